"""Trends, variability and significance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nilas.functions.stats import regression, student_p


def with_p(df: DataFrame, reg: str = "reg") -> DataFrame:
    return df.withColumn("p", student_p(F.col(f"{reg}.r"), F.col(f"{reg}.n")))


def series_trend(series: DataFrame, value: str, x: str, keys) -> DataFrame:
    """Regression of each series on x: slope, intercept, r, n, detrended deviation and p. With two points r is 1 or -1 and p is 0."""
    out = with_p(series.groupBy(*keys).agg(regression(value, x).alias("reg")))
    return out.withColumn("p", F.when((F.col("reg.n") == 2) & F.col("reg.r").isNotNull(), 0.0).otherwise(F.col("p"))).select(*keys, "reg.*", "p")


def map_trend(field: DataFrame, value: str, x: Column, keys, least: Column | int, factor: float) -> DataFrame:
    """Trend, p and detrended deviation of each cell with at least `least` valid points."""
    out = with_p(field.groupBy(*keys).agg(regression(F.col(value), x).alias("reg"), F.count(value).alias("valid")))
    ok = F.col("valid") >= least
    return out.select(*keys, "valid", F.when(ok, F.col("reg.slope") * factor).alias("trend"), F.when(ok, F.col("p")).alias("p"), F.when(ok, F.col("reg.rest")).alias("rest"))


def period_statistics(periods: DataFrame, keys, factor: float = 120.0) -> DataFrame:
    """Mean, trend, detrended deviation, p and significance of each period's yearly values. The key months' trends take `factor`, others 10."""
    out = with_p(periods.groupBy(*keys, "period").agg(F.avg("value").alias("mean"), regression("value", "year").alias("reg")))
    scale = F.when(F.col("period").isin("March", "September"), factor).otherwise(10.0)
    return out.select(*keys, "period", "mean", (F.col("reg.slope") * scale).alias("trend"), F.col("reg.rest").alias("detrended_std"), "p", (F.col("p") < 0.05).alias("significant"))


def significance(p: Column, alpha: float = 0.05) -> Column:
    return F.when(p.isNotNull(), (p < alpha).cast("int"))


def compacted_trend(series: DataFrame, value: str, keys, order: str = "time") -> DataFrame:
    """Trend on the rank of the valid points."""
    rows = series.where(F.col(value).isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return rows.groupBy(*keys).agg(regression(value, "rank").alias("reg")).select(*keys, F.col("reg.slope").alias("slope"))
