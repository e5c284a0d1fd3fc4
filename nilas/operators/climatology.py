"""Resampling in time, climatologies, anomalies and seasons. Fields have a row for each dataset, time and cell; gaps are missing rows or nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from nilas.functions import calendar as cal

CELL = ("dataset", "y", "x")


def monthly_mean(field: DataFrame, value: str, keys=CELL) -> DataFrame:
    """Mean of each month. field: times, or stretches of times within one month in which time and value are lists."""
    if isinstance(field.schema["time"].dataType, ArrayType):
        there = F.filter(value, lambda x: x.isNotNull())
        total = F.aggregate(there, F.lit(0.0), lambda a, x: a + x)
        return field.groupBy(*keys, F.trunc(F.try_element_at("time", F.lit(1)), "month").alias("time")).agg(F.try_divide(F.sum(total), F.sum(F.size(there))).alias("value"))
    return field.groupBy(*keys, F.trunc("time", "month").alias("time")).agg(F.avg(value).alias("value"))


def daily_mean(field: DataFrame, time: str, value: str, keys=CELL) -> DataFrame:
    return field.groupBy(*keys, F.to_date(time).alias("time")).agg(F.avg(value).alias("value"))


def climatology(field: DataFrame, value: str, keys=CELL) -> DataFrame:
    """Mean of each calendar month, by its real month."""
    return field.groupBy(*keys, "mo").agg(F.avg(value).alias("value"))


def anomaly(field: DataFrame, value: str, keys=CELL) -> DataFrame:
    """value less the mean of its calendar month, in a window: no join back."""
    return field.withColumn("anomaly", F.col(value) - F.avg(value).over(Window.partitionBy(*keys, "mo")))


def all_months(clim: DataFrame, keys) -> DataFrame:
    """A row for each of the 12 months; missing ones are null."""
    months = clim.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(1), F.lit(12))).alias("mo"))
    return months.join(clim, [*keys, "mo"], "left")


def yearly_mean(field: DataFrame, value: str, keys) -> DataFrame:
    """Means of the years that have all 12 months."""
    return field.groupBy(*keys, "yr").agg(F.avg(value).alias("value"), F.count_distinct(F.when(F.col(value).isNotNull(), F.col("mo"))).alias("n")).where("n = 12").drop("n")


def season_mean(field: DataFrame, value: str, keys, least: int = 2, weighted: bool = True) -> DataFrame:
    """Season means by season year, weighted with month lengths, from at least `least` months."""
    w = cal.month_days(F.col("mo")) if weighted else F.lit(1)
    rows = field.where(F.col(value).isNotNull()).withColumns({"season": cal.season(F.col("mo")), "season_year": cal.season_year(F.col("yr"), F.col("mo")), "_w": w})
    out = rows.groupBy(*keys, "season", "season_year").agg((F.sum(F.col(value) * F.col("_w")) / F.sum("_w")).alias("value"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least).drop("n")


def season_map(clim: DataFrame, keys=CELL) -> DataFrame:
    """Season means of a climatology with day weights over all months of the season: a missing month counts as zero."""
    rows = clim.withColumns({"season": cal.season(F.col("mo")), "_w": cal.month_days(F.col("mo"))})
    days = F.element_at(F.create_map(*[F.lit(x) for kv in cal.SEASON_DAYS.items() for x in kv]), F.col("season"))
    return rows.groupBy(*keys, "season").agg(F.sum(F.coalesce(F.col("value") * F.col("_w"), F.lit(0.0))).alias("_s")).select(*keys, "season", (F.col("_s") / days).alias("value"))


def periods(series: DataFrame, value: str, keys) -> DataFrame:
    """The seven periods of a monthly series: annual (all 12 months), four seasons (two months at least, weighted with days), March and September, one value a year. One grouping for all."""
    mo, yr = F.col("mo"), F.col("yr")
    of = lambda period, year, weight, least: F.struct(period.alias("period"), year.cast("int").alias("year"), weight.cast("double").alias("_w"), F.lit(least).alias("_least"))
    own = F.array(of(F.lit("annual"), yr, F.lit(1.0), 12), of(cal.season(mo), cal.season_year(yr, mo), cal.month_days(mo), 2))
    key = F.when(mo.isin(3, 9), F.array(of(F.when(mo == 3, "March").otherwise("September"), yr, F.lit(1.0), 1))).otherwise(F.slice(own, 1, 0))
    rows = series.where(F.col(value).isNotNull()).select(*keys, "mo", F.col(value).alias("_v"), F.explode(F.concat(own, key)).alias("_p")).select(*keys, "mo", "_v", "_p.*")
    months = F.bit_count(F.bit_or(F.expr("shiftleft(1, mo)")))  # different months
    out = rows.groupBy(*keys, "period", "year", "_least").agg((F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias("value"), months.alias("_n"))
    return out.where("_n >= _least").select(*keys, "period", "year", "value")


def season_totals(daily: DataFrame, value: str, keys=CELL) -> DataFrame:
    """Multi-year mean of season sums."""
    rows = daily.withColumns({"season": cal.season(F.col("mo")), "season_year": cal.season_year(F.col("yr"), F.col("mo"))})
    return rows.groupBy(*keys, "season", "season_year").agg(F.sum(value).alias("v")).groupBy(*keys, "season").agg(F.avg("v").alias("value"))


def month_totals(daily: DataFrame, value: str, keys=CELL) -> DataFrame:
    return daily.groupBy(*keys, "yr", "mo").agg(F.sum(value).alias("v")).groupBy(*keys, "mo").agg(F.avg("v").alias("value"))


def normalised_totals(daily: DataFrame, value: str, keys=CELL) -> DataFrame:
    """Season sums scaled from the valid days to the season's canonical days."""
    rows = daily.withColumns({"season": cal.season(F.col("mo")), "season_year": cal.season_year(F.col("yr"), F.col("mo"))})
    days = F.element_at(F.create_map(*[F.lit(x) for kv in cal.SEASON_DAYS.items() for x in kv]), F.col("season"))
    own = rows.groupBy(*keys, "season", "season_year").agg(F.sum(value).alias("v"), F.count(value).alias("n")).where("n > 0")
    return own.withColumn("v", F.col("v") / F.col("n") * days).groupBy(*keys, "season").agg(F.avg("v").alias("value"))


def season_mean_of_means(daily: DataFrame, value: str, keys=CELL) -> DataFrame:
    rows = daily.withColumns({"season": cal.season(F.col("mo")), "season_year": cal.season_year(F.col("yr"), F.col("mo"))})
    return rows.groupBy(*keys, "season", "season_year").agg(F.avg(value).alias("v")).groupBy(*keys, "season").agg(F.avg("v").alias("value"))


def masked_season(field: DataFrame, value: str, threshold: float, keys=CELL) -> DataFrame:
    """Season climatology of the values over a threshold."""
    return field.groupBy(*keys, cal.season(F.col("mo")).alias("season")).agg(F.avg(F.when(F.col(value) > threshold, F.col(value))).alias("value"))


def plain_season(clim: DataFrame, keys=CELL) -> DataFrame:
    """Unweighted mean of the season's months of a climatology; null if any is missing."""
    return clim.groupBy(*keys, cal.season(F.col("mo")).alias("season")).agg(F.when(F.count("value") == 3, F.avg("value")).alias("value"))


def flux_climatology(flux: DataFrame, keys) -> DataFrame:
    """Monthly totals (rate times the true seconds of the month), averaged by calendar month."""
    total = F.col("value") * F.dayofmonth(F.last_day("time")) * 86400
    return flux.withColumn("_t", total).groupBy(*keys, "mo").agg(F.avg("_t").alias("value"))


def season_sum(clim: DataFrame, keys) -> DataFrame:
    return clim.groupBy(*keys, cal.season(F.col("mo")).alias("season")).agg(F.sum("value").alias("value"))


def closed_cycle(clim: DataFrame, keys) -> DataFrame:
    """Domain-mean monthly cycle with January again as month 13."""
    cycle = clim.groupBy(*keys, "mo").agg(F.avg("value").alias("value"))
    return cycle.unionByName(cycle.where("mo = 1").withColumn("mo", F.lit(13)))


def period_value(clim: DataFrame, keys, months=tuple(range(1, 13))) -> DataFrame:
    """Day-weighted mean over the valid months of a climatology."""
    w = cal.month_days(F.col("mo"))
    return clim.where(F.col("mo").isin(*months) & F.col("value").isNotNull()).groupBy(*keys).agg((F.sum(F.col("value") * w) / F.sum(w)).alias("value"))


def area_series(field_grid: DataFrame, keys, value: str = "sic") -> DataFrame:
    """Ice area, extent, marginal and pack area in 10^6 km2 for each time; no ice is 0."""
    c, a = F.col(value), F.col("cell_area")
    part = lambda ok, x: (F.coalesce(F.sum(F.when(ok, x)), F.lit(0.0)) / 1e12)
    return field_grid.groupBy(*keys).agg(
        part(c > 15, c / 100 * a).alias("area"), part(c > 15, a).alias("extent"), part((c > 15) & (c < 90), a).alias("marginal"), part(c >= 90, a).alias("pack")
    )


def lagged(series: DataFrame, value: str, keys, lags=(1,)) -> DataFrame:
    """A monthly series with its values so many months before; by month, not by row: a missing month gives null."""
    i, out = F.col("yr") * 12 + F.col("mo"), series.select(*keys, "yr", "mo", value)
    for k in lags:
        w = Window.partitionBy(*keys).orderBy(i).rangeBetween(-k, -k)
        out = out.withColumn(f"lag_{k}", F.first(value).over(w))
    return out
