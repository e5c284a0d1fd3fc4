"""Statistics by domain (annual, seasons, calendar months) of monthly fields and series, of one dataset and of pairs.

Fields have a row for each dataset, month and cell with columns yr, mo, y, x; series have none of y and x. A domain's samples are
the months themselves (annual), the means of a season year's months (two at least), or the same month of each year. Trends are a decade's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nilas.functions import calendar as cal
from nilas.functions.stats import correlation, mae, regression, rmse, weighted_mean
from nilas.operators.skill import day_weighted, edge_error

CELL = ["y", "x"]
ANNUAL = "annual"


def names(month: Column) -> list[Column]:
    return [F.lit(ANNUAL), cal.season(month), F.concat(F.lit("month "), month.cast("string"))]


def per_decade() -> Column:
    """Samples of the column `domain` in ten years."""
    return F.when(F.col("domain") == ANNUAL, 120.0).otherwise(10.0)


def samples(field: DataFrame, values: list[str], keys) -> DataFrame:
    """(keys, domain, t, and for each value its mean and its anomaly <value>_an from the month's climatology)."""
    clim = Window.partitionBy(*keys, "mo")
    rows = field.select(*keys, "yr", "mo", *values, *((F.col(v) - F.avg(v).over(clim)).alias(f"{v}_an") for v in values))
    at = [F.col("yr") * 12 + F.col("mo"), cal.season_year(F.col("yr"), F.col("mo")), F.col("yr")]
    own = F.array(*(F.struct(n.alias("domain"), x.cast("int").alias("t")) for n, x in zip(names(F.col("mo")), at, strict=True)))
    rows = rows.withColumn("_d", F.explode(own)).select(*rows.columns, "_d.domain", "_d.t")
    least = F.when(F.col("domain").isin(*cal.SEASONS), 2).otherwise(1)
    return rows.groupBy(*keys, "domain", "t").agg(*(F.when(F.count(c) >= least, F.avg(c)).alias(c) for v in values for c in (v, f"{v}_an")))


def climatologies(field: DataFrame, values: list[str], keys) -> DataFrame:
    """(keys, domain, values): the calendar months' climatologies, weighted with their days."""
    clim = field.groupBy(*keys, "mo").agg(*(F.avg(v).alias(v) for v in values)).withColumn("domain", F.explode(F.array(*names(F.col("mo")))))
    days = cal.month_days(F.col("mo"))
    return clim.groupBy(*keys, "domain").agg(*(weighted_mean(F.col(v), days).alias(v) for v in values))


def map_statistics(field: DataFrame, values: list[str], keys, detrended: bool = False) -> DataFrame:
    """(keys, cell, domain, and for each value <value>_std and <value>_trend of its anomalies)."""
    cells = [*keys, *CELL]
    own = samples(field, values, cells).groupBy(*cells, "domain").agg(*(regression(f"{v}_an", "t").alias(f"_{v}") for v in values), *(F.stddev_pop(f"{v}_an").alias(f"{v}_std") for v in values))
    return own.select(*cells, "domain", *(x for v in values for x in (F.col(f"_{v}.rest" if detrended else f"{v}_std").alias(f"{v}_std"), (F.col(f"_{v}.slope") * per_decade()).alias(f"{v}_trend"))))


def series_statistics(series: DataFrame, values: list[str], keys) -> DataFrame:
    """(keys, domain, and for each value its climatological mean, and deviation and trend of its anomalies over the rank of the samples; with two values also corr and rmse)."""
    own = samples(series, values, keys).where(" AND ".join(f"{v}_an IS NOT NULL" for v in values))
    own = own.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "domain").orderBy("t")))
    stats = [x for v in values for x in (F.stddev_pop(f"{v}_an").alias(f"{v}_std"), regression(f"{v}_an", "_k").alias(f"_{v}"))]
    if len(values) == 2:
        a, b = (F.col(f"{v}_an") for v in values)
        stats += [F.when(F.count("*") >= 2, correlation(b, a)).alias("corr"), F.when(F.count("*") >= 2, rmse(b, a, F.lit(1.0))).alias("rmse")]
    out = own.groupBy(*keys, "domain").agg(*stats)
    out = out.select(*keys, "domain", *(x for v in values for x in (F.col(f"{v}_std"), (F.col(f"_{v}.slope") * per_decade()).alias(f"{v}_trend"))), *(["corr", "rmse"] if len(values) == 2 else []))
    return climatologies(series, values, keys).withColumnsRenamed({v: f"{v}_mean" for v in values}).join(out, [*keys, "domain"], "left")


def map_differences(pairs: DataFrame, keys, weight: str | None = None, detrended: bool = False) -> DataFrame:
    """(keys, domain, mean, std, trend): mean absolute differences of the maps of a and b. The annual mean is that of the monthly maps, weighted with days."""
    cells, w = [*keys, *CELL], F.lit(1.0) if weight is None else F.col(weight)
    area = [] if weight is None else [F.max(weight).alias(weight)]
    diff = lambda x, y: mae(F.col(y), F.col(x), w)
    clim = pairs.groupBy(*cells, "mo").agg(F.avg("a").alias("a"), F.avg("b").alias("b"), *area)
    year = day_weighted(clim.groupBy(*keys, "mo").agg(diff("a", "b").alias("mean")), ["mean"], keys).withColumn("domain", F.lit(ANNUAL))
    weights = None if weight is None else pairs.groupBy(*cells).agg(*area)
    with_area = lambda df: df if weights is None else df.join(weights, cells)
    parts = with_area(climatologies(pairs, ["a", "b"], cells)).where(F.col("domain") != ANNUAL).groupBy(*keys, "domain").agg(diff("a", "b").alias("mean"))
    maps = with_area(map_statistics(pairs, ["a", "b"], keys, detrended)).groupBy(*keys, "domain").agg(diff("a_std", "b_std").alias("std"), diff("a_trend", "b_trend").alias("trend"))
    return year.unionByName(parts).join(maps, [*keys, "domain"], "left")


def series_differences(series: DataFrame, keys, signed: bool = False) -> DataFrame:
    """(keys, domain, mean, std, trend, corr, rmse) between the series a and b; differences are absolute, or b less a."""
    own = series_statistics(series, ["a", "b"], keys)
    size = (lambda c: c) if signed else F.abs
    return own.select(*keys, "domain", *(size(F.col(f"b_{k}") - F.col(f"a_{k}")).alias(k) for k in ("mean", "std", "trend")), "corr", "rmse")


def edge_by_domain(pairs: DataFrame, reference: str, model: str, area: str, keys) -> DataFrame:
    """(keys, domain, edge): the integrated edge error's monthly climatology, weighted with days."""
    monthly = edge_error(pairs, reference, model, area, [*keys, "yr", "mo"]).withColumnRenamed("total", "edge")
    return climatologies(monthly, ["edge"], keys)


def against(field: DataFrame, values: list[str], reference: str = "obs1", how: str = "inner") -> DataFrame:
    """(dataset, yr, mo, cell, and each value as a_<value> of the reference and b_<value> of the dataset), for every other dataset; with how = left or outer, gaps are null."""
    on = ["yr", "mo", *CELL]
    base = field.where(F.col("dataset") == reference).select(*on, *(F.col(v).alias(f"a_{v}") for v in values))
    own = field.where(F.col("dataset") != reference).select("dataset", *on, *(F.col(v).alias(f"b_{v}") for v in values))
    if how == "inner":
        return own.join(base, on)
    base = base.crossJoin(F.broadcast(own.select("dataset").distinct()))  # a row for each dataset compared
    return own.join(base, ["dataset", *on], "full")


def pair_of(pairs: DataFrame, value: str) -> DataFrame:
    """a and b of one value of `against`."""
    return pairs.withColumns({"a": F.col(f"a_{value}"), "b": F.col(f"b_{value}")})


def area_weighted_sum(pairs: DataFrame, keys, area: str) -> DataFrame:
    """Series a and b of the sums over cells, times area, where both are there."""
    ok = F.col("a").isNotNull() & F.col("b").isNotNull()
    return pairs.where(ok).groupBy(*keys, "yr", "mo").agg(F.sum(F.col("a") * F.col(area)).alias("a"), F.sum(F.col("b") * F.col(area)).alias("b"))


def season_pair_table(sic: DataFrame, series: DataFrame, edges: DataFrame) -> DataFrame:
    """Ten columns by dataset and domain: differences of concentration maps, of extent and area series (a_extent, b_extent, ...), and the edge error."""
    out = map_differences(sic, ["dataset"], detrended=True).withColumnsRenamed({k: f"sic_{k}" for k in ("mean", "std", "trend")})
    for name in ("extent", "area"):
        own = series_differences(pair_of(series, name), ["dataset"]).select("dataset", "domain", *(F.col(k).alias(f"{name}_{k}") for k in ("mean", "std", "trend")))
        out = out.join(own, ["dataset", "domain"], "left")
    return out.join(edges.withColumnRenamed("edge", "edge_mean"), ["dataset", "domain"], "left")


def ratios(rows: DataFrame, columns: list[str], keys, second: str = "obs2") -> DataFrame:
    """Each dataset's columns as a ratio to those of the second observation (denominators of 1e-9 at least)."""
    base = rows.where(F.col("dataset") == second).select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    return rows.join(base, list(keys), "left").select("dataset", *keys, *(F.when(F.col(f"_{c}").isNotNull(), F.abs(F.col(c)) / F.greatest(F.abs(F.col(f"_{c}")), F.lit(1e-9))).alias(c) for c in columns))
