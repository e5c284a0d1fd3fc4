"""Ensembles, tables, records and statistics across them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nilas.functions.stats import correlation, regression

RECORD = ("hemisphere", "module", "region", "coverage_mode", "view_mode", "domain_kind", "domain_key", "metric_name", "metric_unit", "dataset_name", "dataset_type", "value")


def group_stat(rows: DataFrame, members: DataFrame, keys, value: str, std: bool = False) -> DataFrame:
    """Mean (or spread) of a metric over each group's members; only keys that all members have."""
    size = members.groupBy("group").agg(F.count_distinct("member").alias("_size"))
    joined = rows.join(members, F.col("dataset") == F.col("member")).join(F.broadcast(size), "group")
    stat = F.stddev_pop(value) if std else F.avg(value)
    out = joined.groupBy("group", *keys, "_size").agg(stat.alias("value"), F.count_distinct("member").alias("_n"))
    return out.where("_n = _size").drop("_n", "_size")


def wide(rows: DataFrame, keys, name: str, value: str, names: list[str]) -> DataFrame:
    return rows.groupBy(*keys).pivot(name, names).agg(F.first(value))


def differences(rows: DataFrame, keys, value: str, reference: str = "obs1") -> DataFrame:
    """|x - reference| by dataset; the reference itself is 0."""
    base = rows.where(F.col("dataset") == reference).select(*keys, F.col(value).alias("_base"))
    return rows.join(base, keys).withColumn(value, F.abs(F.col(value) - F.col("_base"))).drop("_base")


def records(rows: DataFrame, metrics: list[str], **fixed: str) -> DataFrame:
    """Wide metric columns (dataset, region) melted to the record columns."""
    from nilas.operators.clean import dataset_class

    long = rows.unpivot(["dataset", "region"], metrics, "metric_name", "value")
    extra = {"metric_unit": unit(F.col("metric_name")), "dataset_name": F.col("dataset"), "dataset_type": dataset_class(F.col("dataset"))} | {k: F.lit(v) for k, v in fixed.items()}
    return long.withColumns(extra).select(*RECORD)


def unit(name: Column) -> Column:
    """The unit that a metric's name tells."""
    return (
        F.when(name.contains("trend") & name.contains("extent"), "10^6 km2/decade").when(name.contains("extent") | name.contains("area"), "10^6 km2")
        .when(name.startswith("thick"), "m").when(name.contains("energy"), "m2/s2").when(name.startswith("speed"), "m/s").otherwise("")
    )


def catalog(rows: DataFrame) -> DataFrame:
    """The different options of each hemisphere and module, sorted."""
    options = ("region", "coverage_mode", "view_mode", "metric_name", "dataset_name")
    return rows.groupBy("hemisphere", "module").agg(*(F.array_join(F.sort_array(F.collect_set(c)), ",").alias(c) for c in options))


def average_rank(value: str, keys) -> Column:
    """Ranks from 1; ties share the mean of their ranks."""
    w = Window.partitionBy(*keys).orderBy(value)
    ties = Window.partitionBy(*keys, value)
    return F.rank().over(w) + (F.count("*").over(ties) - 1) / 2


#: A prime and multipliers of the generator of shuffles: whole numbers under 2 to the 62, so that any engine gives the same.
PRIME, BY_DRAW, BY_PLACE, AGAIN = 2147483647, 69621, 16807, 48271


def shuffle_key(draw: str, place: str) -> str:
    """SQL, for Spark and others, of the number by which a place is sorted in a draw."""
    first = f"(({BY_DRAW} * {draw} + {BY_PLACE} * {place} + 1) % {PRIME})"
    second = f"(({first} * {first} + {AGAIN} * {draw} + {place}) % {PRIME})"
    return f"(({second} * {second} + {BY_PLACE} * {first}) % {PRIME})"


def permutation_p(pairs: DataFrame, draws: int = 1200, id_: str = "id") -> DataFrame:
    """Share of shuffles whose |r| reaches the observed one, (hits + 1) / (draws + 1); three pairs at least. Shuffles sort places by arithmetic on draw and place, so they repeat; pairs are a small table of datasets."""
    points = pairs.withColumn("_k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(id_)))
    observed = pairs.agg(F.abs(correlation(F.col("y"), F.col("x"))).alias("_r"), F.count("*").alias("_n"))
    draw = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(draws).cast("long")))
    left = points.select(draw.alias("draw"), F.col("_k").cast("long").alias("_k"), "x")
    right = points.select(draw.alias("draw"), F.col("_k").cast("long").alias("_k"), "y").select("draw", "y", F.row_number().over(Window.partitionBy("draw").orderBy(F.expr(shuffle_key("draw", "_k")), "_k")).cast("long").alias("_k"))
    rs = left.join(right, ["draw", "_k"]).groupBy("draw").agg(F.abs(correlation(F.col("y"), F.col("x"))).alias("r"))
    hits = rs.crossJoin(F.broadcast(observed)).groupBy("_r", "_n").agg(F.sum((F.col("r") >= F.col("_r") - 1e-12).cast("int")).alias("hits"))
    return hits.where("_n >= 3").select(F.col("_r").alias("r"), ((F.col("hits") + 1) / (draws + 1)).alias("p"))


def leave_one_out(pairs: DataFrame, id_: str = "id") -> DataFrame:
    """The dataset whose absence changes r most, and the change; four pairs at least. From sums: no pair of rows meets."""
    s = pairs.agg(*(F.sum(e).alias(n) for n, e in (("n", F.lit(1)), ("sx", F.col("x")), ("sy", F.col("y")), ("sxx", F.col("x") * F.col("x")), ("syy", F.col("y") * F.col("y")), ("sxy", F.col("x") * F.col("y")))))
    rows = pairs.crossJoin(F.broadcast(s)).where("n >= 4")  # one row of sums

    def r(n, sx, sy, sxx, syy, sxy):
        return F.try_divide(n * sxy - sx * sy, F.sqrt(F.greatest(F.lit(0.0), (n * sxx - sx * sx) * (n * syy - sy * sy))))

    whole = [F.col(c).cast("double") for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]
    x, y = F.col("x"), F.col("y")
    less = [a - b for a, b in zip(whole, (F.lit(1.0), x, y, x * x, y * y, x * y), strict=True)]
    rows = rows.select(id_, (r(*less) - r(*whole)).alias("delta"))
    return rows.groupBy().agg(F.max_by(F.struct(id_, "delta"), F.struct(F.abs("delta"), id_)).alias("s")).select("s.*")


def screen(rows: DataFrame, by: str, least: int = 4) -> DataFrame:
    """Correlation and regression of every pair of metrics over the datasets they share.

    The rows are shuffled once: each dataset's metrics (as many as there are metrics) are gathered and their pairs go straight into partial moments, of which a task sends one row a pair on. Rows without a value are left out.
    """
    held = rows.where(F.col("value").isNotNull()).groupBy(by).agg(F.collect_list(F.struct(F.col("metric").alias("m"), F.col("value").alias("v"))).alias("_held"))
    pairs = held.select(F.explode("_held").alias("a"), "_held").select("a", F.explode(F.filter("_held", lambda b: b["m"] > F.col("a.m"))).alias("b"))
    pairs = pairs.select(F.col("a.m").alias("metric_x"), F.col("b.m").alias("metric_y"), F.col("a.v").alias("x"), F.col("b.v").alias("y"))
    return pairs.groupBy("metric_x", "metric_y").agg(F.count("*").alias("n"), regression("y", "x").alias("reg")).where(F.col("n") >= least).select("metric_x", "metric_y", "n", "reg.r", "reg.slope", "reg.intercept")


#: Bins of one pass of `quantiles`, and passes before values are counted singly.
BINS, PASSES = 4096, 3


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], bins: int = BINS, passes: int = PASSES) -> DataFrame:
    """(keys, share, value): exact quantiles between ranks, as `percentile` gives them. Null and NaN values don't count.

    Each pass counts the values of each bin of a range, by partial aggregation, and keeps the bin that holds a wanted rank; the next pass divides what that bin really spans. At last the different values that remain are counted
    singly. So no task holds a key's values: a window sees at most `bins` rows a key and rank, and in the end the different values of one small bin.
    """
    rows = rows.select(*keys, F.nanvl(F.col(value), F.lit(None).cast("double")).alias("_v")).where("_v IS NOT NULL")
    ranks = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wanted = F.explode(F.array(*(F.struct(F.lit(s).alias("share"), (F.lit(s) * (F.col("_n") - 1)).alias("at")) for s in shares)))
    ranks = ranks.withColumn("_w", wanted).select(*keys, "_lo", "_hi", F.col("_w.share").alias("share"), F.col("_w.at").alias("_at"), F.explode(F.array_distinct(F.array(F.floor("_w.at"), F.ceil("_w.at")))).alias("_rank"))
    # the rank inside what is left of the range
    goals = ranks.select(*keys, "_lo", "_hi", F.col("_rank").alias("_goal"), F.col("_rank").alias("_left")).distinct()

    def inside(goals: DataFrame) -> DataFrame:
        few = F.broadcast(goals)  # two rows a key and share: else all rows of a key would be shuffled to one task
        return (rows.join(few, keys) if keys else rows.crossJoin(few)).where("_v BETWEEN _lo AND _hi")

    def chosen(counted: DataFrame, order: str) -> DataFrame:
        before = F.sum("_count").over(Window.partitionBy(*keys, "_goal").orderBy(order)) - F.col("_count")
        return counted.withColumn("_before", before).where("_left >= _before AND _left < _before + _count").withColumn("_left", F.col("_left") - F.col("_before"))

    for _ in range(passes):
        width = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
        bin_ = F.least(F.lit(bins - 1), F.coalesce(F.floor((F.col("_v") - F.col("_lo")) / width * bins), F.lit(0)))
        counted = inside(goals).groupBy(*keys, "_goal", "_left", bin_.alias("_bin")).agg(F.count("*").alias("_count"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        goals = chosen(counted, "_bin").select(*keys, "_lo", "_hi", "_goal", "_left")
    counted = inside(goals).groupBy(*keys, "_goal", "_left", "_v").agg(F.count("*").alias("_count"))
    found = chosen(counted, "_v").select(*keys, F.col("_goal").alias("_rank"), "_v")
    part = 1 - F.abs(F.col("_at") - F.col("_rank"))
    return ranks.join(found, [*keys, "_rank"]).groupBy(*keys, "share").agg(F.sum(F.col("_v") * part).alias("value"))
