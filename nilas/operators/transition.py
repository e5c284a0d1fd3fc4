"""Advance and retreat dates of daily concentration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from nilas.functions.stats import bias, regression, rmse, student_p
from nilas.operators.integrals import area_share
from nilas.operators.skill import area_correlation

#: Threshold, running mean and persistence, in percent and days.
LEVEL, WINDOW, PERSISTENCE = 15.0, 15, 7
CYCLE = ("dataset", "start_year", "y", "x")


def cycles(daily: DataFrame, hemisphere: str = "south", keys=("dataset", "y", "x")) -> DataFrame:
    """start_year (from 1 September in the north, 1 March in the south), day index t and cycle length of each day. Of stretches of days within one month, in which time (and sic) are lists, only the stretches are sorted."""
    first = 9 if hemisphere == "north" else 3
    rows = daily.withColumn("start_year", F.when(F.col("mo") >= first, F.col("yr")).otherwise(F.col("yr") - 1))
    w = Window.partitionBy(*keys, "start_year")
    if isinstance(daily.schema["time"].dataType, ArrayType):
        first, last = F.min(F.array_min("time")).over(w), F.max(F.array_max("time")).over(w)
        rows = rows.withColumns({"_first": first, "cycle": (F.datediff(last, first) + 1).cast("int")})
        rest = [c for c in rows.columns if c not in ("time", "sic", "_first")]
        days = F.arrays_zip("time", "sic") if "sic" in daily.columns else F.arrays_zip("time")
        return rows.select(*rest, "_first", F.explode(days).alias("_d")).select(*rest, "_d.*", F.datediff("_d.time", "_first").alias("t"))
    first, last = F.min("time").over(w), F.max("time").over(w)
    return rows.withColumns({"t": F.datediff("time", first), "cycle": (F.datediff(last, first) + 1).cast("int")})


def smooth(rows: DataFrame, value: str = "sic", window: int = WINDOW, keys=CYCLE) -> DataFrame:
    """Running mean over an odd number of days; the first and last value stand for days outside the cycle, a missing day makes it missing."""
    k = (window - 1) // 2
    w = Window.partitionBy(*keys).orderBy("t")
    near, whole = w.rangeBetween(-k, k), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left, right = F.greatest(F.lit(0), k - F.col("t")), F.greatest(F.lit(0), k - (F.col("cycle") - 1 - F.col("t")))
    edge = lambda n, x: F.when(n > 0, n * x).otherwise(0.0)
    total = F.sum(value).over(near) + edge(left, F.first(value).over(whole)) + edge(right, F.last(value).over(whole))
    return rows.withColumn("smooth", F.when(F.count(value).over(near) == window - left - right, total / window))


def crossings(rows: DataFrame, level: float = LEVEL, persistence: int = PERSISTENCE, keys=CYCLE) -> DataFrame:
    """Whether each day is an upward or downward crossing that persists: the first day over the threshold must be followed by persistence - 1 days over it."""
    w = Window.partitionBy(*keys).orderBy("t")
    after, s, t = w.rangeBetween(1, persistence - 1), F.col("smooth"), F.col("t")
    before, full = F.first("smooth").over(w.rangeBetween(-1, -1)), F.count("smooth").over(after) == persistence - 1
    up = (s >= level) & (before < level) & full & (F.min("smooth").over(after) > level) & t.between(1, F.col("cycle") - persistence - 1)
    down = (s <= level) & (before > level) & full & (F.max("smooth").over(after) < level) & t.between(1, F.col("cycle") - persistence)
    return rows.withColumns({"up": F.coalesce(up, F.lit(False)), "down": F.coalesce(down, F.lit(False))})


def dates(rows: DataFrame, control: bool = True, keys=CYCLE) -> DataFrame:
    """First upward and last downward crossing of each cycle; implausible dates become null, the advance first."""
    out = rows.groupBy(*keys, "cycle").agg(F.min(F.when(F.col("up"), F.col("t"))).alias("advance"), F.max(F.when(F.col("down"), F.col("t"))).alias("retreat"))
    return controlled(out) if control else out


def controlled(out: DataFrame) -> DataFrame:
    """Implausible dates become null, the advance first."""
    a, b = F.col("advance"), F.col("retreat")
    out = out.withColumn("advance", F.when(F.coalesce((a > b) | (a > F.round(0.66 * F.col("cycle"))), F.lit(False)) | F.coalesce(a > F.round(0.66 * F.col("cycle")), F.lit(False)), None).otherwise(a))
    return out.withColumn("retreat", F.when(F.coalesce(b < a, F.lit(False)) | F.coalesce(b < F.round(0.28 * F.col("cycle")), F.lit(False)), None).otherwise(b))


#: Cycles worked out together.
TOGETHER = 512


def _shifted(field: np.ndarray, by: int) -> np.ndarray:
    """The field `by` days on; NaN outside."""
    out = np.full_like(field, np.nan)
    if by > 0:
        out[:, :-by] = field[:, by:]
    elif by < 0:
        out[:, -by:] = field[:, :by]
    else:
        out[:] = field
    return out


def _crossed(batches):
    """Cycles with their days (time, sic) -> cycle, advance and retreat, on arrays (cycle, day): `smooth` and `crossings` for many cycles at once."""
    for whole in batches:
        for rows in (whole.slice(n, TOGETHER) for n in range(0, max(1, len(whole)), TOGETHER)):
            n, days = len(rows), rows["_days"].flatten()
            row = np.repeat(np.arange(n), pc.list_value_length(rows["_days"]).to_numpy())
            time = days.field("time").cast(pa.int32()).to_numpy(zero_copy_only=False).astype("int64")
            sic = days.field("sic").to_numpy(zero_copy_only=False).astype("float64")
            start, end = np.full(n, np.iinfo("int64").max), np.full(n, np.iinfo("int64").min)
            np.minimum.at(start, row, time)
            np.maximum.at(end, row, time)
            cycle, t = end - start + 1, np.arange(int((end - start).max(initial=0)) + 1)
            field = np.full((n, len(t)), np.nan)
            here = np.zeros(field.shape, bool)
            field[row, time - start[row]], here[row, time - start[row]] = sic, True
            k, far = (WINDOW - 1) // 2, cycle[:, None] - 1 - t
            left, right = np.maximum(0, k - t)[None, :], np.maximum(0, np.minimum(k - far, WINDOW))
            edges = np.where(left > 0, left * field[:, :1], 0.0) + np.where(right > 0, right * field[np.arange(n), cycle - 1][:, None], 0.0)
            total, count = np.zeros_like(field), np.zeros(field.shape, "int16")
            for by in range(-k, k + 1):
                part = _shifted(field, by)
                there = ~np.isnan(part)
                total += np.where(there, part, 0.0)
                count += there
            s = np.where(here & (count == WINDOW - left - right), (total + edges) / WINDOW, np.nan)
            after = [_shifted(s, by) for by in range(1, PERSISTENCE)]
            low, high = np.minimum.reduce(after), np.maximum.reduce(after)  # NaN where a day is missing
            before = _shifted(s, -1)
            with np.errstate(invalid="ignore"):
                up = (s >= LEVEL) & (before < LEVEL) & (low > LEVEL) & (t >= 1) & (t <= cycle[:, None] - PERSISTENCE - 1)
                down = (s <= LEVEL) & (before > LEVEL) & (high < LEVEL) & (t >= 1) & (t <= cycle[:, None] - PERSISTENCE)
            first, last = up.argmax(1), len(t) - 1 - down[:, ::-1].argmax(1)
            found = {"cycle": pa.array(cycle.astype("int32")), "_a": pa.array(first.astype("int32"), mask=~up.any(1)), "_b": pa.array(last.astype("int32"), mask=~down.any(1))}
            yield pa.RecordBatch.from_pydict({c: rows[c] for c in rows.schema.names if c != "_days"} | found)


def raw_dates(daily: DataFrame, hemisphere: str = "south") -> DataFrame:
    """First upward and last downward crossing of each cycle, as `crossings` of `smooth` finds them. daily: days, or stretches of days of a cell within one month in which time and sic are lists. A cycle's days are gathered in one row, so none is sorted."""
    first = 9 if hemisphere == "north" else 3
    rows = daily.withColumn("start_year", F.when(F.col("mo") >= first, F.col("yr")).otherwise(F.col("yr") - 1))
    stretches = isinstance(daily.schema["time"].dataType, ArrayType)
    days = F.flatten(F.collect_list(F.arrays_zip("time", "sic"))) if stretches else F.collect_list(F.struct("time", "sic"))
    rows = rows.groupBy(*CYCLE).agg(days.alias("_days"))
    schema = StructType([rows.schema[c] for c in CYCLE] + [StructField(c, IntegerType()) for c in ("cycle", "_a", "_b")])
    return rows.mapInArrow(_crossed, schema).withColumnsRenamed({"_a": "advance", "_b": "retreat"})


def transition_dates(daily: DataFrame, hemisphere: str = "south") -> DataFrame:
    return controlled(raw_dates(daily, hemisphere))


def durations(dates: DataFrame) -> DataFrame:
    """Ice season and open water in days; what isn't positive is null."""
    ice = F.col("retreat") - F.col("advance")
    positive = lambda c: F.when(c > 0, c)
    return dates.withColumn("ice_season", positive(ice)).withColumn("open_water", positive(F.col("cycle") - F.col("ice_season")))


def relation(y: Column, x: Column) -> dict[str, Column]:
    """Regression of y on x over at least three pairs: corr, slope, p, r2 and n."""
    reg = regression(y, x)
    ok = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)) >= 3
    return {"corr": F.when(ok, reg["r"]), "slope": F.when(ok, reg["slope"]), "p": F.when(ok, student_p(reg["r"], reg["n"])), "r2": F.when(ok, reg["r"] * reg["r"]), "n": reg["n"]}


def edge_curve(pairs: DataFrame, obs: str, model: str, area: str, advance: bool, keys) -> DataFrame:
    """Edge error of dates at day thresholds 1, 6, ... 361: each cell counts at every threshold where the sides differ."""
    day = F.explode(F.sequence(F.lit(1), F.lit(365), F.lit(5)))
    hit = lambda c: F.coalesce((F.col(c) <= F.col("day")) if advance else (F.col(c) >= F.col("day")), F.lit(False))
    part = lambda ok: F.coalesce(F.sum(F.when(ok, F.col(area))), F.lit(0.0)) / 1e12
    return pairs.withColumn("day", day).groupBy(*keys, "day").agg(part(hit(model) & ~hit(obs)).alias("over"), part(~hit(model) & hit(obs)).alias("under"))


def lagged_relation(dates: DataFrame) -> DataFrame:
    """(dataset, corr): of a year's mean retreat with the next year's mean advance, from three years on."""
    year = dates.groupBy("dataset", "start_year").agg(F.avg("advance").alias("a"), F.avg("retreat").alias("b"))
    after = F.first("a").over(Window.partitionBy("dataset").orderBy("start_year").rangeBetween(1, 1))
    return year.withColumn("n", after).groupBy("dataset").agg(relation(F.col("n"), F.col("b"))["corr"].alias("lag_corr"))


def phase_maps(dates: DataFrame, least: int = 3) -> DataFrame:
    """(dataset, phase, y, x): climatology, deviation, valid years, trend a year and whether it is significant, from `least` valid years on."""
    long = dates.unpivot(["dataset", "start_year", "y", "x"], ["advance", "retreat"], "phase", "day")
    out = long.groupBy("dataset", "phase", "y", "x").agg(F.avg("day").alias("clim"), F.stddev_pop("day").alias("std"), F.count("day").alias("valid"), regression("day", "start_year").alias("reg"))
    p, ok = student_p(F.col("reg.r"), F.col("reg.n")), F.col("valid") >= least
    return out.select("dataset", "phase", "y", "x", "clim", "std", "valid", F.when(ok, F.col("reg.slope")).alias("trend"), F.when(ok & p.isNotNull(), (p < 0.05).cast("int")).alias("significant"))


def duration_maps(dates: DataFrame) -> DataFrame:
    return durations(dates).groupBy("dataset", "y", "x").agg(F.avg("ice_season").alias("ice_season"), F.avg("open_water").alias("open_water"))


def phase_table(dates: DataFrame) -> DataFrame:
    """Eight columns by dataset and phase: unweighted means of the maps, the significant share in percent, durations and the lagged correlation."""
    maps = phase_maps(dates).groupBy("dataset", "phase").agg(*(F.avg(c).alias(c) for c in ("clim", "std", "trend", "valid")), (100 * F.avg("significant")).alias("significant"))
    length = duration_maps(dates).groupBy("dataset").agg(F.avg("ice_season").alias("ice_season"), F.avg("open_water").alias("open_water"))
    return maps.join(length, "dataset").join(lagged_relation(dates), "dataset")


def phase_differences(dates: DataFrame, grid: DataFrame, reference: str = "obs1") -> DataFrame:
    """Ten columns by dataset and phase against the reference, weighted with cell areas: correlation, error, biases, the dataset's significant share and valid years, durations."""
    area = grid.select("y", "x", "cell_area")
    values = ["clim", "trend", "ice_season", "open_water"]
    maps = phase_maps(dates).join(duration_maps(dates), ["dataset", "y", "x"], "left")
    base = maps.where(F.col("dataset") == reference).select("phase", "y", "x", *(F.col(c).alias(f"_{c}") for c in values))
    both = maps.where(F.col("dataset") != reference).join(base, ["phase", "y", "x"]).join(area, ["y", "x"])
    w, keys = F.col("cell_area"), ["dataset", "phase"]
    of = lambda f, c: f(F.col(c), F.col(f"_{c}"), w)
    length = F.when(F.col("phase") == "advance", of(rmse, "ice_season")).otherwise(of(rmse, "open_water"))
    out = both.groupBy(*keys).agg(
        of(rmse, "clim").alias("rmse"), of(bias, "clim").alias("bias"), of(bias, "trend").alias("trend_bias"), area_share(F.col("significant"), w).alias("significant"), F.avg("valid").alias("valid"),
        of(bias, "ice_season").alias("ice_season_bias"), of(bias, "open_water").alias("open_water_bias"), length.alias("duration_rmse"),
    )
    lag = lagged_relation(dates)
    first = lag.where(F.col("dataset") == reference).select(F.col("lag_corr").alias("_lag"))  # one row
    lag = lag.crossJoin(F.broadcast(first)).select("dataset", (F.col("lag_corr") - F.col("_lag")).alias("lag_corr_bias"))
    return area_correlation(both, "_clim", "clim", "cell_area", keys, 3).withColumnRenamed("value", "corr").join(out, keys, "right").join(lag, "dataset")
