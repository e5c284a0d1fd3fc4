"""A and V: area and volume series, product sets, trends and significance."""

from __future__ import annotations

from pyspark.sql import functions as F

from nilas.functions.stats import regression, student_p
from nilas.functions.stats import rounded as r
from nilas.functions.stats import sql_corr, sql_p, sql_rest, sql_slope, sql_stderr
from nilas.functions.stats import sql_round as q
from nilas.operators import climatology as c
from nilas.operators import integrals as n
from nilas.operators import trends as t
from nilas.plans.climatology import CELL, SERIES, series, sql_periods
from nilas.plans.registry import query

DS = ["dataset", "sector"]
INDEX = "((yr - 1995) * 12 + mo - 1)"
index = lambda: (F.col("yr") - 1995) * 12 + F.col("mo") - 1


def rounded(df, *keys, digits=6):
    """Keys as they are, doubles rounded."""
    return df.select(*keys, *(r(F.col(k), digits).alias(k) if kind == "double" else k for k, kind in df.dtypes if k not in keys))


for _id, _name in (("A1", "area"), ("A2", "extent"), ("A3", "marginal"), ("A4", "pack")):
    query(f"{_id}_ice_{_name}", f"WITH {SERIES} SELECT dataset, sector, time, {q(_name)} AS {_name} FROM series")(lambda v, k=_name: series(v).select(*DS, "time", r(F.col(k)).alias(k)))
query("A5_volume", f"SELECT dataset, sector, time, {q('sum(thick / 1e3 * cell_area / 1e6) / 1e3')} AS volume FROM fieldg JOIN sectors USING (region) GROUP BY ALL")(
    lambda v: v.field_grid.join(v.sectors, "region").groupBy(*DS, "time").agg(r(n.volume(F.col("thick"), F.col("cell_area"))).alias("volume"))
)
query("A6_kinetic_energy", f"SELECT dataset, time, {q('avg((u * u + v * v) / 2)')} AS energy, {q('avg(sqrt(u * u + v * v))')} AS speed FROM field GROUP BY ALL")(
    lambda v: v.field.groupBy("dataset", "time").agg(r(F.avg(n.kinetic_energy(F.col("u"), F.col("v")))).alias("energy"), r(F.avg(n.speed(F.col("u"), F.col("v")))).alias("speed"))
)
query("A12_area_mean", f"SELECT dataset, yr, {q('sum(thick * cell_area) / sum(cell_area)')} AS value FROM fieldg GROUP BY ALL")(lambda v: v.field_grid.groupBy("dataset", "yr").agg(r(n.area_mean(F.col("thick"), F.col("cell_area"))).alias("value")))

# Product sets of one dataset: climatology, anomaly deviation, trend with p.

TREND = f"{sql_slope('extent', 'i')} AS slope, regr_intercept(extent, i) AS intercept, {sql_corr('extent', 'i')} AS r, regr_count(extent, i) AS n, {sql_rest('extent', 'i')} AS rest, {sql_stderr('extent', 'i')} AS stderr"
query("V1_series_trend", f"WITH {SERIES}, s AS (SELECT *, {INDEX} AS i FROM series), g AS (SELECT dataset, sector, {TREND} FROM s GROUP BY ALL) SELECT dataset, sector, {q('slope')} AS slope, {q('intercept')} AS intercept, {q('r')} AS r, CAST(n AS BIGINT) AS n, {q('rest')} AS rest, {q('stderr')} AS stderr, {q(sql_p('r', 'n'), 4)} AS p FROM g")(
    lambda v: rounded(t.series_trend(series(v).withColumn("i", index()), "extent", "i", DS), *DS).withColumn("p", r(F.col("p"), 4)).withColumn("n", F.col("n").cast("long"))
)


def sql_map(value, source, x, keys, least, factor):
    """Rounded trend, p and deviation by key, from a CTE or table."""
    return f"""g AS (SELECT {keys}, count({value}) AS valid, {sql_slope(value, x)} AS slope, {sql_corr(value, x)} AS r, CAST(regr_count({value}, {x}) AS BIGINT) AS n, {sql_rest(value, x)} AS rest FROM {source} GROUP BY ALL)
    SELECT {keys}, CAST(valid AS BIGINT) AS valid, {q(f'CASE WHEN valid >= {least} THEN slope * {factor} END', 4)} AS trend, {q(f'CASE WHEN valid >= {least} THEN {sql_p("r", "n")} END', 4)} AS p, {q(f'CASE WHEN valid >= {least} THEN rest END', 4)} AS rest FROM g"""


query("V2_monthly_map_trend", f"WITH a AS (SELECT dataset, y, x, {INDEX} AS i, sic - avg(sic) OVER (PARTITION BY dataset, y, x, mo) AS an FROM field), {sql_map('an', 'a', 'i', 'dataset, y, x', '(SELECT n // 2 + 1 FROM span)', 120)}")(
    lambda v: rounded(t.map_trend(c.anomaly(v.field, "sic"), "anomaly", index(), CELL, v.half, 120.0), *CELL, digits=4)
)
query("V3_yearly_map_trend", f"WITH a AS (SELECT dataset, y, x, yr, avg(sic) AS m FROM field GROUP BY ALL HAVING count(DISTINCT mo) = 12), {sql_map('m', 'a', 'yr', 'dataset, y, x', 2, 10)}")(
    lambda v: rounded(t.map_trend(c.yearly_mean(v.field, "sic", CELL), "value", F.col("yr"), CELL, 2, 10.0), *CELL, digits=4)
)
query("V4_student_p", f"WITH k AS (SELECT o_orderkey % 97 + 3 AS n, (o_custkey % 199 - 99) / CAST(101 AS DOUBLE) AS r FROM orders GROUP BY ALL) SELECT CAST(n AS BIGINT) AS n, r, {q(sql_p('r', 'n'), 6)} AS p FROM k")(
    lambda v: v.table("orders").select((F.col("o_orderkey") % 97 + 3).alias("n"), ((F.col("o_custkey") % 199 - 99) / 101.0).alias("r")).distinct().select("n", "r", r(student_p(F.col("r"), F.col("n"))).alias("p"))
)
PSTAT = f"""st AS (SELECT dataset, sector, period, avg(value) AS mean, {sql_slope('value', 'year')} * CASE WHEN period IN ('March', 'September') THEN 120 ELSE 10 END AS trend, {sql_rest('value', 'year')} AS rest, {sql_corr('value', 'year')} AS r, CAST(regr_count(value, year) AS BIGINT) AS n FROM p GROUP BY dataset, sector, period)"""
query("V5_detrended_period", f"WITH {SERIES}, p AS ({sql_periods('series', 'extent', 'dataset, sector')}), {PSTAT} SELECT dataset, sector, period, {q('mean')} AS mean, {q('rest')} AS detrended_std, ({sql_p('r', 'n')} < 0.05) AS significant FROM st")(
    lambda v: t.period_statistics(c.periods(series(v), "extent", DS), DS).select(*DS, "period", r(F.col("mean")).alias("mean"), r(F.col("detrended_std")).alias("detrended_std"), "significant")
)
METRIC = "l AS (UNPIVOT series ON area, extent, marginal, pack INTO NAME metric VALUE value)"
KEYS = [*DS, "metric"]
long_series = lambda v: series(v).unpivot([*DS, "time", "yr", "mo"], ["area", "extent", "marginal", "pack"], "metric", "value")
SQL_V6 = (
    f"WITH {SERIES}, {METRIC}, p AS ({sql_periods('l', 'value', 'dataset, sector, metric')}), " + PSTAT.replace("dataset, sector, period", "dataset, sector, metric, period")
    + f" SELECT dataset, sector, metric, period, {q('mean')} AS mean, {q('trend', 4)} AS trend, {q('rest', 4)} AS detrended_std, {q(sql_p('r', 'n'), 4)} AS p, ({sql_p('r', 'n')} < 0.05) AS significant FROM st"
)


def period_table(v, sectors=None):
    out = t.period_statistics(c.periods(long_series(v), "value", KEYS), KEYS)
    return out.select(*KEYS, "period", r(F.col("mean")).alias("mean"), *(r(F.col(k), 4).alias(k) for k in ("trend", "detrended_std", "p")), "significant")


query("V6_period_statistics", SQL_V6 + " WHERE sector = 'All'")(lambda v: period_table(v).where("sector = 'All'"))
query("V7_sector_period_statistics", SQL_V6)(period_table)
query("V8_interannual_std", f"WITH s AS (SELECT dataset, y, x, yr, avg(thick) AS m FROM field GROUP BY ALL HAVING count(DISTINCT mo) = 12) SELECT dataset, y, x, {q('stddev_pop(m)')} AS std FROM s GROUP BY ALL")(
    lambda v: c.yearly_mean(v.field, "thick", CELL).groupBy(*CELL).agg(r(F.stddev_pop("value")).alias("std"))
)
query("V10_significance_mask", f"WITH a AS (SELECT dataset, y, x, {INDEX} AS i, thick FROM field), g AS (SELECT dataset, y, x, {sql_corr('thick', 'i')} AS r, CAST(regr_count(thick, i) AS BIGINT) AS n FROM a GROUP BY ALL) SELECT dataset, y, x, CASE WHEN {sql_p('r', 'n')} IS NOT NULL THEN CAST({sql_p('r', 'n')} < 0.05 AS INT) END AS flag FROM g")(
    lambda v: t.with_p(v.field.groupBy(*CELL).agg(regression(F.col("thick"), index()).alias("reg"))).select(*CELL, t.significance(F.col("p")).alias("flag"))
)
query("V11_samples_per_year_trend", f"WITH a AS (SELECT dataset, y, x, {INDEX} AS i, u FROM field) SELECT dataset, y, x, {q(sql_slope('u', 'i') + ' * 12 * 10', 4)} AS trend FROM a GROUP BY ALL")(lambda v: v.field.groupBy(*CELL).agg(r(regression(F.col("u"), index())["slope"] * 12 * 10, 4).alias("trend")))
query("V12_compacted_trend", f"WITH s AS (SELECT dataset, time, avg(nullif(u, 0)) AS m FROM field GROUP BY ALL), k AS (SELECT dataset, m, row_number() OVER (PARTITION BY dataset ORDER BY time) AS i FROM s WHERE m IS NOT NULL) SELECT dataset, {q(sql_slope('m', 'i') + ' * 120', 5)} AS trend FROM k GROUP BY ALL")(
    lambda v: t.compacted_trend(v.field.groupBy("dataset", "time").agg(F.avg(F.nullif("u", F.lit(0.0))).alias("m")), "m", ["dataset"]).select("dataset", r(F.col("slope") * 120, 5).alias("trend"))
)
query("V13_mean_map_trend", f"WITH a AS (SELECT dataset, y, x, {INDEX} AS i, thick FROM field), m AS (SELECT dataset, {sql_slope('thick', 'i')} * 120 AS tr, stddev_pop(thick) AS sd FROM a GROUP BY dataset, y, x) SELECT dataset, {q('avg(abs(tr))', 4)} AS mean_abs_trend, {q('avg(tr)', 4)} AS mean_trend, {q('avg(sd)', 4)} AS mean_std FROM m GROUP BY ALL")(
    lambda v: v.field.groupBy(*CELL).agg((regression(F.col("thick"), index())["slope"] * 120).alias("tr"), F.stddev_pop("thick").alias("sd")).groupBy("dataset").agg(r(F.avg(F.abs("tr")), 4).alias("mean_abs_trend"), r(F.avg("tr"), 4).alias("mean_trend"), r(F.avg("sd"), 4).alias("mean_std"))
)
query("V15_drift_speed_trend", f"WITH a AS (SELECT dataset, y, x, {INDEX} AS i, sqrt(u * u + v * v) AS w FROM field), g AS (SELECT dataset, y, x, count(w) AS valid, {sql_slope('w', 'i')} * 120 AS tr, {sql_corr('w', 'i')} AS r, CAST(regr_count(w, i) AS BIGINT) AS n FROM a GROUP BY ALL) SELECT dataset, y, x, {q('CASE WHEN (SELECT n FROM span) - valid <= (SELECT n // 2 FROM span) THEN tr END', 4)} AS trend, {q('CASE WHEN (SELECT n FROM span) - valid <= (SELECT n // 2 FROM span) THEN ' + sql_p('r', 'n') + ' ELSE 1 END', 4)} AS p FROM g")(
    lambda v: t.with_p(v.field.groupBy(*CELL).agg(F.count("u").alias("valid"), regression(n.speed(F.col("u"), F.col("v")), index()).alias("reg")))
    .select(*CELL, r(F.when(v.months - F.col("valid") <= v.months // 2, F.col("reg.slope") * 120), 4).alias("trend"), r(F.when(v.months - F.col("valid") <= v.months // 2, F.col("p")).otherwise(1.0), 4).alias("p"))
)
