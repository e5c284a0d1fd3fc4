"""S, P, O, U, Q, E, B and X: sources, cleaning, order, sets, checks, ensembles, tables and their statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from nilas.functions import calendar as cal
from nilas.functions.stats import correlation, regression, sql_corr, sql_fixed, sql_p, sql_rest, sql_slope, student_p
from nilas.functions.stats import rounded as r
from nilas.functions.stats import sql_round as q
from nilas.operators import clean as p
from nilas.operators import climatology as c
from nilas.operators import tables as t
from nilas.operators.align import both_zero_mask, coverage_modes
from nilas.operators.align import coverage as align_coverage
from nilas.operators.trends import period_statistics
from nilas.plans.climatology import SERIES, series
from nilas.plans.registry import query
from nilas.plans.trends import KEYS as LONG_KEYS
from nilas.plans.trends import SQL_V6, long_series, period_table, rounded
from nilas.sources import files as f

KEYS = ["dataset", "time", "y", "x"]
LONG = "lg AS (UNPIVOT (SELECT dataset, time, y, x, sic, u, v FROM field) ON sic, u, v INTO NAME var VALUE value)"
long_field = lambda v: v.field.unpivot(KEYS, ["sic", "u", "v"], "var", "value")


def scratch(v, label):
    """A new path in the shared folder of the cluster."""
    return f"{f.shared_folder(v.spark)}/{label}-{uuid.uuid4().hex}"


# Sources and sinks.
query("S1_scan_variable", f"WITH {LONG} SELECT time, y, x, value FROM lg WHERE dataset = 'obs1' AND var = 'sic'")(lambda v: long_field(v).where("dataset = 'obs1' AND var = 'sic'").select("time", "y", "x", "value"))
query("S2_scan_vectors", f"WITH {LONG} SELECT dataset, time, y, x, a.value AS u, b.value AS v FROM (SELECT * FROM lg WHERE var = 'u') a JOIN (SELECT * FROM lg WHERE var = 'v') b USING (dataset, time, y, x)")(lambda v: f.vector_pair(long_field(v), "u", "v", KEYS))
query("S3_scan_grid", "SELECT y, x, lon, lat, cell_area, region FROM grid")(lambda v: v.grid.select("y", "x", "lon", "lat", "cell_area", "region"))
NAMES = "nm AS (SELECT p_partkey, 'seg' || (p_partkey % 50) || CASE WHEN p_partkey % 3 = 0 THEN '_copy' ELSE '' END || '_' || p_size || '.nc' AS name, 'seg' || (p_partkey % 50) AS segment FROM part)"


def names(v):
    seg = F.concat(F.lit("seg"), (F.col("p_partkey") % 50).cast("string"))
    return v.table("part").select("p_partkey", F.concat(seg, F.when(F.col("p_partkey") % 3 == 0, "_copy").otherwise(""), F.lit("_"), F.col("p_size").cast("string"), F.lit(".nc")).alias("name"))


query("S5_unique_segments", f"WITH {NAMES}, n AS (SELECT DISTINCT name, segment FROM nm), o AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY regexp_matches(name, '(?i)copy'), name) AS n FROM n) SELECT segment, name FROM o WHERE n = 1")(
    lambda v: f.unique_segments(names(v).select("name").distinct(), F.regexp_extract("name", r"^(seg\d+)", 1)).select("segment", "name")
)
query("S6_paired_segments", f"WITH {NAMES}, u AS (SELECT segment, min(name) AS name FROM nm WHERE p_partkey % 50 < 30 GROUP BY 1), w AS (SELECT segment, max(name) AS name FROM nm WHERE p_partkey % 50 >= 10 GROUP BY 1), s AS (SELECT u.name AS u, w.name AS v FROM u JOIN w USING (segment)), a AS (SELECT name, row_number() OVER (ORDER BY segment, name) AS n FROM u WHERE segment NOT IN (SELECT segment FROM w)), b AS (SELECT name, row_number() OVER (ORDER BY segment, name) AS n FROM w WHERE segment NOT IN (SELECT segment FROM u)) SELECT u, v FROM s UNION ALL SELECT a.name, b.name FROM a JOIN b USING (n)")(
    lambda v: (lambda n: f.paired_segments(n.where("p_partkey % 50 < 30").groupBy("segment").agg(F.min("name").alias("name")), n.where("p_partkey % 50 >= 10").groupBy("segment").agg(F.max("name").alias("name"))))(names(v).withColumn("segment", F.regexp_extract("name", r"^(seg\d+)", 1)))
)
query("S7_merge_segments", "SELECT dataset, time, y, x, sic FROM field WHERE yr < 1998 UNION ALL SELECT dataset, time, y, x, sic FROM field WHERE yr >= 1998")(lambda v: v.field.where("yr < 1998").select(*KEYS, "sic").unionByName(v.field.where("yr >= 1998").select(*KEYS, "sic")))
query("S8_missing_months", "WITH m AS (SELECT dataset, y, x, CAST(t AS DATE) AS time FROM (SELECT DISTINCT dataset, y, x FROM field) CROSS JOIN (SELECT unnest(generate_series(first, last, INTERVAL 1 MONTH)) AS t FROM span)) SELECT dataset, y, x, time FROM m WHERE NOT EXISTS (SELECT 1 FROM field g WHERE (g.dataset, g.y, g.x, g.time) = (m.dataset, m.y, m.x, m.time))")(
    lambda v: f.missing_months(v.field, ["dataset", "y", "x"])
)
query("S9_sampling_interval", "WITH s AS (SELECT dataset, time - lag(time) OVER (PARTITION BY dataset ORDER BY time) AS step FROM (SELECT DISTINCT dataset, time FROM field)), m AS (SELECT dataset, CAST(max(step) AS INT) AS step FROM s GROUP BY 1) SELECT *, step <= 1 AS daily, step <= 31 AS monthly FROM m")(lambda v: f.sampling_interval(v.field, ["dataset"]))
query("S10_year_coverage", "SELECT dataset, y, x, min(yr) AS first, max(yr) AS last, (min(yr) <= 1996 AND max(yr) >= 1999) AS covers FROM field GROUP BY ALL")(lambda v: f.year_coverage(v.field, ["dataset", "y", "x"], 1996, 1999))


def stored(v, label, write, read):
    path = scratch(v, label)
    write(period_table(v), path)
    return read(path)


query("S11_metric_store", SQL_V6)(lambda v: stored(v, "metrics", f.write_metrics, v.spark.read.parquet).select(*period_table(v).columns))
query("S13_json_export", SQL_V6)(lambda v: stored(v, "json", f.write_json, lambda path: v.spark.read.schema(period_table(v).schema).json(path)))
query("S14_csv_export", SQL_V6)(lambda v: stored(v, "csv", f.write_csv, lambda path: v.spark.read.schema(period_table(v).schema).option("header", True).csv(path)))

# Cleaning.
query("P1_date_range", "SELECT dataset, time, y, x, sic FROM field WHERE time BETWEEN DATE '1996-03-01' AND DATE '1998-02-28'")(lambda v: v.field.where("time BETWEEN DATE '1996-03-01' AND DATE '1998-02-28'").select(*KEYS, "sic"))
query("P2_select_rename", "SELECT dataset, time, y, x, sic AS concentration FROM field")(lambda v: v.field.select(*KEYS, "sic").withColumnRenamed("sic", "concentration"))
query("P3_missing_to_null", "SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 1, 2, 3) THEN NULL ELSE p_retailprice END AS value FROM part")(
    lambda v: v.table("part").select("p_partkey", p.missing_to_null(F.when(F.col("p_partkey") % 5 == 0, 1e20).when(F.col("p_partkey") % 5 == 1, -9999.0).when(F.col("p_partkey") % 5 == 2, float("nan")).when(F.col("p_partkey") % 5 == 3, 255.0).otherwise(F.col("p_retailprice"))).alias("value"))
)
query("P4_zero_to_null", "SELECT dataset, time, y, x, nullif(thick, 0) AS thick FROM field")(lambda v: v.field.select(*KEYS, p.zero_to_null(F.col("thick")).alias("thick")))
query("P5_percent", "WITH s AS (SELECT dataset, time, y, x, CASE WHEN dataset = 'obs2' THEN sic / 100 ELSE sic * 1.02 END AS sic FROM field), m AS (SELECT dataset, max(sic) < 10 AS small FROM s GROUP BY 1) SELECT dataset, time, y, x, " + q("CASE WHEN CASE WHEN small THEN sic * 100 ELSE sic END BETWEEN 0 AND 100 THEN CASE WHEN small THEN sic * 100 ELSE sic END END") + " AS sic FROM s JOIN m USING (dataset)")(
    lambda v: p.percent(v.field.withColumn("sic", F.when(F.col("dataset") == "obs2", F.col("sic") / 100).otherwise(F.col("sic") * 1.02)), "sic").select(*KEYS, r(F.col("sic")).alias("sic"))
)
query("P6_percent_by_quantile", "WITH s AS (SELECT dataset, time, i, y, x, CASE WHEN dataset = 'obs2' THEN sic / 100 ELSE sic END AS sic FROM daily), m AS (SELECT dataset, quantile_cont(CASE WHEN i < 366 THEN sic END, 0.99) <= 1.5 AS small FROM s GROUP BY 1) SELECT dataset, time, y, x, " + q("CASE WHEN small THEN sic * 100 ELSE sic END") + " AS sic FROM s JOIN m USING (dataset)")(
    lambda v: p.percent_by_quantile(v.daily.withColumn("sic", F.when(F.col("dataset") == "obs2", F.col("sic") / 100).otherwise(F.col("sic"))), "sic").select(*KEYS, r(F.col("sic")).alias("sic"))
)
query("P7_metres_per_second", f"SELECT dataset, time, y, x, {q('u')} AS u, {q('v')} AS v FROM field")(lambda v: p.metres_per_second(v.field.withColumns({c_: F.when(F.col("dataset") == "obs1", F.col(c_) * 100).otherwise(F.col(c_)) for c_ in ("u", "v")})).select(*KEYS, r(F.col("u")).alias("u"), r(F.col("v")).alias("v")))
query("P8_zero_velocity", "SELECT dataset, time, y, x, nullif(u, 0) AS u, nullif(v, 0) AS v FROM field")(lambda v: v.field.select(*KEYS, p.zero_to_null(F.col("u")).alias("u"), p.zero_to_null(F.col("v")).alias("v")))
query("P9_thickness_range", f"SELECT dataset, time, y, x, {q('CASE WHEN thick * 60 BETWEEN 0 AND 200 THEN thick * 60 END')} AS thick FROM field")(lambda v: v.field.select(*KEYS, r(p.between(F.col("thick") * 60, 0, 200)).alias("thick")))
query("P10_valid_mask", "SELECT dataset, time, y, x, (thick IS NOT NULL AND thick > 0) AS valid, (nullif(u, 0) IS NOT NULL AND nullif(v, 0) IS NOT NULL) AS vector FROM field")(lambda v: v.field.select(*KEYS, (F.col("thick").isNotNull() & (F.col("thick") > 0)).alias("valid"), ((F.col("u") != 0) & (F.col("v") != 0)).alias("vector")))
query("P11_both_zero_mask", "SELECT dataset, time, y, x, NOT (thick = 0 AND u = 0) AS keep FROM field")(lambda v: v.field.select(*KEYS, both_zero_mask(F.col("thick"), F.col("u")).alias("keep")))
query("P12_sector_filter", "SELECT sector, dataset, count(*) AS n FROM fieldg JOIN sectors USING (region) GROUP BY ALL")(lambda v: p.in_sector(v.field_grid, v.sectors).groupBy("sector", "dataset").agg(F.count("*").alias("n")))
query("P13_ocean_mask", "SELECT p_partkey, CASE WHEN p_size / 50.0 >= 0.99 THEN 1 ELSE 0 END AS ocean FROM part")(lambda v: v.table("part").select("p_partkey", p.ocean_mask(F.col("p_size") / 50.0).alias("ocean")))
query("P14_key_months", "SELECT dataset, time, y, x, sic FROM field WHERE mo IN (2, 9)")(lambda v: v.field.where(F.col("mo").isin(*cal.KEY_MONTHS["south"])).select(*KEYS, "sic"))
query("P15_scale_with_std", f"SELECT dataset, time, y, x, {q('sic / 100 * 100')} AS sic, {q('thick / 10 * 100')} AS std FROM field")(lambda v: v.field.select(*KEYS, r(F.col("sic") / 100 * 100).alias("sic"), r(F.col("thick") / 10 * 100).alias("std")))
query("P16_displacement_drift", f"SELECT l_orderkey, l_linenumber, {q('l_quantity * 1000 / nullif((l_linenumber - 1) * 86400, 0)')} AS u FROM lineitem")(lambda v: v.table("lineitem").select("l_orderkey", "l_linenumber", r(p.displacement_drift(F.col("l_quantity"), (F.col("l_linenumber") - 1) * 86400)).alias("u")))
query("P17_error_flag", f"SELECT l_orderkey, l_linenumber, {q('CASE WHEN l_discount * 20 > 1 THEN l_discount * 20 - 1 ELSE l_discount * 20 END')} AS error, CAST(l_discount * 20 > 1 AS INT) AS flag FROM lineitem")(lambda v: (lambda e: v.table("lineitem").select("l_orderkey", "l_linenumber", r(e[0]).alias("error"), e[1].alias("flag")))(p.error_flag(F.col("l_discount") * 20)))
query("P18_snow_depth", f"SELECT dataset, time, y, x, {q('thick - u')} AS depth, {q('sqrt(u * u + v * v)')} AS std, {q('(thick - u) * sic / 100')} AS effective FROM field")(lambda v: v.field.select(*KEYS, *(r(x).alias(n) for n, x in p.snow_depth(F.col("thick"), F.col("u"), F.col("u"), F.col("v"), F.col("sic")).items())))
query("P19_effective_thickness", f"SELECT a.yr, a.mo, a.y, a.x, {q('a.thick * b.sic / 100')} AS effective FROM field a LEFT JOIN (SELECT * FROM field WHERE dataset = 'obs2') b ON (a.yr, a.mo, a.y, a.x) = (b.yr, b.mo, b.y, b.x) WHERE a.dataset = 'obs1'")(
    lambda v: v.field.where("dataset = 'obs1'").select("yr", "mo", "y", "x", "thick").join(v.field.where("dataset = 'obs2'").select("yr", "mo", "y", "x", "sic"), ["yr", "mo", "y", "x"], "left").select("yr", "mo", "y", "x", r(F.col("thick") * F.col("sic") / 100).alias("effective"))
)
query("P20_first_of_time", "SELECT dataset, time, sic FROM (SELECT *, row_number() OVER (PARTITION BY dataset, time ORDER BY y * 100 + x) AS n FROM field) WHERE n = 1")(lambda v: p.first_of_time(v.field.withColumn("k", F.col("y") * 100 + F.col("x")), ["dataset"], tie="k").select("dataset", "time", "sic"))
query("P21_time_keys", "SELECT event_id, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, CAST(day(ts) AS INT) AS day FROM events")(lambda v: v.table("events").select("event_id", F.year("ts").alias("year"), F.month("ts").alias("month"), F.dayofmonth("ts").alias("day")))
query("P22_clean_months", "WITH a AS (SELECT p_partkey, [p_size / 3.0, 13.0, 0.2, p_partkey % 12 + 1.1, p_size / 3.0, NULL] AS m FROM part), w AS (SELECT p_partkey, list_filter(list_transform(list_filter(m, lambda x: x IS NOT NULL), lambda x: CAST(round(x) AS INT)), lambda x: x BETWEEN 1 AND 12) AS m FROM a) SELECT p_partkey, array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i), ',') AS months FROM w")(
    lambda v: v.table("part").select("p_partkey", F.array_join(p.clean_months(F.array(F.col("p_size") / 3.0, F.lit(13.0), F.lit(0.2), F.col("p_partkey") % 12 + 1.1, F.col("p_size") / 3.0, F.lit(None).cast("double"))), ",").alias("months"))
)
TXT = "CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN '1,' || (p_size + 100) || '.5*' WHEN 1 THEN p_size || '%' WHEN 2 THEN 'NaN' ELSE ' -' || p_size END"
query("P23_cell_number", f"WITH a AS (SELECT p_partkey, trim(regexp_replace({TXT}, '[%*,]', '', 'g')) AS b FROM part) SELECT p_partkey, CASE WHEN lower(b) IN ('', 'nan', 'none', 'null', '--') THEN NULL ELSE TRY_CAST(b AS DOUBLE) END AS value FROM a")(lambda v: v.table("part").select("p_partkey", p.number(F.expr(TXT)).alias("value")))
query("P24_dataset_class", "WITH l AS (SELECT c_custkey, regexp_replace(lower(trim(['Obs_1', ' GROUP-A ', 'Model  X'][CAST(c_custkey % 3 AS INT) + 1])), '[\\s_-]+', ' ', 'g') AS label FROM customer) SELECT c_custkey, label, CASE WHEN starts_with(label, 'obs') THEN 'obs' WHEN starts_with(label, 'group') OR starts_with(label, 'ensemble') THEN 'group' ELSE 'model' END AS class FROM l")(
    lambda v: (lambda n: v.table("customer").select("c_custkey", p.label(n).alias("label"), p.dataset_class(n).alias("class")))(F.element_at(F.array(F.lit("Obs_1"), F.lit(" GROUP-A "), F.lit("Model  X")), (F.col("c_custkey") % 3).cast("int") + 1))
)
query("P25_significance_star", f"SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '--' ELSE {sql_fixed('p_size / CAST(8 AS DOUBLE)', 3)} || CASE WHEN p_size / 100.0 < 0.05 THEN '*' ELSE '' END END AS cell FROM part")(
    lambda v: v.table("part").select("p_partkey", p.starred(F.when(F.col("p_size") % 7 != 0, F.col("p_size") / 8.0), F.col("p_size") / 100.0).alias("cell"))
)

# Order, quantiles, ranks, sets, checks.
query("O1_sorted_series", f"WITH {SERIES} SELECT row_number() OVER (PARTITION BY dataset, sector ORDER BY time) AS n, dataset, sector, time FROM series")(lambda v: series(v).select(F.row_number().over(Window.partitionBy("dataset", "sector").orderBy("time")).cast("long").alias("n"), "dataset", "sector", "time"))
query("O2_value_ranges", f"SELECT dataset, {', '.join(f'{q(f"greatest(quantile_cont(thick, 0.{d}), 0.5)")} AS p{d}' for d in (95, 98, 99))} FROM field GROUP BY 1")(
    lambda v: t.quantiles(v.field, ["dataset"], "thick", [0.95, 0.98, 0.99]).groupBy("dataset").agg(*(r(F.greatest(F.max(F.when(F.col("share") == d / 100, F.col("value"))), F.lit(0.5))).alias(f"p{d}") for d in (95, 98, 99)))
)
query("O2_price_ranges", " UNION ALL ".join(f"SELECT l_returnflag, l_linestatus, CAST({x} AS DOUBLE) AS share, {q(f'quantile_cont(l_extendedprice, {x})')} AS value FROM lineitem GROUP BY ALL" for x in (0.02, 0.5, 0.98)))(
    lambda v: t.quantiles(v.table("lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.02, 0.5, 0.98]).withColumn("value", r(F.col("value")))
)
query("O3_average_ranks", "SELECT c_custkey, c_nationkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2 AS rank FROM customer")(lambda v: v.table("customer").select("c_custkey", "c_nationkey", t.average_rank("c_nationkey", ["c_mktsegment"]).alias("rank")))
ORDER = "CASE WHEN starts_with(dataset, 'obs') THEN 0 WHEN starts_with(dataset, 'group') THEN 1 ELSE 2 END"
STACK = "SELECT dataset, avg(thick) AS m FROM field GROUP BY 1 UNION ALL SELECT 'group ' || \"group\", avg(thick) FROM field JOIN ensemble ON member = dataset GROUP BY 1"


def stacked(v):
    own = v.field.groupBy("dataset").agg(F.avg("thick").alias("m"))
    groups = v.field.join(v.ensemble, F.col("dataset") == F.col("member")).groupBy(F.concat(F.lit("group "), "group").alias("dataset")).agg(F.avg("thick").alias("m"))
    return own.unionByName(groups)


query("O4_row_order", f"WITH s AS ({STACK}) SELECT dataset, row_number() OVER (ORDER BY {ORDER}, dataset) AS position FROM s")(
    lambda v: stacked(v).select("dataset", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.when(F.col("dataset").startswith("obs"), 0).when(F.col("dataset").startswith("group"), 1).otherwise(2), "dataset")).cast("long").alias("position"))
)
query("U1_stack_datasets", f"WITH s AS ({STACK}) SELECT dataset, {q('m')} AS value FROM s")(lambda v: stacked(v).select("dataset", r(F.col("m")).alias("value")))
MONTHS = "SELECT {0} FROM field WHERE dataset = '{1}' AND sic > 95"
months = lambda v, d: v.field.where((F.col("dataset") == d) & (F.col("sic") > 95)).select("yr", "mo", "y", "x")
query("U2_common_months", f"{MONTHS.format('yr, mo, y, x', 'obs1')} INTERSECT {MONTHS.format('yr, mo, y, x', 'model_a')}")(lambda v: months(v, "obs1").intersect(months(v, "model_a")))
query("U3_months_missing", f"{MONTHS.format('yr, mo, y, x', 'obs1')} EXCEPT {MONTHS.format('yr, mo, y, x', 'model_a')}")(lambda v: months(v, "obs1").subtract(months(v, "model_a")))
query("Q1_missing_by_bin", "WITH b AS (SELECT least(CAST(floor((sic - 10) / 5) AS INT), 17) AS bin, nullif(thick, 0) AS t FROM field WHERE sic BETWEEN 10 AND 100) SELECT bin, count(*) AS n, " + q("avg(CAST(t IS NULL AS INT))") + " AS share FROM b GROUP BY 1")(
    lambda v: v.field.where("sic BETWEEN 10 AND 100").groupBy(F.least(F.floor((F.col("sic") - 10) / 5).cast("int"), F.lit(17)).alias("bin")).agg(F.count("*").alias("n"), r(F.avg((F.col("thick") == 0).cast("int"))).alias("share"))
)
query("Q2_missing_by_time", f"SELECT dataset, time, {q('avg(CAST(nullif(u, 0) IS NULL AS INT))')} AS share FROM field GROUP BY ALL")(lambda v: v.field.groupBy("dataset", "time").agg(r(F.avg((F.col("u") == 0).cast("int"))).alias("share")))
query("Q3_product_comparison", f"WITH m AS (SELECT dataset, mo, yr, avg(thick) AS m FROM field GROUP BY ALL), a AS (SELECT *, avg(m) OVER (PARTITION BY dataset, mo) AS clim FROM m) SELECT dataset, yr, mo, {q('clim')} AS clim, {q('m - clim')} AS anomaly FROM a")(
    lambda v: c.anomaly(v.field.groupBy("dataset", "yr", "mo").agg(F.avg("thick").alias("m")), "m", ["dataset"]).select("dataset", "yr", "mo", r(F.col("m") - F.col("anomaly")).alias("clim"), r(F.col("anomaly")).alias("anomaly"))
)
query("Q4_completeness", f"SELECT dataset, count(*) AS n, {q('count(*) / CAST((SELECT n FROM span) * (SELECT count(*) FROM cells) AS DOUBLE)')} AS share, {q('avg(CAST(sic >= 15 AS INT))')} AS kept FROM field GROUP BY 1")(lambda v: v.field.groupBy("dataset").agg(F.count("*").alias("n"), r(F.count("*") / (float(v.cells.count()) * v.months)).alias("share"), r(F.avg((F.col("sic") >= 15).cast("int"))).alias("kept")))

# Ensembles.
EM = "em AS (SELECT \"group\", member, count(*) OVER (PARTITION BY \"group\") AS size FROM ensemble)"
for _id, _fn, _std in (("E1_group_mean", "avg", False), ("E2_group_spread", "stddev_pop", True)):
    query(_id, f"WITH {SERIES}, {EM} SELECT \"group\", sector, time, {q(f'{_fn}(extent)')} AS value FROM series JOIN em ON member = dataset GROUP BY \"group\", sector, time, size HAVING count(DISTINCT member) = size")(
        lambda v, std=_std: rounded(t.group_stat(series(v), v.ensemble, ["sector", "time"], "extent", std), "group", "sector", "time")
    )
query("E3_group_field", f"SELECT \"group\", time, y, x, {q('avg(sic)')} AS sic FROM field JOIN ensemble ON member = dataset GROUP BY ALL")(lambda v: v.field.join(v.ensemble, F.col("dataset") == F.col("member")).groupBy("group", "time", "y", "x").agg(r(F.avg("sic")).alias("sic")))
CELL_MEAN = q("avg(TRY_CAST(regexp_replace(cell, '[%*,]', '', 'g') AS DOUBLE))", 3)
query("E4_group_rows", f"WITH s AS (SELECT dataset, CASE WHEN dataset = 'model_b' THEN '--' ELSE printf('%.4f', avg(thick)) || '*' END AS cell FROM field GROUP BY 1) SELECT \"group\", {CELL_MEAN} AS value FROM s JOIN ensemble ON member = dataset GROUP BY 1")(
    lambda v: v.field.groupBy("dataset").agg(F.when(F.col("dataset") == "model_b", "--").otherwise(F.concat(F.format_string("%.4f", F.avg("thick")), F.lit("*"))).alias("cell"))
    .join(v.ensemble, F.col("dataset") == F.col("member")).groupBy("group").agg(r(F.avg(p.number(F.col("cell"))), 3).alias("value"))
)
GA = f"WITH {SERIES}, {EM}, ge AS (SELECT \"group\", sector, yr, mo, avg(extent) AS e, stddev_pop(extent) AS sd FROM series JOIN em ON member = dataset GROUP BY \"group\", sector, yr, mo, size HAVING count(DISTINCT member) = size), ga AS (SELECT *, e - avg(e) OVER (PARTITION BY \"group\", sector, mo) AS an, (yr - 1995) * 12 + mo - 1 AS i FROM ge), gt AS (SELECT \"group\", sector, avg(sd) AS spread, stddev_pop(an) AS std, {sql_slope('an', 'i')} * 120 AS trend, {sql_corr('an', 'i')} AS r, CAST(regr_count(an, i) AS BIGINT) AS n FROM ga GROUP BY ALL)"


def group_trends(v):
    m = t.group_stat(series(v), v.ensemble, ["sector", "yr", "mo"], "extent").join(t.group_stat(series(v), v.ensemble, ["sector", "yr", "mo"], "extent", True).withColumnRenamed("value", "sd"), ["group", "sector", "yr", "mo"])
    a = c.anomaly(m, "value", ["group", "sector"])
    return a.groupBy("group", "sector").agg(F.avg("sd").alias("spread"), F.stddev_pop("anomaly").alias("std"), regression(F.col("anomaly"), (F.col("yr") - 1995) * 12 + F.col("mo") - 1).alias("reg"))


query("V14_group_trend", f"{GA} SELECT \"group\", sector, {q('std')} AS std, {q('trend', 4)} AS trend, {q(sql_p('r', 'n'), 4)} AS p FROM gt")(lambda v: group_trends(v).select("group", "sector", r(F.col("std")).alias("std"), r(F.col("reg.slope") * 120, 4).alias("trend"), r(student_p(F.col("reg.r"), F.col("reg.n")), 4).alias("p")))
query("E5_mean_and_spread", f"{GA} SELECT \"group\", sector, {q('spread')} AS spread, {q('std')} AS std, {q('trend', 4)} AS trend FROM gt")(lambda v: group_trends(v).select("group", "sector", r(F.col("spread")).alias("spread"), r(F.col("std")).alias("std"), r(F.col("reg.slope") * 120, 4).alias("trend")))

# Tables.
V6CTE = SQL_V6[5:].rsplit(" SELECT dataset, sector, metric, period,", 1)[0]






FLUXT = f"fc AS (SELECT dataset, term, y, x, mo, avg(value * day(last_day(time)) * 86400) AS value FROM flux GROUP BY ALL), fs AS (SELECT dataset, sector, {cal.SQL_SEASON} AS season, term, sum(value * cell_area) / 1e12 AS value FROM fc JOIN grid USING (y, x) JOIN sectors USING (region) GROUP BY ALL)"
query("B5_mass_budget_table", f"WITH {FLUXT} SELECT dataset, sector, season, {', '.join(f"{q(f"max(CASE WHEN term = '{m}' THEN value END)")} AS {m}" for m in ('dyn', 'growth', 'melt', 'snow'))} FROM fs GROUP BY ALL")(
    lambda v: rounded(
        t.wide(c.flux_climatology(v.flux, ["dataset", "term", "y", "x"]).join(v.grid, ["y", "x"]).join(v.sectors, "region").groupBy("dataset", "sector", cal.season(F.col("mo")).alias("season"), "term").agg((F.sum(F.col("value") * F.col("cell_area")) / 1e12).alias("value")),
               ["dataset", "sector", "season"], "term", "value", ["dyn", "growth", "melt", "snow"]), "dataset", "sector", "season")
)
query("B6_anomaly_summary", f"WITH {V6CTE} SELECT dataset, sector, metric, period, {sql_fixed('mean', 3)} AS mean, CASE WHEN trend IS NULL THEN '--' ELSE {sql_fixed('trend', 2)} || CASE WHEN {sql_p('r', 'n')} < 0.05 THEN '*' ELSE '' END END AS trend FROM st")(
    lambda v: period_statistics(c.periods(*_long(v)), _long(v)[2]).select("dataset", "sector", "metric", "period", p.fixed(F.col("mean"), 3).alias("mean"), p.starred(F.col("trend"), F.col("p"), 2).alias("trend"))
)


def _long(v):
    return long_series(v), "value", LONG_KEYS


REC = f"rw AS (SELECT dataset, sector AS region, avg(area) AS area, avg(extent) AS extent FROM series GROUP BY ALL), rl AS (UNPIVOT rw ON area, extent INTO NAME metric_name VALUE value), rec AS (SELECT 'south' AS hemisphere, 'concentration' AS module, region, 'own' AS coverage_mode, 'raw' AS view_mode, 'period' AS domain_kind, 'annual' AS domain_key, metric_name, '10^6 km2' AS metric_unit, dataset AS dataset_name, CASE WHEN starts_with(dataset, 'obs') THEN 'obs' ELSE 'model' END AS dataset_type, {q('value')} AS value FROM rl)"


def records(v):
    w = series(v).groupBy("dataset", F.col("sector").alias("region")).agg(F.avg("area").alias("area"), F.avg("extent").alias("extent"))
    return t.records(w, ["area", "extent"], hemisphere="south", module="concentration", coverage_mode="own", view_mode="raw", domain_kind="period", domain_key="annual").withColumn("value", r(F.col("value")))


query("B7_records", f"WITH {SERIES}, {REC} SELECT * FROM rec")(records)
query("B8_catalog", f"WITH {SERIES}, {REC} SELECT hemisphere, module, {', '.join(f"array_to_string(list_sort(list(DISTINCT {x})), ',') AS {x}" for x in ('region', 'coverage_mode', 'view_mode', 'metric_name', 'dataset_name'))} FROM rec GROUP BY ALL")(lambda v: t.catalog(records(v)))
FROM_OBS1 = q("abs(m - (SELECT o.m FROM m o WHERE o.dataset = 'obs1'))")
query("B9_scalar_differences", f"WITH m AS (SELECT dataset, avg(sic) AS m FROM field GROUP BY 1) SELECT dataset, {FROM_OBS1} AS value FROM m")(lambda v: t.differences(v.field.groupBy("dataset").agg(F.avg("sic").alias("m")).withColumn("k", F.lit(1)), ["k"], "m").select("dataset", r(F.col("m")).alias("value")))
query("B10_units", "WITH n AS (SELECT DISTINCT ['extent_trend', 'ice_area', 'thick_mean', 'kinetic_energy', 'speed_std', 'other'][CAST(p_partkey % 6 AS INT) + 1] AS name FROM part) SELECT name, CASE WHEN contains(name, 'trend') AND contains(name, 'extent') THEN '10^6 km2/decade' WHEN contains(name, 'extent') OR contains(name, 'area') THEN '10^6 km2' WHEN starts_with(name, 'thick') THEN 'm' WHEN contains(name, 'energy') THEN 'm2/s2' WHEN starts_with(name, 'speed') THEN 'm/s' ELSE '' END AS unit FROM n")(
    lambda v: v.table("part").select(F.element_at(F.array(*map(F.lit, ("extent_trend", "ice_area", "thick_mean", "kinetic_energy", "speed_std", "other"))), (F.col("p_partkey") % 6).cast("int") + 1).alias("name")).distinct().select("name", t.unit(F.col("name")).alias("unit"))
)
#: Both observations and the dataset itself have a drift at the time and cell.
OBSERVED = ["obs1", "obs2"]
MOVES = "nullif(u, 0) IS NOT NULL AND nullif(v, 0) IS NOT NULL"
SQL_COVERAGE = f"""cv AS (SELECT *, {MOVES} AS ok, bool_or(dataset = 'obs1' AND {MOVES}) OVER w AND bool_or(dataset = 'obs2' AND {MOVES}) OVER w AND {MOVES} AS matched FROM field WINDOW w AS (PARTITION BY time, y, x)),
    md AS (SELECT *, 'own' AS coverage_mode FROM cv UNION ALL SELECT *, 'matched' FROM cv WHERE matched)"""


def covered(v):
    """The field's rows by coverage mode."""
    return coverage_modes(align_coverage(v.field, F.expr(MOVES.replace("0)", "0D)")), OBSERVED))


def anomaly_summary(v):
    """Kinetic energy by month, its anomalies from the month's climatology, and their deviation, trend a decade and detrended deviation."""
    e = covered(v).where(MOVES.replace("0)", "0D)")).groupBy("coverage_mode", "dataset", "yr", "mo").agg((F.avg((F.col("u") ** 2 + F.col("v") ** 2) / 2) * 1e3).alias("e"))
    a = c.anomaly(e, "e", ["coverage_mode", "dataset"]).withColumn("i", F.col("yr") * 12 + F.col("mo"))
    s = a.groupBy("coverage_mode", "dataset").agg(F.stddev_pop("anomaly").alias("s"), regression("anomaly", "i").alias("reg"), F.count("anomaly").alias("n")).where("n >= 2")
    return s.select("coverage_mode", "dataset", r(F.col("s"), 4).alias("std"), r(F.col("reg.slope") * 120, 4).alias("trend"), r(F.col("reg.rest"), 4).alias("detrended"))


query("B11_drift_anomaly_summary", f"""WITH {SQL_COVERAGE}, ke AS (SELECT coverage_mode, dataset, yr, mo, avg((u * u + v * v) / 2) * 1e3 AS e FROM md WHERE ok GROUP BY ALL),
    an AS (SELECT coverage_mode, dataset, yr * 12 + mo AS i, e - avg(e) OVER (PARTITION BY coverage_mode, dataset, mo) AS a FROM ke)
    SELECT coverage_mode, dataset, {q('stddev_pop(a)', 4)} AS std, {q(sql_slope('a', 'i') + ' * 120', 4)} AS trend, {q(sql_rest('a', 'i'), 4)} AS detrended FROM an GROUP BY ALL HAVING count(a) >= 2""")(anomaly_summary)
MATCH = "(SELECT f.* FROM field f WHERE EXISTS (SELECT 1 FROM field o WHERE o.dataset = 'obs1' AND (o.yr, o.mo, o.y, o.x) = (f.yr, f.mo, f.y, f.x)))"
query("B13_coverage_views", "WITH a AS (SELECT 'own' AS coverage_mode, dataset, avg(thick) AS m FROM field GROUP BY ALL UNION ALL SELECT 'matched', dataset, avg(thick) FROM " + MATCH + f" GROUP BY ALL) SELECT coverage_mode, 'raw' AS view_mode, dataset, {q('m')} AS value FROM a UNION ALL SELECT a.coverage_mode, 'difference', a.dataset, {q('abs(a.m - o.m)')} FROM a JOIN (SELECT * FROM a WHERE dataset = 'obs1') o USING (coverage_mode)")(lambda v: coverage(v))


def coverage(v):
    own = v.field.groupBy("dataset").agg(F.avg("thick").alias("m")).withColumn("coverage_mode", F.lit("own"))
    keys = v.field.where("dataset = 'obs1'").select("yr", "mo", "y", "x").distinct()
    matched = v.field.join(keys, ["yr", "mo", "y", "x"], "left_semi").groupBy("dataset").agg(F.avg("thick").alias("m")).withColumn("coverage_mode", F.lit("matched"))
    raw = own.unionByName(matched)
    both = raw.withColumn("view_mode", F.lit("raw")).unionByName(t.differences(raw, ["coverage_mode"], "m").withColumn("view_mode", F.lit("difference")))
    return both.select("coverage_mode", "view_mode", "dataset", r(F.col("m")).alias("value"))


COVERED = {"thickness": "sum(thick * cell_area) / sum(cell_area)", "speed": "avg(sqrt(u * u + v * v))", "energy": "avg((u * u + v * v) / 2) * 1000"}


def sector_coverage(v):
    """Own and matched coverage, raw values and differences from the first observation, by sector, for several metrics."""
    rows = covered(v).where(MOVES.replace("0)", "0D)")).join(v.grid, ["y", "x"]).join(v.sectors, "region")
    raw = rows.groupBy("coverage_mode", "sector", "dataset").agg(*(F.expr(e).alias(m) for m, e in COVERED.items()))
    raw = raw.unpivot(["coverage_mode", "sector", "dataset"], list(COVERED), "metric", "value")
    apart = t.differences(raw, ["coverage_mode", "sector", "metric"], "value")
    both = raw.withColumn("view_mode", F.lit("raw")).unionByName(apart.withColumn("view_mode", F.lit("difference")))
    return both.select("coverage_mode", "view_mode", "sector", "metric", "dataset", r(F.col("value")).alias("value"))


query("B13_sector_coverage", f"""WITH {SQL_COVERAGE}, wd AS (SELECT coverage_mode, sector, dataset, {', '.join(f'{e} AS {m}' for m, e in COVERED.items())} FROM md JOIN grid USING (y, x) JOIN sectors USING (region) WHERE ok GROUP BY ALL),
    rw AS (UNPIVOT wd ON {', '.join(COVERED)} INTO NAME metric VALUE value)
    SELECT coverage_mode, 'raw' AS view_mode, sector, metric, dataset, {q('value')} AS value FROM rw
    UNION ALL SELECT a.coverage_mode, 'difference', a.sector, a.metric, a.dataset, {q('abs(a.value - o.value)')} FROM rw a JOIN (SELECT * FROM rw WHERE dataset = 'obs1') o USING (coverage_mode, sector, metric)""")(sector_coverage)

def summary_cells(v):
    """The text cells of the anomaly summary."""
    return period_statistics(c.periods(*_long(v)), _long(v)[2]).select("dataset", "sector", "metric", "period", p.fixed(F.col("mean"), 3).alias("mean"), p.starred(F.col("trend"), F.col("p"), 2).alias("trend"))


CELL_NUMBER = "TRY_CAST(nullif(regexp_replace({0}, '[%*,]', '', 'g'), '--') AS DOUBLE)"
query("P23_table_cells", f"WITH {V6CTE}, ce AS (SELECT dataset, sector, metric, period, {sql_fixed('mean', 3)} AS mean, CASE WHEN trend IS NULL THEN '--' ELSE {sql_fixed('trend', 2)} || CASE WHEN {sql_p('r', 'n')} < 0.05 THEN '*' ELSE '' END END AS trend FROM st) SELECT dataset, sector, metric, period, {CELL_NUMBER.format('mean')} AS mean, {CELL_NUMBER.format('trend')} AS trend FROM ce")(
    lambda v: summary_cells(v).withColumns({x: p.number(F.col(x)) for x in ("mean", "trend")})
)
query("P24_stacked_classes", f"WITH s AS ({STACK}) SELECT dataset, CASE WHEN starts_with(lower(dataset), 'obs') THEN 'obs' WHEN starts_with(lower(dataset), 'group') THEN 'group' ELSE 'model' END AS class FROM s")(lambda v: stacked(v).select("dataset", p.dataset_class(F.col("dataset")).alias("class")))
query("P22_event_months", "SELECT event_id, array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i), ',') AS months FROM (SELECT event_id, list_filter(list_transform(list_filter([value / 10, CAST(month(ts) AS DOUBLE), value, value / 10], lambda x: x IS NOT NULL), lambda x: CAST(round(x) AS INT)), lambda x: x BETWEEN 1 AND 12) AS m FROM events)")(
    lambda v: v.table("events").select("event_id", F.array_join(p.clean_months(F.array(F.col("value") / 10, F.month("ts").cast("double"), F.col("value"), F.col("value") / 10)), ",").alias("months"))
)

# Statistics across tables: a point a nation.
PTS = "cx AS (SELECT c_nationkey AS id, CAST(round(avg(c_acctbal)) AS DOUBLE) AS x FROM customer GROUP BY 1), sy AS (SELECT s_nationkey AS id, CAST(round(avg(s_acctbal)) AS DOUBLE) AS y FROM supplier GROUP BY 1), pts AS (SELECT id, x, y FROM cx JOIN sy USING (id))"


def points(v):
    x = v.table("customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.round(F.avg("c_acctbal")).alias("x"))
    return x.join(v.table("supplier").groupBy(F.col("s_nationkey").alias("id")).agg(F.round(F.avg("s_acctbal")).alias("y")), "id")


query("X1_pearson", f"WITH {PTS} SELECT {q(sql_corr('y', 'x'))} AS r, count(*) AS n FROM pts")(lambda v: points(v).agg(r(correlation(F.col("y"), F.col("x"))).alias("r"), F.count("*").alias("n")))
query("X2_spearman", f"WITH {PTS}, k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM pts) SELECT {q(sql_corr('ry', 'rx'))} AS rho FROM k")(
    lambda v: points(v).withColumn("k", F.lit(0)).withColumns({"rx": t.average_rank("x", ["k"]), "ry": t.average_rank("y", ["k"])}).agg(r(correlation(F.col("ry"), F.col("rx"))).alias("rho"))
)
query("X3_least_squares", f"WITH {PTS} SELECT {q('regr_slope(y, x)')} AS slope, {q('regr_intercept(y, x)', 3)} AS intercept FROM pts")(lambda v: points(v).agg(regression("y", "x").alias("s")).select(r(F.col("s.slope")).alias("slope"), r(F.col("s.intercept"), 3).alias("intercept")))
query("X4_permutation_p", f"""WITH {PTS}, k AS (SELECT id, x, y, row_number() OVER (ORDER BY id) AS k FROM pts), dr AS (SELECT unnest(range(1, 1201)) AS draw),
    sh AS (SELECT draw, y, row_number() OVER (PARTITION BY draw ORDER BY {t.shuffle_key('draw', 'k')}, k) AS k FROM k CROSS JOIN dr),
    rs AS (SELECT sh.draw, abs({sql_corr('sh.y', 'k.x')}) AS r FROM sh JOIN k USING (k) GROUP BY 1), o AS (SELECT abs({sql_corr('y', 'x')}) AS r, count(*) AS n FROM pts)
    SELECT {q('o.r')} AS r, {q('(count(CASE WHEN rs.r >= o.r - 1e-12 THEN 1 END) + 1) / 1201.0')} AS p FROM rs CROSS JOIN o WHERE o.n >= 3 GROUP BY o.r""")(lambda v: rounded(t.permutation_p(points(v))))
query("X5_quadrants", f"WITH {PTS}, m AS (SELECT *, avg(x) OVER () AS mx, avg(y) OVER () AS my FROM pts) SELECT count(CASE WHEN x >= mx AND y >= my THEN 1 END) AS q1, count(CASE WHEN x < mx AND y >= my THEN 1 END) AS q2, count(CASE WHEN x < mx AND y < my THEN 1 END) AS q3, count(CASE WHEN x >= mx AND y < my THEN 1 END) AS q4 FROM m")(
    lambda v: (lambda d: d.crossJoin(F.broadcast(d.agg(F.avg("x").alias("mx"), F.avg("y").alias("my")))).agg(*(F.count(F.when(F.expr(e), 1)).alias(n) for n, e in (("q1", "x >= mx AND y >= my"), ("q2", "x < mx AND y >= my"), ("q3", "x < mx AND y < my"), ("q4", "x >= mx AND y < my")))))(points(v))
)
query("X6_leave_one_out", f"WITH {PTS}, l AS (SELECT a.id, {sql_corr('b.y', 'b.x')} AS r FROM pts a JOIN pts b ON a.id <> b.id GROUP BY 1), d AS (SELECT id, r - (SELECT corr(y, x) FROM pts) AS delta FROM l WHERE (SELECT count(*) FROM pts) >= 4) SELECT arg_max(id, (abs(delta), id)) AS id, {q('arg_max(delta, (abs(delta), id))')} AS delta FROM d")(
    lambda v: t.leave_one_out(points(v)).select("id", r(F.col("delta")).alias("delta"))
)
query("X7_axis_selection", f"WITH {SERIES}, {REC} SELECT dataset_name, value FROM rec WHERE module = 'concentration' AND coverage_mode = 'own' AND view_mode = 'raw' AND region = 'Ross' AND domain_key = 'annual' AND metric_name = 'extent'")(
    lambda v: records(v).where("module = 'concentration' AND coverage_mode = 'own' AND view_mode = 'raw' AND region = 'Ross' AND domain_key = 'annual' AND metric_name = 'extent'").select("dataset_name", "value")
)
SCR = "sc AS (SELECT n AS metric, id, value FROM (SELECT c_nationkey AS id, 'balance' AS n, CAST(round(avg(c_acctbal)) AS DOUBLE) AS value FROM customer GROUP BY 1 UNION ALL SELECT c_nationkey, 'customers', CAST(count(*) AS DOUBLE) FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, 'suppliers', CAST(count(*) AS DOUBLE) FROM supplier GROUP BY 1))"


def scores(v):
    cu, su = v.table("customer"), v.table("supplier")
    one = cu.groupBy(F.col("c_nationkey").alias("id")).agg(F.round(F.avg("c_acctbal")).alias("value")).withColumn("metric", F.lit("balance"))
    two = cu.groupBy(F.col("c_nationkey").alias("id")).agg(F.count("*").cast("double").alias("value")).withColumn("metric", F.lit("customers"))
    return one.unionByName(two).unionByName(su.groupBy(F.col("s_nationkey").alias("id")).agg(F.count("*").cast("double").alias("value")).withColumn("metric", F.lit("suppliers")))


query("X8_correlation_screen", f"WITH {SCR} SELECT a.metric AS metric_x, b.metric AS metric_y, count(*) AS n, {q(sql_corr('b.value', 'a.value'))} AS r, {q(sql_slope('b.value', 'a.value'))} AS slope FROM sc a JOIN sc b ON a.id = b.id AND a.metric < b.metric GROUP BY ALL HAVING count(*) >= 4")(
    lambda v: t.screen(scores(v), "id").select("metric_x", "metric_y", "n", r(F.col("r")).alias("r"), r(F.col("slope")).alias("slope"))
)
query("J13_metric_pairs", f"WITH {SCR} SELECT id, a.value AS x, b.value AS y FROM (SELECT * FROM sc WHERE metric = 'balance') a JOIN (SELECT * FROM sc WHERE metric = 'suppliers') b USING (id)")(
    lambda v: scores(v).where("metric = 'balance'").select("id", F.col("value").alias("x")).join(scores(v).where("metric = 'suppliers'").select("id", F.col("value").alias("y")), "id")
)
