"""J and M: alignment, differences and skill."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from nilas.functions import calendar as cal
from nilas.functions.stats import METRICS, correlation, metric, regression, student_p
from nilas.functions.stats import rounded as r
from nilas.functions.stats import sql_bias, sql_corr, sql_mae, sql_p, sql_rmse, sql_slope
from nilas.functions.stats import sql_round as q
from nilas.operators import align as a
from nilas.operators import climatology as c
from nilas.operators import skill as k
from nilas.plans.climatology import SERIES, series
from nilas.plans.registry import query
from nilas.plans.trends import INDEX, index, rounded
from nilas.sources.views import TERMS

YM = ["yr", "mo", "y", "x"]
pick = lambda v, d: v.field.where(F.col("dataset") == d)


def pairs(v, values, on=YM, how="inner", one="obs1", two="model_a"):
    return a.aligned(pick(v, one), pick(v, two), values, on, how)


def sql_pairs(values, on="yr, mo, y, x", how="", one="obs1", two="model_a"):
    cols = ", ".join(f"a.{x}, b.{x} AS {x}2" for x in values)
    return f"p AS (SELECT {on}, {cols} FROM (SELECT * FROM field WHERE dataset = '{one}') a {how} JOIN (SELECT * FROM field WHERE dataset = '{two}') b USING ({on}))"


query("J1_month_alignment", f"WITH m AS (SELECT dataset, yr, mo, y, x, avg(sic) AS sic FROM daily GROUP BY ALL) SELECT yr, mo, y, x, {q('a.sic')} AS sic, {q('b.sic')} AS sic2 FROM (SELECT * FROM m WHERE dataset = 'obs1') a JOIN (SELECT * FROM m WHERE dataset = 'model_a') b USING (yr, mo, y, x)")(
    lambda v: rounded(a.aligned(a.by_month(v.daily.where("dataset = 'obs1'"), ["sic"]), a.by_month(v.daily.where("dataset = 'model_a'"), ["sic"]), ["sic"], YM), *YM)
)
query(
    "J2_vector_alignment",
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY yr, mo, y, x ORDER BY time) AS n FROM daily WHERE dataset = 'obs1'), m AS (SELECT *, row_number() OVER (PARTITION BY yr, mo, y, x ORDER BY time DESC) AS n FROM daily WHERE dataset = 'model_a')
    SELECT yr, mo, y, x, l.u, l.v, m.u AS u2, m.v AS v2 FROM l JOIN m USING (yr, mo, y, x) WHERE l.n = 1 AND m.n = 1""",
)(lambda v: a.first_and_last(v.daily.where("dataset = 'obs1'"), v.daily.where("dataset = 'model_a'"), ["u", "v"], YM))
query(
    "J2_exact_alignment",
    "SELECT l.time, y, x, m.dataset, l.u, l.v, m.u AS u2, m.v AS v2 FROM (SELECT * FROM daily WHERE dataset = 'obs1') l JOIN (SELECT * FROM daily WHERE dataset <> 'obs1') m USING (time, y, x)",
)(lambda v: a.exact(v.daily.where("dataset = 'obs1'"), v.daily.where("dataset <> 'obs1'"), ["u", "v"], ["time", "y", "x"], ["dataset"]))
query("J3_three_way", "SELECT yr, mo, y, x, sic FROM field f WHERE dataset = 'obs1' AND EXISTS (SELECT 1 FROM field g WHERE g.dataset = 'obs2' AND (g.yr, g.mo, g.y, g.x) = (f.yr, f.mo, f.y, f.x)) AND EXISTS (SELECT 1 FROM field g WHERE g.dataset = 'model_a' AND (g.yr, g.mo, g.y, g.x) = (f.yr, f.mo, f.y, f.x))")(
    lambda v: a.three_way(pick(v, "obs1"), pick(v, "obs2"), pick(v, "model_a"), YM).select(*YM, "sic")
)
query("J4_colocation_mask", f"WITH {sql_pairs(['thick'], how='FULL')} SELECT yr, mo, y, x, (thick IS NOT NULL AND thick2 IS NOT NULL AND NOT (thick = 0 AND thick2 = 0)) AS keep FROM p")(
    lambda v: pairs(v, ["thick"], how="full").select(*YM, F.coalesce(a.both_zero_mask(F.col("thick"), F.col("thick2")), F.lit(False)).alias("keep"))
)
query("J5_observed_match", f"WITH {sql_pairs(['thick'])}, o AS (SELECT * FROM field WHERE dataset = 'obs2') SELECT yr, mo, y, x, p.thick, p.thick2 FROM p JOIN o USING (yr, mo, y, x) WHERE p.thick > 0 AND p.thick2 IS NOT NULL AND o.thick IS NOT NULL")(
    lambda v: pairs(v, ["thick"]).join(pick(v, "obs2").select(*YM, F.col("thick").alias("other")), YM).where(a.observed(F.col("thick"), F.col("thick2"), F.col("other"))).select(*YM, "thick", "thick2")
)
query("J6_vector_match", f"WITH {sql_pairs(['u', 'v'])} SELECT y, x, count(*) AS n FROM p WHERE nullif(u, 0) IS NOT NULL AND nullif(v, 0) IS NOT NULL AND nullif(u2, 0) IS NOT NULL AND nullif(v2, 0) IS NOT NULL GROUP BY ALL")(
    lambda v: pairs(v, ["u", "v"]).where(" AND ".join(f"nullif({x}, 0D) IS NOT NULL" for x in ("u", "v", "u2", "v2"))).groupBy("y", "x").agg(F.count("*").alias("n"))
)
query("J7_external_mask", "SELECT dataset, time, f.y, f.x, CASE WHEN m.region IS NOT NULL THEN sic END AS sic FROM field f LEFT JOIN (SELECT * FROM grid WHERE region <= 3) m ON m.y = f.y AND m.x = f.x")(
    lambda v: a.masked(v.field.select("dataset", "time", "y", "x", "sic"), v.grid.where("region <= 3"), ["sic"])
)
query("J8_field_with_area", "SELECT dataset, time, y, x, sic, cell_area FROM fieldg")(lambda v: v.field_grid.select("dataset", "time", "y", "x", "sic", "cell_area"))
query("J9_climatology_to_series", f"SELECT dataset, y, x, time, {q('avg(sic) OVER (PARTITION BY dataset, y, x, mo)')} AS clim FROM field")(
    lambda v: c.anomaly(v.field, "sic").select("dataset", "y", "x", "time", r(F.col("sic") - F.col("anomaly")).alias("clim"))
)
query("J10_term_merge", f"WITH s AS (SELECT dataset, time, y, x, {', '.join(f'''sum(CASE WHEN term = '{t}' THEN value END) AS {t}''' for t in ('dyn', 'growth', 'melt', 'snow'))} FROM flux GROUP BY ALL) SELECT dataset, time, y, x, {', '.join(f'{q(t + ' * 1e7')} AS {t}' for t in ('dyn', 'growth', 'melt', 'snow'))} FROM s WHERE dyn IS NOT NULL AND growth IS NOT NULL AND melt IS NOT NULL AND snow IS NOT NULL")(
    lambda v: v.flux.groupBy("dataset", "time", "y", "x").pivot("term", ["dyn", "growth", "melt", "snow"]).sum("value").na.drop().select("dataset", "time", "y", "x", *(r(F.col(t) * 1e7).alias(t) for t in ("dyn", "growth", "melt", "snow")))
)
query("J11_months_in_both", "SELECT dataset, time, y, x, sic FROM field f WHERE dataset = 'obs2' AND EXISTS (SELECT 1 FROM field g WHERE g.dataset = 'obs1' AND g.sic > 98 AND g.yr = f.yr AND g.mo = f.mo)")(
    lambda v: pick(v, "obs2").join(pick(v, "obs1").where("sic > 98").select("yr", "mo").distinct(), ["yr", "mo"], "left_semi").select("dataset", "time", "y", "x", "sic")
)
MODELS = "md AS (SELECT dataset AS label, CAST(row_number() OVER (ORDER BY dataset) AS INT) AS position FROM (SELECT DISTINCT dataset FROM field)), me AS (SELECT \"group\", member FROM ensemble UNION ALL SELECT 'index', CAST(position AS VARCHAR) FROM md WHERE position <> 2 UNION ALL SELECT 'mixed', ' ' || upper(label) FROM md WHERE position < 3 UNION ALL SELECT 'mixed', '1' UNION ALL SELECT 'mixed', '99')"


def members(v):
    """The ensemble's groups by label, and groups by position and by both."""
    models = v.field.select(F.col("dataset").alias("label")).distinct()
    models = models.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("label")))  # a list of datasets
    add = lambda name, member, rows: rows.select(F.lit(name).alias("group"), member.alias("member"))
    entries = v.ensemble.select("group", "member").unionByName(add("index", F.col("position").cast("string"), models.where("position <> 2")))
    entries = entries.unionByName(add("mixed", F.concat(F.lit(" "), F.upper("label")), models.where("position < 3"))).unionByName(add("mixed", F.explode(F.array(F.lit("1"), F.lit("99"))), models.where("position = 1")))
    return a.membership(entries, models)


query("J12_membership", f"""WITH {MODELS}, mb AS (SELECT "group", label AS dataset FROM me JOIN md ON lower(trim(member)) = lower(trim(label)) UNION SELECT "group", label FROM me JOIN md ON TRY_CAST(member AS INT) = position WHERE lower(trim(member)) NOT IN (SELECT lower(trim(label)) FROM md)) SELECT "group", dataset, count(*) AS n FROM mb JOIN field USING (dataset) GROUP BY ALL""")(
    lambda v: v.field.join(members(v), "dataset").groupBy("group", "dataset").agg(F.count("*").alias("n"))
)
MEMBERS = "m AS (SELECT DISTINCT dataset, y, x, term, yr, mo, dataset || ':' || y || ':' || x AS member FROM flux)"
query("J15_complete_members", f"WITH {MEMBERS}, c AS (SELECT member, term FROM m WHERE yr = 1997 GROUP BY 1, 2 HAVING count(DISTINCT mo) >= 5), f AS (SELECT member FROM c GROUP BY 1 HAVING count(*) = 4) SELECT DISTINCT dataset, y, x, term FROM m WHERE member IN (SELECT member FROM f)")(
    lambda v: a.complete_members(v.flux.select("dataset", "y", "x", "term", "yr", "mo").distinct().withColumn("member", F.concat_ws(":", "dataset", "y", "x")), "member", "term", list(TERMS), 1997, 1997, least=5).select("dataset", "y", "x", "term").distinct()
)

# Differences.
WP = f"WITH {sql_pairs(['thick', 'sic'])}, w AS (SELECT * FROM p JOIN grid USING (y, x))"
weighted = lambda v: pairs(v, ["thick", "sic"]).join(v.grid, ["y", "x"])
for _id, _name, _sql in (("M1", "bias", sql_bias("thick2", "thick", "cell_area")), ("M2", "mae", sql_mae("thick2", "thick", "cell_area")), ("M3", "rmse", sql_rmse("thick2", "thick", "cell_area"))):
    query(f"{_id}_{_name}", f"{WP} SELECT mo, {q(_sql)} AS value FROM w GROUP BY mo")(lambda v, m=_name: weighted(v).groupBy("mo").agg(r(METRICS[m](F.col("thick2"), F.col("thick"), F.col("cell_area"))).alias("value")))
query("M4_corr", f"{WP}, g AS (SELECT mo, {sql_corr('thick2 * cell_area', 'thick * cell_area')} AS r, CAST(regr_count(thick2 * cell_area, thick * cell_area) AS BIGINT) AS n FROM w GROUP BY mo) SELECT mo, {q('r')} AS value, {q(sql_p('r', 'n'))} AS p FROM g")(
    lambda v: (lambda w: w.groupBy("mo").agg(regression(F.col("thick2") * F.col("cell_area"), F.col("thick") * F.col("cell_area")).alias("reg")).select("mo", r(F.col("reg.r")).alias("value"), r(student_p(F.col("reg.r"), F.col("reg.n"))).alias("p")))(weighted(v))
)
_masked = "CASE WHEN sic > 15 THEN {} END"
query("M5_metric_dispatch", f"{WP} SELECT {q(sql_bias(_masked.format('thick2'), _masked.format('thick'), 'cell_area'))} AS bias, {q(sql_mae(_masked.format('thick2'), _masked.format('thick'), 'cell_area'))} AS mae, {q(sql_rmse(_masked.format('thick2'), _masked.format('thick'), 'cell_area'))} AS rmse, {q(sql_corr(_masked.format('thick2') + ' * cell_area', _masked.format('thick') + ' * cell_area'))} AS corr FROM w")(
    lambda v: weighted(v).agg(*(r(metric(m, F.col("thick2"), F.col("thick"), F.col("cell_area"), F.col("sic") > 15)).alias(m) for m in METRICS))
)
SQL_WCORR = "m AS (SELECT *, sum({x} * cell_area) OVER k / sum(cell_area) OVER k AS mx, sum({y} * cell_area) OVER k / sum(cell_area) OVER k AS my FROM {t} WINDOW k AS (PARTITION BY {key}))"
WC = "CASE WHEN count(*) >= {n} AND sum(pow({x} - mx, 2) * cell_area) > 1e-12 AND sum(pow({y} - my, 2) * cell_area) > 1e-12 THEN sum(({x} - mx) * ({y} - my) * cell_area) / sqrt(sum(pow({x} - mx, 2) * cell_area) * sum(pow({y} - my, 2) * cell_area)) END"
query("M6_area_correlation", f"{WP}, {SQL_WCORR.format(x='thick', y='thick2', t='w', key='mo')} SELECT mo, {q(WC.format(x='thick', y='thick2', n=3))} AS value FROM m GROUP BY mo")(lambda v: rounded(k.area_correlation(weighted(v), "thick", "thick2", "cell_area", ["mo"], 3), "mo"))
query("M7_series_skill", f"WITH {SERIES}, p AS (SELECT sector, time, a.extent AS e1, b.extent AS e2 FROM (SELECT * FROM series WHERE dataset = 'obs1') a JOIN (SELECT * FROM series WHERE dataset = 'model_a') b USING (sector, time)) SELECT sector, {q(sql_corr('e2', 'e1'))} AS corr, {q(sql_rmse('e2', 'e1'))} AS rmse FROM p GROUP BY ALL")(
    lambda v: a.aligned(series(v).where("dataset = 'obs1'"), series(v).where("dataset = 'model_a'"), ["extent"], ["sector", "time"]).groupBy("sector")
    .agg(*(r(x).alias(n) for x, n in zip(k.paired_skill(F.col("extent2"), F.col("extent")), ("corr", "rmse"), strict=True)))
)
maps = lambda v, x, fn=F.avg: v.field.groupBy("dataset", "y", "x").agg(fn(x).alias("m"))
MAPS = "g AS (SELECT dataset, y, x, avg(sic) AS m FROM field GROUP BY ALL), p AS (SELECT y, x, a.m AS m, b.m AS m2 FROM (SELECT * FROM g WHERE dataset = 'obs1') a JOIN (SELECT * FROM g WHERE dataset = 'model_a') b USING (y, x))"
map_pairs = lambda v, df: a.aligned(df.where("dataset = 'obs1'"), df.where("dataset = 'model_a'"), ["m"], ["y", "x"])
query("M8_map_correlation", f"WITH {MAPS} SELECT {q(sql_corr('m2', 'm'))} AS value FROM p")(lambda v: map_pairs(v, maps(v, "sic")).agg(r(correlation(F.col("m2"), F.col("m"))).alias("value")))
MD = f"WITH {sql_pairs(['sic'])}, d AS (SELECT mo, {sql_bias('sic2', 'sic')} AS bias, {sql_mae('sic2', 'sic')} AS mae, {sql_rmse('sic2', 'sic')} AS rmse FROM p GROUP BY mo)"
query("M9_monthly_to_annual", f"{MD} SELECT {', '.join(f'{q(f'sum({m} * {cal.SQL_DAYS}) / sum({cal.SQL_DAYS})')} AS {m}' for m in ('bias', 'mae', 'rmse'))} FROM d")(lambda v: rounded(k.day_weighted(k.monthly_difference(pairs(v, ["sic"]), "sic", "sic2", []), ["bias", "mae", "rmse"], [])))
query("M10_variability_difference", f"WITH an AS (SELECT dataset, y, x, sic - avg(sic) OVER (PARTITION BY dataset, y, x, mo) AS an FROM field), {MAPS.replace('avg(sic) AS m FROM field', 'stddev_pop(an) AS m FROM an')} SELECT {q(sql_bias('m2', 'm'))} AS bias, {q(sql_mae('m2', 'm'))} AS mae, {q(sql_rmse('m2', 'm'))} AS rmse FROM p")(
    lambda v: map_pairs(v, c.anomaly(v.field, "sic").groupBy("dataset", "y", "x").agg(F.stddev_pop("anomaly").alias("m"))).agg(*(r(METRICS[m](F.col("m2"), F.col("m"), F.lit(1.0))).alias(m) for m in ("bias", "mae", "rmse")))
)
SL = sql_slope("extent", INDEX)
query("M11_trend_difference", f"WITH {SERIES}, s AS (SELECT dataset, sector, {SL} * 120 AS t FROM series GROUP BY ALL) SELECT sector, {q('abs(b.t - a.t)', 4)} AS absolute, {q('b.t - a.t', 4)} AS signed FROM (SELECT * FROM s WHERE dataset = 'obs1') a JOIN (SELECT * FROM s WHERE dataset = 'model_a') b USING (sector)")(
    lambda v: (lambda s: a.aligned(s.where("dataset = 'obs1'"), s.where("dataset = 'model_a'"), ["t"], ["sector"]).select("sector", r(F.abs(F.col("t2") - F.col("t")), 4).alias("absolute"), r(F.col("t2") - F.col("t"), 4).alias("signed")))(
        series(v).groupBy("dataset", "sector").agg((regression(F.col("extent"), index())["slope"] * 120).alias("t"))
    )
)
EDGE = f"""WITH {sql_pairs(['sic'], how='FULL')}, w AS (SELECT p.*, cell_area, coalesce(sic >= 15, FALSE) AS o, coalesce(sic2 >= 15, FALSE) AS m FROM p JOIN grid USING (y, x)),
e AS (SELECT yr, mo, coalesce(sum(CASE WHEN m AND NOT o THEN cell_area END), 0) / 1e12 AS over_, coalesce(sum(CASE WHEN o AND NOT m THEN cell_area END), 0) / 1e12 AS under_ FROM w GROUP BY ALL)"""


def edges(v, keys):
    return rounded(k.edge_error(pairs(v, ["sic"], how="full").join(v.grid, ["y", "x"]), "sic", "sic2", "cell_area", keys), *keys)


query("M12_edge_error", f'{EDGE} SELECT yr, mo, {q("over_")} AS "over", {q("under_")} AS "under", {q("over_ + under_")} AS total, {q("over_ - under_")} AS net FROM e')(lambda v: edges(v, ["yr", "mo"]))
VP = f"WITH {sql_pairs(['u', 'v'])}, o AS (SELECT y, x, nullif(u, 0) AS u1, nullif(v, 0) AS v1, nullif(u2, 0) AS u2, nullif(v2, 0) AS v2 FROM p), k AS (SELECT * FROM o WHERE u1 IS NOT NULL AND v1 IS NOT NULL AND u2 IS NOT NULL AND v2 IS NOT NULL)"
_cov = [(x, y) for i, x in enumerate(("u1", "v1", "u2", "v2")) for y in ("u1", "v1", "u2", "v2")[i:]]
VC = f"""{VP}, s AS (SELECT y, x, count(*) AS n, {', '.join(f'covar_samp({x}, {y}) AS {x}{y}' for x, y in _cov)} FROM k GROUP BY ALL),
f AS (SELECT y, x, n, u1u1 * (u2u2 * v1v2 * v1v2 + v2v2 * v1u2 * v1u2) + v1v1 * (u2u2 * u1v2 * u1v2 + v2v2 * u1u2 * u1u2) + 2 * (u1v1 * u1v2 * v1u2 * u2v2 + u1v1 * u1u2 * v1v2 * u2v2)
 - 2 * (u1u1 * v1u2 * v1v2 * u2v2 + v1v1 * u1u2 * u1v2 * u2v2 + u2u2 * u1v1 * u1v2 * v1v2 + v2v2 * u1v1 * u1u2 * v1u2) AS f, (u1u1 * v1v1 - u1v1 * u1v1) * (u2u2 * v2v2 - u2v2 * u2v2) AS g FROM s),
c AS (SELECT y, x, CASE WHEN n >= 11 AND abs(g) > 1e-14 THEN f / g / 2 END AS value FROM f)"""


def vectors(v):
    names = {"u": "u1", "v": "v1", "u2": "u2", "v2": "v2"}
    return pairs(v, ["u", "v"]).select(*YM, *(F.nullif(F.col(x), F.lit(0.0)).alias(n) for x, n in names.items()))


query("M14_vector_correlation", f"{VC} SELECT y, x, {q('value')} AS value FROM c")(lambda v: rounded(k.vector_correlation(vectors(v), ["y", "x"]), "y", "x"))
query("M14_mean_vector_correlation", f"{VC} SELECT {q('avg(value)')} AS value FROM c")(lambda v: k.vector_correlation(vectors(v), ["y", "x"]).agg(r(F.avg("value")).alias("value")))
CM = "g AS (SELECT dataset, y, x, avg(u) AS u, avg(v) AS v FROM field GROUP BY ALL), p AS (SELECT a.u AS u1, a.v AS v1, b.u AS u2, b.v AS v2 FROM (SELECT * FROM g WHERE dataset = 'obs1') a JOIN (SELECT * FROM g WHERE dataset = 'model_a') b USING (y, x)), n AS (SELECT CASE WHEN (u1 * u1 + v1 * v1) * (u2 * u2 + v2 * v2) > 0 THEN (u1 * u2 + v1 * v2) / sqrt((u1 * u1 + v1 * v1) * (u2 * u2 + v2 * v2)) END AS c FROM p)"
query("M15_mean_cosine", f"WITH {CM} SELECT {q('CASE WHEN count(c) >= 2 THEN avg(c) END')} AS value FROM n")(
    lambda v: (lambda g: k.mean_cosine(a.aligned(g.where("dataset = 'obs1'"), g.where("dataset = 'model_a'"), ["u", "v"], ["y", "x"]).withColumnsRenamed({"u": "u1", "v": "v1"}), []).select(r(F.col("value")).alias("value")))(
        v.field.groupBy("dataset", "y", "x").agg(F.avg("u").alias("u"), F.avg("v").alias("v"))
    )
)
SE, SEC = cal.SQL_SEASON, ["season"]
DOMAINS = f"(SELECT *, unnest(['annual', {SE}, 'month ' || mo]) AS domain FROM field)"
domains = lambda v: v.field.withColumn("domain", F.explode(F.array(F.lit("annual"), cal.season(F.col("mo")), F.concat(F.lit("month "), F.col("mo").cast("string")))))
two = lambda d: f"(SELECT mo, {sql_bias('sic2', 'sic')} AS e FROM (SELECT mo, a.sic, b.sic AS sic2 FROM (SELECT * FROM field WHERE dataset = 'obs1') a JOIN (SELECT * FROM field WHERE dataset = '{d}') b USING (yr, mo, y, x)) GROUP BY mo)"
query("M25_uncertainty_ratio", f"SELECT mo, {q('abs(m.e) / greatest(abs(o.e), 1e-9)', 4)} AS ratio FROM {two('model_a')} m JOIN {two('obs2')} o USING (mo)")(
    lambda v: (lambda m, o: m.join(o.select("mo", F.col("bias").alias("second")), "mo").select("mo", r(k.uncertainty_ratio(F.col("bias"), F.col("second")), 4).alias("ratio")))(
        k.monthly_difference(pairs(v, ["sic"]), "sic", "sic2", []), k.monthly_difference(pairs(v, ["sic"], two="obs2"), "sic", "sic2", [])
    )
)
query("M26_difference_maps", f"WITH g AS (SELECT dataset, y, x, unnest(['annual', {SE}, 'month ' || mo]) AS domain, sic FROM field), m AS (SELECT dataset, y, x, domain, avg(sic) AS m FROM g GROUP BY ALL) SELECT domain, y, x, {q('b.m - a.m', 5)} AS value FROM (SELECT * FROM m WHERE dataset = 'obs1') a JOIN (SELECT * FROM m WHERE dataset = 'model_a') b USING (domain, y, x)")(
    lambda v: (lambda m: a.aligned(m.where("dataset = 'obs1'"), m.where("dataset = 'model_a'"), ["m"], ["domain", "y", "x"]).select("domain", "y", "x", r(F.col("m2") - F.col("m"), 5).alias("value")))(domains(v).groupBy("dataset", "domain", "y", "x").agg(F.avg("sic").alias("m")))
)
