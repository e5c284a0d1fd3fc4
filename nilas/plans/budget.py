"""R9, W7-W15 and the budgets of concentration and mass."""

from __future__ import annotations

from pyspark.sql import functions as F

from nilas.functions import calendar as cal
from nilas.functions.stats import rounded as r
from nilas.functions.stats import sql_bias, sql_mae, sql_rmse
from nilas.functions.stats import sql_round as q
from nilas.operators import budget as b
from nilas.operators import climatology as c
from nilas.operators.integrals import sector_totals
from nilas.plans.registry import query
from nilas.plans.skill import SQL_WCORR, WC
from nilas.plans.trends import rounded
from nilas.sources.views import day_values

SEASON, SEASON_YEAR = cal.SQL_SEASON, cal.SQL_SEASON_YEAR
TERMS = ["dadt", "adv", "div", "res"]


def _hav(along: str, across: str) -> str:
    w = f"OVER (PARTITION BY {across} ORDER BY {along})"
    a, z = "radians(lat)", f"radians(lag(lat) {w})"
    return f"coalesce(2 * 6378.137 * asin(sqrt(pow(sin(abs({a} - {z}) / 2), 2) + cos({a}) * cos({z}) * pow(sin(abs(radians(lon) - radians(lag(lon) {w})) / 2), 2))) * 1000, 0)"


DIST = f"st AS (SELECT *, {_hav('x', 'y')} AS dx, {_hav('y', 'x')} AS dy FROM grid), dist AS (SELECT *, sum(dx) OVER (PARTITION BY y ORDER BY x) AS hx, sum(dy) OVER (PARTITION BY x ORDER BY y) AS hy FROM st)"


def _filter(c: str) -> str:
    return f"sum(s{c}) OVER t / nullif(sum(c{c}) OVER t, 0) AS {c}m"


FILT = f"""f1 AS (SELECT d.*, hx, hy, cell_area, region, {', '.join(f'sum({c}) OVER o AS s{c}, count({c}) OVER o AS c{c}' for c in 'uv')} FROM daily d JOIN dist USING (x, y) WINDOW o AS (PARTITION BY dataset, time, d.y ORDER BY d.x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
f2 AS (SELECT *, {_filter('u')}, {_filter('v')} FROM f1 WINDOW t AS (PARTITION BY dataset, time, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""
grad = lambda c, h, w: f"(lead({c}) OVER {w} - lag({c}) OVER {w}) / (lead({h}) OVER {w} - lag({h}) OVER {w})"
BUD = f"""{DIST}, {FILT}, f3 AS (SELECT * EXCLUDE (u, v), CASE WHEN sic >= 15 THEN um END AS u, CASE WHEN sic >= 15 THEN vm END AS v FROM f2),
f4 AS (SELECT *, {grad('sic', 'hx', 'px')} AS ax, {grad('sic', 'hy', 'py')} AS ay, {grad('u', 'hx', 'px')} AS ux, {grad('v', 'hy', 'py')} AS vy FROM f3 WINDOW px AS (PARTITION BY dataset, time, y ORDER BY x), py AS (PARTITION BY dataset, time, x ORDER BY y)),
f5 AS (SELECT *, CASE WHEN i >= 2 THEN -(u * ax + v * ay) * 86400.0 END AS a0, CASE WHEN i >= 2 THEN -sic * (ux + vy) * 86400.0 END AS d0 FROM f4),
f6 AS (SELECT dataset, time, yr, mo, i, y, x, sic, cell_area, region, (lead(sic) OVER k - lag(sic) OVER k) / 2 AS dadt, avg(a0) OVER n AS adv, avg(d0) OVER n AS div FROM f5
 WINDOW k AS (PARTITION BY dataset, y, x ORDER BY i), n AS (PARTITION BY dataset, y, x ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
bud AS (SELECT *, dadt - adv - div AS res FROM f6 WHERE dadt IS NOT NULL)"""


def budget(v):
    return b.daily_budget(v.month_tiles, v.grid, made=day_values)


def sums(v, by, values):
    return b.budget_sums(v.month_tiles, v.grid, by, values, made=day_values)


query("R9_distances", f"WITH {DIST} SELECT y, x, {q('hx', 3)} AS hx, {q('hy', 3)} AS hy FROM dist")(lambda v: rounded(b.distances(v.grid).select("y", "x", "hx", "hy"), "y", "x", digits=3))
query("W7_tendency", f"SELECT dataset, y, x, time, {q('(lead(sic) OVER k - lag(sic) OVER k) / 2')} AS value FROM daily WINDOW k AS (PARTITION BY dataset, y, x ORDER BY i)")(lambda v: v.daily.select("dataset", "y", "x", "time", r(b.tendency("sic")).alias("value")))
query("W8_three_day_mean", f"WITH a AS (SELECT dataset, y, x, i, avg(u) OVER n AS m, count(u) OVER n AS c FROM daily WINDOW n AS (PARTITION BY dataset, y, x ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) SELECT dataset, y, x, i, {q('CASE WHEN c = 3 THEN m END')} AS value FROM a")(
    lambda v: v.daily.select("dataset", "y", "x", "i", r(b.running_mean("u")).alias("value"))
)
query("W9_mean_filter", f"WITH {DIST}, {FILT} SELECT dataset, time, y, x, {q('um')} AS u, {q('vm')} AS v FROM f2")(lambda v: b.own(b.mean_filter(v.daily_tiles, ["u", "v"], frame=b.FRAME)).select("dataset", "time", "y", "x", r(F.col("u_mean")).alias("u"), r(F.col("v_mean")).alias("v")))
query("W10_gradient", f"WITH {DIST}, d AS (SELECT * FROM daily JOIN dist USING (x, y)) SELECT dataset, time, y, x, {q(grad('sic', 'hx', 'px') + ' * 1e5')} AS gx, {q(grad('sic', 'hy', 'py') + ' * 1e5')} AS gy FROM d WINDOW px AS (PARTITION BY dataset, time, y ORDER BY x), py AS (PARTITION BY dataset, time, x ORDER BY y)")(
    lambda v: b.own(v.daily_tiles.withColumns({f"g{c}": b.difference("sic", c, b.FRAME) / F.col(f"s{c}") * 1e5 for c in "xy"})).select("dataset", "time", "y", "x", r(F.col("gx")).alias("gx"), r(F.col("gy")).alias("gy"))
)
query("W11_daily_budget", f"WITH {BUD} SELECT dataset, time, y, x, {', '.join(f'{q(t, 5)} AS {t}' for t in TERMS)} FROM bud")(lambda v: rounded(budget(v).select("dataset", "time", "y", "x", *TERMS), "dataset", "time", "y", "x", digits=5))
query("W12_common_mask", f"WITH {BUD} SELECT dataset, mo, count(CASE WHEN {' AND '.join(f'{t} IS NOT NULL' for t in TERMS)} THEN 1 END) AS n, {q(f'avg(CASE WHEN {" AND ".join(f"{t} IS NOT NULL" for t in TERMS)} THEN dadt END)', 5)} AS dadt FROM bud GROUP BY ALL")(
    lambda v: b.common_mask(budget(v)).groupBy("dataset", "mo").agg(F.count("dadt").alias("n"), r(F.avg("dadt"), 5).alias("dadt"))
)
RIDGE = "coalesce(sic > 90 AND res < -1e-9 AND div > 1e-9, FALSE)"
query("W13_ridging_ratio", f"WITH {BUD} SELECT dataset, time, {q(f'sum(CAST(sic >= 15 AND {RIDGE} AS INT)) / nullif(CAST(sum(CAST(sic >= 15 AS INT)) AS DOUBLE), 0)')} AS ratio FROM bud GROUP BY ALL")(
    lambda v: rounded(b.ridging_ratio(sums(v, ["dataset", "time"], b.RIDGES), ["dataset", "time"]), "dataset", "time")
)
MEANS = f"sn AS (SELECT dataset, y, x, {SEASON} AS season, avg(sic) AS sic, avg(div) AS div, avg(res) AS res FROM bud GROUP BY ALL)"
query("W14_season_ridging_mask", f"WITH {BUD}, {MEANS} SELECT dataset, y, x, season, CASE WHEN div IS NOT NULL AND res IS NOT NULL THEN CAST({RIDGE.replace('90', '40')} AS INT) END AS mask FROM sn")(
    lambda v: budget(v).groupBy("dataset", "y", "x", cal.season(F.col("mo")).alias("season")).agg(*(F.avg(t).alias(t) for t in ("sic", "div", "res")))
    .select("dataset", "y", "x", "season", F.when(F.col("div").isNotNull() & F.col("res").isNotNull(), F.coalesce((F.col("sic") > 40) & (F.col("res") < -b.EPS) & (F.col("div") > b.EPS), F.lit(False)).cast("int")).alias("mask"))
)
query("W15_monthly_ridging", f"WITH {BUD}, d AS (SELECT dataset, yr, mo, time, sum(CAST(sic >= 15 AND {RIDGE} AS INT)) / nullif(CAST(sum(CAST(sic >= 15 AS INT)) AS DOUBLE), 0) AS ratio FROM bud GROUP BY ALL), m AS (SELECT dataset, yr, mo, avg(ratio) AS ratio FROM d GROUP BY ALL) SELECT yr, mo, {q('avg(ratio)')} AS mean, {q('stddev_pop(ratio)')} AS spread FROM m GROUP BY ALL")(
    lambda v: rounded(b.ridging_ratio(sums(v, ["dataset", "yr", "mo", "time"], b.RIDGES), ["dataset", "yr", "mo", "time"]).groupBy("dataset", "yr", "mo").agg(F.avg("ratio").alias("ratio")).groupBy("yr", "mo").agg(F.avg("ratio").alias("mean"), F.stddev_pop("ratio").alias("spread")), "yr", "mo")
)
sql_parts = lambda t, a: f"coalesce(sum(CASE WHEN {t} > 0 THEN {t} * {a} / 1e6 END), 0) AS {t}_pos, coalesce(sum(CASE WHEN {t} < 0 THEN {t} * {a} / 1e6 END), 0) AS {t}_neg, coalesce(sum({t} * {a} / 1e6), 0) AS {t}_net"
INT = f"it AS (SELECT dataset, time, mo, {', '.join(sql_parts(t, 'cell_area') for t in TERMS)} FROM bud GROUP BY ALL)"


def integrals(v):
    return sums(v, ["dataset", "time", "mo"], b.INTEGRALS).groupBy("dataset", "time", "mo").agg(*(F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in b.INTEGRALS))


PCT = {"adv": "abs(dadt_net)", "div": "abs(dadt_net)", "res": "dadt_net"}
query("A7_budget_integrals", f"WITH {BUD}, {INT} SELECT dataset, time, {', '.join(f'{q(f"{t}_{n}", 1)} AS {t}_{n}' for t in TERMS for n in ('pos', 'neg', 'net'))}, {', '.join(f'{q(f"CASE WHEN abs(dadt_net) > 1e-3 THEN {t}_net / {d} * 100 END", 2)} AS {t}_pct' for t, d in PCT.items())} FROM it")(
    lambda v: integrals(v).select("dataset", "time", *(r(F.col(f"{t}_{n}"), 1).alias(f"{t}_{n}") for t in TERMS for n in ("pos", "neg", "net")), *(r(F.when(F.abs("dadt_net") > 1e-3, F.col(f"{t}_net") / F.expr(d) * 100), 2).alias(f"{t}_pct") for t, d in PCT.items()))
)
CLOSE = f"mt AS (SELECT dataset, y, x, cell_area, region, yr, mo, sum(dadt) AS dadt, sum(adv) AS adv, sum(div) AS div, sum(res) AS res FROM bud GROUP BY ALL), mc AS (SELECT dataset, y, x, cell_area, region, mo, avg(dadt) AS dadt, avg(adv) AS adv, avg(div) AS div, avg(res) AS res FROM mt GROUP BY ALL)"


def month_clim(v):
    m = sums(v, ["dataset", "y", "x", "cell_area", "region", "yr", "mo"], b.TOTALS)  # a cell has one tile of its own
    return m.groupBy("dataset", "y", "x", "cell_area", "region", "mo").agg(*(F.avg(t).alias(t) for t in TERMS))


def closure_terms(df, keys):
    """Integrals of total, dynamic and thermodynamic change in 10^6 km2 a month, averaged over the months."""
    part = lambda t: F.sum(t * F.col("cell_area") / 1e6) / 100 / 1e6
    dyn = F.col("adv") + F.col("div")
    m = df.groupBy(*keys, "mo").agg(part(F.col("dadt")).alias("total"), part(dyn).alias("dynamic"), part(F.col("res")).alias("thermo"), part(F.col("dadt") - dyn - F.col("res")).alias("residual"))
    return m.groupBy(*keys).agg(*(F.avg(t).alias(t) for t in ("total", "dynamic", "thermo", "residual")))


PARTS = {"total": "dadt", "dynamic": "adv + div", "thermo": "res", "residual": "dadt - adv - div - res"}
CT = f"cm AS (SELECT dataset, mo, {', '.join(f'sum(({e}) * cell_area / 1e6) / 100 / 1e6 AS {n}' for n, e in PARTS.items())} FROM mc GROUP BY ALL), cl AS (SELECT dataset, {', '.join(f'avg({n}) AS {n}' for n in PARTS)} FROM cm GROUP BY ALL)"
query("A8_budget_closure", f"WITH {BUD}, {CLOSE}, {CT} SELECT dataset, {', '.join(f'{q(n)} AS {n}' for n in PARTS)}, {q('abs(total - (dynamic + thermo + residual))', 3)} AS sum_check FROM cl")(
    lambda v: closure_terms(month_clim(v), ["dataset"]).select("dataset", *(r(F.col(n)).alias(n) for n in PARTS), r(F.abs(F.col("total") - (F.col("dynamic") + F.col("thermo") + F.col("residual"))), 3).alias("sum_check"))
)
SEAS = f"ss AS (SELECT dataset, sector, {SEASON} AS season, {', '.join(f'sum({t} * cell_area / 1e6) / 100 AS {t}' for t in TERMS)} FROM mc JOIN sectors USING (region) GROUP BY ALL)"
query("A9_season_budget_table", f"WITH {BUD}, {CLOSE}, {SEAS} SELECT dataset, sector, season, {', '.join(f'{q(t, 1)} AS {t}' for t in TERMS)}, {', '.join(f'{q(f"CASE WHEN abs(dadt) > 1e-3 THEN {t} / dadt * 100 END", 2)} AS {t}_pct' for t in TERMS[1:])} FROM ss")(
    lambda v: month_clim(v).join(v.sectors, "region").groupBy("dataset", "sector", cal.season(F.col("mo")).alias("season")).agg(*((F.sum(F.col(t) * F.col("cell_area") / 1e6) / 100).alias(t) for t in TERMS))
    .select("dataset", "sector", "season", *(r(F.col(t), 1).alias(t) for t in TERMS), *(r(F.when(F.abs("dadt") > 1e-3, F.col(t) / F.col("dadt") * 100), 2).alias(f"{t}_pct") for t in TERMS[1:]))
)
COMP = f"""cp AS (SELECT * FROM (SELECT dataset, y, x, cell_area, mo, adv + div AS dynamic, res AS thermo, dadt - (adv + div) - res AS residual FROM mc) UNPIVOT INCLUDE NULLS (value FOR component IN (dynamic, thermo, residual))),
cb AS (SELECT m.dataset, component, y, x, mo, m.cell_area, m.value, o.value AS other FROM (SELECT * FROM cp WHERE dataset <> 'obs1') m JOIN (SELECT * FROM cp WHERE dataset = 'obs1') o USING (y, x, mo, component)),
cs AS (SELECT dataset, component, avg(m) AS mean, avg(b) AS bias FROM (SELECT dataset, component, mo, coalesce(sum(value * cell_area / 1e6 / 100) / 1e6, 0) AS m, coalesce(sum((value - other) * cell_area / 1e6 / 100) / 1e6, 0) AS b FROM cb GROUP BY ALL) GROUP BY ALL),
cm AS (SELECT dataset, component, y, x, cell_area, avg(value) AS value, avg(other) AS other FROM cb GROUP BY ALL), {SQL_WCORR.format(x='other', y='value', t='(SELECT * FROM cm WHERE value IS NOT NULL AND other IS NOT NULL)', key='dataset, component')}, cc AS (SELECT dataset, component, {WC.format(x='other', y='value', n=2)} AS corr FROM m GROUP BY dataset, component)"""
query("A10_component_summary", f"WITH {BUD}, {CLOSE}, {COMP} SELECT dataset, component, {q('mean', 4)} AS mean, {q('corr', 4)} AS corr, {q('bias', 4)} AS bias FROM cs LEFT JOIN cc USING (dataset, component) WHERE component <> 'residual' UNION ALL SELECT dataset, component, {q('mean', 4)}, NULL, {q('bias', 4)} FROM cs WHERE component = 'residual'")(
    lambda v: b.component_summary(month_clim(v)).select("dataset", "component", r(F.col("mean"), 4).alias("mean"), r(F.when(F.col("component") != "residual", F.col("corr")), 4).alias("corr"), r(F.col("bias"), 4).alias("bias"))  # the residual is noise around 0
)
FLUX = "fc AS (SELECT dataset, term, y, x, mo, avg(value * day(last_day(time)) * 86400) AS value FROM flux GROUP BY ALL), fs AS (SELECT dataset, term, y, x, {} AS season, sum(value) AS value FROM fc GROUP BY ALL)".format(SEASON)
query("A11_sector_mass_totals", f"WITH {FLUX} SELECT dataset, sector, season, term, {q('sum(value * cell_area) / 1e12')} AS value FROM fs JOIN grid USING (y, x) JOIN sectors USING (region) GROUP BY ALL")(
    lambda v: rounded(sector_totals(c.season_sum(c.flux_climatology(v.flux, ["dataset", "term", "y", "x"]), ["dataset", "term", "y", "x"]).join(v.grid, ["y", "x"]).join(v.sectors, "region"), ["dataset", "sector", "season", "term"]), "dataset", "sector", "season", "term")
)
query("A19_monthly_budget", f"SELECT dataset, time, y, x, {q('(lead(m) OVER k - lag(m) OVER k) / 2')} AS tendency, {q(f'm * {cal.SQL_DAYS}')} AS month_total FROM (SELECT dataset, CAST(date_trunc('month', time) AS DATE) AS time, mo, y, x, avg(sic) AS m FROM daily GROUP BY ALL) WINDOW k AS (PARTITION BY dataset, y, x ORDER BY time)")(
    lambda v: c.monthly_mean(v.months_of_days, "sic").withColumns({"i": F.year("time") * 12 + F.month("time"), "mo": F.month("time")}).select("dataset", "time", "y", "x", r(b.tendency("value")).alias("tendency"), r(F.col("value") * cal.month_days(F.col("mo"))).alias("month_total"))
)
M18 = f"""se AS (UNPIVOT (SELECT dataset, y, x, cell_area, {SEASON} AS season, {', '.join(f'sum({t}) AS {t}' for t in TERMS)} FROM mc GROUP BY ALL) ON {', '.join(TERMS)} INTO NAME term VALUE value),
sb AS (SELECT m.dataset, term, season, {sql_bias('m.value', 'o.value', 'm.cell_area')} AS bias, {sql_mae('m.value', 'o.value', 'm.cell_area')} AS mae, {sql_rmse('m.value', 'o.value', 'm.cell_area')} AS rmse FROM (SELECT * FROM se WHERE dataset <> 'obs1') m JOIN (SELECT * FROM se WHERE dataset = 'obs1') o USING (y, x, season, term) GROUP BY ALL),
sy AS (SELECT dataset, term, 'annual' AS season, {', '.join(f'sum({n} * w) / sum(CASE WHEN {n} IS NOT NULL THEN w END) AS {n}' for n in ('bias', 'mae', 'rmse'))} FROM (SELECT *, CASE season WHEN 'DJF' THEN 90 WHEN 'SON' THEN 91 ELSE 92 END AS w FROM sb) GROUP BY ALL)"""
query("M18_budget_difference", f"WITH {BUD}, {CLOSE}, {M18} SELECT dataset, term, season, {q('bias', 4)} AS bias, {q('mae', 4)} AS mae, {q('rmse', 4)} AS rmse FROM (SELECT * FROM sb UNION ALL BY NAME SELECT * FROM sy)")(
    lambda v: rounded(b.term_differences(month_clim(v)), "dataset", "term", "season", digits=4)
)
AIPE = [("adv", "net"), ("div", "net"), ("res", "pos"), ("res", "neg")]
query("M19_integral_percentage_error", f"WITH {BUD}, {INT} SELECT m.dataset, {', '.join(f'{q(f"avg(CASE WHEN abs(o.{t}_{n}) > 1e-3 THEN abs(m.{t}_{n} - o.{t}_{n}) / abs(o.{t}_{n}) * 100 END)", 2)} AS {t}_{n}' for t, n in AIPE)} FROM (SELECT * FROM it WHERE dataset = 'obs1') o JOIN (SELECT * FROM it WHERE dataset <> 'obs1') m USING (time) GROUP BY m.dataset")(
    lambda v: b.beside(integrals(v), [f"{t}_{n}" for t, n in AIPE], ["time"], "obs1").groupBy("dataset").agg(*(r(F.avg(F.when(F.abs(f"_other.{t}_{n}") > 1e-3, F.abs(F.col(f"{t}_{n}") - F.col(f"_other.{t}_{n}")) / F.abs(f"_other.{t}_{n}") * 100)), 2).alias(f"{t}_{n}") for t, n in AIPE))
)
