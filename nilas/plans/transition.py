"""W1-W6 and what is made of transition dates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from nilas.functions.stats import METRICS, regression, sql_bias, sql_corr, sql_p, sql_rmse, sql_slope, student_p
from nilas.functions.stats import rounded as r
from nilas.functions.stats import sql_round as q
from nilas.operators import skill as k
from nilas.operators import transition as t
from nilas.operators.domains import ratios
from nilas.operators.integrals import area_mean, area_share
from nilas.plans.registry import query
from nilas.plans.skill import SQL_WCORR, WC
from nilas.plans.trends import rounded
from nilas.sources.files import kept

KEYS = "dataset, start_year, y, x"
CYC = f"""cyc AS (SELECT *, CAST(row_number() OVER k - 1 AS INT) AS t, CAST(count(*) OVER (PARTITION BY {KEYS}) AS INT) AS cycle FROM (SELECT *, CASE WHEN mo >= 3 THEN yr ELSE yr - 1 END AS start_year FROM daily) WINDOW k AS (PARTITION BY {KEYS} ORDER BY time))"""
SM = f"""sm AS (SELECT *, (sum(sic) OVER n + greatest(0, 7 - t) * first_value(sic) OVER k + greatest(0, 7 - (cycle - 1 - t)) * last_value(sic) OVER k) / 15 AS smooth FROM cyc
 WINDOW n AS (PARTITION BY {KEYS} ORDER BY t ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), k AS (PARTITION BY {KEYS} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
CR = f"""cr AS (SELECT *, coalesce(smooth >= 15 AND before < 15 AND n = 6 AND lo > 15 AND t BETWEEN 1 AND cycle - 8, FALSE) AS up, coalesce(smooth <= 15 AND before > 15 AND n = 6 AND hi < 15 AND t BETWEEN 1 AND cycle - 7, FALSE) AS down
 FROM (SELECT *, lag(smooth) OVER (PARTITION BY {KEYS} ORDER BY t) AS before, count(smooth) OVER a AS n, min(smooth) OVER a AS lo, max(smooth) OVER a AS hi FROM sm WINDOW a AS (PARTITION BY {KEYS} ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)))"""
RAW = f"raw AS (SELECT {KEYS}, cycle, min(CASE WHEN up THEN t END) AS a, max(CASE WHEN down THEN t END) AS b FROM cr GROUP BY ALL)"
DT = f"""dt AS (SELECT {KEYS}, cycle, advance, CASE WHEN coalesce(b < advance, FALSE) OR coalesce(b < round(0.28 * cycle), FALSE) THEN NULL ELSE b END AS retreat
 FROM (SELECT *, CASE WHEN coalesce(a > b, FALSE) OR coalesce(a > round(0.66 * cycle), FALSE) THEN NULL ELSE a END AS advance FROM raw))"""
DATES = f"WITH {CYC}, {SM}, {CR}, {RAW}, {DT}"
PAIR = f"{DATES}, pr AS (SELECT m.dataset, start_year, y, x, o.cycle, o.advance AS a1, m.advance AS a2, o.retreat AS r1, m.retreat AS r2 FROM (SELECT * FROM dt WHERE dataset = 'obs1') o JOIN (SELECT * FROM dt WHERE dataset <> 'obs1') m USING (start_year, y, x))"
CELL = ["dataset", "y", "x"]


def dates(v):
    """Dates of all cycles, made once: tables of them read them up to a dozen times."""
    return kept(t.transition_dates(v.months_of_days), "dates")


def pairs(v):
    """Dates of the first observation beside those of every other dataset."""
    d = dates(v)
    o, m = d.where("dataset = 'obs1'"), d.where("dataset <> 'obs1'")
    on = ["start_year", "y", "x"]
    return o.select(*on, "cycle", F.col("advance").alias("a1"), F.col("retreat").alias("r1")).join(m.select("dataset", *on, F.col("advance").alias("a2"), F.col("retreat").alias("r2")), on)


query("W1_running_mean", f"WITH {CYC}, {SM} SELECT {KEYS}, t, {q('smooth')} AS smooth FROM sm")(lambda v: t.smooth(t.cycles(v.daily)).select(*t.CYCLE, "t", r(F.col("smooth")).alias("smooth")))
query("W2_advance_date", f"WITH {CYC}, {SM}, {CR}, {RAW} SELECT {KEYS}, a AS advance FROM raw")(lambda v: t.raw_dates(v.months_of_days).select(*t.CYCLE, "advance"))
query("W3_retreat_date", f"WITH {CYC}, {SM}, {CR}, {RAW} SELECT {KEYS}, b AS retreat FROM raw")(lambda v: t.raw_dates(v.months_of_days).select(*t.CYCLE, "retreat"))
query("W4_transition_year", f"WITH {CYC} SELECT {KEYS}, time, t, cycle FROM cyc")(lambda v: t.cycles(v.months_of_days.drop("i", "sic", "u", "v")).select(*t.CYCLE, "time", "t", "cycle"))
query("W5_date_control", f"{DATES} SELECT {KEYS}, cycle, advance, retreat FROM dt")(lambda v: dates(v).select(*t.CYCLE, "cycle", "advance", "retreat"))
LAGGED = f"{DATES}, s AS (SELECT dataset, start_year, avg(advance) AS a, avg(retreat) AS b FROM dt GROUP BY ALL), l AS (SELECT *, lead(a) OVER (PARTITION BY dataset ORDER BY start_year) AS a_next FROM s)"


def lagged(v):
    s = dates(v).groupBy("dataset", "start_year").agg(F.avg("advance").alias("a"), F.avg("retreat").alias("b"))
    return s.withColumn("a_next", F.lead("a").over(Window.partitionBy("dataset").orderBy("start_year")))


query(
    "W6_retreat_advance_relation",
    LAGGED + f", lr AS (SELECT l.*, r0, n0, r1, n1 FROM l JOIN (SELECT dataset, {sql_corr('a', 'b')} AS r0, CAST(regr_count(a, b) AS BIGINT) AS n0, {sql_corr('a_next', 'b')} AS r1, CAST(regr_count(a_next, b) AS BIGINT) AS n1 FROM l GROUP BY dataset) USING (dataset))" + " UNION ALL ".join(f" SELECT dataset, {lag} AS lag, {q(f'CASE WHEN regr_count({y}, b) >= 3 THEN {sql_corr(y, "b")} END', 4)} AS corr, {q(f'CASE WHEN regr_count({y}, b) >= 3 THEN {sql_slope(y, "b")} END', 4)} AS slope, {q(f'any_value(CASE WHEN n{lag} >= 3 THEN {sql_p(f"r{lag}", f"n{lag}")} END)', 4)} AS p, {q(f'any_value(CASE WHEN n{lag} >= 3 THEN r{lag} * r{lag} END)', 4)} AS r2 FROM lr GROUP BY dataset" for lag, y in ((0, "a"), (1, "a_next"))),
)(
    lambda v: (lambda s: (lambda one: one(0, "a").unionByName(one(1, "a_next")))(lambda lag, y: s.groupBy("dataset").agg(*(r(c, 4).alias(n) for n, c in t.relation(F.col(y), F.col("b")).items() if n != "n")).withColumn("lag", F.lit(lag))))(lagged(v))
)
query("J14_date_pairs", f"{PAIR} SELECT dataset, start_year, y, x, a1, a2, r1, r2 FROM pr")(lambda v: pairs(v).select("dataset", "start_year", "y", "x", "a1", "a2", "r1", "r2"))
query("V9_date_trend", f"{DATES}, g AS (SELECT dataset, y, x, count(advance) AS valid, {sql_slope('advance', 'start_year')} AS s, {sql_corr('advance', 'start_year')} AS r, CAST(regr_count(advance, start_year) AS BIGINT) AS n FROM dt GROUP BY ALL) SELECT dataset, y, x, CASE WHEN valid >= 3 THEN valid END AS valid, {q('CASE WHEN valid >= 3 THEN s END', 4)} AS trend, {q(f'CASE WHEN valid >= 3 THEN {sql_p("r", "n")} END', 4)} AS p FROM g")(
    lambda v: dates(v).groupBy(*CELL).agg(F.count("advance").alias("n"), regression("advance", "start_year").alias("reg")).withColumn("ok", F.col("n") >= F.greatest(F.lit(3), F.ceil(0.6 * F.lit(5)).cast("int")))
    .select(*CELL, F.when(F.col("ok"), F.col("n")).alias("valid"), r(F.when(F.col("ok"), F.col("reg.slope")), 4).alias("trend"), r(F.when(F.col("ok"), student_p(F.col("reg.r"), F.col("reg.n"))), 4).alias("p"))
)
A13 = f"{DATES}, g AS (SELECT dataset, y, x, count(advance) AS valid, {sql_corr('advance', 'start_year')} AS r, CAST(regr_count(advance, start_year) AS BIGINT) AS n FROM dt GROUP BY ALL), f AS (SELECT dataset, y, x, CASE WHEN {sql_p('r', 'n')} IS NOT NULL THEN CAST({sql_p('r', 'n')} < 0.05 AS INT) END AS flag FROM g)"
flags = lambda v: dates(v).groupBy(*CELL).agg(regression("advance", "start_year").alias("reg")).select(*CELL, F.when(student_p(F.col("reg.r"), F.col("reg.n")).isNotNull(), (student_p(F.col("reg.r"), F.col("reg.n")) < 0.05).cast("int")).alias("flag"))
query("A13_significant_share", f"{A13} SELECT dataset, {q('100 * sum(flag * cell_area) / sum(CASE WHEN flag IS NOT NULL THEN cell_area END)', 4)} AS share FROM f JOIN grid USING (y, x) GROUP BY ALL")(lambda v: flags(v).join(v.grid, ["y", "x"]).groupBy("dataset").agg(r(area_share(F.col("flag"), F.col("cell_area")), 4).alias("share")))
query("A14_durations", f"{DATES} SELECT {KEYS}, CASE WHEN retreat - advance > 0 THEN retreat - advance END AS ice_season, CASE WHEN cycle - (CASE WHEN retreat - advance > 0 THEN retreat - advance END) > 0 THEN cycle - (retreat - advance) END AS open_water FROM dt")(
    lambda v: t.durations(dates(v)).select(*t.CYCLE, "ice_season", "open_water")
)
query("A15_transition_means", f"{A13}, d AS (SELECT dataset, y, x, avg(advance) AS mean, stddev_pop(advance) AS std, count(advance) AS n FROM dt GROUP BY ALL) SELECT dataset, {q('avg(mean)', 4)} AS mean, {q('avg(std)', 4)} AS std, {q('avg(n)', 4)} AS years, {q('100 * avg(flag)', 4)} AS share FROM d JOIN f USING (dataset, y, x) GROUP BY ALL")(
    lambda v: rounded(dates(v).groupBy(*CELL).agg(F.avg("advance").alias("mean"), F.stddev_pop("advance").alias("std"), F.count("advance").alias("n")).join(flags(v), CELL).groupBy("dataset").agg(F.avg("mean").alias("mean"), F.avg("std").alias("std"), F.avg("n").alias("years"), (100 * F.avg("flag")).alias("share")), "dataset", digits=4)
)
M20 = f"{PAIR}, g AS (SELECT dataset, y, x, avg(a1) AS a1, avg(a2) AS a2, avg(CASE WHEN r1 - a1 > 0 THEN r1 - a1 END) AS d1, avg(CASE WHEN r2 - a2 > 0 THEN r2 - a2 END) AS d2 FROM pr GROUP BY ALL), w AS (SELECT * FROM g JOIN grid USING (y, x))"


def clim_pairs(v):
    d = pairs(v).withColumns({"d1": F.when(F.col("r1") > F.col("a1"), F.col("r1") - F.col("a1")), "d2": F.when(F.col("r2") > F.col("a2"), F.col("r2") - F.col("a2"))})
    return d.groupBy("dataset", "y", "x").agg(*(F.avg(c).alias(c) for c in ("a1", "a2", "d1", "d2"))).join(v.grid, ["y", "x"])


query("M20_date_skill", f"{M20} SELECT dataset, {', '.join(f'{q(f(b, a, "cell_area"), 4)} AS {n}_{m}' for n, a, b in (('advance', 'a1', 'a2'), ('duration', 'd1', 'd2')) for m, f in (('bias', sql_bias), ('rmse', sql_rmse)))} FROM w GROUP BY dataset")(
    lambda v: clim_pairs(v).groupBy("dataset").agg(*(r(METRICS[m](F.col(b), F.col(a), F.col("cell_area")), 4).alias(f"{n}_{m}") for n, a, b in (("advance", "a1", "a2"), ("duration", "d1", "d2")) for m in ("bias", "rmse")))
)
query("M20_date_correlation", f"{M20}, o AS (SELECT * FROM w WHERE a1 IS NOT NULL AND a2 IS NOT NULL), {SQL_WCORR.format(x='a1', y='a2', t='o', key='dataset')} SELECT dataset, {q(WC.format(x='a1', y='a2', n=3), 4)} AS value FROM m GROUP BY dataset")(
    lambda v: rounded(k.area_correlation(clim_pairs(v), "a1", "a2", "cell_area", ["dataset"], 3), "dataset", digits=4)
)
query("M21_edge_curve", f"""{PAIR}, d AS (SELECT dataset, start_year, day, cell_area, coalesce(a1 <= day, FALSE) AS o, coalesce(a2 <= day, FALSE) AS m FROM pr JOIN grid USING (y, x) CROSS JOIN (SELECT CAST(unnest(range(1, 366, 5)) AS INT) AS day))
 SELECT dataset, start_year, day, {q('coalesce(sum(CASE WHEN m AND NOT o THEN cell_area END), 0) / 1e12')} AS "over", {q('coalesce(sum(CASE WHEN o AND NOT m THEN cell_area END), 0) / 1e12')} AS "under" FROM d GROUP BY ALL""")(
    lambda v: rounded(t.edge_curve(pairs(v).join(v.grid, ["y", "x"]), "a1", "a2", "cell_area", True, ["dataset", "start_year"]), "dataset", "start_year", "day")
)
query("A12_yearly_area_mean_date", f"{DATES} SELECT dataset, start_year, {q('sum(advance * cell_area) / sum(CASE WHEN advance IS NOT NULL THEN cell_area END)', 4)} AS value FROM dt JOIN grid USING (y, x) GROUP BY ALL")(
    lambda v: dates(v).join(v.grid, ["y", "x"]).groupBy("dataset", "start_year").agg(r(area_mean(F.col("advance"), F.col("cell_area")), 4).alias("value"))
)

PHASES = f"""{DATES}, ph AS (SELECT dataset, start_year, y, x, 'advance' AS phase, advance AS day FROM dt UNION ALL SELECT dataset, start_year, y, x, 'retreat', retreat FROM dt),
pg AS (SELECT dataset, phase, y, x, avg(day) AS clim, stddev_pop(day) AS std, CAST(count(day) AS BIGINT) AS valid, {sql_slope('day', 'start_year')} AS s, {sql_corr('day', 'start_year')} AS r, CAST(regr_count(day, start_year) AS BIGINT) AS n FROM ph GROUP BY ALL),
pm AS (SELECT dataset, phase, y, x, clim, std, valid, CASE WHEN valid >= 3 THEN s END AS trend, CASE WHEN valid >= 3 AND {sql_p('r', 'n')} IS NOT NULL THEN CAST({sql_p('r', 'n')} < 0.05 AS INT) END AS significant FROM pg),
du AS (SELECT dataset, y, x, avg(ice) AS ice_season, avg(CASE WHEN cycle - ice > 0 THEN cycle - ice END) AS open_water FROM (SELECT *, CASE WHEN retreat - advance > 0 THEN retreat - advance END AS ice FROM dt) GROUP BY ALL),
ym AS (SELECT dataset, start_year, avg(advance) AS a, avg(retreat) AS b FROM dt GROUP BY ALL), yl AS (SELECT o.dataset, o.b, m.a AS n FROM ym o LEFT JOIN ym m ON m.dataset = o.dataset AND m.start_year = o.start_year + 1),
lg AS (SELECT dataset, CASE WHEN regr_count(n, b) >= 3 THEN {sql_corr('n', 'b')} END AS lag_corr FROM yl GROUP BY dataset)"""
RAW8 = ["clim", "std", "trend", "valid", "significant", "ice_season", "open_water", "lag_corr"]
DIFF10 = ["corr", "rmse", "bias", "trend_bias", "significant", "valid", "ice_season_bias", "open_water_bias", "duration_rmse", "lag_corr_bias"]
query("B4_phase_table", f"{PHASES}, pa AS (SELECT dataset, phase, avg(clim) AS clim, avg(std) AS std, avg(trend) AS trend, avg(valid) AS valid, 100 * avg(significant) AS significant FROM pm GROUP BY ALL), da AS (SELECT dataset, avg(ice_season) AS ice_season, avg(open_water) AS open_water FROM du GROUP BY ALL) SELECT dataset, phase, {', '.join(f'{q(c, 4)} AS {c}' for c in RAW8)} FROM pa JOIN da USING (dataset) JOIN lg USING (dataset)")(
    lambda v: rounded(t.phase_table(dates(v)).select("dataset", "phase", *RAW8), "dataset", "phase", digits=4)
)
BOTH = f"""{PHASES}, pl AS (SELECT pm.*, ice_season, open_water FROM pm LEFT JOIN du USING (dataset, y, x)), bo AS (SELECT m.*, o.clim AS clim0, o.trend AS trend0, o.ice_season AS ice0, o.open_water AS open0, cell_area FROM (SELECT * FROM pl WHERE dataset <> 'obs1') m JOIN (SELECT * FROM pl WHERE dataset = 'obs1') o USING (phase, y, x) JOIN grid USING (y, x)),
ok AS (SELECT * FROM bo WHERE clim IS NOT NULL AND clim0 IS NOT NULL), {SQL_WCORR.format(x='clim0', y='clim', t='ok', key='dataset, phase')}, co AS (SELECT dataset, phase, {WC.format(x='clim0', y='clim', n=3)} AS corr FROM m GROUP BY dataset, phase),
ag AS (SELECT dataset, phase, {sql_rmse('clim', 'clim0', 'cell_area')} AS rmse, {sql_bias('clim', 'clim0', 'cell_area')} AS bias, {sql_bias('trend', 'trend0', 'cell_area')} AS trend_bias, 100 * sum(significant * cell_area) / sum(CASE WHEN significant IS NOT NULL THEN cell_area END) AS significant, avg(valid) AS valid,
 {sql_bias('ice_season', 'ice0', 'cell_area')} AS ice_season_bias, {sql_bias('open_water', 'open0', 'cell_area')} AS open_water_bias, CASE WHEN phase = 'advance' THEN {sql_rmse('ice_season', 'ice0', 'cell_area')} ELSE {sql_rmse('open_water', 'open0', 'cell_area')} END AS duration_rmse FROM bo GROUP BY dataset, phase),
pd AS (SELECT dataset, phase, corr, ag.* EXCLUDE (dataset, phase), lg.lag_corr - (SELECT lag_corr FROM lg WHERE dataset = 'obs1') AS lag_corr_bias FROM ag LEFT JOIN co USING (dataset, phase) JOIN lg USING (dataset))"""
query("M20_phase_differences", f"{BOTH} SELECT dataset, phase, {', '.join(f'{q(c, 4)} AS {c}' for c in DIFF10)} FROM pd")(lambda v: rounded(t.phase_differences(dates(v), v.grid).select("dataset", "phase", *DIFF10), "dataset", "phase", digits=4))
query("B4_phase_difference_table", f"{BOTH} SELECT w.dataset, phase, {', '.join(f'{q(f"abs(w.{c}) / greatest(abs(o.{c}), 1e-9)", 3)} AS {c}' for c in DIFF10)} FROM pd w LEFT JOIN (SELECT * FROM pd WHERE dataset = 'obs2') o USING (phase)")(
    lambda v: rounded(ratios(t.phase_differences(dates(v), v.grid), DIFF10, ["phase"]), "dataset", "phase", digits=3)
)
