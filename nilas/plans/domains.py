"""Tables by domain: M16, M17, M22-M24, M10-M13, B1-B3, B12, A16-A18, W16."""

from __future__ import annotations

from pyspark.sql import functions as F

from nilas.functions import calendar as cal
from nilas.functions.stats import rounded as r
from nilas.functions.stats import sql_corr, sql_mae, sql_p, sql_rest, sql_rmse, sql_slope
from nilas.functions.stats import sql_round as q
from nilas.operators import climatology as c
from nilas.operators import domains as d
from nilas.operators import integrals as n
from nilas.operators import skill as k
from nilas.operators import tables as tb
from nilas.operators import trends as t
from nilas.operators.align import both_zero_mask, observed
from nilas.plans.climatology import CELL, SERIES, series
from nilas.plans.registry import query
from nilas.plans.trends import INDEX, METRIC, SQL_V6, index, period_table, rounded

SE, SY, DAYS = cal.SQL_SEASON, cal.SQL_SEASON_YEAR, cal.SQL_DAYS
NAMES = f"['annual', {SE}, 'month ' || mo]"
PER_DECADE = "CASE WHEN domain = 'annual' THEN 120 ELSE 10 END"
IN_SEASON = "domain IN ('DJF', 'MAM', 'JJA', 'SON')"


# The operators of nilas.operators.domains in SQL; each gives one or more CTEs.
def sql_samples(name: str, source: str, values, keys: str) -> str:
    an = ", ".join(f"{v}, {v} - avg({v}) OVER (PARTITION BY {keys}, mo) AS {v}_an" for v in values)
    own = ", ".join(f"CASE WHEN count({x}) >= CASE WHEN {IN_SEASON} THEN 2 ELSE 1 END THEN avg({x}) END AS {x}" for v in values for x in (v, f"{v}_an"))
    rows = f"SELECT *, unnest({NAMES}) AS domain, unnest([yr * 12 + mo, {SY}, yr]) AS t FROM (SELECT {keys}, yr, mo, {an} FROM {source})"
    return f"{name} AS (SELECT {keys}, domain, CAST(t AS INT) AS t, {own} FROM ({rows}) GROUP BY {keys}, domain, t)"


def sql_clim(name: str, source: str, values, keys: str) -> str:
    own = ", ".join(f"sum({v} * w) / sum(CASE WHEN {v} IS NOT NULL THEN w END) AS {v}" for v in values)
    return f"{name} AS (SELECT {keys}, domain, {own} FROM (SELECT *, {DAYS} AS w, unnest({NAMES}) AS domain FROM (SELECT {keys}, mo, {', '.join(f'avg({v}) AS {v}' for v in values)} FROM {source} GROUP BY {keys}, mo)) GROUP BY {keys}, domain)"


def sql_maps(name: str, source: str, values, keys: str, detrended: bool = False) -> str:
    cells = f"{keys}, y, x"
    own = ", ".join(f"{sql_rest(f'{v}_an', 't') if detrended else f'stddev_pop({v}_an)'} AS {v}_std, {sql_slope(f'{v}_an', 't')} * {PER_DECADE} AS {v}_trend" for v in values)
    return f"{sql_samples(name + '_s', source, values, cells)}, {name} AS (SELECT {cells}, domain, {own} FROM {name}_s GROUP BY {cells}, domain)"


def sql_series(name: str, source: str, values, keys: str) -> str:
    ok = " AND ".join(f"{v}_an IS NOT NULL" for v in values)
    own = ", ".join(f"stddev_pop({v}_an) AS {v}_std, {sql_slope(f'{v}_an', 'k')} * {PER_DECADE} AS {v}_trend" for v in values)
    if len(values) == 2:
        a, b = (f"{v}_an" for v in values)
        own += f", CASE WHEN count(*) >= 2 THEN {sql_corr(b, a)} END AS corr, CASE WHEN count(*) >= 2 THEN {sql_rmse(b, a)} END AS rmse"
    return f"""{sql_samples(name + '_s', source, values, keys)}, {sql_clim(name + '_c', source, values, keys)},
    {name}_t AS (SELECT {keys}, domain, {own} FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, domain ORDER BY t) AS k FROM {name}_s WHERE {ok}) GROUP BY {keys}, domain),
    {name} AS (SELECT {', '.join(f'{v} AS {v}_mean' for v in values)}, * EXCLUDE ({', '.join(values)}) FROM {name}_c LEFT JOIN {name}_t USING ({keys}, domain))"""


def sql_map_differences(name: str, source: str, keys: str, weight: str = "", detrended: bool = False) -> str:
    """source has a, b and, where weighted, the weight by cell."""
    cells, w = f"{keys}, y, x", weight or "1.0"
    area = f", max({weight}) AS {weight}" if weight else ""
    joined = f" JOIN (SELECT {cells}{area} FROM {source} GROUP BY {cells}) USING ({cells})" if weight else ""
    return f"""{name}_y AS (SELECT {keys}, 'annual' AS domain, sum(mean * {DAYS}) / sum(CASE WHEN mean IS NOT NULL THEN {DAYS} END) AS mean FROM
      (SELECT {keys}, mo, {sql_mae('b', 'a', w)} AS mean FROM (SELECT {cells}, mo, avg(a) AS a, avg(b) AS b{area} FROM {source} GROUP BY {cells}, mo) GROUP BY {keys}, mo) GROUP BY {keys}),
    {sql_clim(name + '_c', source, ('a', 'b'), cells)}, {name}_p AS (SELECT {keys}, domain, {sql_mae('b', 'a', w)} AS mean FROM {name}_c{joined} WHERE domain <> 'annual' GROUP BY {keys}, domain),
    {sql_maps(name + '_m', source, ('a', 'b'), keys, detrended)},
    {name}_d AS (SELECT {keys}, domain, {sql_mae('b_std', 'a_std', w)} AS std, {sql_mae('b_trend', 'a_trend', w)} AS trend FROM {name}_m{joined} GROUP BY {keys}, domain),
    {name} AS (SELECT * FROM (SELECT {keys}, domain, mean FROM {name}_y UNION ALL SELECT {keys}, domain, mean FROM {name}_p) LEFT JOIN {name}_d USING ({keys}, domain))"""


def sql_differences(name: str, source: str, keys: str, signed: bool = False) -> str:
    own = ", ".join(f"{'' if signed else 'abs'}(b_{x} - a_{x}) AS {x}" for x in ("mean", "std", "trend"))
    return f"{sql_series(name + '_w', source, ('a', 'b'), keys)}, {name} AS (SELECT {keys}, domain, {own}, corr, rmse FROM {name}_w)"


def sql_pairs(name: str, value: str, source: str = "field", how: str = "") -> str:
    """a and b of one value by dataset and cell, against obs1."""
    if not how:
        return f"{name} AS (SELECT b.dataset, yr, mo, y, x, a.{value} AS a, b.{value} AS b FROM (SELECT * FROM {source} WHERE dataset <> 'obs1') b JOIN (SELECT * FROM {source} WHERE dataset = 'obs1') a USING (yr, mo, y, x))"
    return f"""{name} AS (SELECT dataset, yr, mo, y, x, a.{value} AS a, b.{value} AS b FROM (SELECT * FROM {source} WHERE dataset <> 'obs1') b
    FULL JOIN (SELECT k.dataset, o.yr, o.mo, o.y, o.x, o.{value} FROM {source} o, (SELECT DISTINCT dataset FROM {source} WHERE dataset <> 'obs1') k WHERE o.dataset = 'obs1') a USING (dataset, yr, mo, y, x))"""


def sql_out(columns, digits: int = 4, source: str = "") -> str:
    return ", ".join(f"{q(f'{source}{x}', digits)} AS {x}" for x in columns)


def ds(df, columns, keys=("dataset", "domain"), digits=4):
    return df.select(*keys, *(r(F.col(x), digits).alias(x) for x in columns))


# Concentration: edge error, season pair table, skill matrix.
EDGES = f"""{sql_pairs('fp', 'sic', how='FULL')}, em AS (SELECT dataset, yr, mo, coalesce(sum(CASE WHEN coalesce(b >= 15, FALSE) <> coalesce(a >= 15, FALSE) THEN cell_area END), 0) / 1e12 AS edge FROM fp JOIN grid USING (y, x) GROUP BY ALL), {sql_clim('ed', 'em', ('edge',), 'dataset')}"""
TEN = ["sic_mean", "sic_std", "sic_trend", "extent_mean", "extent_std", "extent_trend", "area_mean", "area_std", "area_trend", "edge_mean"]


def _total(metric: str) -> str:
    return f"(SELECT b.dataset, yr, mo, a.{metric} AS a, b.{metric} AS b FROM (SELECT * FROM series WHERE sector = 'All' AND dataset <> 'obs1') b JOIN (SELECT * FROM series WHERE sector = 'All' AND dataset = 'obs1') a USING (yr, mo))"


SEASONS = f"""WITH {SERIES}, {sql_pairs('sp', 'sic')}, {sql_map_differences('sd', 'sp', 'dataset', detrended=True)}, {EDGES}, xe AS {_total('extent')}, xa AS {_total('area')}, {sql_differences('de', 'xe', 'dataset')}, {sql_differences('da', 'xa', 'dataset')},
ten AS (SELECT dataset, domain, sd.mean AS sic_mean, sd.std AS sic_std, sd.trend AS sic_trend, de.mean AS extent_mean, de.std AS extent_std, de.trend AS extent_trend, da.mean AS area_mean, da.std AS area_std, da.trend AS area_trend, edge AS edge_mean
 FROM sd LEFT JOIN de USING (dataset, domain) LEFT JOIN da USING (dataset, domain) LEFT JOIN ed USING (dataset, domain))"""


def edges(v):
    return d.edge_by_domain(d.against(v.field, ["sic"], how="outer").join(v.grid, ["y", "x"]), "a_sic", "b_sic", "cell_area", ["dataset"])


def season_pairs(v):
    s = series(v).where("sector = 'All'").select("dataset", "yr", "mo", "extent", "area")
    base = s.where("dataset = 'obs1'").select("yr", "mo", F.col("extent").alias("a_extent"), F.col("area").alias("a_area"))
    pairs = s.where("dataset <> 'obs1'").select("dataset", "yr", "mo", F.col("extent").alias("b_extent"), F.col("area").alias("b_area")).join(base, ["yr", "mo"])
    return d.season_pair_table(d.pair_of(d.against(v.field, ["sic"]), "sic"), pairs, edges(v))


query("M12_annual_edge_error", f"WITH {EDGES} SELECT dataset, domain, {q('edge')} AS edge FROM ed")(lambda v: ds(edges(v), ["edge"], digits=6))
query("M22_season_pair_table", f"{SEASONS} SELECT dataset, domain, {sql_out(TEN)} FROM ten WHERE {IN_SEASON}")(lambda v: ds(season_pairs(v).where(F.col("domain").isin(*cal.SEASONS)), TEN))


def sql_ratios(source: str, columns, keys: str = "domain") -> str:
    return f"SELECT w.dataset, {', '.join(f'w.{x}' for x in keys.split(', '))}, {', '.join(f'{q(f"abs(w.{x}) / greatest(abs(o.{x}), 1e-9)", 4)} AS {x}' for x in columns)} FROM {source} w LEFT JOIN (SELECT * FROM {source} WHERE dataset = 'obs2') o USING ({keys})"


query("B12_skill_matrix", f"{SEASONS} {sql_ratios(f'''(SELECT * FROM ten WHERE domain = 'annual' OR {IN_SEASON})''', TEN)}")(
    lambda v: ds(d.ratios(season_pairs(v).where(F.col("domain").isin("annual", *cal.SEASONS)), TEN, ["domain"]), TEN)
)

# Drift.
SPEED = "fs AS (SELECT *, sqrt(u * u + v * v) AS speed, (u * u + v * v) / 2 AS energy FROM (SELECT dataset, yr, mo, y, x, nullif(u, 0) AS u, nullif(v, 0) AS v FROM field))"
RAW5 = ["mean", "series_std", "series_trend", "map_std", "map_trend"]
DIFF8 = ["mean", "series_std", "series_trend", "map_std", "map_trend", "vector_corr", "corr", "rmse"]
_COV = [(x, y) for i, x in enumerate(("a_u", "a_v", "b_u", "b_v")) for y in ("a_u", "a_v", "b_u", "b_v")[i:]]


def speeds(v):
    w = v.field.withColumns({"u": F.nullif("u", F.lit(0.0)), "v": F.nullif("v", F.lit(0.0))})
    return w.select("dataset", "yr", "mo", "y", "x", "u", "v", n.speed(F.col("u"), F.col("v")).alias("speed"), n.kinetic_energy(F.col("u"), F.col("v")).alias("energy"))


def drift_raw(v):
    s = speeds(v)
    one = d.series_statistics(s.groupBy("dataset", "yr", "mo").agg(F.avg("speed").alias("speed")), ["speed"], ["dataset"]).drop("speed_mean")
    maps = d.map_statistics(s, ["speed"], ["dataset"]).groupBy("dataset", "domain").agg(F.avg("speed_std").alias("map_std"), F.avg(F.abs("speed_trend")).alias("map_trend"))
    clim = s.groupBy("dataset", "mo", "y", "x").agg(F.avg("speed").alias("speed")).groupBy("dataset", "mo").agg(F.avg("speed").alias("mean"))
    on = ["dataset", "domain"]
    return d.climatologies(clim, ["mean"], ["dataset"]).join(one.withColumnsRenamed({"speed_std": "series_std", "speed_trend": "series_trend"}), on, "left").join(maps, on, "left")


SQL_RAW = f"""{SPEED}, tsp AS (SELECT dataset, yr, mo, avg(speed) AS speed FROM fs GROUP BY ALL), {sql_series('ss', 'tsp', ('speed',), 'dataset')}, {sql_maps('sm', 'fs', ('speed',), 'dataset')},
mm AS (SELECT dataset, domain, avg(speed_std) AS map_std, avg(abs(speed_trend)) AS map_trend FROM sm GROUP BY ALL), mc AS (SELECT dataset, mo, avg(speed) AS mean FROM (SELECT dataset, mo, y, x, avg(speed) AS speed FROM fs GROUP BY ALL) GROUP BY ALL), {sql_clim('cm', 'mc', ('mean',), 'dataset')},
raw AS (SELECT dataset, domain, mean, speed_std AS series_std, speed_trend AS series_trend, map_std, map_trend FROM cm LEFT JOIN ss USING (dataset, domain) LEFT JOIN mm USING (dataset, domain))"""
query("M23_drift_domains", f"WITH {SQL_RAW} SELECT dataset, domain, {sql_out(RAW5)} FROM raw")(lambda v: ds(drift_raw(v), RAW5))


def vector_pairs(v):
    p = d.against(speeds(v), ["u", "v"])
    return p.select("dataset", "y", "x", *(F.col(a).alias(b) for a, b in (("a_u", "u1"), ("a_v", "v1"), ("b_u", "u2"), ("b_v", "v2"))))


def drift_differences(v, value="speed", signed=False):
    p = d.against(speeds(v), ["speed", "energy", "u", "v"]).where("a_speed IS NOT NULL AND b_speed IS NOT NULL")
    own = d.pair_of(p, value)
    maps = d.map_differences(own, ["dataset"]).withColumnsRenamed({"std": "map_std", "trend": "map_trend"})
    ts = own.groupBy("dataset", "yr", "mo").agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    ts = d.series_differences(ts, ["dataset"], signed).drop("mean").withColumnsRenamed({"std": "series_std", "trend": "series_trend"})
    vc = k.vector_correlation(vector_pairs(v), ["dataset", "y", "x"]).groupBy("dataset").agg(F.avg("value").alias("vector_corr"))
    return maps.join(ts, ["dataset", "domain"], "left").join(vc, "dataset", "left")


def sql_drift(value: str, signed: bool = False) -> str:
    """Vector correlation as the trace of the product of the inverse blocks and the cross blocks of the covariance matrix."""
    s = lambda x, y: f"{x}{y}" if (x, y) in _COV else f"{y}{x}"
    inverse = lambda p: {("u", "u"): s(f"{p}_v", f"{p}_v"), ("v", "v"): s(f"{p}_u", f"{p}_u"), ("u", "v"): f"-{s(f'{p}_u', f'{p}_v')}", ("v", "u"): f"-{s(f'{p}_u', f'{p}_v')}"}
    one, two = inverse("a"), inverse("b")
    trace = " + ".join(f"({one[i, j]}) * {s(f'a_{j}', f'b_{m}')} * ({two[m, o]}) * {s(f'a_{i}', f'b_{o}')}" for i in "uv" for j in "uv" for m in "uv" for o in "uv")
    g = f"({s('a_u', 'a_u')} * {s('a_v', 'a_v')} - {s('a_u', 'a_v')} * {s('a_u', 'a_v')}) * ({s('b_u', 'b_u')} * {s('b_v', 'b_v')} - {s('b_u', 'b_v')} * {s('b_u', 'b_v')})"
    return f"""{SPEED}, dp AS (SELECT b.dataset, yr, mo, y, x, a.speed AS a_speed, b.speed AS b_speed, a.energy AS a_energy, b.energy AS b_energy, a.u AS a_u, a.v AS a_v, b.u AS b_u, b.v AS b_v
      FROM (SELECT * FROM fs WHERE dataset <> 'obs1') b JOIN (SELECT * FROM fs WHERE dataset = 'obs1') a USING (yr, mo, y, x)),
    dv AS (SELECT *, a_{value} AS a, b_{value} AS b FROM dp WHERE a_speed IS NOT NULL AND b_speed IS NOT NULL), {sql_map_differences('dm', 'dv', 'dataset')}, dt AS (SELECT dataset, yr, mo, avg(a) AS a, avg(b) AS b FROM dv GROUP BY ALL), {sql_differences('dd', 'dt', 'dataset', signed)},
    vs AS (SELECT dataset, y, x, count(*) AS n, {', '.join(f'covar_samp({x}, {y}) AS {x}{y}' for x, y in _COV)} FROM dp WHERE a_u IS NOT NULL AND a_v IS NOT NULL AND b_u IS NOT NULL AND b_v IS NOT NULL GROUP BY dataset, y, x),
    vc AS (SELECT dataset, avg(CASE WHEN n >= 11 AND abs({g}) > 1e-14 THEN ({trace}) / ({g}) / 2 END) AS vector_corr FROM vs GROUP BY dataset),
    drift AS (SELECT dataset, domain, dm.mean, dd.std AS series_std, dd.trend AS series_trend, dm.std AS map_std, dm.trend AS map_trend, vector_corr, corr, rmse FROM dm LEFT JOIN dd USING (dataset, domain) LEFT JOIN vc USING (dataset))"""


query("M23_drift_domain_differences", f"WITH {sql_drift('speed')} SELECT dataset, domain, {sql_out(DIFF8)} FROM drift")(lambda v: ds(drift_differences(v), DIFF8))
DRIFT6 = ["mean", "map_std", "series_std", "map_trend", "series_trend", "vector_corr"]
query("M16_drift_pair", f"WITH {sql_drift('energy', True)} SELECT dataset, domain, {sql_out(DRIFT6, 5)} FROM drift WHERE domain = 'annual'")(lambda v: ds(drift_differences(v, "energy", True).where("domain = 'annual'"), DRIFT6, digits=5))
query("B12_drift_matrix", f"WITH {sql_drift('speed')} {sql_ratios(f'''(SELECT * FROM drift WHERE domain = 'annual' OR {IN_SEASON})''', DIFF8[:6])}")(
    lambda v: ds(d.ratios(drift_differences(v).where(F.col("domain").isin("annual", *cal.SEASONS)), DIFF8[:6], ["domain"]), DIFF8[:6])
)


def side_by_side(raw, differences, keys=("dataset", "domain")):
    """Raw columns, and the difference columns, 0 for the reference itself."""
    names = [x for x in differences.columns if x not in keys]
    joined = raw.join(differences.select(*keys, *(F.col(x).alias(f"{x}_diff") for x in names)), list(keys), "left")
    return joined.withColumns({f"{x}_diff": F.when(F.col("dataset") == "obs1", 0.0).otherwise(F.col(f"{x}_diff")) for x in names})


def sql_side(raw: str, differences: str, one, two, digits: int = 4) -> str:
    diff = ", ".join(f"{q(f'''CASE WHEN dataset = 'obs1' THEN 0.0 ELSE f.{x} END''', digits)} AS {x}_diff" for x in two)
    return f"SELECT dataset, domain, {sql_out(one, digits, 'w.')}, {diff} FROM {raw} w LEFT JOIN {differences} f USING (dataset, domain)"


B3D = [*RAW5, *(f"{x}_diff" for x in DIFF8)]
query("B3_drift_table", f"WITH {SQL_RAW}, {sql_drift('speed').replace(SPEED + ', ', '')} {sql_side('raw', 'drift', RAW5, DIFF8)}")(lambda v: ds(side_by_side(drift_raw(v), drift_differences(v).select("dataset", "domain", *DIFF8)), B3D))

# Thickness.
THICK = "th AS (SELECT dataset, yr, mo, y, x, CASE WHEN thick BETWEEN 0 AND 200 THEN thick END AS thick, cell_area FROM fieldg)"
RAW6 = ["mean", "std", "trend", "volume_mean", "volume_std", "volume_trend"]
THICK8 = [*RAW6, "corr", "rmse"]
VOLUME = "1e3 * {} / 1e6 / 1e3"


def thick(v):
    return v.field_grid.select("dataset", "yr", "mo", "y", "x", F.when(F.col("thick").between(0, 200), F.col("thick")).alias("thick"), "cell_area")


def thickness_raw(v):
    h, on = thick(v), ["dataset", "domain"]
    clim = d.climatologies(h, ["thick"], CELL).groupBy(*on).agg(F.avg("thick").alias("mean"))
    maps = d.map_statistics(h, ["thick"], ["dataset"]).groupBy(*on).agg(F.avg("thick_std").alias("std"), F.avg("thick_trend").alias("trend"))
    vol = h.groupBy("dataset", "yr", "mo").agg(n.volume(F.col("thick"), F.col("cell_area")).alias("volume"))
    return clim.join(maps, on, "left").join(d.series_statistics(vol, ["volume"], ["dataset"]), on, "left")


SQL_THICK = f"""{THICK}, {sql_clim('hc', 'th', ('thick',), 'dataset, y, x')}, hm AS (SELECT dataset, domain, avg(thick) AS mean FROM hc GROUP BY ALL), {sql_maps('hp', 'th', ('thick',), 'dataset')}, hs AS (SELECT dataset, domain, avg(thick_std) AS std, avg(thick_trend) AS trend FROM hp GROUP BY ALL),
vt AS (SELECT dataset, yr, mo, sum(thick / 1e3 * cell_area / 1e6) / 1e3 AS volume FROM th GROUP BY ALL), {sql_series('vl', 'vt', ('volume',), 'dataset')},
raw AS (SELECT dataset, domain, mean, std, trend, volume_mean, volume_std, volume_trend FROM hm LEFT JOIN hs USING (dataset, domain) LEFT JOIN vl USING (dataset, domain))"""
query("M24_thickness_domains", f"WITH {SQL_THICK} SELECT dataset, domain, {sql_out(RAW6)} FROM raw")(lambda v: ds(thickness_raw(v), RAW6))
#: How cells are matched: pairs that are not both zero, where the observation is over zero, and where a second observation is there too.
MODES = {
    "pairwise": ("NOT (a = 0 AND b = 0)", lambda: both_zero_mask(F.col("a"), F.col("b"))),
    "observed": ("a > 0", lambda: observed(F.col("a"), F.col("b"))),
    "both_observed": ("a > 0 AND second IS NOT NULL", lambda: observed(F.col("a"), F.col("b"), F.col("second"))),
}


def thickness_differences(v, mode="pairwise", signed=False):
    h = thick(v)
    second = h.where("dataset = 'obs2'").select("yr", "mo", "y", "x", F.col("thick").alias("second"))
    p = d.pair_of(d.against(h, ["thick"]), "thick").join(v.grid.select("y", "x", "cell_area"), ["y", "x"]).join(second, ["yr", "mo", "y", "x"], "left")
    own = p.where(MODES[mode][1]())
    maps = d.map_differences(own, ["dataset"], "cell_area")
    every = p if mode == "pairwise" else own  # the volume of pairs is that of all cells each has
    ts = every.withColumn("_w", F.col("cell_area") / 1e12).groupBy("dataset", "yr", "mo").agg(F.sum(F.col("a") * F.col("_w")).alias("a"), F.sum(F.col("b") * F.col("_w")).alias("b"))
    ts = d.series_differences(ts, ["dataset"], signed).withColumnsRenamed({x: f"volume_{x}" for x in ("mean", "std", "trend")})
    return maps.join(ts, ["dataset", "domain"], "left")


def sql_thickness(mode: str, p: str = "m", signed: bool = False) -> str:
    return f"""{p}tp AS (SELECT q.dataset, q.yr, q.mo, q.y, q.x, q.a, q.b, q.cell_area, s.thick AS second FROM (SELECT b.dataset, b.yr, b.mo, b.y, b.x, a.thick AS a, b.thick AS b, b.cell_area FROM (SELECT * FROM th WHERE dataset <> 'obs1') b JOIN (SELECT * FROM th WHERE dataset = 'obs1') a USING (yr, mo, y, x)) q
      LEFT JOIN (SELECT * FROM th WHERE dataset = 'obs2') s USING (yr, mo, y, x)),
    {p}to AS (SELECT * FROM {p}tp WHERE {MODES[mode][0]}), {sql_map_differences(p + 'td', p + 'to', 'dataset', 'cell_area')},
    {p}tv AS (SELECT dataset, yr, mo, sum(a * cell_area) / 1e12 AS a, sum(b * cell_area) / 1e12 AS b FROM {p}{'tp' if mode == 'pairwise' else 'to'} GROUP BY ALL), {sql_differences(p + 'tw', p + 'tv', 'dataset', signed)},
    {p}thd AS (SELECT dataset, domain, d.mean, d.std, d.trend, w.mean AS volume_mean, w.std AS volume_std, w.trend AS volume_trend, corr, rmse FROM {p}td d LEFT JOIN {p}tw w USING (dataset, domain))"""


query("M24_thickness_domain_differences", f"WITH {THICK}, {sql_thickness('pairwise')} SELECT dataset, domain, {sql_out(THICK8)} FROM mthd")(lambda v: ds(thickness_differences(v), THICK8))
KEY_DOMAINS = ["annual", *(f"month {m}" for m in cal.KEY_MONTHS["south"])]
_KEYS = ", ".join(f"'{x}'" for x in KEY_DOMAINS)


def thickness_pair(v):
    out = None
    for mode in MODES:
        own = ds(thickness_differences(v, mode, True).where(F.col("domain").isin(*KEY_DOMAINS)).withColumn("mode", F.lit(mode)), THICK8, ("mode", "dataset", "domain"))
        out = own if out is None else out.unionByName(own)
    return out


query(
    "M17_thickness_pair",
    f"WITH {THICK}, " + ", ".join(sql_thickness(m, f"m{i}", True) for i, m in enumerate(MODES)) + " " + " UNION ALL ".join(f"SELECT '{m}' AS mode, dataset, domain, {sql_out(THICK8)} FROM m{i}thd WHERE domain IN ({_KEYS})" for i, m in enumerate(MODES)),
)(thickness_pair)
query("B12_thickness_matrix", f"WITH {THICK}, {sql_thickness('pairwise')} {sql_ratios(f'''(SELECT * FROM mthd WHERE domain IN ({_KEYS}) OR {IN_SEASON})''', [*RAW6, 'rmse'])}")(
    lambda v: ds(d.ratios(thickness_differences(v).where(F.col("domain").isin(*KEY_DOMAINS, *cal.SEASONS)), [*RAW6, "rmse"], ["domain"]), [*RAW6, "rmse"])
)
B3T = [*RAW6, *(f"{x}_diff" for x in THICK8)]
query("B3_thickness_table", f"WITH {SQL_THICK}, {sql_thickness('pairwise')} {sql_side('raw', 'mthd', RAW6, THICK8)}")(lambda v: ds(side_by_side(thickness_raw(v), thickness_differences(v).select("dataset", "domain", *THICK8)), B3T))

# Period tables of concentration.
NAMES4 = ["area", "extent", "marginal", "pack"]
V6CTE = SQL_V6[5:].rsplit(" SELECT dataset, sector, metric, period,", 1)[0]
STATS = {"mean": q("mean"), "trend": q("trend", 4), "detrended_std": q("rest", 4)}
PERIODS = f"w AS (SELECT dataset, sector, metric, period, {', '.join(f'{e} AS {s}' for s, e in STATS.items())}, {q(sql_p('r', 'n'), 4)} AS p, ({sql_p('r', 'n')} < 0.05) AS significant FROM st)"
_wide = lambda e: ", ".join(f"max(CASE WHEN metric = '{m}' THEN {e(s)} END) AS {m}_{s}" for m in NAMES4 for s in STATS)
query("B1_period_table", f"WITH {V6CTE}, {PERIODS} SELECT dataset, sector, period, {_wide(lambda s: s)}, {', '.join(f'''bool_or(CASE WHEN metric = '{m}' THEN significant END) AS {m}_star''' for m in NAMES4)} FROM w GROUP BY ALL")(
    lambda v: period_table(v).groupBy("dataset", "sector", "period").agg(*(F.max(F.when(F.col("metric") == m, F.col(s))).alias(f"{m}_{s}") for m in NAMES4 for s in STATS), *(F.max(F.when(F.col("metric") == m, F.col("significant"))).alias(f"{m}_star") for m in NAMES4))
)
#: Periods of the tables and the domains of the edge error.
PERIOD_DOMAINS = {"annual": "annual", **{s: s for s in cal.SEASONS}, "March": "month 3", "September": "month 9"}


def period_differences(v):
    rows = period_table(v).where("sector = 'All'")
    for s in STATS:
        rows = tb.differences(rows, ["sector", "metric", "period"], s)
    w = rows.groupBy("dataset", "period").agg(*(F.max(F.when(F.col("metric") == m, F.col(s))).alias(f"{m}_{s}_diff") for m in NAMES4 for s in STATS))
    name = F.create_map(*[F.lit(x) for kv in PERIOD_DOMAINS.items() for x in kv])
    e = edges(v).select("dataset", "domain", F.col("edge").alias("edge_mean_diff"))
    w = w.withColumn("domain", name[F.col("period")]).join(e, ["dataset", "domain"], "left")
    w = w.withColumn("edge_mean_diff", F.when(F.col("dataset") == "obs1", 0.0).otherwise(F.col("edge_mean_diff")))
    return rounded(w.drop("domain"), "dataset", "period", digits=4)


_case = " ".join(f"WHEN '{p}' THEN '{x}'" for p, x in PERIOD_DOMAINS.items())
query(
    "B2_difference_table",
    f"""WITH {V6CTE}, {PERIODS}, {EDGES}, df AS (SELECT w.dataset, w.metric, w.period, {', '.join(f'abs(w.{s} - o.{s}) AS {s}' for s in STATS)} FROM (SELECT * FROM w WHERE sector = 'All') w JOIN (SELECT * FROM w WHERE dataset = 'obs1' AND sector = 'All') o USING (metric, period)),
    dw AS (SELECT dataset, period, CASE period {_case} END AS domain, {', '.join(f"max(CASE WHEN metric = '{m}' THEN {s} END) AS {m}_{s}_diff" for m in NAMES4 for s in STATS)} FROM df GROUP BY dataset, period)
    SELECT dataset, period, {sql_out([f'{m}_{s}_diff' for m in NAMES4 for s in STATS])}, {q("CASE WHEN dataset = 'obs1' THEN 0.0 ELSE edge END", 4)} AS edge_mean_diff FROM dw LEFT JOIN ed USING (dataset, domain)""",
)(period_differences)

# Differences of variability and trend, key months.
ALL4 = ["area", "extent", "marginal", "pack"]


def total_pairs(v):
    s = series(v).where("sector = 'All'").unpivot(["dataset", "yr", "mo"], ALL4, "metric", "value")
    return s.where("dataset <> 'obs1'").withColumnRenamed("value", "b").join(s.where("dataset = 'obs1'").select("yr", "mo", "metric", F.col("value").alias("a")), ["yr", "mo", "metric"])


TOTALS = f"{SERIES}, {METRIC}, lt AS (SELECT * FROM l WHERE sector = 'All'), tp AS (SELECT b.dataset, metric, yr, mo, a.value AS a, b.value AS b FROM (SELECT * FROM lt WHERE dataset <> 'obs1') b JOIN (SELECT * FROM lt WHERE dataset = 'obs1') a USING (metric, yr, mo)), {sql_differences('td', 'tp', 'dataset, metric', True)}"
query("M10_scalar_variability", f"WITH {TOTALS} SELECT dataset, metric, domain, {sql_out(['std'])} FROM td")(lambda v: ds(d.series_differences(total_pairs(v), ["dataset", "metric"], True), ["std"], ("dataset", "metric", "domain")))
query("M11_scalar_trends", f"WITH {TOTALS} SELECT dataset, metric, domain, {q('abs(trend)', 4)} AS absolute, {q('trend', 4)} AS signed FROM td")(
    lambda v: d.series_differences(total_pairs(v), ["dataset", "metric"], True).select("dataset", "metric", "domain", r(F.abs("trend"), 4).alias("absolute"), r(F.col("trend"), 4).alias("signed"))
)
AREA_PAIRS = f"{sql_pairs('sp', 'sic')}, spa AS (SELECT * FROM sp JOIN grid USING (y, x)), {sql_map_differences('sd', 'spa', 'dataset', 'cell_area', True)}"


def sic_differences(v):
    return d.map_differences(d.pair_of(d.against(v.field, ["sic"]), "sic").join(v.grid.select("y", "x", "cell_area"), ["y", "x"]), ["dataset"], "cell_area", True)


query("M11_map_trends", f"WITH {AREA_PAIRS} SELECT dataset, domain, {sql_out(['trend'])} FROM sd")(lambda v: ds(sic_differences(v), ["trend"]))
M13 = ["mean", "std", "trend", "extent_corr", "extent_rmse", "area_corr", "area_rmse"]


def key_months(v):
    out = sic_differences(v).where(F.col("domain").isin(*KEY_DOMAINS[1:]))
    for name in ("extent", "area"):
        own = d.series_differences(total_pairs(v).where(F.col("metric") == name), ["dataset"]).select("dataset", "domain", F.col("corr").alias(f"{name}_corr"), F.col("rmse").alias(f"{name}_rmse"))
        out = out.join(own, ["dataset", "domain"], "left")
    return out


query("M13_key_months", f"WITH {AREA_PAIRS}, {TOTALS} SELECT s.dataset, s.domain, {sql_out(['mean', 'std', 'trend'], 4, 's.')}, {', '.join(f'{q(f'{m}.{x}', 4)} AS {m}_{x}' for m in ('extent', 'area') for x in ('corr', 'rmse'))} FROM sd s " + " ".join(f"LEFT JOIN (SELECT * FROM td WHERE metric = '{m}') {m} ON {m}.dataset = s.dataset AND {m}.domain = s.domain" for m in ("extent", "area")) + f" WHERE s.domain IN ({_KEYS}) AND s.domain <> 'annual'")(
    lambda v: ds(key_months(v), M13)
)
KEYM = ", ".join(map(str, cal.KEY_MONTHS["south"]))
W16A = f"an AS (SELECT dataset, y, x, yr, mo, sic, sic - avg(sic) OVER (PARTITION BY dataset, y, x, mo) AS an FROM field WHERE mo IN ({KEYM}))"


def key_month_products(v):
    """Each key month's climatology, and deviation, trend and p of its yearly anomalies."""
    rows = c.anomaly(v.field.where(F.col("mo").isin(*cal.KEY_MONTHS["south"])), "sic")
    return c.climatology(rows, "sic").join(t.map_trend(rows, "anomaly", F.col("yr"), [*CELL, "mo"], 2, 10.0), [*CELL, "mo"]).withColumnRenamed("value", "clim")


query("W16_key_month_products", f"WITH {W16A}, g AS (SELECT dataset, y, x, mo, avg(sic) AS clim, count(an) AS valid, {sql_slope('an', 'yr')} * 10 AS trend, {sql_corr('an', 'yr')} AS r, CAST(regr_count(an, yr) AS BIGINT) AS n, {sql_rest('an', 'yr')} AS rest FROM an GROUP BY ALL) SELECT dataset, y, x, mo, {q('clim', 4)} AS clim, CAST(valid AS BIGINT) AS valid, {q('CASE WHEN valid >= 2 THEN trend END', 4)} AS trend, {q(f'CASE WHEN valid >= 2 THEN {sql_p("r", "n")} END', 4)} AS p, {q('CASE WHEN valid >= 2 THEN rest END', 4)} AS rest FROM g")(
    lambda v: rounded(key_month_products(v), *CELL, "mo", digits=4)
)
query("W16_lagged_series", f"WITH m AS (SELECT dataset, yr, mo, avg(sic) AS value FROM daily GROUP BY ALL), w AS (SELECT *, yr * 12 + mo AS i FROM m) SELECT a.dataset, a.yr, a.mo, {q('a.value')} AS value, {q('b.value')} AS lag_1, {q('z.value')} AS lag_12 FROM w a LEFT JOIN w b ON b.dataset = a.dataset AND b.i = a.i - 1 LEFT JOIN w z ON z.dataset = a.dataset AND z.i = a.i - 12")(
    lambda v: rounded(c.lagged(v.daily.groupBy("dataset", "yr", "mo").agg(F.avg("sic").alias("value")), "value", ["dataset"], (1, 12)), "dataset", "yr", "mo")
)

# Product sets of one dataset: by cell, and the series of the whole domain.
P5 = ["mean", "std", "rest", "trend", "p"]


def map_products(field, value, least):
    """Mean, deviation, detrended deviation, trend and p of each cell's anomalies; trends from more than `least` months."""
    a = c.anomaly(field, value)
    own = t.map_trend(a, "anomaly", index(), CELL, least, 120.0).drop("valid")
    return a.groupBy(*CELL).agg(F.avg(value).alias("mean"), F.stddev_pop("anomaly").alias("std")).join(own, CELL)


def sql_products(value: str, source: str, least: int) -> str:
    return f"""an AS (SELECT *, {value} - avg({value}) OVER (PARTITION BY dataset, y, x, mo) AS an, {INDEX} AS i FROM {source}), pm AS (SELECT dataset, y, x, avg({value}) AS mean, stddev_pop(an) AS std, count(an) AS valid, {sql_rest('an', 'i')} AS rest, {sql_slope('an', 'i')} * 120 AS trend, {sql_corr('an', 'i')} AS r, CAST(regr_count(an, i) AS BIGINT) AS n FROM an GROUP BY ALL),
    pd AS (SELECT dataset, y, x, mean, std, {', '.join(f'CASE WHEN valid >= {least} THEN {e} END AS {x}' for x, e in (('rest', 'rest'), ('trend', 'trend'), ('p', sql_p('r', 'n'))))} FROM pm)"""


#: Trends need more than half of the months.
#: More than half of the months, in SQL.
HALF = "(SELECT n // 2 + 1 FROM span)"
query("A16_concentration_products", f"WITH {sql_products('sic', 'field', HALF)} SELECT dataset, y, x, {sql_out(P5)} FROM pd")(lambda v: ds(map_products(v.field, "sic", v.half), P5, CELL))
query("A17_thickness_products", f"WITH {THICK}, {sql_products('thick', 'th', HALF)} SELECT dataset, y, x, {sql_out(P5)} FROM pd")(lambda v: ds(map_products(thick(v), "thick", v.half), P5, CELL))
query("A18_drift_products", f"WITH {SPEED}, {sql_products('energy', 'fs', HALF)}, uv AS (SELECT dataset, y, x, avg(u) AS u, avg(v) AS v, avg(speed) AS speed FROM fs GROUP BY ALL) SELECT dataset, y, x, {sql_out(['u', 'v', 'speed', *P5], 5)} FROM pd JOIN uv USING (dataset, y, x)")(
    lambda v: (lambda s: ds(map_products(s, "energy", v.half).join(s.groupBy(*CELL).agg(*(F.avg(x).alias(x) for x in ("u", "v", "speed"))), CELL), ["u", "v", "speed", *P5], CELL, 5))(speeds(v))
)
FIT = ["clim", "anomaly", "std", "slope", "p"]


def series_products(series, values, keys):
    """Each month's value, climatology and anomaly, and the anomalies' deviation, slope and p."""
    rows = c.anomaly(series.unpivot([*keys, "time", "yr", "mo"], values, "metric", "value"), "value", [*keys, "metric"])
    fit = t.series_trend(rows.withColumn("i", index()), "anomaly", "i", [*keys, "metric"]).select(*keys, "metric", "slope", "p")
    std = rows.groupBy(*keys, "metric").agg(F.stddev_pop("anomaly").alias("std"))
    return rows.select(*keys, "metric", "time", "value", (F.col("value") - F.col("anomaly")).alias("clim"), "anomaly").join(std, [*keys, "metric"]).join(fit, [*keys, "metric"])


def sql_series_products(source: str, keys: str) -> str:
    """source: rows (keys, time, yr, mo, metric, value)."""
    p = f"CASE WHEN n = 2 AND r IS NOT NULL THEN 0.0 ELSE {sql_p('r', 'n')} END"
    return f"""sa AS (SELECT *, value - avg(value) OVER (PARTITION BY {keys}, metric, mo) AS anomaly, {INDEX} AS i FROM {source}), sf AS (SELECT {keys}, metric, stddev_pop(anomaly) AS std, {sql_slope('anomaly', 'i')} AS slope, {sql_corr('anomaly', 'i')} AS r, CAST(regr_count(anomaly, i) AS BIGINT) AS n FROM sa GROUP BY ALL)
    SELECT {keys}, metric, time, {q('value')} AS value, {q('value - anomaly')} AS clim, {q('anomaly')} AS anomaly, {q('std')} AS std, {q('slope')} AS slope, {q(p)} AS p FROM sa JOIN sf USING ({keys}, metric)"""


query("A16_concentration_series", f"WITH {SERIES}, {METRIC}, {sql_series_products('l', 'dataset, sector')}")(lambda v: rounded(series_products(series(v), ALL4, ["dataset", "sector"]), "dataset", "sector", "metric", "time"))
VOLS = "vl AS (SELECT dataset, sector, time, yr, mo, 'volume' AS metric, sum(CASE WHEN thick BETWEEN 0 AND 200 THEN thick / 1e3 * cell_area / 1e6 END) / 1e3 AS value FROM fieldg JOIN sectors USING (region) GROUP BY ALL)"
query("A17_volume_series", f"WITH {VOLS}, {sql_series_products('vl', 'dataset, sector')}")(
    lambda v: rounded(series_products(v.field_grid.join(v.sectors, "region").groupBy("dataset", "sector", "time", "yr", "mo").agg(n.volume(F.when(F.col("thick").between(0, 200), F.col("thick")), F.col("cell_area")).alias("volume")), ["volume"], ["dataset", "sector"]), "dataset", "sector", "metric", "time")
)
DTS = "ds AS (SELECT dataset, time, yr, mo, avg(sqrt(u * u + v * v)) AS speed, avg((u * u + v * v) / 2) AS energy FROM (SELECT dataset, time, yr, mo, nullif(u, 0) AS u, nullif(v, 0) AS v FROM field) GROUP BY ALL), dl AS (SELECT * FROM ds UNPIVOT INCLUDE NULLS (value FOR metric IN (speed, energy)))"
query("A18_drift_series", f"WITH {DTS}, {sql_series_products('dl', 'dataset')}")(
    lambda v: rounded(series_products(v.field.withColumns({"u": F.nullif("u", F.lit(0.0)), "v": F.nullif("v", F.lit(0.0))}).groupBy("dataset", "time", "yr", "mo").agg(F.avg(n.speed(F.col("u"), F.col("v"))).alias("speed"), F.avg(n.kinetic_energy(F.col("u"), F.col("v"))).alias("energy")), ["speed", "energy"], ["dataset"]), "dataset", "metric", "time")
)
