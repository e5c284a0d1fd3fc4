"""R1-R8 and R10-R15."""

from __future__ import annotations

from pyspark.sql import functions as F

from nilas.functions.stats import rounded as r
from nilas.functions.stats import sql_round as q
from nilas.operators import regrid as g
from nilas.operators import remap as m
from nilas.plans.registry import query
from nilas.plans.trends import rounded

N = g.EXTENT["south"] // 600
query("R1_polar_grid", f"WITH c AS (SELECT CAST(k % {N} AS INT) AS x, CAST(k // {N} AS INT) AS y FROM (SELECT DISTINCT p_partkey % {N * N} AS k FROM part)), p AS (SELECT x, y, (x - {(N - 1) / 2}) * 600000.0 AS px, (y - {(N - 1) / 2}) * 600000.0 AS py FROM c) SELECT x, y, {q('degrees(atan2(CAST(px AS DOUBLE), CAST(py AS DOUBLE)))')} AS lon, {q(f'-(90 - degrees(2 * atan(sqrt(px * px + py * py) / (2 * {g.RADIUS_M}))))')} AS lat FROM p")(
    lambda v: rounded(g.polar_grid(v.spark, 600).join(v.table("part").select((F.col("p_partkey") % (N * N)).alias("k")).distinct().select((F.col("k") % N).cast("int").alias("x"), F.floor(F.col("k") / N).cast("int").alias("y")), ["x", "y"], "left_semi").select("x", "y", "lon", "lat"), "x", "y")
)
def fitted_grids(v):
    """Whole grids of both hemispheres, with about as many cells as there are parts."""
    side = max(1, int(v.table("part").count() ** 0.5))
    grids = [g.polar_grid(v.spark, g.EXTENT[h] // side, h).withColumn("hemisphere", F.lit(h)) for h in g.EXTENT]
    return rounded(grids[0].unionByName(grids[1]).select("hemisphere", "x", "y", "lon", "lat"), "hemisphere", "x", "y")


_fit = " UNION ALL ".join(f"SELECT '{h}' AS hemisphere, {e} // greatest(1, CAST(floor(sqrt(count(*))) AS BIGINT)) AS res, {e} // ({e} // greatest(1, CAST(floor(sqrt(count(*))) AS BIGINT))) AS n, {sign} AS sg FROM part" for h, e, sign in (("south", g.EXTENT["south"], -1), ("north", g.EXTENT["north"], 1)))
query("R1_fitted_grids", f"""WITH f AS ({_fit}), c AS (SELECT hemisphere, res, sg, n, CAST(i % n AS INT) AS x, CAST(i // n AS INT) AS y FROM (SELECT *, unnest(range(n * n)) AS i FROM f)),
    p AS (SELECT *, (x - (n - 1) / CAST(2 AS DOUBLE)) * res * CAST(1000 AS DOUBLE) AS px, (y - (n - 1) / CAST(2 AS DOUBLE)) * res * CAST(1000 AS DOUBLE) AS py FROM c)
    SELECT hemisphere, x, y, {q('degrees(atan2(px, -sg * py))')} AS lon, {q(f'sg * (90 - degrees(2 * atan(sqrt(px * px + py * py) / (2 * {g.RADIUS_M}))))')} AS lat FROM p""")(fitted_grids)
SRC = "src AS (SELECT x AS sx, y AS sy, avg(sic) AS sic FROM field WHERE dataset = 'obs1' GROUP BY ALL), tgt AS (SELECT y, x, CAST(x * 0.75 + 0.25 AS DOUBLE) AS px, CAST(y * 0.75 + 0.25 AS DOUBLE) AS py FROM grid)"
src = lambda v: v.field.where("dataset = 'obs1'").groupBy(F.col("x").alias("sx"), F.col("y").alias("sy")).agg(F.avg("sic").alias("sic"))
tgt = lambda v: v.grid.select("y", "x", (F.col("x") * 0.75 + 0.25).alias("px"), (F.col("y") * 0.75 + 0.25).alias("py"))
query("R2_bilinear", f"WITH {SRC}, w AS (SELECT y, x, CAST(floor(px) AS INT) + i AS sx, CAST(floor(py) AS INT) + j AS sy, abs(1 - i - (px - floor(px))) * abs(1 - j - (py - floor(py))) AS w FROM tgt CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(i, j)) SELECT y, x, {q('sum(w * sic) / sum(w)')} AS value FROM w JOIN src USING (sx, sy) WHERE w > 0 GROUP BY ALL")(
    lambda v: rounded(g.bilinear(src(v), tgt(v), "sic"), "y", "x")
)
BOX = f"{SRC}, sb AS (SELECT *, sx + 0.0 AS sx0, sx + 1.0 AS sx1, sy + 0.0 AS sy0, sy + 1.0 AS sy1 FROM src), tb AS (SELECT y, x, px AS tx0, px + 1.5 AS tx1, py AS ty0, py + 1.5 AS ty1 FROM tgt), ov AS (SELECT *, (least(sx1, tx1) - greatest(sx0, tx0)) * (least(sy1, ty1) - greatest(sy0, ty0)) AS w FROM sb JOIN tb ON sx0 < tx1 AND tx0 < sx1 AND sy0 < ty1 AND ty0 < sy1)"


def boxes(v):
    s = src(v).select("*", (F.col("sx") + 0.0).alias("sx0"), (F.col("sx") + 1.0).alias("sx1"), (F.col("sy") + 0.0).alias("sy0"), (F.col("sy") + 1.0).alias("sy1"))
    return s, tgt(v).select("y", "x", F.col("px").alias("tx0"), (F.col("px") + 1.5).alias("tx1"), F.col("py").alias("ty0"), (F.col("py") + 1.5).alias("ty1"))


query("R3_conservative", f"WITH {BOX} SELECT y, x, {q('sum(w * sic) / sum(w)')} AS value FROM ov GROUP BY ALL")(lambda v: rounded(g.conservative(*boxes(v), "sic"), "y", "x"))
query("R3_area_extensive", f"WITH {BOX} SELECT y, x, {q('sum(w * sic * (2 + sx % 3)) / 2.25')} AS value FROM ov GROUP BY ALL")(
    lambda v: g.overlaps(*boxes(v)).groupBy("y", "x").agg(r(F.sum(F.col("overlap") * F.col("sic") * (2 + F.col("sx") % 3)) / 2.25).alias("value"))
)
HAV = "2 * 6378.137 * asin(sqrt(pow(sin(abs(radians(tlat) - radians(slat)) / 2), 2) + cos(radians(tlat)) * cos(radians(slat)) * pow(sin(abs(radians(tlon) - radians(slon)) / 2), 2)))"
query("R4_nearest", f"WITH s AS (SELECT y AS sy, x AS sx, lat AS slat, lon / 5 AS slon, region FROM grid), t AS (SELECT y, x, lat + 0.3 AS tlat, lon / 5 + 0.4 AS tlon FROM grid), n AS (SELECT t.y, t.x, region, round({HAV}, 6) AS d, sy, sx FROM t CROSS JOIN s) SELECT y, x, arg_min(region, (d, sy, sx)) AS value FROM n GROUP BY ALL")(
    lambda v: m.nearest(v.grid.select(F.col("y").alias("sy"), F.col("x").alias("sx"), F.col("lat").alias("slat"), (F.col("lon") / 5).alias("slon"), "region"), v.grid.select("y", "x", (F.col("lat") + 0.3).alias("tlat"), (F.col("lon") / 5 + 0.4).alias("tlon")), "region")
)

# Sources in longitude and latitude: a global field on uneven axes, whose cells meet again at 360 degrees.
LON, LAT = "CAST(45 * x + 3 * (x % 2) AS DOUBLE)", "-80 + 60 * CAST(y AS DOUBLE) / {0} + 36 * CAST(y * y AS DOUBLE) / ({0} * {0})"
SQL_NY = "(SELECT ny FROM dims)"
TARGETS = "tg AS (SELECT y, x, CAST(47.5 * x - 31 AS DOUBLE) AS tlon, -79.5 + 84 * CAST(y AS DOUBLE) / (SELECT ny FROM dims) AS tlat FROM grid)"
source_axes = lambda v: v.field.select("dataset", "time", "x", "y", F.expr(LON).alias("lon"), F.expr(LAT.format(v.ny)).alias("lat"), "sic")
targets = lambda v: v.grid.select("y", "x", F.expr("CAST(47.5 * x - 31 AS DOUBLE)").alias("tlon"), F.expr(f"-79.5 + 84 * CAST(y AS DOUBLE) / {v.ny}").cast("double").alias("tlat"))
query("R2_bilinear_lonlat", f"""WITH s AS (SELECT dataset, time, {LON} AS lon, {LAT.format(SQL_NY)} AS lat, sic FROM field), {TARGETS},
    ax AS (SELECT lon, coalesce(lead(lon) OVER (ORDER BY lon), (SELECT min(lon) FROM s) + 360) AS hi FROM (SELECT DISTINCT lon FROM s)),
    ay AS (SELECT lat, lead(lat) OVER (ORDER BY lat) AS hi, (SELECT max(lat) FROM s) AS top FROM (SELECT DISTINCT lat FROM s)),
    tn AS (SELECT y, x, tlat, tlon - 360 * floor(tlon / 360) AS tlon FROM tg),
    wt AS (SELECT y, x, ax.lon AS x0, ax.hi - 360 * floor(ax.hi / 360) AS x1, ay.lat AS y0, ay.hi AS y1, (tlon - ax.lon) / (ax.hi - ax.lon) AS fx, (tlat - ay.lat) / (ay.hi - ay.lat) AS fy
      FROM tn JOIN ax ON tlon >= ax.lon AND tlon < ax.hi JOIN ay ON tlat >= ay.lat AND (tlat < ay.hi OR (ay.hi = top AND tlat = top)) WHERE ay.hi IS NOT NULL),
    c AS (SELECT y, x, x0 AS lon, y0 AS lat, (1 - fx) * (1 - fy) AS w FROM wt UNION ALL SELECT y, x, x1, y0, fx * (1 - fy) FROM wt UNION ALL SELECT y, x, x0, y1, (1 - fx) * fy FROM wt UNION ALL SELECT y, x, x1, y1, fx * fy FROM wt)
    SELECT dataset, time, c.y, c.x, {q('sum(w * sic) / sum(w)')} AS value FROM c JOIN s ON s.lon = c.lon AND s.lat = c.lat WHERE w > 0 GROUP BY ALL""")(
    lambda v: rounded(m.bilinear_lonlat(source_axes(v), targets(v), "sic", ["y", "x"], ["dataset", "time"]), "dataset", "time", "y", "x")
)
BOXES = {"slon0": "45.0D * x", "slon1": "45.0D * x + 45", "slat0": "-90 + 60.0D * y / {0}", "slat1": "-90 + 60.0D * (y + 1) / {0}"}
AIMS = {"tlon0": "30.0D * x - 20", "tlon1": "30.0D * x + 10 + 60 * (x % 2)", "tlat0": "-88 + 72.0D * y / {0}", "tlat1": "-88 + 72.0D * (y + 1) / {0} + (y % 2) * 0.5D"}
_sql = lambda e: e.replace("0D", "0").replace("5D", "5").format(SQL_NY)
box_source = lambda v: v.field_of_cells.select("dataset", "time", "y", "x", "sic", *(F.expr(e.format(v.ny)).cast("double").alias(k) for k, e in BOXES.items()), (1e6 * (2 + F.col("x") % 3)).alias("s_area"))
box_target = lambda v: v.grid.select(F.col("y").alias("ty"), F.col("x").alias("tx"), *(F.expr(e.format(v.ny)).cast("double").alias(k) for k, e in AIMS.items()), (1e6 * (1 + F.col("y") % 2)).alias("t_area"))
# boxes cross 360 degrees by at most one turn, so three turns of the source meet every target
SPHERE = f"""sb AS (SELECT dataset, time, sic, 1e6 * (2 + x % 3) AS sa, {', '.join(f'CAST({_sql(e)} AS DOUBLE) AS {k}' for k, e in BOXES.items())} FROM field),
    tb AS (SELECT y AS ty, x AS tx, 1e6 * (1 + y % 2) AS ta, {', '.join(f'CAST({_sql(e)} AS DOUBLE) AS {k}' for k, e in AIMS.items())} FROM grid),
    ov AS (SELECT *, radians(least(slon1 + k, tlon1) - greatest(slon0 + k, tlon0)) * (sin(radians(least(slat1, tlat1))) - sin(radians(greatest(slat0, tlat0)))) AS w, radians(slon1 - slon0) * (sin(radians(slat1)) - sin(radians(slat0))) AS a
      FROM sb JOIN (VALUES (-360), (0), (360)) z(k) ON true JOIN tb ON slon0 + k < tlon1 AND tlon0 < slon1 + k AND slat0 < tlat1 AND tlat0 < slat1)"""
query("R3_conservative_lonlat", f"WITH {SPHERE} SELECT dataset, time, ty, tx, {q('sum(w * sic) / sum(w)')} AS value FROM ov GROUP BY ALL")(
    lambda v: rounded(m.conservative_lonlat(box_source(v), box_target(v), "sic", ["ty", "tx"], ["dataset", "time"], ["y", "x"]), "dataset", "time", "ty", "tx")
)
query("R3_area_extensive_lonlat", f"WITH {SPHERE} SELECT dataset, time, ty, tx, {q('sum(w / a * sic * sa) / ta')} AS value FROM ov GROUP BY dataset, time, ty, tx, ta")(
    lambda v: rounded(m.conservative_lonlat(box_source(v), box_target(v), "sic", ["ty", "tx"], ["dataset", "time"], ["y", "x"], ("s_area", "t_area")), "dataset", "time", "ty", "tx")
)
SIDES = ["x % 3 + 2.0", "y % 2 + 3.0", "x % 2 + 2.5", "y % 3 + 3.5"]
query("R5_quadrilateral_area", f"WITH s AS (SELECT y, x, {', '.join(f'CAST({e} AS DOUBLE) AS s{i}' for i, e in enumerate(SIDES))} FROM grid), h AS (SELECT *, (s0 + s1 + s2 + s3) / 2 AS h FROM s) SELECT y, x, {q('sqrt(greatest(0, (h - s0) * (h - s1) * (h - s2) * (h - s3)))')} AS area FROM h")(
    lambda v: v.grid.select("y", "x", r(g.quadrilateral_area([F.expr(e.format(v.ny)).cast("double") for e in SIDES])).alias("area"))
)
query("R6_rectilinear_area", f"SELECT y, x, {q(f'pow({g.SOURCE_RADIUS_M}, 2) * radians(5.0) * abs(sin(radians(lat + 1)) - sin(radians(lat - 1))) / 1e6', 3)} AS area FROM grid")(
    lambda v: v.grid.select("y", "x", r(g.rectilinear_area(F.lit(5.0), F.col("lat") - 1, F.col("lat") + 1) / 1e6, 3).alias("area"))
)
_gr = lambda c, w: f"CASE WHEN lag({c}) OVER {w} IS NULL THEN lead({c}) OVER {w} - {c} WHEN lead({c}) OVER {w} IS NULL THEN {c} - lag({c}) OVER {w} ELSE (lead({c}) OVER {w} - lag({c}) OVER {w}) / 2 END"
query("R7_curvilinear_area", f"WITH k AS (SELECT y, x, lon + 0.1 * y AS lon, lat + 0.05 * x AS lat FROM grid), d AS (SELECT y, x, lat, {_gr('lon', 'wx')} AS lx, {_gr('lat', 'wy')} AS ly, {_gr('lon', 'wy')} AS mx, {_gr('lat', 'wx')} AS my FROM k WINDOW wx AS (PARTITION BY y ORDER BY x), wy AS (PARTITION BY x ORDER BY y)) SELECT y, x, {q(f'pow({g.SOURCE_RADIUS_M}, 2) * cos(radians(lat)) * abs(radians(lx) * radians(ly) - radians(mx) * radians(my)) / 1e6', 3)} AS area FROM d")(
    lambda v: g.curvilinear_area(v.grid.select("y", "x", (F.col("lon") + 0.1 * F.col("y")).alias("lon"), (F.col("lat") + 0.05 * F.col("x")).alias("lat"))).select("y", "x", r(F.col("area") / 1e6, 3).alias("area"))
)
query("R8_clean_area", "SELECT p_partkey, CASE WHEN a > 0 AND a <= 1e19 THEN a END AS area FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(-1 AS DOUBLE) WHEN 1 THEN CAST(1e20 AS DOUBLE) ELSE CAST(p_size AS DOUBLE) END AS a FROM part)")(
    lambda v: v.table("part").select("p_partkey", g.clean_area(F.when(F.col("p_partkey") % 3 == 0, -1.0).when(F.col("p_partkey") % 3 == 1, 1e20).otherwise(F.col("p_size").cast("double"))).alias("area"))
)
UV = "SELECT dataset, time, y, x, {} FROM fieldg"
query("R10_rotate", UV.format(f"{q('u * cos(radians(lon)) - v * sin(radians(lon))')} AS u, {q('u * sin(radians(lon)) + v * cos(radians(lon))')} AS v"))(
    lambda v: (lambda f: (lambda a: f.select("dataset", "time", "y", "x", r(a[0]).alias("u"), r(a[1]).alias("v")))(g.rotate(F.col("u"), F.col("v"), F.col("lon"))))(g.in_radians(v.field_grid, "lon"))
)
query("R11_to_projection", UV.format(f"{q('u * cos(radians(lon)) + v * sin(radians(lon))')} AS u, {q('v * cos(radians(lon)) - u * sin(radians(lon))')} AS v"))(
    lambda v: (lambda a: v.field_grid.select("dataset", "time", "y", "x", r(a[0]).alias("u"), r(a[1]).alias("v")))(g.to_projection(F.col("u"), F.col("v"), F.col("lon"), "south"))
)
_turn = lambda d: f"((({d}) + 180) - 360 * floor((({d}) + 180) / 360) - 180)"
BASIS = f"""k AS (SELECT y, x, lon + 3 * y AS lon, lat + 0.5 * x AS lat FROM grid), j AS (SELECT a.y, a.x, {_turn('b.lon - a.lon')} * cos(radians(a.lat)) AS e1, b.lat - a.lat AS n1, {_turn('c.lon - a.lon')} * cos(radians(a.lat)) AS e2, c.lat - a.lat AS n2
 FROM k a JOIN k b ON b.y = a.y AND b.x = (a.x + 1) % 8 JOIN k c ON c.x = a.x AND c.y = a.y + 1), ba AS (SELECT y, x, e1 / sqrt(e1 * e1 + n1 * n1) AS xe, n1 / sqrt(e1 * e1 + n1 * n1) AS xn, e2 / sqrt(e2 * e2 + n2 * n2) AS ye, n2 / sqrt(e2 * e2 + n2 * n2) AS yn FROM j)"""
basis = lambda v: g.native_basis(v.grid.select("y", "x", (F.col("lon") + 3 * F.col("y")).alias("lon"), (F.col("lat") + 0.5 * F.col("x")).alias("lat")), 8)
query("R12_native_basis", f"WITH {BASIS} SELECT y, x, {', '.join(f'{q(c)} AS {c}' for c in ('xe', 'xn', 'ye', 'yn'))}, {q('xe * ye + xn * yn')} AS dot FROM ba")(lambda v: rounded(basis(v), "y", "x"))
query("R12_basis_quality", f"WITH {BASIS} SELECT {q('avg(abs(xe * ye + xn * yn))')} AS mean_dot, {q('avg(xe * yn - xn * ye)')} AS mean_cross, count(*) AS n FROM ba")(
    lambda v: basis(v).agg(r(F.avg(F.abs("dot"))).alias("mean_dot"), r(F.avg(F.col("xe") * F.col("yn") - F.col("xn") * F.col("ye"))).alias("mean_cross"), F.count("*").alias("n"))
)
query("R13_to_east_north", f"WITH {BASIS} SELECT dataset, time, y, x, {q('u * xe + v * ye')} AS u, {q('u * xn + v * yn')} AS v FROM field JOIN ba USING (y, x)")(
    lambda v: (lambda a: v.field.join(basis(v), ["y", "x"]).select("dataset", "time", "y", "x", r(a[0]).alias("u"), r(a[1]).alias("v")))(g.to_east_north(F.col("u"), F.col("v")))
)
FRAME = "CASE WHEN req IN ('xy', 'lonlat', 'other') THEN req WHEN dec IN ('xy', 'lonlat') THEN dec WHEN angle IS NOT NULL THEN 'xy' ELSE 'lonlat' END"
query("R14_source_frame", f"WITH s AS (SELECT s_suppkey, ['auto', 'xy', 'lonlat', 'other'][CAST(s_suppkey % 4 AS INT) + 1] AS req, ['none', 'xy', 'lonlat'][CAST(s_suppkey % 3 AS INT) + 1] AS dec, CASE WHEN s_suppkey % 5 = 0 THEN 1 END AS angle FROM supplier) SELECT s_suppkey, req AS request, {FRAME} AS frame FROM s")(
    lambda v: (lambda s: s.select("s_suppkey", F.col("req").alias("request"), g.source_frame(F.col("req"), F.col("dec"), F.col("angle")).alias("frame")))(
        v.table("supplier").select("s_suppkey", F.element_at(F.array(*map(F.lit, ("auto", "xy", "lonlat", "other"))), (F.col("s_suppkey") % 4).cast("int") + 1).alias("req"), F.element_at(F.array(*map(F.lit, ("none", "xy", "lonlat"))), (F.col("s_suppkey") % 3).cast("int") + 1).alias("dec"), F.when(F.col("s_suppkey") % 5 == 0, 1).alias("angle"))
    )
)
query("R15_drift_preparation", f"WITH {BASIS}, m AS (SELECT dataset, CAST(date_trunc('month', time) AS DATE) AS time, y, x, avg(u) AS u, avg(v) AS v FROM daily GROUP BY ALL), e AS (SELECT dataset, time, y, x, u * xe + v * ye AS u, u * xn + v * yn AS v FROM m JOIN ba USING (y, x)) SELECT dataset, time, y, x, {q('u * cos(radians(lon)) + v * sin(radians(lon))')} AS u, {q('v * cos(radians(lon)) - u * sin(radians(lon))')} AS v FROM e JOIN grid USING (y, x)")(
    lambda v: prepared(v)
)


def prepared(v):
    """Monthly mean, east/north, projection."""
    m = v.daily.groupBy("dataset", F.trunc("time", "month").alias("time"), "y", "x").agg(F.avg("u").alias("u"), F.avg("v").alias("v"))
    e, n = g.to_east_north(F.col("u"), F.col("v"))
    m = m.join(basis(v), ["y", "x"]).select("dataset", "time", "y", "x", e.alias("u"), n.alias("v")).join(v.grid, ["y", "x"])
    a, b = g.to_projection(F.col("u"), F.col("v"), F.col("lon"), "south")
    return m.select("dataset", "time", "y", "x", r(a).alias("u"), r(b).alias("v"))
