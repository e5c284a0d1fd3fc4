"""Hand-computed cases, worked examples and invariants."""

import datetime as dt
import math
import struct
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from nilas.functions.stats import METRICS, metric, regression, student_p
from nilas.operators import align, budget, clean, climatology, domains, integrals, regrid, remap, skill, tables, transition, trends
from nilas.sources import files, store


def one(df):
    return df.first()[0]


def field(spark, rows, schema="dataset string, yr int, mo int, y int, x int, value double"):
    return spark.createDataFrame(rows, schema)


def test_student_p_table_values(spark):
    for df, t in ((1, 12.706), (2, 4.303), (3, 3.182), (4, 2.776), (5, 2.571), (10, 2.228), (15, 2.131), (60, 2.000)):
        r = t / math.sqrt(t * t + df)
        assert one(spark.range(1).select(student_p(F.lit(r), F.lit(df + 2)))) == pytest.approx(0.05, abs=1e-4)
    assert one(spark.range(1).select(student_p(F.lit(0.5), F.lit(2)))) is None
    assert one(spark.range(1).select(student_p(F.lit(1.0), F.lit(9)))) == 0


def test_weighted_rmse_by_hand(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 4.0, 3.0), (None, 1.0, 5.0)], "x double, y double, w double")
    got = df.agg(*(METRICS[m](F.col("y"), F.col("x"), F.col("w")).alias(m) for m in ("bias", "mae", "rmse"))).first()
    assert got["bias"] == 1.75 and got["mae"] == 1.75 and got["rmse"] == pytest.approx(math.sqrt(13 / 4))
    assert one(df.agg(metric("bias", F.col("y"), F.col("x"), mask=F.col("x") > 1))) == 2.0


def test_detrended_deviation_is_the_residuals(spark):
    ys = [1.0, 3.0, 2.0, 5.0, 4.0]
    reg = spark.createDataFrame(list(enumerate(ys)), "x int, y double").agg(regression("y", "x").alias("r")).first()["r"]
    rest = [y - (reg["intercept"] + reg["slope"] * i) for i, y in enumerate(ys)]
    assert reg["rest"] == pytest.approx(math.sqrt(sum(v * v for v in rest) / 5))


def test_constant_series_has_no_correlation(spark):
    reg = spark.createDataFrame([(i, 2.0) for i in range(5)], "x int, y double").agg(regression("y", "x").alias("r")).first()["r"]
    assert reg["r"] is None and reg["slope"] == 0


def test_mean_filter_shrinks_at_the_edge(spark):
    rows = [("a", 0, y, x, float(y * 4 + x)) for y in range(3) for x in range(4)]
    out = budget.mean_filter(spark.createDataFrame(rows, "dataset string, time int, y int, x int, u double"), ["u"])
    got = {(r.y, r.x): r.u_mean for r in out.collect()}
    assert got[0, 0] == (0 + 1 + 4 + 5) / 4 and got[1, 1] == 5.0 and got[2, 3] == (6 + 7 + 10 + 11) / 4


def test_no_ice_is_zero_extent_and_no_cell_no_volume(spark):
    df = spark.createDataFrame([(1, None, 1e9), (1, 15.0, 1e9), (2, 90.0, 2e12), (2, 15.1, 1e12)], "time int, sic double, cell_area double")
    got = {r.time: r for r in climatology.area_series(df, ["time"]).collect()}
    assert got[1]["extent"] == 0 and got[2]["extent"] == 3.0 and got[2]["pack"] == 2.0 and got[2]["marginal"] == 1.0
    assert one(df.select(F.lit(None).cast("double").alias("h"), "cell_area").agg(integrals.volume(F.col("h"), F.col("cell_area")))) is None


def test_edge_error_counts_exactly_fifteen_and_missing(spark):
    df = spark.createDataFrame([(1, 15.0, None, 1e12), (1, None, 20.0, 2e12), (1, 14.9, 14.9, 4e12)], "k int, o double, m double, a double")
    r = skill.edge_error(df, "o", "m", "a", ["k"]).first()
    assert (r["over"], r["under"], r["total"], r["net"]) == (2.0, 1.0, 3.0, 1.0)


def test_december_only_has_no_season_and_belongs_to_next_year(spark):
    df = field(spark, [("a", 1999, 12, 0, 0, 1.0), ("a", 2000, 12, 0, 0, 2.0), ("a", 2001, 1, 0, 0, 5.0)])
    got = climatology.season_mean(df, "value", ["dataset"]).collect()
    assert [(r.season, r.season_year, r.value) for r in got] == [("DJF", 2001, 3.5)]


def test_anomalies_average_to_zero(spark):
    df = field(spark, [("a", 2000 + i, 1 + j, 0, 0, float(i * i + j)) for i in range(4) for j in range(3)])
    means = climatology.anomaly(df, "value").groupBy("mo").agg(F.avg("anomaly").alias("m")).collect()
    assert all(abs(r.m) < 1e-12 for r in means)


def test_season_map_counts_a_missing_month_as_zero(spark):
    clim = spark.createDataFrame([("a", 0, 0, 3, 92.0), ("a", 0, 0, 4, None)], "dataset string, y int, x int, mo int, value double")
    assert climatology.season_map(clim).first()["value"] == 31.0


def daily(spark, values):
    rows = [("a", dt.date(2001, 3, 1) + dt.timedelta(days=i), 2001 + (i > 305), (dt.date(2001, 3, 1) + dt.timedelta(days=i)).month, 0, 0, float(v) if v is not None else None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "dataset string, time date, yr int, mo int, y int, x int, sic double")


def test_advance_is_first_and_retreat_last_crossing(spark):
    values = [0] * 40 + [100] * 50 + [0] * 40 + [100] * 100 + [0] * 70
    got = transition.dates(transition.crossings(transition.smooth(transition.cycles(daily(spark, values)), window=1)), control=False).first()
    assert (got.advance, got.retreat) == (40, 230)


def test_dates_need_persistence_and_no_gaps(spark):
    short = [0] * 40 + [100] * 5 + [0] * 100
    assert transition.dates(transition.crossings(transition.smooth(transition.cycles(daily(spark, short)), window=1)), control=False).first().advance is None
    gap = [0] * 40 + [100] * 3 + [None] + [100] * 60
    assert transition.dates(transition.crossings(transition.smooth(transition.cycles(daily(spark, gap)), window=1)), control=False).first().advance is None


def test_running_mean_repeats_the_edges(spark):
    got = {r.t: r.smooth for r in transition.smooth(transition.cycles(daily(spark, [0, 3, 6, 9])), window=3).collect()}
    assert got == {0: 1.0, 1: 3.0, 2: 6.0, 3: 8.0}


def test_equal_vectors_correlate_fully_and_ten_samples_do_not(spark):
    rows = [(0, math.sin(i), math.cos(2.3 * i)) for i in range(12)] + [(1, math.sin(i), math.cos(2.3 * i)) for i in range(10)]
    df = spark.createDataFrame(rows, "k int, u1 double, v1 double").withColumns({"u2": F.col("u1"), "v2": F.col("v1")})
    got = {r.k: r.value for r in skill.vector_correlation(df, ["k"]).collect()}
    assert got[0] == pytest.approx(1.0) and got[1] is None


def test_budget_terms_add_up(spark):
    from nilas.sources.views import Views

    v = Views(spark, "/root/testdata/sf0.001")
    out = budget.daily_budget(v.daily.where("dataset = 'obs1' AND i < 40"), v.grid).where("res IS NOT NULL")
    assert out.where("abs(adv + div + res - dadt) > 1e-9").count() == 0 and out.count() > 0


def test_rotation_keeps_speed_and_remap_keeps_constants(spark):
    df = spark.createDataFrame([(0.3, -0.4, 1.1)], "u double, v double, a double")
    u, v = regrid.rotate(F.col("u"), F.col("v"), F.col("a"))
    assert one(df.select(F.sqrt(u * u + v * v))) == pytest.approx(0.5)
    source = spark.createDataFrame([(x, y, 7.0) for x in range(4) for y in range(4)], "sx int, sy int, value double")
    target = spark.createDataFrame([(0, 0, 1.3, 1.9), (0, 1, 3.5, 0.5)], "y int, x int, px double, py double")
    assert {r.value for r in regrid.bilinear(source, target, "value").collect()} == {7.0}


def test_polar_grid_is_symmetric_around_the_pole(spark):
    g = regrid.polar_grid(spark, 1400).collect()
    assert len(g) == 36 and max(r.lat for r in g) < 0 and min(r.lat for r in g) == pytest.approx(-81.1, abs=0.5)
    lats = {(r.x, r.y): r.lat for r in g}
    assert lats[0, 0] == pytest.approx(lats[5, 5])


def test_missing_values_become_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1e20,), (-9999.0,), (255.0,), (0.0,), (3.0,)], "v double")
    assert [r[0] for r in df.select(clean.missing_to_null(F.col("v"))).collect()] == [None, None, None, None, 0.0, 3.0]


def test_percent_only_where_small(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 1.2), ("b", 50.0)], "dataset string, v double")
    assert sorted((r.dataset, r.v) for r in clean.percent(df, "v").where("v IS NOT NULL").collect()) == [("a", 50.0), ("b", 50.0)]


def test_raw_cubes_round_trip(spark, tmp_path):
    values = [float(i) for i in range(12 * 2 * 3)]
    values[5] = float("nan")
    (tmp_path / "ice_1999.bin").write_bytes(struct.pack(f"<{len(values)}f", *values))
    got = {(r.month, r.x, r.y): (r.year, r.value) for r in files.read_raw_cubes(spark, str(tmp_path), ny=3, nx=2).collect()}
    assert len(got) == 72 and got[1, 1, 2] == (1999, None) and got[2, 0, 1] == (1999, 7.0)


def test_group_mean_needs_all_members(spark):
    rows = spark.createDataFrame([("m1", 1, 2.0), ("m2", 1, 4.0), ("m1", 2, 8.0)], "dataset string, k int, v double")
    members = spark.createDataFrame([("g", "m1"), ("g", "m2")], "`group` string, member string")
    assert [(r.k, r.value) for r in tables.group_stat(rows, members, ["k"], "v").collect()] == [(1, 3.0)]


def test_leave_one_out_matches_direct(spark):
    pts = [(i, float(i), float(i * i % 7)) for i in range(8)]

    def corr(ps):
        n, mx, my = len(ps), sum(p[1] for p in ps) / len(ps), sum(p[2] for p in ps) / len(ps)
        return sum((p[1] - mx) * (p[2] - my) for p in ps) / math.sqrt(sum((p[1] - mx) ** 2 for p in ps) * sum((p[2] - my) ** 2 for p in ps)) if n else 0

    deltas = {p[0]: corr([q for q in pts if q != p]) - corr(pts) for p in pts}
    got = tables.leave_one_out(spark.createDataFrame(pts, "id int, x double, y double")).first()
    best = max(deltas, key=lambda k: (abs(deltas[k]), k))
    assert got.id == best and got.delta == pytest.approx(deltas[best])


def test_empty_table_gives_no_rows(spark):
    empty = field(spark, [])
    assert climatology.climatology(empty, "value").count() == 0
    assert trends.series_trend(empty.withColumn("i", F.col("yr")), "value", "i", ["dataset"]).count() == 0
    assert align.by_month(empty, ["value"]).count() == 0


def test_a_missing_day_makes_no_neighbours(spark):
    rows = [("a", 0, 0, i, float(i * i)) for i in range(10) if i != 4]
    df = spark.createDataFrame(rows, "dataset string, y int, x int, i int, v double")
    got = {r.i: (r.t, r.m) for r in df.select("i", budget.tendency("v").alias("t"), budget.running_mean("v").alias("m")).collect()}
    assert got[2] == (4.0, pytest.approx(14 / 3)) and got[3] == (None, None) and got[5] == (None, None) and got[6] == (12.0, pytest.approx(110 / 3)) and got[0] == (None, None)


def test_a_missing_day_stops_smoothing_and_crossings(spark):
    values = [0.0] * 40 + [100.0] * 60
    df = daily(spark, values)
    hole = df.where(F.datediff("time", F.lit(df.agg(F.min("time")).first()[0])) != 45)
    got = {r.t: r.smooth for r in transition.smooth(transition.cycles(hole), window=3).collect()}
    assert 45 not in got and got[44] is None and got[46] is None and got[43] == 100.0 and len(got) == 99
    whole = transition.dates(transition.crossings(transition.smooth(transition.cycles(df), window=1)), control=False).first()
    cut = transition.dates(transition.crossings(transition.smooth(transition.cycles(hole), window=1)), control=False).first()
    assert whole.advance == 40 and cut.advance is None


def test_missing_cells_have_no_gradient_and_no_part_in_means(spark):
    cells = [(x, y) for x in range(4) for y in range(3) if (x, y) != (1, 1)]
    df = spark.createDataFrame([("a", 0, x, y, float(10 * x + y), float(x)) for x, y in cells], "dataset string, time int, x int, y int, v double, h double")
    g = {(r.x, r.y): r.g for r in df.select("x", "y", budget.gradient("v", "h", "x").alias("g")).collect()}
    assert g[1, 0] == 10.0 and g[2, 1] is None and g[0, 1] is None and (1, 1) not in g
    m = {(r.x, r.y): r.v_mean for r in budget.mean_filter(df, ["v"]).collect()}
    assert m.keys() == set(cells)
    for x, y in cells:
        near = [10 * a + b for a, b in cells if abs(a - x) <= 1 and abs(b - y) <= 1]
        assert m[x, y] == pytest.approx(sum(near) / len(near))


def test_nearest_crosses_the_date_line_and_the_pole(spark):
    source = spark.createDataFrame([(0, 0, 179.9, 10.0, 1), (0, 1, 170.0, 10.0, 2), (1, 0, 90.0, 89.5, 3), (1, 1, -90.0, 88.0, 4), (2, 0, 0.0, -60.0, 5)], "sy int, sx int, slon double, slat double, v int")
    target = spark.createDataFrame([(0, 0, -179.9, 10.0), (0, 1, -90.0, 89.9), (0, 2, 100.0, -20.0), (0, 3, 359.0, -61.0)], "y int, x int, tlon double, tlat double")
    assert {r.x: r.value for r in remap.nearest(source, target, "v").collect()} == {0: 1, 1: 3, 2: 2, 3: 5}


def test_percentile_by_counting(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    sets = {f"d{k}": np.round(np.concatenate([rng.uniform(0, 1.4, 100 - k), rng.uniform(1.4, 3.0, k)]), 3) for k in range(6)}
    df = spark.createDataFrame([(d, i, float(v)) for d, x in sets.items() for i, v in enumerate(x)], "dataset string, i int, v double")
    got = {r.dataset: r.m for r in clean.percent_by_quantile(df, "v").groupBy("dataset").agg(F.max("v").alias("m")).collect()}
    for d, x in sets.items():
        assert got[d] == pytest.approx(x.max() * (100 if np.percentile(x, 99) <= 1.5 else 1))


def test_membership_by_label_and_position(spark):
    models = spark.createDataFrame([(1, "Alpha"), (2, "beta"), (3, "3x"), (4, "2")], "position int, label string")
    entries = spark.createDataFrame([("g", "alpha "), ("g", "1"), ("g", "3"), ("g", "9"), ("h", "2"), ("h", "none")], "group string, member string")
    assert sorted(map(tuple, align.membership(entries, models).collect())) == [("g", "3x"), ("g", "Alpha"), ("h", "2")]  # a label wins over a position


def test_incomplete_members_are_dropped_or_an_error(spark):
    rows = [(m, t, 2000, k) for m in "ab" for t in ("u", "v") for k in range(1, 13) if not (m == "b" and t == "v" and k > 11)]
    df = spark.createDataFrame(rows, "member string, term string, yr int, mo int")
    kept = lambda **k: {r.member for r in align.complete_members(df, "member", "term", ["u", "v"], **k).collect()}
    assert kept() == {"a", "b"} and kept(first=2000, last=2000) == {"a"} and kept(first=2000, last=2000, least=11) == {"a", "b"} and kept(first=1999, last=2000) == set()
    with pytest.raises(ValueError, match="1 members"):
        kept(first=2000, last=2000, allow_incomplete=False)


def test_standard_error_and_relation_by_hand(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (3.0, 5.0), (4.0, 4.0)], "x double, y double")
    r = df.agg(regression("y", "x").alias("r"), *(c.alias(n) for n, c in transition.relation(F.col("y"), F.col("x")).items())).first()
    assert r.r.slope == pytest.approx(0.8) and r.r.stderr == pytest.approx(0.4242640687) and r.r2 == pytest.approx(0.64) and r.p == pytest.approx(0.2)


def test_permutation_p_matches_numpy(spark):
    import numpy as np

    points = [(i, float(i % 5), float((i * 7) % 11)) for i in range(9)]
    df = spark.createDataFrame(points, "id int, x double, y double")
    got = tables.permutation_p(df, draws=60).first()
    key = lambda d, k: (f := (69621 * d + 16807 * k + 1) % 2147483647, s := (f * f + 48271 * d + k) % 2147483647, (s * s + 16807 * f) % 2147483647)[2]
    x, y = (np.array([p[k] for p in points]) for k in (1, 2))
    observed = abs(np.corrcoef(x, y)[0, 1])
    hits = sum(abs(np.corrcoef(x, y[sorted(range(9), key=lambda k: key(d, k + 1))])[0, 1]) >= observed - 1e-12 for d in range(1, 61))
    assert got.r == pytest.approx(observed) and got.p == pytest.approx((hits + 1) / 61)


def test_domain_statistics_by_hand(spark):
    rows = [("a", y, m, 0, 0, float(m + 12 * (y - 2000) + (5 if m == 3 else 0))) for y in (2000, 2001, 2002) for m in range(1, 13) if (y, m) != (2001, 1)]
    df = field(spark, rows).withColumnRenamed("value", "v")
    got = {r.domain: r for r in domains.series_statistics(df, ["v"], ["dataset"]).collect()}
    assert got["month 3"].v_mean == 20.0 and got["month 3"].v_trend == pytest.approx(120.0) and got["month 3"].v_std == pytest.approx((96) ** 0.5)
    assert got["month 1"].v_mean == pytest.approx((1 + 25) / 2) and len(got) == 17
    own = {(r.domain, r.t) for r in domains.samples(df, ["v"], ["dataset"]).where("v IS NOT NULL").collect()}
    assert ("DJF", 2001) in own and ("DJF", 2003) not in own  # December 2002 alone is no season


def test_month_lags_skip_missing_months(spark):
    df = spark.createDataFrame([("a", 2000, 11, 1.0), ("a", 2000, 12, 2.0), ("a", 2001, 2, 4.0)], "dataset string, yr int, mo int, v double")
    assert [(r.mo, r.lag_1) for r in climatology.lagged(df, "v", ["dataset"]).orderBy("yr", "mo").collect()] == [(11, None), (12, 1.0), (2, None)]


def test_budget_shuffles_the_field_few_times(spark):
    from nilas.sources.views import Views

    v = Views(spark, "/root/testdata/sf0.001")
    daily = v.daily.where("i < 5").select("dataset", "time", "yr", "mo", "i", "x", "y", "sic", "u", "v")
    plan = budget.daily_budget(daily, v.grid)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(dataset") <= 3


def test_queries_that_write_run_without_a_shared_folder_set():
    """A session of its own that sets no spark.checkpoint.dir: it can't be set in a running one."""
    code = (
        "import os, sys; os.environ['SPARK_CONF_DIR'] = __import__('tempfile').mkdtemp(prefix='spark-'); sys.path.insert(0, sys.argv[1])\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '2').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "assert not spark.conf.get('spark.checkpoint.dir', None)\n"
        "import __spark_entry__\n"
        "print('ROWS', __spark_entry__.queries()['S11_metric_store'](spark, sys.argv[2]).count())\n"
        "from nilas.sources.files import shared_folder\n"
        "assert shared_folder(spark) == shared_folder(spark)\n"
    )
    root = Path(__file__).resolve().parents[1]
    done = subprocess.run([sys.executable, "-c", code, str(root), "/root/testdata/sf0.001"], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and int(done.stdout.rsplit("ROWS ", 1)[1].split()[0]) > 0, done.stderr[-2000:]


def test_nearest_is_the_nearest_wherever_cells_are(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    spots = [(k, 0, float(rng.uniform(-180, 360)), float(rng.choice([rng.uniform(-90, 90), rng.normal(70, 0.2)])), k) for k in range(60)]
    aims = [(0, k, float(rng.uniform(-180, 360)), float(rng.uniform(-90, 90))) for k in range(80)]
    source, target = spark.createDataFrame(spots, "sy int, sx int, slon double, slat double, v int"), spark.createDataFrame(aims, "y int, x int, tlon double, tlat double")

    def vector(lon, lat):
        a, b = math.radians(lat), math.radians(lon)
        return np.array([math.cos(a) * math.cos(b), math.cos(a) * math.sin(b), math.sin(a)])

    want = {k: min(spots, key=lambda s: -float(vector(lon, lat) @ vector(s[2], s[3])))[4] for _, k, lon, lat in aims}
    for reach in (0.5, 2.0, 40.0):
        found = remap.nearest(source, target, "v", reach)
        assert {r.x: r.value for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 3  # sources twice, targets once, however many levels


def test_nearest_meets_few_sources_on_dense_lines(spark):
    """Eight lines of ever denser cells, the targets far beside them: candidates follow the targets, not their square; equal distances go by (sy, sx)."""
    for rows in (100, 800):
        source = spark.range(8 * rows).selectExpr("CAST(id AS INT) AS k", "CAST(id DIV 8 AS INT) AS sy", "CAST(id % 8 AS INT) AS sx").selectExpr("*", f"65 + 12D * sy / {rows} AS slat", "CAST(sx AS DOUBLE) AS slon")
        target = source.selectExpr("sy AS y", "sx AS x", "slat + 0.3 AS tlat", "slon + 0.4 AS tlon")
        assert remap.nearest_candidates(source, target, "k").count() <= 80 * 8 * rows
    aims = target.where("y % 80 = 3")
    d = F.round(budget.haversine(F.col("tlat"), F.col("tlon"), F.col("slat"), F.col("slon")), 6)
    want = aims.crossJoin(source).groupBy("y", "x").agg(F.min_by("k", F.struct(d, "sy", "sx")).alias("value"))
    assert {tuple(r) for r in remap.nearest(source, aims, "k").collect()} == {tuple(r) for r in want.collect()}
    twins = spark.createDataFrame([(1, 0, 10.0, 0.0, 1), (0, 1, 10.0, 0.0, 2), (0, 0, -10.0, 0.0, 3)], "sy int, sx int, slon double, slat double, k int")
    assert [r.value for r in remap.nearest(twins, spark.createDataFrame([(0, 0, 0.0, 0.0)], "y int, x int, tlon double, tlat double"), "k").collect()] == [3]


def test_bilinear_from_axes_over_the_date_line(spark):
    lons, lats = [10.0, 100.0, 190.0, 280.0], [-50.0, 0.0, 40.0]
    rows = [(lon, lat, float(lat + lon / 10)) for lon in lons for lat in lats]
    source = spark.createDataFrame([("t", *r) for r in rows], "time string, lon double, lat double, v double")
    aims = {0: (325.0, 20.0), 1: (-35.0, 20.0), 2: (10.0, 40.0), 3: (55.0, -50.0), 4: (55.0, 41.0), 5: (370.0, 0.0), 6: (280.0, -25.0)}
    target = spark.createDataFrame([(k, *v) for k, v in aims.items()], "k int, tlon double, tlat double")
    got = {r.k: r.value for r in remap.bilinear_lonlat(source, target, "v", ["k"], ["time"]).collect()}
    half = 20 + (28 + 1) / 2  # between 280 and 370 degrees
    assert got == pytest.approx({0: half, 1: half, 2: 41.0, 3: -50 + 5.5, 5: 1.0, 6: -25 + 28})
    # a missing corner leaves the others their weights; a regional axis doesn't wrap
    gaps = source.withColumn("v", F.when(~((F.col("lon") == 280) & (F.col("lat") == 0)), F.col("v")))
    assert one(remap.bilinear_lonlat(gaps, target.where("k = 6"), "v", ["k"], ["time"]).select("value")) == pytest.approx(-50 + 28)
    regional = source.where("lon < 200")
    assert {r.k for r in remap.bilinear_lonlat(regional, target, "v", ["k"], ["time"]).collect()} == {2, 3, 5}


def test_conservative_remap_keeps_the_total(spark):
    boxes = [(k, w, e, s, n) for k, (w, e, s, n) in enumerate([(0, 360, -90, -60), (-20, 20, -60, 90), (20, 200, -60, 0), (20, 200, 0, 90), (200, 340, -60, 89.75), (200, 340, 89.75, 90)])]
    source = spark.createDataFrame([(k, *map(float, b), float(k + 1), 1e6 * (k + 2)) for k, *b in boxes], "k int, slon0 double, slon1 double, slat0 double, slat1 double, v double, a double")
    aims = [(i * 100 + j, i * 15.0 - 7, i * 15.0 + 8, j * 10.0 - 90, j * 10.0 - 80, 2e5 + i) for i in range(24) for j in range(18)]
    target = spark.createDataFrame(aims, "t int, tlon0 double, tlon1 double, tlat0 double, tlat1 double, ta double")
    out = remap.conservative_lonlat(source.withColumn("f", F.lit(1)), target, "v", ["t"], ["f"], ["k"], ("a", "ta"))
    total = one(out.join(target, "t").agg(F.sum(F.col("value") * F.col("ta"))))
    assert total == pytest.approx(sum((k + 1) * 1e6 * (k + 2) for k, *_ in boxes), rel=1e-9)
    covered = remap.lonlat_overlaps(source, target).agg(F.sum("overlap"))
    assert one(covered) == pytest.approx(4 * math.pi, rel=1e-9)
    # means lie between the values, and a large box touches few bins
    means = {r.t: r.value for r in remap.conservative_lonlat(source.withColumn("f", F.lit(1)), target, "v", ["t"], ["f"], ["k"]).collect()}
    assert len(means) == len(aims) and means[0] == pytest.approx(1.0) and 1 <= min(means.values()) <= max(means.values()) <= 6
    binned = remap._binned(remap._pieces(source, "s"), "s", spark.sql("SELECT array(4) AS _levels"))
    assert binned.groupBy("k", "_level").count().agg(F.max("count")).first()[0] <= 8 * 2


def test_flat_boxes_meet_those_beside_them(spark):
    """45 degrees wide and ever flatter boxes, targets of two heights: candidates follow the overlaps, not all pairs of a wide bin."""
    for rows in (64, 512):
        source = spark.range(8 * rows).selectExpr("CAST(id AS INT) AS k", "45D * (id % 8) AS slon0", "45D * (id % 8) + 45 AS slon1", f"-60 + 60D * (id DIV 8) / {rows} AS slat0", f"-60 + 60D * (id DIV 8 + 1) / {rows} AS slat1")
        target = spark.range(8 * rows).selectExpr("CAST(id AS INT) AS t", "30D * (id % 8) - 20 AS tlon0", "30D * (id % 8) + 10 AS tlon1", f"-60 + 60D * (id DIV 8) / {rows} AS tlat0", f"-60 + 60D * (id DIV 8 + 1) / {rows} + (id DIV 8) % 2 * 0.5D AS tlat1")
        found = remap.lonlat_overlaps(source, target).count()
        assert remap.overlap_candidates(source, target).count() <= 20 * found
        plain = source.crossJoin(target.select("t", "tlat0", "tlat1", F.explode(F.array(*(F.struct((F.col("tlon0") + k).alias("a"), (F.col("tlon1") + k).alias("b")) for k in (0, 360)))).alias("c")))
        assert found == plain.where("slon0 < c.b AND c.a < slon1 AND slat0 < tlat1 AND tlat0 < slat1").count()


def test_conservative_remap_is_that_of_all_pairs(spark, monkeypatch):
    """Boxes from the globe to thousandths of a degree, over the date line, with several boxes a key, repeated, missing and infinite values; tiles, lists and batches are cut often."""
    import numpy as np

    rng = np.random.default_rng(5)
    monkeypatch.setattr(remap, "PLACES", 5)
    monkeypatch.setattr(remap, "LOT", 4)
    monkeypatch.setattr(remap, "SERIES", 3)

    def boxes(n):
        w, h = (10 ** rng.uniform(-3, top, n) for top in (2.56, 2.2))
        lon, lat = rng.uniform(-200, 400, n), rng.uniform(-90, 90, n)
        near = rng.random(n) < 0.6  # small ones lie together
        lon, lat = np.where(near, rng.uniform(359.7, 360.2, n), lon), np.where(near, rng.uniform(10, 10.5, n), lat)
        return np.stack([lon, lon + np.minimum(w, 360), lat, np.minimum(lat + h, 90)], 1).tolist()

    values = [None, float("inf"), float("-inf"), *rng.normal(0, 5, 400).tolist()]
    source = [(i, *b, 2.0 + i % 3, f, d, v) for i, b in enumerate(boxes(60)) for f, d in (("a", 1), ("a", 2), ("b", 1), ("b", 2), (None, 3)) for v in rng.choice(np.array(values, object), int(rng.integers(0, 3)))]
    target = [(int(i * 0.8), 1.0 + int(i * 0.8) % 2, *b) for i, b in enumerate(boxes(90))] + [(200, 1.0, 10.0, 5.0, 0.0, 1.0), (201, 1.0, None, 5.0, 0.0, 1.0), (202, 1.0, 1.0, 5.0, float("nan"), 1.0)]
    held = spark.createDataFrame(source, "k int, slon0 double, slon1 double, slat0 double, slat1 double, a double, f string, d int, v double")
    aims = spark.createDataFrame(target, "t int, ta double, tlon0 double, tlon1 double, tlat0 double, tlat1 double")
    area = lambda w, e, s, n: np.radians(e - w) * (np.sin(np.radians(n)) - np.sin(np.radians(s)))
    sums = {}
    for _, w, e, s, n, a, f, d, v in source:
        for t, ta, tw, te, ts, tn in target[:90] if v is not None else ():
            for turn in (-720, -360, 0, 360, 720):
                west, east, south, north = max(w + turn, tw), min(e + turn, te), max(s, ts), min(n, tn)
                if west < east and south < north:
                    o, at = area(west, east, south, north), sums.setdefault((f, d, t), [0.0, 0.0, 0.0])
                    at[0], at[1], at[2] = at[0] + o * v, at[1] + o, at[2] + v * a * o / area(w, e, s, n) / ta
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "7")
    try:
        means, totals = ({(r.f, r.d, r.t): r.value for r in remap.conservative_lonlat(held, aims, "v", ["t"], ["f", "d"], ["k"], shares).collect()} for shares in (None, ("a", "ta")))
    finally:
        spark.conf.set(batch, before)
    assert set(means) == set(totals) == set(sums) and len(sums) > 200
    for k, (total, weight, shared) in sums.items():
        assert means[k] == pytest.approx(total / weight, rel=1e-6, nan_ok=True)  # sides of about 360 degrees leave nine digits to thousandths
        assert totals[k] == pytest.approx(shared, rel=1e-6, abs=1e-9, nan_ok=True)


def test_quantiles_are_those_of_percentile(spark):
    import numpy as np

    rng = np.random.default_rng(9)
    sets = {"a": rng.normal(0, 1, 501), "b": np.repeat(3.0, 40), "c": np.array([1e300, -1e300, 5.0, 5.0, 5.1]), "d": np.array([2.0]), "e": np.round(rng.exponential(5, 300), 1)}
    rows = [(k, float(v)) for k, x in sets.items() for v in x] + [("a", None), ("b", float("nan")), ("f", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = [0.0, 0.05, 0.5, 0.98, 1.0]
    for bins, passes in ((4096, 3), (4, 2), (16, 0)):
        found = tables.quantiles(df, ["k"], "v", shares, bins, passes)
        got = {(r.k, r.share): r.value for r in found.collect()}
        assert set(got) == {(k, s) for k in sets for s in shares}
        for (k, s), value in got.items():
            assert value == pytest.approx(float(np.quantile(sets[k], s)), rel=1e-12)
        assert "percentile" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_screen_shuffles_the_rows_once(spark):
    rows = [(m, d, float((i * 7 + k * k) % 13)) for k, m in enumerate("pqrs") for i, d in enumerate("abcdefg") if (i + k) % 6] + [("p", "z", None)]
    df = spark.createDataFrame(rows, "metric string, d string, value double")
    out = {(r.metric_x, r.metric_y): r for r in tables.screen(df, "d").collect()}
    import numpy as np

    held = {m: {d: v for n, d, v in rows if n == m and v is not None} for m in "pqrs"}
    for a in "pqrs":
        for b in "pqrs":
            both = sorted(set(held[a]) & set(held[b]))
            if a < b and len(both) >= 4:
                assert out[a, b].n == len(both) and out[a, b].r == pytest.approx(np.corrcoef([held[a][d] for d in both], [held[b][d] for d in both])[0, 1])
    assert len(out) == 6 and tables.screen(df, "d")._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_store_replaces_datasets_and_merges_columns(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    one_ = spark.createDataFrame([("a", 1), ("b", 2)], "dataset string, value int")
    store.publish(one_, path, "m1")
    store.publish(spark.createDataFrame([("a", "annual", 0.5)], "dataset string, period string, p double"), path, "m2", "north")
    store.publish(spark.createDataFrame([("b", 9.5)], "dataset string, value double"), path, "m1")
    got = {(r.module, r.dataset, r.value, r.period, r.p, r.hemisphere) for r in store.read_store(spark, path).collect()}
    assert got == {("m1", "a", 1.0, None, None, "south"), ("m1", "b", 9.5, None, None, "south"), ("m2", "a", None, "annual", 0.5, "north")}
    store.publish(spark.createDataFrame([("c", 1.0)], "dataset string, value double"), path, "m1", whole=True)
    assert {(r.module, r.dataset) for r in store.partitions(spark, path).collect()} == {("m1", "c"), ("m2", "a")}
    assert store.read_store(spark, path, "dataset", "value", "sector").columns == ["dataset", "value", "sector"]
    index = {r.module: r.filled for r in store.store_index(store.read_store(spark, path)).collect()}
    assert index == {"m1": "value", "m2": "p,period"}


def test_segments_merge_by_precedence(spark):
    rows = [("k", 1, "s1", 1.0, None), ("k", 1, "s2", 2.0, 9.0), ("k", 2, "s2", 3.0, None), ("k", 2, "s2", 2.5, None), ("l", 1, "s3", None, 4.0)]
    df = spark.createDataFrame(rows, "k string, time int, segment string, u double, v double")
    pick = lambda **o: sorted(map(tuple, store.merge_segments(df, ["k"], **o).collect()))
    assert pick() == [("k", 1, 1.0, None), ("k", 2, 2.5, None), ("l", 1, None, 4.0)]
    assert pick(prefer="last") == [("k", 1, 2.0, 9.0), ("k", 2, 3.0, None), ("l", 1, None, 4.0)]
    assert store.merge_segments(df.where("false"), ["k"]).count() == 0


def test_raw_cubes_round_trip(spark, tmp_path):
    rows = [(y, m, a, b, y % 100 + m / 8 + a - b) for y in (1999, 2000) for m in (1, 5, 12) for a in range(3) for b in range(4) if (a, b) != (1, 1)] + [(1999, 13, 0, 0, 5.0), (1999, 1, 7, 0, 5.0), (2000, 2, 0, 0, None)]
    path = f"file://{tmp_path}/cubes"
    store.write_raw_cubes(spark.createDataFrame(rows, "year int, month int, y int, x int, value double"), path, 3, 4)
    names = list(tmp_path.glob("cubes/year=*/part-*.txt"))
    assert sorted(n.stat().st_size for n in names) == [4 * 12 * 12 + 4] * 2
    got = {(r.year, r.month, r.y, r.x): r.value for r in store.read_cube_slabs(spark, path, 3, 4).collect()}
    assert len(got) == 2 * 12 * 12 and {k: v for k, v in got.items() if v is not None} == {tuple(r[:4]): r[4] for r in rows if r[1] <= 12 and r[2] < 3 and r[4] is not None}
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "heff.H2003").write_bytes(struct.pack("<24f", *range(24)))
    got = {(r.year, r.month, r.y, r.x): r.value for r in store.read_cube_slabs(spark, f"file://{tmp_path}/other", 1, 2).collect()}
    assert got == {(2003, m + 1, 0, x): float(2 * m + x) for m in range(12) for x in range(2)}


def test_stencils_go_by_coordinate(spark):
    grid = spark.createDataFrame([(y, x, 10.0 * x, 60.0 + y) for y in range(2) for x in (0, 1, 3, 4)], "y int, x int, lon double, lat double")
    area = {(r.y, r.x): r.area for r in regrid.curvilinear_area(grid).collect()}
    assert area[0, 1] == pytest.approx(area[0, 0]) and area[0, 3] == pytest.approx(area[0, 4])  # one-sided beside the gap
    far = {(r.y, r.x): (r.hx, r.hy) for r in budget.distances(grid).collect()}
    assert far[0, 0][0] == 0 and far[0, 1][0] > 0 and far[0, 3][0] is None and far[0, 4][0] is None and far[1, 3][1] > 0


def test_matched_coverage_needs_every_dataset(spark):
    rows = [("o1", 1, 1.0), ("o2", 1, 1.0), ("m", 1, 1.0), ("o1", 2, 1.0), ("m", 2, 1.0), ("o1", 3, 1.0), ("o2", 3, None), ("m", 3, 1.0), ("o1", 4, 1.0), ("o2", 4, 1.0), ("m", 4, None)]
    df = spark.createDataFrame(rows, "dataset string, time int, v double").withColumns({"y": F.lit(0), "x": F.lit(0)})
    out = align.coverage_modes(align.coverage(df, F.col("v").isNotNull(), ["o1", "o2"]))
    assert {(r.dataset, r.time) for r in out.where("coverage_mode = 'matched'").collect()} == {("o1", 1), ("o2", 1), ("m", 1), ("o1", 4), ("o2", 4)}
    assert out.where("coverage_mode = 'own'").count() == len(rows)


def test_tiles_change_no_stencil(spark, monkeypatch):
    """Tiles of few rows, whose edges cut the grid, against one tile that holds it all; cells that are missing too."""
    from nilas.sources.views import Views

    v = Views(spark, "/root/testdata/sf0.001")
    daily = v.daily.where("dataset <> 'obs2' AND i < 6 AND NOT (x = 3 AND y = 2)")
    grid = spark.createDataFrame([(x, y, 5.0 * x, 65.0 + y, 1.0, 1) for x in range(8) for y in range(6)], "x int, y int, lon double, lat double, cell_area double, region int")
    found = {}
    for tile in (24, 4):
        monkeypatch.setattr(budget, "TILE", tile)
        found[tile] = {(r.dataset, r.i, r.y, r.x): tuple(None if t is None else round(t, 9) for t in (r.dadt, r.adv, r.div, r.res)) for r in budget.daily_budget(daily, grid).collect()}
    assert found[4] == found[24] and any(None not in t for t in found[4].values())


@pytest.mark.parametrize("name", ["W8_three_day_mean", "W9_mean_filter", "W10_gradient", "W11_daily_budget"])
def test_days_of_the_views_are_not_shuffled(spark, name):
    """Cells are shuffled, then their days are made: no exchange stands over the join with the days."""
    from nilas import plans

    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above, days, _ = plan.partition("BroadcastHashJoin [_month")
    assert days and "Exchange" not in above


@pytest.mark.parametrize("name", ["M19_integral_percentage_error", "A8_budget_closure", "W12_common_mask", "W13_ridging_ratio"])
def test_a_budget_is_made_once_and_sorts_no_day(spark, name):
    """No window and no second pass for the reference stand over the join with the days."""
    from nilas import plans

    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and "RunningWindow" not in plan
    made, days, _ = plan.partition("BroadcastHashJoin [_month")
    assert days and "Window" not in made.partition("FlatMapGroupsInArrow")[2]


def test_budget_of_stretches_is_that_of_days(spark):
    """Months as lists and single days, also where a cell and a day are missing."""
    grid = spark.createDataFrame([(x, y, 5.0 * x, 65.0 + y, 1.0, 1) for x in range(4) for y in range(5)], "x int, y int, lon double, lat double, cell_area double, region int")
    days = spark.range(4 * 5 * 9).selectExpr("'a' AS dataset", "CAST(id % 4 AS INT) AS x", "CAST(id DIV 4 % 5 AS INT) AS y", "id DIV 20 AS i").where("NOT (x = 1 AND y = 2) AND i <> 6")
    days = days.selectExpr("*", "date_add(DATE '2000-01-28', CAST(i AS INT)) AS time", "CAST((i * 7 + x * 13 + y * 29) % 101 AS DOUBLE) AS sic", "CASE WHEN x + y <> 5 THEN (i * 5 + x * 3 + y) % 11 / 100D END AS u", "(i + x * y) % 7 / 100D AS v").selectExpr("*", "year(time) AS yr", "month(time) AS mo")
    rows = budget.tiled(budget.on_grid(days, grid)).repartition("dataset", "_tile")
    lists = rows.groupBy("dataset", "_tile", "x", "y", "yr", "mo", "sx", "sy", "cell_area", "region").agg(F.sort_array(F.collect_list(F.struct("i", "time", "sic", "u", "v"))).alias("_l")).select("*", *(F.col(f"_l.{c}").alias(c) for c in ("i", "time", "sic", "u", "v"))).drop("_l")
    got = [sorted(map(repr, budget.daily_budget(df, grid).collect())) for df in (rows, lists)]
    assert got[0] == got[1] and len(got[0]) == 19 * 4


def test_dates_on_arrays_are_those_of_windows(spark):
    """Noisy cycles with missing days and null values, as days and as months; and cut calendars."""
    days = spark.range(6 * 900).selectExpr("'a' AS dataset", "CAST(id % 6 AS INT) AS x", "0 AS y", "CAST(id DIV 6 AS INT) AS i").where("NOT (x = 2 AND i % 97 = 5) AND NOT (x = 3 AND i BETWEEN 340 AND 372) AND NOT (x = 5 AND i > 30)")
    days = days.selectExpr("*", "date_add(DATE '2000-02-10', i) AS time", "CASE WHEN x <> 4 OR i % 53 <> 7 THEN 20 + 25 * sin(i / 40D + x) + pmod(i * 7919 + x * 31, 23) END AS sic").selectExpr("*", "year(time) AS yr", "month(time) AS mo")
    lists = days.groupBy("dataset", "x", "y", "yr", "mo").agg(F.sort_array(F.collect_list(F.struct("time", "sic"))).alias("_l")).select("*", "_l.time", "_l.sic").drop("_l")
    cols = [*transition.CYCLE, "cycle", "advance", "retreat"]
    want = sorted(map(repr, transition.dates(transition.crossings(transition.smooth(transition.cycles(days))), control=False).select(*cols).collect()))
    assert any("None" not in r for r in want)
    for form in (days, lists):
        assert sorted(map(repr, transition.raw_dates(form).select(*cols).collect())) == want
    t = [sorted(map(tuple, transition.cycles(form).select(*transition.CYCLE, "time", "t", "cycle", "sic").collect()), key=repr) for form in (days, lists)]
    assert t[0] == t[1]


@pytest.mark.parametrize("name", ["W4_transition_year", "J14_date_pairs", "B4_phase_table", "M20_phase_differences", "B4_phase_difference_table"])
def test_dates_sort_no_day(spark, name):
    """Days are made as lists of a month; where they come apart, nothing is sorted any more."""
    from nilas import plans

    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    if name == "W4_transition_year":
        assert "collect_list(struct(time" in plan and "explode(_days" not in plan
    else:
        assert "l_shipdate" not in plan and "o_orderdate" not in plan  # dates are made once and read back


def test_quantiles_shuffle_no_row(spark):
    """Rows meet the wanted ranks where they are read, whatever Spark knows of sizes."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(1000).selectExpr("id % 2 AS k", "CAST(id AS DOUBLE) AS v")
        plan = tables.quantiles(rows, ["k"], "v", [0.5])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") <= 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_budget_sums_are_those_of_the_daily_budget(spark):
    from nilas.sources.views import Views, day_values

    v = Views(spark, "/root/testdata/sf0.001")
    rows = v.daily.where("i < 70 AND NOT (x = 3 AND i = 20) AND NOT (x = 2 AND y = 1)").withColumns({"sic": F.when(F.col("x") + F.col("i") != 9, F.col("sic")), "u": F.when(F.col("y") + F.col("i") != 12, F.col("u"))})
    days = budget.daily_budget(rows, v.grid)
    near = lambda rows: {tuple(r[:3]): [None if x is None else pytest.approx(x, abs=1e-6) for x in r[3:]] for r in rows}
    by = ["dataset", "y", "x", "yr", "mo"]
    got = budget.budget_sums(rows, v.grid, by, budget.TOTALS).collect()
    want = {tuple(r[:5]): list(r[5:]) for r in days.groupBy(*by).agg(*(F.sum(t) for t in budget.TERMS)).collect()}
    assert {tuple(r[:5]): [None if x is None else pytest.approx(x, abs=1e-6) for x in r[5:]] for r in got} == want and len(got) == len(want) and any(None in x for x in want.values())
    by = ["dataset", "time", "mo"]
    values = budget.RIDGES | budget.INTEGRALS
    ice = F.col("sic") >= 15
    own = [F.sum((F.coalesce(ice & (F.col("sic") > 90) & (F.col("res") < -1e-9) & (F.col("div") > 1e-9), F.lit(False))).cast("double")), F.sum(F.coalesce(ice, F.lit(False)).cast("double"))]
    own += [F.sum(F.when(ok(F.col(t)), F.col(t) * F.col("cell_area") / 1e6)) for t in budget.TERMS for ok in (lambda x: x > 0, lambda x: x < 0, lambda x: x.isNotNull())]
    want = {tuple(r[:3]): list(r[3:]) for r in days.groupBy(*by).agg(*(c.alias(n) for c, n in zip(own, values, strict=True))).collect()}
    assert near(budget.budget_sums(rows, v.grid, by, values).collect()) == want and want  # one tile
    key = lambda df: {(r.dataset, r.i, r.y, r.x): (r.sic, r.dadt, r.adv, r.div, r.res) for r in df.where("i < 40").collect()}
    assert key(budget.daily_budget(v.month_tiles, v.grid, made=day_values)) == key(budget.daily_budget(v.daily, v.grid))  # days made in the tile's task are those of the view


@pytest.mark.parametrize("name", ["A8_budget_closure", "A9_season_budget_table", "M18_budget_difference", "W13_ridging_ratio"])
def test_budget_queries_send_no_days(spark, name):
    """Days are made and summed inside a tile's task: neither the rows that go to it nor those that leave it are days. Line items are dealt out once."""
    from nilas import plans

    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    leave = next(x for x in text.splitlines() if "FlatMapGroupsInArrow" in x).rsplit("[", 1)[-1]
    assert "lambdafunction" not in text and " i#" not in leave and text.count("RepartitionByExpression") == 3 * text.count("FlatMapGroupsInArrow")
