"""Remapping between grids in longitude and latitude: bilinear from axes, conservative between boxes on the sphere, nearest by a pyramid of cells."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from nilas.operators.budget import BATCH, _steps, haversine
from nilas.sources.files import kept, shared_folder


def _intervals(points: DataFrame, name: str, wraps: bool) -> DataFrame:
    """Neighbouring values of an axis as intervals (lo, hi, last) with the bins they touch and the bins' width, the widest interval. Around 360 degrees the last value meets the first if that gap isn't wider than one and a half others."""
    axis = points.select(F.col(name).alias("lo")).where("lo IS NOT NULL").distinct()
    w = Window.orderBy("lo")  # an axis: as many rows as a grid has columns or rows
    steps = axis.select("lo", F.lead("lo").over(w).alias("hi"))
    ends = steps.agg(F.min("lo").alias("_least"), F.max("lo").alias("_most"), F.max(F.col("hi") - F.col("lo")).alias("_step"))
    steps = steps.crossJoin(ends)  # one row of ends
    if wraps:
        around = (F.col("_least") + 360 - F.col("_most")) <= 1.5 * F.col("_step")
        steps = steps.withColumn("hi", F.when(F.col("hi").isNull() & around, F.col("_least") + 360).otherwise(F.col("hi")))
    steps = steps.where("hi IS NOT NULL").withColumn("_width", F.greatest(F.col("_step"), F.max(F.col("hi") - F.col("lo")).over(Window.partitionBy())))
    bins = F.sequence(F.floor(F.col("lo") / F.col("_width")), F.floor(F.col("hi") / F.col("_width")))
    return steps.select("lo", "hi", (F.col("hi") == F.col("_most")).alias("last"), "_least", "_width", F.explode(bins).alias("_bin"))


def _located(target: DataFrame, axis: DataFrame, name: str, wraps: bool) -> DataFrame:
    """Targets with the interval of the axis that they lie in (lo, hi); those outside go."""
    one = axis.agg(F.first("_least").alias("_least"), F.first("_width").alias("_width"))
    at = F.col("_least") + F.pmod(F.col(name) - F.col("_least"), F.lit(360.0)) if wraps else F.col(name)
    t = target.crossJoin(one).withColumn("_at", at).withColumn("_bin", F.floor(F.col("_at") / F.col("_width"))).drop("_least", "_width")
    inside = (F.col("_at") >= F.col("lo")) & ((F.col("_at") < F.col("hi")) | (F.col("last") & (F.col("_at") == F.col("hi"))) if not wraps else (F.col("_at") < F.col("hi")))
    return t.join(axis.drop("_least", "_width"), "_bin").where(inside).drop("_bin", "last")


def bilinear_weights(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Weights (keys, lon, lat, w) of the up to four corners around each target (keys, tlon, tlat) in a rectilinear source (lon, lat), on any spacing and across 360 degrees. Targets outside the latitudes, or outside the longitudes of a regional source, have none."""
    source = source.select(F.pmod("lon", F.lit(360.0)).alias("lon"), "lat")
    t = _located(target, _intervals(source, "lon", True), "tlon", True).withColumnsRenamed({"lo": "_lon0", "hi": "_lon1", "_at": "_tx"})
    t = _located(t, _intervals(source, "lat", False), "tlat", False)
    fx = (F.col("_tx") - F.col("_lon0")) / (F.col("_lon1") - F.col("_lon0"))
    fy = (F.col("_at") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    corner = lambda lon, lat, w: F.struct(F.pmod(lon, F.lit(360.0)).alias("lon"), lat.alias("lat"), w.alias("w"))
    x0, x1, y0, y1 = (F.col(c) for c in ("_lon0", "_lon1", "lo", "hi"))
    corners = F.array(corner(x0, y0, (1 - fx) * (1 - fy)), corner(x1, y0, fx * (1 - fy)), corner(x0, y1, (1 - fx) * fy), corner(x1, y1, fx * fy))
    return t.select(*keys, F.explode(corners).alias("c")).select(*keys, "c.*").where("w > 0")


def bilinear_lonlat(source: DataFrame, target: DataFrame, value: str, keys: list[str], fields: list[str]) -> DataFrame:
    """source (fields, lon, lat, value), target (keys, tlon, tlat) -> (fields, keys, value): the mean of the corners that are present, by their weights. All fields share one table of weights."""
    weights = bilinear_weights(source.select("lon", "lat").distinct(), target, keys)
    present = source.where(F.col(value).isNotNull()).select(*fields, F.pmod("lon", F.lit(360.0)).alias("lon"), "lat", F.col(value).alias("_v"))
    return present.join(weights, ["lon", "lat"]).groupBy(*fields, *keys).agg((F.sum(F.col("w") * F.col("_v")) / F.sum("w")).alias("value"))


def sphere_area(lon0: Column, lon1: Column, lat0: Column, lat1: Column) -> Column:
    """Area of a box on the unit sphere: the longitudes' difference times the difference of sines."""
    return F.radians(lon1 - lon0) * (F.sin(F.radians(lat1)) - F.sin(F.radians(lat0)))


def _pieces(boxes: DataFrame, p: str) -> DataFrame:
    """Boxes (lon0, lon1, lat0, lat1 with prefix p) with longitudes in 0 to 360, cut in two where they cross 360, and their levels: the powers of two at or above their width (level) and their height (rise)."""
    west, east = (F.col(f"{p}lon{i}") for i in (0, 1))
    low = F.pmod(west, F.lit(360.0))
    high = low + F.least(east - west, F.lit(360.0))
    cut = F.when(high > 360, F.array(F.struct(low.alias("a"), F.lit(360.0).alias("b")), F.struct(F.lit(0.0).alias("a"), (high - 360).alias("b")))).otherwise(F.array(F.struct(low.alias("a"), high.alias("b"))))
    out = boxes.withColumn("_c", F.explode(cut)).withColumns({f"{p}lon0": F.col("_c.a"), f"{p}lon1": F.col("_c.b")}).drop("_c")
    sides = {n: F.col(f"{p}{axis}1") - F.col(f"{p}{axis}0") for axis, n in (("lon", "level"), ("lat", "rise"))}
    for side in sides.values():
        out = out.where((side > 0) & (side < math.inf))  # nor NaN
    return out.withColumns({f"{p}{n}": F.ceil(F.log2(side)).cast("int") for n, side in sides.items()})


def _levels(boxes: DataFrame, p: str) -> DataFrame:
    """The levels and rises that boxes have, a few numbers in one row."""
    return boxes.agg(F.collect_set(f"{p}level").alias("_levels"), F.collect_set(f"{p}rise").alias("_rises"))


def _binned(boxes: DataFrame, p: str, levels: DataFrame) -> DataFrame:
    """Boxes in the bins that they touch, along each axis at their own level and at all greater ones that the other side has (_rises, or _levels for both axes): at most two bins an axis and level, however large or flat a box is."""
    at, greater = boxes.crossJoin(levels), lambda of, own: F.filter(of, lambda x: x > own)
    for axis, own, level, n, other in (("lon", "level", "_level", "_bx", "_levels"), ("lat", "rise", "_rise", "_by", "_rises" if "_rises" in levels.columns else "_levels")):
        own = F.col(f"{p}{own}")
        at = at.withColumn(level, F.explode(F.array_distinct(F.concat(F.array(own), greater(other, own)))))
        width = F.pow(F.lit(2.0), F.col(level))
        at = at.withColumn(n, F.explode(F.sequence(*(F.floor(F.col(f"{p}{axis}{i}") / width).cast("long") for i in (0, 1)))))
    return at.drop(*levels.columns)


def overlap_candidates(source: DataFrame, target: DataFrame) -> DataFrame:
    """Pairs of pieces of boxes (slon0 ... and tlon0 ...) that touch the same bin. Those of like width and height have bins of their own, so that flat or narrow boxes meet those beside them only."""
    s, t = _pieces(source, "s"), _pieces(target, "t")
    return _binned(s, "s", _levels(t, "t")).join(_binned(t, "t", _levels(s, "s")), ["_level", "_rise", "_bx", "_by"])


def lonlat_overlaps(source: DataFrame, target: DataFrame) -> DataFrame:
    """Pairs of boxes (slon0 ... and tlon0 ...) that overlap, with overlap, their common area on the unit sphere. Two boxes meet at the level of the wider one and the rise of the higher one, in the bin of their overlap's lower corner, so each pair once a piece."""
    west, east = F.greatest("slon0", "tlon0"), F.least("slon1", "tlon1")
    south, north = F.greatest("slat0", "tlat0"), F.least("slat1", "tlat1")
    first = (F.col("_bx") == F.floor(west / F.pow(F.lit(2.0), F.col("_level")))) & (F.col("_by") == F.floor(south / F.pow(F.lit(2.0), F.col("_rise"))))
    met = overlap_candidates(source, target).where((F.col("_level") == F.greatest("slevel", "tlevel")) & (F.col("_rise") == F.greatest("srise", "trise")) & (west < east) & (south < north) & first)
    return met.withColumn("overlap", sphere_area(west, east, south, north)).drop("_level", "_rise", "_bx", "_by", "slevel", "tlevel", "srise", "trise")


#: Widths and heights of targets that a tile may have, the most targets in it, and about the most pieces of sources in one of its lots.
SPAN, PLACES, LOT = 32, 512, 4096
#: Values of a source box that one row carries, and boxes whose overlaps a task works out at once.
SERIES, BOXES = 512, 1024
SIDES = ("lon0", "lon1", "lat0", "lat1")


def _tiles(target: DataFrame) -> DataFrame:
    """Pieces of targets with their tile (_tile): up to PLACES pieces of like size and place, so that a tile isn't much larger than what it holds."""
    t = _pieces(target, "t")
    place = [F.floor(F.col(f"t{axis}0") / F.pow(F.lit(2.0), F.col(f"t{n}")) / SPAN) for axis, n in (("lon", "level"), ("lat", "rise"))]
    t = t.withColumn("_tile", F.concat_ws(" ", "tlevel", "trise", *place)).drop("tlevel", "trise")
    order = Window.partitionBy("_tile").orderBy("tlat0", "tlon0", *(c for c in t.columns if c not in ("_tile", "tlat0", "tlon0")))
    return t.withColumn("_tile", F.concat_ws(" ", "_tile", F.floor((F.row_number().over(order) - 1) / PLACES)))


class _Sums:
    """Sums of a tile's targets over the sources that came so far, by target and field."""

    def __init__(self):
        self.rows, self.total, self.weight, self.pairs = [], None, None, None

    def box(self) -> list[np.ndarray]:
        return [np.concatenate([rows[f"_{c}"].to_numpy() for rows in self.rows])[:, None] for c in SIDES]

    def add(self, box: list[np.ndarray], share: np.ndarray, row: np.ndarray, field: np.ndarray, value: np.ndarray, fields: int) -> None:
        """box: sides of sources; row, field and value: what the sources have. Values that aren't finite go only to targets that meet them."""
        if self.total is None:
            self.sides = self.box()
            self.total, self.weight, self.pairs = (np.zeros((len(self.sides[0]), 0)) for _ in range(3))
        if self.total.shape[1] < fields:
            self.total, self.weight, self.pairs = (np.pad(f, ((0, 0), (0, fields - f.shape[1]))) for f in (self.total, self.weight, self.pairs))
        west, south = (np.maximum(self.sides[i], box[i]) for i in (0, 2))
        east, north = (np.minimum(self.sides[i], box[i]) for i in (1, 3))
        meets = (west < east) & (south < north)
        near = np.flatnonzero(meets.any(0))  # sources that meet none of the targets are left out
        overlap = np.where(meets, np.radians(east - west) * (np.sin(np.radians(north)) - np.sin(np.radians(south))), 0.0)[:, near]
        place = np.full(meets.shape[1], -1)
        place[near] = np.arange(len(near))
        kept = place[row] >= 0
        at, value = place[row[kept]] * fields + field[kept], value[kept]
        dense = lambda at, weights=None: np.bincount(at, weights, len(near) * fields).reshape(len(near), fields).astype("float64")
        finite, count = np.isfinite(value), dense(at)
        self.total += (overlap * share[near]) @ dense(at, np.where(finite, value, 0.0))
        self.weight += overlap @ count
        self.pairs += meets[:, near].astype("float64") @ count
        for odd in np.unique(value[~finite]):  # NaN, inf and -inf
            here = np.isnan(value) if np.isnan(odd) else value == odd
            self.total[meets[:, near].astype("float64") @ dense(at[here]) > 0] += odd

    def batches(self, keys: list[str], names: list[str], fields: list[pa.Array]):
        """A row for each target and field that met."""
        if self.total is None:
            return
        targets = pa.Table.from_batches([rows.select(keys) for rows in self.rows]).combine_chunks()
        t, f = np.nonzero(self.pairs)
        for k in range(0, len(t), BATCH):
            a, b = t[k : k + BATCH], f[k : k + BATCH]
            found = [targets[c].take(pa.array(a)).combine_chunks() for c in keys] + [c.take(pa.array(b)) for c in fields]
            yield pa.RecordBatch.from_arrays([*found, pa.array(self.total[a, b]), pa.array(self.weight[a, b])], names=[*keys, *names, "_sum", "_weight"])


def _overlap_sums(keys: list[str], names: list[str]):
    """Reads rows in the order of tiles, a tile's targets before its sources, and gives sums by target and field. A task holds one tile's sums and one batch of sources, however many there are."""

    def run(batches):
        tile, sums, seen, values = None, None, {}, [[] for _ in names]
        for rows in batches:
            kinds = [rows[c].type.value_type for c in names]
            length = pc.fill_null(pc.list_value_length(rows["_v"]), 0).to_numpy()
            start = np.concatenate([[0], np.cumsum(length)])
            code = np.zeros(start[-1], "int64")
            tables = []
            for c in names:
                flat = rows[c].flatten().dictionary_encode(null_encoding="encode")
                code = code * max(1, len(flat.dictionary)) + flat.indices.to_numpy()
                tables.append(flat.dictionary.to_pylist())
            different, at = _steps(code)
            places = np.zeros(len(different), "int64")
            for i, n in enumerate(different.tolist()):
                key = []
                for table in reversed(tables):
                    n, k = divmod(n, max(1, len(table)))
                    key.append(table[k])
                key = tuple(reversed(key))
                if key not in seen:
                    seen[key] = len(seen)
                    for column, v in zip(values, key, strict=True):
                        column.append(v)
                places[i] = seen[key]
            field = places[at]
            flat = rows["_v"].flatten().to_numpy(zero_copy_only=False)
            of = rows["_tile"].dictionary_encode()
            edges = np.flatnonzero(np.diff(of.indices.to_numpy())) + 1
            source = rows["_source"].to_numpy(zero_copy_only=False)
            box, share = [rows[f"_{c}"].to_numpy() for c in SIDES], rows["_share"].to_numpy(zero_copy_only=False)
            for low, high in zip([0, *edges], [*edges, rows.num_rows], strict=True):
                name = rows["_tile"][int(low)].as_py()
                if name != tile:
                    if sums:
                        yield from sums.batches(keys, names, [pa.array(v, k) for v, k in zip(values, kinds, strict=True)])
                    tile, sums = name, _Sums()
                first = int(low + np.count_nonzero(~source[low:high]))
                if first > low:
                    sums.rows.append(rows.slice(low, first - low))
                for k in range(first, int(high), BOXES):
                    to = min(k + BOXES, int(high))
                    part = slice(start[k], start[to])
                    sums.add([b[k:to] for b in box], share[k:to], np.repeat(np.arange(to - k), length[k:to]), field[part], flat[part], len(seen))
        if sums:
            yield from sums.batches(keys, names, [pa.array(v, k) for v, k in zip(values, kinds, strict=True)])

    return run


def conservative_lonlat(source: DataFrame, target: DataFrame, value: str, keys: list[str], fields: list[str], box: list[str], area: tuple[str, str] | None = None) -> DataFrame:
    """source (fields, box, slon0, slon1, slat0, slat1, value), target (keys, tlon0 ... tlat1) -> (fields, keys, value): the mean over each target box by common area.

    box: columns that name a source box. area: columns with the areas of source and target boxes; then each source box gives value times area to the targets by its shares, and a target's sum is divided by its area, which keeps the total.
    A box's values are gathered in one list and written to the shared folder; lists go to the tiles of targets that the box meets, where overlaps are worked out and summed on arrays: no pair of boxes is shuffled, and none meets fields as rows.
    A tile that meets many sources takes them in lots, each with all of its targets.
    """
    shape = [f"s{c}" for c in SIDES]
    whole = sphere_area(*(F.col(c) for c in shape))
    share = F.try_divide(F.col(area[0]), whole) if area else F.lit(1.0)
    names = [f"_f{i}" for i in range(len(fields))]
    present = source.where(F.col(value).isNotNull()).select(*box, *shape, share.cast("double").alias("_share"), F.struct(*(F.col(f).alias(n) for f, n in zip(fields, names, strict=True)), F.col(value).cast("double").alias("_v")).alias("_one"))
    lists = present.where("_share IS NOT NULL").groupBy(*box, *shape, "_share").agg(F.collect_list("_one").alias("_all"))
    cut = F.transform(F.sequence(F.lit(1), F.size("_all"), F.lit(SERIES)), lambda i: F.slice("_all", i, SERIES))
    lists = lists.select(F.struct(*shape).alias("_box"), "_share", F.explode(cut).alias("_part")).select("_box", "_share", *(F.col("_part")[n].alias(n) for n in (*names, "_v")))
    extra = [area[1]] if area else []
    lists, targets = kept(lists, "remap"), kept(_tiles(target.select(*keys, *extra, *(f"t{c}" for c in SIDES))), "remap")

    ends = [f("t" + c).alias("t" + c) for c, f in zip(SIDES, (F.min, F.max, F.min, F.max), strict=True)]
    tiles = targets.groupBy("_tile").agg(*ends)
    sides = lambda p: [F.col(f"{p}{c}").alias(f"_{c}") for c in SIDES]
    meets = kept(lonlat_overlaps(lists.select("_box").distinct().select("_box", "_box.*"), tiles).select("_box", "_tile", *sides("s")), "remap")
    lots = meets.groupBy("_tile").agg(F.ceil(F.count("*") / LOT).alias("_lots"))
    n = lots.agg(F.sum("_lots")).first()[0] or 1
    lot = lambda k: F.concat_ws(" ", "_tile", k).alias("_tile")
    here = targets.join(lots, "_tile").withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_lots") - 1))).select(lot("_lot"), F.lit(False).alias("_source"), *sides("t"), *keys, *extra)
    meets = meets.join(lots, "_tile").select("_box", lot(F.pmod(F.xxhash64("_box"), "_lots")), *(f"_{c}" for c in SIDES))
    # lists are many times as large in memory as in their files, so the size of these must not let Spark broadcast them
    there = lists.join(meets.hint("shuffle_hash"), "_box").select("_tile", F.lit(True).alias("_source"), *sides("_"), "_share", *names, "_v")
    rows = here.unionByName(there, allowMissingColumns=True).repartition(min(n, 8 + n // 8), "_tile").sortWithinPartitions("_tile", "_source")
    kinds = [target.schema[c] for c in (*keys, *extra)] + [StructField(n, source.schema[f].dataType) for f, n in zip(fields, names, strict=True)] + [StructField(n, DoubleType()) for n in ("_sum", "_weight")]
    sums = rows.mapInArrow(_overlap_sums([*keys, *extra], names), StructType(kinds))
    sums = sums.withColumnsRenamed(dict(zip(names, fields, strict=True))).groupBy(*fields, *keys, *extra).agg(F.sum("_sum").alias("_sum"), F.sum("_weight").alias("_weight"))
    return sums.select(*fields, *keys, F.try_divide("_sum", area[1] if area else "_weight").alias("value"))


#: Nodes that all targets look at first, and sources in a cube at which cubes are divided no further.
FIRST, LEAF = 64, 16
#: Levels below the cube around the sphere: the last cubes are about a metre wide.
DEPTH = 24
#: Slack of bounds in unit vectors' distances: more than the rounding of distances, so that equally near sources stay.
SLACK = 1e-9


def nearest_candidates(source: DataFrame, target: DataFrame, value: str, reach: float = 2.0) -> DataFrame:
    """Targets (y, x, tlat, tlon) beside the sources (sy, sx, slat, slon, value) that may be nearest, by a descent through a pyramid of cubes.

    Unit vectors lie in cubes, each level twice as wide as the one below, up to one cube around the sphere; they know neither a date line nor a pole. A node is a cube with the box that its sources really span. A target keeps the nodes
    whose box begins no farther away than another's box ends, and goes on to their cubes one level down, until no cube holds more than LEAF places. Boxes are narrow wherever sources are dense, also along lines, so a target keeps a few
    nodes a level however many sources there are. reach: degrees that the width of one level has.
    """
    width = math.radians(reach)
    top = math.ceil(math.log2(4 / width))
    vectors, cubes = ["_vx", "_vy", "_vz"], ["_bx", "_by", "_bz"]

    def placed(df: DataFrame, lat: str, lon: str) -> DataFrame:
        a, b = F.radians(lat), F.radians(lon)
        return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumns({"_vx": F.cos(a) * F.cos(b), "_vy": F.cos(a) * F.sin(b), "_vz": F.sin(a)})

    def cube(level) -> dict[str, Column]:
        size = F.lit(width) * F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level)
        return {b: F.floor((F.col(v) + 1) / size).cast("int") for b, v in zip(cubes, vectors, strict=True)}

    def boxes(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys, *cubes).agg(*(f(v).alias(f"{v}{n}") for v in vectors for n, f in ((0, F.min), (1, F.max))))

    def bounds(box) -> tuple[Column, Column]:
        """Squared distances of a target to the nearest and the farthest point of a box."""
        near = [F.greatest(box(f"{v}0") - F.col(v), F.col(v) - box(f"{v}1"), F.lit(0.0)) for v in vectors]
        far = [F.greatest(F.col(v) - box(f"{v}0"), box(f"{v}1") - F.col(v)) for v in vectors]
        return tuple(x * x + y * y + z * z for x, y, z in (near, far))

    # sources of one place: the first of them is the nearest of them
    spots = source.groupBy("slat", "slon").agg(F.min_by(value, F.struct("sy", "sx")).alias(value), F.min(F.struct("sy", "sx")).alias("_s")).select("slat", "slon", value, "_s.sy", "_s.sx")
    spots = placed(spots, "slat", "slon")
    levels = F.explode(F.sequence(F.lit(top - DEPTH), F.lit(top)))
    at = spots.withColumn("_level", levels).withColumns(cube(F.col("_level")))
    held = {r["_level"]: r for r in at.groupBy("_level", *cubes).count().groupBy("_level").agg(F.count("*").alias("nodes"), F.max("count").alias("most")).collect()}  # a row a level
    start = min((n for n, r in held.items() if r["nodes"] <= FIRST), default=top)
    last = max((n for n, r in held.items() if n <= start and r["most"] <= LEAF), default=min([start, *held]))

    within = lambda near, least: F.sqrt(near) <= F.sqrt(least) + SLACK
    first = boxes(spots.withColumns(cube(start))).agg(F.collect_list(F.struct(*cubes, *(f"{v}{n}" for v in vectors for n in (0, 1)))).alias("_nodes"))
    wanted = placed(target, "tlat", "tlon").select("y", "x", "tlat", "tlon", *vectors).crossJoin(F.broadcast(first))  # one row of FIRST nodes
    wanted = wanted.withColumn("_least", F.array_min(F.transform("_nodes", lambda b: bounds(lambda c: b[c])[1])))
    wanted = wanted.withColumn("_node", F.explode(F.filter("_nodes", lambda b: within(bounds(lambda c: b[c])[0], F.col("_least"))))).select("y", "x", "tlat", "tlon", *vectors, *(F.col("_node")[c].alias(c) for c in cubes))
    if last < start:
        path = f"{shared_folder(source.sparkSession)}/nearest-{uuid.uuid4().hex}"
        boxes(at.where(F.col("_level").between(last, start - 1)), "_level").write.partitionBy("_level").parquet(path)
        nodes = source.sparkSession.read.parquet(path)
        of_target = Window.partitionBy("y", "x")
        for level in range(start - 1, last - 1, -1):
            below = nodes.where(F.col("_level") == level).drop("_level").select("*", *(F.shiftright(c, 1).alias(f"_up{c}") for c in cubes))
            met = wanted.withColumnsRenamed({c: f"_up{c}" for c in cubes}).join(below, [f"_up{c}" for c in cubes])
            near, far = bounds(F.col)
            met = met.select("y", "x", "tlat", "tlon", *vectors, *cubes, near.alias("_near"), far.alias("_far")).withColumn("_least", F.min("_far").over(of_target))
            wanted = met.where(within(F.col("_near"), F.col("_least"))).drop("_near", "_far", "_least")
    return wanted.drop(*vectors).join(spots.withColumns(cube(last)).drop(*vectors), cubes).drop(*cubes)


def nearest(source: DataFrame, target: DataFrame, value: str, reach: float = 2.0) -> DataFrame:
    """Value of the nearest source cell (sy, sx, slat, slon) of each target (y, x, tlat, tlon) by great-circle distance, wherever it is; the smallest (sy, sx) of equally near ones."""
    d = F.round(haversine(F.col("tlat"), F.col("tlon"), F.col("slat"), F.col("slon")), 6)
    return nearest_candidates(source, target, value, reach).groupBy("y", "x").agg(F.min_by(value, F.struct(d, "sy", "sx")).alias("value"))
