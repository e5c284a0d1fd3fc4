"""Grids, remapping by weight tables, cell areas and vector frames. Spheres throughout."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Km from the pole to the edges of the evaluation domains, and the radii in use.
EXTENT = {"south": 8400, "north": 7000}
RADIUS_M, SOURCE_RADIUS_M = 6378137.0, 6371000.0


def polar_grid(spark: SparkSession, resolution: int, hemisphere: str = "south") -> DataFrame:
    """Regular polar stereographic grid (true scale at the pole) with the lon and lat of each cell centre."""
    n = EXTENT[hemisphere] // resolution
    cells = spark.range(n * n).select((F.col("id") % n).cast("int").alias("x"), F.floor(F.col("id") / n).cast("int").alias("y"))
    px, py = ((F.col(c) - (n - 1) / 2) * resolution * 1000.0 for c in ("x", "y"))
    rho = F.sqrt(px * px + py * py)
    colat = 2 * F.atan(rho / (2 * RADIUS_M))
    sign = -1.0 if hemisphere == "south" else 1.0
    lon = F.degrees(F.atan2(px, py if hemisphere == "south" else -py))
    return cells.select("x", "y", px.alias("px"), py.alias("py"), lon.alias("lon"), (sign * (90 - F.degrees(colat))).alias("lat"))


def bilinear(source: DataFrame, target: DataFrame, value: str, step: float = 1.0) -> DataFrame:
    """source (sy, sx, value) on a regular grid, target (y, x, py, px) in source index space -> mean of the up to four neighbours present, by their weights."""
    fx, fy = F.floor("px"), F.floor("py")
    corners = F.explode(F.array(*[F.struct((fx + i).cast("int").alias("sx"), (fy + j).cast("int").alias("sy"), (F.abs(1 - i - (F.col("px") - fx)) * F.abs(1 - j - (F.col("py") - fy))).alias("w")) for i in (0, 1) for j in (0, 1)]))
    weights = target.select("y", "x", corners.alias("c")).select("y", "x", "c.*").where("w > 0")
    joined = weights.join(source.where(F.col(value).isNotNull()), ["sx", "sy"])
    return joined.groupBy("y", "x").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("value"))


def overlaps(source: DataFrame, target: DataFrame) -> DataFrame:
    """Overlap areas of rectangles (x0, x1, y0, y1): targets go to the unit bins that they touch and meet sources there, each pair once."""
    bins = lambda lo, hi: F.sequence(F.floor(lo).cast("int"), (F.ceil(hi) - 1).cast("int"))
    cut = lambda df, p: df.withColumn("_bx", F.explode(bins(F.col(f"{p}x0"), F.col(f"{p}x1")))).withColumn("_by", F.explode(bins(F.col(f"{p}y0"), F.col(f"{p}y1"))))
    pairs = cut(source, "s").join(cut(target, "t"), ["_bx", "_by"])
    w = F.greatest(F.lit(0.0), F.least("sx1", "tx1", F.col("_bx") + 1.0) - F.greatest("sx0", "tx0", F.col("_bx"))) * F.greatest(F.lit(0.0), F.least("sy1", "ty1", F.col("_by") + 1.0) - F.greatest("sy0", "ty0", F.col("_by")))
    return pairs.withColumn("overlap", w).where("overlap > 0")


def conservative(source: DataFrame, target: DataFrame, value: str) -> DataFrame:
    """Overlap-weighted mean over each target cell."""
    return overlaps(source.where(F.col(value).isNotNull()), target).groupBy("y", "x").agg((F.sum(F.col("overlap") * F.col(value)) / F.sum("overlap")).alias("value"))


def quadrilateral_area(sides: list[Column]) -> Column:
    """Brahmagupta's area of a quadrilateral with four side lengths."""
    s = (sides[0] + sides[1] + sides[2] + sides[3]) / 2
    return F.sqrt(F.greatest(F.lit(0.0), (s - sides[0]) * (s - sides[1]) * (s - sides[2]) * (s - sides[3])))


def rectilinear_area(lon_step: Column, lat0: Column, lat1: Column) -> Column:
    """R^2 times the longitude step times the difference of sines."""
    return SOURCE_RADIUS_M**2 * F.radians(lon_step) * F.abs(F.sin(F.radians(lat1)) - F.sin(F.radians(lat0)))


def curvilinear_area(grid: DataFrame) -> DataFrame:
    """Area from gradients of lon and lat along x and y, one-sided where the neighbour on a side is missing; null without a neighbour on either side."""
    wx, wy = Window.partitionBy("y").orderBy("x"), Window.partitionBy("x").orderBy("y")

    def grad(c: str, w) -> Column:
        before, after = (F.first(c).over(w.rangeBetween(k, k)) for k in (-1, 1))  # by coordinate, so that a missing cell makes no neighbours
        return F.when(before.isNull(), after - F.col(c)).when(after.isNull(), F.col(c) - before).otherwise((after - before) / 2)

    r, k = SOURCE_RADIUS_M, F.cos(F.radians("lat"))
    cross = F.abs(F.radians(grad("lon", wx)) * F.radians(grad("lat", wy)) - F.radians(grad("lon", wy)) * F.radians(grad("lat", wx)))
    return grid.withColumn("area", r * r * k * cross)


def clean_area(area: Column) -> Column:
    return F.when((area > 0) & (area <= 1e19), area)


def rotate(u: Column, v: Column, theta: Column) -> tuple[Column, Column]:
    return u * F.cos(theta) - v * F.sin(theta), u * F.sin(theta) + v * F.cos(theta)


def in_radians(df: DataFrame, angle: str) -> DataFrame:
    """The angle in radians: degrees are told by a largest absolute value over 2 pi + 0.5."""
    top = df.agg(F.max(F.abs(angle)).alias("_top"))  # one row
    return df.crossJoin(F.broadcast(top)).withColumn(angle, F.when(F.col("_top") > 2 * math.pi + 0.5, F.radians(angle)).otherwise(F.col(angle))).drop("_top")


def to_projection(u: Column, v: Column, lon: Column, hemisphere: str) -> tuple[Column, Column]:
    """East/north components to the projection's x/y."""
    c, s = F.cos(F.radians(lon)), F.sin(F.radians(lon))
    return (u * c + v * s, v * c - u * s) if hemisphere == "south" else (u * c - v * s, u * s + v * c)


def native_basis(grid: DataFrame, nx: int) -> DataFrame:
    """Unit vectors of the native x and y axes in east/north, from differences to the next cell (x wraps around), with their dot product."""
    g = grid.select("x", "y", "lon", "lat")
    right = g.select(F.pmod(F.col("x") - 1, F.lit(nx)).cast("int").alias("x"), "y", F.col("lon").alias("lon_x"), F.col("lat").alias("lat_x"))
    up = g.select("x", (F.col("y") - 1).alias("y"), F.col("lon").alias("lon_y"), F.col("lat").alias("lat_y"))
    rows = g.join(right, ["x", "y"]).join(up, ["x", "y"])
    turn = lambda d: F.pmod(d + 180, F.lit(360.0)) - 180
    k = F.cos(F.radians("lat"))
    for a in "xy":
        e, n = turn(F.col(f"lon_{a}") - F.col("lon")) * k, F.col(f"lat_{a}") - F.col("lat")
        size = F.nullif(F.hypot(e, n), F.lit(0.0))
        rows = rows.withColumns({f"{a}e": e / size, f"{a}n": n / size})
    return rows.select("x", "y", "xe", "xn", "ye", "yn", (F.col("xe") * F.col("ye") + F.col("xn") * F.col("yn")).alias("dot"))


def to_east_north(u: Column, v: Column) -> tuple[Column, Column]:
    """Native components to east/north with the basis columns of native_basis."""
    return u * F.col("xe") + v * F.col("ye"), u * F.col("xn") + v * F.col("yn")


def source_frame(request: Column, declared: Column, angle: Column) -> Column:
    """The frame of a vector pair: a definite request wins, then the declared one, then the native grid if there is an angle, else lonlat."""
    return F.when(request.isin("xy", "lonlat", "other"), request).when(declared.isin("xy", "lonlat"), declared).when(angle.isNotNull(), "xy").otherwise("lonlat")
