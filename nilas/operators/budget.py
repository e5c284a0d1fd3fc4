"""Stencils and the concentration budget: tendency = advection + divergence + residual."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from nilas.functions import calendar as cal
from nilas.functions.stats import bias, mae, rmse, weighted_mean
from nilas.operators.skill import area_correlation

LEVEL, EPS = 15.0, 1e-9
#: Rows of the grid in a tile, and rows of its neighbours that it holds too: one for means, one more for gradients of them.
TILE, HALO = 24, 2
#: From a cell to the one above in the order of cells; more than any row is long.
STRIDE = 1 << 32
#: Keys of one field in tiles; rows are sorted in this order, so the key of most values comes first.
FRAME = ("time", "_tile", "dataset")
TERMS = ("dadt", "adv", "div", "res")
#: What a budget keeps of its rows.
KEPT = ("dataset", "time", "yr", "mo", "i", "y", "x", "sic", "cell_area", "region")
#: Components of the change of concentration, in terms; the last closes the budget.
COMPONENTS = {"dynamic": "adv + div", "thermo": "res", "residual": "dadt - (adv + div) - res"}


def haversine(lat0: Column, lon0: Column, lat1: Column, lon1: Column, radius: float = 6378.137) -> Column:
    """Great-circle distance in the unit of radius."""
    a, b = F.radians(lat0), F.radians(lat1)
    h = F.sin(F.abs(a - b) / 2) ** 2 + F.cos(a) * F.cos(b) * F.sin(F.abs(F.radians(lon0) - F.radians(lon1)) / 2) ** 2
    return 2 * radius * F.asin(F.sqrt(h))


def distances(grid: DataFrame) -> DataFrame:
    """hx and hy: cumulative distances in m along x and along y, from the first cell of each row and column; null beyond a missing cell."""
    out = grid
    for name, along, across in (("hx", "x", "y"), ("hy", "y", "x")):
        w = Window.partitionBy(across).orderBy(along)
        before = w.rangeBetween(-1, -1)  # by coordinate
        step = haversine(F.col("lat"), F.col("lon"), F.first("lat").over(before), F.first("lon").over(before)) * 1000
        unbroken = F.count(F.lit(1)).over(w) == F.col(along) - F.min(along).over(w) + 1
        out = out.withColumn("_d", F.coalesce(step, F.lit(0.0))).withColumn(name, F.when(unbroken, F.sum("_d").over(w))).drop("_d")
    return out


def neighbour(value: str, keys, along: str, by: int) -> Column:
    """The value `by` (1 or -1) step on in the coordinate `along`; null if that row is missing."""
    w = Window.partitionBy(*keys).orderBy(along)
    return F.when(F.lead(along, by).over(w) == F.col(along) + by, F.lead(value, by).over(w))


def tiled(rows: DataFrame) -> DataFrame:
    """Rows with their tile (_tile), a band of TILE rows of the grid; those within HALO rows of a band's edge stand in the next tile too, so that stencils need no other tile. `own` takes the repeats out again."""
    tile = lambda by: F.floor((F.col("y") + by) / TILE)
    return rows.withColumn("_tile", F.explode(F.array_distinct(F.array(tile(-HALO), tile(HALO)))))


def own(rows: DataFrame) -> DataFrame:
    """Rows in the tile that they belong to."""
    return rows.where(F.floor(F.col("y") / TILE) == F.col("_tile"))


def _cells(frame) -> Window:
    """The cells of a frame row by row: one order for all stencils, in which the cell above is STRIDE away. y and x are whole numbers."""
    return Window.partitionBy(*frame).orderBy(F.col("y").cast("long") * STRIDE + F.col("x"))


def mean_filter(field: DataFrame, values: list[str], n: int = 3, frame=("dataset", "time")) -> DataFrame:
    """n by n means that shrink at the edges and skip nulls and missing cells."""
    k, w = (n - 1) // 2, _cells(frame)
    rows = [w.rangeBetween(j * STRIDE - k, j * STRIDE + k) for j in range(-k, k + 1)]
    total = lambda f, v, zero: sum((F.coalesce(f(v).over(r), F.lit(zero)) for r in rows[1:]), F.coalesce(f(v).over(rows[0]), F.lit(zero)))
    return field.withColumns({f"{v}_mean": total(F.sum, v, 0.0) / F.nullif(total(F.count, v, 0), F.lit(0)) for v in values})


def difference(value: str, along: str, frame=("dataset", "time")) -> Column:
    """The value of the next cell along x or y less that of the last; null where one is missing."""
    w = _cells(frame)
    if along == "y":
        at = lambda by: F.first(value).over(w.rangeBetween(by * STRIDE, by * STRIDE))
    else:
        at = lambda by: F.when((F.lead("x", by).over(w) == F.col("x") + by) & (F.lead("y", by).over(w) == F.col("y")), F.lead(value, by).over(w))
    return at(1) - at(-1)


def gradient(value: str, distance: str, along: str, frame=("dataset", "time")) -> Column:
    """Central difference along x or y; null at the edges and beside missing cells."""
    return difference(value, along, frame) / difference(distance, along, frame)


def spans(grid: DataFrame) -> DataFrame:
    """grid with sx and sy, the distances in m between the cells on either side along x and y: taken once from the grid, not in every field."""
    far = distances(grid)
    return far.withColumns({"sx": neighbour("hx", ["y"], "x", 1) - neighbour("hx", ["y"], "x", -1), "sy": neighbour("hy", ["x"], "y", 1) - neighbour("hy", ["x"], "y", -1)}).drop("hx", "hy")


def on_grid(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """Rows with sx, sy, cell_area and region of their cell."""
    return rows.join(spans(grid).select("x", "y", "sx", "sy", "cell_area", "region"), ["x", "y"])


def tendency(value: str, keys=("dataset", "y", "x")) -> Column:
    """Half the difference of the next and the last step's value, by the step number i; null where one is missing."""
    return (neighbour(value, keys, "i", 1) - neighbour(value, keys, "i", -1)) / 2


def running_mean(value: str, keys=("dataset", "y", "x"), before: int = 1, after: int = 1) -> Column:
    """Mean over the steps i - before to i + after; null if any of them is missing."""
    w = Window.partitionBy(*keys).orderBy("i").rangeBetween(-before, after)
    return F.when(F.count(value).over(w) == before + after + 1, F.avg(value).over(w))


#: Rows of a batch that a task hands back.
BATCH = 65536


def _steps(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of a coordinate in order, and the place of each row among them."""
    if len(values) and values.dtype.kind == "i" and int(values.max()) - int(values.min()) <= 4 * len(values):  # without a sort
        low = int(values.min())
        here = np.bincount(values - low) > 0
        return np.flatnonzero(here) + low, (np.cumsum(here) - 1)[values - low]
    return np.unique(values, return_inverse=True)


def _at(field: np.ndarray, axis: int, values: np.ndarray, by: int) -> np.ndarray:
    """The field `by` steps on in a coordinate; NaN where that step is missing."""
    to = np.searchsorted(values, values + by)
    found = (to < len(values)) & (values[np.minimum(to, len(values) - 1)] == values + by)
    out = np.take(field, np.where(found, to, 0), axis=axis)
    out[(slice(None),) * axis + (~found,)] = np.nan
    return out


def _counted(field: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The field with 0 where it is missing, and 1 where it isn't."""
    here = ~np.isnan(field)
    return np.where(here, field, 0.0), here.astype("float64")


def _mean(field: np.ndarray, axes: dict[int, np.ndarray], by) -> np.ndarray:
    """Mean of the values that are there, `by` steps on along each of the axes (given with their coordinates); NaN where none is."""
    total, n = _counted(field)
    for axis, values in axes.items():
        total, n = (sum(np.nan_to_num(_at(f, axis, values, k), copy=False) if k else f for k in by) for f in (total, n))
    return np.divide(total, n, out=np.full_like(total, np.nan), where=n > 0)


class _Tile:
    """Budget of a tile on arrays (y, x, i). Columns that are lists hold the steps of a cell, the others one value for all steps of a row."""

    def __init__(self, rows: pa.Table, made=None):
        self.rows = rows
        lists = [c for c in rows.column_names if pa.types.is_list(rows.schema.field(c).type)]
        self.flat = {c: pa.chunked_array([k.flatten() for k in rows[c].chunks], rows.schema.field(c).type.value_type) for c in lists}
        self.length = pc.list_value_length(rows[lists[0]]).to_numpy() if lists else np.ones(len(rows), "int64")
        values = {c: self.numbers(c) for c in ("sic", "u", "v")} if made is None else made(self.numbers)
        (ys, y), (xs, x), (steps, i) = (_steps(v) for v in (*(rows[c].to_numpy() for c in "yx"), self.numbers("i")))
        cell, shape = y * len(xs) + x, (len(ys), len(xs), len(steps))
        self.place = self.spread(cell * len(steps)) + i

        def dense(values: np.ndarray, place=self.place, shape=shape) -> np.ndarray:
            out = np.full(shape, np.nan)
            out.ravel()[place] = values
            return out

        sic, u, v = (dense(values[c].astype("float64")) for c in ("sic", "u", "v"))  # nulls are NaN
        weight = dense(self.numbers("_weight")) if "_weight" in rows.column_names else 1.0
        span = {c: dense(rows[f"s{c}"].to_numpy().astype("float64"), cell, (*shape[:2], 1)) for c in "xy"}
        with np.errstate(all="ignore"):
            ice = sic >= LEVEL
            u, v = (np.where(ice, _mean(f, {1: xs, 0: ys}, (-1, 0, 1)), np.nan) for f in (u, v))
            span = {c: np.where(s == 0, np.nan, s) for c, s in span.items()}
            slope = lambda f, axis, values, c: (_at(f, axis, values, 1) - _at(f, axis, values, -1)) / span[c]
            late = np.where(steps >= 2, 86400.0, np.nan) * weight
            adv = -(u * slope(sic, 1, xs, "x") + v * slope(sic, 0, ys, "y")) * late
            div = -sic * (slope(u, 1, xs, "x") + slope(v, 0, ys, "y")) * late
            dadt = (_at(sic, 2, steps, 1) - _at(sic, 2, steps, -1)) / 2
            adv, div = (_mean(f, {2: steps}, (0, 1, 2)) for f in (adv, div))
            self.terms = {"dadt": dadt, "adv": adv, "div": div, "res": dadt - adv - div}
        self.sic = sic
        own = self.spread(np.floor_divide(rows["y"].to_numpy(), TILE) == rows["_tile"].to_numpy())
        self.kept = np.flatnonzero(own & ~np.isnan(dadt.ravel()[self.place]))

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Values of rows for each of their steps."""
        return np.repeat(values, self.length)

    def numbers(self, name: str) -> np.ndarray:
        """A column's value for each step."""
        return self.flat[name].to_numpy() if name in self.flat else self.spread(self.rows[name].to_numpy())

    def column(self, name: str, at: np.ndarray):
        """A column's values for some steps."""
        if name in self.flat:
            return self.flat[name].take(pa.array(at))
        if name == "sic" and name not in self.rows.column_names:
            return pa.array(self.sic.ravel()[self.place[at]], from_pandas=True)
        return self.rows[name].take(pa.array(np.searchsorted(np.cumsum(self.length), at, side="right")))

    def days(self) -> pa.Table:
        """A row a cell and step."""
        table = pa.table({c: self.column(c, self.kept) for c in KEPT} | {n: pa.array(f.ravel()[self.place[self.kept]], from_pandas=True) for n, f in self.terms.items()})
        return pa.concat_tables([table.slice(k, BATCH).combine_chunks() for k in range(0, max(1, len(table)), BATCH)])

    def sums(self, by, values) -> pa.Table:
        """Sums of values (functions of sic, cell_area and the terms, by name) over the steps that have the same values of the columns `by`; null where all are missing."""
        whole = [c for c in by if c not in self.flat]
        code = np.zeros(len(self.rows), "int64")
        for c in whole:
            found, at = _steps(self.rows[c].to_numpy())
            code = _steps(code * len(found) + at)[1]
        code = self.spread(code)
        for c in by:
            if c in self.flat:
                found, at = _steps(self.flat[c].cast(pa.int32()).to_numpy() if pa.types.is_date(self.flat[c].type) else self.flat[c].to_numpy())
                code = code * len(found) + at
        groups, code = _steps(code[self.kept])
        first = np.zeros(len(groups), "int64")
        first[code[::-1]] = self.kept[::-1]
        fields = {n: f.ravel()[self.place[self.kept]] for n, f in (self.terms | {"sic": self.sic}).items()} | {"cell_area": self.numbers("cell_area")[self.kept]}
        out = {c: self.column(c, first) for c in by}
        for name, value in values.items():
            total, n = (np.bincount(code, x, len(groups)) for x in _counted(value(fields)))
            out[name] = pa.array(np.where(n > 0, total, np.nan), from_pandas=True)
        return pa.table(out)


def _in_tiles(daily: DataFrame, grid: DataFrame, weight: Column | None, columns) -> DataFrame:
    """daily on its grid and in tiles, with what a budget needs."""
    if "_tile" not in daily.columns:
        daily = tiled(on_grid(daily, grid)).repartition("dataset", "_tile")
    if weight is not None:
        daily = daily.withColumn("_weight", weight.cast("double"))
    return daily.select(*(c for c in daily.columns if c in columns))


#: What a tile needs of its rows.
NEEDED = (*KEPT, "_tile", "sx", "sy", "u", "v", "_weight", "shift", "_k", "_u", "_v")


def _schema(rows: DataFrame, names, more) -> StructType:
    kinds = {f.name: f.dataType.elementType if isinstance(f.dataType, ArrayType) else f.dataType for f in rows.schema.fields}
    return StructType([StructField(c, kinds.get(c, DoubleType())) for c in names] + [StructField(t, DoubleType()) for t in more])


def daily_budget(daily: DataFrame, grid: DataFrame, weight: Column | None = None, made=None) -> DataFrame:
    """dadt, adv, div and res in percent a day. Velocities are filtered and dropped where concentration is under LEVEL; day i averages the terms of fields i, i+1 and i+2, of which the first two fields have none.

    daily: where it is on its grid (`on_grid`) and in tiles (`tiled`) its partitions are kept; else rows meet the grid here and are shuffled once, into tiles. Its rows are days, or stretches of days of a cell in which time, i, sic, u and v are lists.
    Each tile is worked out on arrays in one step, so no day is sorted or shuffled. weight: days that a field stands for (1, or the days of the month for monthly fields).
    made: where daily has no sic, u and v yet, what makes them in the tile's task of a function that gives its columns' values day by day.
    """
    rows = _in_tiles(daily, grid, weight, NEEDED)
    return rows.groupBy("dataset", "_tile").applyInArrow(lambda table: _Tile(table, made).days(), _schema(rows, KEPT, TERMS))


def budget_sums(daily: DataFrame, grid: DataFrame, by, values: dict, weight: Column | None = None, made=None) -> DataFrame:
    """Sums over `daily_budget` by columns of it, a row a tile and group: those of different tiles are still to be summed. values: by name, functions of arrays (sic, cell_area and the terms, NaN where missing). Only sums leave a tile, no days."""
    rows = _in_tiles(daily, grid, weight, NEEDED)
    return rows.groupBy("dataset", "_tile").applyInArrow(lambda table: _Tile(table, made).sums(by, values), _schema(rows, by, values))


def common_mask(rows: DataFrame, terms=TERMS) -> DataFrame:
    """Terms where all four are present."""
    ok = F.lit(True)
    for t in terms:
        ok = ok & F.col(t).isNotNull()
    return rows.withColumn("_ok", ok).withColumns({t: F.when(F.col("_ok"), F.col(t)) for t in terms}).drop("_ok")


def _ridging(f: dict) -> np.ndarray:
    """Ridging where concentration is over 90, the residual negative and the divergence positive."""
    return (f["sic"] > 90) & (f["res"] < -EPS) & (f["div"] > EPS)


#: For `budget_sums`: cells with ice, and those of them with ridging.
RIDGES = {"ridged": lambda f: ((f["sic"] >= LEVEL) & _ridging(f)).astype("float64"), "ice": lambda f: (f["sic"] >= LEVEL).astype("float64")}
#: For `budget_sums`: the terms themselves.
TOTALS = {t: lambda f, t=t: f[t] for t in TERMS}
#: For `budget_sums`: integrals over area of the terms' positive and negative parts and of the whole, in km2 for fractions.
INTEGRALS = {
    f"{t}_{n}": lambda f, t=t, ok=ok: np.where(ok(f[t]), f[t], np.nan) * f["cell_area"] / 1e6
    for t in TERMS
    for n, ok in (("pos", lambda x: x > 0), ("neg", lambda x: x < 0), ("net", lambda x: x == x))
}


def ridging_ratio(sums: DataFrame, keys) -> DataFrame:
    """sums of RIDGES by keys -> their ratio."""
    return sums.groupBy(*keys).agg(F.try_divide(F.sum("ridged"), F.nullif(F.sum("ice"), F.lit(0.0))).alias("ratio"))


def beside(rows: DataFrame, values, on, reference: str) -> DataFrame:
    """Rows of the other datasets with the reference's values of the same keys (_other), where it has a row; a dataset has one row a key. The rows are made once, which a join with themselves would do twice."""
    other = F.max(F.when(F.col("dataset") == reference, F.struct(*values))).over(Window.partitionBy(*on))
    return rows.withColumn("_other", other).where((F.col("dataset") != reference) & F.col("_other").isNotNull())


def paired(values) -> Column:
    """Array of (name, value, other) of values and of the reference's (`beside`)."""
    return F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("value"), F.col(f"_other.{n}").alias("other")) for n in values))


def component_summary(clim: DataFrame, reference: str = "obs1") -> DataFrame:
    """clim (dataset, y, x, cell_area, mo, terms in percent a month) -> (dataset, component, mean, corr, bias): mean and bias in 10^6 km2, averaged over the months, and the area-weighted correlation of the annual maps."""
    rows = beside(clim.select("dataset", "y", "x", "cell_area", "mo", *(F.expr(e).alias(n) for n, e in COMPONENTS.items())), list(COMPONENTS), ["y", "x", "mo"], reference)
    both = rows.select("dataset", "y", "x", "cell_area", "mo", F.explode(paired(COMPONENTS)).alias("c")).select("*", "c.*").drop("c").withColumnRenamed("name", "component")
    keys, total = ["dataset", "component"], lambda x: F.coalesce(F.sum(x * F.col("cell_area") / 1e6 / 100) / 1e6, F.lit(0.0))
    sums = both.groupBy(*keys, "mo").agg(total(F.col("value")).alias("m"), total(F.col("value") - F.col("other")).alias("b")).groupBy(*keys).agg(F.avg("m").alias("mean"), F.avg("b").alias("bias"))
    maps = both.groupBy(*keys, "y", "x", "cell_area").agg(F.avg("value").alias("value"), F.avg("other").alias("other"))
    return area_correlation(maps, "other", "value", "cell_area", keys, 2).withColumnRenamed("value", "corr").join(sums, keys, "right")


def term_differences(clim: DataFrame, reference: str = "obs1", terms=TERMS) -> DataFrame:
    """clim as above -> (dataset, term, season, bias, mae, rmse) of the season sums, area-weighted, and under season `annual` their mean weighted with the seasons' days."""
    rows = clim.groupBy("dataset", "y", "x", "cell_area", cal.season(F.col("mo")).alias("season")).agg(*(F.sum(t).alias(t) for t in terms))
    rows = beside(rows, terms, ["y", "x", "season"], reference)
    both, w = rows.select("dataset", "season", "cell_area", F.explode(paired(terms)).alias("c")).select("*", "c.*").withColumnRenamed("name", "term"), F.col("cell_area")
    out = both.groupBy("dataset", "term", "season").agg(*(f(F.col("value"), F.col("other"), w).alias(n) for n, f in (("bias", bias), ("mae", mae), ("rmse", rmse))))
    days = F.element_at(F.create_map(*[F.lit(x) for kv in cal.SEASON_DAYS.items() for x in kv]), F.col("season"))
    year = out.groupBy("dataset", "term").agg(*(weighted_mean(F.col(n), days).alias(n) for n in ("bias", "mae", "rmse"))).withColumn("season", F.lit("annual"))
    return out.unionByName(year)
