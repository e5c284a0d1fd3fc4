"""Gridded fields derived from the given tables, as DataFrames and as SQL.

field (dataset, time, yr, mo, y, x, sic, u, v, thick) is monthly and spans the line items, daily fields span the orders. The grid has eight columns and, for
each 2000 parts, six rows: cells and the fields on them grow with the tables.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nilas.operators.budget import on_grid, tiled

#: Region codes of the southern sectors. All is every region over 0.
SECTORS = (("All", (1, 2, 3, 4, 5, 6)), ("Weddell", (1,)), ("West Indian", (2,)), ("East Indian", (3,)), ("Ross", (4,)), ("AB", (5,)))
#: Region codes of the northern sectors.
NORTHERN = (("CA", (1,)), ("CBS", (2, 3)), ("LESS", (4, 5)), ("KBS", (6, 7)), ("EG", (8,)), ("HBB", (9, 11)), ("CAA", (12,)), ("Other", (13, 14, 15, 17, 18)))
ENSEMBLE = (("ALL", "model_a"), ("ALL", "model_b"), ("A", "model_a"))
TERMS = ("dyn", "growth", "melt", "snow")
#: Datasets of the daily fields, and by how many days each is late.
SHIFTS = (("obs1", 0), ("obs2", 6), ("model_a", 15))
#: Columns of the grid, and the parts for which it has ROWS rows.
COLUMNS, ROWS, PARTS = 8, 6, 2000
#: Daily series that one task makes; each is as long as the orders' calendar.
SERIES = 128


def cell(key: Column, ny: int) -> dict[str, Column]:
    return {"x": (key % COLUMNS).cast("int"), "y": (F.floor(key / float(COLUMNS)).cast("long") % ny).cast("int")}


class Views:
    """Lazy views over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def ny(self) -> int:
        """Rows of the grid, from the largest part key."""
        return ROWS * max(1, ((self.table("part").agg(F.max("p_partkey")).first()[0] or 0) + 1) // PARTS)

    @cached_property
    def months(self) -> int:
        """Months from the first line item to the last."""
        first, last = self.table("lineitem").agg(F.min("l_shipdate"), F.max("l_shipdate")).first()
        return (last.year - first.year) * 12 + last.month - first.month + 1 if first else 0

    @property
    def half(self) -> int:
        """More than half of the months."""
        return self.months // 2 + 1

    @cached_property
    def _lines(self) -> DataFrame:
        """Line items with their dataset, month, cell and term."""
        dataset = F.when(F.col("l_returnflag") == "R", "obs1").when(F.col("l_returnflag") == "A", "obs2").when(F.col("l_linestatus") == "O", "model_a").otherwise("model_b")
        place = cell(F.col("l_partkey"), self.ny)
        return self.table("lineitem").select(dataset.alias("dataset"), F.trunc("l_shipdate", "month").alias("time"), *(c.alias(n) for n, c in place.items()), (F.col("l_linenumber") % 4).cast("int").alias("k"), "l_quantity")

    @staticmethod
    def _sums(lines: DataFrame) -> DataFrame:
        """Monthly sums of quantity by dataset, cell and term."""
        return lines.groupBy("dataset", "time", "x", "y", "k").agg(F.sum("l_quantity").cast("long").alias("s"), F.count("*").alias("n"))

    @staticmethod
    def _fields(sums: DataFrame) -> DataFrame:
        t = sums.groupBy("dataset", "time", "x", "y").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        s, n = F.col("s"), F.col("n")
        return t.select(
            "dataset", "time", F.year("time").alias("yr"), F.month("time").alias("mo"), "x", "y",
            ((s * 37 + n * 11) % 101).cast("double").alias("sic"), (((s * 7) % 41 - 20) / 100.0).alias("u"), (((s * 13 + n) % 41 - 20) / 100.0).alias("v"), (((s * 5) % 40) / 10.0).alias("thick"),
        )

    @cached_property
    def _monthly_sums(self) -> DataFrame:
        return self._sums(self._lines)

    @cached_property
    def field(self) -> DataFrame:
        """Monthly fields: concentration (percent), drift (m/s), thickness (m). Gaps stay gaps."""
        return self._fields(self._monthly_sums)

    @cached_property
    def field_of_cells(self) -> DataFrame:
        """As field. Line items are dealt out to the cells once and summed there, so that a cell's months lie in one partition and no sum is shuffled."""
        return self._fields(self._sums(self._lines.repartition(-(-COLUMNS * self.ny // SERIES), "x", "y")))

    @cached_property
    def flux(self) -> DataFrame:
        """Monthly mass fluxes by term, kg/m2/s."""
        name = F.element_at(F.array(*map(F.lit, TERMS)), F.col("k") + 1)
        return self._monthly_sums.select("dataset", "time", F.year("time").alias("yr"), F.month("time").alias("mo"), "x", "y", name.alias("term"), (((F.col("s") * 17 + F.col("n")) % 201 - 100) * 1e-7).alias("value"))

    @cached_property
    def cells(self) -> DataFrame:
        return self.table("part").select(*(c.alias(k) for k, c in cell(F.col("p_partkey"), self.ny).items())).distinct()

    @cached_property
    def grid(self) -> DataFrame:
        """lon, lat, cell_area (m2), ocean and region of each cell."""
        x, y = F.col("x"), F.col("y")
        return self.cells.select("x", "y", (5.0 * x).alias("lon"), (65.0 + 12.0 * y / self.ny).alias("lat"), (2.5e9 + 1e8 * ((3 * x + 5 * y) % 7)).alias("cell_area"), F.lit(1).alias("ocean"), (1 + (x + 2 * y) % 6).alias("region"))

    @cached_property
    def days(self) -> DataFrame:
        """Every day from the first order to the last, numbered from 0."""
        ends = self.table("orders").agg(F.to_date(F.min("o_orderdate")).alias("first"), F.to_date(F.max("o_orderdate")).alias("last")).where("first IS NOT NULL")
        return ends.select("first", F.explode(F.sequence("first", "last")).alias("time")).select("time", F.datediff("time", "first").cast("long").alias("i"))

    @property
    def parts(self) -> int:
        """Partitions of the daily fields of three datasets: the number follows the grid, as the rows of a partition grow many times after its shuffle."""
        return -(-3 * COLUMNS * self.ny // SERIES)

    @cached_property
    def _drifts(self) -> DataFrame:
        """Cells by dataset (and its shift) with the drift of their months, a map of as many entries as there are months. Line items are dealt out to the cells once, and summed there."""
        keys = ["dataset", "x", "y"]
        lines = self._lines.where(F.col("dataset").isin([d for d, _ in SHIFTS])).repartition(self.parts, *keys)
        drift = self._fields(self._sums(lines)).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("time", F.struct("u", "v")))).alias("_drift"))
        shift = self.spark.createDataFrame(list(SHIFTS), "dataset string, shift int")
        return self.cells.crossJoin(F.broadcast(shift)).repartition(self.parts, *keys).join(drift, keys, "left")  # datasets are three

    def _months(self, cells: DataFrame) -> DataFrame:
        """Cells (with their drift) by month: the month's drift (_at) and its days (_days: time, i and the noise k). Made after the cells are dealt out: no row of a month or day is shuffled, and those of a cell stay in its partition."""
        noise = self.table("orders").groupBy(F.to_date("o_orderdate").alias("time")).agg((F.count("*") % 11).alias("k"))
        days = self.days.join(noise, "time", "left").groupBy(F.trunc("time", "month").alias("_month")).agg(F.sort_array(F.collect_list(F.struct("time", "i", F.coalesce("k", F.lit(0)).alias("k")))).alias("_days"))
        months = self.days.select(F.trunc("time", "month").alias("_month")).distinct()
        rows = cells.crossJoin(F.broadcast(months))  # months are a few hundred
        rows = rows.withColumn("_at", F.try_element_at("_drift", F.col("_month"))).drop("_drift")
        return rows.join(F.broadcast(days), "_month")  # a list of days a month

    @staticmethod
    def _values(day: Column) -> dict[str, Column]:
        """sic, u and v of a row of `_months` on one of its days."""
        i, k, x, y = day["i"], day["k"], F.col("x"), F.col("y")
        wave = F.abs((i + 9 * x + 5 * y + F.col("shift")) % 365 - 182) - 50 + k
        return {
            "sic": F.greatest(F.lit(0), F.least(F.lit(100), wave)).cast("double"),
            "u": 0.5 * F.coalesce("_at.u", F.lit(0.0)) + ((i * 7 + x * 3 + y * 5 + k) % 41 - 20) / 200.0,
            "v": 0.5 * F.coalesce("_at.v", F.lit(0.0)) + ((i * 5 + x * 11 + y * 2 + 3 * k) % 41 - 20) / 200.0,
        }

    def _daily(self, cells: DataFrame) -> DataFrame:
        """Daily rows of cells."""
        rows = self._months(cells).withColumn("_day", F.explode("_days"))
        return rows.select(
            "dataset", "_day.time", F.year("_day.time").alias("yr"), F.month("_day.time").alias("mo"), "_day.i", "x", "y", *(c.alias(n) for n, c in self._values(F.col("_day")).items()),
            *(c for c in cells.columns if c not in ("x", "y", "dataset", "shift", "_drift")),
        )

    def _stretches(self, cells: DataFrame) -> DataFrame:
        """The daily rows of a cell's month as one row, in which time, i, sic, u and v are lists."""
        of_days = lambda n: F.transform("_days", lambda day: self._values(day)[n])
        return self._months(cells).select(
            "dataset", F.col("_days.time").alias("time"), F.year("_month").alias("yr"), F.month("_month").alias("mo"), F.col("_days.i").alias("i"), "x", "y", *(of_days(n).alias(n) for n in ("sic", "u", "v")),
            *(c for c in cells.columns if c not in ("x", "y", "dataset", "shift", "_drift")),
        )

    @cached_property
    def daily(self) -> DataFrame:
        """Daily concentration and drift of three datasets over all days of the orders, without gaps. Half of the drift is the month's, where line items give one."""
        return self._daily(self._drifts)

    @cached_property
    def months_of_days(self) -> DataFrame:
        """As daily, a month of a cell a row: time, i, sic, u and v are lists."""
        return self._stretches(self._drifts)

    @cached_property
    def daily_tiles(self) -> DataFrame:
        """The daily fields on their grid (`budget.on_grid`) and in tiles for stencils (`budget.tiled`): cells meet the grid and are dealt out to tiles before their days are made."""
        return self._daily(self._tiles)

    @cached_property
    def _tiles(self) -> DataFrame:
        return tiled(on_grid(self._drifts, self.grid)).repartition(self.parts, "dataset", "_tile")

    @cached_property
    def month_tiles(self) -> DataFrame:
        """As daily_tiles, a month of a cell a row: time, i and the noise _k are lists, of sic, u and v there is what `day_values` needs to make them inside a tile's task."""
        return self._months(self._tiles).select(
            "dataset", F.col("_days.time").alias("time"), F.year("_month").alias("yr"), F.month("_month").alias("mo"), F.col("_days.i").alias("i"), F.col("_days.k").alias("_k"), "x", "y", "shift",
            *(F.coalesce(f"_at.{c}", F.lit(0.0)).alias(f"_{c}") for c in "uv"), "sx", "sy", "cell_area", "region", "_tile",
        )

    @cached_property
    def sectors(self) -> DataFrame:
        return self.spark.createDataFrame([(s, r) for s, codes in SECTORS for r in codes], "sector string, region int")

    @cached_property
    def ensemble(self) -> DataFrame:
        return self.spark.createDataFrame(list(ENSEMBLE), "`group` string, member string")

    @cached_property
    def field_grid(self) -> DataFrame:
        return self.field.join(self.grid, ["x", "y"])


def day_values(at) -> dict[str, np.ndarray]:
    """`Views._values` on arrays, a value a day; at gives the columns of `month_tiles`."""
    i, k, x, y = (at(c).astype("int64") for c in ("i", "_k", "x", "y"))
    wave = np.abs(np.fmod(i + 9 * x + 5 * y + at("shift"), 365) - 182) - 50 + k
    return {
        "sic": np.clip(wave, 0, 100).astype("float64"),
        "u": 0.5 * at("_u") + (np.fmod(i * 7 + x * 3 + y * 5 + k, 41) - 20) / 200.0,
        "v": 0.5 * at("_v") + (np.fmod(i * 5 + x * 11 + y * 2 + 3 * k, 41) - 20) / 200.0,
    }


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


#: The views in SQL, to stand before a query; engines skip those that aren't used.
PRELUDE = f"""
WITH dims AS (SELECT {ROWS} * greatest(1, (coalesce(max(p_partkey), 0) + 1) // {PARTS}) AS ny FROM part),
span AS (SELECT min(date_trunc('month', l_shipdate)) AS first, max(date_trunc('month', l_shipdate)) AS last, datediff('month', min(l_shipdate), max(l_shipdate)) + 1 AS n FROM lineitem),
ts AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 'obs1' WHEN l_returnflag = 'A' THEN 'obs2' WHEN l_linestatus = 'O' THEN 'model_a' ELSE 'model_b' END AS dataset,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS time, CAST(l_partkey % {COLUMNS} AS INT) AS x, CAST(CAST(floor(l_partkey / {COLUMNS}.0) AS BIGINT) % (SELECT ny FROM dims) AS INT) AS y,
         CAST(l_linenumber % 4 AS INT) AS k, CAST(sum(l_quantity) AS BIGINT) AS s, count(*) AS n
  FROM lineitem GROUP BY 1, 2, 3, 4, 5),
field AS (
  SELECT dataset, time, CAST(year(time) AS INT) AS yr, CAST(month(time) AS INT) AS mo, x, y, CAST((s * 37 + n * 11) % 101 AS DOUBLE) AS sic,
         ((s * 7) % 41 - 20) / CAST(100 AS DOUBLE) AS u, ((s * 13 + n) % 41 - 20) / CAST(100 AS DOUBLE) AS v, ((s * 5) % 40) / CAST(10 AS DOUBLE) AS thick
  FROM (SELECT dataset, time, x, y, CAST(sum(s) AS BIGINT) AS s, CAST(sum(n) AS BIGINT) AS n FROM ts GROUP BY 1, 2, 3, 4)),
flux AS (
  SELECT dataset, time, CAST(year(time) AS INT) AS yr, CAST(month(time) AS INT) AS mo, x, y, (['dyn', 'growth', 'melt', 'snow'])[k + 1] AS term,
         ((s * 17 + n) % 201 - 100) * CAST(1e-7 AS DOUBLE) AS value FROM ts),
cells AS (SELECT DISTINCT CAST(p_partkey % {COLUMNS} AS INT) AS x, CAST(CAST(floor(p_partkey / {COLUMNS}.0) AS BIGINT) % (SELECT ny FROM dims) AS INT) AS y FROM part),
grid AS (
  SELECT x, y, CAST(5.0 * x AS DOUBLE) AS lon, CAST(65 AS DOUBLE) + CAST(12 AS DOUBLE) * y / (SELECT ny FROM dims) AS lat, CAST(2.5e9 + 1e8 * ((3 * x + 5 * y) % 7) AS DOUBLE) AS cell_area,
         1 AS ocean, CAST(1 + (x + 2 * y) % 6 AS INT) AS region FROM cells),
noise AS (SELECT CAST(o_orderdate AS DATE) AS dt, count(*) % 11 AS k FROM orders GROUP BY 1),
ends AS (SELECT CAST(min(o_orderdate) AS DATE) AS f, CAST(max(o_orderdate) AS DATE) AS l FROM orders),
days AS (SELECT time, CAST(time - f AS BIGINT) AS i FROM (SELECT f, CAST(unnest(generate_series(f, l, INTERVAL 1 DAY)) AS DATE) AS time FROM ends)),
shifts AS (SELECT * FROM (VALUES ('obs1', 0), ('obs2', 6), ('model_a', 15)) q(dataset, shift)),
daily AS (
  SELECT dataset, time, CAST(year(time) AS INT) AS yr, CAST(month(time) AS INT) AS mo, i, x, y,
         CAST(greatest(0, least(100, abs((i + 9 * x + 5 * y + shift) % 365 - 182) - 50 + coalesce(k, 0))) AS DOUBLE) AS sic,
         CAST(0.5 AS DOUBLE) * coalesce(fu, 0) + ((i * 7 + x * 3 + y * 5 + coalesce(k, 0)) % 41 - 20) / CAST(200 AS DOUBLE) AS u,
         CAST(0.5 AS DOUBLE) * coalesce(fv, 0) + ((i * 5 + x * 11 + y * 2 + 3 * coalesce(k, 0)) % 41 - 20) / CAST(200 AS DOUBLE) AS v
  FROM (SELECT days.time, i, cells.x, cells.y, shifts.dataset, shift, k, field.u AS fu, field.v AS fv FROM days CROSS JOIN cells CROSS JOIN shifts LEFT JOIN noise ON noise.dt = days.time
    LEFT JOIN field ON field.dataset = shifts.dataset AND field.time = CAST(date_trunc('month', days.time) AS DATE) AND field.x = cells.x AND field.y = cells.y)),
sectors AS (SELECT * FROM (VALUES {_values((s, r) for s, codes in SECTORS for r in codes)}) q(sector, region)),
ensemble AS (SELECT * FROM (VALUES {_values(ENSEMBLE)}) q("group", member)),
fieldg AS (SELECT * FROM field JOIN grid USING (x, y))
"""
