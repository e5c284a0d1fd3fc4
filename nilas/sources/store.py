"""The store of metric records that all modules write to, merged segments, and raw cubes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Version of the store's layout; records of another version are not read.
SCHEMA_VERSION = 1
PARTITIONS = ("hemisphere", "module", "dataset")
#: Columns whose type is the same for all modules, so that their files can be read as one table.
TYPES = {"hemisphere": "string", "module": "string", "dataset": "string", "sector": "string", "metric": "string", "period": "string", "time": "date", "y": "int", "x": "int", "value": "double", "mean": "double", "trend": "double", "p": "double"}


def publish(records: DataFrame, path: str, module: str, hemisphere: str = "south", whole: bool = False) -> None:
    """Writes a module's records (dataset, ...): the partitions of its datasets are replaced, all others stay. With `whole`, datasets of the module that the records lack go."""
    out = records.withColumns({"hemisphere": F.lit(hemisphere), "module": F.lit(module), "schema_version": F.lit(SCHEMA_VERSION)})
    out = out.withColumns({c: F.col(c).cast(TYPES[c]) for c in out.columns if c in TYPES})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)
    if whole:
        held = partitions(records.sparkSession, path).where((F.col("hemisphere") == hemisphere) & (F.col("module") == module))
        for r in held.join(records.select("dataset").distinct(), "dataset", "left_anti").collect():  # names of datasets
            _delete(records.sparkSession, "/".join([path, *(f"{c}={r[c]}" for c in PARTITIONS)]))


def partitions(spark: SparkSession, path: str) -> DataFrame:
    """The store's partitions. Their values are in the folders' names, so no record is read."""
    kinds = ", ".join(f"{c} string" for c in PARTITIONS)
    return spark.read.schema(f"schema_version int, {kinds}").parquet(path).select(*PARTITIONS).distinct()


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_store(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """All modules' records as one table: the columns are those that any module has, null for the others. Columns asked for that no module has are null too."""
    out = spark.read.option("mergeSchema", "true").parquet(path).where(F.col("schema_version") == SCHEMA_VERSION).drop("schema_version")
    out = out.withColumns({c: F.col(c).cast("string") for c in PARTITIONS})
    if columns:
        out = out.select(*(F.col(c) if c in out.columns else F.lit(None).cast(TYPES.get(c, "string")).alias(c) for c in columns))
    return out


def store_index(store: DataFrame) -> DataFrame:
    """What each module has: datasets, records, and the sorted names of the columns it fills."""
    own = [c for c in store.columns if c not in PARTITIONS]
    filled = store.groupBy("hemisphere", "module").agg(F.count_distinct("dataset").alias("datasets"), F.count("*").alias("records"), *(F.count(c).alias(c) for c in own))
    names = F.array_join(F.array_compact(F.array(*(F.when(F.col(c) > 0, F.lit(c)) for c in sorted(own)))), ",")
    return filled.select("hemisphere", "module", "datasets", "records", names.alias("filled"))


def merge_segments(segments: DataFrame, keys: list[str], time: str = "time", order: str = "segment", prefer: str = "first") -> DataFrame:
    """Rows of overlapping segments as one series: each key and time once, from the first segment (by `order`) that has it, or with prefer="last" from the last one.

    Values of a time come from one segment together. Rows repeated inside a segment count once: the smallest of them. Only the rows of one key and time meet, in partial aggregates.
    """
    values = [c for c in segments.columns if c not in (*keys, time, order)]
    row = F.struct(*values)
    pick = F.min(F.struct(order, row.alias("row"))) if prefer == "first" else F.max(F.struct(order, row.alias("row")))
    return segments.groupBy(*keys, time).agg(pick.alias("_own")).select(*keys, time, *(F.col(f"_own.row.{v}").alias(v) for v in values))


def write_raw_cubes(field: DataFrame, path: str, ny: int, nx: int, months: int = 12) -> None:
    """(year, month, y, x, value) -> a file of float32 a year, [month, x, y], missing cells NaN, in folders year=... ; four bytes follow that no reader looks at.

    A month's slab is put together by its own task, a file by one that joins its slabs. Months or cells outside are left out; of repeated cells the largest value counts.
    """

    def slab(key, cells):
        content = np.full(nx * ny, np.nan, "<f4")
        content[cells["x"].to_numpy() * ny + cells["y"].to_numpy()] = cells["value"].to_numpy()
        return pa.table({"year": pa.array([key[0].as_py()], pa.int32()), "month": pa.array([key[1].as_py()], pa.int32()), "slab": pa.array([content.tobytes()], pa.binary())})

    inside = field.where((F.col("month").between(1, months)) & (F.col("x").between(0, nx - 1)) & (F.col("y").between(0, ny - 1)))
    cells = inside.groupBy("year", "month", "y", "x").agg(F.max("value").cast("float").alias("value")).select(F.col("year").cast("int"), F.col("month").cast("int"), "y", "x", "value")
    parts = cells.groupBy("year", "month").applyInArrow(slab, "year int, month int, slab binary")
    empty = F.lit(np.full(nx * ny, np.nan, "<f4").tobytes())
    year = parts.groupBy("year").agg(F.map_from_entries(F.collect_list(F.struct("month", "slab"))).alias("slabs"))
    cube = F.concat(*(F.coalesce(F.col("slabs")[m], empty) for m in range(1, months + 1)))
    year.select("year", cube.cast("string").alias("value")).repartition("year").write.mode("overwrite").partitionBy("year").option("lineSep", "\n\n\n\n").text(path)


def read_cube_slabs(spark: SparkSession, path: str, ny: int, nx: int, months: int = 12) -> DataFrame:
    """Files of `write_raw_cubes`, or any whose path ends in four digits of the year before its extension -> (year, month, y, x, value). Files are cut into months, which are dealt out to tasks before they are unpacked."""
    size = 4 * nx * ny
    year = F.regexp_extract("path", r"(?:year=|[^/]*?)(\d{4})(?:/[^/]*|\.[^/.]*|)$", 1).cast("int")
    month = F.explode(F.sequence(F.lit(1), F.lit(months)))
    parts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(year.alias("year"), month.alias("month"), "content")
    parts = parts.select("year", "month", F.substring("content", (F.col("month") - 1) * size + 1, F.lit(size)).alias("slab")).repartition("year", "month")

    def unpack(batches):
        x, y = (a.ravel().astype(np.int32) for a in np.indices((nx, ny)))
        for batch in batches:
            for year, month, slab in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                value = np.frombuffer(slab, "<f4").astype(float)
                n = len(value)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, year, np.int32)), pa.array(np.full(n, month, np.int32)), pa.array(y[:n]), pa.array(x[:n]), pa.array(value, from_pandas=True)], names=["year", "month", "y", "x", "value"])

    return parts.mapInArrow(unpack, "year int, month int, y int, x int, value double")
