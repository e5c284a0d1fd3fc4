"""Sources and sinks: raw cubes, file manifests, metric tables."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Temporary folders by application, for sessions in one process that set no shared folder.
_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where that is unset, a temporary one, but only if Spark runs in this one process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master, application = spark.sparkContext.master, spark.sparkContext.applicationId
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if application not in _own_folders:  # the setting can't be changed in a running session
            _own_folders[application] = "file://" + tempfile.mkdtemp(prefix="spark-")
        folder = _own_folders[application]
    return folder.rstrip("/")


def kept(rows: DataFrame, name: str) -> DataFrame:
    """Rows written to a new folder of the shared one and read back: for what a query uses more than once and is dear to make."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def read_raw_cubes(spark: SparkSession, path: str, ny: int, nx: int, months: int = 12) -> DataFrame:
    """Yearly files (name ends with the year) of float32 cubes [month, x, y] -> (year, month, y, x, value), a task a file."""

    def unpack(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                cube = np.frombuffer(content, "<f4").reshape(months, nx, ny)
                m, x, y = (a.ravel() for a in np.indices(cube.shape))
                year = int("".join(c for c in name.rsplit("/", 1)[-1].rsplit(".", 1)[0] if c.isdigit())[-4:])
                yield pd.DataFrame({"year": year, "month": m + 1, "y": y, "x": x, "value": cube.ravel().astype(float)})

    out = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "year int, month int, y int, x int, value double")
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def vector_pair(field: DataFrame, u: str, v: str, keys) -> DataFrame:
    """u and v of a long field (var, value) side by side, where both exist."""
    side = lambda name: field.where(F.col("var") == name)
    return side(u).select(*keys, F.col("value").alias("u")).join(side(v).select(*keys, F.col("value").alias("v")), keys)


def unique_segments(files: DataFrame, segment: Column) -> DataFrame:
    """One file of each segment: no copy before copies, then the smallest name."""
    w = Window.partitionBy("segment").orderBy(F.col("name").rlike("(?i)copy|\\(\\d+\\)"), "name")
    return files.withColumn("segment", segment).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def paired_segments(u: DataFrame, v: DataFrame) -> DataFrame:
    """Files (segment, name) of u and v by equal segment; those left over by order."""
    same = u.select("segment", F.col("name").alias("u")).join(v.select("segment", F.col("name").alias("v")), "segment").select("u", "v")
    rank = lambda df, other: df.join(other.select("segment"), "segment", "left_anti").select("name", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("segment", "name")).alias("n"))  # noqa: E731  a manifest of file names
    rest = rank(u, v).withColumnRenamed("name", "u").join(rank(v, u).withColumnRenamed("name", "v"), "n").select("u", "v")
    return same.unionByName(rest)


def missing_months(field: DataFrame, keys, first: str | None = None, last: str | None = None) -> DataFrame:
    """Months from first to last, by default those that the whole field spans, that each key lacks."""
    span = field.agg(F.trunc(F.min("time"), "month").alias("_first"), F.trunc(F.max("time"), "month").alias("_last")).where("_first IS NOT NULL")
    low, high = F.to_date(F.lit(first)) if first else F.col("_first"), F.to_date(F.lit(last)) if last else F.col("_last")
    months = field.select(*keys).distinct().crossJoin(span).select(*keys, F.explode(F.sequence(low, high, F.expr("INTERVAL 1 MONTH"))).alias("time"))  # one row of ends
    return months.join(field.select(*keys, F.trunc("time", "month").alias("time")).distinct(), [*keys, "time"], "left_anti")


def sampling_interval(times: DataFrame, keys) -> DataFrame:
    """Largest step in days of each dataset's times, and whether it is daily or monthly."""
    w = Window.partitionBy(*keys).orderBy("time")
    steps = times.select(*keys, "time").distinct().withColumn("step", F.datediff("time", F.lag("time").over(w)))
    return steps.groupBy(*keys).agg(F.max("step").alias("step")).withColumns({"daily": F.col("step") <= 1, "monthly": F.col("step") <= 31})


def year_coverage(field: DataFrame, keys, first: int, last: int) -> DataFrame:
    return field.groupBy(*keys).agg(F.min("yr").alias("first"), F.max("yr").alias("last")).withColumn("covers", (F.col("first") <= first) & (F.col("last") >= last))


def write_metrics(metrics: DataFrame, path: str, partition=("dataset",)) -> None:
    metrics.write.mode("overwrite").partitionBy(*partition).parquet(path)


def write_json(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def write_csv(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").option("header", True).csv(path)
