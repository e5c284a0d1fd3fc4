"""Shared pieces: tables in the shared folder, and connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nilas.llm.text import mix
from nilas.sources.files import shared_folder

#: Links that one task takes in at once (16 bytes each).
LINKS_PER_TASK = 1_000_000


BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python once an application, wherever they run, and keeps the batches that Spark hands them small: rows may carry whole texts."""
    context = spark.sparkContext
    if int(spark.conf.get(BATCH, "10000")) > BATCH_ROWS:
        spark.conf.set(BATCH, str(BATCH_ROWS))
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[2]
        archive = Path(tempfile.mkdtemp(prefix="spark-")) / "nilas.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(root.glob("nilas/**/*.py")):
                out.write(path, path.relative_to(root))
        context.addPyFile(str(archive))  # the driver serves it to the executors
        _shipped.add(context.applicationId)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: lineage ends here."""
    path = new_path(df.sparkSession, label)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what is no longer referred to; it does so when the driver collects garbage, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(*tables: DataFrame) -> None:
    """Deletes tables of `saved` that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def renamed(df: DataFrame, *own: str) -> tuple[DataFrame, list[str]]:
    """df with its columns other than `own` called c0, c1, ..., so that helper columns clash with none, and the names that all columns had."""
    return df.toDF(*(c if c in own else f"c{i}" for i, c in enumerate(df.columns))), df.columns


#: Bits of the filters that pick rows by a hash, fixed for any input.
FILTER_BITS = 1 << 23


def _bits(batches):
    bits = np.zeros(FILTER_BITS, bool)
    for batch in batches:
        bits[_places(batch.column(0))] = True
    whole = np.packbits(bits, bitorder="little")
    at = np.flatnonzero(whole)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(whole[at].astype(np.int64))], names=["at", "byte"])


def _places(keys: pa.Array) -> np.ndarray:
    return (mix(keys.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def key_filter(keys: DataFrame):
    """A broadcast bit map with the hashes of all keys, a column of longs: 1 MB whatever the input. Keys that it lets pass beside them only cost time."""
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    found = keys.mapInArrow(_bits, "at long, byte long").groupBy("at").agg(F.bit_or("byte").alias("byte")).toArrow()  # a row a byte at most, in one job
    bits[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return keys.sparkSession.sparkContext.broadcast(bits.tobytes())


def passing(batch: pa.RecordBatch, name: str, bits: bytes, passes: bool = True) -> pa.RecordBatch:
    """The rows whose key passes the filter, or those whose key doesn't."""
    at, known = _places(batch.column(batch.schema.get_field_index(name))), np.frombuffer(bits, np.uint8)
    return batch.filter(pa.array(((known[at >> 3] >> (at & 7)) & 1 == 1) == passes))


#: A labelled text that is longer is learned from by so many parts of so many code points, chosen by hash.
PARTS, PART = 12, 8000


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, label) of at most `rows` labelled documents, in the order of the hash of their doc_id, in one partition: rows and length of each are bounded.

    labels: (doc_id, label). Of texts over PARTS * PART code points PARTS parts are taken. Repeated documents and labels count once.
    """
    chosen = labels.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    parts = F.transform(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)), lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x")))
    text = F.array_join(F.transform(F.slice(F.array_sort(parts), 1, PARTS), lambda x: x["x"]), " ")
    text = F.when(F.length("text") > PARTS * PART, text).otherwise(F.coalesce("text", F.lit("")))
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", text.alias("text"))
    own = own.groupBy("doc_id", "label").agg(F.min("text").alias("text")).withColumn("order", F.xxhash64("doc_id"))
    return own.repartition(1).sortWithinPartitions("order", "doc_id", "label").select("text", "label")


def held_texts(batches, total: int):
    """Texts and labels of `labelled_sample` up to `total` bytes."""
    texts, labels, size = [], [], 0
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            size += len(text.encode())
            if size <= total or not texts:
                texts.append(text)
                labels.append(label)
    return texts, labels


def _local_forest(batches):
    """Union-find over the links of one task; gives (node, root), root the smallest node reached."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(p, p)
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = np.fromiter(parent, np.int64, len(parent))
    roots = np.fromiter((root(x) for x in nodes.tolist()), np.int64, len(nodes))
    other = nodes != roots
    nodes, roots = nodes[other], roots[other]
    for i in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(roots[i : i + 100_000])], names=["node", "root"])


def components(links: DataFrame, links_per_task: int = LINKS_PER_TASK) -> DataFrame:
    """links (a, b: long) -> (node, component): the smallest node each linked node reaches.

    Every round builds a spanning forest inside each task, lets each node point at
    its smallest neighbour and contracts; links of a tree at least halve. A round whose
    links fit one task ends it. Nodes that are their own component are left out.
    """
    links = saved(links.where("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b"), "links")
    steps = []
    while (n := links.count()) or not steps:
        parts = max(1, -(-n // links_per_task))
        stars = links.repartition(parts).mapInArrow(_local_forest, "node long, root long")
        if parts == 1:
            steps.append(saved(stars.select("node", F.col("root").alias("up")), "up"))
            break
        stars = saved(stars, "stars")
        up = saved(stars.groupBy("node").agg(F.min("root").alias("up")), "up")
        steps.append(up)
        mapped = stars.join(up, "node").join(up.select(F.col("node").alias("root"), F.col("up").alias("up_root")), "root", "left")
        links = saved(mapped.selectExpr("up AS a", "coalesce(up_root, root) AS b").where("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct(), "links")
    labels = None
    for up in steps:
        if labels is None:
            labels = up.select("node", F.col("up").alias("component"))
            continue
        later = up.select(F.col("node").alias("component"), "up")
        moved = labels.join(later, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        new = up.join(labels, "node", "left_anti").select("node", F.col("up").alias("component"))
        labels = moved.unionByName(new)
    return labels
