"""Sharding by vector bin packing over bytes, tokens and rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nilas.llm.common import drop, renamed, saved

#: Bounds of what the driver places: bundles of small groups, and how small a group must be.
BUNDLES, SMALL, PIECES, SLOTS = 4096, 256, 64, 1024
DIMENSIONS = ("bytes", "tokens", "rows")


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """items (n, 3): shares of one shard's capacity. The shard of each item.

    Items go by falling size to the shard with room where the dot product of the item with the
    residual capacity is highest; then moves and swaps even out the first dimension.
    """
    at, room = np.zeros(len(items), np.int64), np.ones((shards, items.shape[1]))
    for i in np.lexsort((np.arange(len(items)), -items.sum(1))):
        score = room @ items[i]
        fits = (room >= items[i] - 1e-12).all(1)
        score = np.where(fits, score, score - 1e6) if fits.any() else score
        at[i] = int(score.argmax())
        room[at[i]] -= items[i]
    size = items[:, 0]
    load = np.bincount(at, size, shards)
    for _ in range(200):
        hi, lo = int(load.argmax()), int(load.argmin())
        gap = load[hi] - load[lo]
        inside, other = np.flatnonzero(at == hi), np.flatnonzero(at == lo)
        if gap <= 1e-9 or not len(inside):
            break
        give = np.concatenate([[0.0], size[other]])
        order = np.argsort(give, kind="stable")
        want = size[inside] - gap / 2  # what should come back for each
        k = np.clip(np.searchsorted(give[order], want), 1, len(give) - 1) if len(give) > 1 else np.zeros(len(inside), int)
        k = np.where(np.abs(give[order][k - 1] - want) <= np.abs(give[order][k] - want), k - 1, k) if len(give) > 1 else k
        shift = size[inside] - give[order][k]
        best = int(np.abs(shift - gap / 2).argmin())
        if not 1e-12 < shift[best] < gap - 1e-12:
            break
        at[inside[best]] = lo
        if order[k[best]]:
            at[other[order[k[best]] - 1]] = hi
        load = np.bincount(at, size, shards)
    return at


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """docs (doc_id, text, ...) with columns size, shard and slot added.

    size is the UTF-8 length plus 1; slot counts from 0 in each shard without gaps. Equal
    texts stay together unless their group alone exceeds a shard in some dimension; then
    it goes out in up to PIECES pieces, by the hash of doc_id. A null text has size 1 and
    counts as one group of its own; null or repeated ids are rows like others. An empty
    table gives no rows. Columns of docs called size, shard or slot are replaced; others may have any name. Rows of
    a shard are numbered by a bucket, doc_id, size and the hash of the text, so only rows with the same id and text may swap slots.

    Groups above 1/(SMALL * shards) of the total in some dimension (3 * SMALL * shards of them at
    most) are placed one by one, the others as BUNDLES bundles by hash: what the driver
    packs and broadcasts is bounded whatever the input.
    """
    docs, names = renamed(docs.drop("size", "shard", "slot"), "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    key = F.md5(F.concat(F.col("text").isNull().cast("string"), text))
    piece = F.pmod(F.xxhash64("doc_id"), F.lit(PIECES)).cast("int")
    sized = docs.withColumn("size", (F.octet_length(text) + 1).cast("long"))
    cells = saved_cells = saved(
        sized.select(key.alias("key"), piece.alias("piece"), "size", F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"))
        .groupBy("key", "piece").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")),
        "cells",
    )
    total = cells.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in DIMENSIONS)).first()
    over = lambda share: " OR ".join(f"{c} > {max(1.0, total[c]) * share!r}D" for c in DIMENSIONS)
    groups = cells.groupBy("key").agg(*(F.sum(c).alias(c) for c in DIMENSIONS))
    large = groups.where(over(1 / (SMALL * shards))).withColumn("split", F.expr(over(1 / shards)))
    large = saved(large.select("key", "split"), "large")
    cells = cells.join(F.broadcast(large), "key", "left").withColumns({
        "item": F.when(F.col("split").isNull(), F.pmod(F.xxhash64("key"), F.lit(BUNDLES)).cast("string")).otherwise(F.col("key")),
        "part": F.when(F.col("split"), F.col("piece")).otherwise(F.lit(-1)),
    })
    items = cells.groupBy("item", "part").agg(*(F.sum(c).alias(c) for c in DIMENSIONS)).orderBy("item", "part").collect()
    drop(saved_cells)
    weights = np.array([[r[c] for c in DIMENSIONS] for r in items], float).reshape(-1, 3) * shards / np.array([max(1, total[c]) for c in DIMENSIONS])
    spark: SparkSession = docs.sparkSession
    placed = spark.createDataFrame([(r["item"], r["part"], int(s)) for r, s in zip(items, place(weights, shards), strict=True)], "item string, part int, shard int")
    out = sized.withColumn("_key", key).join(F.broadcast(large.withColumnsRenamed({"key": "_key", "split": "_split"})), "_key", "left")
    out = out.withColumns({
        "_item": F.when(F.col("_split").isNull(), F.pmod(F.xxhash64("_key"), F.lit(BUNDLES)).cast("string")).otherwise(F.col("_key")),
        "_part": F.when(F.col("_split"), piece).otherwise(F.lit(-1)),
    })
    out = out.join(F.broadcast(placed.withColumnsRenamed({"item": "_item", "part": "_part"})), ["_item", "_part"]).drop("_key", "_split", "_item", "_part")
    return numbered(out.withColumn("_order", F.xxhash64("text"))).select(*docs.columns, "size", "shard", "slot").toDF(*names, "size", "shard", "slot")


def numbered(out: DataFrame) -> DataFrame:
    """Rows (doc_id, size, shard, _order, ...) with slot: SLOTS buckets of each shard are numbered apart and start where the one before ends."""
    out = out.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", F.lit(7), "size"), F.lit(SLOTS)).cast("int"))
    starts = out.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    starts = starts.select("shard", "_bucket", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("_n")).alias("_start"))
    row = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("doc_id", "size", "_order")) - 1
    # at most shards * SLOTS rows
    return out.withColumn("_row", row).join(F.broadcast(starts), ["shard", "_bucket"]).withColumn("slot", F.col("_row") + F.col("_start")).drop("_row", "_bucket", "_start")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the checksum comes first, so that texts needn't move with the rows
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", crc.alias("text_crc32"))
    return shard(docs, 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
