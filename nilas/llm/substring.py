"""Passages of words that also stand in an earlier document, found with compressed FM-indexes.

A window is a number of consecutive words. Every window has an anchor, the leftmost smallest (by hash) of the short word sequences in it, and windows that have one anchor occurrence in common are one
segment of text. Equal windows have equal anchors, so an index shard holds the segments of its share of the anchors, and a window needs no other shard: index and search are linear in the
input. Only anchors that occur in several documents go into an index. Of anchors with very many segments each window goes apart, by its own hash, so that a
common passage with ever different surroundings is spread over all shards; equal segments are counted together by Spark before they are shuffled.

A shard's index is the run-length compressed Burrows-Wheeler transform of its segments, with a wavelet matrix over the heads of its runs. Suffixes are sorted by a window's words, so backward search is exact up to that depth.
Segments stream through it from their last word to their first, many at once: each step extends the match to the left by one rank, shortens it on the right when it has a window's length, and on failure until it can be extended. Where the
statistic reaches a window's length, the rows of the match tell the smallest id of the documents that hold the window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nilas.llm import text as t
from nilas.llm.bits import Wavelet
from nilas.llm.common import drop, release, saved

U = np.uint64
#: Words of a window and of an anchor, segments of an anchor from which on each window goes apart, bytes of segments in a shard.
WINDOW, ANCHOR, MANY, SHARD = 13, 5, 20_000, 8 << 20
#: Greater than any document's id.
NONE = np.iinfo(np.int64).max


class Index:
    """A compressed FM-index over words (numbers from 1; 0 stands behind each segment), exact for patterns of up to `depth` words."""

    def __init__(self, words: np.ndarray, depth: int = WINDOW):
        n, self.depth = len(words), depth
        self.classes = {}
        rank, size = np.unique(words, return_inverse=True)[1].astype(np.int64), 1
        ranks = {1: rank}
        while size < depth:  # ranks by the first 1, 2, 4 ... words; the last step overlaps
            step = min(size, depth - size)
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
            size += step
            ranks[size] = rank
        self.ranks = ranks
        self.order = np.argsort(rank, kind="stable")
        before = words[self.order - 1]
        new = np.ones(n, bool)
        new[1:] = before[1:] != before[:-1]
        self.starts = np.flatnonzero(new)  # of runs
        self.heads = before[self.starts]
        self.runs = Wavelet(self.heads)
        self.sizes = np.bincount(words, minlength=int(words.max()) + 2)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])  # rows that begin with a smaller word
        by = np.argsort(self.heads, kind="stable")  # runs of each word, and the lengths of those before them
        self.run_first = np.concatenate([[0], np.cumsum(np.bincount(self.heads, minlength=len(self.sizes)))])
        self.run_sums = np.concatenate([[0], np.cumsum(np.diff(np.append(self.starts, n))[by])])

    def rank(self, word: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each word stands before row i of the transform: whole runs by the wavelet matrix over their heads, and the part of the last one."""
        held = self.sizes[word] > 0
        word = np.where(held, word, 0)
        run = np.searchsorted(self.starts, i, "right") - 1
        inside = np.maximum(run, 0)
        k = self.run_first[word] + self.runs.rank(word, inside)
        whole = self.run_sums[k] - self.run_sums[self.run_first[word]]
        return np.where(held, whole + np.where((run >= 0) & (self.heads[inside] == word), i - self.starts[inside], 0), 0)

    def extend(self, word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the patterns with the word put before them."""
        return self.first[word] + self.rank(word, lo), self.first[word] + self.rank(word, hi)

    def rows(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each row: the first row of its class, those with the same first `depth` words; and of each class its first row, with the number of rows at the end."""
        if depth not in self.classes:
            size = max(k for k in self.ranks if k <= depth)
            key = self.ranks[size][self.order]
            after = np.minimum(self.order + depth - size, len(key) - 1)
            other = self.ranks[size][after]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (other[1:] != other[:-1])
            self.classes[depth] = np.cumsum(new) - 1, np.append(np.flatnonzero(new), len(key))
        return self.classes[depth]

    def shorten(self, lo: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the patterns' first `depth` words."""
        number, first = self.rows(depth)
        return first[number[lo]], first[number[lo] + 1]


def matching_statistics(index: Index, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of the streamed segments (at: where they begin) the length of the longest match that begins there, the index's depth at most, and the match's first row. Words that the index lacks have a number that it doesn't hold."""
    n, sizes = len(words), np.diff(at)
    length, row = np.zeros(n, np.int64), np.zeros(n, np.int64)
    by = np.argsort(-sizes, kind="stable")
    last, sizes = at[1:][by] - 1, sizes[by]
    lo, hi, held = np.zeros(len(by), np.int64), np.full(len(by), len(index.order)), np.zeros(len(by), np.int64)
    known = (words > 0) & (words < len(index.sizes) - 1)
    for step in range(int(sizes.max()) if len(sizes) else 0):
        active = int(np.searchsorted(-sizes, -step, "left"))  # segments with more than `step` words
        i = last[:active] - step
        word = np.where(known[i], words[i], len(index.sizes) - 1)
        full = np.flatnonzero(held[:active] == index.depth)
        lo[full], hi[full] = index.shorten(lo[full], index.depth - 1)
        held[full] -= 1
        left = np.arange(active)
        while len(left):
            a, b = index.extend(word[left], lo[left], hi[left])
            met = b > a
            done = left[met]
            lo[done], hi[done], held[done] = a[met], b[met], held[done] + 1
            left = left[~met]
            gone = left[held[left] == 0]  # the word occurs nowhere
            lo[gone], hi[gone] = 0, len(index.order)
            left = left[held[left] > 0]
            for depth in np.unique(held[left]):
                some = left[held[left] == depth]
                if depth == 1:
                    lo[some], hi[some] = 0, len(index.order)
                else:
                    lo[some], hi[some] = index.shorten(lo[some], int(depth) - 1)
                held[some] = depth - 1
        length[i], row[i] = held[:active], lo[:active]
    return length, row


def _anchors(words: np.ndarray, at: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of texts: hash of the anchor, row, first word (in all) and number of words."""
    n, wide, counts = len(words), window - anchor + 1, np.diff(at)
    if n < window:
        return np.zeros(0, np.int64), *(np.zeros(0, np.int64),) * 3
    grams = np.zeros(n - anchor + 1, U)
    for k in range(anchor):
        grams = t.mix(grams * U(0xD1342543DE82EF95) + words[k : n - anchor + 1 + k])
    best, place = grams[: n - window + 1].copy(), np.arange(n - window + 1)
    for k in range(1, wide):
        less = grams[k : n - window + 1 + k] < best
        best[less] = grams[k : n - window + 1 + k][less]
        place[less] = np.flatnonzero(less) + k
    row = np.repeat(np.arange(len(counts)), counts)
    inside = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])
    new = np.ones(len(inside), bool)
    new[1:] = (place[inside][1:] != place[inside][:-1]) | (row[inside][1:] != row[inside][:-1])
    first = inside[new]
    windows = np.diff(np.append(np.flatnonzero(new), len(inside)))
    return best[first].view(np.int64), row[first], first, windows + window - 1


def anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(anchor, doc_id, n): each document's anchors, and how many segments they have in it."""

    def run(batches):
        for batch in batches:
            for part in t.slices(batch, "text"):
                words, at = t.words(*t.buffers(t.column(part, "text")), lower=False)
                h, row, _, _ = _anchors(words, at, window, anchor)
                by = np.lexsort((h, row))
                h, row = h[by], row[by]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                first = np.flatnonzero(new)
                ids = part.column(part.schema.get_field_index("doc_id")).take(pa.array(row[first]))
                yield pa.RecordBatch.from_arrays([pa.array(h[first]), ids, pa.array(np.diff(np.append(first, len(h))))], names=["anchor", "doc_id", "n"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, "anchor long, doc_id long, n long")


def segments(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """docs (doc_id, key, text, shared, apart: sorted anchors) -> (route, doc_id, key, start, words): segments of shared anchors as text, those of anchors in `apart` as single windows."""

    def run(batches):
        for batch in batches:
            for part in t.slices(batch, "text"):
                data, offsets = t.buffers(t.column(part, "text"))
                words, at, starts, ends = t.words(data, offsets, lower=False, bounds=True)
                h, row, first, size = _anchors(words, at, window, anchor)
                col = lambda name: part.column(part.schema.get_field_index(name))  # noqa: B023, E731
                wanted, parted = (col(c) for c in ("shared", "apart"))
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
                own = np.zeros(len(h), bool)
                single = np.zeros(len(h), bool)
                for i in range(part.num_rows):
                    mine = slice(bounds[i], bounds[i + 1])
                    own[mine] = np.isin(h[mine], np.array(wanted[i].values))
                    if len(parted[i]):
                        single[mine] = np.isin(h[mine], np.array(parted[i].values))
                h, row, first, size, single = (x[own] for x in (h, row, first, size, single))
                # windows apart
                n = np.where(single, size - window + 1, 1)
                each = np.repeat(np.arange(len(n)), n)
                first = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                size = np.where(single, window, size)[each]
                row, route = row[each], h[each]
                index = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
                text = t.rejoined(data, starts[index], ends[index], np.concatenate([[0], np.cumsum(size)]))
                if single.any():
                    apart = single[each]
                    sums = np.zeros(int(apart.sum()), U)
                    for k in range(window):
                        sums = t.mix(sums * U(0x9E3779B97F4A7C15) + words[first[apart] + k])
                    route[apart] = sums.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(route), col("doc_id").take(pa.array(row)), col("key").take(pa.array(row)), pa.array((first - at[row]).astype(np.int32)), text.cast(pa.string())], names=["route", "doc_id", "key", "start", "words"])

    return docs.select("doc_id", "key", "text", "shared", "apart").mapInArrow(run, "route long, doc_id long, key long, start int, words string")


def earliest(window: int):
    """Of a shard's different segments (words, least doc_id): for each of its windows the least id of all documents of the shard that hold it."""

    def run(batches):
        parts = list(batches)  # a shard's segments: SHARD bytes, or a little more
        table = pa.Table.from_batches(parts) if parts else None
        if table is None or not table.num_rows:
            return
        column = table.column("words").combine_chunks().cast(pa.large_string())
        ids = table.column("low").to_numpy()
        data, offsets = t.buffers(column.cast(pa.large_binary()))
        _, at, starts, ends = t.words(data, offsets, lower=False, bounds=True)
        bounds = np.append(np.stack([starts, ends], 1).ravel(), ends[-1]).astype(np.int64)  # words and the gaps between them
        each = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        number = each.dictionary_encode().indices.to_numpy()[::2].astype(np.int64) + 1  # words by their bytes
        size = np.diff(at)
        places = np.arange(len(number)) + np.repeat(np.arange(len(size)), size)
        words = np.zeros(len(number) + len(size), np.int64)
        words[places] = number
        index = Index(words, window)
        document = np.full(len(words), NONE)
        document[places] = np.repeat(ids, size)
        classes, first = index.rows(window)
        least = np.minimum.reduceat(document[index.order], first[:-1])
        length, row = matching_statistics(index, number, at)
        low = np.where(length == window, least[classes[row]], NONE)
        windows = size - window + 1
        own = np.arange(windows.sum()) + np.repeat(at[:-1] - (np.cumsum(windows) - windows), windows)
        lows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(windows)]).astype(np.int32)), pa.array(low[own]))
        step = 10_000
        for i in range(0, len(lows), step):
            yield pa.RecordBatch.from_arrays([column.slice(i, step).cast(pa.string()), lows.slice(i, step)], names=["words", "lows"])

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, many: int = MANY, shard_bytes: int = SHARD) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, key, marks): numbers of the words where windows begin that also begin in a document with a smaller doc_id.

    key is the hash of the text, which tells rows with one doc_id apart. Rows with a null doc_id come neither before nor after others and are left out.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    found = saved(anchors(docs, window, anchor), "anchors")
    counted = found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum("n").alias("n"))
    shared = counted.where("low < high").select("anchor", (F.col("n") > many).alias("many"))
    lists = found.select("anchor", "doc_id").join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("shared"), F.collect_set(F.when(F.col("many"), F.col("anchor"))).alias("apart"))
    lists = saved(lists, "lists")
    drop(found)
    release(spark)
    # much text that repeats itself: packed tightly, and without the hashes that later joins make of it
    cut = saved(segments(docs.join(lists, "doc_id"), window, anchor), "segments", "zstd")
    drop(lists)
    release(spark)
    size = cut.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    # least ids of equal segments are found before a shard gets them
    different = cut.groupBy("route", "words").agg(F.min("doc_id").alias("low"))
    shards = max(1, -(-int(size) // shard_bytes))
    lows = different.repartition(shards, "route").select("words", "low").mapInArrow(earliest(window), "words string, lows array<long>")
    keys = F.xxhash64("words").alias("k1"), F.xxhash64(F.lit(1), "words").alias("k2")
    lows = saved(lows.select(*keys, "lows"), "lows")
    release(spark)
    hits = cut.select(*keys, "doc_id", "key", "start").join(lows, ["k1", "k2"]).where("exists(lows, x -> x < doc_id)")
    marks = hits.select("doc_id", "key", F.expr("filter(transform(lows, (x, i) -> if(x < doc_id, start + i, null)), x -> x IS NOT NULL)").alias("marks"))
    marks = saved(marks.groupBy("doc_id", "key").agg(F.array_distinct(F.flatten(F.collect_list("marks"))).alias("marks")), "marks")
    drop(cut, lows)
    release(spark)
    return marks


def substring_dedup(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_words, spans (start, end: words that are removed, end exclusive) and kept (the other words, joined by one space).

    A word is removed if a window of `window` words that covers it also begins in a document with a smaller doc_id. Windows are judged on the texts as they are. Null and empty texts have no words, texts with less than a window's words lose none;
    rows with one doc_id don't remove each other's words, and rows without doc_id neither lose words nor remove others'. Other columns are left out. Texts of any length are taken whole.
    """

    def remove(batches):
        for batch in batches:
            for part in t.slices(batch, "text"):
                data, offsets = t.buffers(t.column(part, "text"))
                _, at, starts, ends = t.words(data, offsets, lower=False, bounds=True)
                marks = part.column(part.schema.get_field_index("marks"))
                change = np.zeros(len(starts) + 1, np.int64)
                begins = np.array(marks.flatten(), np.int64) + np.repeat(at[:-1], np.array(marks.value_lengths().fill_null(0), np.int64))
                np.add.at(change, begins, 1)
                np.add.at(change, begins + window, -1)
                gone = np.cumsum(change)[:-1] > 0
                kept = np.flatnonzero(~gone)
                edge = gone.copy()
                edge[1:] &= ~gone[:-1]
                edge[at[:-1][at[:-1] < len(gone)]] = gone[at[:-1][at[:-1] < len(gone)]]
                stop = gone.copy()
                stop[:-1] &= ~gone[1:]
                stop[at[1:][at[1:] > 0] - 1] = gone[at[1:][at[1:] > 0] - 1]
                edge, stop = np.flatnonzero(edge), np.flatnonzero(stop) + 1
                bounds = np.searchsorted(edge, at)
                row = at[:-1][np.searchsorted(bounds, np.arange(len(edge)), "right") - 1] if len(edge) else edge
                spans = pa.StructArray.from_arrays([pa.array(edge - row), pa.array(stop - row)], names=["start", "end"])
                spans = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), spans)
                text = t.rejoined(data, starts[kept], ends[kept], np.searchsorted(kept, at))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array(np.diff(at)), spans, text.cast(pa.string())], names=["doc_id", "n_words", "spans", "kept"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = repeated_windows(docs, window, **options)
    both = docs.withColumn("key", F.xxhash64("text")).join(marks, ["doc_id", "key"], "left").select("doc_id", "text", "marks")
    return both.mapInArrow(remove, "doc_id long, n_words long, spans array<struct<start: bigint, end: bigint>>, kept string")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM g),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS low FROM k),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM m CROSS JOIN range(13) r(j) WHERE low < doc_id),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS text, count(*) AS n FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i WHERE gone.i IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
