"""Periodic runs of words: stretches that repeat themselves with a period, and texts with the repeats taken out.

A run of period q and at least 2q words holds, inside its first q words, an aligned block of b words (b a power of two, 2b - 1 <= q <= 4b - 2)
that occurs again q words later. So each aligned block asks for its occurrences in the window that follows it: they are the successors of a
position among the values of the suffix array between the block's bounds, and a wavelet matrix over the suffix array finds them. A block that overlaps its next
occurrence by half has occurrences in arithmetic progressions, one for each stretch of the block's own period; a progression is
taken from its first occurrence and the length of its stretch. Distances are candidate periods, and the longest common extensions to both sides give
the run. Periods under 7, whose blocks would have less than four words, are compared word by word.

Many documents are handled at once: words of different documents never count as equal, so nothing crosses them. Work on a
document of n words is n log n at most; memory grows with the longest document.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nilas.llm import text as t
from nilas.llm.bits import Wavelet

U = np.uint64
#: Least words of a run, the level of the smallest blocks (four words), the largest period that is compared word by word.
LEAST, FIRST_LEVEL, SHORT = 12, 2, 6
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def suffixes(keys: np.ndarray, last: np.ndarray):
    """Suffix array by prefix doubling. For each level (the first 1, 2, 4 ... words) the rank of each position (where its group begins; -1 past the end), the
    size of each rank's group, and the positions in groups of several; only those are sorted again. last: where the position's document ends."""
    n, m = len(keys), np.arange(len(keys))
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    begins = np.concatenate([[True], ordered[1:] != ordered[:-1]])[:n]
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(begins, m, 0))
    levels, step, active = [], 1, m
    while len(active):
        counts = np.bincount(rank[active], minlength=n)
        active = active[counts[rank[active]] > 1]
        levels.append((rank, counts, active))
        after = active + step
        second = np.where(after < last[active], rank[np.minimum(after, n)], -1)
        by = np.argsort(rank[active] * (n + 1) + second + 1, kind="stable")
        a, first, second, k = active[by], rank[active[by]], second[by], m[: len(active)]
        begins = np.ones(len(a), bool)
        begins[1:] = first[1:] != first[:-1]
        group = np.maximum.accumulate(np.where(begins, k, 0))
        begins[1:] |= second[1:] != second[:-1]
        rank = rank.copy()
        rank[a] = first + np.maximum.accumulate(np.where(begins, k, 0)) - group
        order[first + k - group] = a
        step *= 2
    return order, levels


class Repeats:
    """Suffix ranks of words of many documents, longest common extensions, and successors of positions among a block's occurrences."""

    def __init__(self, words: np.ndarray, at: np.ndarray):
        counts = np.diff(at)
        document = np.repeat(np.arange(len(counts)), counts)
        self.first, last = at[:-1][document], at[1:][document]
        self.keys = t.mix(words * U(0x5851F42D4C957F2D) + t.mix(document.astype(U) + U(1)))
        order, levels = suffixes(self.keys, last)
        self.ranks, self.counts, self.active = zip(*levels, strict=True)
        again = np.zeros(len(words), bool)
        if len(levels) > FIRST_LEVEL:
            again[self.active[FIRST_LEVEL]] = True
        kept = again[order]
        self.place = np.concatenate([[0], np.cumsum(kept)])  # the suffix array is held for words that begin a block which occurs again
        self.occurrences = Wavelet(order[kept])

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words from i on that equal those from j on (i < j, one document)."""
        out = np.zeros_like(i)
        for k in range(len(self.ranks) - 1, -1, -1):
            out += (self.ranks[k][i + out] == self.ranks[k][j + out]).astype(np.int64) << k
        return out

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words before i that equal those before j."""
        out = np.zeros_like(i)
        for k in range(len(self.ranks) - 1, -1, -1):
            to = i - out - (1 << k)
            same = (to >= self.first[i]) & (self.ranks[k][np.maximum(to, 0)] == self.ranks[k][np.maximum(j - out - (1 << k), 0)])
            out += same.astype(np.int64) << k
        return out

    def blocks(self, k: int) -> np.ndarray:
        """Aligned blocks of 2 to the k words that occur again in their document."""
        i = self.active[k]
        return i[(i - self.first[i]) & ((1 << k) - 1) == 0]

    def next(self, k: int, block: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first occurrence of each block of level k at `least` or after, or -1."""
        rank = self.ranks[k][block]
        return self.occurrences.successor(self.place[rank], self.place[rank + self.counts[k][rank]], least)


def candidates(r: Repeats):
    """(block, period): all blocks and distances that may belong to a run of a period over SHORT."""
    for k in range(FIRST_LEVEL, len(r.ranks)):
        b, i = 1 << k, r.blocks(k)
        far = lambda i: i + 4 * b - 2  # noqa: B023, E731
        y = r.next(k, i, i + 1)
        near = (y >= 0) & (y <= far(i))
        i, y = i[near], y[near]
        own = np.where(y - i <= b // 2, y - i, 0)  # the block's own period, if it overlaps its next occurrence by half
        least, some = i + 2 * b - 1, own > 0
        # no run of a longer period lies within the stretch of the block's own period
        least[some] = np.maximum(least[some], y[some] + r.right(i[some], y[some]) - b + 1)
        while len(i):
            y = r.next(k, i, least)
            near = (y >= 0) & (y <= far(i))
            i, y, own = i[near], y[near], own[near]
            yield i, y - i
            least, some = y + 1, own > 0
            if some.any():
                s, p = y[some], own[some]
                end = s + p + r.right(s, s + p)  # of this occurrence's stretch
                more = np.minimum((end - b - s) // p, (far(i[some]) - s) // p)
                each = np.repeat(np.arange(len(s)), more)
                step = np.arange(len(each)) - np.repeat(np.cumsum(more) - more, more) + 1
                yield i[some][each], s[each] + step * p[each] - i[some][each]
                least[some] = end - b + 1


def runs(words: np.ndarray, at: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of every run of at least `least` words and two periods, by start and period. words: hashes, at: where each document's begin."""
    if not len(words):
        return (np.zeros(0, np.int64),) * 3
    r, none = Repeats(words, at), np.zeros(0, np.int64)
    found = [(none, none, none)]
    for q in range(1, min(SHORT, len(words) - 1) + 1):
        edge = np.diff(np.concatenate([[0], (r.keys[q:] == r.keys[:-q]).astype(np.int8), [0]]))
        found.append((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + q, q))
    for i, q in candidates(r):
        found.append((i - r.left(i, i + q), i + q + r.right(i, i + q), q))
    s, e, q = (np.concatenate([np.broadcast_to(f[c], len(f[0])) for f in found]) for c in range(3))
    whole = e - s >= np.maximum(least, 2 * q)
    s, e, q = s[whole], e[whole], q[whole]
    # a period that isn't the smallest gives the same stretch as the smallest
    by = np.lexsort((q, e, s))
    s, e, q = s[by], e[by], q[by]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    s, e, q = s[new], e[new], q[new]
    by = np.lexsort((q, s))
    return s[by], e[by], q[by]


def periodic_runs(docs: DataFrame, least: int = LEAST, reorder: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_words, runs (start, length, period, by start and period) and collapsed: each run's words after its first period taken out, the others joined by one space.

    A null or empty text has no words and no runs; rows with null or repeated ids are rows like others, and further columns are left out. A text of any length is one piece of work.
    reorder: gives for a row's doc_id and number of words the words' new order as numbers of old ones, or None.
    """

    def find(batches):
        for batch in batches:
            for part in t.slices(batch, "text"):
                ids = part.column(part.schema.get_field_index("doc_id"))
                data, offsets = t.buffers(t.column(part, "text"))
                words, at, starts, ends = t.words(data, offsets, lower=False, bounds=True)
                if reorder:
                    new = [reorder(i, int(b - a)) for i, a, b in zip(ids.to_pylist(), at[:-1], at[1:], strict=True)]
                    if any(x is not None for x in new):
                        index = np.concatenate([np.arange(a, b) if x is None else x + a for x, a, b in zip(new, at[:-1], at[1:], strict=True)])
                        words, starts, ends = words[index], starts[index], ends[index]
                s, e, q = runs(words, at, least)
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, s + q, 1)
                np.add.at(gone, e, -1)
                kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
                text = t.rejoined(data, starts[kept], ends[kept], np.searchsorted(kept, at))
                bounds = np.searchsorted(s, at)
                row = at[:-1][np.searchsorted(bounds, np.arange(len(s)), "right") - 1] if len(s) else s
                each = pa.StructArray.from_arrays([pa.array(s - row), pa.array(e - s), pa.array(q)], names=["start", "length", "period"])
                listed = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), each)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(at)), listed, text.cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string")


def _planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The query's rule: one document in ten has its tail turned into a repetition."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), reorder=_planted)
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    # greatest length, then smallest start, then smallest period
    best = F.element_at(F.array_sort(F.transform("runs", lambda x: F.struct((-x["length"]).alias("l"), x["start"].alias("s"), x["period"].alias("p")))), 1)
    found = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.p").alias("period"),
        F.expr("1000 * -best.l div best.p").alias("exponent_milli"), F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
