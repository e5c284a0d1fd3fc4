"""Benchmark decontamination by size-partitioned MinHash containment search.

Documents and items fall into classes of size (powers of two). For each pair of classes the containment
threshold fixes how many bins a one-permutation MinHash needs so that an item contained to the threshold shares a
bin's minimum with its document but for a chance of MISS: the longer the document and the shorter the item, the more bins. Bins in common give
candidates; each is verified by the exact share of the item's shingles that the document has.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nilas.llm import text as t

U = np.uint64
MISS = 1e-12
#: Words of items whose index is broadcast at once (8 bytes each for every number of bins in use); more items go in further passes.
BLOCK_WORDS = 1_000_000


def bits_for(document: int, item: int, threshold: float) -> int:
    """log2 of the bins for documents of up to 2**document shingles and items of at least 2**item."""
    shared = max(1, math.ceil(threshold * 2**item))
    hit = 1 - MISS ** (1 / shared)  # chance that a shared shingle is its bin's minimum
    load = 2.0
    while load > 2**-40 and -math.expm1(-load) / load < hit:
        load /= 2
    return min(64, max(0, document - round(math.log2(load))))


def _minima(tokens: np.ndarray, owner: np.ndarray, bits: int) -> np.ndarray:
    """Positions of the least token of each bin; tokens are sorted for each owner."""
    bins = tokens >> U(64 - bits) if bits else np.zeros(len(tokens), U)
    first = np.ones(len(tokens), bool)
    first[1:] = (bins[1:] != bins[:-1]) | (owner[1:] != owner[:-1])
    return np.flatnonzero(first)


class Index:
    """Sorted shingle sets of some items, and for each number of bins in use their minima."""

    def __init__(self, ids: list, sets: list[np.ndarray]):
        self.ids, self.sets, self.minima = ids, sets, {}
        self.level = np.array([max(0, len(s).bit_length() - 1) for s in sets], int)

    def of(self, level: int, bits: int):
        if (level, bits) not in self.minima:
            own = [i for i in np.flatnonzero(self.level == level) if len(self.sets[i])]
            tokens = np.concatenate([self.sets[i] for i in own]) if own else np.zeros(0, U)
            owner = np.repeat(own, [len(self.sets[i]) for i in own]).astype(np.int64)
            at = _minima(tokens, owner, bits)
            at = at[np.argsort(tokens[at], kind="stable")]
            self.minima[level, bits] = tokens[at], owner[at]
        return self.minima[level, bits]

    def search(self, tokens: np.ndarray, begin: np.ndarray, threshold: float):
        """Texts' sorted sets, one after the other -> rows (text, item, shared)."""
        size = np.diff(begin)
        level = np.array([max(0, int(n - 1).bit_length()) if n else -1 for n in size])
        found = []
        for c in np.unique(level[level >= 0]):
            own = np.flatnonzero(level == c)
            part = np.concatenate([tokens[begin[i] : begin[i + 1]] for i in own])
            owner = np.repeat(own, size[own])
            for k in np.unique(self.level):
                bits = bits_for(int(c), int(k), threshold)
                keys, items = self.of(int(k), bits)
                at = _minima(part, owner, bits)
                lo, hi = np.searchsorted(keys, part[at], "left"), np.searchsorted(keys, part[at], "right")
                n = hi - lo
                if n.any():
                    text = np.repeat(owner[at], n)
                    found.append(np.stack([text, items[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]], 1))
        out = []
        for text, item in np.unique(np.concatenate(found), axis=0) if found else ():
            own, want = tokens[begin[text] : begin[text + 1]], self.sets[item]
            at = np.searchsorted(own, want)
            shared = int((own[np.minimum(at, len(own) - 1)] == want).sum())
            if shared >= threshold * len(want) - 1e-9:
                out.append((int(text), int(item), shared))
        return out


def _sets(col: pa.Array, words: int):
    hashes, at = t.words(*t.buffers(col))
    runs, at = t.shingles(hashes, at, words, short=False)
    sets = [np.unique(runs[at[i] : at[i + 1]]) for i in range(len(col))]
    return sets, np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def _search(index, words: int, threshold: float, names: list[str] | None):
    def run(batches):
        known = Index(*index.value)
        for batch in batches:
            for part in t.slices(batch, "text"):
                sets, begin = _sets(t.column(part, "text"), words)
                hits = known.search(np.concatenate(sets) if sets else np.zeros(0, U), begin, threshold)
                if names is not None:
                    clean = np.ones(part.num_rows, bool)
                    clean[[h[0] for h in hits]] = False
                    yield part.filter(pa.array(clean)).select(names)
                elif hits:
                    ids = part.column(part.schema.get_field_index("doc_id")).take(pa.array([h[0] for h in hits]))
                    n = [len(known.sets[h[1]]) for h in hits]
                    shared = [h[2] for h in hits]
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([known.ids[h[1]] for h in hits], pa.int64()), pa.array(n, pa.int64()), pa.array(shared, pa.int64()), pa.array([s / m for s, m in zip(shared, n, strict=True)])],
                        names=["doc_id", "item_id", "item_shingles", "shared", "containment"],
                    )

    return run


def _indexes(items: DataFrame, words: int, block_words: int):
    """The items' shingle sets, a bounded block of items at a time."""
    items = items.select("item_id", "text").where("text IS NOT NULL").distinct()
    sized = items.withColumn("n", F.size(F.split("text", r"[\x20\x09-\x0D]+")))
    blocks = max(1, -(-(sized.agg(F.sum("n")).first()[0] or 0) // block_words))
    for k in range(blocks):
        table = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow().combine_chunks()
        ids, sets = [], []
        for batch in table.to_batches():
            ids += batch.column(0).to_pylist()
            sets += _sets(t.column(batch, "text"), words)[0]
        yield items.sparkSession.sparkContext.broadcast((ids, sets))


def contaminated(docs: DataFrame, items: DataFrame, words: int = 5, threshold: float = 0.8, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment) for each document that has at least `threshold` of an item's shingles.

    Shingles of `words` lower-cased words, anywhere in the document. Null and empty texts, and items and documents with fewer words
    than a shingle, match nothing; a repeated document gives its rows again, repeated items count once. Items go in blocks of
    about block_words words, so what is broadcast is bounded; every block is searched over all documents.
    """
    docs = docs.select("doc_id", "text")
    kinds = "doc_id long, item_id long, item_shingles long, shared long, containment double"
    found = [docs.mapInArrow(_search(index, words, threshold, None), kinds) for index in _indexes(items, words, block_words)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, words: int = 5, threshold: float = 0.8, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that `contaminated` doesn't name, with all their columns; no shuffle."""
    for index in _indexes(items, words, block_words):
        docs = docs.mapInArrow(_search(index, words, threshold, docs.columns), docs.schema)
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SHINGLES = r"""SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM
(SELECT {id} AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {table}) WHERE len(w) >= 5"""
SQL = f"""
WITH b AS ({_SHINGLES.format(id="item_id", table="benchmark")}), d AS ({_SHINGLES.format(id="doc_id", table="documents")}),
n AS (SELECT id, count(*) AS n FROM b GROUP BY 1)
SELECT d.id AS doc_id, b.id AS item_id, n.n AS item_shingles, count(*) AS shared, count(*) / CAST(n.n AS DOUBLE) AS containment
FROM d JOIN b USING (g) JOIN n ON n.id = b.id GROUP BY 1, 2, 3 HAVING count(*) >= 0.8 * n.n - 1e-9
"""
