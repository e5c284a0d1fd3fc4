"""N-gram Jaccard join over count vectors.

Each document is a set of word shingles. Shingles are hashed into groups; the group counts of a set are a
point, and the summed coordinate minima of two points bound the overlap of their sets. With only boxes to go by, a
tree over such points can't separate sets of like size (every box reaches over most of each coordinate), so the pages
of the tree are formed by an exact rule: two sets that differ in k shingles agree wholly in all but k groups, hence
with more than k groups a linked pair shares a page "size band, group, content of the group". Inside a page the
nodes of a packed R-tree hold the largest count of each coordinate and prune by the same bound; what survives is
bounded again by fine points, several groups a shingle of which only the low bit of each count is kept, and
verified on the shingles themselves.

Texts are read once: sets, points and pages go to the shared folder. Pages are counted by partial aggregation and equal
pages are kept once. A first pass ties each page to its smallest member and verifies those pairs, which joins most of a group of
copies in linear work. Further passes look only at pages that still hold several components: in each page every component
names its nearest pair to another one, first in a share of the pages, then in all; a last pass verifies all pairs
across components that the fine bound still allows. Pages over BLOCK members are cut into block pairs, none of them
inside a page's largest component.
No link between different sets is lost, and pairs inside a component are never listed.
"""

from __future__ import annotations

import functools
import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nilas.llm import text as t
from nilas.llm.common import components, drop, key_filter, passing, release, saved

U = np.uint64
#: Least number of coordinates of a point (a byte each), shingles a coordinate, members of a block and of a leaf node, largest count.
GROUPS, LOAD, BLOCK, LEAF, FULL = 64, 64, 2048, 64, 255
#: Groups a shingle of the fine points (a bit each) up to sets of FINE_FULL shingles; larger sets have at least as many groups, and one a shingle.
FINE, FINE_FULL = 4, 4096
#: Bytes of points compared at once, and bytes of points held at once.
CELLS, HELD = 512 << 10, 16 << 20
#: Members of the largest pages whose pairs are all compared at once, many pages together.
FEW = 16
#: Groups a set is hashed into for each one that the pigeonhole needs; only the strongest that it needs become pages.
SURPLUS = 1.25
#: Documents (chosen by hash) whose shingles tell which are common, and from how many of them on; this only ranks groups, it changes no result.
SAMPLE, COMMON = 4096, 8
#: Verified members of one page sent to one task beside its first.
SALTS = 64
#: Turns in which pages are counted, each with its share of the shuffled rows: a power of two, the low bits of a page tell its turn.
TURNS, TURN_BITS = 4, 2
#: Bits of the filter of pages that are kept for each page, and in all at most; bytes of a piece of it.
PER_PAGE, PAGE_BITS, CHUNK = 64, 1 << 27, 1 << 16
#: Passes over pages with several components: the share of pages (one in so many), and whether components only name their nearest pairs.
#: The last pass takes every page and every pair.
PASSES = ((8, True), (1, False))


class Bands:
    """Size bands and the number of groups each needs, for a Jaccard threshold num/den."""

    def __init__(self, num: int, den: int, width: float = 1.3):
        self.num, self.den, self.low = num, den, [1]
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * width)))
        differ = [2 * (hi - 1) * (den - num) // (den + num) for hi in self.low[1:]]
        self.pages = [k + 1 for k in differ]
        self.groups = [k + 1 if k == 0 else max(k + 2, int((k + 1) * SURPLUS)) for k in differ]

    def of(self, n: int) -> range:
        """Bands in which a set of n shingles can be the smaller or the larger of a linked pair."""
        return range(bisect_right(self.low, n) - 1, bisect_right(self.low, n * self.den // self.num))


def _needed(a, b, num: int, den: int):
    """Least overlap of linked sets with a and b shingles."""
    return -((-num * (a + b)) // (num + den))


def _pages(tokens: np.ndarray, bands: Bands, common: np.ndarray) -> np.ndarray:
    """Pages of a sorted set: of all groups the strongest, by tokens that aren't common and then by hash.

    Linked sets differ in at most k tokens, so all but k of their groups agree. In an order that depends on a group's
    content alone, the last of those that agree comes after all others that agree, so it is among the last k + 1 groups of both sets.
    """
    sums = np.concatenate([np.zeros(1, U), np.cumsum(t.mix(tokens), dtype=U)])
    rare = np.ones(len(tokens), bool)
    if len(common):
        rare = common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] != tokens
    rare = np.concatenate([[0], np.cumsum(rare)])
    out = []
    for band in bands.of(len(tokens)):
        groups = bands.groups[band]
        width = (1 << 64) // groups + 1
        at = np.searchsorted(tokens, np.arange(1, groups, dtype=U) * U(width) if groups > 1 else np.zeros(0, U))
        at = np.concatenate([[0], at, [len(tokens)]])
        content = t.mix(sums[at[1:]] - sums[at[:-1]]) ^ t.mix(np.arange(groups, dtype=U) + U(band << 40))
        strength = rare[at[1:]] - rare[at[:-1]]
        strongest = np.lexsort((content, strength))[-bands.pages[band] :]
        out.append(content[strongest])
    return t.mix(np.concatenate(out)).view(np.int64)


def _sets(batch: pa.RecordBatch, words: int):
    """Sorted distinct shingle hashes of each text in the batch."""
    hashes, at = t.words(*t.buffers(t.column(batch, "text")))
    runs, at = t.shingles(hashes, at, words)
    return [np.unique(runs[at[i] : at[i + 1]]) for i in range(batch.num_rows)]


def _size(n: int) -> int:
    """The power of two at or above n."""
    return 1 << max(0, n - 1).bit_length()


def _point(tokens: np.ndarray) -> bytes:
    """Counts of the groups. Their number is a power of two that grows with the set; groups fold into fewer by adding halves."""
    groups = max(GROUPS, _size(len(tokens) // LOAD))
    at = ((tokens >> U(8)) & U(groups - 1)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=groups), FULL).astype(np.uint8).tobytes()


def _fine(tokens: np.ndarray) -> bytes:
    """Low bits of the counts of many more groups. Counts differ by at least the difference of their low bits; groups fold into fewer by halves, their low bits by exclusive or."""
    groups = max(64, _size(max(FINE * min(len(tokens), FINE_FULL), len(tokens))))
    at = ((tokens >> U(20)) & U(groups - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=groups) & 1 == 1, bitorder="little").tobytes()


def _featurise(words: int, bands: Bands, common):
    """Each text's size of its set, digest, points, and pages by turn; those without a set or id have null but for the size."""

    def run(batches):
        often = np.frombuffer(common.value, U)
        for batch in batches:
            for part in t.slices(batch, "text"):
                sets = _sets(part, words)
                ids = part.column(part.schema.get_field_index("doc_id"))
                own = [s if len(s) and i is not None else None for s, i in zip(sets, ids.to_pylist(), strict=True)]
                each = lambda f: pa.array([None if s is None else f(s) for s in own], pa.binary())
                pages = [np.zeros(0, np.int64) if s is None else _pages(s, bands, often) for s in own]
                turns = []
                for turn in range(TURNS):
                    of_turn = [x[x % TURNS == turn] for x in pages]
                    at = np.concatenate([[0], np.cumsum([len(x) for x in of_turn])]).astype(np.int32)
                    turns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int64), *of_turn]))))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([len(s) for s in sets], pa.int64()), each(lambda s: hashlib.blake2b(s.tobytes(), digest_size=16).digest()), each(_point), each(_fine), *turns],
                    names=["doc_id", "n", "digest", "point", "fine", *(f"p{i}" for i in range(TURNS))],
                )

    return run


def _page_filter(pages: DataFrame, n: int):
    """A broadcast bit map of PER_PAGE bits or more for each of n pages of a turn, PAGE_BITS at most; of the other pages of that turn it lets about n / bits pass, which only cost time. The bits that are the same in all pages of a turn are left out."""
    bits = min(PAGE_BITS, max(8 * CHUNK, _size(PER_PAGE * n)))
    place = F.shiftright("page", TURN_BITS).bitwiseAND(F.lit(bits - 1))
    chunks = pages.select(F.floor(place / (8 * CHUNK)).cast("int").alias("chunk"), (place % (8 * CHUNK)).alias("at")).repartition("chunk").mapInArrow(_chunks, "chunk int, data binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in chunks.toArrow().to_pylist():  # as large as the map, in one job
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["data"], np.uint8)
    return pages.sparkSession.sparkContext.broadcast(out.tobytes())


def _chunks(batches):
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        chunk, at = _column(batch, "chunk"), _column(batch, "at")
        for c in np.unique(chunk):
            own = at[chunk == c]
            np.bitwise_or.at(held.setdefault(int(c), np.zeros(CHUNK, np.uint8)), own >> 3, (1 << (own & 7)).astype(np.uint8))
    for c, data in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([data.tobytes()], pa.binary())], names=["chunk", "data"])


def _entries(wanted, kept=None):
    """A row (page, node) for each page in the lists of the documents whose bit is set; with a filter of pages, of those that pass it."""

    def run(batches):
        for batch in batches:
            batch = passing(batch, "doc_id", wanted.value)
            lists = batch.column(1)
            whole = lists.flatten().to_numpy(zero_copy_only=False)
            nodes = np.repeat(_column(batch, "doc_id"), np.diff(lists.offsets.to_numpy()))
            if kept is not None:
                bits = np.frombuffer(kept.value, np.uint8)
                place = (whole >> TURN_BITS) & (8 * len(bits) - 1)
                own = (bits[place >> 3] >> (place & 7)) & 1 == 1
                whole, nodes = whole[own], nodes[own]
            for i in range(0, len(whole), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (whole, nodes)], names=["page", "node"])

    return run


def _shingles(words: int):
    def run(batches):
        for batch in batches:
            for part in t.slices(batch, "text"):
                sets = _sets(part, words)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))], names=["shingle"])

    return run


def _common(docs: DataFrame, words: int):
    """Broadcast of the shingles of at least COMMON of about SAMPLE documents; at most SAMPLE / COMMON documents' worth."""
    docs = docs.where("doc_id IS NOT NULL")
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, docs.count() // SAMPLE))) == 0)
    found = some.mapInArrow(_shingles(words), "shingle long").groupBy("shingle").count().where(F.col("count") >= COMMON).select("shingle").toArrow()
    values = found.column(0).to_numpy().view(U)
    return docs.sparkSession.sparkContext.broadcast(np.sort(values).tobytes())


class Points:
    """Points of some rows; `at` folds those of some rows to a common size in bytes."""

    def __init__(self, batches: list[pa.RecordBatch], name: str):
        parts = [t.buffers(b.column(b.schema.get_field_index(name)).cast(pa.large_binary())) for b in batches]
        self.data = np.concatenate([d for d, _ in parts])
        self.length = np.concatenate([np.diff(o) for _, o in parts])
        self.start = np.cumsum(self.length) - self.length

    def _parts(self, rows: np.ndarray, size: int):
        """Positions among rows, and their points as (rows, pieces of `size` bytes, bytes)."""
        for n in np.unique(self.length[rows]):
            same = np.flatnonzero(self.length[rows] == n)
            step = max(1, CELLS // int(n))
            for i in range(0, len(same), step):
                own = same[i : i + step]
                yield own, self.data[self.start[rows[own]][:, None] + np.arange(n)].reshape(len(own), n // size, size)

    def at(self, rows: np.ndarray, size: int) -> np.ndarray:
        """Counts."""
        out = np.zeros((len(rows), size), np.int16)
        for own, pieces in self._parts(rows, size):
            out[own] = pieces.sum(1, dtype=np.int16)
        return out

    def bits(self, rows: np.ndarray, size: int) -> np.ndarray:
        """Low bits of counts, 64 a number."""
        out = np.zeros((len(rows), size), np.uint8)
        for own, pieces in self._parts(rows, size):
            out[own] = np.bitwise_xor.reduce(pieces, axis=1)
        return out.view(U)


def _apart(left: Points, x: np.ndarray, right: Points, y: np.ndarray) -> np.ndarray:
    """In how many groups the fine points of rows x and y differ, at the smaller number of groups of each pair: at most the distance of their counts."""
    out = np.zeros(len(x), np.int64)
    size = np.minimum(left.length[x], right.length[y])
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        step = max(1, CELLS // int(n))
        for i in range(0, len(own), step):
            k = own[i : i + step]
            out[k] = np.bitwise_count(left.bits(x[k], n) ^ right.bits(y[k], n)).sum(1, dtype=np.int64)
    return out


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _bounded(num: int, den: int):
    """Keeps the pairs whose summed coordinate minima allow a link. Summed minima are half of the sizes less the distance of the counts, which is at least that of their low bits."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                na, nb = _column(batch, "na"), _column(batch, "nb")
                rows = np.arange(batch.num_rows)
                apart = _apart(Points([batch], "fa"), rows, Points([batch], "fb"), rows)
                keep = (na + nb - apart) // 2 >= _needed(na, nb, num, den)
                yield pa.RecordBatch.from_arrays([pa.array(_column(batch, c)[keep]) for c in "ab"], names=["a", "b"])

    return run


def _pack(points: np.ndarray) -> list[np.ndarray]:
    """Order that packs points into leaves: halves along the widest coordinate until a leaf is left."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        own = todo.pop()
        if len(own) <= LEAF:
            done.append(own)
            continue
        own = own[np.argsort(points[own, np.ptp(points[own], axis=0).argmax()], kind="stable")]
        half = -(-len(own) // 2)
        todo += [own[half:], own[:half]]
    return done


class Block:
    """Rows of some pages' blocks, held by a task."""

    def __init__(self, rows: list[pa.RecordBatch], num: int, den: int):
        for c in ("page", "i", "j", "part", "node", "comp", "n"):
            setattr(self, c, np.concatenate([_column(b, c) for b in rows]))
        self.points, self.fine = Points(rows, "point"), Points(rows, "fine")
        self.num, self.den = num, den
        key = np.stack([self.page, self.i, self.j])
        self.edge = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
        self.length = np.diff(np.concatenate([self.edge, [len(self.page)]]))

    def allowed(self, x: np.ndarray, y: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Rows (block, comp of a, comp of b, distance, a, b) of the pairs of rows in different components that the fine bound allows."""
        ok = (self.comp[x] != self.comp[y]) & ((self.i[x] == self.j[x]) | (self.part[x] != self.part[y]))
        x, y, block = x[ok], y[ok], block[ok]
        apart, total = _apart(self.fine, x, self.fine, y), self.n[x] + self.n[y]
        ok = (total - apart) // 2 >= _needed(total, 0, self.num, self.den)
        x, y = x[ok], y[ok]
        turned = self.node[x] > self.node[y]
        x, y = np.where(turned, y, x), np.where(turned, x, y)
        return np.stack([block[ok], self.comp[x], self.comp[y], apart[ok], self.node[x], self.node[y]], 1)

    def few(self):
        """Pairs of all blocks of at most FEW members."""
        for m in np.unique(self.length[(self.length > 1) & (self.length <= FEW)]):
            first = self.edge[self.length == m]
            at = first[:, None] + np.arange(m)
            p, q = (at[:, side].ravel() for side in np.triu_indices(m, 1))
            block = np.repeat(first, m * (m - 1) // 2)
            for s in range(0, len(p), 100_000):
                yield self.allowed(p[s : s + 100_000], q[s : s + 100_000], block[s : s + 100_000])

    def many(self, e: int, m: int):
        """Pairs of one larger block, leaf by leaf."""
        at = np.arange(e, e + m)
        size = self.n[at]
        points = self.points.at(at, int(self.points.length[at].min()))
        leaves = _pack(points)
        high, low = np.array([points[x].max(0) for x in leaves]), np.array([size[x].min() for x in leaves])
        for i, x in enumerate(leaves):
            room = (np.minimum(high[i], high[i:]).sum(1) >= _needed(low[i] + low[i:], 0, self.num, self.den)) | (high[i:].max(1) == FULL)
            for j in np.flatnonzero(room) + i:
                y = leaves[j]
                total = size[x][:, None] + size[y][None, :]
                apart = np.abs(points[x][:, None, :] - points[y][None, :, :]).sum(2, dtype=np.int64)
                ok = (total - apart) // 2 >= _needed(total, 0, self.num, self.den)
                if i == j:
                    ok = np.triu(ok, 1)
                p, q = np.nonzero(ok)
                yield self.allowed(at[x[p]], at[y[q]], np.full(len(p), e))


def _nearest(pairs: np.ndarray) -> np.ndarray:
    """Of rows of `allowed`, the nearest for each block and component."""
    both = np.concatenate([np.concatenate([pairs[:, [0, 1]], pairs], 1), np.concatenate([pairs[:, [0, 2]], pairs], 1)])
    both = both[np.lexsort((both[:, 7], both[:, 6], both[:, 5], both[:, 1], both[:, 0]))]
    first = np.ones(len(both), bool)
    first[1:] = (both[1:, :2] != both[:-1, :2]).any(1)
    return np.unique(both[first, 2:], axis=0)


def _across(num: int, den: int, nearest: bool):
    """Rows of a block stand together; they are held until the block ends. nearest: only each component's nearest pair."""

    def emit(pairs):
        pairs = np.unique(pairs[:, 4:], axis=0)
        for s in range(0, len(pairs), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[s : s + 50_000, 0]), pa.array(pairs[s : s + 50_000, 1])], names=["a", "b"])

    def flush(rows):
        block = Block(rows, num, den)
        pairs = [np.zeros((0, 6), np.int64)]

        def reduced(found):
            size = 0
            for x in found:
                pairs.append(x)
                size += len(x)
                if nearest and size > 100_000:
                    pairs[:] = [_nearest(np.concatenate(pairs))]
                    size = 0
                elif not nearest and size > 100_000:
                    yield from emit(np.concatenate(pairs))
                    pairs[:] = [np.zeros((0, 6), np.int64)]
                    size = 0

        yield from reduced(block.few())
        for e, m in zip(block.edge[block.length > FEW], block.length[block.length > FEW], strict=True):
            yield from reduced(block.many(int(e), int(m)))
        left = np.concatenate(pairs)
        yield from emit(_nearest(left) if nearest else left)

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.nbytes
            if rows >= HELD:
                last = [_column(batch, c)[-1] for c in ("page", "i", "j")]
                same = np.ones(batch.num_rows, bool)
                for c, v in zip(("page", "i", "j"), last, strict=True):
                    same &= _column(batch, c) == v
                cut = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
                if cut:
                    yield from flush([*held[:-1], batch.slice(0, cut)])
                    held = [batch.slice(cut)]
                    rows = held[0].nbytes
        if rows:
            yield from flush(held)

    return run


def _tokens(words: int, wanted):
    """Shingle sets of the documents whose bit is set in the filter."""

    def run(batches):
        for batch in batches:
            batch = passing(batch, "doc_id", wanted.value)
            for part in t.slices(batch, "text"):
                sets = _sets(part, words)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "tokens"])

    return run


def _verify(num: int, den: int):
    """Rows (a, salt, first, x, tokens), those of (a, salt) together with a's own set first -> links (a, b)."""

    def run(batches):
        key, own = None, None
        for batch in batches:
            a, salt, first, x = (_column(batch, c) for c in ("a", "salt", "first", "x"))
            tokens = batch.column(batch.schema.get_field_index("tokens"))
            keep = []
            for i in range(batch.num_rows):
                s = np.frombuffer(tokens[i].as_py(), U)
                if not first[i]:
                    key, own = (a[i], salt[i]), s
                elif key == (a[i], salt[i]):
                    both = len(own) + len(s) - len(np.unique(np.concatenate([own, s])))
                    if den * both >= num * (len(own) + len(s) - both):
                        keep.append(i)
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(x[keep])], names=["a", "b"])

    return run


def _links(docs: DataFrame, pairs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """A saved table of the pairs (a, b) whose sets truly reach the threshold."""
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")
    members = pairs.select("a", salt.alias("salt"), F.lit(1).alias("first"), F.col("b").alias("x"))
    members = saved(members.unionByName(members.select("a", "salt", F.lit(0).alias("first"), F.col("a").alias("x")).distinct()), "members")
    wanted = key_filter(members.select(F.col("x").alias("doc_id")))
    sets = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(_tokens(words, wanted), "doc_id long, tokens binary")
    rows = members.join(sets.withColumnRenamed("doc_id", "x"), "x").select("a", "salt", "first", "x", "tokens")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "first")
    out = saved(rows.mapInArrow(_verify(num, den), "a long, b long").distinct(), "links")
    drop(members)
    return out


def _blocks(named: DataFrame, block: int) -> DataFrame:
    """(page, node, comp, m) -> those of pages with several components, with the part of the page that each belongs to and the parts that it meets.

    Pages over `block` members are cut into parts of about that size. The largest component of such a page has parts of its
    own, which meet all other parts but not one another: m copies beside a few other documents go out about m times, not m times m / block.
    """
    small = named.where(F.col("m") <= block).groupBy("page").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y")
    large = named.where(F.col("m") > block).groupBy("page", "comp").agg(F.count("*").alias("c"))
    large = large.groupBy("page").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("c"), F.sum("c").alias("all")).where("c < all")
    count = lambda n: F.ceil(n / block).cast("int")
    large = large.select("page", "main", count(F.col("c")).alias("own"), count(F.col("all") - F.col("c")).alias("more"))
    rest = named.join(small.select("page").unionByName(large, allowMissingColumns=True), "page")
    place, inside = F.xxhash64("node"), F.col("comp") == F.col("main")
    part = F.when(F.col("main").isNull(), 0).when(inside, F.pmod(place, "own")).otherwise(F.col("own") + F.pmod(place, "more"))
    others = F.when(F.col("main").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.when(inside, F.col("own")).otherwise(0), F.col("own") + F.col("more") - 1))
    return rest.select("page", "node", "comp", part.cast("int").alias("part"), others.alias("others"))


def jaccard_components(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (8, 10), block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_shingles, component_id), a row for each row of docs.

    A document's set: distinct shingles of `words` words (lower-cased A-Z), or its whole sequence if it has fewer. Two documents
    link when |A & B| / |A | B| >= threshold; component_id is the smallest doc_id reachable by links, itself
    included. Null and empty texts have no set and link with nothing, and so do rows without doc_id (component_id null). Rows
    that repeat a doc_id count as one document. An empty table gives no rows; further columns are left out.
    """
    num, den = threshold
    docs = docs.select("doc_id", "text")
    bands, kinds = Bands(num, den), "doc_id long, n long, digest binary, point binary, fine binary" + "".join(f", p{i} array<long>" for i in range(TURNS))
    made = saved(docs.mapInArrow(_featurise(words, bands, _common(docs, words)), kinds), "sets")
    sizes = saved(made.select("doc_id", "n", "digest"), "sizes")
    nodes = saved(sizes.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node")), "nodes")  # equal sets are one node
    wanted = key_filter(nodes.select(F.col("node").alias("doc_id")))
    turns = []
    for turn in range(TURNS):  # the shuffles of one turn are gone before the next
        lists = made.where("digest IS NOT NULL").select("doc_id", f"p{turn}")
        counted = lists.mapInArrow(_entries(wanted), "page long, node long").groupBy("page").agg(F.min("node").alias("lead"), F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("members"))
        counted = counted.where("m > 1").groupBy("lead", "m", "members").agg(F.min("page").alias("page"))  # pages with the same members once
        counted = saved(counted.select("page", "lead", "m"), "counted")
        kept = _page_filter(counted.select("page"), counted.count())
        own = lists.mapInArrow(_entries(wanted, kept), "page long, node long").join(counted, "page").join(nodes.select("node"), "node", "left_semi")
        turns.append(saved(own.select("page", "node", "lead", "m"), "pages"))
        kept.destroy()
        drop(counted)
        del own
        release(docs.sparkSession)
    pages = functools.reduce(DataFrame.unionByName, turns)
    points = made.select(F.col("doc_id").alias("node"), "n", "point", "fine", "digest").join(nodes, ["digest", "node"])
    points = saved(points.join(pages.select("node").distinct(), "node", "left_semi").dropDuplicates(["node", "digest"]).drop("digest"), "points")
    drop(made)

    side = lambda c: points.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("fine").alias(f"f{c}"))
    stars = pages.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    stars = saved(stars.join(side("b"), "b").join(side("a"), "a").mapInArrow(_bounded(num, den), "a long, b long"), "stars")
    links = _links(docs, stars, words, num, den)
    labels = saved(components(links), "labels")

    tested, steps = stars, [stars]
    for share, nearest in PASSES:
        named = pages.where(F.pmod("page", F.lit(share)) == 0).join(labels, "node", "left").select("page", "node", "m", F.coalesce("component", "node").alias("comp"))
        rest = _blocks(named, block).join(points, "node").withColumn("k", F.explode("others"))
        rest = rest.select("page", F.least("part", "k").alias("i"), F.greatest("part", "k").alias("j"), "part", "node", "comp", "n", "point", "fine")
        rest = rest.repartition("page", "i", "j").sortWithinPartitions("page", "i", "j").mapInArrow(_across(num, den, nearest), "a long, b long")
        more = saved(rest.distinct().join(tested, ["a", "b"], "left_anti"), "more")
        steps.append(more)
        if not more.isEmpty():
            links = links.unionByName(_links(docs, more, words, num, den))
            labels = saved(components(links), "labels")
            tested = tested.unionByName(more)
        del named, rest
        release(docs.sparkSession)

    drop(*turns, points, *steps)
    by_set = nodes.join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = sizes.join(by_set, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, (90, 100))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
h AS (SELECT s.doc_id, n, hash(g) AS g FROM s JOIN n USING (doc_id)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM h a JOIN h b ON a.g = b.g AND a.doc_id < b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY 1) USING (doc_id)
"""
