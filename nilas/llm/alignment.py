"""Alignment of two tokenizers: which tokens end together, and how often each pair of tokens does so in the whole corpus.

Both tokenizers cut a text into pieces of its bytes. Where a piece of each ends at one place, the text falls into groups, and the two tokens that end there are linked.
Links are counted by inverted bitmaps. Documents are numbered inside chunks; for each pair of tokens a chunk holds the bit planes of a multiplicity for each of its documents
(plane k: the documents whose number of such links has bit k), as a list of document numbers or, for pairs with many documents, as a bitmap. No document is in two chunks,
so a pair's planes are popcounted chunk by chunk and summed: the union of its planes counts its documents, and the planes by their powers of two count its links. The same planes are the postings that return a pair's
count to the documents which hold it, again chunk by chunk. Nothing grows with a pair's documents but the number of its rows, which joins split.

Tokenizing is the costly part. No token of either vocabulary reaches over a place where a blank or line break follows something else, so texts are cut there and each different segment is tokenized and aligned once a task,
as long as the segments kept fit a bounded cache. Texts in which this can't be shown are tokenized whole. The vocabulary files are read by the driver and broadcast; their size is checked.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nilas.llm import text as t
from nilas.llm.common import saved

U = np.uint64
#: Where the vocabulary files are, and how large they may be to be broadcast.
FOLDER, LARGEST = "/opt/tokenizers", 32 << 20
#: Segments and characters of segments that a task keeps.
SEGMENTS, CHARACTERS = 700_000, 12 << 20
#: Segments encoded together, and what doesn't end one.
TOGETHER, WHITE = 10_000, " \t\n\x0b\x0c\r"
#: Bytes of text in a chunk of documents.
CHUNK = 4 << 20
#: Fixed value: the pattern by which byte-level vocabularies cut texts before they merge.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space beyond ASCII (and the separators that some engines count as such): texts with any are tokenized whole.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A segment ends before a blank or line break that follows something else.
SEGMENT = re.compile(r"[ \t-\r]*[^ \t-\r]+(?:[\t\x0b-\r][ \t-\r]*[^ \t-\r]*)*|[ \t-\r]+")


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes of Latin-1 stand for themselves, the others for the code points from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


class Tokenizers:
    """A: a byte-level BPE of the tokenizers library (JSON). B: a sentencepiece model, which puts a blank before a text. Ids and bytes of texts that begin with that blank."""

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece
        import tiktoken
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True  # their strings in texts are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        byte = byte_of_character()
        own = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(own.values()) + 1)
        for token, i in own.items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        # the same merges by a faster engine, where ids are ranks: 256 bytes, then a token a merge
        merges, ranks = json.loads(a)["model"]["merges"], {self.a_bytes[i]: i for i in range(len(self.a_bytes))}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        ranked = all(own.get(x + y) == 256 + k for k, (x, y) in enumerate(pairs))
        ordinary = {x: i for x, i in ranks.items() if i < 256 + len(pairs)}
        self.ranks = tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks=ordinary, special_tokens={}) if ranked and len(ordinary) == 256 + len(pairs) else None
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        assert max(len(self.a_bytes), len(self.b_bytes)) < 1 << 24
        self.blank = self.b.piece_to_id("▁")
        long = [p for i, p in enumerate(pieces) if len(p) > 1 and not self.b.is_byte(i)]
        self.cuttable = not any("▁" in p.lstrip("▁") or "\n" in p for p in long)

        # each token's id with what follows it: in a group, or at its end
        self.a_written = [f"{i}{end}".encode() for i in range(len(self.a_bytes)) for end in ",|"]
        self.b_written = [f"{i}{end}".encode() for i in range(len(self.b_bytes)) for end in ",;"]
        self.a_size, self.b_size, self.a_long, self.b_long = (np.array([len(x) for x in k], np.int64) for k in (self.a_bytes, self.b_bytes, self.a_written, self.b_written))

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.a.encode_batch(texts, add_special_tokens=False)]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        """Of texts with or without a leading blank: the one that the model adds is used up or taken away."""
        out = self.b.encode([x[1:] if x[:1] == " " else x for x in texts], num_threads=1)
        return [ids if x[:1] == " " or ids[:1] != [self.blank] else ids[1:] for x, ids in zip(texts, out, strict=True)]

    def each(self, texts: list[str]):
        """Ids of texts that are encoded one by one: (whether the tokens' bytes are the text's, A ids, their number in each text, B ids, their number); no ids of those whose bytes differ."""
        a, b, data = self.encode_a(texts), self.encode_b(texts), [x.encode() for x in texts]
        same = lambda ids, table: b"".join(map(table.__getitem__, ids))
        good = np.array([same(x, self.a_bytes) == z and same(y, self.b_bytes) == z for x, y, z in zip(a, b, data, strict=True)], bool)
        a, b = ([x if g else [] for x, g in zip(k, good, strict=True)] for k in (a, b))
        flat = lambda lists: np.fromiter(itertools.chain.from_iterable(lists), np.int64, sum(map(len, lists)))
        count = lambda lists: np.array([len(x) for x in lists], np.int64)
        return good, flat(a), count(a), flat(b), count(b)

    def joined(self, texts: list[str]):
        """As `each`, for segments which may follow each other in a text: they are encoded as one. None if that can't be shown to be the same."""
        whole = "".join(texts)
        data, ends = whole.encode(), np.cumsum([len(x.encode()) for x in texts])
        a = self.ranks.encode_ordinary(whole) if self.ranks else self.encode_a([whole])[0]
        b = self.encode_b([whole])[0]
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        to_a, to_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        at_a, at_b = np.searchsorted(to_a, ends), np.searchsorted(to_b, ends)
        if (to_a[at_a] != ends).any() or (to_b[at_b] != ends).any():
            return None
        return np.ones(len(texts), bool), a, np.diff(at_a + 1, prepend=0), b, np.diff(at_b + 1, prepend=0)

    def aligned(self, texts: list[str], segments: bool = False):
        """(whether the tokens' bytes are the text's, numbers of A tokens, of B tokens, of links; all links as A id << 32 | B id; groups as text) of the texts; nothing of those whose bytes differ."""
        good, a, n_a, b, n_b = segments and self.joined(texts) or self.each(texts)
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        last_a, last_b = (np.isin(x, y, assume_unique=True) for x, y in ((ends_a, ends_b), (ends_b, ends_a)))
        links = (a[last_a] << 32 | b[last_b]).astype(U)
        # the ids in the order of the groups, A's before B's
        before = lambda last: np.cumsum(last) - last
        groups_a, groups_b = np.flatnonzero(last_a) + 1, np.concatenate([[0], np.flatnonzero(last_b) + 1])
        at_a, at_b = np.arange(len(a)) + groups_b[before(last_a)], np.arange(len(b)) + groups_a[before(last_b)] if len(b) else np.zeros(0, np.int64)
        written, long = [b""] * (len(a) + len(b)), np.zeros(len(a) + len(b), np.int64)
        codes_a, codes_b = 2 * a + last_a, 2 * b + last_b
        long[at_a], long[at_b] = self.a_long[codes_a], self.b_long[codes_b]
        order = np.empty(len(written), np.int64)
        order[at_a], order[at_b] = codes_a, codes_b + len(self.a_written)
        text = b"".join(map((self.a_written + self.b_written).__getitem__, order.tolist()))
        counted = lambda last, n: np.diff(np.concatenate([[0], np.cumsum(last)])[np.concatenate([[0], np.cumsum(n)])])
        cuts = np.concatenate([[0], np.cumsum(long)])[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        return good, n_a, n_b, counted(last_a, n_a), links, [text[i : max(i, j - 1)] for i, j in itertools.pairwise(cuts)]


class Aligner:
    """Alignments of many texts, each different segment once while it is kept."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.clear()

    def clear(self) -> None:
        self.number, self.groups, self.characters = {}, [], 0
        self.good, self.counts, self.links = np.zeros(0, bool), np.zeros((3, 0), np.int64), np.zeros(0, U)

    def add(self, texts: list[str], segments: bool = False) -> range:
        """Aligns texts; their numbers among the entries."""
        first = len(self.groups)
        for i in range(0, len(texts), TOGETHER):
            good, n_a, n_b, n_links, links, groups = self.tokenizers.aligned(texts[i : i + TOGETHER], segments)
            self.good, self.counts, self.links = np.append(self.good, good), np.hstack([self.counts, [n_a, n_b, n_links]]), np.append(self.links, links)
            self.groups += groups
        self.characters += sum(map(len, texts))
        return range(first, len(self.groups))

    def texts(self, texts: list[str | None]):
        """Of each text: numbers of A tokens, of B tokens and of links, and the SHA-256 of its groups; and all links. Without text, or where the tokens' bytes differ: zeros and an empty text."""
        if len(self.groups) > SEGMENTS or self.characters > CHARACTERS:
            self.clear()
        whole = lambda x: not self.tokenizers.cuttable or not x.isascii() and OTHER_SPACE.search(x) is not None
        cut = [[] if not x else [" " + x] if whole(x) else SEGMENT.findall(" " + x) for x in texts]
        known = [list(map(self.number.get, segments)) for segments in cut]
        new = {s for segments, numbers in zip(cut, known, strict=True) if None in numbers for s, k in zip(segments, numbers, strict=True) if k is None}
        plain = lambda x: x[-1] not in WHITE and (x.isascii() or OTHER_SPACE.search(x) is None) and self.tokenizers.cuttable
        for joinable in (True, False):
            own = [x for x in new if plain(x) == joinable]
            self.number.update(zip(own, self.add(own, joinable), strict=True))
        found = ([self.number[s] if k is None else k for s, k in zip(segments, numbers, strict=True)] if None in numbers else numbers for segments, numbers in zip(cut, known, strict=True))
        entries = [np.array(x, np.int64) for x in found]
        for k in [k for k, x in enumerate(entries) if not self.good[x].all()]:
            whole_text = self.add([" " + texts[k]]) if len(entries[k]) > 1 else entries[k]
            entries[k] = np.array([e for e in whole_text if self.good[e]], np.int64)
        flat = np.concatenate([*entries, np.zeros(0, np.int64)])
        at = np.concatenate([[0], np.cumsum([len(x) for x in entries], dtype=np.int64)])
        sums = np.hstack([np.zeros((3, 1), np.int64), np.cumsum(self.counts[:, flat], axis=1)])
        begin, n = (np.cumsum(self.counts[2]) - self.counts[2])[flat], self.counts[2][flat]
        links = self.links[np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)]
        digests = [hashlib.sha256(b";".join(map(self.groups.__getitem__, x.tolist()))).hexdigest() if len(x) else "" for x in entries]
        return np.diff(sums[:, at]), digests, links


@functools.lru_cache(1)
def aligner(a: bytes, b: bytes) -> Aligner:
    """One a Python process, for all of its tasks."""
    return Aligner(Tokenizers(a, b))


#: Rows of one pass over the texts: those of documents (with a row), and those of a pair's planes in a chunk.
SCHEMA = "chunk long, row int, doc_id long, n_a long, n_b long, n_links long, groups_sha256 string, a int, b int, plane int, n int, n_documents int, dense boolean, documents binary"


def planes(links: np.ndarray, documents: np.ndarray, total: int):
    """(a, b, plane, n, n_documents, dense, documents) of a chunk's links and their documents (numbers under total): lists of uint16, or bitmaps where they are smaller.

    n is the popcount of the plane; n_documents that of all planes of the pair together, with the first of them.
    """
    # ids under 2 to the 24 and document numbers under 2 to the 16 in one number
    packed = np.sort(links >> U(32) << U(40) | (links & U(0xFFFFFF)) << U(16) | documents.astype(U))
    links, documents = packed >> U(40) << U(32) | packed >> U(16) & U(0xFFFFFF), (packed & U(0xFFFF)).astype(np.int64)
    new = np.ones(len(links), bool)
    new[1:] = (links[1:] != links[:-1]) | (documents[1:] != documents[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(links)))
    links, documents = links[at], documents[at]
    new = np.ones(len(links), bool)
    new[1:] = links[1:] != links[:-1]
    held = np.diff(np.append(np.flatnonzero(new), len(links)))[np.cumsum(new) - 1]  # documents of the pair
    seen = np.zeros(len(links), bool)  # pairs that have a plane already
    pair = np.cumsum(new) - 1
    for k in range(int(times.max()).bit_length() if len(times) else 0):
        own = (times >> k) & 1 == 1
        x, d, p, h = links[own], documents[own], pair[own], held[own]
        first = np.ones(len(x), bool)
        first[1:] = p[1:] != p[:-1]
        at = np.flatnonzero(first)
        n = np.diff(np.append(at, len(x)))
        counted = np.where(seen[p[at]], 0, h[at])
        seen[p[at]] = True
        many = n * 16 > total
        a, b = (x[at] >> U(32)).astype(np.int32), (x[at] & U(0xFFFFFFFF)).astype(np.int32)
        for dense in (False, True):
            rows = many == dense
            if not rows.any():
                continue
            inside = np.repeat(rows, n)
            if dense:
                bits = np.zeros((int(rows.sum()), total), bool)
                bits[np.repeat(np.arange(len(bits)), n[rows]), d[inside]] = True
                content = np.packbits(bits, axis=1, bitorder="little")
                ends = np.arange(len(bits) + 1) * content.shape[1]
            else:
                content = d[inside].astype("<u2")
                ends = np.concatenate([[0], np.cumsum(n[rows]) * 2])
            stored = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(content))])
            yield a[rows], b[rows], k, n[rows], counted[rows], dense, stored


def numbers_of(documents: bytes, dense: bool) -> np.ndarray:
    """Document numbers of a plane."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(documents, np.uint8), bitorder="little")) if dense else np.frombuffer(documents, "<u2")


def vocabularies(spark: SparkSession, a: str, b: str):
    """Both files, broadcast."""
    files = tuple(Path(x).read_bytes() for x in (a, b))
    if sum(map(len, files)) > LARGEST:
        raise ValueError(f"vocabulary files over {LARGEST} bytes aren't broadcast")
    return spark.sparkContext.broadcast(files)


def tokenized(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of SCHEMA for docs (doc_id, text): one a document, and the planes of each chunk's pairs."""
    files = vocabularies(docs.sparkSession, a, b)
    schema = pa.schema([("chunk", pa.int64()), ("row", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("plane", pa.int32()), ("n", pa.int32()), ("n_documents", pa.int32()), ("dense", pa.bool_()), ("documents", pa.binary())])

    def column(field: pa.Field, x, rows: int) -> pa.Array:
        if x is None:
            return pa.nulls(rows, field.type)
        if isinstance(x, bool | int):
            x = np.full(rows, x)
        return x if isinstance(x, pa.Array) else pa.array(x, field.type)

    def record(rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([column(f, columns.get(f.name), rows) for f in schema], schema=schema)

    def run(batches):
        own, chunk = aligner(*files.value), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in t.slices(batch, "text", CHUNK):
                for i in range(0, part.num_rows, 1 << 16):
                    some = part.slice(i, 1 << 16)
                    (n_a, n_b, n), digests, links = own.texts(some.column(some.schema.get_field_index("text")).to_pylist())
                    ids, numbers = some.column(some.schema.get_field_index("doc_id")).cast(pa.int64()), np.arange(len(n), dtype=np.int32)
                    yield record(len(n), chunk=chunk, row=numbers, doc_id=ids, n_a=n_a, n_b=n_b, n_links=n, groups_sha256=digests)
                    for x, y, k, popcount, held, dense, stored in planes(links, np.repeat(numbers, n), len(n)):
                        yield record(len(x), chunk=chunk, a=x, b=y, plane=k, n=popcount, n_documents=held, dense=dense, documents=stored)
                    chunk += 1

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def pair_counts(rows: DataFrame) -> DataFrame:
    """Of the planes of `tokenized`: a, b, n_links, n_documents, and best, whether no other pair of this b has more links."""
    pairs = rows.where("row IS NULL").groupBy("a", "b").agg(F.sum(F.col("n") * F.expr("shiftleft(1L, plane)")).alias("n_links"), F.sum("n_documents").alias("n_documents"))
    most = pairs.groupBy("b").agg(F.max("n_links").alias("_most"))
    return pairs.join(most, "b").select("a", "b", "n_links", "n_documents", (F.col("n_links") == F.col("_most")).alias("best"))


def _scores(batches):
    """Rows (chunk, plane, dense, documents, n_links, best), those of a chunk together -> (chunk, row, n_best, count_sum)."""

    def told(chunk, best, total):
        row = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(row), chunk)), pa.array(row.astype(np.int32)), pa.array(best[row]), pa.array(total[row])], names=["chunk", "row", "n_best", "count_sum"])

    current, best, total = None, None, None
    for batch in batches:
        columns = [batch.column(k) for k in range(batch.num_columns)]
        for chunk, plane, dense, documents, count, top in zip(*(c.to_pylist() for c in columns), strict=True):
            if chunk != current:
                if current is not None:
                    yield told(current, best, total)
                current, best, total = chunk, np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
            at = numbers_of(documents, dense)
            total[at] += count << plane  # a plane has a document once
            if top:
                best[at] += 1 << plane
    if current is not None:
        yield told(current, best, total)


def alignment(docs: DataFrame, a: str = f"{FOLDER}/byte_bpe_50k.json", b: str = f"{FOLDER}/piece_bpe_32k.model", watch: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; other columns are left out.

    Both tokenizers take a blank and the text. A document has no tokens, and zeros, if its text is null or empty or the bytes of its tokens differ from the blank and the text. Rows with null or repeated ids are rows like others, each counted.
    n_best: links whose pair has the most links of its B token in all documents, ties included; count_sum: the sum of the links' counts. Every text is taken whole, however long.
    watch: is given the table of `tokenized` (for the pairs' counts and planes), which is written to the shared folder so that documents keep their numbers when tasks run again.
    """
    rows = saved(tokenized(docs, a, b), "alignment")
    if watch:
        watch(rows)
    planes_ = rows.where("row IS NULL").select("chunk", "a", "b", "plane", "dense", "documents")
    scored = planes_.join(pair_counts(rows).select("a", "b", "n_links", "best"), ["a", "b"]).select("chunk", "plane", "dense", "documents", "n_links", "best")
    scores = scored.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_scores, "chunk long, row int, n_best long, count_sum long")
    none = F.lit(0).cast("long")
    return rows.where("row IS NOT NULL").join(scores, ["chunk", "row"], "left").select(
        "doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256"
    )


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"))
