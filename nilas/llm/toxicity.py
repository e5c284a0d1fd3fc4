"""Toxicity scores from a bag of subword embeddings, averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams (with word edges) and of itself; a passage is the mean of its
words; a linear softmax over that mean gives the probability of label 1. Embeddings and softmax are trained together in
numpy. Misspelt words share n-grams with known ones. As mean and softmax input are linear, the trained
model is one number a bucket for scoring, which is what the tasks get.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nilas.llm import text as t
from nilas.llm.common import held_texts, labelled_sample

U = np.uint64
BUCKETS_LOG2, DIM, NGRAMS = 18, 8, (3, 4, 5)
#: Most labelled documents the model is fitted on, in the order of their hash, and the most bytes of all; bytes whose features are held at once.
TRAIN_ROWS, TRAIN_TOTAL, CHUNK_BYTES = 6000, 32 << 20, 256 << 10
#: Words of a passage. A document's score is that of its highest passage.
PASSAGE = 12
STEPS, RATE, DECAY, EPS = 120, 0.05, 1e-5, 1e-5
#: Buckets are trained whose log odds ratio over documents is so many standard errors from 0; documents counted at once.
TELLS, DOCS = 2.5, 64
CUT = 0.7
#: Bytes of text whose features are held at once.
PIECE = 512 << 10

_EDGE = np.uint32(1)
FOLD = np.array([ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(0x600)], np.uint32)
FOLD[[*range(0x21), *map(ord, '.,;:?"()[]{}*#%&|<>/\\'), 0x85, 0xA0]] = _EDGE


def code_points(data: np.ndarray, offsets: np.ndarray):
    """Folded code points with an edge before, between and after texts, and where each text's begin."""
    lead = (data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(lead)])[offsets]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    points = np.where(points < len(FOLD), FOLD[np.minimum(points, len(FOLD) - 1)], points)
    points = np.insert(points, at, _EDGE)  # the edge before text i is at at[i] + i
    return points, at + np.arange(len(at))


class Features:
    """Buckets of every n-gram and word of some texts, with the word each belongs to."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        c, self.begin = code_points(data, offsets)
        inside = c != _EDGE
        first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        last = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
        x = c.astype(U) * U(0x9E3779B97F4A7C15) + U(0x632BE59BD9B4E019)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(x * _weights(len(c)), dtype=U)])
        whole = t.mix((sums[last] - sums[first]) * _inverse(len(c))[first])
        again = np.zeros(len(first), bool)  # a word right after itself counts once, so that a stutter doesn't fill a passage
        again[1:] = whole[1:] == whole[:-1]
        for a, b in zip(first[again], last[again], strict=True):
            inside[a:b] = False
        first, last, whole = first[~again], last[~again], whole[~again]
        self.n_words, self.first = len(first), first
        self.text_words = np.searchsorted(first, self.begin)
        length = last - first
        shift = U(64 - BUCKETS_LOG2)
        word_of = np.cumsum(np.bincount(first, minlength=len(c)))[: len(c)] - 1
        buckets, owners = [], []
        h = np.zeros(len(c), U)
        ok = np.ones(len(c), bool)
        for n in range(1, max(NGRAMS) + 1):
            m = len(c) - n + 1
            if m <= 0:
                break
            h = (h[:m] ^ (h[:m] >> U(29))) * U(0xBF58476D1CE4E5B9) + x[n - 1 :]
            if n > 2:
                ok = ok[:m] & inside[n - 2 : len(c) - 1]  # what isn't first or last is no edge
            if n in NGRAMS:
                p = np.flatnonzero(ok[:m])
                buckets.append(((h[p] + U(n)) * U(0x94D049BB133111EB) >> shift).astype(np.int32))
                owners.append(word_of[p + 1])
        buckets.append((whole >> shift).astype(np.int32))
        owners.append(np.arange(self.n_words))
        self.whole, self.buckets, self.owners = whole, np.concatenate(buckets), np.concatenate(owners)
        self.share = 1.0 / np.maximum(1, sum(np.maximum(0, length + 3 - n) for n in NGRAMS) + 1)

    def word_sums(self, table: np.ndarray) -> np.ndarray:
        return np.bincount(self.owners, table[self.buckets], self.n_words) * self.share


_cache: dict = {}


def _weights(n: int) -> np.ndarray:
    if len(_cache.get("w", ())) < n:
        _cache["w"], _cache["i"] = t._powers(t.BASE, n), t._powers(t.BASE_INVERSE, n)
    return _cache["w"][:n]


def _inverse(n: int) -> np.ndarray:
    return _cache["i"][:n]


def _passages(text_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each passage begins among the words, and each text's passages begin among the passages."""
    counts = np.diff(text_words)
    each = -(-counts // PASSAGE)
    begin = np.concatenate([[0], np.cumsum(each)])
    k = np.arange(begin[-1]) - np.repeat(begin[:-1], each)
    return np.concatenate([np.repeat(text_words[:-1], each) + k * PASSAGE, text_words[-1:]]), begin


def _tops(logits: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The position of each text's highest passage; texts without passages have none and are left out."""
    full = np.flatnonzero(np.diff(begin))
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((-logits, owner))
    return order[begin[full]]


def _chunks(texts: list[str]):
    """The texts as Arrow arrays of about CHUNK_BYTES."""
    own, size = [], 0
    for x in texts:
        own.append(x.encode())
        size += len(own[-1])
        if size >= CHUNK_BYTES:
            yield pa.array(own, pa.large_binary())
            own, size = [], 0
    if own:
        yield pa.array(own, pa.large_binary())


class Bag:
    """Training passages: their words, and each different word's buckets."""

    def __init__(self, texts: list[str]):
        words, lists, starts, begins = [], [], [], []
        n = p = 0
        known = np.zeros(0, U)
        for part in _chunks(texts):
            f = Features(*t.buffers(part))
            start, begin = _passages(f.text_words)
            words.append(f.whole)
            own, at = np.unique(f.whole, return_index=True)
            new = np.zeros(f.n_words, bool)
            new[at[~np.isin(own, known)]] = True  # a word's buckets are needed once
            new, known = new[f.owners], np.union1d(known, own)
            lists.append((f.whole[f.owners[new]], f.buckets[new], f.share[f.owners[new]].astype(np.float32)))
            starts.append(start[:-1] + n)
            begins.append(begin[:-1] + p)
            n, p = n + f.n_words, p + begin[-1]
        self.vocabulary = np.unique(np.concatenate([np.unique(x) for x in words]))
        self.words = np.concatenate([np.searchsorted(self.vocabulary, x).astype(np.int32) for x in words])
        word, bucket, share = map(np.concatenate, zip(*lists, strict=True))
        word = np.searchsorted(self.vocabulary, word)
        _, first = np.unique(word.astype(np.int64) << 20 | bucket, return_index=True)  # each word's buckets once
        self.word, self.bucket, self.share = word[first], bucket[first], share[first]
        self.begin = np.concatenate([*begins, [p]])
        starts = np.concatenate([*starts, [n]])
        self.passage = np.repeat(np.arange(p, dtype=np.int32), np.diff(starts))
        self.length = np.maximum(1, np.diff(starts))

    def keep(self, label: np.ndarray, doc: np.ndarray) -> None:
        """Only buckets that tell the labels apart are trained: their log odds ratio over documents is TELLS standard errors from 0 at least. They are numbered anew."""
        size = 1 << BUCKETS_LOG2
        begin = np.searchsorted(self.word, np.arange(len(self.vocabulary) + 1))
        having, first = np.zeros((2, size)), np.searchsorted(doc[self.passage], np.arange(len(label) + 1))
        for i in range(0, len(label), DOCS):
            part = slice(first[i], first[min(i + DOCS, len(label))])
            own = np.unique(doc[self.passage[part]].astype(np.int64) << 32 | self.words[part])  # each document's words
            word, of = own & 0xFFFFFFFF, own >> 32
            n = begin[word + 1] - begin[word]
            at = np.repeat(begin[word] - np.cumsum(n) + n, n) + np.arange(n.sum())
            own = np.unique(np.repeat(of, n) << BUCKETS_LOG2 | self.bucket[at])
            for k in (0, 1):
                having[k] += np.bincount((own & (size - 1))[label[own >> BUCKETS_LOG2] == k], minlength=size)
        total = np.array([[(label == k).sum()] for k in (0, 1)])
        yes, no = having + 0.5, total - having + 0.5
        odds = np.log(yes[1] / no[1]) - np.log(yes[0] / no[0])
        self.active = np.flatnonzero((np.abs(odds) >= TELLS * np.sqrt((1 / yes + 1 / no).sum(0))) & (having.sum(0) > 0))
        number = np.full(size, -1)
        number[self.active] = np.arange(len(self.active))
        kept = number[self.bucket] >= 0
        self.word, self.bucket, self.share = self.word[kept], number[self.bucket[kept]], self.share[kept]

    def down(self, table: np.ndarray) -> np.ndarray:
        """Mean over each passage's words of the mean of their buckets' values."""
        word = np.bincount(self.word, table[self.bucket] * self.share, len(self.vocabulary))
        return np.bincount(self.passage, word[self.words], len(self.length)) / self.length

    def up(self, err: np.ndarray) -> np.ndarray:
        """The gradient of each bucket's value, from that of each passage's mean."""
        word = np.bincount(self.words, (err / self.length)[self.passage], len(self.vocabulary))
        return np.bincount(self.bucket, word[self.word] * self.share, len(self.active))


def train(texts: list[str], labels: list[int], seed: int = 7):
    """(one number a bucket, the rest of the model): see `scores`.

    First every passage has its document's label; then only the highest passage of each document counts. A fifth
    of the documents is kept back to fit how the highest passage and the number of passages give the probability.
    """
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():  # nothing to tell apart
        share = (y.sum() + 0.5) / (len(y) + 1)
        return np.zeros(1 << BUCKETS_LOG2, np.float32), (0.0, 0.0, float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    back = rng.random(len(y)) < 0.2
    own = [x for x, b in zip(texts, back, strict=True) if not b]
    bag, label = Bag(own), y[~back]
    each = np.diff(bag.begin)
    doc = np.repeat(np.arange(len(label)), each)
    bag.keep(label, doc)
    size = len(bag.active)
    emb, out, bias = rng.normal(0, 0.1, (size, DIM)), rng.normal(0, 0.3, (DIM, 2)), np.zeros(2)
    state = [np.zeros_like(x) for x in (emb, out, bias, emb, out, bias)]
    balance = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum()))
    for step in range(1, STEPS + 1):
        # of two classes only the difference of the softmax inputs counts
        p1 = 1 / (1 + np.exp(-np.clip(bag.down(emb @ (out[:, 1] - out[:, 0])) + bias[1] - bias[0], -50, 50)))
        weight = (balance / np.maximum(1, each))[doc]
        if step > STEPS // 3:
            top = _tops(p1, bag.begin)
            weight = 0.2 * weight * (label[doc] == 0)
            weight[top] += balance[doc[top]]
        err1 = weight * (p1 - label[doc])
        g1 = bag.up(err1)
        g = np.stack([-g1, g1], 1)
        grads = (g @ out.T + DECAY * emb, emb.T @ g, np.array([-err1.sum(), err1.sum()]))
        for k, (x, d) in enumerate(zip((emb, out, bias), grads, strict=True)):
            state[k] = 0.9 * state[k] + 0.1 * d
            state[k + 3] = 0.99 * state[k + 3] + 0.01 * d * d
            x -= RATE * (state[k] / (1 - 0.9**step)) / (np.sqrt(state[k + 3] / (1 - 0.99**step)) + EPS)
    table = np.zeros(1 << BUCKETS_LOG2, np.float32)
    table[bag.active] = emb @ (out[:, 1] - out[:, 0])
    kept = [x for x, b in zip(texts, back, strict=True) if b]
    parts = [_highest(part, table) for part in _chunks(kept)]
    top, count = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0), np.zeros(0))
    return table, _calibrate(top, count, y[back])


def _highest(col: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's highest passage mean (0 without words) and its number of passages."""
    f = Features(*t.buffers(col))
    start, begin = _passages(f.text_words)
    sums = np.concatenate([[0], np.cumsum(f.word_sums(table))])
    mean = np.diff(sums[start]) / np.maximum(1, np.diff(start))
    top = np.zeros(len(begin) - 1)
    if len(mean):
        top[np.flatnonzero(np.diff(begin))] = mean[_tops(mean, begin)]
    return top, np.diff(begin)


def _calibrate(top: np.ndarray, count: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression of the label on the highest passage and the log of the number of passages (ridge, Newton steps)."""
    x = np.stack([top, np.log1p(count), np.ones(len(top))], 1)
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        w -= np.linalg.solve(hess, x.T @ (p - y) + 1e-2 * w)
    return tuple(map(float, w))


def _of_long(text: bytes, table: np.ndarray) -> tuple[float, int]:
    """Like `_highest` for one text of any length, a piece at a time: the next piece begins with the last passage of the one before, so passages are those of the whole text."""
    top, count, at, size = -np.inf, 0, 0, PIECE
    while at < len(text):
        end = at + size
        if end < len(text):
            cut = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end))
            end = cut if cut > at else min((c for c in (text.find(b" ", end), text.find(b"\n", end)) if c >= 0), default=len(text))
        data = np.frombuffer(text[at:end], np.uint8)
        f = Features(data, np.array([0, len(data)]))
        start, _ = _passages(f.text_words)
        n = len(start) - 1
        if end < len(text) and n == 1:
            size *= 2
            continue
        used = n - 1 if end < len(text) and n else n
        if used:
            sums = np.concatenate([[0], np.cumsum(f.word_sums(table))])
            top = max(top, float((np.diff(sums[start]) / np.maximum(1, np.diff(start)))[:used].max()))
            count += used
        at = at + int(np.flatnonzero((data & 0xC0) != 0x80)[f.first[start[used]] - 1]) if used < n else end
        size = PIECE
    return (top if count else 0.0), count


def scores(col: pa.Array, table: np.ndarray, rest: tuple[float, float, float]) -> np.ndarray:
    """Probability of label 1 for each text: a logistic function of its highest passage and the log of its number of passages."""
    _, offsets = t.buffers(col)
    top, count = np.zeros(len(col)), np.zeros(len(col))
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        if offsets[j] - offsets[i] > PIECE:
            top[i], count[i] = _of_long(col[i].as_py(), table)
        else:
            top[i:j], count[i:j] = _highest(col[i:j], table)
        i = j
    return 1 / (1 + np.exp(-np.clip(rest[0] * top + rest[1] * np.log1p(count) + rest[2], -50, 50)))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS):
    """The model from at most `rows` labelled documents that aren't held out, up to TRAIN_TOTAL bytes, trained in one task."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).select("doc_id", F.col("toxic").alias("label"))
    made = labelled_sample(docs, known, rows).mapInArrow(_train_task, "table binary, rest array<double>").first()
    return train([], []) if made is None else (np.frombuffer(bytes(made["table"]), np.float32), tuple(made["rest"]))


def _train_task(batches):
    table, rest = train(*held_texts(batches, TRAIN_TOTAL))
    yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary()), pa.array([list(rest)], pa.list_(pa.float64()))], names=["table", "rest"])


def toxicity(docs: DataFrame, model) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, held_out, score, predicted), a row for each row of docs.

    Null and empty texts score by the share of label 1 among short texts; words are lower-cased, a word right after itself counts once.
    Rows without doc_id aren't held out; further columns are left out; an empty table gives no rows.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB

    def run(batches):
        for batch in batches:
            for part in t.slices(batch, "text"):
                ids, held = (part.column(part.schema.get_field_index(c)) for c in ("doc_id", "held_out"))
                score = scores(t.column(part, "text"), *known.value)
                yield pa.RecordBatch.from_arrays([ids, held, pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
