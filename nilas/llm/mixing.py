"""Soft-membership mixing of documents to target weights.

A classifier fitted on the labelled table gives each document posteriors of the domains. Rates r >= 0 of the documents are
fitted so that the expected tokens of each domain, sum r * tokens * posterior, meet the targets: projected
gradient steps on the squared distance, scaled by the token-weighted second moment of the posteriors of documents that still have a rate.
Each step is one distributed sum over the documents; a step's direction has one number a domain, so a document's rate
follows from its posteriors and the few directions so far.
"""

from __future__ import annotations

import warnings
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nilas.llm import text as t
from nilas.llm.common import held_texts, labelled_sample, renamed, saved

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.95, "low": 0.04, "toxic": 0.01}
#: Most labelled documents the classifier is fitted on, in the order of their hash, and the most bytes of all; buckets of words.
TRAIN_ROWS, TRAIN_TOTAL, BUCKETS_LOG2 = 12_000, 32 << 20, 20
#: Steps of the fit of rates, and its tolerance as a share of all tokens.
STEPS, TOLERANCE = 25, 1e-6
MIN_SEEN, PRIOR = 5, 3.0
#: Measures of style.
STYLES = 6


def domain_of(quality: Column, toxic: Column) -> Column:
    """The labelled domain; null labels count as 0 for toxic and give no domain for quality."""
    return F.when(toxic == 1, F.lit("toxic")).when(quality == 0, F.lit("low")).when(quality == 1, F.lit("clean"))


def _measures(col: pa.Array):
    """Words of each text, their buckets, and measures of style."""
    data, offsets = t.buffers(col)
    hashes, at = t.words(data, offsets)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])
    n = np.diff(at)
    repeated = np.zeros(len(hashes), bool)
    repeated[1:] = hashes[1:] == hashes[:-1]
    again = np.diff(np.concatenate([[0], np.cumsum(repeated)])[at])
    upper, lower = total((data >= 65) & (data <= 90)), total((data >= 97) & (data <= 122))
    symbols = total(np.isin(np.arange(256), list(b"#*$%&|<>!"))[data])
    style = np.stack([np.log1p(n), symbols / np.maximum(1, n), upper / np.maximum(1, upper + lower), again / np.maximum(1, n), total(~t.SPACE[data]) / np.maximum(1, n), (n < 50).astype(float)], 1)
    return (hashes >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64), at, style


def _evidence(buckets: np.ndarray, at: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each domain the mean and the largest of the words' evidence."""
    n, out = np.diff(at), []
    full = np.flatnonzero(n)
    for k in range(table.shape[1]):
        v = table[buckets, k]
        mean, top = np.zeros(len(n)), np.zeros(len(n))
        if len(full):
            mean[full] = np.add.reduceat(v, at[:-1][full]) / n[full]
            top[full] = np.maximum.reduceat(v, at[:-1][full])
        out += [mean, top]
    return np.stack(out, 1)


class Classifier:
    """Softmax regression on style and on word evidence, which is learned on one half of the labelled documents and weighed on the other."""

    def __init__(self, texts: list[str], labels: list[int], seed: int = 11):
        k, y = len(DOMAINS), np.array(labels, int)
        first = np.random.default_rng(seed).random(len(y)) < 0.5
        size = np.bincount(y[first], minlength=k) + 2.0
        seen = np.zeros((1 << BUCKETS_LOG2, k), np.float32) + (PRIOR * size / size.sum()).astype(np.float32)  # a word not seen tells nothing
        docs = np.zeros(1 << BUCKETS_LOG2, np.int32)
        for own in np.flatnonzero(first):
            used = np.unique(_measures(pa.array([texts[own].encode()], pa.large_binary()))[0])
            seen[used, y[own]] += 1
            docs[used] += 1
        self.at = np.flatnonzero(docs >= MIN_SEEN)
        seen = seen[self.at]
        self.values, every = np.zeros_like(seen), seen.sum(1)
        for d in range(k):
            self.values[:, d] = np.log(seen[:, d] / size[d] / ((every - seen[:, d]) / (size.sum() - size[d])))
        self.center, self.scale, self.weights = 0.0, 1.0, np.zeros((1, k))
        rest = np.flatnonzero(~first)
        if not len(rest):
            self.weights = np.zeros((self.features(pa.array([b""], pa.large_binary()), raw=True).shape[1] + 1, k))
            return
        x = np.concatenate([self.features(pa.array([texts[i].encode() for i in rest[s : s + 100]], pa.large_binary()), raw=True) for s in range(0, len(rest), 100)])
        self.center, self.scale = x.mean(0), x.std(0) + 1e-9
        x = np.concatenate([(x - self.center) / self.scale, np.ones((len(x), 1))], 1)
        goal, w = np.eye(k)[y[rest]], np.zeros((x.shape[1], k))
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, 601):
            d = x.T @ (_softmax(x @ w) - goal) / len(x) + 1e-4 * w
            m, v = 0.9 * m + 0.1 * d, 0.99 * v + 0.01 * d * d
            w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights = w

    @classmethod
    def of(cls, at: np.ndarray, values: np.ndarray, center, scale, weights: np.ndarray) -> Classifier:
        """A classifier with the evidence (values) of the buckets `at`, which has no table before it is used."""
        model = cls.__new__(cls)
        model.at, model.values, model.center, model.scale, model.weights = at, values, center, scale, weights
        return model

    @cached_property
    def table(self) -> np.ndarray:
        """The evidence of all buckets, 12 MB: tasks make it, the driver and broadcasts hold only buckets that tell something."""
        table = np.zeros((1 << BUCKETS_LOG2, len(DOMAINS)), np.float32)
        table[self.at] = self.values
        return table

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def features(self, col: pa.Array, raw: bool = False) -> np.ndarray:
        buckets, at, style = _measures(col)
        x = np.concatenate([style, _evidence(buckets, at, self.table)], 1)
        return x if raw else np.concatenate([(x - self.center) / self.scale, np.ones((len(x), 1))], 1)

    def posteriors(self, col: pa.Array) -> np.ndarray:
        return _softmax(self.features(col) @ self.weights)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _fit_task(batches):
    texts, labels = held_texts(batches, TRAIN_TOTAL)
    model = Classifier(texts, [DOMAINS.index(d) for d in labels])
    yield pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()], pa.binary()) for x in (model.at.astype(np.int32), model.values)), *(pa.array([np.ravel(x).astype(float).tolist()]) for x in (model.center, model.scale, model.weights))], names=["at", "values", "center", "scale", "weights"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Classifier:
    """The classifier from at most `rows` labelled documents, up to TRAIN_TOTAL bytes, trained in one task."""
    known = labels.where("doc_id IS NOT NULL").select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("label")).where("label IS NOT NULL")
    kinds = "at binary, `values` binary, center array<double>, scale array<double>, weights array<double>"
    made, k = labelled_sample(docs, known, rows).mapInArrow(_fit_task, kinds).first(), len(DOMAINS)
    if made is None:
        return Classifier.of(np.zeros(0, np.int32), np.zeros((0, k), np.float32), 0.0, 1.0, np.zeros((STYLES + 2 * k + 1, k)))
    numbers = lambda c, kind: np.frombuffer(bytes(made[c]), kind)
    return Classifier.of(numbers("at", np.int32), numbers("values", np.float32).reshape(-1, k), np.array(made["center"]), np.array(made["scale"]), np.array(made["weights"]).reshape(-1, k))


def with_posteriors(docs: DataFrame, model: Classifier, names: list[str]) -> DataFrame:
    """docs with tokens (words) and the posteriors p_<domain>, of the columns `names`."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in t.slices(batch, "text"):
                col = t.column(part, "text")
                tokens = np.diff(t.words(*t.buffers(col))[1])
                p = known.value.posteriors(col)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names), pa.array(tokens), *(pa.array(p[:, k].copy()) for k in range(len(DOMAINS)))], names=[*names, "_tokens", *(f"_p_{d}" for d in DOMAINS)])

    schema = docs.select(*names).schema
    schema.add("_tokens", "long")
    for d in DOMAINS:
        schema.add(f"_p_{d}", "double")
    return docs.mapInArrow(run, schema)


def _rate(directions: list[np.ndarray]) -> Column:
    rate = F.lit(1.0)
    for v in directions:
        rate = F.greatest(F.lit(0.0), rate - sum(F.col(f"_p_{d}") * float(x) for d, x in zip(DOMAINS, v, strict=True)))
    return rate


def fit_rates(table: DataFrame, targets: dict[str, float] = TARGETS, total: float | None = None, slack: float = 1.0, repeats: bool = True) -> tuple[list[np.ndarray], np.ndarray]:
    """Directions whose steps give each document's rate, and the token totals aimed at. A difference to them that no step takes away is warned of.

    total: tokens to end with, of which each domain gets its weight. By default the domain of the largest weight keeps all its tokens and the
    others get theirs in proportion; unless repeats is allowed, rates over 1 have no use, and none gets more than it has. slack raises the totals by a factor.
    """
    p = [F.col(f"_p_{d}") for d in DOMAINS]
    n = len(DOMAINS)

    def sums(directions):
        own = table.withColumn("_rate", _rate(directions))
        active = F.when(F.col("_rate") > 0, F.col("_tokens")).otherwise(F.lit(0))
        cells = [F.sum(F.col("_rate") * F.col("_tokens") * x) for x in p] + [F.sum(active * p[i] * p[j]) for i in range(n) for j in range(n)] + [F.sum("_tokens")]
        row = [x or 0.0 for x in own.agg(*(c.alias(f"c{i}") for i, c in enumerate(cells))).first()]
        return np.array(row[:n]), np.array(row[n:-1]).reshape(n, n), float(row[-1])

    directions, goal, left = [], np.zeros(n), np.full(n, np.inf)
    weight = np.array([targets[d] for d in DOMAINS]) / sum(targets.values())
    for step in range(STEPS + 1):
        have, moment, tokens = sums(directions)
        if not step:
            goal = weight * (have[weight.argmax()] / weight.max() if total is None else total)
            goal = (goal if repeats else np.minimum(have, goal)) * slack
        before, left = left, have - goal
        if tokens == 0 or np.abs(left).max() <= TOLERANCE * tokens:
            break
        if step == STEPS or np.abs(left - before).max() <= TOLERANCE * tokens:  # no further step helps
            warnings.warn(f"token totals differ from their targets by {dict(zip(DOMAINS, left.round(1).tolist(), strict=True))}", stacklevel=2)
            break
        directions.append(np.linalg.solve(moment + 1e-9 * tokens * np.eye(n), left))
    return directions, goal


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, total: float | None = None) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, tokens, p_<domain> of each, rate), a row for each row of docs.

    Null and empty texts have no tokens; their rate follows their posteriors like any other. Without labels all domains are equally likely.
    A domain short of tokens has rates over 1, and a difference that no step takes away is warned of.
    Repeated rows and null ids are rows like others; further columns are left out; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    table = saved(with_posteriors(docs, fit(docs, labels), ["doc_id"]), "posteriors")
    directions, _ = fit_rates(table, targets, total)
    return table.select("doc_id", F.col("_tokens").alias("tokens"), *(F.col(f"_p_{d}").alias(f"p_{d}") for d in DOMAINS), _rate(directions).alias("rate"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, slack: float = 1.02) -> DataFrame:
    """The rows of docs chosen at their rates, with all their columns: a row stays if the hash of its id and text falls below its rate.

    No row is repeated: rates over 1 count as 1, and a domain that has less than its share keeps what it has. With slack, documents plainly of the domain with the largest weight all stay.
    Null and empty texts are drawn by their posteriors; repeated rows stay or go together; columns may have any name; an empty table gives no rows.
    """
    docs, names = renamed(docs, "doc_id", "text")
    table = saved(with_posteriors(docs, fit(docs, labels), docs.columns), "posteriors")
    directions, _ = fit_rates(table, targets, slack=slack, repeats=False)
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    return table.where(draw < _rate(directions)).select(*docs.columns).toDF(*names)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
