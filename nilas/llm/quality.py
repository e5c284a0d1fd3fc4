"""Quality rules as a short-circuit cascade, ordered by rejections per cost."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nilas.llm import text as t

#: About so many rows, drawn at random, on which costs and rejections are estimated. They set the order of the rules, never a verdict.
SAMPLE = 1024


class Texts:
    """Measures of a batch of texts, each computed when first asked for."""

    def __init__(self, part: pa.RecordBatch):
        self.part = part
        self.col = t.column(part, "text")
        self.data, self.offsets = t.buffers(self.col)

    def _sum(self, flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[self.offsets])

    @cached_property
    def words(self):
        return t.words(self.data, self.offsets, lower=False)

    @cached_property
    def n_words(self) -> np.ndarray:
        space = t.SPACE[self.data]
        first = ~space
        first[1:] &= space[:-1]
        at = self.offsets[:-1]
        at = at[at < len(space)]
        first[at] = ~space[at]
        return self._sum(first)

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self._sum(((self.data & 0xC0) != 0x80) & ~t.SPACE[self.data])

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self._sum(np.isin(np.arange(256), list(b"#*$%&|<>"))[self.data])

    @cached_property
    def n_upper(self) -> np.ndarray:
        return self._sum((self.data >= 65) & (self.data <= 90))

    @cached_property
    def n_lower(self) -> np.ndarray:
        return self._sum((self.data >= 97) & (self.data <= 122))

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and those of them equal to an earlier line."""
        full, again = [], []
        for x in self.col:
            own = [line for line in x.as_py().split(b"\n") if line.split(None, 1)]
            full.append(len(own))
            again.append(len(own) - len(set(own)))
        return np.array(full, np.int64), np.array(again, np.int64)

    @cached_property
    def n_lines(self) -> np.ndarray:
        return self._lines[0]

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        return self._lines[1]

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        hashes, at = self.words
        runs, begin = t.shingles(hashes, at, 3, short=False)
        each = np.diff(begin)
        owner = np.repeat(np.arange(len(each)), each)
        _, back, count = np.unique(t.mix(runs ^ t.mix(owner.astype(np.uint64))), return_inverse=True, return_counts=True)
        where = (np.arange(len(runs)) - np.repeat(begin[:-1], each) + np.repeat(at[:-1], each))[count[back] > 1]
        covered = np.zeros(len(hashes) + 1, bool)
        for k in range(3):
            covered[where + k] = True
        return np.diff(np.concatenate([[0], np.cumsum(covered[:-1])])[at])


class Measured:
    """Measures of a batch of texts of which each row's is computed once, when a rule or the result asks for it."""

    def __init__(self, part: pa.RecordBatch):
        self.part, self.known, self.values = part, {}, {}

    def get(self, name: str, rows: np.ndarray) -> np.ndarray:
        known = self.known.setdefault(name, np.zeros(self.part.num_rows, bool))
        values = self.values.setdefault(name, np.zeros(self.part.num_rows, np.int64))
        todo = rows[~known[rows]]
        if len(todo):
            values[todo] = getattr(Texts(self.part if len(todo) == self.part.num_rows else self.part.take(pa.array(todo))), name)
            known[todo] = True
        return values[rows]

    def of(self, rows: np.ndarray) -> Rows:
        return Rows(self, rows)


class Rows:
    """Some rows of a batch; attributes are their measures."""

    def __init__(self, batch: Measured, rows: np.ndarray):
        self._batch, self._rows = batch, rows

    def __getattr__(self, name: str) -> np.ndarray:
        return self._batch.get(name, self._rows)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Texts | Rows], np.ndarray]


RULES = (
    Rule("few_words", lambda x: x.n_words < 50),
    Rule("repeats", lambda x: 100 * x.n_repeat_words > 50 * x.n_words),
    Rule("symbols", lambda x: 100 * x.n_symbols > 20 * x.n_words),
    Rule("repeated_lines", lambda x: 100 * x.n_dup_lines > 50 * x.n_lines),
    Rule("shouting", lambda x: 100 * x.n_upper > 60 * (x.n_upper + x.n_lower)),
    Rule("word_length", lambda x: (x.word_chars > 20 * x.n_words) | (x.word_chars < 2 * x.n_words)),
)
BASE = ("few_words", "repeats")


def order(rules: tuple[Rule, ...], rejected: dict[str, int], seconds: dict[str, float]) -> tuple[Rule, ...]:
    """The rules by falling rejections per second; a rule that wasn't tried keeps its place at the front."""
    rate = {r.name: (rejected[r.name] + 0.5) / (seconds[r.name] + 1e-9) if r.name in seconds else float("inf") for r in rules}
    return tuple(sorted(rules, key=lambda r: -rate[r.name]))


def verdicts(batch: Measured, rules: tuple[Rule, ...]) -> np.ndarray:
    """Which rows pass all rules; a rule sees only the rows that the ones before left."""
    left = np.arange(batch.part.num_rows)
    for rule in rules:
        if not len(left):
            break
        left = left[~rule.rejects(batch.of(left))]
    kept = np.zeros(batch.part.num_rows, bool)
    kept[left] = True
    return kept


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judge(rules, measures: bool, names: list[str]):
    def run(batches):
        for batch in batches:
            for part in t.slices(batch, "text"):
                x = Measured(part)
                kept = verdicts(x, rules)
                if not measures:
                    yield part.filter(pa.array(kept)).select(names)
                    continue
                every = x.of(np.arange(part.num_rows))  # what the cascade left out is measured now
                failed = np.logical_or.reduce([r.rejects(every) for r in RULES if r.name in BASE])
                ids = part.column(part.schema.get_field_index("doc_id"))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(getattr(every, m)) for m in MEASURES), pa.array(failed), pa.array(kept)], names=["doc_id", *MEASURES, "base_failed", "kept"])

    return run


def _tried(rules):
    """Rows (rule, rejected, seconds) for each batch."""

    def run(batches):
        for batch in batches:
            for part in t.slices(batch, "text"):
                rejected, seconds = [], []
                for rule in rules:
                    began = time.perf_counter()
                    rejected.append(int(rule.rejects(Texts(part)).sum()))
                    seconds.append(time.perf_counter() - began)
                yield pa.RecordBatch.from_arrays([pa.array([r.name for r in rules]), pa.array(rejected, pa.int64()), pa.array(seconds)], names=["rule", "rejected", "seconds"])

    return run


def ordered_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """The rules in the order that the sample suggests; it is tried in tasks, and only a sum for each rule comes to the driver."""
    docs = docs.select("text")
    some = docs.sample(min(1.0, SAMPLE / max(1, docs.count())), seed=7)
    found = some.mapInArrow(_tried(rules), "rule string, rejected long, seconds double").groupBy("rule").agg(F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds")).collect()
    return order(rules, {r["rule"]: r["rejected"] for r in found}, {r["rule"]: r["seconds"] for r in found})


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs (with a column text) that no rule rejects, with all their columns.

    Null and empty texts have no words and are rejected. Repeated rows stay repeated; an empty table stays empty. Long texts are measured whole. The order
    of the rules, estimated on about SAMPLE rows, changes the time taken, not the rows kept.
    """
    return docs.mapInArrow(_judge(ordered_rules(docs, rules), False, docs.columns), docs.schema)


def quality_measures(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs (doc_id, text) -> doc_id, the measures, base_failed and kept, a row for each row of docs."""
    docs = docs.select("doc_id", "text")
    kinds = ", ".join(f"{m} long" for m in MEASURES)
    return docs.mapInArrow(_judge(ordered_rules(docs, rules), True, []), f"doc_id long, {kinds}, base_failed boolean, kept boolean")


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_measures(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r WHERE n > 1) GROUP BY 1),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
      CAST(len(l) AS BIGINT) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS u, length(regexp_replace(text, '[^a-z]', '', 'g')) AS v
      FROM w JOIN l USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 50 * n_lines
            OR 100 * u > 60 * (u + v) OR word_chars > 20 * n_words OR word_chars < 2 * n_words) AS kept FROM m
"""
