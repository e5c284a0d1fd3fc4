"""Repeated windows against brute force."""

import re

import numpy as np
import pytest

from nilas.llm import common, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=13):
    low, out = {}, []
    split = [(d, WORD.findall(x or "")) for d, x in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if d is not None:
                low[k] = min(low.get(k, d), d)
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and low[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def longest(pattern, text):
    return max((k for k in range(len(pattern) + 1) if any(text[i : i + k] == pattern[:k] for i in range(len(text) - k + 1))), default=0)


def test_matching_statistics_of_other_texts():
    rng = np.random.default_rng(4)
    for kinds, depth in ((2, 5), (3, 13), (40, 4)):
        text = rng.integers(1, kinds + 1, 300)
        text[rng.integers(0, 300, 12)] = text[-1] = 0
        index = substring.Index(text, depth)
        sizes = rng.integers(0, 25, 20)
        at = np.concatenate([[0], np.cumsum(sizes)])
        query = np.where(rng.random(at[-1]) < 0.5, rng.integers(1, kinds + 3, at[-1]), 1)
        for k in range(0, 12, 3):  # pieces of the text
            query[at[k] : at[k + 1]] = text[k * 20 : k * 20 + sizes[k]]
        length, row = substring.matching_statistics(index, query, at)
        for k in range(20):
            for i in range(at[k], at[k + 1]):
                end = next((j for j in range(i, at[k + 1]) if query[j] == 0), at[k + 1])
                want = longest(query[i : min(end, i + depth)].tolist(), text.tolist())
                assert length[i] == want
                if want:
                    assert text[index.order[row[i]] :][:want].tolist() == query[i : i + want].tolist()


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(300)] + ["é", "ÄB", "x,y."]
    prose = lambda n: " ".join(rng.choice(words, n))
    passage, line = prose(40), prose(13)
    out = [prose(int(n)) for n in rng.integers(0, 200, 60)]
    out += [f"{prose(int(rng.integers(0, 60)))} {passage}\n{prose(int(rng.integers(0, 60)))}" for _ in range(40)]
    out += [f"{prose(5)}  {line}\t{prose(5)}" for _ in range(50)] + [out[70]] * 6 + [out[3] + " " + out[3]]
    out += ["a " * 400, "a " * 30, "b a " * 50, None, "", " \n ", prose(12), line, passage.upper(), "long" * 60_000]
    ids = rng.permutation(len(out))
    rows = [(int(i) * 7, x) for i, x in zip(ids, out, strict=True)]
    return rows + [(rows[70][0], out[71]), (rows[70][0], out[70]), (rows[75][0], None), (None, out[75]), (None, line)]


@pytest.mark.parametrize("options", [{}, {"many": 3}, {"many": 20, "shard_bytes": 4000}, {"anchor": 1}, {"anchor": 13}])
def test_matches_brute_force(spark, rows, options):
    common.ship(spark)
    docs = spark.createDataFrame([(i, x, 1, "k") for i, x in rows], "doc_id long, text string, start int, key string").repartition(5)
    out = substring.substring_dedup(docs, **options).collect()
    got = sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r.kept) for r in out), key=repr)
    assert got == brute(rows)
    assert all(a.end < b.start for r in out for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_another_window_and_no_rows(spark, rows):
    common.ship(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r.kept) for r in substring.substring_dedup(docs, window=6, anchor=3).collect()), key=repr)
    assert got == brute(rows, 6)
    assert substring.substring_dedup(docs.where("false")).count() == 0
