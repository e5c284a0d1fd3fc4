"""Periodic runs against brute force, and the query against a plain version."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from conftest import DATA

from nilas.llm import common, periods, text
from nilas.llm.bits import Bits, Wavelet

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, least=12):
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, q, e - s) for (s, e), q in found.items())


def test_rank_and_successor():
    rng = np.random.default_rng(0)
    bits = rng.random(1000) < 0.3
    assert (Bits(bits).one(np.arange(1001)) == np.concatenate([[0], np.cumsum(bits)])).all()
    values = rng.permutation(500)
    w = Wavelet(values)
    for _ in range(300):
        lo, hi = sorted(rng.integers(0, 501, 2))
        x = int(rng.integers(0, 520))
        want = min((v for v in values[lo:hi] if v >= x), default=-1)
        assert w.successor(np.array([lo]), np.array([hi]), np.array([x]))[0] == want
    repeated = rng.integers(0, 9, 400)
    v, i = rng.integers(0, 9, 50), rng.integers(0, 401, 50)
    assert Wavelet(repeated).rank(v, i).tolist() == [int((repeated[:b] == a).sum()) for a, b in zip(v, i, strict=True)]


def _document(rng):
    n, few = int(rng.integers(0, 160)), int(rng.integers(1, 6))
    part = lambda most, kinds: rng.integers(0, kinds, int(rng.integers(1, most))).tolist()
    kind = rng.integers(0, 8)
    if kind == 0:
        return rng.integers(0, few, n).tolist()
    if kind == 1:
        return (part(40, 3) * 6)[:n]
    if kind == 2:  # many runs
        a, b = [0], [0, 1]
        while len(b) < n + 2:
            a, b = b, b + a
        return b[:n]
    if kind == 3:  # long stretches of one word
        x, y = [0] * int(rng.integers(1, 50)) + [1], [0] * int(rng.integers(1, 50)) + [1]
        return x + y + x + y + y + x + x
    if kind == 4:  # two stretches of one period that meet out of step
        x = ([0, 0, 1] * 15)[: int(rng.integers(3, 45))]
        return x + x + [2] + x + x + x + [0] * int(rng.integers(0, 30))
    if kind == 5:
        return ((part(8, 2) * 5 + part(8, 2) * 4) * 3)[:200]
    if kind == 6:
        return rng.integers(0, 50, n).tolist()
    x = part(160, 30)
    return x + part(5, 2) + x + x


def test_runs_match_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(40):
        docs = [_document(rng) for _ in range(20)] + [[], [1]]
        at = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        s, e, q = periods.runs(text.mix(np.array([x for d in docs for x in d], np.uint64) + np.uint64(7)), at)
        for k, d in enumerate(docs):
            own = (s >= at[k]) & (s < at[k + 1])
            assert list(zip((s[own] - at[k]).tolist(), q[own].tolist(), (e[own] - s[own]).tolist(), strict=True)) == brute_runs(d), d
    assert [len(x) for x in periods.runs(np.zeros(0, np.uint64), np.zeros(1, np.int64))] == [0, 0, 0]


def test_a_long_periodic_text_takes_few_steps():
    for words in ([0] * 60_000, list(range(7000)) * 8, ([0] * 500 + [1]) * 120):
        w = text.mix(np.array(words, np.uint64))
        s, e, q = periods.runs(w, np.array([0, len(words)]))
        assert (0, len(words)) in set(zip(s.tolist(), e.tolist(), strict=True)) and q[np.argmax(e - s)] == {60_000: 1, 56_000: 7000, 60_120: 501}[len(words)]


def plain(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n and doc_id is not None:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, q, size in found for i in range(s + q, s + size)}
    best = min(((-size, s, q) for s, q, size in found), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    out = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *out, sha("".join(f"{s},{size},{q}\n" for s, q, size in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_matches_plain_version(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: plain(r.doc_id, r.text) for r in docs if len(r.text or "") < 9000}
    common.ship(spark)
    got = {r.doc_id: tuple(r) for r in periods.op12_periodic_runs(spark, DATA).collect()}
    assert len(got) == len(docs) and len(short) > 100 and sum(r[1] > 0 for r in short.values()) > 10
    assert {k: got[k] for k in short} == short


def test_awkward_rows(spark):
    common.ship(spark)
    rows = [(1, None, 5), (None, "a b " * 20, 5), (2, "", 5), (2, "é " * 30, 5), (3, " \n ", 5), (4, "x\ty\x0bz " * 5, 5), (4, "x\ty\x0bz " * 5, 5), (5, "long" * 100_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periods.periodic_runs(docs).collect()), key=repr)
    long = "long" * 100_000
    want = [(1, 0, [], ""), (None, 40, [(0, 40, 2)], "a b"), (2, 0, [], ""), (2, 30, [(0, 30, 1)], "é"), (3, 0, [], ""), *[(4, 15, [(0, 15, 3)], "x y z")] * 2, (5, 1, [], long)]
    assert got == sorted(want, key=repr)
    assert periods.periodic_runs(docs.where("false")).count() == 0


@pytest.mark.parametrize("sizes", [[3, 0, 2], [0], [1]])
def test_rejoined(sizes):
    words = [f"w{i}é" for i in range(sum(sizes))]
    data, starts, ends, *_ = (lambda d: (d, *text.words(d, np.array([0, len(d)]), bounds=True)[2:]))(np.frombuffer("  ".join(words).encode(), np.uint8))
    at = np.concatenate([[0], np.cumsum(sizes)])
    assert text.rejoined(data, starts, ends, at).to_pylist() == [" ".join(words[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
