"""The training-data operators against brute force, round trips and held-out labels, with the edge cases of each."""

import base64
import hashlib
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA, rows_of, same_rows

from nilas.llm import common, decontaminate, html_text, mixing, ngram_join, pii, quality, queries, sharding, text, toxicity, url_filter, warc

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    common.ship(spark)


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


def edited(rng, words, share):
    words = words.split()
    for i in rng.choice(len(words), max(1, int(share * len(words))), replace=False):
        words[i] = f"x{rng.integers(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="session")
def corpus():
    """Copies, near copies at all distances, a passage that many share, and awkward rows."""
    rng = np.random.default_rng(3)
    base = [prose(rng, n) for n in (8, 30, 60, 120, 200, 400, 3000)]
    rows = [*base, *base[:3]]
    for b in base:
        rows += [edited(rng, b, s) for s in (0.002, 0.004, 0.008, 0.015, 0.03, 0.1) for _ in range(5)]
    hub = prose(rng, 150)
    for _ in range(60):
        hub = edited(rng, hub, 0.004)
        rows.append(hub)
    shared = prose(rng, 60)
    rows += [f"{prose(rng, 40)} {shared} {prose(rng, 40)}" for _ in range(30)]
    rows += ["", None, "one", "one", "one two", "ONE Two", " \n\t ", "one two three", "é é é é", "a" * 5000]
    return [(i * 3, t) for i, t in enumerate(rows)]


# Shared pieces.
def test_words_and_shingles_match_python():
    rng = np.random.default_rng(1)
    texts = ["", "a", " A b\tc\x0bd\n", "x\x1cy z", "Äé ÄÉ z", prose(rng, 3000), "long" * 200_000 + " tail", "  "]
    col = pa.array([t.encode() for t in texts], pa.large_binary())
    hashes, at, starts, ends = text.words(*text.buffers(col), bounds=True)
    data = b"".join(t.encode() for t in texts)
    want = [t.encode().lower().split() for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in want]
    assert [data[a:b].lower() for a, b in zip(starts, ends)] == [x for w in want for x in w]
    known = {}
    for h, w in zip(hashes.tolist(), (x for w in want for x in w)):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
    runs, begin = text.shingles(hashes, at, 3)
    assert np.diff(begin).tolist() == [len(w) - 2 if len(w) > 2 else min(1, len(w)) for w in want]


def test_components_in_one_round_and_in_many(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {x: root(x) for x in parent if root(x) != x}
    df = spark.createDataFrame(edges, "a long, b long")
    for size in (10**6, 50):
        assert {r.node: r.component for r in common.components(df, size).collect()} == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1. N-gram Jaccard join.
def brute_components(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    ids = sorted(sets)
    comp = {i: i for i in ids}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                comp[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("k", "num", "den", "block"), [(3, 90, 100, 2048), (5, 8, 10, 2048), (3, 8, 10, 4), (5, 5, 10, 2048)])
def test_jaccard_components_match_brute_force(spark, corpus, k, num, den, block):
    df = spark.createDataFrame(corpus, SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df, k, (num, den), block).collect()}
    assert got == brute_components(corpus, k, num, den)


def test_jaccard_awkward_rows(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (2, None), (3, ""), (2, None), (1, "a b c d")]
    df = spark.createDataFrame([(*r, 9, "z") for r in rows], SCHEMA + ", node long, page string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()), key=repr)
    assert got == sorted([(None, 1, None), (1, 1, 1), (1, 1, 1), (2, 0, 2), (2, 0, 2), (3, 0, 3)], key=repr)
    assert ngram_join.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pages_keep_every_link():
    """Any two sets over the threshold share a page, whatever is common."""
    rng = np.random.default_rng(9)
    bands = ngram_join.Bands(8, 10)
    for n in (1, 2, 5, 9, 18, 40, 150, 700):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            drop = rng.integers(0, max(1, len(a) // 5) + 1)
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, rng.integers(0, max(1, len(a) // 6) + 1), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 10 * both >= 8 * (len(a) + len(b) - both):
                common_ = np.sort(rng.choice(a, len(a) // 3, replace=False)) if n > 3 else np.zeros(0, np.uint64)
                assert set(ngram_join._pages(a, bands, common_)) & set(ngram_join._pages(b, bands, common_))


def test_largest_component_of_a_page_has_its_own_parts(spark):
    """Every two members of different components meet in one block; copies beside a few others go out about once more, however many they are."""
    comp = {**dict.fromkeys(range(1000), 0), **{n: n for n in range(1000, 1012)}}
    named = [(page, n, m, comp[n] * c) for page, of, m, c in ((1, range(1012), 1012, 1), (2, range(999, 1012), 13, 1), (3, range(500), 500, 0)) for n in of]
    got = ngram_join._blocks(spark.createDataFrame(named, "page long, node long, m long, comp long"), 20).collect()
    assert {r.page for r in got} == {1, 2}
    blocks = {}
    for r in got:
        for k in r.others:
            blocks.setdefault((r.page, min(r.part, k), max(r.part, k)), []).append((r.node, r.part))
    assert sum(len(x) for (page, _, _), x in blocks.items() if page == 1) <= 1000 + 12 * 52 and max(map(len, blocks.values())) < 80
    met = Counter((page, min(a, b), max(a, b)) for (page, i, j), x in blocks.items() for s, (a, p) in enumerate(x) for b, q in x[:s] if comp[a] != comp[b] and (i == j or p != q))
    assert met == {(page, a, b): 1 for page, of in ((1, range(1012)), (2, range(999, 1012))) for a in of for b in of if a < b and comp[a] != comp[b]}


def test_hot_page_of_copies_and_strangers_matches_brute_force(spark):
    """A passage that many share: near copies, texts that share half, and their links, with blocks far smaller than the page."""
    rng = np.random.default_rng(31)
    shared, own = prose(rng, 40).split(), lambda n: prose(rng, n).split()
    rows = [(i, " ".join(shared + own(int(rng.integers(0, 3))))) for i in range(40)] + [(100 + i, " ".join(shared + own(int(rng.integers(4, 16))))) for i in range(40)]
    rows += [(200 + i, t + " end") for i, t in rows[40:60]]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, SCHEMA), 3, (8, 10), 6).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 3, 8, 10)


# 2. Sharding.
def check_shards(rows, shards):
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))


def test_shards_balance_and_keep_equal_texts(spark, corpus):
    rng = np.random.default_rng(4)
    rows = corpus + [(10_000 + i, prose(rng, 30)) for i in range(600)] + [(20_000 + i, "same text of many") for i in range(900)]
    out = sharding.shard(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    check_shards(out, 8)
    load = Counter()
    for r in out:
        assert r["size"] == len((r.text or "").encode()) + 1
        load[r.shard] += r["size"]
    assert max(load.values()) - min(load.values()) <= 0.02 * sum(load.values())
    where = {}
    for r in out:
        if r.text != "same text of many":  # this group alone exceeds a shard's rows
            where.setdefault(r.text, set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_shards_awkward_rows(spark):
    rows = [(None, None, 5, 1), (None, None, 5, 1), (1, "", 5, 2), (1, "a", 5, 2)]
    out = sharding.shard(spark.createDataFrame(rows, SCHEMA + ", shard int, size int")).collect()
    check_shards(out, 8)
    assert len(out) == 4 and sharding.shard(spark.createDataFrame([], SCHEMA)).count() == 0
    names = ["_key", "_split", "_item", "_part", "_row", "_bucket", "_n", "_start", "_order", "c0"]
    rows = [(i % 3, ("long text " * 200_000 if i == 5 else f"t{i % 4}"), *[i] * len(names)) for i in range(12)]
    for parts in (1, 5):
        out = sharding.shard(spark.createDataFrame(rows, SCHEMA + "".join(f", {c} int" for c in names)).repartition(parts), 2)
        assert out.columns == ["doc_id", "text", *names, "size", "shard", "slot"]
        out = out.collect()
        check_shards(out, 2)
        assert sorted(tuple(r)[:-3] for r in out) == sorted(rows)


def test_slots_of_equal_ids_and_sizes_have_an_order(spark):
    docs = spark.createDataFrame([(1, f"text {i:03d}") for i in range(50)], SCHEMA)
    slots = [{(r.text, r.shard, r.slot) for r in sharding.shard(docs.repartition(n), 3).collect()} for n in (1, 4)]
    assert slots[0] == slots[1]


def test_op2_on_the_table(spark, oracle):
    out = queries.QUERIES["op2_sharding"](spark, DATA).collect()
    texts = dict(oracle.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    assert {r.doc_id: (r["size"], r.text_crc32) for r in out} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()}
    check_shards(out, 8)


# 3. WARC.
def test_archives_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    bodies = [f"<html><body>{prose(rng, n)}</body></html>" for n in rng.integers(1, 400, 60)]
    rows = [(i, f"http://h/{i}", bodies[i % 60]) for i in range(100)] + [(200, None, None), (201, "u\nv", ""), (None, "n", bodies[0]), (None, "m", "only here"), (0, "http://h/0", bodies[0]), (300, "é", "𝒳" * 100_000)]
    path = f"file://{tmp_path}/warc"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path)
    got = warc.read_archives(spark, path).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        lead = first.get(h or "")
        revisit = lead is not None and lead != i
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", lead if revisit else None))
        if not revisit:
            assert any(r.page_id == i and bytes(r.payload or b"") == body for r in got)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    archives = [f.read_bytes() for f in (tmp_path / "warc").glob("part-*") if f.stat().st_size]
    assert all(a[:4] == b"\x5d\x2a\x4d\x18" for a in archives)


def test_archives_end_at_their_size(spark, tmp_path):
    rng = np.random.default_rng(22)
    rows = [(i, None, rng.bytes(6000).hex()) for i in range(120)] + [(500 + i, None, "many copies") for i in range(300)]
    path, most = f"file://{tmp_path}/small", 50_000
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path, most)
    sizes = [f.stat().st_size for f in (tmp_path / "small").glob("part-*") if f.stat().st_size]
    assert len(sizes) > 10 and max(sizes) < 2 * most + (64 << 10)
    got = warc.read_archives(spark, path).collect()
    assert sorted(r.page_id for r in got) == sorted(r[0] for r in rows)
    assert sum(r.record_type == "response" for r in got) == 121 and {r.refers_to for r in got if r.record_type == "revisit"} == {500}
    assert {r.page_id: bytes(r.payload).decode() for r in got if r.payload is not None} == {i: h for i, _, h in rows if i <= 500}


@pytest.mark.parametrize("hot_bytes", [0, 3000, 1 << 40])
def test_copies_of_hot_pages_need_no_shuffle(spark, tmp_path, hot_bytes):
    rows = [(9 + i, None, "hot page " * 9) for i in range(300)] + [(1000 + i, "u", f"pair {i // 2}") for i in range(60)] + [(None, None, None), (None, None, ""), (None, "u", "no id"), (None, "u", "no id"), (2000, None, "alone")]
    path = f"file://{tmp_path}/hot"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path, hot_bytes=hot_bytes)
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(spark, path).collect())
    by_page = {}
    for i, _, html in rows:
        if i is not None:
            by_page[html or ""] = min(i, by_page.get(html or "", i))
    want = Counter()
    for i, _, html in rows:
        to = by_page.get(html or "")
        revisit = to is not None and to != i
        want[i, len(html or ""), "revisit" if revisit else "response", to if revisit else None] += 1
    assert got == want


def test_no_pages_no_records(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0


# 4. Toxicity.
def test_unseen_misspellings_score_high(spark):
    rng = np.random.default_rng(6)
    bad = ["horrible", "disgusting", "worthless"]

    def doc(toxic):
        w = list(rng.choice(WORDS, 60))
        if toxic:
            for i in rng.choice(60, 3, replace=False):
                w[i] = rng.choice(bad)
        return " ".join(w)

    labels = [int(i % 4 == 0) for i in range(900)]
    model = toxicity.train([doc(y) for y in labels], labels)
    score = lambda texts: toxicity.scores(pa.array([x.encode() for x in texts], pa.large_binary()), *model)
    assert (score([doc(1) for _ in range(50)]) >= 0.7).mean() > 0.9 and (score([doc(0) for _ in range(50)]) < 0.7).mean() > 0.9
    assert (score([doc(0) + " disgustingg worthles horible" for _ in range(20)]) >= 0.7).mean() > 0.6
    assert ((s := score(["", " ", "w1", "w1 " * 400_000])) >= 0).all() and (s <= 1).all()


def test_toxicity_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (None, "x", 0.1), (1, None, 0.1), (2, "", 0.1)], SCHEMA + ", score double")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, toxicity.fit(docs, labels)).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out) and [r.held_out for r in out if r.doc_id is None] == [False]
    assert toxicity.toxicity(spark.createDataFrame([], SCHEMA), toxicity.fit(docs, labels)).count() == 0


def test_passages_of_long_texts_are_those_of_the_whole(monkeypatch):
    rng = np.random.default_rng(1)
    table = rng.normal(0, 1, 1 << toxicity.BUCKETS_LOG2).astype(np.float32)
    texts = [" ".join("".join(rng.choice(list("abcdeäß𝒳"), rng.integers(1, 8))) + " ab ab ab" * (rng.random() < 0.1) for _ in range(2000)) for _ in range(2)]
    for x in [*texts, "x" * 3000, " " * 5000 + "a b", "a " * 4000, ""]:
        top, count = toxicity._highest(pa.array([x.encode()], pa.large_binary()), table)
        for piece in (100, 777, 5000):
            monkeypatch.setattr(toxicity, "PIECE", piece)
            assert toxicity._of_long(x.encode(), table) == (pytest.approx(top[0]), count[0])


@pytest.mark.parametrize(("sf", "precision", "recall"), [("sf0.01", 0.8, 0.5), ("sf0.1", 0.9, 0.7)])
def test_op4_on_held_out_labels(spark, sf, precision, recall):
    folder = f"/root/testdata/{sf}"
    if not Path(folder).exists():
        pytest.skip("no test tables")
    rows = toxicity.op4_toxicity(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet").where("toxic IS NOT NULL"), "doc_id").select("predicted", "toxic").collect()
    hit = sum(r.predicted == 1 == r.toxic for r in rows)
    assert hit >= precision * sum(r.predicted for r in rows) and hit >= recall * sum(r.toxic for r in rows)


def test_op4_holds_out_a_third(spark, oracle):
    out = queries.QUERIES["op4_toxicity"](spark, DATA).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in out)


# 5. URL filter.
def test_urls_parts_and_rules(spark):
    urls = {
        1: ("http://A.example.COM/en/7x?q", "a.example.com", "/en/7x", "example.com/en/7", "allow"), 2: ("x://com/en/", "com", "/en/", "com/en/", "block"), 3: ("http://notexample.com/fr/", "notexample.com", "/fr/", None, "allow"),
        4: ("http://b.example.net/de/81#t", "b.example.net", "/de/81", "example.net/de/8", "block"), 5: ("http://b.net/de/81", "b.net", "/de/81", "net/de/", "allow"), 6: (None, "", "", None, "allow"), 7: ("no scheme/en/", "", "", None, "allow"),
        8: ("http://h.org?x=/es/", "h.org", "", None, "allow"), 9: ("", "", "", None, "allow"), 10: ("a://b.com/en/://c", "b.com", "/en/://c", "com/en/", "block"),
    }
    pages = spark.createDataFrame([(i, u[0], "x") for i, u in urls.items()] + [(1, urls[1][0], "x")], "page_id long, url string, host string")
    out = url_filter.filter_urls(pages, spark.createDataFrame([], "page_id long, bad int")).collect()
    assert len(out) == 11 and all((r.host, r.path, r.rule, r.verdict) == urls[r.page_id][1:] for r in out)
    assert url_filter.filter_urls(pages.where("false"), spark.createDataFrame([], "page_id long, bad int")).count() == 0


def test_bad_hosts_are_blocked_by_their_bound(spark):
    rows = [(i, f"http://bad.site.xyz/{i}") for i in range(40)] + [(100 + i, f"http://good{i % 9}.other.xyz/{i}") for i in range(200)] + [(900, "http://new.other.xyz/")]
    outcomes = spark.createDataFrame([(i, int(i < 40 or i % 50 == 0)) for i, _ in rows if i != 900], "page_id long, bad int")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), outcomes).collect()}
    assert {got[i] for i in range(40)} == {"block"} and {got[i] for i, _ in rows if i >= 100} == {"allow"}


@pytest.mark.parametrize("hot_pages", [0, 10, 10**9])
def test_pages_of_hot_hosts_and_names_that_clash(spark, hot_pages):
    rows = [(i, f"http://bad.site.xyz/{i}", "a", i, "p") for i in range(40)] + [(100 + i, f"http://good{i % 9}.other.xyz/{i}", "b", i, "p") for i in range(60)] + [(900, None, None, None, None), (901, "x" * 100_000, "c", 1, "p"), (902, "http://com/en/" + "y" * 100_000, "c", 1, "p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, _low string, _fit long, bad string")
    outcomes = spark.createDataFrame([(i, int(i < 40)) for i, *_ in rows if i < 900] + [(None, 1)], "page_id long, bad int")
    out = url_filter.filter_urls(pages, outcomes, hot_pages=hot_pages)
    assert out.columns == ["page_id", "url", "_low", "_fit", "bad", "host", "path", "rule", "verdict"]
    got = out.collect()
    assert sorted((r.page_id, r._low or "", r._fit or 0, r.bad or "") for r in got) == sorted((i, a or "", b or 0, c or "") for i, _, a, b, c in rows)
    assert {r.page_id for r in got if r.verdict == "block"} == {*range(40), 902}


# 6. HTML.
def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a>menu</a></ul></nav><div class="ad">buy</div>
    <article><h1>Head &amp; line</h1><p><b>First
      par.<br><p>Short.<div class="share">tweet</div><p>A&nbsp;b &lt;i&gt; &#233;</p><section id="comments"><p>nice</p></section></article><aside>side</aside><footer>&copy;</footer></body></html>"""
    assert html_text.main_text(page) == "Head & line\nFirst par.\nShort.\nA b <i> é"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text('<article><p class="ad">buy<p>real text<ul class="menu"><li>a<li>b</ul><p>more') == "real text\nmore"
    assert len(html_text.main_text("<p>" + "word " * 200_000 + "</p>").split()) == 200_000


def test_loose_names_drop_nothing():
    body = "<h2 id='legal'>Law</h2><section id='legal-status'><p>One</p></section><div class='share-price'>Two</div><div id='search-results'>Three</div><h3 class='header' id='comments'>Four</h3>"
    want = "Law\nOne\nTwo\nThree\nFour"
    assert html_text.main_text(f"<article>{body}</article>") == want
    for wrapper in ("class='page with-sidebar'", "id='content' class='no-header'", "class='sidebar'", "id='header'"):
        assert html_text.main_text(f"<nav>menu</nav><div {wrapper}><article>{body}</article></div>") == want
        assert html_text.main_text(f"<div {wrapper}><p>{'long text ' * 40}</p></div><p>end of it</p>").startswith("long text")
    assert html_text.main_text(f"<form action='x'><main>{body}</main></form>") == want
    for part in ("class='ad'", "class='x share_buttons'", "id='siteFooter'", "role='navigation'", "id='comments'", "aria-label='Related posts'"):
        assert html_text.main_text(f"<article>{body}<div {part}>no</div></article>") == want
    assert html_text.main_text(f"<article>{body * 9}</article><div class='related'><article>card</article></div>") == "\n".join([want] * 9)


def test_article_tag_is_a_weight():
    long = [f"Paragraph {i} " + "of the main text " * 20 for i in range(4)]
    plain = "".join(f"<p>{x}</p>" for x in long)
    want = "\n".join(" ".join(x.split()) for x in long)
    links = "".join(f"<p><a href='{i}'>Link {i} to elsewhere</a></p>" for i in range(5))
    assert html_text.main_text(f"<div><article><a>Card</a></article></div><div>{plain}</div>") == want
    assert html_text.main_text(f"<article><h1>Head</h1><p>Start.</p></article><div>{plain}</div>").endswith(want)
    assert html_text.main_text(f"<main><h1>Head</h1>{plain}</main><div>{plain}</div>") == f"Head\n{want}\n{want}"
    assert html_text.main_text(f"<div>Site name</div><article><h1>Head</h1>{plain}{links}</article><div>Imprint</div>") == f"Head\n{want}"
    assert html_text.main_text(f"<article><p>a <a>b</a></p><p><a>c</a></p>{links}<p>d</p></article>") == "a b\nd"


def test_long_line_hides_no_paragraphs():
    ad, want = "<div class='ad'>buy</div>", ["Hi.", "w " * 5000, *("v " * 250 for _ in range(3)), "Short close.", "z " * 80, "The end."]
    for page in ("{}", "<div id='top'>Home</div><nav>a</nav><div>{}</div><nav>b</nav><div>Imprint</div>"):
        body = "".join(f"<p>{x}</p>{ad}" for x in want)
        assert html_text.main_text(page.format(body)).split("\n") == [x.strip() for x in want]
    quote = f"<div><p>{'w ' * 900}</p>{ad}<div>Quoted.</div>{ad}<p>{'v ' * 90}</p></div><nav>b</nav><div>Imprint</div>"
    assert "Quoted." in html_text.main_text(quote) and "Imprint" not in html_text.main_text(quote)


def test_op6_gives_the_articles(spark, oracle):
    got = {r.page_id: r for r in queries.QUERIES["op6_html_text"](spark, DATA).collect()}
    for page_id, source in oracle.sql("SELECT page_id, html FROM pages").fetchall():
        article = source[source.index("<article>") + 9 :].split("</article>")[0].replace("<b>", "")
        want = [" ".join(html_text.html.unescape(x).split()) for x in re.split(r"<[^>]*>", article)]
        assert got[page_id].text == "\n".join(x for x in want if x) and got[page_id].n_chars == len(got[page_id].text)


def test_markup_is_scanned_in_linear_time():
    for piece in ("<script ", "<svg>", '<a ="', "<!--", "<![CDATA[", "<", "&amp", "<a href='", "<nav><article>x</article></nav>", "<h1 id="):
        for tail in ("", '>"', "</svg></script>"):
            began = time.perf_counter()
            html_text.main_text(piece * ((1 << 19) // len(piece)) + tail)
            assert time.perf_counter() - began < 8, piece


def test_broken_and_nested_markup():
    cases = {
        "<p title=it's>Hello world</p><p>two</p>": "Hello world\ntwo",
        "a<!-- c -->b c": "ab c",
        "<p>x<script>var a='</p>'</script>y</p>": "xy",
        "<p>1 < 2 and 3 > 2 text</p>": "1 < 2 and 3 > 2 text",
        "<p>fine</p><p unclosed": "fine",
        "<article><p>a<p>b</article>": "a\nb",
        "<svg/><p>t</p>": "t",
        "<title>x<body><p>hello there</p>": "hello there",
        "x<select><option>1</select>y": "x y",
        "<p>a<b>c</b>d</p>": "acd",
        "<p>t</p></nav></article>": "t",
        '<article><div class="article-header"><h1>Title</h1></div><p>text of it</p><div class="related-studies-table">body</div></article>': "Title\ntext of it\nbody",
    }
    assert {k: html_text.main_text(k) for k in cases} == cases
    long = "<h1>T</h1><p>" + "long words here " * 60 + "</p><p>short one.</p>"
    menu = "<ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li><li>Legal</li></ul>"
    assert html_text.main_text(menu + long + menu).split("\n") == ["T", " ".join("long words here ".split() * 60), "short one."]


def test_articles_without_their_tag_are_found_too(oracle):
    for _, page in oracle.sql("SELECT page_id, html FROM pages").fetchall():
        if page and "<article>" in page:
            assert html_text.main_text(page.replace("<article>", "<div>").replace("</article>", "</div>")) == html_text.main_text(page)


def test_line_blocks_find_articles_when_no_tag_says_where(oracle):
    pages = [page for _, page in oracle.sql("SELECT page_id, html FROM pages").fetchall() if page]
    long = [page for page in pages if len(html_text.main_text(page)) > 2 * html_text.ENOUGH]  # a footer may be longer than the others
    assert len(long) > 0.8 * len(pages)
    for page in long:
        assert html_text.main_text(re.sub(r"<(/?)(?:article|main|nav|header|footer|aside|form)(?=[\s>])", r"<\1div", page)) == html_text.main_text(page)
    story = f"<h1>Head</h1><p>{'word ' * 60}</p><p>{'more ' * 40}</p>"
    want = "\n".join(["Head", " ".join(["word"] * 60), " ".join(["more"] * 40)])
    assert html_text.main_text(f"<div>{story}</div><div>Home</div><div>About us</div><div>Contact</div>") == want
    inner = f"<div>{story}<div>Told in a box.</div></div><div>Imprint</div>"
    assert html_text.main_text(inner) == want + "\nTold in a box."
    equal = "".join(f"<div><h2>Part</h2><p>{'word ' * 60}</p></div>" for _ in range(3))  # no box holds most of the text
    assert html_text.main_text(equal) == "\n".join(["Part", " ".join(["word"] * 60)] * 3)


def test_headlines_and_sections_of_articles_stay():
    body = f"<p>{'word ' * 60}</p>"
    words = " ".join(["word"] * 60)
    assert html_text.main_text(f"<article><header><h1>Head Line</h1><p>By them.</p></header>{body}</article>") == f"Head Line\nBy them.\n{words}"
    assert html_text.main_text(f"<header><h1>Site</h1></header><article>{body}</article>") == words
    assert html_text.main_text(f"<article>{body}<section class='legal'><p>A law.</p></section></article>") == f"{words}\nA law."
    assert html_text.main_text(f"<article>{body}<div class='comments'><p>First!</p></div><div class='ad'>Buy</div></article>") == words


def test_pages_awkward_rows(spark):
    pages = spark.createDataFrame([(None, None, None, "t"), (1, "u", "<p>x</p>", "t"), (1, "u", "<p>x</p>", "t")], "page_id long, url string, html string, text string")
    assert sorted((r.text, r.n_chars) for r in html_text.extract_text(pages).collect()) == [("", 0), ("x", 1), ("x", 1)]
    assert html_text.extract_text(pages.where("false")).count() == 0


# 7. Quality.
def test_order_of_rules_never_changes_verdicts(corpus):
    rng = np.random.default_rng(8)
    extra = [prose(rng, 80), "SHOUT " * 80, "### " * 90 + prose(rng, 60), "\n".join(["same line here again"] * 40), None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in corpus] + extra)], names=["text"])
    want = ~np.logical_or.reduce([r.rejects(quality.Texts(batch)) for r in quality.RULES])
    for _ in range(5):
        measured = quality.Measured(batch)
        assert (quality.verdicts(measured, tuple(rng.permutation(quality.RULES))) == want).all()
        every = measured.of(np.arange(batch.num_rows))
        for name in quality.MEASURES:  # rows that the cascade left out are measured too
            assert (getattr(every, name) == getattr(quality.Texts(batch), name)).all()
    assert want.any() and not want.all()
    order = quality.order(quality.RULES, {"symbols": 9, "repeats": 9}, {"symbols": 1.0, "repeats": 3.0})
    assert [r.name for r in order][-2:] == ["symbols", "repeats"] and len(order) == len(quality.RULES)


def test_rules_are_tried_in_tasks(spark, corpus):
    docs = spark.createDataFrame(corpus, SCHEMA)
    assert sorted(r.name for r in quality.ordered_rules(docs)) == sorted(r.name for r in quality.RULES)
    long = spark.createDataFrame([(1, "word and other words " * 200_000), (2, None), (2, None)], SCHEMA)
    assert [(r.doc_id, r.n_words, r.kept) for r in quality.quality_measures(long).orderBy("doc_id").collect()] == [(1, 800_000, False), (2, 0, False), (2, 0, False)]


def test_quality_filter_keeps_columns(spark):
    rng = np.random.default_rng(8)
    rows = [(1, prose(rng, 80), 7, "kept"), (1, prose(rng, 80), 7, "kept"), (2, "short", 7, "x"), (None, None, 7, "x"), (3, "", 7, "x")]
    docs = spark.createDataFrame(rows, SCHEMA + ", n_words int, kept string")
    assert [tuple(r) for r in quality.quality_filter(docs).collect()] == rows[:2]
    assert quality.quality_filter(docs.where("false")).count() == 0 and quality.quality_measures(docs.where("false")).count() == 0


# 8. Decontamination.
def brute_pairs(docs, items, k=5, t=0.8):
    grams = lambda x: {tuple(w[i : i + k]) for w in [(x or "").lower().split()] for i in range(len(w) - k + 1)}
    sets = {i: s for i, x in items if (s := grams(x))}
    return sorted((d, i, len(s), len(s & g)) for d, x in docs for g in [grams(x)] for i, s in sets.items() if len(s & g) >= t * len(s))


@pytest.mark.parametrize("block_words", [10**6, 40])
def test_contaminated_matches_brute_force(spark, block_words):
    rng = np.random.default_rng(12)
    items = [(i, prose(rng, n)) for i, n in enumerate([5, 6, 7, 9, 12, 20, 40, 90, 200, 4, 1])] + [(50, ""), (51, None), (52, None)]
    docs = []
    for i, (_, x) in enumerate(items[:9]):
        for n in (0, 50, 20_000):
            half = x.split()
            docs += [(i * 100_000 + n, f"{prose(rng, n)} {x.upper()} {prose(rng, n)}"), (i * 100_000 + n + 1, " ".join(half[: int(len(half) * 0.9)]) + " " + prose(rng, n)), (i * 100_000 + n + 2, " ".join(half[: len(half) // 2]))]
    docs += [(70, None), (80, ""), (None, items[5][1]), (90, items[5][1]), (90, items[5][1])]
    d, b = spark.createDataFrame([(*r, 1) for r in docs], SCHEMA + ", item_id int"), spark.createDataFrame(items, "item_id long, text string")
    key = lambda rows: sorted(rows, key=repr)
    got = decontaminate.contaminated(d, b, block_words=block_words).collect()
    assert key((r.doc_id, r.item_id, r.item_shingles, r.shared) for r in got) == key(brute_pairs([(a if a is not None else None, x) for a, x in docs], items) if all(a is not None for a, _ in docs) else pairs_with_nulls(docs, items))
    bad = Counter(r.doc_id for r in got)
    left = decontaminate.decontaminate(d, b, block_words=block_words).collect()
    assert sorted((r.doc_id or -1) for r in left) == sorted((a or -1) for a, _ in docs if a not in bad)
    loose = spark.createDataFrame([(None, x.replace(" ", "\n")) for _, x in items if x], "item_id long, text string")
    assert Counter(r.doc_id for r in decontaminate.contaminated(d, loose, block_words=block_words).collect()) == bad
    assert len(list(decontaminate._indexes(loose, 5, 40))) > 5
    assert decontaminate.contaminated(d.where("false"), b).count() == 0 and decontaminate.contaminated(d, b.where("false")).count() == 0


def pairs_with_nulls(docs, items):
    out = []
    for a, x in docs:
        out += [(a, i, n, s) for _, i, n, s in brute_pairs([(0, x)], items)]
    return out


# 9. Personal data.
PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    out = []
    for k, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(d[::-1])) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_match_plain_patterns(spark):
    texts = ["a@b.c.@d.e x", "é 𝒳 mail x.y+z@foo-bar.co.uk, 1.2.3.4.5.6.7.8 and 999.1.1.1 0001.2.3.4", "4242 4242 4242 4242 4 2", "+1 (234) 567-8901 +12 +1-2", "4111-1111-1111-1111 4111 1111  1111 1111", "", None]
    texts += ["x" * 20_000 + "@", "1" * 20_000, "1 " * 9000, "a@b" + ".c" * 9000, "0" * 400 + ".1.1.1", "+1 234 567 8901+1 234 567 8901 @ @@ a@@b.c"]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, texts[0], "c"), (0, texts[0], "c")], SCHEMA + ", spans string")
    out = pii.personal_data(docs).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        assert [(s.start, s.kind, s.end) for s in r.base] == brute_spans(texts[r.doc_id or 0])
    assert pii.personal_data(docs.where("false")).count() == 0


def test_revealing_terms_go(spark):
    rng = np.random.default_rng(10)
    rows = [(i, f"{prose(rng, 40)} Oberbuchhalter{i % 1 and ''} wrote boss@corp.example {prose(rng, 40)}") for i in range(6)]
    rows = [(i, re.sub(r"\bw(\d+)\b", r"word\1", t)) for i, t in rows] + [(100 + i, re.sub(r"\bw(\d+)\b", r"word\1", prose(rng, 80)) + " wrote") for i in range(60)]
    out = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(6):
        terms = {s.value for s in out[i].spans if s.kind == 4}
        assert "Oberbuchhalter" in terms and "wrote" not in terms
        assert "Oberbuchhalter" not in out[i].sanitised and "<email>" in out[i].sanitised and "boss@" not in out[i].sanitised
    assert all(not out[i].spans and out[i].sanitised == dict(rows)[i] for i in range(100, 160))


def test_terms_far_from_the_entity_go(spark):
    rng = np.random.default_rng(14)
    plain = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 2)) for _ in range(n))
    copy = plain(150).split()
    rows = [(i, f"Dear Zoë, {plain(60)} Regards from the desk of the treasury in town, as ever and always yours, boss@corp.example {plain(90)} Obmann") for i in range(5)]
    rows += [(50 + i, " ".join([*copy[:3 * i], "Quartz", *copy[3 * i :], "other@corp.example", plain(30)]) if i == 0 else " ".join(["Quartz", *copy, "other@corp.example"])) for i in range(5)]
    rows += [(100 + i, f"{plain(100)} regards from the desk of the treasury in town as ever and always yours") for i in range(200)]
    out = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(5):
        assert {s.value for s in out[i].spans if s.kind == 4} == {"Zoë", "Obmann", "Dear"} and "Zoë" not in out[i].sanitised
        assert not [s for s in out[50 + i].spans if s.kind == 4]  # copies are one text


def test_terms_of_kinds_and_secrets(spark):
    rng = np.random.default_rng(15)
    secret = lambda: rng.bytes(20).hex()
    plain = lambda n: prose(rng, n).translate({48 + i: "abcdefghij"[i] for i in range(10)})
    rows = [(i, f'{plain(40)} token = "{secret()}" {plain(30)}') for i in range(30)] + [(100 + i, plain(70)) for i in range(300)]
    rows += [(900, "ffffffffffffffffffffffff00000000000000000000 internationalisation20240101 a_name_of_some_length_with_words")]
    out = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(30):
        assert [s.value for s in out[i].spans if s.kind == 4] == ["token"] and [s.kind for s in out[i].spans].count(5) == 1 and not out[i].base
        assert '= "<secret>"' in out[i].sanitised and "token" not in out[i].sanitised
    assert all(not r.spans for i, r in out.items() if i >= 100)


def test_disclosure_matches_brute_force(spark):
    from pyspark.sql import functions as F

    rows = [(1000, 30, 30, 30, True), (1000, 30, 4, 4, True), (1000, 300, 12, 12, True), (1000, 5, 5, 4, False), (1000, 5, 50, 5, False)]
    df = spark.createDataFrame(rows, "n long, e long, t long, b long, k boolean")
    got = [r[0] for r in df.select(pii.disclosed(F.col("n"), F.col("e"), F.col("t"), F.col("b"), F.col("k"))).collect()]
    for x, (n, e, t, b, kind) in zip(got, rows, strict=True):
        mean = (b + pii.PRIOR * e / n) / (t + pii.PRIOR)
        p = mean - pii.BELOW * (mean * (1 - mean) / (t + pii.PRIOR + 1)) ** 0.5 if kind else b / t
        assert x == pytest.approx(np.log2(p * n / e) / np.log2(n / e))
    assert got[0] > pii.DISCLOSURE > max(got[1:3])


def test_many_matches_take_no_square_of_time(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "x@y.zz and +1 234 567 8901, " * 50_000)], SCHEMA)
    began = time.perf_counter()
    spans = pii.base_spans(F.col("text"))
    r = docs.select(F.size(spans).alias("n"), pii.sanitised(F.col("text"), spans).alias("s")).first()
    assert r.n == 100_000 and r.s == "<email> and <phone>, " * 50_000 and time.perf_counter() - began < 60


def test_op9_on_the_tables(spark, oracle):
    rows = {r.doc_id: r for r in pii.op9_personal_data(spark, DATA).collect()}
    texts = dict(oracle.sql("SELECT doc_id, text FROM documents").fetchall())
    assert rows.keys() == texts.keys()
    for i, r in rows.items():
        base = brute_spans(texts[i])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        written = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        spans = [x for x in r.spans.split(",") if x]
        assert [x for x in spans if x.split(":")[0] in pii.PATTERNS] == written
        assert all(re.search("[A-Za-z0-9_]{20}", texts[i][int(a) : int(b)]) for k, a, b in (x.split(":") for x in spans) if k == "secret")


# 10. Mixing.
def test_rates_meet_targets(spark):
    rng = np.random.default_rng(7)
    rows = [(i, *(float(x) for x in rng.dirichlet((6, 2, 1))), int(rng.integers(5, 400))) for i in range(800)]
    table = spark.createDataFrame(rows, "doc_id long, _p_clean double, _p_low double, _p_toxic double, _tokens long")
    targets = {"clean": 0.8, "low": 0.15, "toxic": 0.05}
    directions, goal = mixing.fit_rates(table, targets)
    rate = {r.doc_id: r.rate for r in table.select("doc_id", mixing._rate(directions).alias("rate")).collect()}
    have = np.zeros(3)
    for i, a, b, c, n in rows:
        assert rate[i] >= 0
        have += rate[i] * n * np.array([a, b, c])
    assert np.abs(have - goal).max() <= 1e-4 * sum(r[4] for r in rows)
    total = 5e4
    directions, goal = mixing.fit_rates(table, targets, total)
    assert goal.sum() == pytest.approx(total)


def test_classifier_on_held_out_labels(spark, oracle):
    rng = np.random.default_rng(13)

    def doc(y):
        w = list(rng.choice(WORDS, 70))
        if y == 2:
            w[5], w[30], w[60] = "awful", "awful", "vile"
        return " ".join(x + "###" for x in w) if y == 1 else " ".join(w)

    y = rng.choice(3, 900, p=[0.7, 0.15, 0.15])
    model = mixing.Classifier([doc(k) for k in y], list(y))
    new = rng.choice(3, 300)
    p = model.posteriors(pa.array([doc(k).encode() for k in new], pa.large_binary()))
    assert (p.argmax(1) == new).mean() > 0.95 and np.allclose(p.sum(1), 1)


def test_op10_meets_its_targets(spark):
    out = mixing.op10_mixing(spark, DATA).collect()
    total = {d: sum(r.rate * r.tokens * r[f"p_{d}"] for r in out) for d in mixing.DOMAINS}
    for d, share in mixing.TARGETS.items():
        assert total[d] / sum(total.values()) == pytest.approx(share, abs=1e-3)
    assert all(r.rate >= 0 and sum(r[f"p_{d}"] for d in mixing.DOMAINS) == pytest.approx(1) for r in out)


def test_what_a_domain_cannot_give_is_told(spark):
    table = spark.createDataFrame([(i, 10, 1.0, 0.0, 0.0) for i in range(5)], "doc_id long, _tokens long, _p_clean double, _p_low double, _p_toxic double")
    with pytest.warns(UserWarning, match="token totals differ"):
        _, goal = mixing.fit_rates(table)
    assert goal.sum() == pytest.approx(50 / 0.95)


def test_mixing_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "x", 1), (1, None, 1), (2, "", 1), (3, "a b", 1)], SCHEMA + ", rate int")
    for labels in ([], [(1, 1, 0), (3, 0, 0), (9, 1, None), (None, 1, 1)]):
        known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        assert mixing.mixing_rates(docs, known).where("rate >= 0").count() == 5
        assert mixing.mix(docs, known).columns == docs.columns
        named = spark.createDataFrame([(1, "a b", 7, 8, 9), (2, "long " * 100_000, 7, 8, 9)], SCHEMA + ", _tokens int, _p_clean int, c0 int")
        assert {tuple(r)[2:] for r in mixing.mix(named, known, slack=9.0).collect()} <= {(7, 8, 9)}
        assert mixing.mixing_rates(docs.where("false"), known).count() == 0


# Queries and the pipeline.
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, oracle, name):
    same_rows(spark, oracle, queries.QUERIES[name], queries.ORACLES[name])


def test_pipeline_stages(spark, oracle):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = common.saved(stage(spark, docs, DATA), name)
        before, after = {r[0] for r in docs.select("doc_id").collect()}, {r[0] for r in out.select("doc_id").collect()}
        assert after <= before and out.count() <= docs.count()
        if name == "near_duplicates":
            groups = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 8, 10)
            assert after == {i for i, (_, c) in groups.items() if c == i}
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
            assert before - after == {p[0] for p in brute_pairs([(r.doc_id, r.text) for r in docs.collect()], items)}
        elif name == "sharding":
            check_shards(out.collect(), 8)
            assert after == before
        if name != "sharding":
            assert out.columns == columns
        docs = out


def test_pipeline_takes_empty_tables_and_more_columns(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, None, None, None, None, 3), (None, "a b c", "en", "s", 5, 3)], SCHEMA + ", lang string, source string, n_chars long, size int")
    for d in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, d, DATA).collect()


def test_stages_on_awkward_rows(spark):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    a, b, long = prose(rng, 90), prose(rng, 80), prose(rng, 150_000)
    rows = [(1, a), (1, a), (2, a), (3, long), (4, long + " end"), (None, b), (5, b), (6, None), (7, ""), (8, b)]
    docs = spark.createDataFrame([(*r, "en", "s", 1, 9) for r in rows], SCHEMA + ", lang string, source string, n_chars long, node int")
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=repr)
    stage = {name: lambda d, run=run: run(spark, d, DATA) for name, run in corpus_pipeline.STAGES}
    assert {6, 7}.isdisjoint(ids(stage["quality"](docs)))
    assert ids(stage["near_duplicates"](docs)) == sorted([1, 1, 3, None, 5, 6, 7], key=repr)
    assert ids(stage["decontamination"](docs)) == ids(docs)
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").where("size(split(text, ' ')) > 8").first().text
    planted = spark.createDataFrame([(1, f"{long} {item} {long}"), (1, item), (2, a)], SCHEMA)
    assert ids(stage["decontamination"](planted)) == [2]
    mixed = Counter(ids(stage["mixing"](docs)))
    assert not mixed - Counter(ids(docs))
    shards = stage["sharding"](docs).collect()
    assert sorted((r.doc_id for r in shards), key=repr) == ids(docs)
    for s in {r.shard for r in shards}:
        assert sorted(r.slot for r in shards if r.shard == s) == list(range(sum(r.shard == s for r in shards)))


def test_rows_of_sorts():
    assert rows_of(["b", "a"], [(1, 2.0)]) == [(2.0, 1)]


def test_mixing_sends_only_buckets_that_tell_something(spark):
    """The driver's model and its broadcast are small and give what the whole table gives."""
    import pickle

    import numpy as np
    import pyarrow as pa

    from nilas.llm import mixing

    texts = [f"good word{i % 7} plain text number" if i % 3 else f"bad word{i % 5} nasty text" for i in range(90)]
    model = mixing.Classifier(texts, [0 if i % 3 else 2 for i in range(90)])
    assert len(pickle.dumps(model)) < 1 << 16
    again = pickle.loads(pickle.dumps(model))
    col = pa.array([x.encode() for x in texts[:9]], pa.large_binary())
    assert (again.posteriors(col) == model.posteriors(col)).all() and np.count_nonzero(model.table.any(1)) == np.count_nonzero(model.values.any(1))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = mixing.fit(docs, docs.selectExpr("doc_id", "CAST(doc_id % 3 > 0 AS INT) AS quality", "0 AS toxic"))
    assert "table" not in vars(made) and len(pickle.dumps(made)) < 1 << 16


def test_page_filter_lets_few_other_pages_pass(spark):
    """Of the pages of a turn that aren't kept, which share their low bits with those that are, few pass the filter, and all kept ones do."""
    import numpy as np
    import pyarrow as pa

    from nilas.llm import ngram_join as j
    from nilas.llm.common import key_filter

    pages = np.random.default_rng(5).integers(-(1 << 63), 1 << 63, 220_000) // j.TURNS * j.TURNS + 1
    kept = spark.createDataFrame([(int(p),) for p in pages[:20_000]], "page long")
    bits, wanted = j._page_filter(kept, 20_000), key_filter(spark.range(1))
    lists = pa.RecordBatch.from_arrays([pa.array([0]), pa.ListArray.from_arrays(pa.array([0, len(pages)], pa.int32()), pa.array(pages))], names=["doc_id", "p"])
    passed = np.concatenate([b.column(0).to_numpy() for b in j._entries(wanted, bits)([lists])])
    assert set(pages[:20_000].tolist()) <= set(passed.tolist())
    assert len(passed) - 20_000 <= 200_000 * 0.02
