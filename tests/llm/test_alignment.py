"""The alignment of two tokenizers against a plain version that encodes whole texts."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

from nilas.llm import alignment as al
from nilas.llm import common

A, B = f"{al.FOLDER}/byte_bpe_50k.json", f"{al.FOLDER}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def both():
    return al.Tokenizers(open(A, "rb").read(), open(B, "rb").read())


def plain(rows):
    """Rows (doc_id, text) as the query's, by the libraries on whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte = {c: x for x, c in zip([*range(33, 127), *range(161, 173), *range(174, 256)], [*map(chr, range(33, 127)), *map(chr, range(161, 173)), *map(chr, range(174, 256))], strict=True)}
    rest = [x for x in range(256) if x not in byte.values()]
    byte |= {chr(256 + k): x for k, x in enumerate(rest)}
    a_bytes = lambda i: bytes(byte[c] for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], Counter()
    for doc_id, text in rows:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        p, q = [a_bytes(i) for i in x], [b_bytes(i) for i in y]
        if not text or b"".join(p) != (" " + text).encode() or b"".join(q) != (" " + text).encode():
            docs.append((doc_id, 0, 0, [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(z) for z in p]).tolist(), np.cumsum([len(z) for z in q]).tolist()
        links, groups, i, j = [], [], 0, 0
        for end in sorted({*ends_a} & {*ends_b}):
            k, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            links.append((x[k - 1], y[m - 1]))
            groups.append(",".join(map(str, x[i:k])) + "|" + ",".join(map(str, y[j:m])))
            i, j = k, m
        counts.update(links)
        docs.append((doc_id, len(x), len(y), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return sorted(((d, m, n, len(k), len(k), sum(counts[z] == best[z[1]] for z in k), sum(counts[z] for z in k), s) for d, m, n, k, s in docs), key=repr), counts


def test_query_matches_plain_version(spark):
    common.ship(spark)
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    want, counts = plain(rows)
    seen = {}

    def watch(table):
        seen["pairs"] = {(r.a, r.b): (r.n_links, r.n_documents) for r in al.pair_counts(table).collect()}

    got = sorted((tuple(r) for r in al.alignment(spark.read.parquet(f"{DATA}/documents.parquet"), watch=watch).collect()), key=repr)
    assert got == want
    assert {k: n for k, (n, _) in seen["pairs"].items()} == dict(counts)
    assert all(0 < d <= n for n, d in seen["pairs"].values()) and any(d < n for n, d in seen["pairs"].values())
    assert sorted((tuple(r) for r in al.op13_alignment(spark, DATA).collect()), key=repr) == want


def test_awkward_rows(spark):
    common.ship(spark)
    texts = [None, "", " ", "  a  b ", "a\n b\r\n\tc;\r", "\nfoo", "x\x00y", "<s> a</s> <|endoftext|> it's", "\u00e9 \ufb01 \uff21\uff22 \u3000x a\u2003 b", "\u2581a", "word " * 20_000, "a" * 3000, "one two", "one two", "\U0001f642 na\u00efve e\u0301"]
    rows = [(i if i != 4 else None, x) for i, x in enumerate(texts)] + [(3, "one")]
    docs = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "doc_id long, text string, row int, chunk int")
    got = sorted((tuple(r) for r in al.alignment(docs).collect()), key=repr)
    assert got == plain(rows)[0]
    assert [r[1:] for r in got if r[0] == 9] == [(0, 0, 0, 0, 0, 0, "")]
    assert al.alignment(docs.where("false")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*" \n\t\r\x0b\x0c\x1c\x85\xa0\u2003\u3000\u2581", *"aZ09.,;:'!#{}()<>/_-", "'s", "the", "ing", " the", "));\r", "\u00e9", "\ufb01", "\u4e2d", "\U0001f642", "e\u0301", "\x00", "<s>", "<0x41>"]), max_size=30))
def test_cut_texts_give_the_tokens_of_whole_texts(both, parts):
    cut_as_whole(both, ["".join(parts)])


def cut_as_whole(both, texts):
    """Cut texts give the tokens of whole texts."""
    counts, digests, links = al.Aligner(both).texts(texts)
    good, n_a, n_b, n, all_links, groups = both.aligned([" " + (x or "") for x in texts])
    good &= [bool(x) for x in texts]
    assert counts.T.tolist() == [[*x] if g else [0, 0, 0] for x, g in zip(zip(n_a.tolist(), n_b.tolist(), n.tolist(), strict=True), good, strict=True)]
    assert digests == [hashlib.sha256(x).hexdigest() if g else "" for x, g in zip(groups, good, strict=True)]
    assert links.tolist() == all_links[np.repeat(good, n)].tolist()


def test_cut_texts_of_the_tables(both, spark):
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    cut_as_whole(both, [*texts, None, "", "a", "a\u2581 b", "x"])


def test_ranks_are_the_merges(both, spark):
    assert both.ranks is not None and both.cuttable
    texts = [" " + (r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()] + ["", " it's  1st\n\n x!!", "<|endoftext|> \u3000\U0001f642"]
    assert [both.ranks.encode_ordinary(x) for x in texts] == both.encode_a(texts)


def test_planes_hold_every_document():
    rng = np.random.default_rng(2)
    for total, links in ((300, 20_000), (5, 400), (1, 1), (40_000, 3000)):
        pair = rng.zipf(1.4, links).astype(np.uint64) % np.uint64(50) + (np.uint64(7) << np.uint64(32))
        documents = rng.integers(0, total, links)
        want, got, held = Counter(zip(pair.tolist(), documents.tolist(), strict=True)), Counter(), Counter()
        for a, b, k, n, counted, dense, stored in al.planes(pair, documents, total):
            for x, y, c, h, s in zip(a.tolist(), b.tolist(), n.tolist(), counted.tolist(), stored.to_pylist(), strict=True):
                d = al.numbers_of(s, dense)
                assert len(d) == c
                held[x << 32 | y] += h
                got.update({(x << 32 | y, int(i)): 1 << k for i in d})
        assert got == want and held == Counter(p for p, _ in want)
    assert list(al.planes(np.zeros(0, np.uint64), np.zeros(0, np.int64), 3)) == []


def test_large_vocabularies_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(al, "LARGEST", 10)
    with pytest.raises(ValueError, match="aren't broadcast"):
        al.vocabularies(spark, A, B)
