"""Operator 1 and its kernel against brute force."""

import random
from collections import Counter
from hashlib import sha256

import pytest
from corpusloom.llm import gsaca, suffix


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_linear_grouping_sorts_suffixes(spark):
    r = random.Random(1)
    texts = [bytes(r.choice(b"ab" if i % 3 else b"abcdefgh\xff") for _ in range(r.randrange(1, 90))) for i in range(300)] + [b"a" * 50, b"ab" * 40, b"ba" * 31 + b"b"]
    f = gsaca.register(spark)
    got = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "i int, t binary").selectExpr("i", f"{f}(array(t), array(1L), 0)[0] AS sa")
    for x in got.collect():
        t = texts[x["i"]]
        assert x["sa"] == sorted(range(len(t)), key=lambda k, t=t: t[k:])


def brute(texts, width):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        kept = bytes(c for c, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    common, passage, frame = prose(12), prose(60), prose(30)
    texts = [prose(r.randrange(0, 120)) for _ in range(40)]
    texts += [prose(r.randrange(3, 30)) + common + prose(r.randrange(3, 30)) for _ in range(40)]
    texts += [prose(20) + passage[r.randrange(0, 200) :] + prose(5) for _ in range(6)]
    texts += [frame[:k] + word() + frame[k:] for k in range(10, 150, 7)]
    texts += [None, "", "a" * 700, "ab" * 300, texts[1], texts[1], texts[50], passage + passage, "x" * 63, "x" * 64]
    return texts


@pytest.mark.parametrize(("width", "group"), [(64, 256), (64, 3), (200, 256)])
def test_suffix_dedup(spark, width, group):
    texts = corpus(width + group)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, h int")
    got = {r["doc_id"]: r for r in rows(suffix.suffix_dedup(df, width, 32, group))}
    want = brute(texts, width)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == w, i
        assert sum(b - a for a, b in got[i]["spans"]) == w[1]
    assert any(0 < w[1] < w[0] for w in want)


def test_suffix_dedup_edges(spark, docs, no_docs):
    assert rows(suffix.suffix_dedup(no_docs)) == []
    data = docs.collect()
    got = rows(suffix.suffix_dedup(docs))
    want = brute([r["text"] for r in data], 200)
    assert sorted((str(g["doc_id"]), g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) for g in got) == sorted((str(r["doc_id"]), *w) for r, w in zip(data, want))


def test_anchors_in_slabs(monkeypatch):
    r = random.Random(5)
    for text in (bytes(r.choice(b"abcd") for _ in range(3000)), b"a" * 2500, b"abcdefgh" * 300, b"x" * 64, b"x" * 63):
        whole = [x.tolist() for x in suffix.anchors(text, 64, 32)]
        for slab in (1, 7, 64, 1000):
            monkeypatch.setattr(suffix, "SLAB", slab)
            assert [x.tolist() for x in suffix.anchors(text, 64, 32)] == whole
        monkeypatch.undo()
