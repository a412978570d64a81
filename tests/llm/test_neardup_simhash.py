"""The pipeline's near-dedup meets documents by the SimHash grid; the prefix filter only adds what that leaves."""

import random
from itertools import combinations

from pyspark.sql import functions as F

import test_neardup as t  # also puts the repository on the path
from corpusloom.llm import neardup, simhash


def flipped(x, n, r):
    for i in r.sample(range(64), n):
        x ^= 1 << i
    return x


def test_fingerprint_of_a_set():
    text = " ".join(f"w{i}" for i in range(500)).encode()
    assert simhash.majority(neardup.shingles(text)) == simhash.fingerprint(text, neardup.SHINGLE)
    assert simhash.majority(neardup.shingles(None)) == 0


def test_candidates(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(40)]
    prints = base + [flipped(b, i % 9, r) for i, b in enumerate(base)] + [flipped(base[0], r.randrange(4), r) for _ in range(30)]
    docs = spark.createDataFrame([(i, simhash._signed(x), i) for i, x in enumerate(prints)], "node long, fp long, n long")
    bits = {(i, j): (prints[i] ^ prints[j]).bit_count() for i, j in combinations(range(len(prints)), 2)}
    for cell in (1000, 4):
        got = simhash.candidates(docs, neardup.LEFT_OUT, neardup.RADIUS, cell).collect()
        found = {(x["u"], x["v"]) for x in got}
        assert len(found) == len(got) and all(bits[p] <= neardup.RADIUS for p in found)
        assert all((x["n"], x["m"]) == (x["u"], x["v"]) for x in got)
        if cell == 1000:
            assert {p for p, n in bits.items() if n <= neardup.LEFT_OUT} <= found


def test_stage_goes_through_simhash(spark, sf, monkeypatch):
    """Without the prefix filter's pairs, the stage still drops near copies within the grids' bits, and only those that are similar."""
    monkeypatch.setattr(neardup, "_may", lambda *_: F.lit(False))
    r = random.Random(4)
    base = [f"b{r.randrange(900)}" for _ in range(600)]
    data = [(0, " ".join(base))]
    while len(data) < 6:
        text = t.changed(base, 2, r)
        a, b = (simhash.majority(neardup.shingles(x.encode())) for x in (data[0][1], text))
        if (a ^ b) & (1 << 64) - 1 and ((a ^ b) & (1 << 64) - 1).bit_count() <= neardup.LEFT_OUT:
            data.append((len(data), text))
    data += [(100 + i, " ".join(f"u{i}x{r.randrange(60)}" for _ in range(120))) for i in range(5)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(x["doc_id"] for x in t.corpus_pipeline.near_dedup(spark, docs, sf).collect()) == [0, 100, 101, 102, 103, 104]
