"""Co-training against a plain loop, and on labels of which a plain last fifth lacks a class."""

import math
import sys
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from corpusloom.llm import quality  # noqa: E402


@pytest.mark.parametrize("low", [10, 5, 3, 1])
def test_every_class_in_both_slices(low):
    y = np.array([0] * low + [1] * 60)
    x = np.stack([y, 1 - y, np.ones(len(y))], axis=1).astype(np.float32)
    m = quality.fit_views(x, x, y)
    assert m.a is not None
    assert ((m.scores(x, x)[:, 2] >= quality.THRESHOLD) == (y == 1)).all()


def brute(docs, labels, sample, rounds, grow):
    """Scores of co-training by plain loops over Python lists; the features and one view's fit are the operator's."""
    sure = math.log(quality.SURE / (1 - quality.SURE))
    seen = lambda r: (r["text"], r["lang"], r["source"])
    xa = {k: quality.content([(k[0] or "").encode()])[0] for k in map(seen, docs)}
    xb = {k: quality.metadata([(k[0] or "").encode()], [k[1]], [k[2]])[0] for k in map(seen, docs)}
    key = {seen(r): r["key"] for r in docs}
    chosen = sorted((r for r in labels), key=lambda r: r["order"])[:sample]
    by_id = {r["doc_id"]: seen(r) for r in docs}
    train = [(by_id[r["doc_id"]], r["quality"]) for r in chosen if r["doc_id"] in by_id]
    known = {r["doc_id"] for r in chosen}
    given, taken = ([], []), set()
    stack = lambda x, ks: np.array([x[k] for k in ks], np.float32)
    for turn in range(rounds + 1):
        y = np.array([q for _, q in train])
        more = [(stack(x, [k for k, _ in sorted(g, key=lambda p: key[p[0]])]), np.array([q for _, q in sorted(g, key=lambda p: key[p[0]])])) if g else None for x, g in zip((xa, xb), given)]
        m = quality.fit_views(stack(xa, [k for k, _ in train]), stack(xb, [k for k, _ in train]), y, *more)
        if turn == rounds:
            break
        found = set()
        for view, x, to in ((m.a, xa, 1), (m.b, xb, 0)):
            pool = {seen(r) for r in docs if r["doc_id"] not in known} - taken
            z = {k: round(float(view.logit(x[k][None])[0]), 9) for k in pool}
            for sign, most in ((1, round(grow * m.prior)), (-1, grow - round(grow * m.prior))):
                best = sorted((k for k in pool if sign * z[k] >= sure), key=lambda k: (-abs(z[k]), key[k]))[:most]
                given[to].extend((k, int(sign > 0)) for k in best)
                found |= set(best)
        taken |= found
    return {k: m.scores(xa[k][None], xb[k][None])[0].tolist() for k in xa}, [len(g) for g in given]


def test_against_a_plain_loop(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 400"), spark.read.parquet(f"{sf}/labels.parquet").where("doc_id < 400")
    docs = docs.unionByName(docs.where("doc_id % 50 = 7").withColumn("doc_id", F.col("doc_id") + 1000)).repartition(3)
    keyed = [r.asDict() for r in docs.select("doc_id", "text", "lang", "source", F.xxhash64("text", "lang", "source").alias("key")).collect()]
    known = [r.asDict() for r in labels.select(F.col("doc_id").cast("long"), "quality", F.xxhash64(F.lit(quality.SEED), F.col("doc_id").cast("long")).alias("order")).collect()]
    want, given = brute(keyed, known, 120, 2, 30)
    assert min(given) > 5
    got = quality.classify(docs, quality.train(docs, labels, sample=120, rounds=2, grow=30)).collect()
    assert len(got) == len(keyed)
    text = {r["doc_id"]: (r["text"], r["lang"], r["source"]) for r in keyed}
    for r in got:
        assert np.allclose([r["p_content"], r["p_metadata"], r["score"]], want[text[r["doc_id"]]], atol=1e-4)


def test_features_do_not_depend_on_the_batch_or_the_cut(monkeypatch):
    r = np.random.default_rng(1)
    texts = [b"", b" \n\t", b"one", "é naïve Ünï 12 !?".encode(), b" lead and trail \n\n", *(b" ".join(bytes(r.integers(97, 123, r.integers(1, 9)).astype(np.uint8)) for _ in range(n)) for n in (3, 40, 700))]
    together = quality.content(texts)
    assert np.array_equal(together, np.vstack([quality.content([t]) for t in texts]))
    assert not together[:1].any() and np.isfinite(together).all()
    monkeypatch.setattr(quality, "PART", 64)
    cut = quality.content(texts)
    same = [i for i in range(together.shape[1]) if i not in (quality.CONTENT - 10, quality.CONTENT - 9)]  # distinct words and pairs count by part
    assert np.array_equal(cut[:, same], together[:, same])
    assert np.isfinite(quality.content([b"x" * 5000])).all()


def test_a_long_text_is_linear():
    t0 = time.perf_counter()
    quality.content([b"word " * 2_000_000, b"." * 5_000_000])
    assert time.perf_counter() - t0 < 20
