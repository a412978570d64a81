"""The pipeline's near-dedup stage against brute-force Jaccard similarity, and with null and repeated doc_ids."""

import random
import re
import sys
from collections import defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from corpusloom.llm import neardup  # noqa: E402


def shingle_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(k, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute_groups(texts):
    """Group number of each text: components of the pairs with 5-word Jaccard similarity of 0.8 or more."""
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(sets)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    at = defaultdict(list)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s or [()]:
            for j in at[x]:
                shared[j] += 1
            at[x].append(i)
        for j, n in shared.items():
            if not s or 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                label[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def changed(words, n, r):
    w = list(words)
    for i in r.sample(range(len(w)), n):
        w[i] = f"w{r.random()}"
    return " ".join(w)


@pytest.mark.parametrize("cell, counters", [(16, 1 << 20), (1, 1)])
def test_stage_against_brute_force(spark, sf, monkeypatch, cell, counters):
    monkeypatch.setattr(neardup, "CELL", cell)
    monkeypatch.setattr(neardup, "COUNTERS", counters)
    r = random.Random(7)
    given = spark.read.parquet(f"{sf}/documents.parquet")
    data = [(x["doc_id"], x["text"]) for x in given.collect()]
    base = [f"b{r.randrange(90)}" for _ in range(300)]
    data += [(1000 + i, changed(base, i % 14, r)) for i in range(40)]
    data += [(2000 + i, changed(base[:100], i % 4, r).upper()) for i in range(12)]
    data += [(3000, "a b c d e f"), (3001, "A b  c d e f"), (3002, "a b c"), (3003, "a b c"), (3004, "a b"), (3005, None), (3006, " ")]
    texts = [t for _, t in data]
    groups = defaultdict(list)
    for (d, _), g in zip(data, brute_groups(texts), strict=True):
        groups[g].append(d)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert sorted(x["doc_id"] for x in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == sorted(map(min, groups.values()))
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), sf).collect() == []


def test_null_and_repeated_doc_ids(spark, sf):
    r = random.Random(8)
    words = lambda i: [f"t{i}x{r.randrange(60)}" for _ in range(120)]
    own = [words(i) for i in range(9)]
    text = [" ".join(w) for w in own]
    data = [(None, text[0]), (None, text[1]), (None, text[2]), (None, text[2]), (None, changed(own[2], 1, r))]
    data += [(5, text[3]), (5, text[4]), (5, text[4])]
    data += [(7, text[5]), (7, text[6]), (6, changed(own[6], 1, r)), (None, text[7]), (8, text[7]), (9, text[8])]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in data], "doc_id long, text string, n long, cl_doc int").repartition(3)
    out = corpus_pipeline.near_dedup(spark, docs, sf)
    assert out.columns == docs.columns
    got = [(x["doc_id"], x["text"]) for x in out.collect()]
    third = [x for x in got if x[0] is None and x[1] in {t for _, t in data[2:5]}]
    assert len(third) == 1
    got.remove(third[0])
    assert sorted(got, key=str) == sorted([data[0], data[1], data[5], data[6], data[8], data[10], data[12], data[13]], key=str)
