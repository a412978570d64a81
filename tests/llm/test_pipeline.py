"""The pipeline's stages, each against brute force on the stage's own input, and run() against the stages."""

import sys
from collections import Counter, defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
from corpusloom.llm import quality  # noqa: E402
from test_first_ops import brute_contamination  # noqa: E402
from test_neardup import brute_groups  # noqa: E402


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], sf).write.parquet(str(tmp_path / str(i)))
        seen.append(spark.read.parquet(str(tmp_path / str(i))))
    assert all(s.columns == docs.columns for s in seen[:-1])
    scored = quality.quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert ids(seen[1]) == sorted(r["doc_id"] for r in scored if r["keep"]) and 0 < seen[1].count() < docs.count()
    rows = seen[1].collect()
    least = defaultdict(list)
    for r, c in zip(rows, brute_groups([r["text"] for r in rows])):
        least[c].append(r["doc_id"])
    assert ids(seen[2]) == sorted(map(min, least.values()))
    rows = seen[2].collect()
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert ids(seen[3]) == sorted(r["doc_id"] for r, c in zip(rows, brute_contamination([r["text"] for r in rows], items)) if not c[4])
    copies, size, source = Counter(ids(seen[4])), Counter(), {}
    for r in seen[3].collect():
        n = len((r["text"] or "").split())
        size[r["source"]] += n
        source[r["doc_id"]] = (r["source"], n)
    assert max(copies.values()) <= 3 and set(copies) <= set(source)
    taken = Counter()
    for d, n in copies.items():
        taken[source[d][0]] += n * source[d][1]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    full = set()
    while True:
        left, w = sum(size.values()) - sum(3 * size[s] for s in full), sum(weight[s] for s in size if s not in full)
        target = {s: 3 * size[s] if s in full else left * weight[s] / w for s in size}
        if not (over := {s for s in size if target[s] > 3 * size[s]}):
            break
        full |= over
    for s in size:
        assert abs(taken[s] - target[s]) <= max(n for x, n in source.values() if x == s)
    final = seen[5].collect()
    slots = defaultdict(list)
    for r in final:
        slots[r["shard"]].append(r["slot"])
    assert Counter(r["doc_id"] for r in final) == copies and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in corpus_pipeline.run(spark, sf).collect()) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in final)
