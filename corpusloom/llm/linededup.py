"""Line dedup by distinct-site spread.

A line is boilerplate if it occurs on ``MIN_SITES`` distinct sites or more.
Lines are known by a 128-bit hash.  One aggregation gives every line a
HyperLogLog sketch of its sites: each task sketches its own rows and the
partial sketches merge, so a line on a third of all rows sends one small sketch
a task, and no (line, site) pair is built.  Only for lines whose estimate lies
within ``BAND`` of the threshold the distinct sites are counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_batches, materialize

MIN_SITES, LG_K = 8, 12
#: Six standard errors (0.83 / sqrt(2 ** LG_K)) of the sketch; the band is one site wide at least.
BAND = 0.08
#: Up to so many lines (16 bytes each) go to the tasks by broadcast, else by a join.
BROADCAST_LINES = 200_000
SEED_1, SEED_2 = 42, 20_023


def _line_hash(x):
    return F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(SEED_2), x).alias("h2"))


def hashed_lines(docs: DataFrame, site: str = "source") -> DataFrame:
    """k1, k2 (the text's hash), pos, h1, h2, site of each line; blank lines are left out."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(SEED_2), text).alias("k2"), F.col(site).alias("site"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return lines.where(F.trim("line") != "").select("k1", "k2", "pos", _line_hash(F.col("line")).alias("h"), "site").select("k1", "k2", "pos", "h.h1", "h.h2", "site")


def near_threshold(sketched: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The rows of ``sketched`` (h1, h2, sites) whose estimate does not decide on its own."""
    return sketched.where(F.abs(F.col("sites") - min_sites) <= max(1.0, min_sites * BAND))


def site_pairs(lines: DataFrame, near: DataFrame, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """h1, h2, site: the distinct pairs of the lines in ``near`` (stored), folded in each task before the exchange."""
    side = F.broadcast(near) if near.count() <= broadcast_lines else near
    return lines.where("site IS NOT NULL").join(side, ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct()


def spread(lines: DataFrame, min_sites: int = MIN_SITES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """h1, h2, sites of the lines on at least ``min_sites`` sites; null is no site.

    ``sites`` is exact near the threshold and an estimate above.
    """
    sketch = F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites")
    sketched = lines.where("site IS NOT NULL").groupBy("h1", "h2").agg(sketch).where(F.col("sites") >= min_sites - max(1.0, min_sites * BAND))
    sketched = materialize(sketched, "line-sketches")
    near = materialize(near_threshold(sketched, min_sites).select("h1", "h2"), "line-near")
    exact = site_pairs(lines, near, broadcast_lines).groupBy("h1", "h2").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return sketched.join(near, ["h1", "h2"], "left_anti").where(F.col("sites") > min_sites).unionByName(exact)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def spark_hashes(line: bytes) -> tuple[int, int]:
    """What ``_line_hash`` gives: XXH64, and XXH64 seeded by the hash of the integer SEED_2."""
    seed = xxhash.xxh64_intdigest(SEED_2.to_bytes(4, "little"), SEED_1)
    return _signed(xxhash.xxh64_intdigest(line, SEED_1)), _signed(xxhash.xxh64_intdigest(line, seed))


def remove(docs: DataFrame, boilerplate: DataFrame, site: str = "source", broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """doc_id, n_lines, n_removed, kept (the text without its boilerplate lines) of each row of ``docs``."""
    spark = docs.sparkSession
    arrow_batches(spark)
    if boilerplate.count() <= broadcast_lines:
        held = spark.sparkContext.broadcast({(r["h1"], r["h2"]) for r in boilerplate.select("h1", "h2").toLocalIterator()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            drop, firsts = held.value, {h for h, _ in held.value}
            for b in batches:
                out = []
                for text in b.column(1).cast(pa.binary()).to_pylist():
                    lines = (text or b"").split(b"\n")
                    kept = [x for x in lines if not (x.strip(b" ") and _signed(xxhash.xxh64_intdigest(x, SEED_1)) in firsts and spark_hashes(x) in drop)]
                    out.append((len(lines), len(lines) - len(kept), b"\n".join(kept)))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)), pa.array([o[2] for o in out], pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_removed", "kept"])

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, n_lines bigint, n_removed bigint, kept string")
    marks = hashed_lines(docs, site).join(boilerplate.select("h1", "h2"), ["h1", "h2"]).select("k1", "k2", "pos").distinct()
    # stored, so that both sides of the join are plain exchanges and a hot text's partition can be split
    marks = materialize(marks.groupBy("k1", "k2").agg(F.collect_list("pos").alias("gone")), "line-marks")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(SEED_2), text).alias("k2")).join(marks, ["k1", "k2"], "left")
    rows = rows.withColumn("lines", F.split("text", "\n")).withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    return rows.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), F.array_join(F.filter("lines", lambda x, i: ~F.array_contains("gone", i)), "\n").alias("kept"))


def line_dedup(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """Every row of ``docs`` without the lines that ``min_sites`` distinct sites or more share.

    Returns doc_id, n_lines, n_removed, kept.  Null text is one blank line;
    blank lines are never removed; rows of null site lose lines but add no
    site; a line is removed wherever it stands, repeats included; repeated rows
    each get their result; an empty table gives an empty result.
    """
    boilerplate = materialize(spread(hashed_lines(docs, site), min_sites, broadcast_lines), "boilerplate")
    return remove(docs, boilerplate, site, broadcast_lines)


ORACLE = f"""
WITH l AS (
  SELECT source, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
b AS (
  SELECT line FROM l WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
s AS (SELECT list(line) AS gone FROM b),
d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
k AS (
  SELECT doc_id, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(gone, x), false)) AS kept FROM d CROSS JOIN s)
SELECT doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256
FROM k
"""
