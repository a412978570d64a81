"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits, and maps to the
vector of their bit counts.  The Manhattan distance of two vectors never
exceeds the Hamming distance of the fingerprints, so a range join of the
vectors under that distance loses no pair.  The join uses a grid: the 32
coordinates form eight bands, vectors within Manhattan distance ``d`` differ in
at most ``d`` bands, and so they share a cell of one of the grids that leave
out ``d`` bands.  Pairs of a cell that pass the Manhattan test are verified on
the fingerprints.

Cells with more than ``CELL`` fingerprints are not paired.  Fingerprints x and
y are within 2 bits exactly if some z is within one bit of both, so each
fingerprint of such a cell is linked through its 65 neighbours z: linear in the
cell's size, with no loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import neardup
from corpusloom.llm.common import arrow_batches, discard, materialize
from corpusloom.llm.components import components

SHINGLE, MAX_BITS, CELL, CHUNK = 3, 2, 16, 1 << 15
#: Up to so many shared cells are broadcast.
WANTED = 200_000
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_PAIRS = 0x5555555555555555


def fingerprint(text: bytes | None, k: int = SHINGLE) -> int:
    """SimHash of whole ``text``: a bit is 1 if set in over half of the hashes of its k-word shingles."""
    w = (text or b"").translate(_LOWER).split()
    if not w:
        return 0
    joined, h = b" ".join(w), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    k = min(k, len(w))
    n, counts = len(w) - k + 1, np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        j = min(n, i + CHUNK)
        hashes = np.fromiter((h(joined[a:b], 42) for a, b in zip(starts[i:j], ends[i + k - 1 : j + k - 1], strict=True)), ">u8", j - i)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def fingerprinter(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [fingerprint(t, k) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, fp for each row of ``docs``; null and wordless texts have fingerprint 0."""
    arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(fingerprinter(k), "doc_id long, fp long")


def embedding(fp: Column) -> Column:
    """The 32 segment popcounts, packed two bits each."""
    low, high = fp.bitwiseAND(F.lit(_PAIRS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_PAIRS))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))


def manhattan(x: Column, y: Column) -> Column:
    """Manhattan distance of two packed embeddings: counts are 0 to 2, so each coordinate differs by 0 to 2."""
    total = None
    for i in range(0, 64, 2):
        d = F.abs(F.shiftrightunsigned(x, i).bitwiseAND(F.lit(3)) - F.shiftrightunsigned(y, i).bitwiseAND(F.lit(3)))
        total = d if total is None else total + d
    return total


def hamming(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(prints: DataFrame, cell: int = CELL) -> DataFrame:
    """u, v: links whose components are those of all pairs of ``prints`` (fp, distinct) at ``MAX_BITS`` or fewer bits."""
    masks = [_signed(~sum(0xFF << 8 * b for b in out) & (1 << 64) - 1) for out in combinations(range(8), MAX_BITS)]
    v = prints.withColumn("e", embedding(F.col("fp")))
    cells = v.select("fp", F.posexplode(F.array(*[F.col("e").bitwiseAND(F.lit(m)) for m in masks])).alias("grid", "at"))
    counts = cells.groupBy("grid", "at").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("z")).where("n > 1")
    counts = materialize(counts, "simhash-cells")
    near = lambda x, y: (manhattan(embedding(x), embedding(y)) <= MAX_BITS) & (hamming(x, y) <= MAX_BITS)
    # a cell of two is its own pair
    found = counts.where("n = 2").select(F.col("a").alias("u"), F.col("z").alias("v"))
    crowded = counts.where("n > 2").select("grid", "at", "n")
    members = materialize(cells.join(crowded, ["grid", "at"]).select("grid", "at", "n", "fp"), "simhash-members")
    lists = members.where(F.col("n") <= cell).groupBy("grid", "at").agg(F.collect_list("fp").alias("l"))
    paired = lists.select(F.explode("l").alias("u"), "l").select("u", F.explode(F.filter("l", lambda y: y > F.col("u"))).alias("v"))
    found = found.unionByName(paired).where(near(F.col("u"), F.col("v")))
    hot = members.where(F.col("n") > cell).select("fp").distinct()
    ball = hot.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])).alias("z"))
    hubs = ball.groupBy("z").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    through = ball.join(hubs, "z").select(F.col("fp").alias("u"), "v").where("u <> v")
    return found.unionByName(through).distinct()


def majority(hashes: np.ndarray) -> int:
    """Fingerprint of 64-bit hashes: a bit is 1 if set in over half of them."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def candidates(prints: DataFrame, left_out: int, radius: int, cell: int = CELL) -> DataFrame:
    """u, v, n, m: pairs of ``prints`` (node, distinct; fp; n, any number) that meet in a grid, at ``radius`` or fewer bits.

    The grids leave out ``left_out`` of the eight bands, so they miss no pair
    within that many bits and find others up to ``radius`` whose bits lie in so
    many bands.  In a cell of more than ``cell`` nodes each meets the least only.
    The result is stored; ``discard`` it.
    """
    masks = [_signed(~sum(0xFF << 8 * b for b in out) & (1 << 64) - 1) for out in combinations(range(8), left_out)]
    e = embedding(F.col("fp"))
    cells = prints.select("node", F.explode(F.array(*[F.xxhash64(F.lit(i), e.bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])).alias("at"))
    shared = materialize(cells.groupBy("at").agg(F.count("*").alias("c"), F.min("node").alias("hub")).where("c > 1"), "simhash-shared")
    members = materialize(cells.join(F.broadcast(shared) if shared.count() <= WANTED else shared, "at"), "simhash-meeting")
    lists = members.where(F.col("c") <= cell).groupBy("at").agg(F.collect_list("node").alias("l"))
    paired = lists.select(F.explode("l").alias("u"), "l").select("u", F.explode(F.filter("l", lambda y: y > F.col("u"))).alias("v"))
    through = members.where((F.col("c") > cell) & (F.col("node") != F.col("hub"))).select(F.col("hub").alias("u"), F.col("node").alias("v"))
    pairs = materialize(paired.unionByName(through).distinct(), "simhash-pairs")
    side = lambda *names: prints.select(*(F.col(c).alias(x) for c, x in zip(("node", "fp", "n"), names, strict=True)))
    x, y = F.col("x"), F.col("y")
    near = (manhattan(embedding(x), embedding(y)) <= radius) & (hamming(x, y) <= radius)
    out = materialize(pairs.join(side("u", "x", "n"), "u").join(side("v", "y", "m"), "v").where(near).select("u", "v", "n", "m"), "simhash-candidates")
    discard(shared, members, pairs)
    return out


def dedup(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: ``neardup.dedup``, five-word shingles and exact similarity."""
    return neardup.dedup(docs)


def near_duplicates(docs: DataFrame, k: int = SHINGLE, cell: int = CELL) -> DataFrame:
    """Component of every row of ``docs``: doc_id, fp, component_id.

    component_id is the least doc_id reachable over links of at most
    ``MAX_BITS`` differing bits.  Copies share a fingerprint and are one node.
    Null, empty and wordless texts have fingerprint 0, linked like any other;
    repeated rows share a component; null doc_ids are never a component_id
    unless nothing else is in it; an empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, k), "simhash-fingerprints")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(prints.select("fp"), cell), "simhash-components")
    known = roots.join(prints, roots.node == prints.fp).select("node", "root", "least")
    ends = roots.select("root").distinct().join(prints, F.col("root") == prints.fp).select(F.col("root").alias("node"), "root", "least")
    known = known.unionByName(ends)
    best = known.groupBy("root").agg(F.min("least").alias("component"))
    moved = known.join(best, "root").select("node", "component")
    final = prints.join(moved, prints.fp == moved.node, "left").select(F.col("fp").alias("key"), F.coalesce("component", "least").alias("component_id"))
    final = materialize(final, "simhash-final")  # so that both sides are plain exchanges, and a hot fingerprint's partition can be split
    return rows.join(final, rows.fp == final.key).select("doc_id", "fp", "component_id")
