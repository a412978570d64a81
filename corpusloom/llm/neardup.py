"""Near-duplicates by exact Jaccard similarity of word shingles.

Documents are sets of hashed shingles of ``SHINGLE`` words, and are linked if
the Jaccard similarity of their sets is 0.8 or more.  First they meet by the
SimHash of their sets: in the grids of the segment popcounts that leave out
``LEFT_OUT`` bands, with a Manhattan and then a Hamming distance of ``RADIUS`` or
less, and the pairs are verified on the whole sets.  At similarity 0.8
fingerprints differ in about ten bits, which no such grid finds for certain; so
the pairs that these links do not yet join meet once more, by an exact join.

The exact join is a prefix filter: with all shingles in one global order, two linked sets share a shingle
among the first n - ceil(0.8 n) + 1 of either, n being the set's size.  So
documents meet by these prefixes.  Of the pairs that meet, those go whose
bitmaps (a bit is the parity of the shingles that hash to it) differ in more
bits than the sets may differ in shingles, and the others are verified on the
whole sets; no linked pair is lost.

Any global order is exact; rare shingles first keeps the meetings few.  The
order is by counters that shingles of all texts fall into by their hash, a
fixed number of them at any size of the corpus.

Shingles with more than ``CELL`` documents first meet a hub only, for ``HUBS``
rounds; after that all pairs that the links found do not yet join are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import simhash
from corpusloom.llm.common import arrow_batches, discard, distinct, free_prefix, materialize
from corpusloom.llm.components import components

SHINGLE, CELL, HUBS, BITS = 5, 16, 2, 1024
#: The grids leave out so many of eight bands; their pairs are verified up to so many differing bits.
LEFT_OUT, RADIUS = 3, 12
#: Counters of the order; 4 bytes each are broadcast.
COUNTERS = 1 << 18
#: Up to so many documents whose texts are read again are broadcast by key.
WANTED = 500_000
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
ROWS = "doc_id long, text_key long, node long, n long, fp long, prefix array<long>, bits array<long>"


def shingles(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the k-word shingles of whole ``text``, sorted; a text of fewer words is one shingle."""
    w = (text or b"").translate(_LOWER).split()
    if not w:
        return np.zeros(0, np.int64)
    joined, h = b" ".join(w), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts, ends, k = [0, *(ends[:-1] + 1).tolist()], ends.tolist(), min(k, len(w))
    n = len(w) - k + 1
    return distinct(np.fromiter((h(joined[a:b], 42) for a, b in zip(starts[:n], ends[k - 1 :], strict=True)), np.uint64, n).view(np.int64))


def _counters(docs: DataFrame, k: int) -> np.ndarray:
    """How many shingles of all texts fall into each counter.  A task sends its own counters, at most ``COUNTERS`` rows."""
    size = COUNTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                np.add.at(held, shingles(t, k) & size - 1, 1)
        at = np.flatnonzero(held)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(held[part])], names=["at", "c"])

    found = docs.select("text").mapInArrow(run, "at int, c long").groupBy("at").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(size, np.float32)
    out[found["at"].to_numpy()] = found["c"].to_numpy()
    return out


def grams(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``ROWS`` of each row of ``docs``: node is a hash of the set of n shingles, fp its SimHash, prefix its first ones, bits its bitmap."""
    spark = docs.sparkSession
    arrow_batches(spark)
    held = spark.sparkContext.broadcast(_counters(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held.value
        for b in batches:
            nodes, sizes, prints, prefixes, maps = [], [], [], [], []
            for t in b.column(2).cast(pa.binary()).to_pylist():
                s = shingles(t, k)
                n, rank = len(s), counts[s & len(counts) - 1]
                nodes.append(int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True))
                sizes.append(n)
                prints.append(simhash.majority(s))
                prefixes.append(s[np.argsort(rank, kind="stable")[: n - (4 * n + 4) // 5 + 1]])
                maps.append(np.packbits(np.bincount(s & BITS - 1, minlength=BITS) & 1).view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(prefixes, longs), pa.array(maps, longs)],
                names=["doc_id", "text_key", "node", "n", "fp", "prefix", "bits"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text").mapInArrow(run, ROWS)


def _may(n: Column, pos: Column, m: Column, at: Column) -> Column:
    """Whether sets of n and m shingles can have similarity 0.8 if their first common one is at these positions."""
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * F.least(n - pos, m - at) >= 4 * (n + m))


def _sets(docs: DataFrame, nodes: DataFrame, prints: DataFrame, k: int) -> DataFrame:
    """node, grams: all shingles of the sets in ``nodes``, from the text of one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, k) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "grams"])

    least = prints.select("node", F.col("least.doc_id").alias("w_doc"), F.col("least.text_key").alias("w_text"))
    wanted = materialize(nodes.distinct().join(least, "node"), "neardup-wanted")
    small = F.broadcast(wanted) if wanted.count() <= WANTED else wanted
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    found = keyed.join(small, keyed.doc_id.eqNullSafe(F.col("w_doc")) & (keyed.text_key == F.col("w_text"))).select("node", "text").mapInArrow(run, "node long, grams array<long>")
    out = materialize(found.groupBy("node").agg(F.first("grams").alias("grams")), "neardup-sets")
    discard(wanted)
    return out


def links(docs: DataFrame, rows: DataFrame, prints: DataFrame, k: int = SHINGLE) -> DataFrame:
    """u, v: links whose components are those of all pairs of nodes in ``rows`` with similarity 0.8 or more."""

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        close = materialize(pairs.distinct(), f"neardup-{name}")
        sets = _sets(docs, close.select(F.explode(F.array("u", "v")).alias("node")), prints, k)
        side = lambda c, x: sets.select(F.col("node").alias(c), F.col("grams").alias(x))
        both = close.join(side("u", "x"), "u").join(side("v", "y"), "v")
        out = materialize(both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * F.col("total")).select("u", "v"), f"neardup-links-{name}")
        discard(close, sets)
        return out

    def mapped(table: DataFrame) -> DataFrame:
        return table.join(prints.select("node", "bits"), "node")

    def alike(n: Column, x: Column, m: Column, y: Column) -> Column:
        """The bitmaps leave similarity 0.8 possible."""
        return 9 * sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(1, BITS // 64)), F.bit_count(F.get(x, F.lit(0)).bitwiseXOR(F.get(y, F.lit(0))))) <= n + m

    def labelled() -> DataFrame:
        roots = components(found, "neardup-components").withColumnRenamed("node", "of")
        return members.join(roots, members.node == roots["of"], "left").select("s", "node", "n", "pos", F.coalesce("root", "node").alias("label"))

    near = simhash.candidates(prints, LEFT_OUT, RADIUS)
    found = verified(near.where(5 * F.least("n", "m") >= 4 * F.greatest("n", "m")).select("u", "v", (F.col("n") + F.col("m")).alias("total")), "simhash")
    discard(near)
    posts = rows.select("node", "n", F.posexplode("prefix").alias("pos", "s"))
    met = materialize(posts.groupBy("s").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("s"), "neardup-met")
    members = materialize(posts.join(met, "s").select("s", "node", "n", "pos").distinct(), "neardup-members")
    discard(met)
    state = labelled()
    crowded = materialize(members.groupBy("s").agg(F.count("*").alias("c")).where(F.col("c") > CELL).select("s"), "neardup-crowded")
    for i in range(0 if crowded.isEmpty() else HUBS):
        hot = materialize(mapped(state.join(crowded, "s")), "neardup-hot")
        hub = F.min_by(F.struct("node", "n", "pos", "label", "bits"), F.xxhash64(F.lit(i), "node")).alias("h")
        pairs = hot.join(hot.groupBy("s").agg(hub), "s").where(F.col("label") != F.col("h.label"))
        pairs = pairs.where(_may(F.col("n"), F.col("pos"), F.col("h.n"), F.col("h.pos")) & alike(F.col("n"), F.col("bits"), F.col("h.n"), F.col("h.bits")))
        more = verified(pairs.select(F.col("node").alias("u"), F.col("h.node").alias("v"), (F.col("n") + F.col("h.n")).alias("total")), f"hub{i}")
        found = found.unionByName(more)
        state = labelled()
        discard(hot)
    # what is left: pairs of a shingle that are not yet joined; only shingles with two labels matter
    state = materialize(state, "neardup-labels")
    discard(members, crowded)
    apart = materialize(state.groupBy("s").agg(F.min("label").alias("a"), F.max("label").alias("z")).where("a <> z").select("s"), "neardup-apart")
    still = materialize(mapped(state.join(apart, "s", "left_semi")), "neardup-open")
    discard(state, apart)
    other = still.select("s", *(F.col(c).alias(f"{c}2") for c in ("node", "n", "pos", "label", "bits")))
    pairs = still.join(other, "s").where((F.col("node") < F.col("node2")) & (F.col("label") != F.col("label2")) & _may(F.col("n"), F.col("pos"), F.col("n2"), F.col("pos2")))
    pairs = pairs.where(alike(F.col("n"), F.col("bits"), F.col("n2"), F.col("bits2")))
    last = verified(pairs.select(F.col("node").alias("u"), F.col("node2").alias("v"), (F.col("n") + F.col("n2")).alias("total")), "open")
    discard(still)
    return found.unionByName(last)


def dedup(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` less all but one row of each group of near duplicates, columns unchanged.

    Groups are the components of the links.  The row with the least doc_id
    stays (nulls last, ties by a hash of the text); rows are told apart by
    doc_id and text, so null and repeated doc_ids lose no unlike document.  Of
    rows alike in both, one stays.  Null, empty and wordless texts are one group; texts of
    fewer than ``k`` words are alike if their words are; letter case (ASCII)
    and white space do not count; an empty table gives an empty result.
    """
    rows = materialize(grams(docs, k), "neardup-rows")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("least")
    prints = materialize(rows.groupBy("node").agg(least, F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bits").alias("bits")), "neardup-distinct")
    roots = components(links(docs, rows, prints, k), "neardup-components").withColumnRenamed("node", "of")
    kept = prints.join(roots, prints.node == roots["of"], "left").groupBy(F.coalesce("root", "node").alias("group")).agg(F.min("least").alias("k"))
    p = free_prefix(docs.columns)
    doc, text, n = f"{p}doc", f"{p}text", f"{p}n"
    kept = kept.select(F.col("k.doc_id").alias(doc), F.col("k.text_key").alias(text))
    again = rows.groupBy("doc_id", "text_key").agg(F.count("*").alias(n)).where(F.col(n) > 1)
    same = kept[doc].eqNullSafe(again.doc_id) & (kept[text] == again.text_key)
    kept = materialize(kept.join(again, same, "left").select(doc, text, F.coalesce(n, F.lit(1)).alias(n)), "neardup-kept")
    discard(rows, prints)
    # the narrow side is hashed a partition at a time, so the texts need no sort
    keyed = docs.withColumn(f"{p}key", F.xxhash64("text"))
    out = keyed.join(kept.hint("shuffle_hash"), keyed.doc_id.cast("long").eqNullSafe(kept[doc]) & (keyed[f"{p}key"] == kept[text]))
    single = out.where(F.col(n) == 1).select(*[docs[c] for c in docs.columns])
    if kept.where(F.col(n) > 1).isEmpty():
        return single
    # rows alike in doc_id and text: each task keeps one, so a hot group does not meet in one task
    first = F.first(F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)])).alias("r")
    several = out.where(F.col(n) > 1).groupBy(doc, text).agg(first).select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(docs.columns)])
    return single.unionByName(several)
