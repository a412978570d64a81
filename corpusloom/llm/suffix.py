"""Suffix-array dedup of long repeated strings over the whole corpus.

A byte goes if a window of ``WIDTH`` bytes that covers it also starts anywhere
else.  Sorting all suffixes of a corpus in one place does not scale, so windows
first meet by content:

1. Every window belongs to its anchor, the leftmost least hash of its ``GRAM``-
   byte grams.  The choice depends on the window's bytes alone, so equal windows
   have equal grams at equal offsets.  Anchors whose gram occurs once are done.
2. The windows of each other anchor form one context, the bytes they cover.
   Equal contexts are counted together, and each gram's distinct contexts go to
   the kernel in ``gsaca``: it builds their suffix array by linear grouping, and
   neighbours in the order with ``WIDTH`` common bytes are the repeats.
3. A gram with over ``GROUP`` distinct contexts (a frequent line in changing
   surroundings) is split: its windows are cut into blocks of neighbouring
   offsets, which meet by the bytes that all of a block's windows share, first
   blocks of ``SPLITS[0]`` offsets, then shorter ones, last single windows.
   Equal windows stay together at each step, so nothing is lost, and no group
   of single windows has two distinct contexts.
4. Repeated starts go back to the texts that have the context.

Copies of a text are worked on once; a text that more than one row has is
removed whole if it is long enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import gsaca
from corpusloom.llm.common import arrow_batches, discard, materialize, utf8

WIDTH, GRAM, GROUP, SPLITS = 200, 32, 1024, (16, 4, 1)
SEED_2 = 20_029
_M = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_BYTES = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, 256, dtype=np.uint64)


#: Windows whose anchors are looked for at once.
SLAB = 1 << 20


def _slab(text: bytes, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window start, place and hash of each run of windows with one anchor."""
    h, done = _BYTES[np.frombuffer(text, np.uint8)], 1
    while done < gram:  # polynomial hashes of doubling length; gram is a power of two
        h = h[:-done] * np.uint64(pow(_M, done, 1 << 64)) + h[done:]
        done *= 2
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span, done = width - gram + 1, 1
    while 2 * done <= span:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    least = np.minimum(least[: len(least) - (span - done)], least[span - done :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return first, place[first], h[place[first]].astype(np.int64)


def anchors(text: bytes, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor: its gram's hash, first window start, number of windows, and its place after that start."""
    starts = len(text) - width + 1
    if starts <= 0:
        return (np.zeros(0, np.int64),) * 4
    slabs = []
    for i in range(0, starts, SLAB):
        first, place, h = _slab(text[i : min(i + SLAB, starts) + width - 1], width, gram)
        slabs.append((first + i, place + i, h))
    first, place, h = (np.concatenate([s[k] for s in slabs]) for k in range(3))
    fresh = np.diff(place, prepend=-1) != 0  # a run that goes on into the next slab
    first, place, h = first[fresh], place[fresh], h[fresh]
    return h, first, np.diff(first, append=starts), place - first


def _anchor_rows(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [anchors(t, width, gram) for t in b.column(2).to_pylist()]
            sizes = [len(f[0]) for f in found]
            k1, k2 = (np.repeat(b.column(i).to_numpy(), sizes) for i in (0, 1))
            h, first, n, at = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (h, k1, k2, first << 20 | n << 10 | at)], names=["h", "k1", "k2", "p"])

    return run


def _ctx_hash(context: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(context)
    return ((d >> 64) ^ (1 << 63)) - (1 << 63), ((d & _MASK) ^ (1 << 63)) - (1 << 63)


CONTEXTS = "h bigint, c1 bigint, c2 bigint, context binary, copies bigint, at int, n int, k1 bigint, k2 bigint, first int"


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in CONTEXTS.split(", ")])


def _context_rows(width: int):
    """Contexts of each text's anchors; the bytes go with a context's first place in the text, with the number of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for k1, k2, text, hs, ps in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                seen: dict[tuple, int] = {}
                own: list[list] = []
                for h, p in zip(hs, ps, strict=True):
                    first, n, at = p >> 20, p >> 10 & 1023, p & 1023
                    context = text[first : first + n - 1 + width]
                    c = _ctx_hash(context)
                    if (h, c) in seen:
                        own[seen[h, c]][4] += 1
                        own.append([h, *c, None, 0, at, n, k1, k2, first])
                    else:
                        seen[h, c] = len(own)
                        own.append([h, *c, context, 1, at, n, k1, k2, first])
                rows += own
                if len(rows) >= 20_000:
                    yield _emit(rows)
                    rows = []
            yield _emit(rows)

    return run


TOPS = ["top_h", "top_c1", "top_c2", "shift"]
PARTS = "h bigint, c1 bigint, c2 bigint, context binary, copies bigint, at int, n int, top_h bigint, top_c1 bigint, top_c2 bigint, shift int"


def _split_rows(block: int, width: int):
    """Cut contexts into blocks of ``block`` neighbouring offsets, keyed by the bytes that a block's windows share.

    A part keeps the whole context that it is of (``top_``) and its place there.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 3, pa.int32()]
    names = [f.split()[0] for f in PARTS.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for h, _, _, context, copies, at, n, *top, shift in zip(*(b.column(i).to_pylist() for i in range(len(names))), strict=True):
                for q in range((at - n + 1) // block, at // block + 1):
                    far, near = min(at, q * block + block - 1), max(at - n + 1, q * block)  # offsets before the anchor
                    i, j = at - far, at - near
                    core = context[at - q * block : at - q * block - block + 1 + width]
                    part = context[i : j + width]
                    key = xxhash.xxh64_intdigest(core, xxhash.xxh64_intdigest(q.to_bytes(4, "little", signed=True), h & _MASK))
                    rows.append(((key ^ (1 << 63)) - (1 << 63), *_ctx_hash(part), part, copies, far, j - i + 1, *top, shift + i))
                if len(rows) >= 20_000:
                    yield batch(rows)
                    rows = []
            yield batch(rows)

    return run


def _repeats(contexts: DataFrame, width: int, group: int, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(h, c1, c2, runs) of the grams with at most ``group`` distinct contexts, all distinct contexts, and the other grams."""
    distinct = contexts.where("context IS NOT NULL").groupBy("h", "c1", "c2", "context", "at", "n").agg(F.sum("copies").alias("copies"))
    distinct = materialize(distinct, f"{name}-distinct")
    sizes = materialize(distinct.groupBy("h").agg(F.count("*").alias("m"), F.sum("copies").alias("all")).where("all > 1"), f"{name}-sizes")
    few = distinct.join(sizes.where(F.col("m") <= group).select("h"), "h", "left_semi")
    lists = few.groupBy("h").agg(F.collect_list(F.struct("c1", "c2", "context", "copies")).alias("l"))
    kernel = gsaca.register(contexts.sparkSession)
    found = lists.selectExpr("h", "l.c1 AS c1", "l.c2 AS c2", f"{kernel}(l.context, l.copies, {width}) AS runs")
    found = found.select("h", F.explode(F.arrays_zip("c1", "c2", "runs")).alias("x")).select("h", "x.c1", "x.c2", "x.runs").where(F.size("runs") > 0)
    many = materialize(sizes.where(F.col("m") > group).select("h"), f"{name}-many")
    found = materialize(found, f"{name}-found")
    discard(sizes)
    return found, distinct, many


def _runs(found: DataFrame) -> DataFrame:
    """One row a run: from, to instead of the flat list."""
    pairs = F.transform(F.sequence(F.lit(0), (F.size("runs") / 2).cast("int") - 1), lambda i: F.struct(F.get("runs", (2 * i).cast("int")).alias("a"), F.get("runs", (2 * i + 1).cast("int")).alias("b")))
    return found.select("h", "c1", "c2", F.explode(pairs).alias("r")).select("h", "c1", "c2", "r.a", "r.b")


def repeated_starts(contexts: DataFrame, width: int, group: int) -> DataFrame:
    """h, c1, c2, a, b: runs [a, b) of the windows in each context that also start elsewhere."""
    found, distinct, many = _repeats(contexts, width, group, "repeats")
    out = _runs(found)
    parts = distinct.select("*", F.col("h").alias("top_h"), F.col("c1").alias("top_c1"), F.col("c2").alias("top_c2"), F.lit(0).alias("shift"))
    for block in SPLITS:
        if many.isEmpty():
            break
        names = [f.split()[0] for f in PARTS.split(", ")]
        parts = materialize(parts.join(many, "h", "left_semi").select(*names).mapInArrow(_split_rows(block, width), PARTS), f"split-{block}")
        discard(many, distinct)
        found, distinct, many = _repeats(parts, width, group, f"split-{block}")
        hits = _runs(found).join(parts.select("h", "c1", "c2", *TOPS), ["h", "c1", "c2"])
        out = out.unionByName(hits.select(F.col("top_h").alias("h"), F.col("top_c1").alias("c1"), F.col("top_c2").alias("c2"), (F.col("a") + F.col("shift")).alias("a"), (F.col("b") + F.col("shift")).alias("b")))
    out = materialize(out, "dedup-starts")
    discard(distinct)
    return out


def _cut(width: int):
    """sha256 and counts of each text without the bytes under its repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k1, k2, text, runs in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                spans: list[list[int]] = []
                for a, z in sorted((r["a"], r["b"] - 1 + width) for r in runs):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], z)
                    else:
                        spans.append([a, z])
                edges = [0, *(x for s in spans for x in s), len(text)]
                kept = b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
                rows.append((k1, k2, len(text) - len(kept), len(spans), sha256(kept).hexdigest(), spans))
            c = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(c, kinds, strict=True)], names=["k1", "k2", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def suffix_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """What dedup removes from every row of ``docs``.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (removed
    byte ranges, end exclusive).  Null text counts as empty; texts under
    ``width`` bytes lose nothing; a row whose text another row has too loses all
    of it if it is long enough, repeated rows included; other columns are not
    read; an empty table gives an empty result.  ``width`` is under 1000, and
    ``gram`` a power of two below it.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("t"))
    rows = rows.select("doc_id", F.xxhash64("t").alias("k1"), F.xxhash64(F.lit(SEED_2), "t").alias("k2"), "t")
    texts = materialize(rows.select("doc_id", "k1", "k2", F.octet_length("t").cast("long").alias("n_bytes"), F.sha2("t", 256).alias("whole")), "dedup-texts")
    owners = materialize(texts.groupBy("k1", "k2").agg(F.min("doc_id").alias("owner"), F.count("*").alias("rows")), "dedup-owners")
    found = materialize(rows.where(F.octet_length("t") >= width).select("k1", "k2", "t").mapInArrow(_anchor_rows(width, gram), "h bigint, k1 bigint, k2 bigint, p bigint"), "dedup-anchors")
    often = materialize(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "dedup-grams")
    # a text's own list; copies fold into a set
    lists = found.join(often, "h", "left_semi").groupBy("k1", "k2").agg(F.collect_set(F.struct("p", "h")).alias("l"))
    lists = materialize(lists.join(owners, ["k1", "k2"]).select("k1", "k2", "owner", F.col("l.h").alias("hs"), F.col("l.p").alias("ps")), "dedup-lists")

    def carried(side: DataFrame, *columns: str) -> DataFrame:
        """``side`` with its texts: each from its least doc_id, so that copies do not meet in one task."""
        side = side.withColumnsRenamed({"k1": "s1", "k2": "s2"})
        on = (rows.k1 == side.s1) & (rows.k2 == side.s2) & rows.doc_id.eqNullSafe(side.owner)
        return rows.join(side, on).select("k1", "k2", "t", *columns)

    contexts = materialize(carried(lists, "hs", "ps").mapInArrow(_context_rows(width), CONTEXTS), "dedup-contexts")
    discard(found, often, lists)
    starts = repeated_starts(contexts, width, group)
    marks = contexts.select("h", "c1", "c2", "k1", "k2", "first").join(starts, ["h", "c1", "c2"])
    marks = marks.select("k1", "k2", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))
    marks = marks.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("runs"))
    marks = materialize(marks.join(owners.where(F.col("rows") == 1), ["k1", "k2"]), "dedup-marks")
    discard(contexts, starts)
    cut = materialize(carried(marks, "runs").mapInArrow(_cut(width), "k1 bigint, k2 bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<array<bigint>>"), "dedup-cut")
    # stored, so that both sides of the last join are plain exchanges and a hot text's partition can be split
    result = materialize(owners.select("k1", "k2", (F.col("rows") > 1).alias("copied")).join(cut, ["k1", "k2"], "left"), "dedup-result")
    whole = F.col("copied") & (F.col("n_bytes") >= width)
    everything = F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))
    return texts.join(result, ["k1", "k2"]).select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        F.when(whole, everything).otherwise(F.coalesce("spans", F.array().cast("array<array<bigint>>"))).alias("spans"),
    )
