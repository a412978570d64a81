"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: a block (some ``BLOCK`` bytes of texts)
becomes a stored row that holds, for every term of its texts, the sorted
positions at which it occurs.  It does not depend on the benchmark, so it serves
any number of searches.  A search sums document frequencies of the benchmark's
terms over all blocks; then each block's posting lists are intersected, offset
by their place in the window, from the window's rarest term on.  No exchange
carries text or postings, so neither hot terms nor groups of copies skew it.

Terms are 64-bit hashes of words.  The benchmark's words are hashed on the
executors; its terms and their frequencies go to the tasks in blocks of items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import LARGE_ROWS, arrow_batches, discard, distinct, free_prefix, materialize
from corpusloom.llm.words import CHUNK, word_hashes

WINDOW, SHIFT, NEAR = 10, 36, 2
#: A search's plan that is broadcast at once, 16 bytes for each benchmark word; a larger benchmark goes in blocks of items.
PLAN_BYTES = 8 << 20
#: Text of a stored block.
BLOCK = 4 << 20
#: Up to so many contaminated documents are broadcast by key.
WANTED = 200_000
#: Postings that are expanded at once in a block's intersection.
EXPAND = 1 << 20
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
INDEX = "doc_id array<bigint>, rid array<bigint>, text_key array<bigint>, start array<int>, n_words array<int>, terms array<bigint>, counts array<int>, positions array<int>"
HITS = "doc_id bigint, rid bigint, text_key bigint, n_words bigint, spans array<struct<a:int,b:int>>, items array<string>"


def terms_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """How many words each text has, and the terms of all words in turn.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased.  Texts go in chunks, long ones in parts that end between words.
    """
    counts, found, at, held, size = np.zeros(len(texts), np.int64), [], [], [], 0

    def take() -> None:
        data = np.frombuffer(b"".join(held), np.uint8)
        _, _, own, h = word_hashes(data, data != 32, np.concatenate([[0], np.cumsum([len(p) for p in held])]))
        np.add.at(counts, np.array(at)[own], 1)
        found.append(h.view(np.int64))

    for i, t in enumerate(texts):
        t, start = (t or b"").translate(_FOLD), 0
        while start < len(t):
            end = min(len(t), start + CHUNK)
            if end < len(t):
                space = t.rfind(b" ", start, end)
                end = space if space > start else t.find(b" ", end)
                end = len(t) if end < 0 else end
            if held and size + end - start > CHUNK:
                take()
                at, held, size = [], [], 0
            at.append(i)
            held.append(t[start:end])
            size += end - start
            start = end
    if held:
        take()
    return counts, np.concatenate(found) if found else np.zeros(0, np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut to blocks of some ``BLOCK`` bytes of text, or one row."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(3)), 0).to_numpy())
        cuts = [0, *(np.flatnonzero(np.diff(size // BLOCK)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i < j:
                yield b.slice(i, j - i)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _blocks(batches):
        sizes, terms = terms_of(b.column(3).cast(pa.binary()).to_pylist())
        order = np.argsort(terms, kind="stable")
        terms = terms[order]
        first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
        lists = [b.column(0), b.column(1), b.column(2), np.cumsum(sizes) - sizes, sizes, terms[first], np.diff(first, append=len(terms)), order]
        kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] + [pa.int32()] * 2
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v, k)) for v, k in zip(lists, kinds, strict=True)], names=[f.split()[0] for f in INDEX.split(", ")])


def build_index(docs: DataFrame) -> DataFrame:
    """Positional postings of all terms of ``docs`` (doc_id, text), stored in the shared folder; ``discard`` it after the last search."""
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("rid"), F.xxhash64("text").alias("text_key"), "text")
    return materialize(rows.mapInArrow(_index, INDEX), "postings", LARGE_ROWS)


class Plan:
    """The windows of a block of items: ``terms`` and their ``df`` word by word, ``ends`` of the items, ``ids`` of the items."""

    def __init__(self, ids: list[str], items: list[np.ndarray], df: dict[int, int]):
        self.ids, self.terms = ids, np.concatenate([*items, np.zeros(0, np.int64)])
        self.df = np.array([df.get(t, 0) for t in self.terms.tolist()], np.int64)
        self.ends = np.cumsum([0, *map(len, items)])

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, length and item of each window."""
        sizes = np.diff(self.ends)
        n = np.where(sizes > 0, np.maximum(1, sizes - width + 1), 0)
        item = np.repeat(np.arange(len(sizes)), n)
        return np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n) + self.ends[:-1][item], np.minimum(sizes, width)[item], item

    def ordered(self, first: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
        """Offsets of each window's terms, rarest first; -1 pads short windows."""
        at = np.arange(width)
        df = np.where(at < length[:, None], self.df[np.minimum(first[:, None] + at, len(self.df) - 1)], np.iinfo(np.int64).max)
        order = np.argsort(df, axis=1, kind="stable")
        return np.where(at < length[:, None], order, -1)


def intersect(own: np.ndarray, counts: np.ndarray, places: np.ndarray, start: np.ndarray, size: np.ndarray, terms: np.ndarray, first: np.ndarray, order: np.ndarray, slop: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, text, start in the block) of the matches in one block's postings, some windows at a time.

    ``own``, ``counts`` and ``places`` are the block's terms and positions,
    ``start`` and ``size`` its texts.  A match has the window's rarest term in
    its place, and every other at its offset from there or up to ``slop`` places
    off, within the text.
    """
    low = np.cumsum(counts) - counts
    keys = (np.repeat(np.arange(len(own)), counts) << SHIFT) | places

    def local(t: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(own, t), len(own) - 1)
        return np.where(own[at] == t, at, -1)

    rarest = local(terms[first + order[:, 0]])
    windows = np.flatnonzero(rarest >= 0)
    n = counts[rarest[windows]]
    for part in np.split(windows, np.flatnonzero(np.diff(np.cumsum(n) // EXPAND)) + 1):
        k = rarest[part]
        m = counts[k]
        window = np.repeat(part, m)
        at = places[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low[k], m)]
        text = np.searchsorted(start, at, side="right") - 1
        begin = at - order[window, 0]
        a, z = start[text], start[text] + size[text]
        for j in range(1, order.shape[1]):
            if not len(window):
                break
            off = order[window, j]
            t = local(terms[first[window] + np.maximum(off, 0)])
            want = begin + off
            lo, hi = np.maximum(want - slop, a), np.minimum(want + slop, z - 1)
            ok = (t >= 0) & (lo <= hi)
            ok &= np.searchsorted(keys, (t << SHIFT) | np.maximum(lo, 0)) < np.searchsorted(keys, (t << SHIFT) | np.maximum(hi, 0), side="right")
            ok |= off < 0
            window, begin, text, a, z = window[ok], begin[ok], text[ok], a[ok], z[ok]
        yield window, text, begin


def _searcher(plan, slop: int, width: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        first, length, item = p.windows(width)
        order = p.ordered(first, length, width) if len(first) else np.zeros((0, width), np.int64)
        for b in batches:
            for row in range(b.num_rows):
                doc, rid, key, start, size, own, counts, places = (b.column(i)[row].values for i in range(8))
                start, size, own, counts, places = (x.to_numpy().astype(np.int64) for x in (start, size, own, counts, places))
                found = list(intersect(own, counts, places, start, size, p.terms, first, order, slop)) if len(own) and len(first) else []
                window, text, begin = (np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in range(3))
                # words under any match; with slop the span reaches slop places further, within the text
                edge = np.zeros(int(size.sum()) + 2, np.int64)
                np.add.at(edge, np.maximum(begin - slop, start[text]), 1)
                np.add.at(edge, np.minimum(begin + length[window] + slop, start[text] + size[text]), -1)
                depth = np.cumsum(edge) > 0
                cut = np.zeros(len(depth) + 1, bool)
                cut[start] = True  # a span ends with its text
                flip = np.diff(depth.astype(np.int8), prepend=0)
                a = np.flatnonzero((flip == 1) | (depth & cut[:-1]))
                z = np.flatnonzero((flip == -1) | (depth & cut[:-1] & np.concatenate([[False], depth[:-1]])))
                in_text = np.searchsorted(start, a, side="right") - 1
                pairs = distinct(text * max(1, len(p.ids)) + item[window])
                items: list[list[str]] = [[] for _ in range(len(start))]
                for d, i in zip((pairs // max(1, len(p.ids))).tolist(), (pairs % max(1, len(p.ids))).tolist(), strict=True):
                    items[d].append(p.ids[i])
                cuts = np.searchsorted(in_text, np.arange(len(start) + 1))
                spans = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(a - start[in_text], pa.int32()), pa.array(z - start[in_text], pa.int32())], names=["a", "b"]))
                yield pa.RecordBatch.from_arrays([doc, rid, key, pa.array(size, pa.int64()), spans, pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))], names=["doc_id", "rid", "text_key", "n_words", "spans", "items"])

    return search


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, terms = terms_of(b.column(1).cast(pa.binary()).to_pylist())
        ends = np.concatenate([[0], np.cumsum(sizes)])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(terms))], names=["item", "terms"])


def _plans(items: DataFrame, stats: DataFrame, most: int) -> Iterator[Plan]:
    """Plans of blocks of items, of ``most`` bytes or one item."""
    spark, held, size = items.sparkSession, [], 0

    def made() -> Plan:
        terms = distinct(np.concatenate([*(t for _, t in held), np.zeros(0, np.int64)]))
        mine = F.broadcast(spark.createDataFrame(pa.table({"term": terms})))
        df = dict(stats.join(mine, "term").select("term", "df").collect())  # at most one row for each of the block's words
        return Plan([i for i, _ in held], [t for _, t in held], df)

    for r in items.toLocalIterator():
        t = np.array(r["terms"], np.int64)
        if held and size + 16 * len(t) > most:
            yield made()
            held, size = [], 0
        held.append((r["item"], t))
        size += 16 * len(t)
    yield made()


def search(index: DataFrame, benchmark: DataFrame, slop: int = 0, plan_bytes: int = PLAN_BYTES, width: int = WINDOW) -> DataFrame:
    """Matches of the benchmark's windows in every text of ``index``: doc_id, rid, text_key, n_words, spans, items.

    A benchmark whose plan is over ``plan_bytes`` is searched in blocks of items
    over the same index, and the blocks' spans are merged by row.
    """
    spark = index.sparkSession
    arrow_batches(spark)
    items = materialize(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").mapInArrow(_item_terms, "item string, terms array<bigint>"), "benchmark-terms")
    own = items.select(F.explode("terms").alias("term")).distinct()
    stats = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("t.terms", "t.counts")
    stats = materialize(stats.join(own, stats.terms == own.term, "left_semi").groupBy(F.col("terms").alias("term")).agg(F.sum("counts").alias("df")), "benchmark-frequencies")
    parts = [index.mapInArrow(_searcher(spark.sparkContext.broadcast(p), slop, width), HITS) for p in _plans(items, stats, plan_bytes)]
    if len(parts) == 1:
        return parts[0]
    every = materialize(parts[0], "block-hits")
    for p in parts[1:]:
        every = every.unionByName(materialize(p.where(F.size("items") > 0), "block-hits"))
    last = lambda done: F.try_element_at(done, F.lit(-1))
    merged = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))),
        F.array().cast("array<struct<a:int,b:int>>"),
        lambda done, s: F.when((F.size(done) > 0) & (last(done)["b"] >= s["a"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last(done)["a"].alias("a"), F.greatest(last(done)["b"], s["b"]).alias("b"))))).otherwise(F.concat(done, F.array(s))),
    )
    first = lambda c: F.first(c).alias(c)
    return every.groupBy("rid").agg(first("doc_id"), first("text_key"), first("n_words"), merged.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def matches(docs: DataFrame, benchmark: DataFrame, slop: int = 0, plan_bytes: int = PLAN_BYTES) -> DataFrame:
    """Phrase (``slop`` 0) or proximity matches of benchmark windows in each row of ``docs``.

    Returns doc_id, text_key (a hash of the text), n_words, spans (word ranges
    under matches, merged, end exclusive) and items (ids of the matching items).
    Null or empty texts have no words and no matches; an item of null or no
    words matches nothing; items of one id count once, and a null item_id reads
    "null"; repeated rows each get their result; other columns are not read; an
    empty table gives an empty result.
    """
    return search(build_index(docs.select("doc_id", "text")), benchmark, slop, plan_bytes).drop("rid")


def counted(m: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated beside the columns of ``m``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["b"] - s["a"]))
    return m.withColumns({"n_hit": hit, "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join(F.array_sort("items"), ","), 256), "contaminated": hit > 0})


def contamination(docs: DataFrame, benchmark: DataFrame, slop: int = 0, plan_bytes: int = PLAN_BYTES, near: int | None = None) -> DataFrame:
    """``matches`` with the columns of ``counted``.

    With ``near``, the same index is searched again for proximity matches with
    that slop, and n_near is the number of items that match so.
    """
    index = build_index(docs.select("doc_id", "text"))
    out = counted(search(index, benchmark, slop, plan_bytes))
    if near is None:
        return out.drop("rid")
    close = search(index, benchmark, near, plan_bytes).where(F.size("items") > 0)
    close = materialize(close.select(F.col("rid").alias("n_rid"), F.size("items").cast("long").alias("n_near")), "near-hits")
    return out.join(close, F.col("rid") == F.col("n_rid"), "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long"))).drop("rid", "n_rid")


def clean(docs: DataFrame, benchmark: DataFrame, slop: int = 0, plan_bytes: int = PLAN_BYTES) -> DataFrame:
    """The rows of ``docs`` that no benchmark window occurs in, columns unchanged."""
    p = free_prefix(docs.columns)
    index = build_index(docs.select("doc_id", "text"))
    hit = search(index, benchmark, slop, plan_bytes).where(F.size("items") > 0)
    hit = materialize(hit.select(F.col("doc_id").alias(f"{p}hit"), F.col("text_key").alias(f"{p}text")).distinct(), "contaminated")
    discard(index)
    # the narrow side is hashed, so the texts need no sort
    hit = F.broadcast(hit) if hit.count() <= WANTED else hit.hint("shuffle_hash")
    return docs.join(hit, docs.doc_id.cast("long").eqNullSafe(hit[f"{p}hit"]) & (F.xxhash64(docs.text) == hit[f"{p}text"]), "left_anti")
