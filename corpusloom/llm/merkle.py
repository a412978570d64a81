"""Document fingerprints: a Merkle tree over sections, paragraphs and their pieces.

Sections end at blank lines, and at paragraphs whose hash picks them, so that an
insertion moves no later boundary.  Paragraphs are lines.  A paragraph's leaves
end with sentences, with words that their hash picks (one in ``CUT``), and at
``LEAF`` bytes: before the word that would pass it, and within a longer word.
Leaves joined give the text back, so equal roots mean equal texts, and the
branches in which two trees differ are where the texts were edited.

The fingerprint is written as ``root|section/section/...``: a section is its
paragraphs joined by ``.``, a paragraph its leaves joined by ``,``, and a leaf
the first eight hex digits of its hash and its size in hex.  Inner hashes follow
from the leaves as written, so trees, likenesses and edits can be had from the
fingerprint alone.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_batches, materialize

#: Largest leaf; one word in CUT ends a leaf, one paragraph in SECTION a section.
LEAF, CUT, SECTION = 256, 4, 8
_WORD = re.compile(rb"(\S+)(\s*)|\s+")
_ENDS = b".!?"
#: Most blocks of consecutive documents; it bounds what the driver holds.
BLOCKS, BLOCK_ROWS = 20_000, 2_048
OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edits string"


def _hash(data: bytes) -> bytes:
    return blake2b(data, digest_size=8).digest()


def pieces(paragraph: bytes) -> Iterator[bytes]:
    """The paragraph's leaves, in one pass."""
    start, crc = 0, zlib.crc32
    for m in _WORD.finditer(paragraph):
        a, z = m.span()
        while z - start > LEAF:
            cut = a if a > start else start + LEAF
            yield paragraph[start:cut]
            start = cut
        word = m[1]
        if word and (crc(word) % CUT == 0 or m[2] and word[-1] in _ENDS):
            yield paragraph[start:z]
            start = z
    if start < len(paragraph):
        yield paragraph[start:]


def lines(text: bytes) -> list[bytes]:
    """The text's lines, each with its line feed."""
    *whole, last = text.split(b"\n")
    return [x + b"\n" for x in whole] + ([last] if last else [])


class Tree:
    """sections: nodes (hash, size, children); a leaf has no children and its published hash.  ``root`` covers whole leaf hashes."""

    def __init__(self, root: str, paragraphs: Iterator[tuple[list[tuple[bytes, int, None]], bool]]):
        """``paragraphs``: leaves, and whether the section ends here."""
        self.root, self.sections, held = root, [], []
        for leaves, ends in paragraphs:
            held.append(self._node(b"P", leaves))
            if ends:
                self.sections.append(self._node(b"S", held))
                held = []
        if held:
            self.sections.append(self._node(b"S", held))
        self.size = sum(s[1] for s in self.sections)

    @staticmethod
    def _node(kind: bytes, children: list) -> tuple[bytes, int, list]:
        size = sum(c[1] for c in children)
        return _hash(kind + b"".join([c[0] for c in children]) + b"%d" % size), size, children

    @classmethod
    def of(cls, text: bytes) -> Tree:
        whole, out = blake2b(b"R", digest_size=16), []
        for line in lines(text):
            hashes = [(_hash(p), len(p)) for p in pieces(line)]
            joined = b"".join([h for h, _ in hashes])
            whole.update(joined + b"%d" % len(line))
            out.append(([(h[:4], n, None) for h, n in hashes], not line.strip() or zlib.crc32(joined) % SECTION == 0))
        return cls(whole.hexdigest(), iter(out))

    @classmethod
    def parse(cls, fingerprint: str) -> Tree:
        root, _, body = fingerprint.partition("|")
        out = []
        for section in body.split("/") if body else []:
            ps = [[(bytes.fromhex(x[:8]), int(x[8:], 16), None) for x in p.split(",")] for p in section.split(".")]
            out += [(p, i == len(ps) - 1) for i, p in enumerate(ps)]
        return cls(root, iter(out))

    def __str__(self) -> str:
        return self.root + "|" + "/".join([".".join([",".join([f"{h.hex()}{n:x}" for h, n, _ in p[2]]) for p in s[2]]) for s in self.sections])


def likeness(a: Tree, b: Tree) -> float:
    """1 for equal roots, else the share of bytes under equal branches (Dice, counted with repeats).

    Sections are matched by hash; only the paragraphs of the others are opened and matched, and then their leaves.
    """
    if a.root == b.root:
        return 1.0
    x, y, same = a.sections, b.sections, 0
    for _ in range(3):
        left = Counter([(n[0], n[1]) for n in y])
        opened = []
        for n in x:
            if left[n[0], n[1]] > 0:
                left[n[0], n[1]] -= 1
                same += n[1]
            else:
                opened += n[2] or []
        other = []
        for n in reversed(y):
            if left[n[0], n[1]] > 0:
                left[n[0], n[1]] -= 1
                other += n[2] or []
        x, y = opened, other
    return 2.0 * same / (a.size + b.size) if a.size + b.size else 0.0


def differing(x: list, y: list) -> list[tuple[int, int, int, int]]:
    """(start, end in x, start, end in y) of the ranges in which two lists differ.

    Equal ends fall away; what both have once, in its longest common order, anchors the rest.
    """
    out = []

    def between(a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int, int]:
        while a0 < a1 and b0 < b1 and x[a0] == y[b0]:
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and x[a1 - 1] == y[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
        return a0, a1, b0, b1

    a0, a1, b0, b1 = between(0, len(x), 0, len(y))
    once_x, once_y = Counter(x[a0:a1]), Counter(y[b0:b1])
    place = {v: j for j, v in enumerate(y[b0:b1], b0) if once_y[v] == 1}
    pairs = [(i, place[v]) for i, v in enumerate(x[a0:a1], a0) if once_x[v] == 1 and v in place]
    tails, before, at = [], [], []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        tails[p : p + 1], at[p : p + 1] = [j], [k]
        before.append(at[p - 1] if p else -1)
    k, chain = at[-1] if at else -1, []
    while k >= 0:
        chain.append(pairs[k])
        k = before[k]
    for i, j in [*reversed(chain), (a1, b1)]:
        r = between(a0, i, b0, j)
        if r[0] < r[1] or r[2] < r[3]:
            out.append(r)
        a0, b0 = i + 1, j + 1
    return out


def edits(a: Tree, b: Tree) -> list[tuple[int, int, int, int]]:
    """(start, end in a, start, end in b), in bytes, of the branches in which the trees differ; only unequal branches are opened."""
    out: list[tuple[int, int, int, int]] = []

    def walk(x: list, y: list, i: int, j: int) -> None:
        at = [np.cumsum([k, *(n[1] for n in nodes)]).tolist() for k, nodes in ((i, x), (j, y))]
        for a0, a1, b0, b1 in differing([n[:2] for n in x], [n[:2] for n in y]):
            if a0 < a1 and b0 < b1 and x[a0][2] is not None:
                walk([c for n in x[a0:a1] for c in n[2]], [c for n in y[b0:b1] for c in n[2]], at[0][a0], at[1][b0])
            else:
                out.append((at[0][a0], at[0][a1], at[1][b0], at[1][b1]))

    if a.root != b.root:
        walk(a.sections, b.sections, 0, 0)
    return out


def edited(text: str, following: str) -> str:
    """``text`` with its last third (of code points, rounded down) replaced by the first as many of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in (block, carried, order): each document meets the next one, and a block ends with a carried row."""
    held = None
    closed = None
    for b in batches:
        rows = []
        for block, carried, doc, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if block == closed:
                continue
            text = text or ""
            tree = Tree.of(text.encode("utf-8", "surrogatepass"))
            if held is not None:
                old_doc, old, old_tree = held
                changed = edited(old, text).encode("utf-8", "surrogatepass")
                new = Tree.of(changed)
                spans = ";".join(f"{i}-{j}>{k}-{m}" for i, j, k, m in edits(old_tree, new))
                rows.append((old_doc, len(old), sha256(changed).hexdigest(), str(old_tree), str(new), likeness(old_tree, new), likeness(old_tree, tree), spans))
            held = (doc, text, tree)
            if carried:
                held, closed = None, block
        if rows:
            c = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types, strict=True)], names=[f.split()[0] for f in OUT.split(", ")])


_SUB = 1 << 24


def _blocks(ids: np.ndarray, null: np.ndarray, h: np.ndarray, first: np.ndarray, parts: dict[int, int]) -> np.ndarray:
    """The block of each row, ascending in the rows' order; blocks of one hot doc_id are cut by the text's hash."""
    base = np.where(null, len(first), np.searchsorted(-first, -ids, side="right") - 1)
    m = np.array([parts.get(int(x), 1) for x in base], np.uint64)
    high = (h.astype(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
    return base * _SUB + ((high * m) >> np.uint64(32)).astype(np.int64)


def fingerprints(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Fingerprint of each row of ``docs`` and of its edited text, with likenesses to that and to the next row.

    The next row is the next in descending doc_id (nulls last, ties by a hash
    of the text); after the last comes the first.  ``edits`` has the byte ranges
    in which the text and its edited text differ, as ``a-b>c-d`` joined by
    ``;``.  Rows go to blocks of consecutive doc_ids, and the first row of each
    block is carried to the end of the block before, so no task sees the whole
    order.  Block starts are doc_ids from an approximate quantile sketch,
    ``BLOCKS`` at most; a doc_id (or null) with more rows than a few blocks hold
    has blocks of its own, cut by the texts' hash.  Null text counts as empty,
    equal texts have equal fingerprints, a single row is its own next, rows
    alike in doc_id and text share a block, other columns are not read and an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    n, most = docs.agg(F.count("*"), F.max("doc_id")).first()
    blocks = int(min(BLOCKS, n // block_rows + 1))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks + 1)], 10 * blocks)).first()[0] if blocks > 1 and most is not None else None
    each = max(2 * block_rows, n // BLOCKS)
    # at most BLOCKS rows, since each has a block's rows or more
    hot = {r["doc_id"]: r["n"] for r in docs.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > each).collect()}
    starts = ({most, *(cuts or [])} if most is not None else set()) | {d for d in hot if d is not None} | {d - 1 for d in hot if d is not None and d > -(1 << 63)}
    first = np.array(sorted(starts, reverse=True), np.int64)
    at = {int(x): i for i, x in enumerate(first)}
    parts = {len(first) if d is None else at[d]: int(min(_SUB - 1, c // block_rows + 1)) for d, c in hot.items()}

    @F.pandas_udf("long")
    def home(ids: pd.Series, h: pd.Series) -> pd.Series:
        null = ids.isna().to_numpy()
        return pd.Series(_blocks(ids.fillna(0).to_numpy().astype(np.int64), null, h.to_numpy().astype(np.int64), first, parts))

    placed = docs.withColumn("block", home("doc_id", "h"))
    least = placed.groupBy("block").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), (-F.col("doc_id")).alias("y"), "h")).alias("f"))
    # a row a block: the first document of each, and the block before it
    heads = sorted((r["block"], None if r["f"]["x"] else -r["f"]["y"], r["f"]["h"]) for r in least.collect())
    back = [(d, h, heads[i - 1][0]) for i, (_, d, h) in enumerate(heads)]
    back = spark.createDataFrame(back, "b_doc long, b_h long, to long")
    carried = docs.join(F.broadcast(back), docs.doc_id.eqNullSafe(F.col("b_doc")) & (docs.h == F.col("b_h"))).groupBy("to").agg(F.first("doc_id").alias("doc_id"), F.first("h").alias("h"), F.first("text").alias("text"))
    carried = materialize(carried, "merkle-carried")
    every = placed.select("block", F.lit(0).alias("carried"), "doc_id", "h", "text").unionByName(carried.select(F.col("to").alias("block"), F.lit(1).alias("carried"), "doc_id", "h", "text"))
    ordered = every.repartition("block").sortWithinPartitions("block", "carried", F.col("doc_id").desc_nulls_last(), "h", F.col("text").asc_nulls_first())
    return ordered.select("block", "carried", "doc_id", "text").mapInArrow(_compare, OUT)
