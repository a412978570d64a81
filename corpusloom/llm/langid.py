"""Language ID by hyperdimensional profiles.

Every letter has a random binary vector of ``DIMS`` dimensions, seeded by its
code point.  A trigram binds (XOR) its three letters' vectors, permuted twice,
once and not at all; a document bundles (sums, as +1 and -1) its trigrams.  A
language's prototype bundles all its training documents, and a document takes
the language whose prototype has the highest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_batches, distinct

DIMS, SEED, GROUP, CHUNK = 1024, 7, 128, 4096
#: Characters that are looked at together.
PART = 1 << 20
#: Prototypes go to the tasks by broadcast: DIMS * 8 bytes each.
MAX_LANGUAGES = 4096
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@lru_cache(1)
def _permutation() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(SEED)).permutation(DIMS)


@lru_cache(100_000)
def _letter(code: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letter's vector, packed: permuted twice, once and not."""
    bits = np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, DIMS, dtype=np.uint8)
    once = bits[_permutation()]
    return np.packbits(once[_permutation()]), np.packbits(once), np.packbits(bits)


def grams(text: str) -> np.ndarray:
    """Letter trigrams with runs of other characters as one space, packed in 63 bits; a space is no middle letter.

    A long text goes in parts that end with a space, which changes no trigram.
    """
    if len(text) <= PART:
        return _grams(text)
    out, i = [], 0
    while i < len(text):
        j = i + PART
        if j < len(text):
            space = text.rfind(" ", i, j)
            j = space + 1 if space >= 0 else j
        out.append(_grams(text[i:j]))
        i = j
    return np.concatenate(out)


def _grams(text: str) -> np.ndarray:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.concatenate([[0], np.where(_letters()[codes], codes, 0), [0]])
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    c = codes[keep]
    packed = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
    return packed[c[1:-1] != 0]


def vectors(packed: np.ndarray) -> np.ndarray:
    """The bound vectors of trigrams as rows of +1 and -1."""
    out = np.zeros((len(packed), DIMS // 8), np.uint8)
    for place, shift in enumerate((42, 21, 0)):
        codes, at = np.unique((packed >> shift) & 0x1FFFFF, return_inverse=True)
        if len(codes):
            out ^= np.stack([_letter(int(c))[place] for c in codes])[at]
    return 1.0 - 2.0 * np.unpackbits(out, axis=1).astype(np.float32)


def bundle(packed: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.zeros(DIMS)
    for i in range(0, len(packed), CHUNK):
        total += counts[i : i + CHUNK].astype(np.float64) @ vectors(packed[i : i + CHUNK]).astype(np.float64)
    return total


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each language's bundle over the task's documents."""
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(grams(text or ""))
        for lang, parts in by.items():
            sums[lang] = sums.get(lang, 0) + bundle(*np.unique(np.concatenate(parts), return_counts=True))
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.astype(np.int64) for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "v"])


def train(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototype of each non-null ``lang`` over all rows of ``docs``; sums of integers, so the same in any order."""
    arrow_batches(docs.sparkSession)
    parts = docs.where("lang IS NOT NULL").select("lang", "text").mapInArrow(_learn, "lang string, v array<bigint>")
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("lang", F.col("v.x").alias("v")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    return {r["lang"]: np.array(r["v"], np.float64) for r in sorted(found, key=lambda r: r["lang"])}


def score(texts: list[str | None], langs: list[str], unit: np.ndarray) -> list[tuple[str, float]]:
    """(language, cosine) of each text; ``unit`` has the prototypes at length 1."""
    out: list[tuple[str, float]] = []
    for i in range(0, len(texts), GROUP):
        docs = [grams(t or "") for t in texts[i : i + GROUP]]
        every = distinct(np.concatenate(docs))
        vecs = np.zeros((len(docs), DIMS), np.float32)
        for j in range(0, len(every), CHUNK):
            part = every[j : j + CHUNK]
            counts = np.zeros((len(docs), len(part)), np.float32)
            for k, g in enumerate(docs):
                at = np.searchsorted(part, g)
                held = (at < len(part)) & (part[np.minimum(at, len(part) - 1)] == g)
                counts[k] = np.bincount(at[held], minlength=len(part))
            vecs += counts @ vectors(part)
        length = np.linalg.norm(vecs, axis=1)
        for k, g in enumerate(docs):
            if not len(g) or not langs:
                out.append((UNKNOWN, 0.0))
                continue
            cosine = unit @ vecs[k].astype(np.float64) / max(float(length[k]), 1e-9)
            best = int(np.argmax(cosine))
            out.append((langs[best], float(min(1.0, max(0.0, cosine[best])))))
    return out


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score of each row of ``docs``; only the text is looked at.

    Null text, or text without a letter, is ``und`` with score 0, as is
    everything if no language was learned.  Ties go to the first language by
    code point.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    langs = list(prototypes)
    unit = np.stack([v / max(np.linalg.norm(v), 1e-9) for v in prototypes.values()]) if langs else np.zeros((0, DIMS))
    held = spark.sparkContext.broadcast((langs, unit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, unit = held.value
        for b in batches:
            found = score(b.column(1).to_pylist(), langs, unit)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def fold():
    """crc32 of doc_id as text, mod 3; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows outside fold 1 and predict every row: doc_id, held_out, lang_pred, score.

    A null doc_id is in no fold and not held out; repeated rows each get their
    result; an empty table gives an empty result.
    """
    prototypes = train(docs.where(F.coalesce(fold() != 1, F.lit(True))))
    return predict(docs, prototypes).withColumn("held_out", F.coalesce(fold() == 1, F.lit(False)))
