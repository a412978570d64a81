"""Secret scans with an incremental blob ledger.

Every version of a document is addressed by the SHA-256 of its text.  The
ledger is a table in the shared folder with a row for each pair of blob and
rule version that was scanned.  A run folds its rows to blobs, leaves out the
pairs that the ledger holds, scans the others once, appends them, and joins the
ledger's findings back to every path (row) that has the blob.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_batches, folder, materialize, stored, utf8


def _either(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else c for c in word)


_KEY = "(?:" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
_C = "[A-Za-z0-9_-]"
#: kind -> pattern, group whose length counts (0: the match), least length.  The first three are the base rules.
#: A pattern's finding is its group ``hit``, if it has one.
RULES: dict[str, tuple[str, int, int]] = {
    "assign": (_KEY + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
    # eyJ and 8 or more, a dot, 8 or more, a dot, 1 or more; a run of letters is entered once, at its first eyJ, which is its best
    "jwt": (rf"(?<!{_C})(?>{_C}*?(?=eyJ))(?P<hit>eyJ{_C}{{8,}}+\.{_C}{{8,}}+\.{_C}+)", 0, 20),
    "forge": (r"gh[opsur]_[A-Za-z0-9]+", 0, 24),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
}
#: What a text must hold for a rule to find anything.
NEEDLES = {"access": "AKIA", "jwt": "eyJ", "pem": "-----BEGIN "}
BASE = ("assign", "access", "hex")
#: Up to so many unseen blobs (64 bytes each) pick out their texts by broadcast, else by a join.
BROADCAST_BLOBS = 200_000
LEDGER = "blob string, rules string, n_assign long, n_access long, n_hex long, base string, spans string"


def rule_version(rules: dict = RULES) -> str:
    return hashlib.sha256(json.dumps(rules, sort_keys=False).encode()).hexdigest()[:16]


def find(text: str, compiled: list[tuple[int, str, re.Pattern, int, int]]) -> list[tuple[int, int, str, int]]:
    """(start, order of kind, kind, end) of each finding, sorted; code points, end exclusive."""
    out = []
    for order, kind, pattern, group, least in compiled:
        if NEEDLES.get(kind, "") not in text:
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                start, end = m.span("hit" if "hit" in pattern.groupindex else 0)
                out.append((start, order, kind, end))
    return sorted(out)


def scanner(rules: dict = RULES):
    version = rule_version(rules)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(i, kind, re.compile(p, re.ASCII), g, n) for i, (kind, (p, g, n)) in enumerate(rules.items())]
        for b in batches:
            rows = []
            for blob, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = find(text or "", compiled)
                kinds = [f[2] for f in found]
                rows.append((blob, version, *(kinds.count(k) for k in BASE), ",".join(f"{k}:{s}:{e}" for s, _, k, e in found if k in BASE), ",".join(f"{k}:{s}:{e}" for s, _, k, e in found)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["blob", "rules", "n_assign", "n_access", "n_hex", "base", "spans"])

    return scan


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, rules: dict = RULES, broadcast_blobs: int = BROADCAST_BLOBS) -> DataFrame:
    """Ledger rows (see ``LEDGER``) for the blobs of ``docs`` that ``ledger`` lacks under these rules.

    Each task folds its copies of a text to one before the exchange, so a large
    group of copies, or one repeated row, sends a text a task at most.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.sha2(utf8(), 256).alias("blob"), "text")
    once = lambda r: r.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        return once(rows).mapInArrow(scanner(rules), LEDGER)
    seen = ledger.where(F.col("rules") == rule_version(rules)).select("blob")
    unseen = materialize(rows.select("blob").distinct().join(seen, "blob", "left_anti"), "unseen-blobs")
    few = unseen.count() <= broadcast_blobs
    carried = once(rows.join(F.broadcast(unseen), "blob", "left_semi")) if few else once(rows).join(unseen, "blob", "left_semi")
    return carried.mapInArrow(scanner(rules), LEDGER)


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at ``path``, a row for each pair, however often one was appended; None where there is none yet."""
    if not stored(spark, path):
        return None
    return spark.read.schema(LEDGER).parquet(path).dropDuplicates(["blob", "rules"])


def append_ledger(new: DataFrame, path: str) -> None:
    """Add newly scanned pairs to the ledger at ``path``; pairs that it holds already are left out, so a retry adds nothing."""
    held = read_ledger(new.sparkSession, path)
    if held is not None:
        new = materialize(new.join(held.select("blob", "rules"), ["blob", "rules"], "left_anti"), "ledger-new")
    new.write.mode("append").partitionBy("rules").parquet(path)


def secrets(docs: DataFrame, path: str | None = None, rules: dict = RULES, broadcast_blobs: int = BROADCAST_BLOBS) -> DataFrame:
    """Findings of every row of ``docs``: doc_id, blob and the ledger's columns.

    The ledger at ``path`` is read, unseen pairs are scanned and appended to it;
    without a path the run has a ledger of its own, which starts empty.  Null
    text is the empty blob, which has no findings; versions of one doc_id are
    blobs of their own; repeated rows each get the blob's findings; other
    columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = path or folder(spark, "ledger")
    ledger = read_ledger(spark, path)
    append_ledger(scan_unseen(docs, ledger, rules, broadcast_blobs), path)
    # both sides of the join are plain exchanges of narrow rows, so a hot blob's partition can be split
    found = spark.read.schema(LEDGER).parquet(path) if ledger is None else materialize(read_ledger(spark, path), "ledger-read")
    return docs.select("doc_id", F.sha2(utf8(), 256).alias("blob")).join(found.where(F.col("rules") == rule_version(rules)), "blob")
