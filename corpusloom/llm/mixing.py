"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a 60-bit hash.  A source that must give ``r`` words beyond
whole passes takes the documents whose hash lies under a threshold, and the
threshold is found from histograms: words are summed by source and hash bucket,
the bucket in which the running sum meets ``r`` is cut into finer buckets, and
so on for ``LEVELS`` levels.  Larger budgets only raise the threshold, so mixes
are nested.  Documents are never sorted; only histograms of at most
``2**BITS`` rows a source are.  All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import free_prefix, materialize

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BITS, LEVELS, HASH_BITS = 12, 3, 60
WORD = r"[^\x20\x09-\x0D]+"


def row_hash(seed: int = 17):
    """The row's hash ``u``: the top bits of an MD5 of seed, doc_id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(text.cast("binary"))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, source, size (words) and hash ``u`` of each row of ``docs``."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), row_hash(seed).alias("u"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """Water-filling: source, source_size, target.

    ``sizes`` has a row for each source.  Sources in code-point order, null
    last, get the weights in turn.  Sorted by cap over weight, a source is full
    if the level that the sources from it on would share lies above its cap.
    The windows run over one row a source.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    s = sizes.select("source", "source_size").withColumn("w", weight).withColumn("cap", (cap * F.col("source_size")).cast("double"))
    everything = Window.partitionBy()
    by = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.col("before")) / F.col("rest"))
    full = F.col("level") >= F.col("cap") / F.col("w")
    s = s.withColumn("common", F.max(F.when(~full, F.col("level"))).over(everything))
    return s.select("source", "source_size", F.when(full, F.col("cap")).otherwise(F.col("common") * F.col("w")).alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """source, copies, theta: ``copies`` whole passes and the documents with ``u >> shift < theta``.

    ``goals`` has source, copies and ``left`` (words wanted beyond the whole
    passes).  Each level sums only the rows in its source's boundary bucket.
    """
    goals = goals.select("source", "copies", F.col("left").cast("double").alias("left"), F.lit(0).cast("long").alias("prefix"))
    for level in range(1, LEVELS + 1):
        shift = HASH_BITS - BITS * level
        bucket = F.shiftright(F.col("u"), shift)
        g = goals.withColumnRenamed("source", "g_source")
        inside = rows.join(g, rows.source.eqNullSafe(g.g_source) & (F.shiftright(rows.u, shift + BITS) == g.prefix))
        hist = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("n").over(run))
        h, g = hist.withColumnRenamed("source", "h_source"), goals
        met = (
            h.join(g, h.h_source.eqNullSafe(g.source))
            .where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("n") < F.col("left")))
            .groupBy("h_source").agg(F.min(F.struct("bucket", "n", "upto")).alias("m"))
        )
        goals = goals.join(met, goals.source.eqNullSafe(met.h_source), "left").select(
            "source", "copies",
            (F.col("left") - F.coalesce(F.col("m.upto") - F.col("m.n"), F.lit(0))).alias("left"),
            F.coalesce(F.col("m.bucket"), F.shiftleft(F.col("prefix"), BITS)).alias("prefix"),
            F.coalesce(F.col("m.n"), F.lit(0)).alias("last"),
        )
        goals = materialize(goals, f"mix-level{level}")
        if level < LEVELS:
            goals = goals.drop("last")
    # the last boundary bucket goes in if that brings the sum nearer to the goal
    return goals.select("source", "copies", (F.col("prefix") + F.when(F.col("last") - F.col("left") <= F.col("left"), F.when(F.col("left") > 0, 1).otherwise(0)).otherwise(0)).alias("theta"))


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """A row for each source of ``rows`` (see ``sized``): p_source, source_size, target, copies, theta."""
    goal = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    split = goal.select("source", whole.alias("copies"), (F.col("target") - whole * F.col("source_size")).alias("left"))
    theta = thresholds(rows, split).withColumnRenamed("source", "t_source")
    per = goal.join(theta, goal.source.eqNullSafe(theta.t_source)).withColumnRenamed("source", "p_source").drop("t_source")
    return materialize(per, "mix-sources")  # Spark knows its size and broadcasts it only if it is small


def _copies(cap: int):
    more = F.shiftright(F.col("u"), HASH_BITS - BITS * LEVELS) < F.col("theta")
    return F.least(F.col("copies") + F.when(more, 1).otherwise(0), F.lit(cap)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES, seed: int = 17) -> DataFrame:
    """How often the mix takes each row of ``docs``.

    Returns a row for each row of ``docs``: doc_id, source, size, u,
    source_size, target, copies (0 to ``cap``), taken = copies * size.  Other
    columns of ``docs`` are not read.  Null text has size 0, null source is a
    source of its own, rows that agree in doc_id and text share a hash and are
    taken alike, and an empty table gives an empty result.
    """
    rows = materialize(sized(docs, seed), "mix-sized")
    per = plan(rows, weights, cap)
    out = rows.join(per, rows.source.eqNullSafe(per.p_source)).withColumn("copies", _copies(cap))
    return out.select("doc_id", "source", "size", "u", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES, seed: int = 17) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, columns unchanged."""
    p = free_prefix(docs.columns)
    per = plan(materialize(sized(docs, seed), "mix-sized"), weights, cap)
    per = per.select(F.col("p_source").alias(f"{p}source"), F.col("copies").alias(f"{p}whole"), F.col("theta").alias(f"{p}theta"))
    more = F.shiftright(row_hash(seed), HASH_BITS - BITS * LEVELS) < F.col(f"{p}theta")
    copies = F.least(F.col(f"{p}whole") + F.when(more, 1).otherwise(0), F.lit(cap)).cast("int")
    out = docs.join(per, docs.source.eqNullSafe(per[f"{p}source"])).withColumn(f"{p}copy", F.explode(F.array_repeat(F.lit(0), copies)))
    return out.select(*[docs[c] for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '-') || '|' || md5(coalesce(text, ''))), 1, 9))::BIGINT AS p
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3.0 * sum(size)::DOUBLE AS cap,
         (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w
  FROM d GROUP BY source),
f AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
t AS (
  SELECT source, source_size, CASE WHEN level >= cap / w THEN cap ELSE w * max(CASE WHEN level < cap / w THEN level END) OVER () END AS target FROM f),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
         CASE WHEN source_size > 0 THEN target - floor(target / source_size) * source_size ELSE target END AS wanted FROM t),
h AS (SELECT source, p, sum(size) AS n FROM d GROUP BY source, p),
c AS (SELECT source, p, n, sum(n) OVER (PARTITION BY source ORDER BY p) AS upto FROM h),
e AS (
  SELECT c.source, c.p, (CASE WHEN upto <= wanted THEN 1 WHEN upto - n >= wanted THEN 0 WHEN upto - wanted <= wanted - (upto - n) THEN 1 ELSE 0 END) AS more
  FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source)
SELECT d.doc_id, d.size, g.source_size, g.target, (least(g.whole + e.more, 3) * d.size)::BIGINT AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source JOIN e ON e.source IS NOT DISTINCT FROM d.source AND e.p = d.p
"""
