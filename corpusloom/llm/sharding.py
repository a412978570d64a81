"""Two-pass external shuffle into shards.

Pass one scatters records by seeded hashes into buckets that fit in memory (the
exchange).  Pass two loads one bucket at a time, puts its rows in a canonical
order, Fisher-Yates shuffles them with a seed of the bucket's own, and emits
them; a record's slot is its bucket's offset in the shard plus its place.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusloom.llm.common import arrow_batches, free_prefix, materialize

SHARDS, SEED = 8, 20_011
#: Target size of a bucket in memory.
BUCKET_BYTES = 16 << 20
#: Most partitions of the scatter; beyond that a task takes several buckets, one at a time.
MAX_PARTITIONS = 20_000
PREFIX = "cl_sh_"


def rendezvous(key, shards: int, seed: int = SEED):
    """Highest-random-weight shard of ``key``; another shard takes rows only into itself."""
    return F.greatest(*[F.struct(F.xxhash64(F.lit(seed), F.lit(i), key).alias("h"), F.lit(i).alias("i")) for i in range(shards)])["i"]


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A uniform permutation of ``range(n)``, the same for the same seed.

    ``draws[i]`` is uniform in 0..i; the loop swaps from the end down.
    """
    draws = np.random.Generator(np.random.PCG64(seed)).integers(0, np.arange(1, n + 1), endpoint=False) if n else []
    order, draws = list(range(n)), [int(x) for x in draws]
    for i in range(n - 1, 0, -1):
        j = draws[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def _placed(docs: DataFrame, shards: int, seed: int, bucket_bytes: int) -> tuple[DataFrame, int]:
    """``docs`` with shard, bucket and grown shard, and the number of buckets.

    The shard comes from doc_id, the bucket from a hash of doc_id and text.
    Rows alike in both would share a bucket; where such a group is over an
    eighth of a bucket its rows get a number each, which the hash takes in.
    The numbers are written down first, so that a repeated task finds the same.
    """
    p, text = free_prefix(docs.columns, PREFIX), F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + 64
    alike = F.xxhash64(F.lit(seed + 1), key, text)
    groups = docs.select(alike.alias("h"), size.alias("b")).groupBy("h").agg(F.sum("b").alias("b"), F.count("*").alias("n"))
    large = F.col("b") > bucket_bytes / 8
    weight, repeated = groups.agg(F.sum("b"), F.max(large & (F.col("n") > 1))).first()
    per_shard = max(1, math.ceil((weight or 0) / shards / bucket_bytes))
    h = alike
    if repeated and per_shard > 1:
        hot = materialize(groups.where(large & (F.col("n") > 1)).select(F.col("h").alias(f"{p}h")), "shard-repeated")  # at most 8 a bucket
        marked = docs.withColumn(f"{p}alike", alike).join(hot, F.col(f"{p}alike") == F.col(f"{p}h"), "left")
        docs = materialize(marked.withColumn(f"{p}tie", F.when(F.col(f"{p}h").isNotNull(), F.monotonically_increasing_id())).drop(f"{p}h"), "shard-numbered")
        h = F.when(F.col(f"{p}tie").isNull(), F.col(f"{p}alike")).otherwise(F.xxhash64(f"{p}alike", f"{p}tie"))
    placed = docs.withColumns({f"{p}shard": rendezvous(key, shards, seed), f"{p}bucket": F.pmod(h, F.lit(per_shard)).cast("int"), f"{p}grown": rendezvous(key, shards + 1, seed)})
    return placed.drop(f"{p}alike", f"{p}tie"), shards * per_shard


def external_shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every row of ``docs`` with its shard, slot and the shard it has with one shard more.

    Law ``key``: ``doc_id`` and the number of shards decide the shard, so a hot
    source or a group of copies spreads like any rows; the bucket within a shard
    comes from a hash of doc_id and text.  Returns all columns of ``docs`` plus
    shard, slot and grown_shard (these names are overwritten if ``docs`` has
    them).  Null doc_id is a key of its own; null text counts as empty; rows
    alike in doc_id and text get slots of their own, and a large group of them
    spreads over the shard's buckets; an empty table gives an empty result.
    """
    arrow_batches(docs.sparkSession)
    docs = docs.drop("shard", "slot", "grown_shard")
    placed, buckets = _placed(docs, shards, seed, bucket_bytes)
    p = free_prefix(docs.columns, PREFIX)
    both = [f"{p}shard", f"{p}bucket"]
    # offsets: one row a bucket
    counts = placed.groupBy(*both).agg(F.count("*").alias(f"{p}n"))
    run = Window.partitionBy(both[0]).orderBy(both[1]).rowsBetween(Window.unboundedPreceding, -1)
    base = materialize(counts.select(*both, F.coalesce(F.sum(f"{p}n").over(run), F.lit(0)).alias(f"{p}base")), "shard-offsets")

    def shuffled(bucket_rows: pa.Table) -> pa.Table:
        shard, part = bucket_rows[both[0]][0].as_py(), bucket_rows[both[1]][0].as_py()
        order = [(c, "ascending") for c in ("doc_id", "text")]
        rows = bucket_rows.sort_by(order) if bucket_rows.num_rows > 1 else bucket_rows
        rows = rows.take(pa.array(fisher_yates(rows.num_rows, (seed, shard, part))))
        return rows.append_column(f"{p}at", pa.array(np.arange(rows.num_rows), pa.int64()))

    schema = StructType([*placed.schema.fields, StructField(f"{p}at", LongType())])
    # the scatter has a partition for each bucket, and the grouping needs no other exchange
    done = placed.repartition(min(buckets, MAX_PARTITIONS), *both).groupBy(*both).applyInArrow(shuffled, schema).join(base, both)
    return done.select(*[done[c] for c in docs.columns], F.col(both[0]).alias("shard"), (F.col(f"{p}base") + F.col(f"{p}at")).alias("slot"), F.col(f"{p}grown").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """The shuffled records as Parquet, a folder for each shard; each task writes its buckets as it has shuffled them, rows in slot order."""
    out = external_shuffle(docs, shards, seed, bucket_bytes)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
