"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize


def _with_least(pairs: DataFrame) -> DataFrame:
    """u, v and m, the least of u and its neighbours.

    The least comes from a pre-aggregation.  It is dealt anew before the join,
    so that both sides of the join are plain exchanges and a hub's partition
    can be split.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    least = least.repartition(F.xxhash64("k"))
    return pairs.join(least, pairs.u == least.k).select("u", "v", F.least("u", "m").alias("m"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root: the least node that each node of ``edges`` (u, v; longs) reaches.

    Every round is written to the shared folder, so neither lineage nor the
    driver grows.  Loops and repeated edges are harmless; nodes without an edge
    to another node are absent; no edges give an empty result.
    """
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    state = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        s = _with_least(large)
        small = s.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(s.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = materialize(small, name)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
