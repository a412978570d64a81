"""Token dictionary and term ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.scratch import keep


def dictionary(tokens: DataFrame) -> DataFrame:
    """token, cnt."""
    return tokens.groupBy("token").agg(F.count("*").alias("cnt"))


def ordered(counts: DataFrame) -> DataFrame:
    """The dictionary by (count, token)."""
    return counts.orderBy("cnt", "token")


def term_ids(counts: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """term_id, term: terms in the order in which their first token stands in the ordered dictionary, from 0.

    A global number needs one order over the vocabulary: rows are range-
    partitioned, numbered within each partition, and moved up by the counts of
    the partitions before (one small row each).
    """
    if lemmas is not None:
        counts = counts.join(lemmas, "token", "left").withColumn("term", F.coalesce(F.nullif("lemma", F.lit("")), "token"))
    else:
        counts = counts.withColumn("term", F.col("token"))
    first = counts.groupBy("term").agg(F.min(F.struct("cnt", "token")).alias("first"))
    return number(first, ["first"], "term_id").select("term_id", "term")


def number(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with its rows' places in the order, from 0, without bringing them to one task.

    The partitioned rows are written to the shared folder: both the places and
    the partitions' sizes must see the same partitions, whatever executors get lost.
    """
    parts = keep(df.repartitionByRange(*order).withColumn("cl_part", F.spark_partition_id()), "numbered")
    local = parts.withColumn("cl_at", F.row_number().over(Window.partitionBy("cl_part").orderBy(*order)))
    sizes = parts.groupBy("cl_part").agg(F.count("*").alias("n"))
    base = sizes.select("cl_part", F.coalesce(F.sum("n").over(Window.orderBy("cl_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("cl_base"))
    return local.join(F.broadcast(base), "cl_part").withColumn(name, F.col("cl_base") + F.col("cl_at") - 1).drop("cl_part", "cl_at", "cl_base")
