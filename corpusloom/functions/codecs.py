"""Sizes of posting lists under the two variable-length integer codes, delta coding and skip entries.

Parquet encodes the stored tables; these columns serve statistics and parity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _length(x: Column) -> Column:
    return F.greatest(F.when(x > 0, F.length(F.bin(x))).otherwise(1), F.lit(1))


def byte_bits(x: Column) -> Column:
    """Bits of x in the byte code: seven data bits a byte."""
    return F.ceil(_length(x) / 7) * 8


def nibble_bits(x: Column) -> Column:
    """Bits of x in the half-byte code: three data bits a nibble."""
    return F.ceil(_length(x) / 3) * 4


def deltas(df: DataFrame, key: str, value: str) -> DataFrame:
    """``delta``: the first value of a key, then differences, in ascending order."""
    w = Window.partitionBy(key).orderBy(value)
    return df.withColumn("delta", F.col(value) - F.lag(value, 1, 0).over(w))


def undelta(df: DataFrame, key: str, order: str) -> DataFrame:
    """``value``: the running sum of ``delta``."""
    return df.withColumn("value", F.sum("delta").over(Window.partitionBy(key).orderBy(order)))


def skip_stride(n: Column) -> Column:
    """Entries between skips in a list of n: the root of n, 1 to 100."""
    return F.least(F.greatest(F.lit(1), F.floor(F.sqrt(n))), F.lit(100))


def has_skip(n: Column, pos: Column) -> Column:
    """Whether entry ``pos`` of a list of n carries a skip."""
    s = skip_stride(n)
    return (s > 10) & (n - pos > 10) & (pos % s == 0)


def list_sizes(postings: DataFrame) -> DataFrame:
    """term, df, byte_bits, nibble_bits, codec (byte on ties) and skips of each term's list of doc_ids."""
    d = deltas(postings.select("term", "doc_id"), "term", "doc_id").withColumn("pos", F.row_number().over(Window.partitionBy("term").orderBy("doc_id")) - 1)
    d = d.withColumn("df", F.count("*").over(Window.partitionBy("term")))
    sizes = d.groupBy("term", "df").agg(F.sum(byte_bits(F.col("delta"))).alias("byte_bits"), F.sum(nibble_bits(F.col("delta"))).alias("nibble_bits"), F.count_if(has_skip(F.col("df"), F.col("pos"))).alias("skips"))
    return sizes.withColumn("codec", F.when(F.col("byte_bits") <= F.col("nibble_bits"), "byte").otherwise("nibble"))
