"""Scores of terms; each is rounded to a 32-bit float, as ties depend on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idf(n_docs: int, df: Column) -> Column:
    return F.ln(F.lit(float(n_docs)) / df).cast("float")


def tf_weight(tf: Column) -> Column:
    return F.when(F.coalesce(tf, F.lit(0)) > 0, 1 + F.ln(tf)).otherwise(0.0).cast("float")


def tfidf(tf: Column, df: int, n_docs: int) -> Column:
    """The alternative scoring: ln(1 + tf) * idf."""
    import math

    return (F.ln(1 + F.coalesce(tf, F.lit(0))) * (math.log(n_docs / df) if df else 0.0)).cast("float")
