"""Bigram collocations by t-test and chi-square."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import token_lists, tokenize

#: Fixed thresholds: t at 0.1 %, chi-square at 0.1 %, least cell counts, rows shown.
T_LEAST, CHI_LEAST, A11, A12, A21, TOP = 3.291, 10.83, 50, 20, 20, 150


def bigram_counts(tokens: DataFrame) -> DataFrame:
    """w1, w2, n of adjacent tokens of a document, from doc_id, pos, token."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    pairs = tokens.select(F.col("token").alias("w1"), F.lead("token").over(w).alias("w2")).where("w2 IS NOT NULL")
    return pairs.groupBy("w1", "w2").agg(F.count("*").alias("n"))


def text_bigrams(docs: DataFrame) -> DataFrame:
    """w1, w2, n of adjacent tokens of ``docs``; the pairs come out of each document's row, without a shuffle or sort of tokens."""
    t = token_lists(docs).select("t", F.expr("slice(t, 2, greatest(size(t) - 1, 0))").alias("u"))
    pairs = t.select(F.explode_outer(F.arrays_zip("t", "u")).alias("p")).select(F.col("p.t").alias("w1"), F.col("p.u").alias("w2"))
    return pairs.where("w2 IS NOT NULL").groupBy("w1", "w2").agg(F.count("*").alias("n"))


def t_test(tokens: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """w1, w2, n, score of the pairs that pass; the marginals join by shuffle or, if small, by broadcast."""
    pairs = bigram_counts(tokens) if pairs is None else pairs
    single = tokens.groupBy("token").agg(F.count("*").alias("c"))
    totals = pairs.agg(F.sum("n").cast("double").alias("b")).join(single.agg(F.sum("c").cast("double").alias("total")))  # one row
    c1, c2 = single.select(F.col("token").alias("w1"), F.col("c").alias("c1")), single.select(F.col("token").alias("w2"), F.col("c").alias("c2"))
    j = pairs.join(c1, "w1").join(c2, "w2").join(F.broadcast(totals))
    m1, m2 = (F.col("c1") / F.col("total")) * (F.col("c2") / F.col("total")), F.col("n") / F.col("b")
    t = F.try_divide(m2 - m1, F.sqrt(m2 * (1 - m2) / F.col("b")))
    return j.select("w1", "w2", "n", t.alias("score")).where(F.col("score") > T_LEAST)


def chi_square(tokens: DataFrame | None, corrected: bool = False, pairs: DataFrame | None = None) -> DataFrame:
    """w1, w2, n, score of the pairs that pass.

    The fourth cell is B - a12 - a21 + a11, as the results to match have it;
    ``corrected`` subtracts a11 instead.
    """
    pairs = bigram_counts(tokens) if pairs is None else pairs
    first, second = pairs.groupBy("w1").agg(F.sum("n").alias("f")), pairs.groupBy("w2").agg(F.sum("n").alias("s"))
    j = pairs.join(first, "w1").join(second, "w2").join(F.broadcast(pairs.agg(F.sum("n").cast("double").alias("b"))))
    j = j.withColumn("a11", F.col("n").cast("double")).withColumn("a12", F.col("f") - F.col("a11")).withColumn("a21", F.col("s") - F.col("a11"))
    j = j.withColumn("a22", F.col("b") - F.col("a12") - F.col("a21") + F.col("a11") * (-1 if corrected else 1))
    a11, a12, a21, a22, b = (F.col(c) for c in ("a11", "a12", "a21", "a22", "b"))
    x = F.try_divide(b * F.pow(a11 * a22 - a12 * a21, F.lit(2.0)), (a11 + a12) * (a11 + a21) * (a12 + a22) * (a21 + a22))
    return j.withColumn("score", x).where((F.col("score") > CHI_LEAST) & (a11 > A11) & (a12 > A12) & (a21 > A21)).select("w1", "w2", "n", "score")


def top(scored: DataFrame, n: int = TOP) -> DataFrame:
    return scored.orderBy(F.desc("score"), "w1", "w2").limit(n)


def collocations(tokens: DataFrame, test: str = "t", n: int = TOP) -> DataFrame:
    return top({"t": t_test, "chi": chi_square}[test](tokens), n)


def text_collocations(docs: DataFrame, test: str = "t", n: int = TOP, corrected: bool = False) -> DataFrame:
    """``collocations`` of the documents' texts."""
    pairs = text_bigrams(docs)
    return top(t_test(tokenize(docs), pairs) if test == "t" else chi_square(None, corrected, pairs), n)
