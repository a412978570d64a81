"""Writing: tokens, metadata, lists and the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tokens(tokens: DataFrame, path: str) -> None:
    """doc_id and its tokens in order, one row a document."""
    by_doc = tokens.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("tokens"))
    by_doc.write.mode("overwrite").parquet(path)


def write_meta(meta: DataFrame, path: str) -> None:
    meta.select("doc_id", "link", "title", "path").write.mode("overwrite").csv(path, sep="\t", quote="", escapeQuotes=False)


def write_lines(df: DataFrame, column: str, order: list[str], path: str) -> None:
    """One value a line, in order, over as many part files as the range partitioner makes."""
    df.orderBy(*order).select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def token_statistics(tokens: DataFrame, docs: DataFrame) -> DataFrame:
    """n_docs, n_tokens, avg_token_length, avg_tokens_per_doc."""
    t = tokens.agg(F.count("*").alias("n_tokens"), F.sum(F.length("token")).alias("chars"))
    both = docs.agg(F.count("*").alias("n_docs")).join(t)  # one row each
    return both.select("n_docs", "n_tokens", F.try_divide("chars", "n_tokens").alias("avg_token_length"), F.try_divide("n_tokens", "n_docs").alias("avg_tokens_per_doc"))
