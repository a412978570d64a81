"""The inverted index: one row for each term and document."""

from __future__ import annotations

from dataclasses import dataclass

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import lemmatize, tokenize

#: Least and most partitions of a stored index by hash of term, and documents for each more; a query reads only its terms' partitions.
BUCKETS, MOST_BUCKETS, BUCKET_DOCS = 64, 100_000, 100_000
#: Parts of each of them, by hash of doc_id, so that a hot term is not one file.
SPREAD = 4


def postings(terms: DataFrame) -> DataFrame:
    """term, doc_id, tf, positions (ascending) from doc_id, pos, term."""
    return terms.groupBy("term", "doc_id").agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def term_statistics(p: DataFrame) -> DataFrame:
    """term, df, cf."""
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@dataclass(frozen=True)
class Index:
    """The universe of documents, their postings and each term's frequencies."""

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    buckets: int = 0  # of a stored index

    def select(self, terms: list[str]) -> DataFrame:
        """Postings of some terms; a stored index prunes to their partitions and row groups."""
        p = self.postings
        if self.buckets:
            p = p.where(F.col("bucket").isin(*{bucket_of(t, self.buckets) for t in terms}))
        return p.where(F.col("term").isin(*terms)).select("term", "doc_id", "tf", "positions")


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def bucket_of(term: str, buckets: int) -> int:
    """What ``_bucket`` gives for a term, without a job."""
    h = xxhash.xxh64_intdigest(term.encode(), 42)
    return (h - (1 << 64) if h >= 1 << 63 else h) % buckets


def build_index(docs: DataFrame, lemmas: DataFrame | None = None, drop_unknown: bool = False) -> Index:
    p = postings(lemmatize(tokenize(docs.select("doc_id", "text")), lemmas, drop_unknown))
    return Index(docs.select("doc_id"), p, term_statistics(p))


def save_index(index: Index, path: str, buckets: int | None = None) -> Index:
    """Write the index: postings partitioned by term hash, hot terms spread over files by doc_id, sorted by term.

    The number of partitions grows with the documents; it is stored with the index.
    """
    spark = index.postings.sparkSession
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    if buckets is None:
        buckets = min(MOST_BUCKETS, max(BUCKETS, spark.read.parquet(f"{path}/docs").count() // BUCKET_DOCS))
    p = index.postings.withColumn("bucket", _bucket(buckets))
    keys = ["bucket", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))]
    p = p.repartition(*keys) if buckets <= BUCKETS else p.repartition(buckets * SPREAD, *keys)
    p.sortWithinPartitions("bucket", "term", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    term_statistics(spark.read.parquet(f"{path}/postings")).write.mode("overwrite").parquet(f"{path}/terms")
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
    return load_index(spark, path)


def load_index(spark: SparkSession, path: str) -> Index:
    buckets = spark.read.parquet(f"{path}/layout").first()["buckets"]
    return Index(spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), buckets)
