"""Reading: dump files, token files, metadata, term lists, path listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import dictionary
from corpusloom.schemas import META

#: Fixed form of a dump record: id, url and title in this order, none of them empty.
RECORD = r'(?s)<doc\s+id="(\d+?)"\s+url="(.+?)"\s+title="(.+?)">(.+?)</doc>'


def read_dump_files(spark: SparkSession, *paths: str) -> DataFrame:
    """path, value (the whole file) of every file below ``paths``."""
    files = spark.read.option("recursiveFileLookup", True).text(list(paths), wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def split_documents(files: DataFrame) -> DataFrame:
    """doc_id, link, title, text, path of every record in the files."""
    found = files.select("path", F.explode(F.regexp_extract_all("value", F.lit(RECORD), F.lit(0))).alias("record"))
    part = lambda i: F.regexp_extract("record", RECORD, i)
    return found.select(part(1).cast("long").alias("doc_id"), part(2).alias("link"), part(3).alias("title"), part(4).alias("text"), "path")


def read_token_files(spark: SparkSession, *paths: str, recursive: bool = True) -> DataFrame:
    """doc_id (the file's name), pos, token of files with whitespace-separated tokens."""
    files = spark.read.option("recursiveFileLookup", recursive).text(list(paths), wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).cast("long")
    split = F.filter(F.split("value", r"\s+"), lambda t: t != "")
    return files.select(name.alias("doc_id"), F.posexplode(split).alias("pos", "token"))


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, link, title, path from a tab-separated file."""
    return spark.read.csv(path, sep="\t", schema=META, quote="")


def read_numbered(spark: SparkSession, path: str, name: str, number: str) -> DataFrame:
    """Lines of a list with their numbers from 0; the part files of a folder follow each other by name.

    A list may be as large as a vocabulary: blocks of files are read side by
    side, and a line's place within its block decides among the block's lines.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias(name), F.col("_metadata.file_path").alias("cl_file"),
        F.col("_metadata.file_block_start").alias("cl_block"), F.monotonically_increasing_id().alias("cl_line"),
    )
    return dictionary.number(lines, ["cl_file", "cl_block", "cl_line"], number).select(number, name)


def zip_lemmas(tokens: DataFrame, lemmas: DataFrame) -> DataFrame:
    """token, lemma of two line-numbered lists (``read_numbered``); lines that one list lacks are left out (``unpaired``)."""
    return tokens.join(lemmas, "line").select("token", "lemma")


def unpaired(tokens: DataFrame, lemmas: DataFrame) -> DataFrame:
    """line, token, lemma of the lines that one of the two lists lacks: no row if the lists fit each other."""
    both = tokens.withColumn("cl_a", F.lit(True)).join(lemmas.withColumn("cl_b", F.lit(True)), "line", "full")
    return both.where("cl_a IS NULL OR cl_b IS NULL").select("line", "token", "lemma")


def list_paths(spark: SparkSession, *paths: str) -> DataFrame:
    """file, dir of every file directly in ``paths``."""
    found = spark.read.format("binaryFile").load(list(paths)).select(F.regexp_replace("path", r"^file:/+", "/").alias("p"))
    return found.select(F.regexp_extract("p", r"([^/]+)$", 1).alias("file"), F.regexp_extract("p", r"^(.*)/[^/]+$", 1).alias("dir"))
