"""Command line: clean, dictionary, index, collocations, search, archive, paths.

``python -m corpusloom.cli clean OUT DIR...`` and so on; ``-h`` lists all.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import lemmatize, tokenize
from corpusloom.operators import collocations, dictionary
from corpusloom.operators.postings import Index, load_index, postings, save_index, term_statistics
from corpusloom.plans.service import Searcher
from corpusloom.sources import dumps, sinks


def clean(spark, a) -> None:
    """Dump files to OUT/docs, OUT/tokens and OUT/meta; prints the statistics."""
    dumps.split_documents(dumps.read_dump_files(spark, *a.dirs)).write.mode("overwrite").parquet(f"{a.out}/docs")
    docs = spark.read.parquet(f"{a.out}/docs")
    sinks.write_meta(docs, f"{a.out}/meta")
    sinks.write_tokens(tokenize(docs), f"{a.out}/tokens")
    print(sinks.token_statistics(tokenize(docs), docs).first().asDict())


def _tokens(spark, path):
    return spark.read.parquet(f"{path}/tokens").select("doc_id", F.posexplode("tokens").alias("pos", "token"))


def make_dictionary(spark, a) -> None:
    """Tokens of a cleaned corpus, a line each, by count and token."""
    sinks.write_lines(dictionary.dictionary(_tokens(spark, a.corpus)), "token", ["cnt", "token"], a.out)


def index(spark, a) -> None:
    """The index of a cleaned corpus; LEMMAS is a tab-separated file of token and lemma."""
    lemmas = spark.read.csv(a.lemmas, sep="\t", schema="token string, lemma string", quote="") if a.lemmas else None
    p = postings(lemmatize(_tokens(spark, a.corpus), lemmas, drop_unknown=lemmas is not None))
    save_index(Index(spark.read.parquet(f"{a.corpus}/docs").select("doc_id"), p, term_statistics(p)), a.out)


def collocate(spark, a) -> None:
    """The best pairs by both tests."""
    tokens = _tokens(spark, a.corpus)
    for test in ("t", "chi"):
        print(f"---- {test} ----")
        for r in collocations.collocations(tokens, test).collect():
            print(r["w1"], r["w2"])


def find(spark, a) -> None:
    """A page of results with snippets."""
    meta = dumps.read_meta(spark, f"{a.corpus}/meta")
    searcher = Searcher(load_index(spark, a.index), spark.read.parquet(f"{a.corpus}/docs"), meta=meta)
    for r in searcher.view(a.query, a.page):
        print(f"{r['doc_id']}\t{r['title']}\t{r['link']}\n  {r['snippet']}")


def archive(spark, a) -> None:
    """A stored document."""
    from corpusloom.plans.search import archive as stored

    for r in stored(spark.read.parquet(f"{a.corpus}/docs"), a.id).collect():
        print(r["text"])


def paths(spark, a) -> None:
    """Files of directories."""
    dumps.list_paths(spark, *a.dirs).select(F.concat_ws(" ", "file", "dir").alias("value")).write.mode("overwrite").text(a.out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    sub = p.add_subparsers(required=True)
    for name, run, args in (
        ("clean", clean, ["out", "dirs+"]), ("dictionary", make_dictionary, ["out", "corpus"]), ("index", index, ["out", "corpus", "--lemmas"]),
        ("collocations", collocate, ["corpus"]), ("search", find, ["index", "corpus", "query", "--page"]), ("archive", archive, ["corpus", "id"]), ("paths", paths, ["out", "dirs+"]),
    ):
        s = sub.add_parser(name, help=run.__doc__)
        s.set_defaults(run=run)
        for x in args:
            s.add_argument(x.rstrip("+"), **({"nargs": "+"} if x.endswith("+") else {"type": int, "default": 0} if x == "--page" else {}))
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("corpusloom").getOrCreate()
    args.run(spark, args)


if __name__ == "__main__":
    main()
