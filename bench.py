"""Times the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores).  The index is
built and stored once (timed as ``index_build``); searches run on the stored
index, as they would in service.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import tokenize
from corpusloom.operators import collocations
from corpusloom.operators.postings import build_index, save_index
from corpusloom.plans import search
from corpusloom.plans.registry import SEARCHES, TEXTS


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).agg(F.sum("id")).collect()
    seconds: dict[str, float] = {}

    def timed(name, run):
        began = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - began, 3)

    def drain(df):
        df.write.format("noop").mode("overwrite").save()

    with tempfile.TemporaryDirectory() as folder:
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        held = {}
        timed("index_build", lambda: held.update(index=save_index(build_index(docs), f"{folder}/index")))
        index = held["index"]
        drain(search.ranked(index, SEARCHES["q_term"]))  # warm up
        for name in ("q_term", "q_and", "q_and_three", "q_or", "q_not", "q_nested", "q_phrase2", "q_phrase3", "q_phrase_repeat", "q_proximity"):
            timed(name, lambda node=SEARCHES[name]: drain(search.ranked(index, node)))
        for name, text in {**TEXTS, "cascade_2": "of the", "cascade_3": "and of the"}.items():
            timed(name, lambda text=text: drain(search.search(index, text)))
        timed("page_2", lambda: drain(search.page(search.ranked(index, SEARCHES["q_and"]), 1)))
        tokens = tokenize(docs)
        timed("tokenize", lambda: drain(tokens))
        timed("collocations_t", lambda: drain(collocations.text_collocations(docs, "t")))
        timed("collocations_chi", lambda: drain(collocations.text_collocations(docs, "chi")))
        try:
            from corpusloom.llm.queries import QUERIES
        except ModuleNotFoundError:
            QUERIES = {}
        for name, f in QUERIES.items():
            timed(name, lambda f=f: drain(f(spark, sf)))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus}))


if __name__ == "__main__":
    main()
