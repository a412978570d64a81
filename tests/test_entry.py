"""The driver contract."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert entry.entry(spark).columns == ["rank_pos", "doc_id", "rank", "stage"] and entry.entry(spark).count() > 0


def test_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["q_and", "q_nested", "q_proximity", "cascade_3", "collocations_t", "postings", "search_view", "snippets", "dump_walk", "meta_sink", "lemma_lists", "lemma_postings_known", "lemma_boolean", "stored_not", "postfix_search", "service_page", "parsed_queries"])
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    cell = lambda v: round(v, 6) if isinstance(v, float) else v
    have = sorted(str([cell(r[c]) for c in columns]) for r in df.collect())
    out = db.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in out.description].index(c) for c in columns]
    assert have == sorted(str([cell(r[i]) for i in at]) for r in out.fetchall())
