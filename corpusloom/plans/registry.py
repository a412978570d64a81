"""The retrieval engine's queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import codecs
from corpusloom.functions.text import tokenize, tokens_of
from corpusloom.functions.weights import idf
from corpusloom.operators import collocations as coll
from corpusloom.operators import dictionary as dic
from corpusloom.operators.postings import Index, build_index
from corpusloom.plans import ast, search, sql
from corpusloom.plans.ast import And, Not, Or, Quote, Term
from corpusloom.sources import dumps, sinks

QUERIES: dict = {}
ORACLE: dict = {}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _index(spark: SparkSession, sf_dir: str) -> Index:
    return build_index(_docs(spark, sf_dir))


def _shown(results: DataFrame) -> DataFrame:
    return results.withColumn("rank", F.round(F.col("rank").cast("double"), 4))


def query(sql_text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql_text:
            ORACLE[f.__name__] = sql_text
        return f

    return add


@query(f"WITH {sql.TOKENS} SELECT doc_id, pos, token FROM tok")
def tokenize_documents(spark, sf_dir):
    return tokenize(_docs(spark, sf_dir))


@query(f"WITH {sql.TOKENS} SELECT (SELECT count(*) FROM documents) AS n_docs, count(*) AS n_tokens, sum(length(token)) / count(*) AS avg_token_length, count(*) / (SELECT count(*) FROM documents) AS avg_tokens_per_doc FROM tok")
def token_stats(spark, sf_dir):
    return sinks.token_statistics(tokenize(_docs(spark, sf_dir)), _docs(spark, sf_dir))


def records(docs: DataFrame) -> DataFrame:
    """Each document as a dump record; none for a null text."""
    head = F.concat(F.lit('<doc id="'), "doc_id", F.lit('" url="https://example.org/'), "doc_id", F.lit('" title="T'), "doc_id", F.lit('">'))
    return docs.select(F.concat(head, "text", F.lit("</doc>")).alias("value")).where("value IS NOT NULL")


#: A record's text ends before the first end tag behind its first character; without one there is no record.
EXTRACTED = """SELECT doc_id, 'https://example.org/' || doc_id AS link, 'T' || doc_id AS title, left(t, 1) || split_part(substr(t, 2), '</doc>', 1) AS text
    FROM (SELECT doc_id, text || '</doc>' AS t FROM documents) WHERE contains(substr(t, 2), '</doc>')"""


@query(EXTRACTED)
def doc_extract(spark, sf_dir):
    """Wrap each document as a dump record and read it back."""
    return dumps.split_documents(records(_docs(spark, sf_dir)).withColumn("path", F.lit("dump"))).select("doc_id", "link", "title", "text")


@query(f"WITH {sql.TOKENS} SELECT token, count(*) AS cnt FROM tok GROUP BY token")
def dictionary(spark, sf_dir):
    return dic.dictionary(tokenize(_docs(spark, sf_dir)))


@query(f"WITH {sql.TOKENS}, c AS (SELECT token, count(*) AS cnt FROM tok GROUP BY token) SELECT (row_number() OVER (ORDER BY cnt, token)) - 1 AS term_id, token AS term FROM c")
def term_ids(spark, sf_dir):
    return dic.term_ids(dic.dictionary(tokenize(_docs(spark, sf_dir))))


_POST = f"WITH {sql.TOKENS}, post AS (SELECT token AS term, doc_id, count(*)::INT AS tf, list(pos ORDER BY pos) AS positions FROM tok GROUP BY 1, 2)"


@query(_POST + " SELECT term, doc_id, tf, array_to_string(positions, ',') AS positions FROM post")
def postings(spark, sf_dir):
    return _index(spark, sf_dir).postings.withColumn("positions", F.array_join("positions", ","))


@query(_POST + ", n AS (SELECT count(*) AS n FROM documents) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, round(ln(any_value(n) / count(*))::DOUBLE, 4) AS idf FROM post, n GROUP BY term")
def term_df_idf(spark, sf_dir):
    index = _index(spark, sf_dir)
    return index.terms.withColumn("idf", F.round(idf(index.docs.count(), F.col("df")).cast("double"), 4))


@query(_POST + " SELECT term, doc_id, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS delta FROM post")
def delta_doc_ids(spark, sf_dir):
    return codecs.deltas(_index(spark, sf_dir).postings.select("term", "doc_id"), "term", "doc_id")


_LEN = "CASE WHEN delta > 0 THEN length(ltrim(bin(delta), '0')) ELSE 1 END"


@query(
    _POST + f""", d AS (SELECT term, doc_id, doc_id - lag(doc_id, 1, 0) OVER w AS delta, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY term) AS df FROM post WINDOW w AS (PARTITION BY term ORDER BY doc_id)),
    s AS (SELECT *, least(greatest(1, floor(sqrt(df))), 100) AS stride FROM d)
    SELECT term, df, sum(ceil({_LEN} / 7) * 8)::BIGINT AS byte_bits, sum(ceil({_LEN} / 3) * 4)::BIGINT AS nibble_bits, count(*) FILTER (stride > 10 AND df - pos > 10 AND pos % stride = 0) AS skips,
    CASE WHEN sum(ceil({_LEN} / 7) * 8) <= sum(ceil({_LEN} / 3) * 4) THEN 'byte' ELSE 'nibble' END AS codec FROM s GROUP BY term, df"""
)
def posting_list_sizes(spark, sf_dir):
    return codecs.list_sizes(_index(spark, sf_dir).postings)


#: name -> expression.  Frequent terms, so that the cap on results is reached.
SEARCHES: dict[str, ast.Node] = {
    "q_term": Term("the"),
    "q_and": And(Term("the"), Term("of")),
    "q_and_self": And(Term("the"), Term("the")),
    "q_and_three": And(And(Term("the"), Term("of")), Term("and")),
    "q_or": Or(Term("the"), Term("de")),
    "q_not": Not(Term("the")),
    "q_not_not": Not(Not(Term("the"))),
    "q_nested": And(Or(Not(Quote(("of", "the"), 4)), Or(Term("and"), Term("en"))), Term("in")),
    "q_phrase2": Quote(("of", "the")),
    "q_phrase3": Quote(("and", "of", "the")),
    "q_phrase_repeat": Quote(("the", "of", "the"), 12),
    "q_proximity": Quote(("the", "and", "of"), 9),
    "q_single_word_quote": Quote(("the",)),
}
for _name, _node in SEARCHES.items():
    QUERIES[_name] = lambda spark, sf_dir, node=_node: _shown(search.ranked(_index(spark, sf_dir), node))
    ORACLE[_name] = sql.Sql(ast.simplify(_node)).ranked(search.MAX_RESULTS)

#: Query texts; their SQL comes from the trees that they stand for, written out.
TEXTS: dict[str, str] = {"rank_boolean_top500": "(the | de) & !\"of the\" /3", "q_implicit_and": "the of !en"}
TREES: dict[str, ast.Node] = {
    "rank_boolean_top500": And(Or(Term("the"), Term("de")), Not(Quote(("of", "the"), 3))),
    "q_implicit_and": And(Term("the"), And(Term("of"), Not(Term("en")))),
}
for _name, _text in TEXTS.items():
    QUERIES[_name] = lambda spark, sf_dir, text=_text: _shown(search.search(_index(spark, sf_dir), text))
    ORACLE[_name] = sql.Sql(TREES[_name]).ranked(search.MAX_RESULTS)

CASCADES: dict[str, str] = {"cascade_single": "the", "cascade_2": "of the", "cascade_3": "and of the"}
#: Stage -> tree, the strictest first.
STAGES: dict[str, dict[int, ast.Node]] = {
    "cascade_single": {1: Term("the")},
    "cascade_2": {2: Quote(("of", "the")), 1: And(Term("of"), Term("the")), 0: Or(Term("of"), Term("the"))},
    "cascade_3": {
        3: Quote(("and", "of", "the")),
        2: And(Quote(("and", "of")), Quote(("of", "the"))),
        1: And(And(Term("and"), Term("of")), Term("the")),
        0: Or(Or(Term("and"), Term("of")), Term("the")),
    },
}
for _name, _text in CASCADES.items():
    QUERIES[_name] = lambda spark, sf_dir, text=_text: _shown(search.search(_index(spark, sf_dir), text))
    ORACLE[_name] = sql.cascade(STAGES[_name], search.MAX_RESULTS)


@query(sql.Sql(Or(Term("the"), Term("de"))).matches())
def match_set(spark, sf_dir):
    return search.match_set(_index(spark, sf_dir), Or(Term("the"), Term("de")))


@query(sql.Sql(SEARCHES["q_and"]).ranked(search.MAX_RESULTS, 51, 100))
def page_2(spark, sf_dir):
    return _shown(search.page(search.ranked(_index(spark, sf_dir), SEARCHES["q_and"]), 1))


@query("SELECT 1 AS rank_pos, 1::BIGINT AS doc_id, 0.5::DOUBLE AS rank, 0 AS stage WHERE false")
def q_unknown_term(spark, sf_dir):
    """An unknown word empties a boolean query, even under OR."""
    return _shown(search.search(_index(spark, sf_dir), "the | zzzzqqqq"))


_PAIRS = f"""WITH {sql.TOKENS}, p AS (SELECT token AS w1, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS w2 FROM tok),
b AS (SELECT w1, w2, count(*) AS n FROM p WHERE w2 IS NOT NULL GROUP BY 1, 2), g AS (SELECT sum(n)::DOUBLE AS b FROM b)"""


@query(_PAIRS + " SELECT * FROM b")
def bigram_counts(spark, sf_dir):
    return coll.text_bigrams(_docs(spark, sf_dir))


@query(
    _PAIRS + """, s AS (SELECT token, count(*) AS c FROM tok GROUP BY 1), t AS (SELECT sum(c)::DOUBLE AS total FROM s),
    m AS (SELECT w1, w2, n, (x.c / total) * (y.c / total) AS m1, n / b AS m2, b FROM b JOIN s x ON x.token = w1 JOIN s y ON y.token = w2, g, t)
    SELECT w1, w2, n, round((m2 - m1) / sqrt(m2 * (1 - m2) / b), 4) AS score FROM m WHERE (m2 - m1) / sqrt(m2 * (1 - m2) / b) > 3.291 ORDER BY (m2 - m1) / sqrt(m2 * (1 - m2) / b) DESC, w1, w2 LIMIT 150"""
)
def collocations_t(spark, sf_dir):
    return coll.text_collocations(_docs(spark, sf_dir), "t").withColumn("score", F.round("score", 4))


def _chi_sql(sign: str) -> str:
    return _PAIRS + f""", f AS (SELECT w1, sum(n) AS f FROM b GROUP BY 1), s AS (SELECT w2, sum(n) AS s FROM b GROUP BY 1),
    c AS (SELECT w1, w2, n, n::DOUBLE AS a11, f - n::DOUBLE AS a12, s - n::DOUBLE AS a21, b FROM b JOIN f USING (w1) JOIN s USING (w2), g),
    d AS (SELECT *, b - a12 - a21 {sign} a11 AS a22 FROM c),
    x AS (SELECT *, b * pow(a11 * a22 - a12 * a21, 2) / nullif((a11 + a12) * (a11 + a21) * (a12 + a22) * (a21 + a22), 0) AS score FROM d)
    SELECT w1, w2, n, round(score, 2) AS score FROM x WHERE score > 10.83 AND a11 > 50 AND a12 > 20 AND a21 > 20 ORDER BY x.score DESC, w1, w2 LIMIT 150"""


@query(_chi_sql("+"))
def collocations_chi(spark, sf_dir):
    return coll.text_collocations(_docs(spark, sf_dir), "chi").withColumn("score", F.round("score", 2))


@query(_chi_sql("-"))
def collocations_chi_corrected(spark, sf_dir):
    return coll.text_collocations(_docs(spark, sf_dir), "chi", corrected=True).withColumn("score", F.round("score", 2))


@query("SELECT doc_id, text FROM documents WHERE doc_id = 7")
def archive(spark, sf_dir):
    return search.archive(_docs(spark, sf_dir), 7)


@query("SELECT 'documents.parquet' AS file")
def path_listing(spark, sf_dir):
    return dumps.list_paths(spark, sf_dir).where("file = 'documents.parquet'").select("file")


@query(sql.snippets(f"SELECT rank_pos, doc_id, text FROM ({sql.cascade(STAGES['cascade_3'], search.MAX_RESULTS)}) JOIN documents USING (doc_id) WHERE rank_pos <= {search.PAGE}", ["and", "of", "the"]))
def search_view(spark, sf_dir):
    """A page of results with snippets."""
    docs = _docs(spark, sf_dir)
    return search.results_view(build_index(docs), docs, "and of the")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_index(spark, sf_dir), "the & of")
