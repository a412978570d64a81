"""Queries over what the sources and sinks wrote, over lemmas and stored indexes, and over the query language itself.

Files go to the shared folder.  Every SQL starts from ``documents`` again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.snippets import snippet_column
from corpusloom.functions.text import ends_with, file_name, tokenize
from corpusloom.operators import dictionary as dic
from corpusloom.operators.postings import Index, build_index, save_index
from corpusloom.plans import ast, parser, search, sql
from corpusloom.plans.ast import And, Not, Or, Quote, Term
from corpusloom.plans.registry import EXTRACTED, ORACLE, QUERIES, _docs, _shown, query, records
from corpusloom.schemas import RESULTS
from corpusloom.scratch import folder
from corpusloom.ship import ship
from corpusloom.sources import dumps, sinks

#: Stand-in for a morphological analyser: a plural's s goes, a token of two characters has an empty lemma, which stands for itself.
LEMMA = "CASE WHEN length(token) > 2 AND token LIKE '%s' THEN left(token, length(token) - 1) WHEN length(token) = 2 THEN '' ELSE token END"


def lemma_table(tokens: DataFrame, least: int = 1) -> DataFrame:
    """token, lemma of the tokens that occur ``least`` times."""
    return dic.dictionary(tokens).where(F.col("cnt") >= least).select("token", F.expr(LEMMA).alias("lemma"))


_LEM = sql.TOKENS + f", lem AS (SELECT doc_id, pos, coalesce(nullif({LEMMA}, ''), token) AS token FROM tok)"
_POSTED = "SELECT token AS term, doc_id, count(*)::INT AS tf, array_to_string(list(pos ORDER BY pos), ',') AS positions FROM {} GROUP BY 1, 2"


def _positions(index: Index) -> DataFrame:
    return index.postings.select("term", "doc_id", "tf", F.array_join("positions", ",").alias("positions"))


def _lemma_sql(text: str) -> str:
    """A search's SQL over lemmas instead of tokens."""
    return text.replace(sql.TOKENS, _LEM, 1).replace("FROM tok WHERE", "FROM lem WHERE")


@query(EXTRACTED)
def dump_walk(spark, sf_dir):
    """Dump files in folders below each other, walked and split into documents."""
    path = folder(spark, "dump")
    found = records(_docs(spark, sf_dir))
    # files of at most 1000 records, since one file is read as one row
    found.where("crc32(value) % 2 = 0").write.option("maxRecordsPerFile", 1000).text(f"{path}/a")
    found.where("crc32(value) % 2 = 1").write.option("maxRecordsPerFile", 1000).text(f"{path}/b/c")
    return dumps.split_documents(dumps.read_dump_files(spark, path)).select("doc_id", "link", "title", "text")


@query(f"WITH {sql.TOKENS} SELECT doc_id, pos, token FROM tok")
def token_sink(spark, sf_dir):
    """Tokens written by document and read back in order."""
    path = folder(spark, "tokens")
    sinks.write_tokens(tokenize(_docs(spark, sf_dir)), path)
    return spark.read.parquet(path).select("doc_id", F.posexplode("tokens").alias("pos", "token"))


@query("SELECT doc_id, 'https://example.org/' || doc_id AS link, 'T \"' || doc_id || '\" \\' || coalesce(lang, 'none') AS title, coalesce(source, 'none') || '/' || doc_id || '.txt' AS path FROM documents")
def meta_sink(spark, sf_dir):
    """Tab-separated metadata, quotation marks and backslashes included, written and read back."""
    path, d = folder(spark, "meta"), _docs(spark, sf_dir)
    title = F.concat(F.lit('T "'), "doc_id", F.lit('" \\'), F.coalesce("lang", F.lit("none")))
    meta = d.select("doc_id", F.concat(F.lit("https://example.org/"), "doc_id").alias("link"), title.alias("title"), F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), "doc_id", F.lit(".txt")).alias("path"))
    sinks.write_meta(meta, path)
    return dumps.read_meta(spark, path)


@query("SELECT doc_id, doc_id || '.txt' AS file, (doc_id || '.txt') LIKE '%7.txt' AS seven FROM documents")
def file_names(spark, sf_dir):
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/sub/"), "doc_id", F.lit(".txt"))
    return _docs(spark, sf_dir).select("doc_id", file_name(path).alias("file"), ends_with(path, "7.txt").alias("seven"))


@query(f"WITH {sql.TOKENS}, c AS (SELECT token, count(*) AS cnt FROM tok GROUP BY token) SELECT row_number() OVER (ORDER BY cnt, token) - 1 AS line, token FROM c")
def ordered_dictionary(spark, sf_dir):
    """The dictionary written a line each in its order, and read with line numbers."""
    path = folder(spark, "dictionary")
    sinks.write_lines(dic.dictionary(tokenize(_docs(spark, sf_dir))), "token", ["cnt", "token"], path)
    return dumps.read_numbered(spark, path, "token", "line")


@query(f"WITH {sql.TOKENS} SELECT DISTINCT token, {LEMMA} AS lemma, 0::BIGINT AS unpaired FROM tok")
def lemma_lists(spark, sf_dir):
    """Tokens and lemmas as two lists of lines, paired again; ``unpaired`` counts lines that one list lacks."""
    table, path = lemma_table(tokenize(_docs(spark, sf_dir))), folder(spark, "lists")
    for name in ("token", "lemma"):
        sinks.write_lines(table, name, ["token"], f"{path}/{name}")
    a, b = dumps.read_numbered(spark, f"{path}/token", "token", "line"), dumps.read_numbered(spark, f"{path}/lemma", "lemma", "line")
    return dumps.zip_lemmas(a, b).crossJoin(F.broadcast(dumps.unpaired(a, b).agg(F.count("*").alias("unpaired"))))


@query(f"WITH {_LEM} " + _POSTED.format("lem"))
def lemma_postings(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return _positions(build_index(d, lemma_table(tokenize(d))))


@query(f"WITH {sql.TOKENS}, v AS (SELECT token FROM tok GROUP BY token HAVING count(*) >= 2), known AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, coalesce(nullif({LEMMA}, ''), token) AS token FROM tok SEMI JOIN v USING (token)) " + _POSTED.format("known"))
def lemma_postings_known(spark, sf_dir):
    """Tokens that the dictionary lacks go, and the positions behind them move up."""
    d = _docs(spark, sf_dir)
    return _positions(build_index(d, lemma_table(tokenize(d), 2), drop_unknown=True))


@query(f"WITH {sql.TOKENS}, c AS (SELECT token, count(*) AS cnt FROM tok GROUP BY token), f AS (SELECT coalesce(nullif({LEMMA}, ''), token) AS term, min(struct_pack(cnt := cnt, token := token)) AS first FROM c GROUP BY 1) SELECT row_number() OVER (ORDER BY first) - 1 AS term_id, term FROM f")
def lemma_term_ids(spark, sf_dir):
    tokens = tokenize(_docs(spark, sf_dir))
    return dic.term_ids(dic.dictionary(tokens), lemma_table(tokens))


def stored_index(spark: SparkSession, sf_dir: str, lemmas: DataFrame | None = None) -> Index:
    """The index of the documents, written and loaded."""
    return save_index(build_index(_docs(spark, sf_dir), lemmas), folder(spark, "index"))


#: name -> query text and its tree; searched on a stored index of tokens.
STORED: dict[str, tuple[str, ast.Node]] = {
    "stored_symbols": ("the  &&\tof || de", Or(And(Term("the"), Term("of")), Term("de"))),
    "stored_not": ("!(the | en) | \"of the\"/6", Or(Not(Or(Term("the"), Term("en"))), Quote(("of", "the"), 6))),
    "stored_accents": ("THÉ & \"Of  THE\"", And(Term("the"), Quote(("of", "the")))),
}
for _name, (_text, _tree) in STORED.items():
    QUERIES[_name] = lambda spark, sf_dir, text=_text: _shown(search.search(stored_index(spark, sf_dir), text))
    ORACLE[_name] = sql.Sql(_tree).ranked(search.MAX_RESULTS)


@query(_POSTED.format("tok WHERE token IN ('the', 'en')").replace("SELECT", f"WITH {sql.TOKENS} SELECT", 1))
def stored_postings(spark, sf_dir):
    """Two terms' postings out of a stored index."""
    return stored_index(spark, sf_dir).select(["the", "en"]).withColumn("positions", F.array_join("positions", ","))


#: Searches over lemmas: query text and tree.
LEMMATISED: dict[str, tuple[str, ast.Node]] = {
    "lemma_boolean": ("(Dès | les) & !\"ofs THE\" /4", And(Or(Term("de"), Term("le")), Not(Quote(("of", "the"), 4)))),
    "lemma_quote": ("\"les des\" /9 | thes", Or(Quote(("le", "de"), 9), Term("the"))),
}


def _lemma_search(spark, sf_dir: str, text: str) -> DataFrame:
    """The lemma table has the corpus's tokens and the plurals that the queries use."""
    own = spark.createDataFrame([("ofs", "of"), ("thes", "the"), ("les", "le"), ("des", "de")], "token string, lemma string")
    table = lemma_table(tokenize(_docs(spark, sf_dir))).unionByName(own).distinct()
    return _shown(search.search(stored_index(spark, sf_dir, table), text, search.lemmas_of(table, text)))


for _name, (_text, _tree) in LEMMATISED.items():
    QUERIES[_name] = lambda spark, sf_dir, text=_text: _lemma_search(spark, sf_dir, text)
    ORACLE[_name] = _lemma_sql(sql.Sql(_tree).ranked(search.MAX_RESULTS))


@query(sql.cascade({2: Quote(("of", "the")), 1: And(Term("of"), Term("the")), 0: Or(Term("of"), Term("the"))}, search.MAX_RESULTS))
def free_text_unknown(spark, sf_dir):
    """Free text without its unknown words."""
    return _shown(search.search(stored_index(spark, sf_dir), "zzzzqqqq OF yyyyqqqq the"))


@query(sql.Sql(Or(Not(Term("en")), And(Term("of"), Term("the")))).ranked(search.MAX_RESULTS))
def postfix_search(spark, sf_dir):
    """A query given as a postfix list; the operand on top comes first."""
    return _shown(search.ranked(build_index(_docs(spark, sf_dir)), parser.postfix(["the", "of", "&", "en", "!", "|"])))


@query(sql.snippets("SELECT 0 AS rank_pos, doc_id, text FROM documents", ["of", "the", "de"]).replace("SELECT rank_pos, doc_id, coalesce", "SELECT doc_id, coalesce"))
def snippets(spark, sf_dir):
    """Snippets of all documents, those without a hit included."""
    ship(spark)
    return _docs(spark, sf_dir).select("doc_id", snippet_column(F.col("text"), ["of", "the", "de"]).alias("snippet"))


#: Query text -> what the parser says: boolean, words, postfix list or words, error.
REPORTS: dict[str, tuple] = {
    "a b": (False, 2, "a b", None),
    "a  &&  b": (True, 2, "a b &", None),
    "a||b": (True, 2, "a b |", None),
    "a b|c": (True, 3, "a b & c |", None),
    "!a b": (True, 2, "a ! b &", None),
    "(a)(b)": (True, 2, "a b &", None),
    'a"b': (True, 1, 'a"b', None),
    '"x & y" /5 z': (True, 3, '"x y /5" z &', None),
    "it's-a & b.c": (True, 2, "it's-a b.c &", None),
    "a &": (None, None, None, "an operand is missing"),
    "(a": (None, None, None, "a parenthesis is open"),
    "a)": (None, None, None, "a parenthesis is not open"),
    " ": (None, None, None, "the query is empty"),
    "x" * 1000: (False, 1, "x" * 1000, None),
    "x" * 1001: (None, None, None, "the query has over 1000 characters"),
    " ".join("a" * 20): (False, 20, " ".join("a" * 20), None),
    " ".join("a" * 21): (None, None, None, "the query has over 20 words"),
    '"' + " ".join("a" * 19) + '" | b & c': (None, None, None, "the query has over 20 words"),
}


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, (bool, int)) else sql._lit(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) v({names})"


@query(_values([(t, *r) for t, r in REPORTS.items()], "query, is_boolean, words, shape, problem"))
def parsed_queries(spark, sf_dir):
    """What the parser makes of query texts."""
    return spark.createDataFrame([(t, *parser.report(t)) for t in REPORTS], "query string, is_boolean boolean, words int, shape string, problem string")


_PAGERS = [(0, i, str(i + 1), f"/search?text=a %26 b %7C c&p={i}") for i in range(5)] + [(7, i, str(i + 1), f"/search?text=a %26 b %7C c&p={i}") for i in range(5, 10)]


@query(_values(_PAGERS, "page, button, label, link"))
def pager_links(spark, sf_dir):
    rows = [(page, int(label) - 1, label, link) for page in (0, 7) for label, link in search.pager("a & b | c", page)]
    return spark.createDataFrame(rows, "page int, button int, label string, link string")


@query(_values([("the & !\"Of Thé\" /4", "the of"), ("Ünder the", "under the")], "query, marked"))
def marked_words(spark, sf_dir):
    """The terms that a result page marks."""
    texts = ("the & !\"Of Thé\" /4", "Ünder the")
    return spark.createDataFrame([(t, " ".join(dict.fromkeys(search.query_words(t)))) for t in texts], "query string, marked string")


@query(f"SELECT rank_pos, doc_id FROM ({sql.cascade({2: Quote(('of', 'the')), 1: And(Term('of'), Term('the')), 0: Or(Term('of'), Term('the'))}, search.MAX_RESULTS)}) WHERE rank_pos BETWEEN 251 AND 300")
def service_page(spark, sf_dir):
    """A page of a service that keeps its cursors: the sixth, asked for after the first and again."""
    from corpusloom.plans.service import Searcher

    d = _docs(spark, sf_dir)
    s = Searcher(stored_index(spark, sf_dir), d)
    s.page("of the")
    ids = s.page("of the", 5)
    assert ids == s.page("of the", 5)
    return spark.createDataFrame([(251 + i, x, None, None) for i, x in enumerate(ids)], RESULTS).select("rank_pos", "doc_id")
