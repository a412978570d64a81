"""Searching: binding, ranking, the fallback cascade, pages, stored documents."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.snippets import snippet_column
from corpusloom.functions.text import normalize_word
from corpusloom.operators.postings import Index
from corpusloom.plans import ast
from corpusloom.plans.compile import Compiler, matched, pivot
from corpusloom.plans.parser import parse
from corpusloom.schemas import RESULTS
from corpusloom.ship import ship

MAX_RESULTS, PAGE = 500, 50


def frequencies(index: Index, terms: list[str]) -> dict[str, int]:
    """df of the terms that the index has; at most as many rows as the query has words."""
    return {r["term"]: r["df"] for r in index.terms.where(F.col("term").isin(*terms)).select("term", "df").collect()}


def _top(found: DataFrame, n: int) -> DataFrame:
    return found.orderBy(F.desc("rank"), F.desc("doc_id")).limit(n)


def _numbered(found: DataFrame, stage: int = 0) -> DataFrame:
    """rank_pos from 1; the rows are few, so one task may number them."""
    w = Window.orderBy(F.desc("rank"), F.desc("doc_id"))
    return found.select(F.row_number().over(w).alias("rank_pos"), F.col("doc_id").cast("long"), "rank", F.lit(stage).alias("stage"))


def match_set(index: Index, node: ast.Node, n_docs: int | None = None) -> DataFrame:
    """doc_id of every match, without a cap."""
    node = ast.simplify(node)
    return pivot(index, node).where(Compiler(node, {}, 0).match(node)).select("doc_id")


def ranked(index: Index, node: ast.Node, max_results: int = MAX_RESULTS, scoring: str = "tf") -> DataFrame:
    """rank_pos, doc_id, rank, stage of the best matches; larger doc_ids first on ties."""
    node = ast.simplify(node)
    needs_n = not ast.positive(node) or _has_not(node) or scoring != "tf"
    n = index.docs.count() if needs_n else 0
    df = frequencies(index, ast.terms(node)) if needs_n else {}
    return _numbered(_top(matched(index, node, df, n, scoring), max_results))


def _has_not(node: ast.Node) -> bool:
    match node:
        case ast.Not():
            return True
        case ast.And(a, b) | ast.Or(a, b):
            return _has_not(a) or _has_not(b)
    return False


def stage_query(terms: list[str], k: int) -> ast.Node:
    """Stage k of the cascade: all runs of k words as phrases, all words (1), any word (0)."""
    if k > 1:
        return ast.all_of(ast.Quote(tuple(terms[i : i + k])) for i in range(len(terms) - k + 1))
    return (ast.all_of if k else ast.any_of)(ast.Term(t) for t in terms)


def stages(index: Index, terms: list[str], max_results: int = MAX_RESULTS) -> Iterator[list[tuple[int, float, int]]]:
    """Results (doc_id, rank, stage) of one stage after the other, each only when asked for.

    A stage leaves out what earlier stages gave; documents that a cap cut off
    come back in the next.  At most ``max_results`` rows a stage reach the driver.
    """
    if len(terms) == 1:
        yield [(r["doc_id"], r["rank"], 1) for r in _top(matched(index, ast.Term(terms[0]), {}, 0), max_results).collect()]
        return
    whole = stage_query(terms, len(terms))
    every = tuple(stage_query(terms, k) for k in range(len(terms), 1, -1))
    base = pivot(index, whole, universe=False, counted=every).persist()
    c = Compiler(whole, {}, 0, counted=every)
    used: list[int] = []
    try:
        for k in range(len(terms), -1, -1):
            node = stage_query(terms, k)
            found = base.where(c.match(node)).select("doc_id", c.rank(node).alias("rank"))
            if used:
                given = index.docs.sparkSession.createDataFrame([(d,) for d in used], "doc_id long")
                found = found.join(F.broadcast(given), "doc_id", "left_anti")  # at most max_results a stage
            rows = [(r["doc_id"], r["rank"], k) for r in _top(found, max_results).collect()]
            used += [r[0] for r in rows]
            if rows:
                yield rows
    finally:
        base.unpersist()


def cascade(index: Index, terms: list[str], max_results: int = MAX_RESULTS, enough: int | None = None) -> DataFrame:
    """All stages' results in order, or the first ``enough``."""
    rows: list[tuple[int, float, int]] = []
    for stage in stages(index, terms, max_results):
        rows += stage
        if enough is not None and len(rows) >= enough:
            break
    spark = index.docs.sparkSession
    return spark.createDataFrame([(i + 1, d, r, k) for i, (d, r, k) in enumerate(rows[:enough])], RESULTS)


def bind(node: ast.Node, known: set[str], lemmas: dict[str, str] | None) -> ast.Node | None:
    """The tree with terms for words; None if any of them is unknown."""
    match node:
        case ast.Term(t):
            t = normalize_word(t, lemmas)
            return ast.Term(t) if t in known else None
        case ast.Quote(ts, d):
            ts = tuple(normalize_word(t, lemmas) for t in ts)
            return ast.Quote(ts, d) if set(ts) <= known else None
        case ast.Not(c):
            c = bind(c, known, lemmas)
            return ast.Not(c) if c else None
    a, b = bind(node.left, known, lemmas), bind(node.right, known, lemmas)
    return type(node)(a, b) if a and b else None


def lemmas_of(lemmas: DataFrame, text: str) -> dict[str, str]:
    """The lemmas of a query's own words out of a table (token, lemma); the table itself stays where it is."""
    query = parse(text)
    words = {normalize_word(w) for w in (ast.terms(query.tree) if query.boolean else query.terms)}
    return {r["token"]: r["lemma"] for r in lemmas.where(F.col("token").isin(*words)).select("token", "lemma").collect()}


def search(index: Index, text: str, lemmas: dict[str, str] | None = None, max_results: int = MAX_RESULTS, enough: int | None = None) -> DataFrame:
    """Results of a query text.

    An unknown word empties a boolean query, wherever it stands, and is left
    out of a free-text one.
    """
    query = parse(text)
    words = ast.terms(query.tree) if query.boolean else query.terms
    known = set(frequencies(index, sorted({normalize_word(w, lemmas) for w in words})))
    empty = index.docs.sparkSession.createDataFrame([], RESULTS)
    if query.boolean:
        tree = bind(query.tree, known, lemmas)
        return ranked(index, tree, max_results) if tree else empty
    terms = [t for t in (normalize_word(w, lemmas) for w in words) if t in known]
    return cascade(index, terms, max_results, enough) if terms else empty


def page(results: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    """Page ``number`` from 0; empty beyond the end."""
    return results.where(F.col("rank_pos").between(number * size + 1, (number + 1) * size))


def pager(text: str, number: int, shown: int = 5) -> list[tuple[str, str]]:
    """Label and link of the pages around ``number``."""
    start, text = max(0, number - shown // 2), text.replace("&", "%26").replace("|", "%7C")
    return [(str(i + 1), f"/search?text={text}&p={i}") for i in range(start, start + shown)]


def query_words(text: str, lemmas: dict[str, str] | None = None) -> list[str]:
    """Terms to highlight."""
    query = parse(text)
    return [normalize_word(w, lemmas) for w in (ast.terms(query.tree) if query.boolean else query.terms)]


def results_view(index: Index, docs: DataFrame, text: str, number: int = 0, lemmas: dict[str, str] | None = None, meta: DataFrame | None = None) -> DataFrame:
    """A result page: rank_pos, doc_id, [link, title,] snippet.  At most a page of texts is read through to the snippets."""
    ship(docs.sparkSession)
    found = F.broadcast(page(search(index, text, lemmas, enough=(number + 1) * PAGE), number))  # a page of rows
    out = docs.select("doc_id", "text").join(found, "doc_id")
    if meta is not None:
        out = out.join(meta.select("doc_id", "link", "title"), "doc_id", "left")
    names = ["rank_pos", "doc_id", *(["link", "title"] if meta is not None else [])]
    return out.select(*names, snippet_column(F.col("text"), query_words(text, lemmas), lemmas).alias("snippet"))


def archive(docs: DataFrame, doc_id) -> DataFrame:
    """The stored text of a document; no row for an unknown or malformed id."""
    try:
        return docs.where(F.col("doc_id") == int(doc_id)).select("doc_id", "text")
    except (TypeError, ValueError):
        return docs.limit(0).select("doc_id", "text")
