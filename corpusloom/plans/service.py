"""A searcher that keeps the results of queries it has run, as a service would."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.snippets import snippet_column
from corpusloom.functions.text import normalize_word
from corpusloom.operators.postings import Index
from corpusloom.plans import ast, search
from corpusloom.plans.parser import parse


class Searcher:
    """Pages of results by query; equal queries share a cursor.

    A boolean query runs once.  A free-text query runs its next stage when a
    page needs it.  ``kept`` queries stay, the least recently used go first.
    """

    def __init__(self, index: Index, docs: DataFrame, lemmas: dict[str, str] | None = None, meta: DataFrame | None = None, kept: int = 1000):
        self.index, self.docs, self.lemmas, self.meta, self.kept = index, docs, lemmas, meta, kept
        self._cursors: OrderedDict[object, tuple[list[int], Iterator[list[int]]]] = OrderedDict()

    def _start(self, key) -> Iterator[list[int]]:
        if isinstance(key, tuple):
            return ([d for d, _, _ in rows] for rows in search.stages(self.index, list(key)))
        found = search.ranked(self.index, key).orderBy("rank_pos").collect()
        return iter([[r["doc_id"] for r in found]])

    def _key(self, text: str):
        """The query with terms for words: a tree, a tuple of terms, or None if it has no results."""
        query = parse(text)
        words = ast.terms(query.tree) if query.boolean else query.terms
        known = set(search.frequencies(self.index, sorted({normalize_word(w, self.lemmas) for w in words})))
        if query.boolean:
            return search.bind(query.tree, known, self.lemmas)
        return tuple(t for t in (normalize_word(w, self.lemmas) for w in words) if t in known) or None

    def page(self, text: str, number: int = 0) -> list[int]:
        """doc_ids of page ``number`` from 0, best first; none beyond the end."""
        key = self._key(text)
        if key is None:
            return []
        if key not in self._cursors:
            self._cursors[key] = ([], self._start(key))
        self._cursors.move_to_end(key)
        if len(self._cursors) > self.kept:
            self._cursors.popitem(last=False)
        found, more = self._cursors[key]
        while len(found) < (number + 1) * search.PAGE:
            rows = next(more, None)
            if rows is None:
                break
            found += rows
        return found[number * search.PAGE : (number + 1) * search.PAGE]

    def view(self, text: str, number: int = 0) -> list[dict]:
        """The page's rows with doc_id, [link, title,] snippet."""
        ids = self.page(text, number)
        rows = self.docs.where(F.col("doc_id").isin(*ids)).select("doc_id", "text") if ids else None
        if rows is None:
            return []
        if self.meta is not None:
            rows = rows.join(self.meta.select("doc_id", "link", "title"), "doc_id", "left")
        shown = rows.withColumn("snippet", snippet_column(F.col("text"), search.query_words(text, self.lemmas), self.lemmas)).drop("text").collect()
        by = {r["doc_id"]: r.asDict() for r in shown}
        return [by[i] for i in ids if i in by]
