"""Expressions to columns.

A query becomes one aggregation: the postings of its terms, pivoted to a row for
each document with the terms' frequencies, over which match and rank are plain
columns.  A quote is counted in the same aggregation, so its positions go no
further than there.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.weights import tf_weight, tfidf
from corpusloom.operators.postings import Index
from corpusloom.plans import ast

#: 0.05 and its complement as 32-bit floats.
QUOTE_A = float(np.float32(0.05))
QUOTE_B = float(np.float32(1) - np.float32(0.05))


def quotes(*nodes: ast.Node) -> list[ast.Quote]:
    """Distinct quotes in the order of first appearance."""
    out: list[ast.Quote] = []
    for node in nodes:
        match node:
            case ast.Quote():
                out.append(node)
            case ast.Not(c):
                out += quotes(c)
            case ast.And(a, b) | ast.Or(a, b):
                out += quotes(a, b)
    return list(dict.fromkeys(out))


def _shifted(positions: Column, times: int, by: int) -> Column:
    return F.transform(positions, lambda x: x.cast("long") * times + by)


def chains(dist: int, positions: list[Column]) -> Column:
    """Starts of the first term from which the greedy chain of next positions ends within the distance.

    All positions are merged once and read from the last to the first.  ``e_k``
    is the end of the chain that begins with the next position of term k; at
    equal positions earlier terms come first, as a chain goes strictly forward.
    """
    m = len(positions)
    events = F.sort_array(F.flatten(F.array(*(_shifted(p, m, m - 1 - k) for k, p in enumerate(positions)))), asc=False)
    start = F.struct(F.lit(0).alias("c"), *(F.lit(None).cast("long").alias(f"e_{k}") for k in range(1, m)))

    def step(state: Column, event: Column) -> Column:
        at, k = F.floor(event / m), m - 1 - event % m
        ends = [F.when(k == i, at if i == m - 1 else state[f"e_{i + 1}"]).otherwise(state[f"e_{i}"]).alias(f"e_{i}") for i in range(1, m)]
        near = F.coalesce(state["e_1"] - at + 1 <= dist, F.lit(False))
        return F.struct((state["c"] + F.when((k == 0) & near, 1).otherwise(0)).alias("c"), *ends)

    return F.aggregate(events, start, step, lambda state: state["c"])


def adjacent(positions: list[Column]) -> Column:
    """Starts of the first term that the others follow one by one."""
    first, *rest = [p.cast("array<long>") for p in positions]
    for k, p in enumerate(rest, 1):
        first = F.array_intersect(first, _shifted(p, 1, -k))
    return F.size(first)


def pivot(index: Index, node: ast.Node, universe: bool | None = None, counted: tuple[ast.Node, ...] = ()) -> DataFrame:
    """doc_id, tf_0.., q_0..: every document that can match, its terms' frequencies and the chains of the quotes in ``counted`` (``node``)."""
    names = ast.terms(node)
    hits = index.select(names)
    own = {t: F.col("term") == F.lit(t) for t in names}
    columns = [F.max(F.when(own[t], F.col("tf"))).alias(f"tf_{i}") for i, t in enumerate(names)]
    for i, q in enumerate(quotes(*(counted or (node,)))):
        # any_value: a term has one row a document
        places = [F.any_value(F.when(own[t], F.col("positions")), ignoreNulls=True) for t in q.terms]
        every = F.count(F.when(F.col("term").isin(*set(q.terms)), 1)) == len(set(q.terms))
        count = adjacent(places) if q.dist == len(q.terms) else chains(q.dist, places)
        columns.append(F.when(every, count).otherwise(0).alias(f"q_{i}"))
    found = hits.groupBy("doc_id").agg(*columns)
    if universe if universe is not None else not ast.positive(node):
        return index.docs.join(found, "doc_id", "left")
    return found


class Compiler:
    """match and rank of nodes over the columns of ``pivot``."""

    def __init__(self, node: ast.Node, df: dict[str, int], n_docs: int, scoring: str = "tf", counted: tuple[ast.Node, ...] = ()):
        self.at = {t: i for i, t in enumerate(ast.terms(node))}
        self.quotes = {q: i for i, q in enumerate(quotes(*(counted or (node,))))}
        self.df, self.n, self.scoring = df, n_docs, scoring

    def tf(self, term: str) -> Column:
        return F.col(f"tf_{self.at[term]}")

    def weight(self, term: str) -> Column:
        return tf_weight(self.tf(term)) if self.scoring == "tf" else tfidf(self.tf(term), self.df.get(term, 0), self.n)

    def chains(self, q: ast.Quote) -> Column:
        """0 for a document without any of the terms, which only the universe has."""
        return F.coalesce(F.col(f"q_{self.quotes[q]}"), F.lit(0))

    def match(self, node: ast.Node) -> Column:
        match node:
            case ast.Term(t):
                return self.tf(t).isNotNull()
            case ast.Quote():
                return self.chains(node) > 0
            case ast.Not(c):
                return ~self.match(c)
            case ast.And(a, b):
                return self.match(a) & self.match(b)
        return self.match(node.left) | self.match(node.right)

    def rank(self, node: ast.Node) -> Column:
        """Rank as a 32-bit float, rounded at every node."""
        match node:
            case ast.Term(t):
                return self.weight(t)
            case ast.Not(c):
                n = ast.estimate(c, self.df, self.n)
                return F.lit(10 * float(np.float32(math.log(self.n / n))) if n and self.n else 0.0).cast("float")
            case ast.And(a, b):
                return (self.rank(a) + self.rank(b)).cast("float")
            case ast.Or(a, b):
                ra, rb = self.rank(a), self.rank(b)
                return F.when(self.match(a) & self.match(b), (ra + rb).cast("float")).when(self.match(a), ra).otherwise(rb)
        first, *rest = dict.fromkeys(node.terms)
        total = self.weight(first)
        for t in rest:
            total = (total + self.weight(t)).cast("float")
        k = len(node.terms)
        place = F.ln(1 + F.floor(self.chains(node) * k * k * 10 / F.lit(node.dist)))
        text = F.ln(1 + total.cast("double")).cast("float").cast("double")
        return ((QUOTE_A * text).cast("float").cast("double") + QUOTE_B * place).cast("float")


def matched(index: Index, node: ast.Node, df: dict[str, int], n_docs: int, scoring: str = "tf") -> DataFrame:
    """doc_id, rank of every document that matches."""
    c = Compiler(node, df, n_docs, scoring)
    return pivot(index, node).where(c.match(node)).select("doc_id", c.rank(node).alias("rank"))
