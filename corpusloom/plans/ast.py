"""Query expressions."""

from __future__ import annotations

from dataclasses import dataclass


class QueryError(ValueError):
    """A query that cannot be run."""


@dataclass(frozen=True)
class Term:
    term: str


@dataclass(frozen=True)
class Not:
    child: Node


@dataclass(frozen=True)
class And:
    left: Node
    right: Node


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node


@dataclass(frozen=True)
class Quote:
    """Terms in this order within ``dist`` places; ``dist`` equal to their number: an exact phrase."""

    terms: tuple[str, ...]
    dist: int = 0

    def __post_init__(self):
        if not self.terms:
            raise QueryError("a quote needs a word")
        object.__setattr__(self, "dist", max(self.dist, len(self.terms)))


Node = Term | Not | And | Or | Quote


def all_of(nodes) -> Node:
    """Left-deep AND."""
    first, *rest = nodes
    for n in rest:
        first = And(first, n)
    return first


def any_of(nodes) -> Node:
    first, *rest = nodes
    for n in rest:
        first = Or(first, n)
    return first


def simplify(node: Node) -> Node:
    """A quote of one word is the word."""
    match node:
        case Quote(terms) if len(terms) == 1:
            return Term(terms[0])
        case Not(c):
            return Not(simplify(c))
        case And(a, b):
            return And(simplify(a), simplify(b))
        case Or(a, b):
            return Or(simplify(a), simplify(b))
    return node


def terms(node: Node) -> list[str]:
    """Distinct terms in the order of first appearance."""
    match node:
        case Term(t):
            return [t]
        case Quote(ts):
            return list(dict.fromkeys(ts))
        case Not(c):
            return terms(c)
    return list(dict.fromkeys(terms(node.left) + terms(node.right)))


def positive(node: Node) -> bool:
    """Whether no document without any of the terms can match."""
    match node:
        case Not():
            return False
        case And(a, b):
            return positive(a) or positive(b)
        case Or(a, b):
            return positive(a) and positive(b)
    return True


def estimate(node: Node, df: dict[str, int], n: int) -> int:
    """Estimated number of matches; it feeds the rank of NOT."""
    match node:
        case Term(t):
            return df.get(t, 0)
        case Quote(ts):
            return min(df.get(t, 0) for t in ts)
        case Not(c):
            return n - estimate(c, df, n)
        case And(a, b):
            return min(estimate(a, df, n), estimate(b, df, n))
        case Or(a, b):
            return min(estimate(a, df, n) + estimate(b, df, n), n)
