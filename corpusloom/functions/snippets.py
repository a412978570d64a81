"""Snippets: the shortest stretch of a text with all query words that it has, and context around it."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions.text import normalize_word

LIMIT, FIRST, STEP, HEAD = 300, 1, 5, 50
_SEGMENT = re.compile(r"[^\W_]+|[\W_]", re.S)


def shortest_window(hits: list[tuple[int, str]]) -> tuple[int, int]:
    """First and last segment of the shortest run of hits that has every word; the earliest of equals."""
    latest: dict[str, int] = {}
    words = {w for _, w in hits}
    best: tuple[int, int, int] | None = None
    for at, word in hits:
        latest[word] = at
        if len(latest) == len(words):
            start = min(latest.values())
            if best is None or at - start < best[0]:
                best = (at - start, start, at)
    return best[1], best[2]


def snippet(text: str, words: list[str], term_of: Callable[[str], str] = normalize_word, limit: int = LIMIT) -> str:
    """At most ``limit`` characters around the shortest window; the first ``HEAD`` segments if no word occurs or nothing fits.

    The context grows by ``STEP`` segments at a time.  The whole window is
    preferred; if it is too long, each hit keeps that much context after it and
    dots stand for the rest.
    """
    segments = _SEGMENT.findall(text.replace("\n", " "))
    wanted, term = set(words), lru_cache(None)(term_of)
    terms = [term(s) if s[0].isalnum() else "" for s in segments]
    hits = [(i, t) for i, t in enumerate(terms) if t and t in wanted]
    head = " ".join([*segments[:HEAD], "..."])
    if not hits:
        return head
    left, right = shortest_window(hits)
    best, around = "", FIRST
    while True:
        a, z = max(left - around, 0), min(right + around + 1, len(segments))
        before, after = "..." if left - around > 0 else "", "..." if right + around + 1 < len(segments) else ""
        full = before + "".join(segments[a:z]) + after
        parts, room = [before], around
        for i in range(a, z):
            if terms[i] in wanted:
                room = around
                parts.append(segments[i])
            elif room > 0:
                room -= 1
                parts.append(segments[i] + ("" if room else "..."))
        cut = "".join(parts)
        if len(full) <= limit:
            best = full
        elif len(cut) <= limit:
            best = cut
        if len(cut) >= min(limit, len(text)) or a == 0 and z == len(segments):
            return best or head
        around += STEP


def snippet_column(text: Column, words: list[str], lemmas: dict[str, str] | None = None) -> Column:
    """``snippet`` of a column; meant for the rows of one page."""
    own = dict(lemmas or {})

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet(t or "", words, lambda w: normalize_word(w, own)))

    return run(text)
