"""Accent folding, tokens and lemmas as columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.ship import ship

WORD = r"[\p{L}\p{N}]+"


def fold(text: str) -> str:
    """NFKD without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _table() -> tuple[str, str]:
    """All characters that fold to one other character, by rule, and what they fold to.

    ``translate`` works on UTF-16 units here, so characters beyond the first plane are left out.
    """
    pairs = [(c, f) for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x10000))) if not unicodedata.combining(c) and len(f := fold(c)) == 1 and f != c and f < "\U00010000"]
    return "".join(c for c, _ in pairs), "".join(f for _, f in pairs)


_FROM, _TO = _table()


def _ranges(codes: list[int]) -> str:
    """A character class of ascending code points."""
    out, start, last = "", None, None
    for c in [*codes, None]:
        if last is not None and c != last + 1:
            out += f"\\x{{{start:x}}}" + (f"-\\x{{{last:x}}}" if last > start else "")
            start = None
        start, last = c if start is None else start, c
    return out


#: Combining marks, which folding drops, and characters whose folding is longer than one or lies beyond ``translate``.
_MARKS = r"(?=[\p{M}\p{Cn}])[" + _ranges([i for i in range(0x80, 0x110000) if unicodedata.combining(chr(i))]) + "]"
_RARE = r"(?=[^\x00-\x{b7}\x{bf}-\x{131}\x{150}-\x{1bf}\x{1d0}-\x{1ef}\x{400}-\x{52f}])[" + _ranges([i for i in range(0x80, 0x110000) if not 0xD800 <= i < 0xE000 and not unicodedata.combining(chr(i)) and (len(fold(chr(i))) != 1 or (i > 0xFFFF and fold(chr(i)) != chr(i)) or fold(chr(i)) > "\uffff" and i <= 0xFFFF)]) + "]"


@F.pandas_udf(StringType())
def _exact(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fold(t))


def fold_fast(text: Column) -> Column:
    """``fold`` of texts without ``_RARE`` characters, inside the JVM; pure ASCII is left as it is."""
    bare = F.when(text.rlike(r"[^\x00-\x{2ff}]"), F.regexp_replace(text, _MARKS, "")).otherwise(text)
    folded = F.translate(bare, _FROM, _TO)
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(folded)


def fold_accents(text: Column) -> Column:
    """``fold`` as a column.  Only texts with rare characters reach the Python worker; the others stay in the JVM."""
    return F.coalesce(_exact(F.when(text.rlike(_RARE), text)), fold_fast(text))


def _words(folded: Column) -> Column:
    """Lower case comes before the match, in one go, but for a capital sigma, whose form depends on the word's end."""
    runs = lambda x: F.regexp_extract_all(x, F.lit(WORD), F.lit(0))
    return F.when(F.contains(folded, F.lit("\u03a3")), F.transform(runs(folded), F.lower)).otherwise(runs(F.lower(folded)))


def tokens_of(text: Column) -> Column:
    """Array of lower-cased maximal runs of letters and digits of the folded text; null for null."""
    return _words(fold_accents(text))


def token_lists(docs: DataFrame) -> DataFrame:
    """doc_id, t (its tokens) of every document.

    The rare texts are a branch of their own, so that the plan of the others
    has no Python in it; a text is looked at once to tell them apart.
    """
    ship(docs.sparkSession)
    rare = F.coalesce(F.octet_length("text") != F.char_length("text"), F.lit(False)) & F.coalesce(F.col("text").rlike(_RARE), F.lit(False))
    plain = docs.where(~rare).select("doc_id", _words(fold_fast(F.col("text"))).alias("t"))
    return plain.unionByName(docs.where(rare).select("doc_id", _words(_exact(F.col("text"))).alias("t")))


def tokenize(docs: DataFrame) -> DataFrame:
    """doc_id, pos, token of every document; documents without a token have no row."""
    # the outer form, since Spark would else repeat the tokens' expression in a filter below it
    return token_lists(docs).select("doc_id", F.posexplode_outer("t").alias("pos", "token")).where("token IS NOT NULL")


def lemmatize(tokens: DataFrame, lemmas: DataFrame | None = None, drop_unknown: bool = False) -> DataFrame:
    """doc_id, pos, term.

    ``lemmas`` maps token to lemma; without it a token is its own term.  A token
    that the map lacks keeps its own form, or, with ``drop_unknown``, goes, and
    the positions behind it move up.
    """
    if lemmas is None:
        return tokens.withColumnRenamed("token", "term")
    lemma = F.coalesce(F.nullif("lemma", F.lit("")), "token").alias("term")
    if not drop_unknown:
        return tokens.join(lemmas, "token", "left").select("doc_id", "pos", lemma)
    kept = tokens.join(lemmas, "token").select("doc_id", "pos", lemma)
    by_doc = kept.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("t"))
    return by_doc.select("doc_id", F.posexplode("t").alias("pos", "term"))


def normalize_word(word: str, lemmas: dict[str, str] | None = None) -> str:
    """A query word as a term."""
    token = fold(word).lower()
    return (lemmas or {}).get(token) or token


def ends_with(text: Column, suffix: str) -> Column:
    return F.endswith(text, F.lit(suffix))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)
