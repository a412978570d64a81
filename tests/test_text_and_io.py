"""Tokens, dictionary, postings, codes, reading and writing."""

import math
import re
import unicodedata
from collections import Counter, defaultdict

import pytest
from corpusloom.functions import codecs, text
from corpusloom.operators import dictionary, postings
from corpusloom.sources import dumps, sinks
from pyspark.sql import functions as F


def brute_tokens(t):
    folded, out, word = text.fold(t), [], ""
    for c in folded + " ":
        if c.isalnum():
            word += c
        elif word:
            out.append(word.lower())
            word = ""
    return out


TEXTS = ["Éa-b_C3 ½ ﬁ ß й", "", "a b c a", None, "  x\ty\n", "Ŀŀ ĳ ª² Ñandú", "日本 ёж İ", "C" * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_tokens(docs):
    got = defaultdict(list)
    for r in text.tokenize(docs).orderBy("doc_id", "pos").collect():
        assert r["pos"] == len(got[r["doc_id"]])
        got[r["doc_id"]].append(r["token"])
    assert {i: brute_tokens(t or "") for i, t in enumerate(TEXTS) if brute_tokens(t or "")} == dict(got)
    assert got[0] == ["ea", "b", "c3", "1", "2", "fi", "ß", "и"]


def test_fold_agrees_with_the_definition(spark):
    cps = [chr(i) for i in range(32, 0x2FF)]
    out = spark.createDataFrame([(c,) for c in cps], "c string").select("c", text.fold_accents(F.col("c")).alias("f")).collect()
    for r in out:
        assert r["f"] == "".join(x for x in unicodedata.normalize("NFKD", r["c"]) if not unicodedata.combining(x))


def test_lemmas_and_dropped_tokens(spark):
    docs = spark.createDataFrame([(1, "Cats saw cat dogs"), (2, "dogs")], "doc_id long, text string")
    lemmas = spark.createDataFrame([("cats", "cat"), ("cat", "cat"), ("dogs", "dog"), ("saw", "")], "token string, lemma string")
    terms = {(r["doc_id"], r["pos"]): r["term"] for r in text.lemmatize(text.tokenize(docs), lemmas).collect()}
    assert terms == {(1, 0): "cat", (1, 1): "saw", (1, 2): "cat", (1, 3): "dog", (2, 0): "dog"}
    kept = {(r["doc_id"], r["pos"]): r["term"] for r in text.lemmatize(text.tokenize(docs), lemmas.where("token <> 'saw'"), True).collect()}
    assert kept == {(1, 0): "cat", (1, 1): "cat", (1, 2): "dog", (2, 0): "dog"}
    assert text.normalize_word("Cáts", {"cats": "cat"}) == "cat" and text.normalize_word("Zoo") == "zoo"


def test_dictionary_and_term_ids(spark, docs):
    counts = Counter(t for x in TEXTS for t in brute_tokens(x or ""))
    d = dictionary.dictionary(text.tokenize(docs))
    want = sorted(counts.items(), key=lambda kv: (kv[1], kv[0].encode()))
    assert [(r["token"], r["cnt"]) for r in dictionary.ordered(d).collect()] == want
    assert {r["term"]: r["term_id"] for r in dictionary.term_ids(d).collect()} == {t: i for i, (t, _) in enumerate(want)}
    lemmas = spark.createDataFrame([("c", "a")], "token string, lemma string")
    ids = {r["term"]: r["term_id"] for r in dictionary.term_ids(d, lemmas).collect()}
    assert "c" not in ids and sorted(ids.values()) == list(range(len(ids)))


def test_postings_round_trip(spark, docs, tmp_path):
    want = defaultdict(list)
    for i, t in enumerate(TEXTS):
        for pos, w in enumerate(brute_tokens(t or "")):
            want[w, i].append(pos)
    built = postings.build_index(docs)
    stored = postings.save_index(built, str(tmp_path / "index"))
    for index in (built, stored):
        got = {(r["term"], r["doc_id"]): (r["tf"], r["positions"]) for r in index.postings.collect()}
        assert got == {k: (len(v), v) for k, v in want.items()}
        assert {r["doc_id"] for r in index.select(["a", "zz"]).collect()} == {d for t, d in want if t == "a"}
        assert {(r["term"], r["df"], r["cf"]) for r in index.terms.collect()} == {(t, sum(k[0] == t for k in want), sum(len(v) for k, v in want.items() if k[0] == t)) for t, _ in want}
        assert index.docs.count() == len(TEXTS)
    plan = stored.select(["a"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull" in plan or "bucket" in plan.split("PartitionFilters")[1][:120]


def byte_code(x):
    out = []
    while True:
        out.append(x & 127)
        x >>= 7
        if not x:
            return 8 * len(out)


def nibble_code(x):
    n = 1
    while x >> 3:
        x >>= 3
        n += 1
    return 4 * n


def test_codes(spark):
    xs = [0, 1, 7, 8, 127, 128, 16383, 16384, 2**31, 2**40]
    for r in spark.createDataFrame([(x,) for x in xs], "x long").select("x", codecs.byte_bits(F.col("x")).alias("b"), codecs.nibble_bits(F.col("x")).alias("n")).collect():
        assert (r["b"], r["n"]) == (byte_code(r["x"]), nibble_code(r["x"]))
    values = spark.createDataFrame([("t", v) for v in (3, 9, 10, 50)], "k string, v long")
    d = codecs.deltas(values, "k", "v")
    assert sorted(r["delta"] for r in d.collect()) == [1, 3, 6, 40]
    assert sorted(r["value"] for r in codecs.undelta(d, "k", "v").collect()) == [3, 9, 10, 50]
    n = spark.createDataFrame([(i, p) for i in (1, 100, 121, 150, 20000) for p in (0, 5, 12, 24, 100)], "n long, p long")
    for r in n.select("n", "p", codecs.skip_stride(F.col("n")).alias("s"), codecs.has_skip(F.col("n"), F.col("p")).alias("k")).collect():
        s = min(max(1, math.isqrt(r["n"])), 100)
        assert r["s"] == s and r["k"] == (s > 10 and r["n"] - r["p"] > 10 and r["p"] % s == 0)


def test_dumps_and_sinks(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a").write_text('<doc id="12" url="u1" title="T 1">one\ntwo é</doc>\njunk <doc id="x" url="u" title="t">no</doc><doc id="13" url="u2" title="T">x</doc>', encoding="utf-8")
    (tmp_path / "in" / "sub" / "b").write_text('<doc id="14" url="u3" title="T3"></doc><doc id="15" url="u" title="t">y</doc>', encoding="utf-8")
    found = dumps.split_documents(dumps.read_dump_files(spark, str(tmp_path / "in")))
    rows = {r["doc_id"]: (r["link"], r["title"], r["text"]) for r in found.collect()}
    # a record's text has a character at least, so an empty one runs on to the next end
    pattern = re.compile(dumps.RECORD)
    want = [m.groups() for f in ("a", "sub/b") for m in pattern.finditer((tmp_path / "in" / f).read_text(encoding="utf-8"))]
    assert rows == {int(i): (link, title, body) for i, link, title, body in want}
    assert rows[12] == ("u1", "T 1", "one\ntwo é") and rows[13] == ("u2", "T", "x") and len(rows) == 3
    sinks.write_meta(found, str(tmp_path / "meta"))
    assert {r["doc_id"]: r["title"] for r in dumps.read_meta(spark, str(tmp_path / "meta")).collect()} == {k: v[1] for k, v in rows.items()}
    sinks.write_tokens(text.tokenize(found), str(tmp_path / "tokens"))
    assert spark.read.parquet(str(tmp_path / "tokens")).where("doc_id = 12").first()["tokens"] == ["one", "two", "e"]
    stats = sinks.token_statistics(text.tokenize(found), found).first()
    n = sum(len(brute_tokens(v[2])) for v in rows.values())
    assert (stats["n_docs"], stats["n_tokens"]) == (3, n) and stats["avg_tokens_per_doc"] == pytest.approx(n / 3)
    files = {(r["file"], r["dir"]) for r in dumps.list_paths(spark, str(tmp_path / "in")).collect()}
    assert files == {("a", str(tmp_path / "in"))}


def test_token_files_and_lists(spark, tmp_path):
    (tmp_path / "t" / "0").mkdir(parents=True)
    (tmp_path / "t" / "0" / "5").write_text("a b\nc\n")
    (tmp_path / "t" / "0" / "6").write_text("")
    got = [(r["doc_id"], r["pos"], r["token"]) for r in dumps.read_token_files(spark, str(tmp_path / "t")).orderBy("pos").collect()]
    assert got == [(5, 0, "a"), (5, 1, "b"), (5, 2, "c")]
    (tmp_path / "d").write_text("x\ny\nz\n")
    (tmp_path / "l").write_text("X\nY\n")
    a, b = dumps.read_numbered(spark, str(tmp_path / "d"), "token", "line"), dumps.read_numbered(spark, str(tmp_path / "l"), "lemma", "line")
    assert {(r["token"], r["lemma"]) for r in dumps.zip_lemmas(a, b).collect()} == {("x", "X"), ("y", "Y")}
    sinks.write_lines(a, "token", ["line"], str(tmp_path / "o"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "o")).collect()] == ["x", "y", "z"]
    assert [tuple(r) for r in dumps.unpaired(a, b).collect()] == [(2, "z", None)]
    assert dumps.unpaired(a, a.withColumnRenamed("token", "lemma")).count() == 0
    flat = dumps.read_token_files(spark, str(tmp_path / "t" / "0"), recursive=False)
    assert sorted(r["token"] for r in flat.collect()) == ["a", "b", "c"]
    (tmp_path / "t" / "7").write_text("d")
    assert [tuple(r) for r in dumps.read_token_files(spark, str(tmp_path / "t"), recursive=False).collect()] == [(7, 0, "d")]


def test_lists_of_many_files(spark, tmp_path):
    lines = [f"w{i:05d}" if i % 50 else "" for i in range(3000)]
    for k in range(6):
        (tmp_path / f"part-{k:05d}").write_text("".join(f"{x}\n" for x in lines[k * 500 : k * 500 + 500]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # a file falls into several blocks
    try:
        got = {r["line"]: r["word"] for r in dumps.read_numbered(spark, str(tmp_path), "word", "line").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == dict(enumerate(lines))


def test_suffix_and_file_name(spark):
    r = spark.createDataFrame([("/a/b/c.txt",)], "p string").select(text.file_name(F.col("p")), text.ends_with(F.col("p"), ".txt"), text.ends_with(F.col("p"), "x/a/b/c.txt")).first()
    assert tuple(r) == ("c.txt", True, False)


def test_folding_in_the_jvm(spark):
    """Every character of the first three planes, alone and between letters, as the exact function has it."""
    from corpusloom.functions import text as fold
    from corpusloom.ship import ship

    ship(spark)
    chars = [chr(i) for i in range(1, 0x30000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([(c, f"x{c}Y") for c in chars], "a string, b string")
    assert all((r["fa"], r["fb"]) == (fold.fold(r["a"]), fold.fold(r["b"])) for r in df.select("a", "b", fold.fold_accents(df.a).alias("fa"), fold.fold_accents(df.b).alias("fb")).collect())
    texts = ["ΟΔΟΣ ΟΔΟΣ'Α ΣΑΣ1 ς", "İstanbul ÉCOLE", "“Привет”, мир — й", "日本語 ﬁne ½", "plain Text 12", "", None]
    got = {r["doc_id"]: r["t"] for r in fold.token_lists(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    import regex

    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else [w.lower() for w in regex.findall(r"[\p{L}\p{N}]+", fold.fold(t))])


def test_bigrams_without_a_shuffle_of_tokens(spark):
    from corpusloom.functions.text import tokenize
    from corpusloom.operators import collocations

    docs = spark.createDataFrame([(1, "a b a b c"), (2, "B a"), (3, "one"), (4, ""), (5, None), (1, "a b")], "doc_id long, text string")
    pairs = lambda df: sorted(map(tuple, df.collect()))
    assert pairs(collocations.text_bigrams(docs)) == [("a", "b", 3), ("b", "a", 2), ("b", "c", 1)]
    one = docs.where("doc_id > 1")
    assert pairs(collocations.text_bigrams(one)) == pairs(collocations.bigram_counts(tokenize(one)))
