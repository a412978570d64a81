"""Parser, matching, ranks, cascade, pages, snippets and collocations against brute force."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from corpusloom.functions.snippets import snippet
from corpusloom.operators import collocations
from corpusloom.operators.postings import build_index
from corpusloom.plans import ast, search
from corpusloom.plans.ast import And, Not, Or, QueryError, Quote, Term
from corpusloom.plans import compile as plan
from corpusloom.plans.parser import parse, postfix, postfix_of, report

T = Term
F32 = np.float32


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("a b|c", Or(And(T("a"), T("b")), T("c"))),
        ("!a b", And(Not(T("a")), T("b"))),
        ("(a)(b)", And(T("a"), T("b"))),
        ('"x y" /5 z', And(Quote(("x", "y"), 5), T("z"))),
        ("a && b", And(T("a"), T("b"))),
        ("a || b & !c", Or(T("a"), And(T("b"), Not(T("c"))))),
        ("!(a|b)c", And(Not(Or(T("a"), T("b"))), T("c"))),
        ('a "b c"d', And(T("a"), And(Quote(("b", "c")), T("d")))),
        ('a"b', T('a"b')),
        ("!!a", Not(Not(T("a")))),
        ('"a & b" /1', Quote(("a", "b"), 2)),
        ("a&b&c", And(T("a"), And(T("b"), T("c")))),
    ],
)
def test_parser(text, tree):
    assert parse(text).tree == tree and parse(text).boolean


@pytest.mark.parametrize("text", ["a &", "(a", "a)", '"&"', "& a", "a | | b", "()", "!", "", "  ", None, "x" * 1001, " ".join("a" * 21), '"a /x b"', "a !", "| a"])
def test_parser_errors(text):
    with pytest.raises(QueryError):
        parse(text)


def test_parser_counts_and_postfix():
    assert parse("a b c").terms == ("a", "b", "c") and not parse("a b").boolean
    assert parse('"a b c" /7 | d').words == 4
    assert postfix(["a", "b", "&", "c", "!", "|"]) == Or(Not(T("c")), And(T("b"), T("a")))
    assert postfix(['"a b /5"']) == Quote(("a", "b"), 5)
    for bad in (["&"], ["a", "b"], ["a", "&"], ["!"], []):
        with pytest.raises(QueryError):
            postfix(bad)


@pytest.mark.parametrize("text", ["a b|c", '"x y" /5 z', "!(a|b)c", "a & b & !!c"])
def test_postfix_of(text):
    tree = parse(text).tree
    assert report(text)[2] == " ".join(postfix_of(tree))

    def swapped(n):  # the reader takes the operand on top first
        match n:
            case And(a, b) | Or(a, b):
                return type(n)(swapped(b), swapped(a))
            case Not(c):
                return Not(swapped(c))
        return n

    assert postfix(postfix_of(tree)) == swapped(tree)


@pytest.mark.parametrize("names", [("a", "b"), ("a", "b", "a"), ("a", "a"), ("c", "a", "b", "c")])
def test_chains_by_merging(spark, names):
    r, rows = random.Random(3), []
    for i in range(150):
        t = [r.choice("abcd") for _ in range(r.randrange(0, 25))]
        rows.append((i, *([j for j, x in enumerate(t) if x == n] for n in names)))
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"p{k} array<int>" for k in range(len(names))))
    places = [df[f"p{k}"] for k in range(len(names))]
    dists = (len(names), len(names) + 1, len(names) + 4)
    got = df.select("id", plan.adjacent(places).alias("next"), *(plan.chains(d, places).alias(f"d{d}") for d in dists)).orderBy("id").collect()
    for (_, *lists), g in zip(rows, got):
        ends = []
        for start in lists[0]:
            at = start
            for p in lists[1:]:
                at = min((x for x in p if at is not None and x > at), default=None)
            ends += [at - start + 1] if at is not None else []
        for d in dists:
            assert g[f"d{d}"] == sum(e <= d for e in ends)
        assert g["next"] == g[f"d{len(names)}"]


class Brute:
    def __init__(self, texts, scoring="tf"):
        self.docs = {i: t.split() for i, t in texts.items()}
        self.df = Counter(w for t in self.docs.values() for w in set(t))

    def chains(self, doc, q):
        places = [[i for i, w in enumerate(self.docs[doc]) if w == t] for t in q.terms]
        n = 0
        for s in places[0]:
            at = s
            for p in places[1:]:
                at = next((x for x in p if x > at), None)
                if at is None:
                    break
            n += at is not None and at - s + 1 <= q.dist
        return n

    def match(self, doc, n):
        match n:
            case Term(t):
                return t in self.docs[doc]
            case Quote():
                return self.chains(doc, n) > 0
            case Not(c):
                return not self.match(doc, c)
            case And(a, b):
                return self.match(doc, a) and self.match(doc, b)
        return self.match(doc, n.left) or self.match(doc, n.right)

    def weight(self, doc, t):
        tf = self.docs[doc].count(t)
        return F32(1 + math.log(tf)) if tf else F32(0)

    def rank(self, doc, n):
        match n:
            case Term(t):
                return self.weight(doc, t)
            case Not(c):
                k = ast.estimate(c, self.df, len(self.docs))
                return F32(10 * float(F32(math.log(len(self.docs) / k)))) if k else F32(0)
            case And(a, b):
                return F32(self.rank(doc, a) + self.rank(doc, b))
            case Or(a, b):
                if self.match(doc, a) and self.match(doc, b):
                    return F32(self.rank(doc, a) + self.rank(doc, b))
                return self.rank(doc, a if self.match(doc, a) else b)
        total = F32(0)
        for t in dict.fromkeys(n.terms):
            total = F32(total + self.weight(doc, t))
        k = len(n.terms)
        a = F32(0.05)
        return F32(float(F32(float(a) * float(F32(math.log(1 + float(total)))))) + float(F32(1) - a) * math.log(1 + self.chains(doc, n) * k * k * 10 // n.dist))

    def top(self, n, most, used=()):
        found = [(float(self.rank(d, n)), d) for d in self.docs if d not in used and self.match(d, n)]
        return [(d, r) for r, d in sorted(found, reverse=True)[:most]]


def random_tree(r, words, depth):
    if depth == 0 or r.random() < 0.2:
        if r.random() < 0.4:
            ws = tuple(r.choice(words) for _ in range(r.randrange(2, 4)))
            return Quote(ws, r.randrange(0, 8))
        return T(r.choice(words))
    kind = r.choice("nao")
    if kind == "n":
        return Not(random_tree(r, words, depth - 1))
    return (And if kind == "a" else Or)(random_tree(r, words, depth - 1), random_tree(r, words, depth - 1))


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(7)
    texts = {i: " ".join(r.choice("abcdef") for _ in range(r.randrange(0, 14))) for i in range(120)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    built = build_index(docs)
    from corpusloom.operators.postings import Index

    return texts, docs, Index(built.docs.cache(), built.postings.cache(), built.terms.cache())


def got(df):
    return [(r["doc_id"], r["rank"]) for r in df.orderBy("rank_pos").collect()]


def test_random_trees(corpus):
    texts, _, index = corpus
    r, brute = random.Random(3), Brute(texts)
    fixed = [T("a"), Quote(("a", "b")), Quote(("a", "a"), 4), Not(Not(T("b"))), And(T("a"), T("a")), Quote(("c",))]
    for tree in [*fixed, *(random_tree(r, "abcdef", 3) for _ in range(8))]:
        tree = ast.simplify(tree)
        want = brute.top(tree, 30)
        have = got(search.ranked(index, tree, 30))
        assert [d for d, _ in have] == [d for d, _ in want], tree
        assert [x for _, x in have] == pytest.approx([x for _, x in want], abs=0)
        assert {x["doc_id"] for x in search.match_set(index, tree).collect()} == {d for d in texts if brute.match(d, tree)}


def test_laws(corpus):
    texts, _, index = corpus
    s = lambda n: {r["doc_id"] for r in search.match_set(index, n).collect()}
    a, b = T("a"), T("b")
    assert s(And(a, a)) == s(a) and s(And(a, b)) == s(And(b, a)) <= s(a) <= s(Or(a, b))
    assert s(Quote(("a", "b"))) <= s(Quote(("a", "b"), 4)) <= s(And(a, b))
    assert s(Not(Not(a))) == s(a) and len(s(a)) + len(s(Not(a))) == len(texts)


def test_cascade_with_cap(corpus):
    texts, _, index = corpus
    brute = Brute(texts)
    for words, cap in itertools.product((["a", "b"], ["c", "a", "b"], ["d"]), (5, 500)):
        want, used = [], set()
        for k in range(len(words), -1, -1) if len(words) > 1 else [1]:
            part = brute.top(ast.simplify(search.stage_query(words, k)) if len(words) > 1 else T(words[0]), cap, used)
            used |= {d for d, _ in part}
            want += [(d, x, k) for d, x in part]
        rows = search.cascade(index, words, cap).orderBy("rank_pos").collect()
        assert [(r["doc_id"], r["rank"], r["stage"]) for r in rows] == want
    assert search.cascade(index, ["a", "b"], 5, enough=3).count() == 3


def test_cap_ties_and_pages(spark):
    docs = spark.createDataFrame([(i, "same") for i in range(60)], "doc_id long, text string")
    out = search.ranked(build_index(docs), T("same"), 55)
    assert [d for d, _ in got(out)] == list(range(59, 4, -1))
    assert [r["doc_id"] for r in search.page(out, 1).orderBy("rank_pos").collect()] == [9, 8, 7, 6, 5]
    assert search.page(out, 2).count() == 0


def test_search_binding(spark, corpus):
    texts, docs, index = corpus
    assert search.search(index, "a | zzz").count() == 0 and search.search(index, "zzz").count() == 0
    assert got(search.search(index, "a zzz")) == got(search.search(index, "a"))
    assert got(search.search(index, "Á & b")) == got(search.search(index, "a&b"))
    assert got(search.search(index, "x1 | b", {"x1": "a"})) == got(search.search(index, "a | b"))
    view = search.results_view(index, docs, "a b", meta=docs.selectExpr("doc_id", "'l' AS link", "'t' AS title")).orderBy("rank_pos").collect()
    assert len(view) == min(50, search.search(index, "a b").count()) and {"link", "title", "snippet"} < set(view[0].asDict())
    assert search.archive(docs, 5).first()["text"] == texts[5] and search.archive(docs, "x").count() == 0
    assert search.pager("a&b", 4)[0] == ("3", "/search?text=a%26b&p=2")


def test_tfidf_scoring(corpus):
    _, _, index = corpus
    rows = search.ranked(index, And(T("a"), T("b")), 500, "tfidf").collect()
    assert rows and all(r["rank"] >= 0 for r in rows)


def test_snippets():
    text = "zero " * 40 + "cat saw the dog. " + "fill " * 40 + "cat " + "gap " * 200 + "dog"
    s = snippet(text, ["cat", "dog"])
    assert "cat saw the dog" in s and len(s) <= 300 and s.startswith("...") and s.endswith("...")
    assert snippet("one two", ["none"]) == "one   two ..." and snippet("", ["a"]) == "..."
    assert "Çat" in snippet("x Çat y", ["cat"])
    far = snippet("cat " + "w " * 400 + "dog", ["cat", "dog"])
    assert "cat" in far and "dog" in far and len(far) <= 300


def test_collocations(spark):
    r = random.Random(5)
    texts = [" ".join(["new york"] * r.randrange(0, 3) + [r.choice("abcdefgh") if r.random() < 0.7 else r.choice(["new", "york"]) for _ in range(30)]) for _ in range(120)]
    tokens = [(i, p, w) for i, t in enumerate(texts) for p, w in enumerate(t.split())]
    df = spark.createDataFrame(tokens, "doc_id long, pos int, token string")
    single, both, first, second = Counter(w for _, _, w in tokens), Counter(), Counter(), Counter()
    for t in texts:
        for a, b in itertools.pairwise(t.split()):
            both[a, b] += 1
            first[a] += 1
            second[b] += 1
    total, pairs = len(tokens), len(tokens) - len(texts)
    t_want, chi_want = {}, {}
    for (a, b), n in both.items():
        m1, m2 = single[a] / total * single[b] / total, n / pairs
        t = (m2 - m1) / math.sqrt(m2 * (1 - m2) / pairs)
        if t > 3.291:
            t_want[a, b] = t
        a11, a12, a21 = n, first[a] - n, second[b] - n
        for plus in (1, -1):
            a22 = pairs - a12 - a21 + plus * a11
            x = pairs * (a11 * a22 - a12 * a21) ** 2 / ((a11 + a12) * (a11 + a21) * (a12 + a22) * (a21 + a22))
            if x > 10.83 and a11 > 50 and a12 > 20 and a21 > 20:
                chi_want[a, b, plus] = x
    assert {(r["w1"], r["w2"]): r["score"] for r in collocations.t_test(df).collect()} == pytest.approx(t_want)
    for plus in (1, -1):
        want = {k[:2]: v for k, v in chi_want.items() if k[2] == plus}
        assert {(r["w1"], r["w2"]): r["score"] for r in collocations.chi_square(df, plus < 0).collect()} == pytest.approx(want)
    assert ("new", "york") in t_want and ("new", "york", 1) in chi_want
    assert collocations.collocations(df, "t", 2).count() <= 2


def test_stored_index_with_any_number_of_buckets(spark, tmp_path):
    from pyspark.sql import functions as F

    from corpusloom.operators import postings

    docs = spark.createDataFrame([(i, f"w{i % 7} élan日 x w{i % 5}") for i in range(60)], "doc_id long, text string")
    index = postings.build_index(docs)
    every = sorted(tuple(r) for r in index.select(["w3", "日", "elan日", "none"]).withColumn("positions", F.array_join("positions", ",")).collect())
    for n in (None, 5, 130):
        held = postings.save_index(index, str(tmp_path / str(n)), n)
        assert held.buckets == (n or postings.BUCKETS) and postings.load_index(spark, str(tmp_path / str(n))).buckets == held.buckets
        got = held.select(["w3", "日", "elan日", "none"])
        assert sorted(tuple(r) for r in got.withColumn("positions", F.array_join("positions", ",")).collect()) == every
    terms = held.postings.select("term", "bucket").distinct().collect()
    assert terms and all(postings.bucket_of(r["term"], 130) == r["bucket"] for r in terms)
