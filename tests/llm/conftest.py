import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string"


def tricky(spark, seed=1, n=60):
    """Nulls, empty, long, repeated and copied texts, ties and columns with clashing names."""
    r = random.Random(seed)
    pool = ["alpha", "beta", "Gamma", "delta", "épée", "ß", "x1", "the", "of", "naïve", "日本", "rest"]
    texts = [" ".join(r.choice(pool) for _ in range(r.randrange(0, 80))) for _ in range(n)]
    texts[3], texts[4], texts[5], texts[6] = None, "", " \t\n ", texts[7]
    texts[8] = " ".join(r.choice(pool) for _ in range(6000))
    texts[9] = texts[8].replace("alpha", "beta", 1)
    rows = [(i, t, ["en", "fr", None][i % 3], ["s0", "s0", "s1", None][i % 4], len(t or ""), i, "z") for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], (None, texts[11], "en", "s1", 1, 0, "z"), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(2)


@pytest.fixture(scope="session")
def docs(spark):
    return tricky(spark).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
