import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, fp string, rule string, copies int, `end` int, g_id int, times int"


def make_docs(spark, texts, **columns):
    """Documents with columns whose names the operators use themselves."""
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, t, columns.get("lang", ["en"] * len(texts))[i], columns.get("source", ["s"] * len(texts))[i], len(t or ""), 1, "x", "y", 2, 3, 4, 5))
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, letterless, one-word, repeated, tied and very long texts."""
    rng = random.Random(5)
    long = words(rng, 60_000)
    return [None, "", " \t\n", "12 34 !!", "word", "the same text twice here", "the same text twice here", "é中\U0001f600 ﬁ x", long, "a" * 200_000, None, words(rng, 300), words(rng, 300)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    n = len(odd_texts)
    df = make_docs(spark, odd_texts, lang=[None if i % 5 == 0 else "en" if i % 2 else "fr" for i in range(n)], source=[None if i % 4 == 0 else "s" if i % 3 else "" for i in range(n)])
    nulls = spark.createDataFrame([(None,) * 12, (None,) * 12], DOCS)
    return df.unionByName(df.filter("doc_id = 5")).unionByName(nulls).cache()  # a repeated row, and rows of nulls


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
