"""Scores by blocks of documents: the same as joins of postings give, without postings that leave a task."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.functions.text import char_wb_ngrams
from gleaner.operators import blocks, popularity
from gleaner.operators.blocks import Best, Cut, term_statistics
from gleaner.operators.retrieval import retrieve_dense
from gleaner.operators.vocabulary import gram_counts, postings, term_frequencies
from gleaner.plans import channels
from gleaner.plans.channels import CHAR, Sparse, query_terms
from gleaner.plans.queries import QUERIES

SPECS = [Sparse(), Sparse(high=2, min_df=1), Sparse(scoring="tfidf", weighted=True), CHAR, Sparse(words="snowball")]


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


def made(spark, repeated=()):
    """300 texts of few words, copies among them, some ids null or repeated, some categories null."""
    rng = np.random.default_rng(3)
    words = [f"wo{i}rd" for i in range(40)] + ["мастер", "мастера", "x" * 70, "ab"]
    text = lambda n: " ".join(rng.choice(words, n))
    out = [(i, ("a", "b", None)[rng.integers(0, 9) // 4], "l", text(3), "p", text(int(rng.integers(0, 30)))) for i in range(300)]
    out += [(i, "a", "l", "wo1rd ab", "p", "wo2rd") for i in range(300, 340)] + [(None, "a", "l", text(3), "p", ""), *repeated]
    return spark.createDataFrame(out, "item_id long, category string, location string, title string, params string, description string")


def asked(items):
    return items.filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "category", "location", F.col("title").alias("query"), "params")


@pytest.mark.parametrize("spec", SPECS, ids=str)
def test_channels_equal_joins(spark, monkeypatch, spec):
    monkeypatch.setattr(blocks, "LEAST_SAMPLED", 0)
    same = [(7, None, "l", "wo3rd wo3rd", "p", "ab"), (7, None, "l", "ab", "p", ""), (40, "c", "l", "wo3rd ab", "p", "wo4rd"), (40, "c", "l", "wo5rd", "p", "ab")]
    items = made(spark, same).filter("item_id is null or item_id not in (7, 40) or coalesce(category, '') in ('', 'c')").cache()
    q = asked(items)
    terms = query_terms(q, spec) if spec.words == "plain" else channels.with_word_forms(query_terms(q, Sparse()), "query_id", spec.words)
    want = rows(channels._channel_by_postings(items, terms, spec, 5), "query_id", "item_id", "score", "rank")
    found = channels.sparse_channel(items, q, spec, 5)
    assert [(a, b, pytest.approx(s, abs=2e-9), r) for a, b, s, r in want] == rows(found, "query_id", "item_id", "score", "rank")


def test_an_id_of_several_categories(spark):
    items = made(spark, [(20, "a", "l", "wo1rd", "p", "ab"), (20, "b", "l", "wo1rd", "p", "ab")])
    want = rows(channels._channel_by_postings(items, query_terms(asked(items), Sparse()), Sparse(), 5))
    assert rows(channels.sparse_channel(items, asked(items), Sparse(), 5)) == want


def test_no_postings_are_written_or_dealt_out(spark, sf, monkeypatch):
    """Postings of whole texts were shuffled twice and written: more disk than the input at a hundred times its terms."""
    monkeypatch.setattr(channels, "item_postings", lambda *a: pytest.fail("postings of all items"))
    for name in ("word_bm25_topk", "char_bm25_topk", "word_bigram_bm25_topk", "vocabulary_prune"):
        assert QUERIES[name](spark, sf).count() > 0
    plan = QUERIES["char_wb_counts"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "item_id" not in plan


def test_statistics_and_counts(spark):
    texts = ["baba bab  abba", "", "a bab baba baba", "б" * 60 + " ab"]
    df = spark.createDataFrame([(i, "c", x) for i, x in enumerate(texts)], "item_id long, category string, text string")
    words = df.select("item_id", "category", F.filter(F.split("text", " "), lambda w: F.length(w) > 0).alias("terms"))
    plain = words.withColumn("tf", F.lit(None).cast("array<long>"))
    for low, high in ((4, 4), (2, 3)):
        by_text = postings(df.select("item_id", "category", char_wb_ngrams(F.col("text"), low, high).alias("terms")))
        want = rows(term_frequencies(by_text), "term", "df", "cf")
        assert rows(term_statistics(plain, Cut("char", low, high)), "term", "df", "cf") == want
        assert rows(gram_counts(words, char_wb_ngrams(F.col("term"), low, high))) == [(t, n) for t, _, n in want]


def test_best_is_cut_often():
    """However often candidates are cut, the k best stay, ties by id, NaN first."""
    rng = np.random.default_rng(5)
    scores = rng.integers(0, 6, (4, 200)) / 3
    scores[1, 150] = np.nan
    best = Best(np.full(4, -np.inf), 7)
    best.bound = 20
    ids = rng.permutation(200)
    for a in range(0, 200, 10):
        start = best.documents(pa.array(ids[a : a + 10]))
        best.add(np.arange(4), np.arange(10) + start, scores[:, a : a + 10])
    place, item, _, _ = best.cut()
    for q in range(4):
        order = sorted(range(200), key=lambda i: (-np.nan_to_num(scores[q, i], nan=9), ids[i]))[:7]
        assert [ids[i] for i in item[place == q]] == [ids[i] for i in order]


def test_dense_thresholds(spark, monkeypatch):
    rng = np.random.default_rng(1)
    items = spark.createDataFrame([(i, "c", rng.normal(size=3).tolist()) for i in range(600)], "item_id long, category string, vector array<double>")
    queries = items.filter("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")
    want = rows(retrieve_dense(queries, items, 30))
    monkeypatch.setattr("gleaner.operators.retrieval.LEAST_SAMPLED", 0)
    assert rows(retrieve_dense(queries, items, 30)) == want and len(want) == 12 * 30


def test_candidates_do_not_grow_with_pieces(spark, monkeypatch):
    """The sample had a task for each piece of the table: with more of them its bounds sank, and scores that left were many more."""
    rng = np.random.default_rng(2)
    items = spark.createDataFrame([(i, "c", rng.normal(size=3).tolist()) for i in range(4000)], "item_id long, category string, vector array<double>").repartition(60)
    queries = items.filter("item_id % 400 = 0").withColumnRenamed("item_id", "query_id")
    want = rows(retrieve_dense(queries, items, 100))
    monkeypatch.setattr("gleaner.operators.retrieval.LEAST_SAMPLED", 0)
    with monkeypatch.context() as m:
        m.setattr(blocks, "top_k", lambda rows, k: rows)
        assert retrieve_dense(queries, items, 100).count() < 10 * 1.5 * blocks.SAMPLE * 100
    assert rows(retrieve_dense(queries, items, 100)) == want
    monkeypatch.setattr(blocks, "HELD", 1)  # tasks of the sample look for fewer where memory is short
    assert rows(retrieve_dense(queries, items, 100)) == want


def test_lists_by_priority(spark):
    """A list that all queries share isn't repeated for each before it is cut."""
    lists = lambda *r: spark.createDataFrame(r, "query_id long, item_id long, rank int")
    own, near = lists((1, 5, 1), (1, 6, 2)), spark.createDataFrame([("g", 6, 1), ("g", 7, 2), ("h", 5, 1)], "category string, item_id long, rank int")
    q = spark.createDataFrame([(1, "g"), (1, "g"), (2, "h"), (3, None)], "query_id long, category string")
    overall = spark.createDataFrame([(9, 1), (5, 2)], "item_id long, rank int")
    want = popularity.by_priority([own, q.join(near, "category").select("query_id", "item_id", "rank"), q.crossJoin(overall).select("query_id", "item_id", "rank")], 3)
    found = popularity.lists_by_priority(q, [(popularity.listed(own, ["query_id"]), ["query_id"]), (popularity.listed(near, ["category"]), ["category"]), (popularity.listed(overall, []), [])], 3)
    assert rows(found) == rows(want)
