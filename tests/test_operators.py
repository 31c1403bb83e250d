import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import evaluation, fusion, popularity, profile, submission
from gleaner.operators.ranking import top_k
from gleaner.operators.retrieval import retrieve_dense, retrieve_sparse, target_category
from gleaner.functions.text import char_wb_ngrams
from gleaner.operators.vocabulary import build_vocabulary, corpus_stats, document_lengths, gram_postings, postings, term_frequencies
from gleaner.operators.weights import binary_query_terms, bm25_postings, tfidf_weights
from gleaner.plans.channels import WORD, Sparse, final_pipeline, sparse_channel
from gleaner.plans.tables import hashed_vectors
from gleaner.sources import io
from gleaner.streaming.popularity import windowed_popularity

CANDIDATES = "channel string, query_id long, item_id long, score double, rank int"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


def docs(spark, *texts):
    return spark.createDataFrame([(i, "c" if i < 9 else "d", t.split()) for i, t in enumerate(texts)], "item_id long, category string, terms array<string>")


def test_category_and_ties(spark):
    df = spark.createDataFrame([(0,), (81,)], "c int")
    assert [r[0] for r in df.select(target_category(F.col("c"))).collect()] == [114, 81]
    tied = spark.createDataFrame([(1, i, 0.5) for i in (9, 3, 7)], "query_id int, item_id int, score double")
    assert rows(top_k(tied, 2), "item_id", "rank") == [(3, 1), (7, 2)]


def test_vocabulary(spark):
    terms = term_frequencies(postings(docs(spark, "a a b", "a b c", "a d", "")))
    assert rows(build_vocabulary(terms, 4, 2, 1.0, None)) == [("a", 3, 4), ("b", 2, 2)]
    assert rows(build_vocabulary(terms, 4, 1, 0.5, 2)) == [("b", 2, 2), ("c", 1, 1)]
    for k in range(1, 6):  # ties at every place
        assert rows(build_vocabulary(terms, 4, 1, 1.0, k)) == sorted([("a", 3, 4), ("b", 2, 2), ("c", 1, 1), ("d", 1, 1)][:k])
    p, v = postings(docs(spark, "a a b", "a b c", "a d", "")), build_vocabulary(terms, 4, 2)
    s = corpus_stats(document_lengths(p, v), v, 4).first()
    assert (s["n_docs"], s["n_terms"], s["nnz"], s["avg_len"]) == (4, 2, 5, 1.5)


def test_gram_postings(spark):
    """Grams made from a document's different words are those made from its text."""
    texts = ["baba bab  abba", "", "a bab baba baba"]
    df = spark.createDataFrame([(i, "c", x) for i, x in enumerate(texts)], "item_id long, category string, text string")
    for low, high in ((4, 4), (2, 3)):
        by_text = postings(df.select("item_id", "category", char_wb_ngrams(F.col("text"), low, high).alias("terms")))
        words = df.select("item_id", "category", F.filter(F.split("text", " "), lambda w: F.length(w) > 0).alias("terms"))
        assert rows(gram_postings(words, char_wb_ngrams(F.col("term"), low, high))) == rows(by_text)


def test_bm25_by_hand(spark):
    p = postings(docs(spark, "a a b", "a b c", "a d", ""))
    v = build_vocabulary(term_frequencies(p), 4, 2)
    lengths = document_lengths(p, v)
    got = {(r["item_id"], r["term"]): r["weight"] for r in bm25_postings(p, v, lengths, 4).collect()}
    lens, avg = {0: 3, 1: 2, 2: 1}, 6 / 4
    for (i, term), w in got.items():
        df, tf = {"a": 3, "b": 2}[term], 2 if (i, term) == (0, "a") else 1
        assert w == pytest.approx(math.log1p((4 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * lens[i] / avg)))
    assert len(got) == 5
    q = spark.createDataFrame([(1, "c", ["a", "a", "zz"]), (2, "c", ["a"]), (3, "x", ["a"])], "query_id long, category string, terms array<string>")
    found = retrieve_sparse(binary_query_terms(q, v), bm25_postings(p, v, lengths, 4, binary_query_terms(q, v)))
    by = {}
    for r in found.collect():
        by.setdefault(r["query_id"], []).append((r["item_id"], r["score"]))
    assert by[1] == by[2] and 3 not in by  # a repeated term counts once; another category finds nothing


def test_tfidf_by_hand(spark):
    p = postings(docs(spark, "a a b", "a b"))
    got = {(r["item_id"], r["term"]): r["weight"] for r in tfidf_weights(p, build_vocabulary(term_frequencies(p), 2, 1), 2).collect()}
    a, b = 1 + math.log(2), 1.0
    assert got[0, "a"] == pytest.approx(a / math.hypot(a, b)) and got[1, "a"] == pytest.approx(2**-0.5)


def test_dense(spark):
    q = spark.createDataFrame([(1, "c", [1.0, 0.0]), (2, "c", [0.0, 0.0])], "query_id long, category string, vector array<double>")
    i = spark.createDataFrame([(5, "c", [0.0, 1.0]), (6, "c", [1.0, 0.0]), (7, "d", [1.0, 0.0])], "item_id long, category string, vector array<double>")
    got = {(r["query_id"], r["rank"]): (r["item_id"], r["score"]) for r in retrieve_dense(q, i).collect()}
    assert got == {(1, 1): (6, 1.0), (1, 2): (5, 0.0), (2, 1): (5, 0.0), (2, 2): (6, 0.0)}


def test_a_save_that_breaks_off(spark, tmp_path):
    """Neither a write that fails nor a crash before the metadata touches what was valid; a folder that isn't finished isn't loaded."""
    df = spark.createDataFrame([(1, 2)], "query_id int, item_id int")
    store = io.CandidateStore(spark, str(tmp_path / "s"), "f")
    store.save("word", "cold", df)
    with pytest.raises(Exception, match="broken"):
        store.save("word", "cold", df.withColumn("item_id", F.raise_error(F.lit("broken")).cast("int")))
    assert rows(store.load("word", "cold")) == [(1, 2)]
    df.union(df).write.parquet(store._data("word", "cold", "half"))  # the metadata never came
    assert rows(store.load("word", "cold")) == [(1, 2)]
    store.save("word", "cold", df.union(df))
    assert rows(store.load("word", "cold")) == [(1, 2)] * 2
    assert len([f for f in (tmp_path / "s" / "word" / "cold").iterdir() if f.name.startswith("candidates-")]) == 1
    next((tmp_path / "s" / "word" / "cold").glob("candidates-*/_SUCCESS")).unlink()
    with pytest.raises(ValueError):
        store.load("word", "cold")


def test_dense_blocks(spark):
    """Many small blocks, ties, and a category that holds most rows, against all products."""
    rng = np.random.default_rng(1)
    made = [(i, "c" if i % 10 else "d", (rng.integers(-3, 4, 4) / 2).tolist()) for i in range(300)]
    items = spark.createDataFrame([*made, (1000, "c", None), (1001, None, [1.0] * 4)], "item_id long, category string, vector array<double>")
    queries = items.filter("item_id % 7 = 0").withColumnRenamed("item_id", "query_id")
    want = []
    for q, c, v in made:
        if q % 7 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), i) for i, d, x in made if d == c)[:5]
            want += [(q, i, -s, r + 1) for r, (s, i) in enumerate(scored)]
    for blocks in ((512, 4096), (3, 7)):
        assert rows(retrieve_dense(queries, items, 5, *blocks), "query_id", "item_id", "score", "rank") == sorted(want)


def test_quantiles(spark):
    rng = np.random.default_rng(2)
    for values in ([3.0], [1.0, 2.0], rng.integers(0, 9, 200).astype(float).tolist(), rng.normal(size=333).tolist()):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
        got = {r["share"]: r["value"] for r in profile.quantiles(df, F.col("x")).collect()}
        assert got == pytest.approx({s: float(np.quantile(values, s)) for s in profile.SHARES})
    empty = profile.quantiles(spark.createDataFrame([], "x double"), F.col("x")).collect()
    assert len(empty) == len(profile.SHARES) and all(r["value"] is None for r in empty)


def test_column_profile(spark):
    df = spark.createDataFrame([(1, "aa", True, None, [1]), (2, None, False, None, [1]), (2, "b", None, None, None)], "a int, b string, c boolean, d double, e array<int>")
    got = {r["column"]: tuple(r)[1:] for r in profile.column_profile(df).collect()}
    assert got == {"a": ("int", 3, 0, 2, 1.0, 2.0, 2.0), "b": ("string", 3, 1, 2, 1.0, 1.5, 2.0), "c": ("boolean", 3, 1, 2, 0.0, 0.5, 1.0), "d": ("double", 3, 3, 0, None, None, None), "e": ("array<int>", 3, 1, 1, None, None, None)}


def test_pool_recalls(spark):
    found = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("b", 1, 6), ("a", 2, 9)], "channel string, query_id int, item_id int")
    relevant = spark.createDataFrame([(1, 5), (1, 6), (2, 8), (3, 1)], "query_id int, item_id int")
    got = {r["pool"]: (r["queries"], round(r["recall"], 6), r["queries_with_hit"]) for r in evaluation.pool_recalls(found, relevant, ["a", "b"]).collect()}
    assert got == {"a": (3, 0.166667, 1), "b": (3, 0.333333, 1), "union": (3, 0.333333, 1)}


def test_minmax(spark):
    c = spark.createDataFrame([("a", 1, 1, 2.0, 1), ("a", 1, 2, 2.0, 2), ("b", 1, 1, 7.0, 1), ("c", 1, 1, 3.0, 1), ("c", 1, 2, 1.0, 2), ("c", 1, 3, 2.0, 3)], CANDIDATES)
    assert rows(fusion.minmax(c), "channel", "item_id", "score") == [("a", 1, 0.0), ("a", 2, 0.0), ("b", 1, 0.0), ("c", 1, 1.0), ("c", 2, 0.0), ("c", 3, 0.5)]
    fused = {r["item_id"]: r["score"] for r in fusion.mean_minmax(c, 3).collect()}
    assert fused == pytest.approx({1: 1 / 3, 2: 0.0, 3: 0.5 / 3})
    rrf = {r["item_id"]: r["score"] for r in fusion.reciprocal_rank(c).collect()}
    assert rrf[1] == 1.0 and min(rrf.values()) == 0.0
    flipped = c.orderBy(F.desc("channel"))
    assert rows(fusion.mean_minmax(flipped, 3)) == rows(fusion.mean_minmax(c, 3))


def test_blend(spark):
    a = spark.createDataFrame([(1, 1, 1.0)], "query_id long, item_id long, score double")
    b = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0)], "query_id long, item_id long, score double")
    assert rows(fusion.weighted_blend(a, b, 0.0)) == [(1, 1, 1.0)]
    assert rows(fusion.weighted_blend(a, b, 0.5)) == [(1, 1, 1.5), (1, 2, 1.0)]
    assert rows(fusion.weighted_blend(a, b, 1.0, complement=True)) == [(1, 1, 1.0), (1, 2, 2.0)]


def test_priority_and_fallback(spark):
    make = lambda *x: spark.createDataFrame(list(x), "query_id long, item_id long, rank int")
    got = popularity.by_priority([make((1, 5, 1), (1, 6, 2)), make((1, 6, 1), (1, 7, 2), (2, 7, 1))], 3)
    assert rows(got) == [(1, 5, 1), (1, 6, 2), (1, 7, 3), (2, 7, 1)]
    q = spark.createDataFrame([(1, "c", "x"), (2, "c", "y"), (3, "c", "x")], "query_id long, category string, location string")
    i = spark.createDataFrame([(4, "c", "x"), (5, "c", "x"), (6, "c", "z")], "item_id long, category string, location string")
    c = spark.createDataFrame([(3, 9, 1.0, 1)], "query_id long, item_id long, score double, rank int")
    assert rows(popularity.fill_empty(c, q, i, 2), "query_id", "item_id") == [(1, 4), (1, 5), (2, 4), (2, 5), (3, 9)]


def test_popularity_uses_its_keys(spark):
    pairs = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 2)], "g string, item_id long")
    assert rows(popularity.popular(pairs, ["g"], 1)) == [("a", 1, 2, 1), ("b", 2, 1, 1)]
    assert rows(popularity.popular(pairs, [], 1)) == [(1, 2, 1)]


def test_history(spark):
    h = spark.createDataFrame([("t", None), ("t", 1), ("u", 1)], "text string, loc int")
    held = spark.createDataFrame([("t", None)], "text string, loc int")
    assert rows(popularity.remove_signatures(h, held, ["text", "loc"])) == [("t", 1), ("u", 1)]
    assert rows(popularity.remove_texts(h, held, "text"), "text") == [("u",)]


def test_recall(spark):
    rel = spark.createDataFrame([("A", 1), ("B", 1), ("B", 2), ("C", 3), ("D", 4)], "query_id string, item_id long")
    cand = spark.createDataFrame([("A", 1, 1), ("B", 1, 50), ("B", 2, 51), ("C", 9, 1)], "query_id string, item_id long, rank int")
    r = evaluation.recall_at_k(cand, rel)
    assert {x["query_id"]: x["recall"] for x in r.collect()} == {"A": 1.0, "B": 0.5, "C": 0.0, "D": 0.0}
    assert rows(evaluation.summarize(r)) == [(4, 0.375, 2)]


def test_splits(spark):
    t = spark.createDataFrame([("Дом", 1, 5), ("дом ", 2, 6), ("баня", 1, 7), ("баня", 1, 8)], "q string, loc int, item_id long")
    norm = F.trim(F.lower("q"))
    assert rows(evaluation.hash_split(t, ["q", "loc"], "cold", 9, norm), "text") == [("баня",), ("дом",)]
    warm = evaluation.hash_split(t, ["q", "loc"], "warm", 9, norm).collect()
    assert [r["text"] for r in warm] == ["дом"]
    with pytest.raises(ValueError):
        evaluation.hash_split(t, ["q"], "hot", 9, norm)


def test_bootstrap(spark):
    w = evaluation.bootstrap_weights(spark, 7, 3, 1).toPandas()
    assert (w.groupby("run").weight.sum() == 7).all()
    again = evaluation.bootstrap_weights(spark, 7, 3, 1).toPandas()
    assert w.equals(again)


def test_negatives(spark):
    items = spark.createDataFrame([(i, "c" if i % 2 else "d") for i in range(40)], "item_id long, category string")
    got = evaluation.random_negatives(items.withColumn("query_id", F.col("item_id")), items).toPandas()
    assert len(got) == 40 and (got.negative != got.item_id).all() and (got.negative % 2 == got.item_id % 2).all() and got.negative.nunique() > 10


def test_negatives_are_uniform(spark):
    """Over many pairs every other item is drawn about equally often; a category of one item has no row, or the default's."""
    items = spark.createDataFrame([(i, "c") for i in range(10)] + [(100, "lone")], "item_id long, category string")
    pairs = items.withColumn("query_id", F.explode(F.sequence(F.lit(0), F.lit(999))))
    got = evaluation.random_negatives(pairs, items)
    n = {(r["item_id"], r["negative"]): r["count"] for r in got.groupBy("item_id", "negative").count().collect()}
    assert len(n) == 90 and min(n.values()) > 70 and max(n.values()) < 160
    assert got.filter("item_id = 100").count() == 0
    assert evaluation.random_negatives(pairs, items, default_category="c").filter("item_id = 100").count() == 1000


def test_submission(spark):
    q = spark.createDataFrame([("1" * 16,), ("2" * 16,)], "query_id string")
    i = spark.createDataFrame([("a" * 16,), ("b" * 16,)], "item_id string")
    c = spark.createDataFrame([("1" * 16, "b" * 16, 1), ("1" * 16, "a" * 16, 2)], "query_id string, item_id string, rank int")
    built = submission.build_submission(c, q)
    assert rows(built) == [("1" * 16, "b" * 16 + " " + "a" * 16), ("2" * 16, "")]
    assert rows(submission.violations(built, q, i)) == [("answer_size", "2" * 16)]
    make = lambda *x: spark.createDataFrame(list(x), "query_id string, answer string")
    ok = make(("1" * 16, "a" * 16), ("2" * 16, "b" * 16))
    assert submission.violations(ok, q, i).isEmpty()
    rule = lambda a: {r["rule"] for r in submission.violations(a, q, i).collect()}
    assert rule(ok.withColumn("more", F.lit(1))) == {"columns"}
    assert rule(ok.limit(1)) == {"missing_query"}
    assert "duplicate_query" in rule(ok.unionByName(ok))
    assert rule(make(("1" * 16, "a" * 16 + " " + "a" * 16), ("2" * 16, "b" * 16))) == {"repeated_item"}
    assert rule(make(("1" * 16, "A" * 16), ("2" * 16, "b" * 16))) == {"item_format", "unknown_item"}
    assert rule(make(("1" * 16, "c" * 16), ("2" * 16, "b" * 16))) == {"unknown_item"}
    assert "answer_size" in rule(make(("1" * 16, " ".join(["a" * 16] * 51)), ("2" * 16, "b" * 16)))
    with pytest.raises(ValueError, match="missing_query"):
        submission.check(ok.limit(1), q, i)


def test_profile(spark):
    df = spark.createDataFrame([(1, "ab", True), (None, "", False)], "n int, s string, b boolean")
    got = {r["column"]: r for r in profile.column_profile(df).collect()}
    assert got["n"]["nulls"] == 1 and got["s"]["high"] == 2.0 and got["b"]["distinct"] == 2
    assert profile.same_ids(df, df, "n") and not profile.same_ids(df, df.limit(1), "n")


def test_word_forms_in_a_channel(spark):
    items = spark.createDataFrame([(1, "c", "x", "ремонт стены", "", None), (2, "c", "x", "ремонта стен", "", ""), (3, "c", "x", "дом", "", "")], "item_id long, category string, location string, title string, params string, description string")
    q = spark.createDataFrame([(9, "c", "x", "ремонту", "")], "query_id long, category string, location string, query string, params string")
    assert rows(sparse_channel(items, q, Sparse(max_df=1.0)), "item_id") == []
    assert rows(sparse_channel(items, q, Sparse(max_df=1.0, words="snowball")), "item_id") == [(1,), (2,)]


def test_final_pipeline(spark, sf):
    from gleaner.plans import tables

    items, asked = tables.items(spark, sf), tables.known_items(spark, sf)
    got = final_pipeline(items, asked, hashed_vectors(items.select(F.col("title").alias("text"))), k=5).toPandas()
    assert (got.groupby("query_id").size() <= 5).all() and not got.duplicated(["query_id", "item_id"]).any()
    assert WORD.max_features == 200_000


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("1", "a b"), ("2", None)], "query_id string, answer string")
    io.write_csv(df, str(tmp_path / "out"))
    back = io.read_csv_strings(spark, str(tmp_path / "out"), ["query_id", "answer"])
    assert rows(back) == [("1", "a b"), ("2", "")]
    assert io.fingerprint(df) == io.fingerprint(df.repartition(3)) != io.fingerprint(df.limit(1))
    store = io.CandidateStore(spark, str(tmp_path / "store"), "f1")
    assert not store.complete("word", "cold")
    store.save("word", "cold", df, seconds=1.5)
    assert store.complete("word", "cold") and rows(store.load("word", "cold")) == rows(df) and store.diagnostics("word", "cold")["seconds"] == 1.5
    other = io.CandidateStore(spark, str(tmp_path / "store"), "f2")
    assert not other.complete("word", "cold")
    with pytest.raises(ValueError):
        other.load("word", "cold")
    made = []
    cache = io.EmbeddingCache(spark, str(tmp_path / "emb"), "k")
    for _ in range(2):
        cache.get_or_make("title", lambda: made.append(1) or df)
    assert made == [1]
    io.write_report({"a": 1, "row": df.first()}, str(tmp_path / "r.json"))
    assert '"a b"' in (tmp_path / "r.json").read_text()
    m = spark.createDataFrame([("x", 0.2), ("y", 0.7), ("z", 0.7)], "config string, mix double")
    io.write_csv(m, str(tmp_path / "m"))
    assert io.best_row(io.read_csv_typed(spark, str(tmp_path / "m")), "mix")["config"] == "y"
    (tmp_path / "model").write_bytes(b"weights")
    digest = io.file_sha256(str(tmp_path / "model"))
    assert io.verified_model(str(tmp_path / "model"), digest, lambda p: p).endswith("model")
    with pytest.raises(ValueError):
        io.verified_model(str(tmp_path / "model"), "0" * 64, lambda p: p)


def test_streaming_popularity_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_type")
    (tmp_path / "in").mkdir()
    events.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in" / "*"))
    q = windowed_popularity(stream, ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("pop").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("pop")) == rows(windowed_popularity(events, ["event_type"]))
