"""One query for each operator, over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.stemming import stem_tokens
from gleaner.functions.text import char_wb_ngrams, coverage, hyphen_tokens, normalize_basic, normalize_text, stable_hash, tokens, word_ngrams
from gleaner.functions.vectors import l2_normalize
from gleaner.operators import evaluation, fusion, popularity, profile, submission
from gleaner.operators.blocks import Cut, term_statistics
from gleaner.operators.grid import evaluate_grid
from gleaner.operators.ranking import top_k
from gleaner.operators.retrieval import retrieve_dense, target_category
from gleaner.operators.vocabulary import corpus_stats, gram_counts
from gleaner.plans import channels, tables
from gleaner.plans.channels import CHAR, WORD, Sparse
from gleaner.sources.io import fingerprint
from gleaner.sources.scratch import scratch
from gleaner.streaming.popularity import windowed_popularity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: The published blend takes TF-IDF over titles.
TITLE_TFIDF = Sparse(scoring="tfidf", variant="title", max_df=1.0)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def shown(c: Column | str) -> Column:
    """Scores as they are compared: six digits."""
    return F.round(c, 6)


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "item_id", shown("score").alias("score"), "rank")


def _channel(spark: SparkSession, sf: str, spec: Sparse, k: int = 500) -> DataFrame:
    return channels.sparse_channel(tables.items(spark, sf), tables.known_items(spark, sf), spec, k)


# --- channels ---


@query
def word_bm25_topk(spark, sf):
    return _ranked(_channel(spark, sf, WORD, 50))


@query
def word_tfidf_topk(spark, sf):
    return _ranked(_channel(spark, sf, Sparse(scoring="tfidf", max_df=1.0), 50))


@query
def word_bigram_bm25_topk(spark, sf):
    return _ranked(_channel(spark, sf, Sparse(high=2), 50))


@query
def weighted_composition_tfidf_topk(spark, sf):
    return _ranked(_channel(spark, sf, Sparse(scoring="tfidf", weighted=True), 50))


@query
def char_bm25_topk(spark, sf):
    return _ranked(_channel(spark, sf, CHAR, 50))


@query
def dense_cosine_topk(spark, sf):
    e = tables.load(spark, sf, "embeddings").select("vec_id", F.col("label").alias("category"), l2_normalize(F.col("embedding")).alias("vector"))
    q = e.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "category", "vector")
    return _ranked(retrieve_dense(q, e.withColumnRenamed("vec_id", "item_id"), 50))


@query
def pooled_cosine_topk(spark, sf):
    return _ranked(channels.dense_channel(tables.items(spark, sf), tables.known_items(spark, sf), tables.title_vectors(spark, sf), 50))


def _three(spark, sf) -> dict[str, DataFrame]:
    i, q = tables.items(spark, sf), tables.known_items(spark, sf)
    return {"word": channels.sparse_channel(i, q, WORD), "char": channels.sparse_channel(i, q, CHAR), "dense": channels.dense_channel(i, q, tables.title_vectors(spark, sf))}


@query
def fusion_mean_minmax(spark, sf):
    return _ranked(channels.fuse(_three(spark, sf), tables.known_items(spark, sf), tables.items(spark, sf)))


@query
def fusion_rrf(spark, sf):
    return _ranked(channels.fuse(_three(spark, sf), tables.known_items(spark, sf), tables.items(spark, sf), "rrf"))


@query
def fusion_no_bonus(spark, sf):
    return _ranked(channels.fuse(_three(spark, sf), tables.known_items(spark, sf), tables.items(spark, sf), bonus=0.0))


@query
def location_boost(spark, sf):
    scores = fusion.location_boost(_channel(spark, sf, WORD).select("query_id", "item_id", "score"), tables.known_items(spark, sf), tables.items(spark, sf), 0.5)
    return _ranked(top_k(scores, 50))


@query
def weighted_blend(spark, sf):
    blend = fusion.weighted_blend(_channel(spark, sf, TITLE_TFIDF), _channel(spark, sf, CHAR), 0.25)
    return _ranked(top_k(blend, 50))


@query
def grid_eval(spark, sf):
    g = evaluate_grid(_channel(spark, sf, WORD), _channel(spark, sf, CHAR), tables.known_items(spark, sf), tables.items(spark, sf), tables.relevance(spark, sf), [0.0, 0.25, 1.0], [0.0, 0.5])
    return g.select("weight", "bonus", "queries", shown("recall").alias("recall"), "queries_with_hit")


# --- vocabulary ---


@query
def vocabulary_prune(spark, sf):
    return channels.vocabulary(tables.items(spark, sf))[0]


@query
def bm25_stats(spark, sf):
    vocabulary, n = channels.vocabulary(tables.items(spark, sf))
    s = corpus_stats(vocabulary.select(F.col("cf").alias("len")), vocabulary, n)  # lengths add up to what the terms do
    return s.select("n_docs", "n_terms", "nnz", *[shown(c).alias(c) for c in ("avg_len", "idf_min", "idf_max")])


# --- text ---


@query
def normalized_text(spark, sf):
    d = tables.load(spark, sf, "documents", "doc_id", "text")
    n, b = normalize_text(F.col("text")), normalize_basic(F.col("text"))
    return d.select("doc_id", F.md5(n.cast("binary")).alias("normalized"), F.length(n).cast("long").alias("n_chars"), F.length(b).cast("long").alias("n_basic"), F.octet_length(n).cast("long").alias("n_bytes"))


@query
def token_counts(spark, sf):
    d = tables.load(spark, sf, "documents", "doc_id", "text")
    t = tokens(normalize_text(F.col("text")))
    return d.select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.size(hyphen_tokens(F.col("text"))).cast("long").alias("n_hyphen"))


@query
def word_bigram_counts(spark, sf):
    d = channels.text_rows(tables.items(spark, sf), Sparse(low=2, high=2))
    return term_statistics(d, Cut("word", 2, 2)).filter("cf >= 2").select(F.col("term").alias("gram"), F.col("cf").alias("n"))


@query
def char_wb_counts(spark, sf):
    words = F.filter(F.split(normalize_text(F.concat_ws(" ", "title", "description")), " "), lambda w: F.length(w) > 0)
    return gram_counts(tables.items(spark, sf).select(words.alias("terms")), char_wb_ngrams(F.col("term"), 3, 4)).select(F.col("term").alias("gram"), "n")


@query
def stable_hashes(spark, sf):
    return tables.load(spark, sf, "documents", "doc_id", "source").select("doc_id", stable_hash(F.concat_ws("|", "source", F.col("doc_id").cast("string"))).alias("digest"))


@query
def token_coverage(spark, sf):
    i = tables.items(spark, sf)
    return i.select("item_id", shown(coverage(hyphen_tokens(F.col("title")), hyphen_tokens(F.col("description")))).alias("coverage"))


@query
def snowball_stem(spark, sf):
    d = tables.load(spark, sf, "documents", "text")
    return stem_tokens(d.select(F.explode(tokens(normalize_text(F.col("text")))).alias("token")).distinct())


@query
def l2_normalized(spark, sf):
    e = tables.load(spark, sf, "embeddings", "vec_id", "embedding")
    return e.select("vec_id", F.posexplode(l2_normalize(F.col("embedding"))).alias("i", "x")).groupBy("vec_id").agg(shown(F.sum(F.col("x") * (F.col("i") + 1))).alias("checksum"))


@query
def category_remap(spark, sf):
    return tables.load(spark, sf, "embeddings", "vec_id", "label").select("vec_id", target_category(F.col("label")).alias("category"))


# --- popularity and history ---


@query
def popularity_global(spark, sf):
    return popularity.popular(tables.clicks(spark, sf), [])


@query
def popularity_by_category(spark, sf):
    return popularity.popular(tables.clicks(spark, sf), ["category"])


@query
def popularity_by_category_location(spark, sf):
    return popularity.popular(tables.clicks(spark, sf), ["category", "location"])


@query
def query_history_priority(spark, sf):
    c = tables.clicks(spark, sf)
    asked = tables.load(spark, sf, "customer", "c_custkey").select(F.col("c_custkey").alias("query_id"))
    asked = asked.withColumn("category", F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("query_id") % 3 + 1).cast("int")))
    own = popularity.listed(popularity.popular(c, ["customer"]).withColumnRenamed("customer", "query_id"), ["query_id"])
    near, overall = (scratch(popularity.listed(popularity.popular(c, by), by), "popular") for by in (["category"], []))
    return popularity.lists_by_priority(asked, [(own, ["query_id"]), (near, ["category"]), (overall, [])])


@query
def fallback_fill(spark, sf):
    """A channel of rare title words, as one over whole texts leaves hardly any query without candidates."""
    i, q = tables.items(spark, sf), tables.known_items(spark, sf)
    found = _channel(spark, sf, Sparse(variant="title", min_df=6, max_df=0.9), 50)
    return _ranked(popularity.fill_empty(found, q, i, 50))


@query
def history_counts(spark, sf):
    o = tables.load(spark, sf, "orders", "o_custkey")
    c = tables.load(spark, sf, "customer", "c_custkey").select(F.col("c_custkey").alias("o_custkey"))
    return popularity.history_counts(c, o, "o_custkey").select("o_custkey", "history_rows")


@query
def history_anti_join(spark, sf):
    o = tables.load(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    held = o.filter(F.col("o_orderstatus") == "P")
    return popularity.remove_signatures(o, held, ["o_custkey", "o_orderpriority"]).select("o_orderkey", "o_custkey", "o_orderpriority")


@query
def history_text_anti_join(spark, sf):
    o = tables.load(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    return popularity.remove_texts(o, o.filter(F.col("o_orderstatus") == "P"), "o_custkey").select("o_custkey", "o_orderkey")


# --- evaluation ---


def _joined(c: str) -> Column:
    return F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), " ")


@query
def signature_positives(spark, sf):
    s = evaluation.signatures(tables.clicks(spark, sf), ["customer", "category"])
    return s.select("customer", "category", F.size("positives").cast("long").alias("n"), _joined("positives").alias("positives"))


def _named_clicks(spark, sf) -> DataFrame:
    part = tables.load(spark, sf, "part", "p_partkey", "p_name", "p_brand")
    lines = tables.load(spark, sf, "lineitem", "l_partkey", "l_suppkey")
    return lines.join(part, lines.l_partkey == part.p_partkey).select("p_name", "p_brand", F.col("l_suppkey").alias("item_id"))


def _split(spark, sf, mode: str, size: int = 40) -> DataFrame:
    held = evaluation.hash_split(_named_clicks(spark, sf), ["p_name", "p_brand"], mode, size, normalize_text(F.col("p_name")))
    return held.select("text", "p_brand", F.size("positives").cast("long").alias("n"), _joined("positives").alias("positives"))


@query
def hash_split_cold(spark, sf):
    return _split(spark, sf, "cold")


@query
def hash_split_warm(spark, sf):
    return _split(spark, sf, "warm")


@query
def hash_split_cold_2500(spark, sf):
    """As many texts as the reference's experiments hold out."""
    return _split(spark, sf, "cold", 2500)


@query
def hash_split_warm_2500(spark, sf):
    return _split(spark, sf, "warm", 2500)


def _recalls(spark, sf) -> DataFrame:
    return evaluation.recall_at_k(_channel(spark, sf, WORD, 50), tables.relevance(spark, sf))


@query
def recall_at_k(spark, sf):
    return _recalls(spark, sf).select("query_id", "hits", "relevant", shown("recall").alias("recall"))


@query
def recall_summary(spark, sf):
    return evaluation.summarize(_recalls(spark, sf)).select("queries", shown("recall").alias("recall"), "queries_with_hit")


@query
def pool_recall(spark, sf):
    """Recall of each channel's pool and of their union."""
    return evaluation.pool_recalls(fusion.union_channels(_three(spark, sf)), tables.relevance(spark, sf), ["word", "char", "dense"]).select("pool", "queries", shown("recall").alias("recall"), "queries_with_hit")


@query
def mode_mixture_pivot(spark, sf):
    e = tables.load(spark, sf, "events", "event_type", "user_id", "value")
    m = e.withColumn("mode", F.when(F.col("user_id") % 2 == 0, "cold").otherwise("warm"))
    out = evaluation.mode_mixture(m, ["event_type"], "value")
    return out.select("event_type", *[shown(c).alias(c) for c in ("cold", "warm", "mix")])


@query
def pairwise_delta(spark, sf):
    o = tables.load(spark, sf, "orders", "o_orderpriority", "o_orderstatus", "o_totalprice")
    out = evaluation.pairwise_delta(o, ["o_orderpriority"], "o_orderstatus", "F", "O", "o_totalprice")
    return out.select("o_orderpriority", *[F.round(c, 4).alias(n) for c, n in (("F", "status_f"), ("O", "status_o"), ("delta", "delta"))])


@query
def best_config(spark, sf):
    e = tables.load(spark, sf, "events", "user_id", "event_type", "value").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("mix"))
    return evaluation.best_config(e, ["user_id", "event_type"])


@query
def bootstrap_recall(spark, sf):
    e = tables.load(spark, sf, "labels", "doc_id", "quality").select(F.col("doc_id").alias("query_id"), F.col("quality").cast("double").alias("recall"))
    s = evaluation.bootstrap_summary(evaluation.hashed_weights(e, 10, evaluation.BOOTSTRAP_SEEDS["cold"]))
    return s.select(*[shown(c).alias(c) for c in ("mean", "std", "low", "high")])


@query
def bootstrap_recall_multinomial(spark, sf):
    """As published: each run draws as many queries as there are, with replacement, by NumPy's generator; sums are divided by their
    number. `bootstrap_recall` has weights from hashes instead, which SQL can repeat."""
    e = tables.load(spark, sf, "labels", "doc_id", "quality").select(F.col("doc_id").alias("query_id"), F.col("quality").cast("double").alias("recall"))
    return evaluation.bootstrap(e, 10, evaluation.BOOTSTRAP_SEEDS["cold"]).select(*[shown(c).alias(c) for c in ("mean", "std", "low", "high")])


@query
def random_negatives(spark, sf):
    i = tables.items(spark, sf).select("item_id", "category")
    q = tables.load(spark, sf, "documents", "doc_id", "lang").select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("item_id"), F.col("lang").alias("category"))
    return evaluation.random_negatives(q, i)


# --- profile ---


@query
def column_profile(spark, sf):
    return profile.column_profile(tables.load(spark, sf, "customer"))


@query
def quantiles(spark, sf):
    d = tables.load(spark, sf, "documents", "text")
    return profile.quantiles(d, F.length(F.coalesce("text", F.lit(""))).cast("double"))


@query
def value_counts(spark, sf):
    return profile.value_counts(tables.load(spark, sf, "documents", "lang"), "lang")


@query
def group_counts(spark, sf):
    return profile.group_counts(tables.clicks(spark, sf), ["customer"], "item_id")


@query
def match_rates(spark, sf):
    o = tables.load(spark, sf, "lineitem", "l_returnflag", "l_linestatus", "l_partkey", "l_suppkey")
    out = profile.match_rates(o, {"flag_is_status": ("l_returnflag", "l_linestatus"), "part_is_supplier": ("l_partkey", "l_suppkey")})
    return out.select(*[shown(c).alias(c) for c in out.columns])


@query
def overlap_counts(spark, sf):
    return profile.overlap(tables.load(spark, sf, "documents", "doc_id"), tables.load(spark, sf, "labels", "doc_id"), "doc_id")


@query
def malformed_ids(spark, sf):
    return profile.malformed_ids(tables.load(spark, sf, "customer", "c_custkey", "c_name"), "c_name", "^Customer#[0-9]*[02468]$")


@query
def first_row_distinct(spark, sf):
    o = tables.load(spark, sf, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    return profile.first_rows(o, "o_custkey", [F.col("o_totalprice"), F.col("o_orderkey")])


def _pairs(spark, sf) -> DataFrame:
    i, lab = tables.items(spark, sf), tables.load(spark, sf, "labels", "doc_id", "quality", "toxic")
    p = i.join(lab, i.item_id == lab.doc_id, "left")
    # two words of the description and one of the title ask for an item of source src0
    asked = F.concat(F.substring_index("description", " ", 2), F.lit(" "), F.substring_index("title", " ", 1))
    return p.select(
        "item_id", asked.alias("query"), F.concat(F.lit("src0 "), F.coalesce("category", F.lit(""))).alias("query_params"), F.col("category").alias("query_category"), F.lit("src0").alias("query_location"),
        F.col("title"), F.col("params"), F.col("description"), F.lit("en").alias("item_category"), F.col("location").alias("item_location"),
        F.length("description").alias("reviews"), F.col("quality").alias("item_rating"), (F.col("toxic") == 1).alias("phone_hidden"), F.col("quality").isNull().alias("message_forbidden"), F.length("title").alias("clicks"), "quality",
    )


@query
def pair_features(spark, sf):
    return profile.pair_features(_pairs(spark, sf)).select("item_id", *[shown(f).alias(f) for f in profile.FEATURES])


@query
def feature_label_corr(spark, sf):
    rows = profile.pair_features(_pairs(spark, sf)).filter("quality is not null")
    out = profile.separation(rows, ["title_query_coverage", "category_match", "location_match", "log_reviews", "log_train_click_frequency"], "quality")
    return out.select("feature", *[shown(c).alias(c) for c in ("mean_positive", "mean_negative", "difference", "correlation")])


@query
def zero_vector_count(spark, sf):
    return profile.zero_vectors(tables.load(spark, sf, "embeddings", "embedding"), "embedding")


# --- answers, sources, streams ---


@query
def submission_format(spark, sf):
    return submission.build_submission(_channel(spark, sf, WORD, 50), tables.known_items(spark, sf))


@query
def submission_violations(spark, sf):
    c = tables.clicks(spark, sf)
    answer = c.groupBy("customer").agg(F.array_join(F.transform(F.array_sort(F.collect_list("item_id")), lambda x: x.cast("string")), " ").alias("answer"))
    answer = answer.select(F.col("customer").cast("string").alias("query_id"), "answer")
    asked = tables.load(spark, sf, "customer", "c_custkey").select(F.col("c_custkey").alias("query_id"))
    known = tables.load(spark, sf, "part", "p_partkey", "p_size").filter("p_size < 49").select(F.col("p_partkey").alias("item_id"))
    return submission.violations(answer, asked, known, "^[0-9]{1,3}$", 3, 45)


@query
def data_fingerprint(spark, sf):
    d = tables.load(spark, sf, "documents", "doc_id", "text")
    return spark.sql(f"SELECT '{fingerprint(d)}' AS fingerprint, {d.count()} AS n")


@query
def windowed_events(spark, sf):
    return windowed_popularity(tables.load(spark, sf, "events", "ts", "event_type"), ["event_type"])
