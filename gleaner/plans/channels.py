"""Retrieval channels and the final pipeline.

Items are (item_id, category, location, title, params, description) rows, queries
(query_id, category, location, query, params). Channels return (query_id, item_id, score, rank).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.stemming import normalize_tokens
from gleaner.functions.text import char_wb_ngrams, compose_item, compose_query, normalize_text, tokens, word_ngrams
from gleaner.functions.vectors import sum_pool
from gleaner.operators.blocks import Cut, retrieve_terms, term_statistics
from gleaner.operators.fusion import FINAL, LOCATION_BONUS, mean_minmax, reciprocal_rank, select_fused, union_channels
from gleaner.operators.retrieval import POOL, retrieve_dense, retrieve_sparse
from gleaner.operators.vocabulary import build_vocabulary, document_lengths, gram_postings, postings, term_frequencies
from gleaner.operators.weights import bm25_postings, binary_query_terms, tfidf_weights
from gleaner.sources.scratch import scratch


@dataclass(frozen=True)
class Sparse:
    """What a sparse channel is made of."""

    kind: str = "word"  # word or char
    low: int = 1
    high: int = 1
    variant: str = "all_text"
    weighted: bool = False
    min_df: int = 2
    max_df: float = 0.99
    max_features: int | None = 200_000
    scoring: str = "bm25"  # bm25 or tfidf
    words: str = "plain"  # plain, snowball or lemma


WORD = Sparse()
CHAR = Sparse(kind="char", low=4, high=4, max_df=1.0, max_features=150_000)


def _terms(text: Column, spec: Sparse) -> Column:
    if spec.kind == "char":
        return char_wb_ngrams(text, spec.low, spec.high)
    return word_ngrams(tokens(text), spec.low, spec.high)


def _item_text(spec: Sparse) -> Column:
    parts = {c: normalize_text(F.col(c)) for c in ("title", "params", "description")}
    return compose_item(spec.variant, parts, spec.weighted)


def item_terms(items: DataFrame, spec: Sparse) -> DataFrame:
    return items.select("item_id", "category", _terms(_item_text(spec), spec).alias("terms"))


def item_postings(items: DataFrame, spec: Sparse, lemmas: DataFrame | None = None) -> DataFrame:
    """(item_id, category, term, tf), from one pass over the texts."""
    if spec.kind == "char":
        words = F.filter(F.split(_item_text(spec), " "), lambda w: F.length(w) > 0)
        docs = items.select("item_id", "category", words.alias("terms"))
        return gram_postings(docs, char_wb_ngrams(F.col("term"), spec.low, spec.high))
    if spec.words == "plain":
        return postings(item_terms(items, spec))
    plain = Sparse(kind="word", variant=spec.variant, weighted=spec.weighted)
    docs = item_terms(items, plain)
    if spec.high == 1:  # forms of a document's different tokens
        formed = normalize_tokens(postings(docs).withColumnRenamed("term", "token"), spec.words, lemmas)
        formed = formed.filter(F.length("token") > 1).groupBy("item_id", "category", F.col("token").alias("term"))
        return formed.agg(F.sum("tf").alias("tf"))
    docs = with_word_forms(docs, "item_id", spec.words, lemmas)
    return postings(docs.withColumn("terms", word_ngrams(F.col("terms"), spec.low, spec.high)))


def query_terms(queries: DataFrame, spec: Sparse) -> DataFrame:
    text = compose_query(spec.variant, normalize_text(F.col("query")), normalize_text(F.col("params")), spec.weighted)
    return queries.select("query_id", "category", _terms(text, spec).alias("terms"))


def with_word_forms(rows: DataFrame, key: str, mode: str, lemmas: DataFrame | None = None) -> DataFrame:
    """`terms` arrays with every word in its stem or lemma, in the same order."""
    if mode == "plain":
        return rows
    each = rows.select(key, F.posexplode("terms").alias("at", "token"))
    formed = normalize_tokens(each, mode, lemmas).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("x"))
    # words of one letter vanish, as a vectoriser that reads the joined text again would drop them
    formed = formed.select(F.col(key).alias("f_key"), F.filter(F.col("x.token"), lambda t: F.length(t) > 1).alias("formed"))
    joined = rows.join(formed, F.col(key) == F.col("f_key"), "left")
    return joined.select(*[F.coalesce("formed", "terms").alias("terms") if c == "terms" else rows[c] for c in rows.columns])


@dataclass(frozen=True)
class Index:
    """A sparse channel's postings, vocabulary (term, df, cf) and lengths (item_id, len), and the number of documents."""

    postings: DataFrame
    vocabulary: DataFrame
    lengths: DataFrame
    n_docs: int


def build_index(items: DataFrame, spec: Sparse = WORD, lemmas: DataFrame | None = None) -> Index:
    """Postings, terms and lengths, each written out once, whatever the ids are."""
    n = items.count()
    rows = scratch(item_postings(items, spec, lemmas), "postings")
    vocabulary = scratch(build_vocabulary(scratch(term_frequencies(rows), "terms"), n, spec.min_df, spec.max_df, spec.max_features), "vocabulary")
    return Index(rows, vocabulary, scratch(document_lengths(rows, vocabulary), "lengths"), n)


def _merged(rows: DataFrame, key: str) -> DataFrame:
    """Term rows of postings."""
    cells = rows.groupBy(key, "category").agg(F.collect_list(F.struct("term", "tf")).alias("x"))
    return cells.select(key, "category", F.col("x.term").alias("terms"), F.col("x.tf").cast("array<long>").alias("tf"))


def repeated_ids(rows: DataFrame, key: str) -> tuple[DataFrame, bool, bool]:
    """The ids of several rows, whether there are any, and whether one has several categories."""
    c, null = F.col("category"), F.count_if(F.col("category").isNull())
    per = rows.groupBy(F.col(key).alias("r_id")).agg(F.count("*").alias("n"), ((F.min(c) != F.max(c)) | ((null > 0) & (null < F.count("*")))).alias("mixed"))
    ids = scratch(per.filter("n > 1").select("r_id", F.coalesce("mixed", F.lit(False)).alias("mixed")), "repeated")
    found = ids.agg(F.count("*").alias("n"), F.coalesce(F.max("mixed"), F.lit(False)).alias("mixed")).first()
    return ids, found["n"] > 0, found["mixed"]


def _words(rows: DataFrame, key: str, text: Column, spec: Sparse) -> DataFrame:
    words = F.filter(F.split(text, " "), lambda w: F.length(w) > 0) if spec.kind == "char" else tokens(text)
    return rows.select(key, "category", words.alias("terms"), F.lit(None).cast("array<long>").alias("tf"))


def text_rows(items: DataFrame, spec: Sparse) -> DataFrame:
    """A term row for each text, whatever its id."""
    return _words(items, "item_id", _item_text(spec), spec)


def term_rows(items: DataFrame, spec: Sparse, lemmas: DataFrame | None = None) -> DataFrame | None:
    """Term rows (see operators.blocks) of items, one for each id; none if an id has several categories.

    A text's words stay in its row: only texts whose id is repeated, and words that are replaced by stems or lemmas, are shuffled."""
    ids, some, mixed = repeated_ids(items, "item_id")
    if mixed:
        return None
    if spec.words != "plain":
        return scratch(_merged(item_postings(items, spec, lemmas), "item_id"), "terms")
    if not some:
        return text_rows(items, spec)
    same = F.col("item_id").eqNullSafe(F.col("r_id"))
    again = scratch(_merged(item_postings(items.join(ids, same, "left_semi"), spec), "item_id"), "repeated-terms")
    return text_rows(items.join(ids, same, "left_anti"), spec).unionByName(again)


def _cut(spec: Sparse) -> Cut:
    return Cut(spec.kind, spec.low, spec.high)


def build_vocabulary_of(rows: DataFrame, spec: Sparse, n: int) -> DataFrame:
    """The vocabulary of term rows: one pass over the texts."""
    terms = scratch(term_statistics(rows, _cut(spec)).filter(F.col("df") >= spec.min_df), "terms")
    return scratch(build_vocabulary(terms, n, spec.min_df, spec.max_df, spec.max_features), "vocabulary")


def vocabulary(items: DataFrame, spec: Sparse = WORD) -> tuple[DataFrame, int]:
    """(term, df, cf) of a channel, and the number of documents."""
    n, rows = items.count(), term_rows(items, spec)
    return (build_vocabulary_of(rows, spec, n), n) if rows is not None else (build_index(items, spec).vocabulary, n)


def sparse_channel(items: DataFrame, queries: DataFrame, spec: Sparse = WORD, k: int = POOL, lemmas: DataFrame | None = None) -> DataFrame:
    """The k best items of each query by BM25 or TF-IDF over one composition of the texts."""
    if spec.words == "plain":
        asked = query_terms(queries, spec)
    else:
        asked = with_word_forms(query_terms(queries, Sparse(kind="word", variant=spec.variant, weighted=spec.weighted)), "query_id", spec.words, lemmas)
        asked = asked.withColumn("terms", word_ngrams(F.col("terms"), spec.low, spec.high))
    rows = term_rows(items, spec, lemmas)
    _, repeated, mixed = repeated_ids(queries, "query_id")
    if rows is None or mixed:
        return _channel_by_postings(items, asked, spec, k, lemmas)
    if repeated or spec.words != "plain":
        asked = _merged(postings(asked, ("query_id", "category")), "query_id")
    else:
        text = compose_query(spec.variant, normalize_text(F.col("query")), normalize_text(F.col("params")), spec.weighted)
        asked = _words(queries, "query_id", text, spec)
    n = items.count()
    return scratch(retrieve_terms(rows, asked, build_vocabulary_of(rows, spec, n), n, _cut(spec), spec.scoring, k), "candidates")


def _channel_by_postings(items: DataFrame, asked: DataFrame, spec: Sparse, k: int, lemmas: DataFrame | None = None) -> DataFrame:
    """The same by joins of written postings, for ids that stand in several categories, whose scores are sums over them."""
    index = build_index(items, spec, lemmas)
    if spec.scoring == "tfidf":
        q = tfidf_weights(postings(asked, ("query_id", "category")), index.vocabulary, index.n_docs, ("query_id", "category"))
        return retrieve_sparse(q, tfidf_weights(index.postings, index.vocabulary, index.n_docs), k)
    q = binary_query_terms(asked, index.vocabulary)
    return retrieve_sparse(q, bm25_postings(index.postings, index.vocabulary, index.lengths, index.n_docs, q), k)


def token_vectors(texts: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """(key, category, vector) of (key, category, text) rows; a text without known tokens has a vector of zeros."""
    rows = texts.select(key, F.explode(tokens(normalize_text(F.col("text")))).alias("token"))
    pooled = sum_pool(rows, vectors, key)
    return texts.select(key, "category").join(pooled, key, "left")


def dense_channel(items: DataFrame, queries: DataFrame, vectors: DataFrame, k: int = POOL, field: str = "title") -> DataFrame:
    """Cosine of summed token vectors; items without any known token are left out, as they score 0."""
    q = token_vectors(queries.select("query_id", "category", F.col("query").alias("text")), vectors, "query_id").filter("vector is not null")
    i = token_vectors(items.select("item_id", "category", F.col(field).alias("text")), vectors, "item_id").filter("vector is not null")
    return scratch(retrieve_dense(q, scratch(i, "vectors"), k), "candidates")


def fuse(channels: dict[str, DataFrame], queries: DataFrame, items: DataFrame, method: str = "mean_minmax", bonus: float = LOCATION_BONUS, k: int = FINAL) -> DataFrame:
    both = union_channels(channels)
    scores = mean_minmax(both, len(channels)) if method == "mean_minmax" else reciprocal_rank(both)
    return select_fused(scores, queries, items, bonus, k)


def final_pipeline(items: DataFrame, queries: DataFrame, vectors: DataFrame, method: str = "mean_minmax", bonus: float = LOCATION_BONUS, k: int = FINAL, pool: int = POOL, lemmas: DataFrame | None = None) -> DataFrame:
    """Word BM25, character BM25 and dense cosine, fused with the location bonus: the k best items of each query."""
    word = Sparse(words="lemma") if lemmas is not None else WORD
    channels = {
        "word": sparse_channel(items, queries, word, pool, lemmas),
        "char": sparse_channel(items, queries, CHAR, pool),
        "dense": dense_channel(items, queries, vectors, pool),
    }
    return fuse(channels, queries, items, method, bonus, k)
