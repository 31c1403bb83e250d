"""Vocabularies and term statistics over postings: (item_id, category, term, tf) rows.

Postings are made once, in one pass over the texts, and written out (see plans.channels.build_index); all statistics are sums over
them. Statistics cover the whole corpus; what is weighted can then be limited to the terms that queries ask for, which changes
no score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def postings(docs: DataFrame, keys: tuple[str, ...] = ("item_id", "category")) -> DataFrame:
    """(keys, term, tf) of documents with `terms` arrays."""
    return docs.select(*keys, F.explode("terms").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def gram_postings(docs: DataFrame, grams: Column, keys: tuple[str, ...] = ("item_id", "category")) -> DataFrame:
    """(keys, term, tf) of the grams within words: `terms` are words, and `grams` an array made of one word in column `term`. A
    document's equal words are cut into grams once."""
    each = postings(docs, keys).select(*keys, "tf", F.explode(grams).alias("term"))
    return each.groupBy(*keys, "term").agg(F.sum("tf").alias("tf"))


def gram_counts(docs: DataFrame, grams: Column) -> DataFrame:
    """(term, n): how often the grams within words occur in all documents. Words are counted over the corpus first, so that a row
    for each different word and task is dealt out, and each word is cut once."""
    words = docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("words"))
    return words.select("words", F.explode(grams).alias("term")).groupBy("term").agg(F.sum("words").alias("n"))


def term_frequencies(rows: DataFrame) -> DataFrame:
    """(term, df, cf): in how many documents a term occurs, and how often."""
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def build_vocabulary(terms: DataFrame, n_docs: int, min_df: int = 2, max_df: float = 1.0, max_features: int | None = None) -> DataFrame:
    """(term, df, cf) of the terms that stay: in at least min_df documents and at most a share max_df of them, and
    of those the max_features most frequent in the corpus, ties by term."""
    kept = terms.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    return most_frequent(kept, max_features) if max_features else kept


def most_frequent(terms: DataFrame, k: int) -> DataFrame:
    """The k terms of largest cf, ties by term, without sorting them all: how many terms have each cf (one row for
    each different value) shows the cf at which the k-th lies; only the terms of that cf are put in order. One plan, no jobs."""
    sizes = terms.groupBy("cf").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("cf")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = sizes.withColumn("before", before).filter(F.col("before") < k).groupBy().agg(F.min("cf").alias("edge"), F.max("before").alias("above"))
    # all terms above the edge; at the edge as many as are left, if they are too many
    rows = terms.join(F.broadcast(edge))  # one row
    ties = rows.filter(F.col("cf") == F.col("edge")).withColumn("place", F.row_number().over(Window.partitionBy("cf").orderBy("term"))).filter(F.col("place") + F.col("above") <= k)
    return rows.filter(F.col("cf") > F.col("edge")).select("term", "df", "cf").unionByName(ties.select("term", "df", "cf"))


def document_lengths(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(item_id, len): occurrences of vocabulary terms; documents without any are absent."""
    return rows.join(vocabulary.select("term"), "term", "left_semi").groupBy("item_id").agg(F.sum("tf").alias("len"))


def corpus_stats(lengths: DataFrame, vocabulary: DataFrame, n_docs: int) -> DataFrame:
    """One row (n_docs, n_terms, nnz, avg_len, idf_min, idf_max): lengths count terms of the vocabulary, over all documents,
    empty ones too; idf as BM25 has it."""
    idf = lambda df: F.log1p((n_docs - df + 0.5) / (df + 0.5))
    v = vocabulary.agg(F.count("*").alias("n_terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("nnz"), idf(F.max("df")).alias("idf_min"), idf(F.min("df")).alias("idf_max"))
    total = lengths.agg(F.try_divide(F.coalesce(F.sum("len"), F.lit(0)), F.lit(n_docs)).alias("avg_len"))
    return v.join(F.broadcast(total)).select(F.lit(n_docs).cast("long").alias("n_docs"), "n_terms", "nnz", "avg_len", "idf_min", "idf_max")  # one row each


def counts(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings of the vocabulary's terms, with `df`."""
    return rows.join(vocabulary.select("term", "df"), "term")
