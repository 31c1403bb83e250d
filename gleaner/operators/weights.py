"""TF-IDF and Okapi BM25 weights of postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.vocabulary import counts

K1, B = 1.5, 0.75


def bm25_postings(rows: DataFrame, vocabulary: DataFrame, lengths: DataFrame, n_docs: int, only: DataFrame | None = None) -> DataFrame:
    """(item_id, category, term, weight), for the terms of `only` if it is given.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)); the weight is idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len / avg_len)).
    Lengths, their mean and N span the whole corpus, whatever `only` and the categories are.
    """
    wanted = vocabulary if only is None else vocabulary.join(only.select("term").distinct(), "term", "left_semi")
    mean = lengths.agg((F.sum("len") / F.lit(n_docs)).alias("avg"))
    tf = counts(rows, wanted).join(lengths, "item_id").join(F.broadcast(mean))  # one row
    idf = F.log1p((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg"))
    return tf.select("item_id", "category", "term", (idf * F.col("tf") * (K1 + 1) / norm).alias("weight"))


def tfidf_weights(rows: DataFrame, vocabulary: DataFrame, n_docs: int, keys: tuple[str, ...] = ("item_id", "category")) -> DataFrame:
    """(keys, term, weight): (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1), divided by the row's L2 norm."""
    raw = counts(rows, vocabulary).withColumn("raw", (1 + F.log("tf")) * (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1))
    norms = raw.groupBy(keys[0]).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm")).withColumnRenamed(keys[0], "n_key")
    return raw.join(norms, F.col(keys[0]) == F.col("n_key")).select(*keys, "term", (F.col("raw") / F.col("norm")).alias("weight"))


def binary_query_terms(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(query_id, category, term, weight = 1): each known term of a query counts once, also if the query's id is repeated."""
    terms = queries.select("query_id", "category", F.explode(F.array_distinct("terms")).alias("term")).distinct()
    return terms.join(vocabulary.select("term"), "term", "left_semi").withColumn("weight", F.lit(1.0))
