"""The driver's tables in the roles that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import normalize_text, tokens
from gleaner.sources.io import read_table, spread
from gleaner.sources.scratch import scratch

DIMENSIONS = 16


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", list(columns) or None)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items: the first line is the title, the rest the description; the parameters name the source."""
    d = spread(load(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"), "doc_id")
    title = F.substring_index("text", "\n", 1)
    return d.select(
        F.col("doc_id").alias("item_id"), F.col("lang").alias("category"), F.col("source").alias("location"),
        title.alias("title"), F.coalesce("source", F.lit("")).alias("params"), F.col("text").substr(F.length(title) + 2, F.length("text")).alias("description"),
    )


def known_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search's stated query set: every document whose id is divisible by 100 asks with its title and parameters."""
    d = items(spark, sf_dir).filter(F.col("item_id") % 100 == 0)
    return d.select(F.col("item_id").alias("query_id"), "category", "location", F.col("title").alias("query"), "params")


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, item_id): documents with the query document's very text."""
    d = load(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("digest"))
    q = d.filter(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), F.col("digest").alias("q_digest"))
    return d.join(q, F.col("digest") == F.col("q_digest")).select("query_id", F.col("doc_id").alias("item_id"))


def hashed_vectors(texts: DataFrame) -> DataFrame:
    """(token, vector) for the tokens of `text`: a stand-in for a trained model, with numbers from the token's MD5."""
    words = texts.select(F.explode(tokens(normalize_text(F.col("text")))).alias("token")).distinct()
    digest = F.md5(F.col("token").cast("binary"))
    numbers = [(F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("double") - 127.5) / 127.5 for i in range(DIMENSIONS)]
    return words.select("token", F.array(*numbers).alias("vector"))


def title_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scratch(hashed_vectors(items(spark, sf_dir).select(F.col("title").alias("text"))), "token-vectors")


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as clicks: customer, part, return flag (category) and line status (location)."""
    lines = load(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_returnflag", "l_linestatus")
    orders = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.select(F.col("o_custkey").alias("customer"), F.col("l_partkey").alias("item_id"), F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("location"))
