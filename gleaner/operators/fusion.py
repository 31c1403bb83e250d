"""Fusing the candidates of several channels: (channel, query_id, item_id, score, rank) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.ranking import top_k

LOCATION_BONUS, RRF_K, FINAL = 0.5, 60, 50
#: A span of scores no larger than this counts as none (the least step of a 32-bit float at 1).
LEAST_SPAN = 1.1920928955078125e-07


def minmax(candidates: DataFrame, by: tuple[str, ...] = ("channel", "query_id")) -> DataFrame:
    """Scores moved to 0..1 within each channel and query; without a span all are 0."""
    w = Window.partitionBy(*by)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return candidates.withColumn("low", low).withColumn("span", high - low).withColumn(
        "score", F.when(F.col("span") <= LEAST_SPAN, F.lit(0.0)).otherwise((F.col("score") - F.col("low")) / F.col("span"))
    ).drop("low", "span")


def union_channels(channels: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, rows in channels.items():
        rows = rows.select(F.lit(name).alias("channel"), "query_id", "item_id", "score", "rank")
        out = rows if out is None else out.unionByName(rows)
    return out


def mean_minmax(candidates: DataFrame, n_channels: int) -> DataFrame:
    """(query_id, item_id, score): normalised scores summed and divided by the number of channels, missing ones 0."""
    return minmax(candidates).groupBy("query_id", "item_id").agg((F.sum("score") / F.lit(n_channels)).alias("score"))


def reciprocal_rank(candidates: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, item_id, score): sums of 1 / (k + rank), moved to 0..1 within each query."""
    sums = candidates.groupBy("query_id", "item_id").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"))
    return minmax(sums, ("query_id",))


def weighted_blend(first: DataFrame, second: DataFrame, weight: float, complement: bool = False) -> DataFrame:
    """(query_id, item_id, score): first + weight * second, or (1 - weight) * first + weight * second.

    A side of weight 0 adds no candidates."""
    a = 1.0 - weight if complement else 1.0
    sides = [s.select("query_id", "item_id", (F.col("score") * w).alias("score")) for s, w in ((first, a), (second, weight)) if w]
    both = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    return both.groupBy("query_id", "item_id").agg(F.sum("score").alias("score"))


def location_boost(scores: DataFrame, queries: DataFrame, items: DataFrame, bonus: float = LOCATION_BONUS) -> DataFrame:
    """Scores plus `bonus` where the query's and the item's location agree."""
    q = queries.select(F.col("query_id").alias("q_id"), F.col("location").alias("q_location"))
    i = items.select(F.col("item_id").alias("i_id"), F.col("location").alias("i_location"))
    met = scores.join(q, F.col("query_id") == F.col("q_id")).join(i, F.col("item_id") == F.col("i_id"))
    return met.select("query_id", "item_id", (F.col("score") + F.when(F.col("i_location") == F.col("q_location"), F.lit(bonus)).otherwise(0.0)).alias("score"))


def select_fused(scores: DataFrame, queries: DataFrame, items: DataFrame, bonus: float = LOCATION_BONUS, k: int = FINAL) -> DataFrame:
    return top_k(location_boost(scores, queries, items, bonus), k)
