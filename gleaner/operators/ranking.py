"""Deterministic rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Digits to which scores are compared, as sums differ in the last bits with their order.
DIGITS = 9


def top_rows(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in the given order, with their rank. Without a group the order is global
    and only k rows of each partition meet."""
    if not by:
        rows = rows.orderBy(*order).limit(k)
        return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def top_k(scores: DataFrame, k: int, query: str = "query_id", item: str = "item_id", score: str = "score") -> DataFrame:
    """The k best items of each query: higher scores first, ties by item."""
    rounded = scores.withColumn(score, F.round(score, DIGITS))
    return top_rows(rounded, [query], [F.desc(score), F.asc(item)], k)
