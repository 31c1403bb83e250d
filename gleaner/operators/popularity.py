"""Popularity lists, query history, and filling up short answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.ranking import top_rows


def popular(pairs: DataFrame, by: list[str], k: int = 50, item: str = "item_id") -> DataFrame:
    """(by..., item_id, n, rank): the k most frequent items of each group, ties by item; without a group, overall."""
    n = pairs.groupBy(*by, item).agg(F.count("*").alias("n"))
    return top_rows(n, by, [F.desc("n"), F.asc(item)], k)


def remove_texts(history: DataFrame, held: DataFrame, text: str) -> DataFrame:
    """History without the texts that are held out."""
    return history.join(held.select(text).distinct(), text, "left_anti")


def remove_signatures(history: DataFrame, held: DataFrame, columns: list[str]) -> DataFrame:
    """History without the rows whose whole signature is held out; nulls are values."""
    h = held.select(*[F.col(c).alias(f"h_{c}") for c in columns]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"h_{c}")) for c in columns])
    return history.join(h, same, "left_anti")


def history_counts(queries: DataFrame, history: DataFrame, text: str) -> DataFrame:
    """Queries with the number of history rows of their text, 0 if none."""
    n = history.groupBy(text).agg(F.count("*").alias("history_rows"))
    return queries.join(n, text, "left").withColumn("history_rows", F.coalesce("history_rows", F.lit(0)))


def by_priority(lists: list[DataFrame], k: int = 50) -> DataFrame:
    """(query_id, item_id, rank): lists of (query_id, item_id, rank) one after the other, each item once, k in all."""
    rows = reduce(DataFrame.unionByName, [x.select("query_id", "item_id", F.lit(i).alias("priority"), F.col("rank").alias("place")) for i, x in enumerate(lists)])
    first = rows.groupBy("query_id", "item_id").agg(F.min(F.struct("priority", "place")).alias("at"))
    return top_rows(first, ["query_id"], [F.col("at.priority"), F.col("at.place"), F.col("item_id")], k).select("query_id", "item_id", "rank")


def listed(ranked: DataFrame, by: list[str]) -> DataFrame:
    """(by..., items): each group's (item_id, rank) rows as one array, in order of rank."""
    cells = ranked.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("x"))
    return cells.select(*by, F.col("x.item_id").alias("items"))


def lists_by_priority(queries: DataFrame, lists: list[tuple[DataFrame, list[str]]], k: int = 50) -> DataFrame:
    """(query_id, item_id, rank): what by_priority gives for (lists, keys) that queries meet by their keys, a list without keys being
    everybody's. A query's lists come together in its row, so that a list which many queries share is not repeated before."""
    rows, at = queries.distinct(), []
    for i, (items, keys) in enumerate(lists):
        rows = rows.join(items.withColumnRenamed("items", f"items_{i}"), keys, "left") if keys else rows.join(F.broadcast(items.withColumnRenamed("items", f"items_{i}")), how="left")
        at.append(F.coalesce(f"items_{i}", F.array().cast(items.schema["items"].dataType)))
    found = F.slice(F.array_distinct(F.concat(*at)), 1, k)
    return rows.select("query_id", F.posexplode(found).alias("place", "item_id")).select("query_id", "item_id", (F.col("place") + 1).alias("rank"))


def fallback_lists(items: DataFrame, by: list[str], k: int) -> DataFrame:
    """(by..., item_id, rank): the first k items of each group, by item."""
    return top_rows(items.select(*by, "item_id"), by, [F.asc("item_id")], k)


def fill_empty(candidates: DataFrame, queries: DataFrame, items: DataFrame, k: int = 500) -> DataFrame:
    """Candidates, and for queries without any the first k items of their category and location, else of their
    category, with score 0."""
    empty = queries.join(candidates.select("query_id").distinct(), "query_id", "left_anti")
    near = empty.join(fallback_lists(items, ["category", "location"], k), ["category", "location"])
    rest = empty.join(near.select("query_id").distinct(), "query_id", "left_anti").join(fallback_lists(items, ["category"], k), "category")
    cols = ["query_id", "item_id", "score", "rank"]
    fill = lambda d: d.withColumn("score", F.lit(0.0)).select(*cols)
    return candidates.select(*cols).unionByName(fill(near)).unionByName(fill(rest))
