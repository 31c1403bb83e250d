"""Building and validating answer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_IDS = 50
ID = "^[0-9a-f]{16}$"


def build_submission(candidates: DataFrame, queries: DataFrame, k: int = MOST_IDS) -> DataFrame:
    """(query_id, answer): each query's items by rank, joined by spaces; empty without candidates."""
    best = candidates.filter(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("item_id").cast("string").alias("item")))).alias("x"))
    answers = best.select("query_id", F.array_join(F.col("x.item"), " ").alias("answer"))
    return queries.select("query_id").join(answers, "query_id", "left").select(F.col("query_id").cast("string").alias("query_id"), F.coalesce("answer", F.lit("")).alias("answer"))


def violations(answer: DataFrame, queries: DataFrame, items: DataFrame, id_pattern: str = ID, id_length: int = 16, most: int = MOST_IDS) -> DataFrame:
    """(rule, query_id) rows of what is wrong; none if the table is valid.

    Rules: columns, null_value, query_id_length, duplicate_query, unknown_query, missing_query, answer_size,
    repeated_item, item_format, unknown_item. With wrong columns nothing else is looked at."""
    spark = answer.sparkSession
    if answer.columns != ["query_id", "answer"]:
        return spark.createDataFrame([("columns", None)], "rule string, query_id string")
    a = answer.select(F.col("query_id").cast("string").alias("query_id"), F.col("answer").cast("string").alias("answer"))
    q = queries.select(F.col("query_id").cast("string").alias("query_id"))
    ids = F.filter(F.split(F.trim(F.col("answer")), r"\s+"), lambda x: x != "")
    full = a.dropna().withColumn("ids", ids)
    rule = lambda name, rows: rows.select(F.lit(name).alias("rule"), "query_id")
    known = items.select(F.col("item_id").cast("string").alias("item")).distinct()
    each = full.select("query_id", F.explode("ids").alias("item"))
    found = [
        rule("null_value", a.filter(F.col("query_id").isNull() | F.col("answer").isNull())),
        rule("query_id_length", a.filter(F.length("query_id") != id_length)),
        rule("duplicate_query", a.groupBy("query_id").agg(F.count("*").alias("n")).filter("n > 1")),
        rule("unknown_query", a.select("query_id").distinct().join(q, "query_id", "left_anti")),
        rule("missing_query", q.join(a.select("query_id"), "query_id", "left_anti")),
        rule("answer_size", full.filter((F.size("ids") < 1) | (F.size("ids") > most))),
        rule("repeated_item", full.filter(F.size("ids") != F.size(F.array_distinct("ids")))),
        rule("item_format", full.filter(F.exists("ids", lambda x: ~x.rlike(id_pattern)))),
        rule("unknown_item", each.join(known, "item", "left_anti").select("query_id").distinct()),
    ]
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out


def check(answer: DataFrame, queries: DataFrame, items: DataFrame, **limits) -> None:
    """Raise ValueError with the first violations, if there are any."""
    bad = violations(answer, queries, items, **limits).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['rule']}: {r['query_id']}" for r in bad))
