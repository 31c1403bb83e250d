"""Connected components of a graph given as an edge table, by alternating large and small stars.

Every step is a join and an aggregation; no neighbourhood is gathered in one task, and a frequent
node's rows are dealt out by Spark's skew join. Each round is written to the checkpoint folder, and the one before deleted.

Defined cases: repeated edges count once; nodes are not null; a table without edges has no components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut, drop


def _large(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node's larger neighbours move to the least node around it; and what can be dropped afterwards."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # written out first: next to an aggregation Spark can't split a join's hot keys
    least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")))
    moved = both.filter(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("u"))
    return cut(moved.select(F.col("m").alias("a"), "b").filter("a <> b").distinct()), least


def _small(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node and its smaller neighbours move to the least of them; and what can be dropped afterwards."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = cut(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b")
    return cut(moved.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()), least


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; edges are (a, b) with a <> b, root is the least node."""
    edges, seen = cut(edges.select("a", "b").distinct()), None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == seen or not state["n"]:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            )
        large, one = _large(edges)
        small, two = _small(large)
        for done in (edges, one, large, two):
            drop(done)
        edges, seen = small, state
