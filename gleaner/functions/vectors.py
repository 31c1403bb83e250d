"""Column expressions and joins for dense vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Divided by its length; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def sum_pool(token_rows: DataFrame, vectors: DataFrame, key: str = "doc_id", token: str = "token") -> DataFrame:
    """(key, vector): the L2-normalised sum of the vectors of a row's tokens; tokens without a vector count nothing.

    Token counts are summed before vectors are, so a frequent token costs one row for each document; components are summed side by side,
    so a row holds them all.
    """
    counts = token_rows.groupBy(key, token).agg(F.count("*").alias("n"))
    size = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    sums = [F.sum(F.col("n") * F.col("vector")[i]).alias(f"x{i}") for i in range(size)] or [F.count("*").alias("none")]
    pooled = counts.join(vectors, token).groupBy(key).agg(*sums)
    return pooled.select(key, l2_normalize(F.array(*[F.col(f"x{i}") for i in range(size)]).cast("array<double>")).alias("vector"))
