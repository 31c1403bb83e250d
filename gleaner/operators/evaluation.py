"""Splits, recall, mixtures, bootstrap and sampling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions.text import SEED, signature_text, stable_hash
from gleaner.operators.ranking import top_rows

COLD_SHARE, WARM_SHARE = 0.63, 0.37
BOOTSTRAP_SEEDS = {"cold": 20260919, "warm": 20260920}


def signatures(train: DataFrame, columns: list[str], item: str = "item_id") -> DataFrame:
    """(columns..., positives): the distinct items of each full signature, sorted; nulls are values."""
    return train.groupBy(*columns).agg(F.array_sort(F.collect_set(item)).alias("positives"))


def hash_split(train: DataFrame, columns: list[str], mode: str, size: int, text: Column, seed: str = SEED, item: str = "item_id") -> DataFrame:
    """(text, columns..., positives): one signature for each of the `size` texts with the least hashes.

    `text` normalises the first column. Cold mode takes all texts, warm those with two signatures or more.
    Of a text's signatures the one whose printed tuple has the least hash stands for it."""
    if mode not in ("cold", "warm"):
        raise ValueError(f"unknown mode: {mode}")
    sig = train.select(*columns).distinct().withColumn("text", text)
    sig = sig.withColumn("sig_hash", stable_hash(signature_text(*[F.col(c) for c in columns]), seed))
    chosen = sig.groupBy("text").agg(F.count("*").alias("n"), F.min_by(F.struct(*columns), "sig_hash").alias("sig"))
    chosen = chosen.filter(F.col("n") >= (2 if mode == "warm" else 1)).withColumn("text_hash", stable_hash(F.col("text"), seed))
    chosen = top_rows(chosen, [], [F.asc("text_hash"), F.asc("text")], size).select("text", *[F.col("sig")[c].alias(f"s_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"s_{c}"))
    held = train.join(chosen, same).groupBy("text", *columns).agg(F.array_sort(F.collect_set(item)).alias("positives"))
    return held


def recall_at_k(candidates: DataFrame, relevance: DataFrame, k: int = 50) -> DataFrame:
    """(query_id, hits, relevant, recall) for every query of `relevance` (query_id, item_id), also without candidates."""
    best = candidates.filter(F.col("rank") <= k).select("query_id", "item_id").distinct().withColumn("hit", F.lit(1))
    met = relevance.select("query_id", "item_id").distinct().join(best, ["query_id", "item_id"], "left")
    per = met.groupBy("query_id").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.count("*").alias("relevant"))
    return per.withColumn("recall", F.col("hits") / F.col("relevant"))


def summarize(recalls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., queries, recall, queries_with_hit)."""
    return recalls.groupBy(*(by or [])).agg(F.count("*").alias("queries"), F.avg("recall").alias("recall"), F.count_if(F.col("recall") > 0).alias("queries_with_hit"))


def pool_recalls(candidates: DataFrame, relevance: DataFrame, channels: list[str], union: str = "union") -> DataFrame:
    """(pool, queries, recall, queries_with_hit) of each channel's candidates and of all together: the candidates of all channels are
    summed up once, and met with the relevant items once."""
    found = candidates.groupBy("query_id", "item_id").agg(*[F.max((F.col("channel") == c).cast("int")).alias(f"in_{c}") for c in channels])
    met = relevance.select("query_id", "item_id").distinct().join(found, ["query_id", "item_id"], "left")
    hits = {c: F.coalesce(F.col(f"in_{c}"), F.lit(0)) for c in channels}
    pools = hits | {union: F.greatest(*hits.values()) if len(hits) > 1 else next(iter(hits.values()))}
    per = met.groupBy("query_id").agg(*[F.avg(h).alias(f"pool_{c}") for c, h in pools.items()])
    each = F.array(*[F.struct(F.lit(c).alias("pool"), F.col(f"pool_{c}").alias("recall")) for c in pools])
    return summarize(per.select(F.inline(each)), ["pool"])


def mode_mixture(metrics: DataFrame, by: list[str], metric: str = "recall", cold: float = COLD_SHARE, warm: float = WARM_SHARE) -> DataFrame:
    """(by..., cold, warm, mix): modes as columns, and their weighted mean."""
    wide = metrics.groupBy(*by).pivot("mode", ["cold", "warm"]).agg(F.avg(metric))
    return wide.withColumn("mix", cold * F.col("cold") + warm * F.col("warm"))


def bootstrap_weights(spark: SparkSession, n_queries: int, runs: int, seed: int) -> DataFrame:
    """(run, position, weight): how often each of n queries is drawn, with replacement, in each run.

    Drawn on the driver by NumPy, so the numbers of queries and runs bound its size."""
    rng = np.random.default_rng(seed)
    drawn = np.stack([np.bincount(rng.integers(0, n_queries, n_queries), minlength=n_queries) for _ in range(runs)])
    run, position = np.nonzero(drawn)
    return spark.createDataFrame(pa.table({"run": run.astype(np.int32), "position": position.astype(np.int64), "weight": drawn[run, position].astype(np.int64)}))


def bootstrap(recalls: DataFrame, runs: int, seed: int, query: str = "query_id") -> DataFrame:
    """(mean, std, low, high) over multinomial runs; queries are numbered by their ids. The driver draws as many numbers a run as there
    are queries, which a validation set bounds."""
    n = recalls.count()
    if not n:
        return bootstrap_summary(recalls.select(F.lit(0).alias("run"), F.lit(1).alias("weight"), "recall"))
    placed = recalls.select("recall", (F.row_number().over(Window.orderBy(query)) - 1).cast("long").alias("position"))
    return bootstrap_summary(bootstrap_weights(recalls.sparkSession, n, runs, seed).join(placed, "position"))


def hashed_weights(recalls: DataFrame, runs: int, seed: int, query: str = "query_id") -> DataFrame:
    """(run, query_id, recall, weight): a bootstrap that any engine can repeat, with weights from a hash: a Poisson(1)
    draw for each run and query, which is what multinomial draws tend to as queries grow."""
    u = lambda run: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), run, F.col(query).cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    rows = recalls.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).withColumn("u", u(F.col("run")))
    steps, total, term = [], 0.0, float(np.exp(-1.0))
    for k in range(12):
        total += term
        steps.append(total)
        term /= k + 1
    weight = F.lit(0)
    for s in steps:
        weight = weight + F.when(F.col("u") >= F.lit(s), 1).otherwise(0)
    return rows.select("run", query, "recall", weight.alias("weight"))


def bootstrap_summary(weighted: DataFrame) -> DataFrame:
    """(mean, std, low, high) of the weighted mean recall over the runs."""
    per = weighted.groupBy("run").agg((F.sum(F.col("weight") * F.col("recall")) / F.sum("weight")).alias("r"))
    return per.agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.min("r").alias("low"), F.max("r").alias("high"))


def random_negatives(pairs: DataFrame, items: DataFrame, seed: str = SEED, default_category=None) -> DataFrame:
    """pairs (query_id, item_id, category) with `negative`: another item of the category, each equally likely, drawn by a hash.

    Items are numbered within their category, by buckets of their ids' hashes; a pair's hash names one of the numbers but the pair's own
    item's. Categories without another item use the default one, if given; without one such pairs have no row."""
    number = lambda c: F.conv(F.substring(stable_hash(c, seed), 1, 12), 16, 10).cast("long")
    # numbered bucket by bucket, so that no task orders a whole category
    n = F.broadcast(items.agg(F.greatest(F.lit(1).cast("long"), F.floor(F.count("*") / 100_000)).alias("buckets")))  # one row
    hashed = items.select("category", "item_id", number(F.col("item_id").cast("string")).alias("h")).join(n).withColumn("bucket", F.col("h") % F.col("buckets"))
    held = hashed.groupBy("category", "bucket").agg(F.count("*").alias("held"))
    w = Window.partitionBy("category")
    held = held.select(F.col("category").alias("c"), F.col("bucket").alias("b"), (F.sum("held").over(w.orderBy("bucket")) - F.col("held")).alias("before"), F.sum("held").over(w).alias("n"))
    inside = F.row_number().over(Window.partitionBy("category", "bucket").orderBy("h", "item_id"))
    numbered = hashed.withColumn("inside", inside).join(held, (F.col("category") == F.col("c")) & (F.col("bucket") == F.col("b")))
    numbered = numbered.select(F.col("category").alias("n_category"), F.col("item_id").alias("negative"), (F.col("before") + F.col("inside") - 1).alias("place"))
    sizes = held.select(F.col("c").alias("s_category"), "n").distinct()
    known = pairs.join(sizes, F.col("category") == F.col("s_category"), "left")
    if default_category is not None:
        enough = F.coalesce(F.col("n") >= 2, F.lit(False))
        known = pairs.select("query_id", "item_id", "category").join(known.filter(enough).select(F.col("category").alias("k")).distinct(), F.col("category") == F.col("k"), "left")
        known = known.withColumn("category", F.when(F.col("k").isNull(), F.lit(default_category)).otherwise(F.col("category"))).drop("k").join(sizes, F.col("category") == F.col("s_category"), "left")
    own = numbered.select(F.col("n_category").alias("o_category"), F.col("negative").alias("o_item"), F.col("place").alias("own"))
    known = known.join(own, (F.col("category") == F.col("o_category")) & (F.col("item_id") == F.col("o_item")), "left")
    # an item of the category itself is skipped: the numbers after it move down by one
    choices = F.col("n") - F.col("own").isNotNull().cast("long")
    drawn = known.filter(choices > 0).withColumn("place_", number(F.concat_ws("|", F.col("query_id").cast("string"), F.col("item_id").cast("string"))) % choices)
    drawn = drawn.withColumn("place_", F.col("place_") + F.coalesce(F.col("place_") >= F.col("own"), F.lit(False)).cast("long"))
    met = drawn.join(numbered, (F.col("category") == F.col("n_category")) & (F.col("place_") == F.col("place")))
    return met.select("query_id", "item_id", "category", "negative")


def best_config(metrics: DataFrame, config: list[str], metric: str = "mix", k: int = 20) -> DataFrame:
    """The k best configurations, ties by configuration."""
    return top_rows(metrics.withColumn(metric, F.round(metric, 12)), [], [F.desc(metric), *[F.asc(c) for c in config]], k)


def pairwise_delta(metrics: DataFrame, by: list[str], name: str, a: str, b: str, metric: str = "mix") -> DataFrame:
    """(by..., a, b, delta): the metric of two variants side by side, and b - a."""
    wide = metrics.groupBy(*by).pivot(name, [a, b]).agg(F.avg(metric))
    return wide.withColumn("delta", F.col(b) - F.col(a))
