"""URL filtering: host-suffix and path-prefix expressions, joined to the rules on short digests.

Each URL becomes a small set of expressions (every suffix of its host at a label border, with every
prefix of its path whose length some rule has). An equi-join on the first 32 bits of the expression's
SHA-256 finds candidate rules; the full digest confirms them; of a URL's rules the longest wins.

Defined cases: a null URL, or one without "://", has empty host and path and fits no rule; a URL that no
rule fits gets `default`. Equal URLs are judged once, so a frequent URL or host costs no more than a rare
one. Of rules of equal length the one with the longer host wins, then "block". Duplicate rules count once.
Columns of `pages` other than the key and the URL are not read, so their names can't clash.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import ascii_lower, small_frame

PREFIX_HEX = 8


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, action) rows; action is allow or block."""
    cols = list(zip(*rules, strict=True)) if rules else [(), (), ()]
    return small_frame(spark, pa.table({n: pa.array(c, pa.string()) for n, c in zip(("host", "path", "action"), cols, strict=True)}))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def expressions(urls: DataFrame, labels: int, lengths: list[int]) -> DataFrame:
    """(host, path) rows to (host, path, expression host, expression path, digest prefix, digest).

    Only suffixes of at most `labels` labels and prefixes of the given lengths can meet a rule; the
    others are never made, which bounds what a very long host or path expands to by the rules alone.
    """
    parts = F.split("host", r"\.")
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(labels))), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(x) for x in lengths]), lambda k: k <= F.length("path")),
        lambda k: F.substring(F.col("path"), F.lit(1), k),
    )
    out = urls.withColumn("x_host", F.explode(suffixes)).withColumn("x_path", F.explode(prefixes))
    out = out.withColumn("digest", _digest(F.col("x_host"), F.col("x_path")))
    return out.select("host", "path", "digest", F.substring("digest", 1, PREFIX_HEX).alias("short"))


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, url, host, path, rule, verdict): one row for each row of `pages`."""
    rules = rules.select(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), "action").dropna().distinct()
    rules = rules.withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path"))).withColumn("r_short", F.substring("r_digest", 1, PREFIX_HEX))
    # What the rules ask for: as many numbers as the longest rule has characters, at most.
    shape = rules.agg(F.max(F.size(F.split("r_host", r"\."))).alias("labels"), F.collect_set(F.length("r_path")).alias("lengths")).first()
    base = pages.select(F.col(key).alias("g_key"), F.col(url).alias("g_url"))
    base = base.select("g_key", "g_url", host_of(F.col("g_url")).alias("host"), path_of(F.col("g_url")).alias("path"))
    if not shape["labels"]:
        judged = base.withColumn("rule", F.lit(None).cast("string")).withColumn("action", F.lit(None).cast("string"))
    else:
        found = expressions(base.select("host", "path").distinct(), shape["labels"], sorted(shape["lengths"])).join(rules, F.col("short") == F.col("r_short"))
        found = found.filter(F.col("digest") == F.col("r_digest"))
        order = F.struct(
            (F.length("r_host") + F.length("r_path")).alias("total"), F.length("r_host").alias("host"), (F.col("action") == "block").alias("blocks"),
        )
        best = found.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "action"), order).alias("best"))
        best = best.select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), "best.rule", "best.action")
        judged = base.join(best, (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left")
    return judged.select(
        F.col("g_key").alias(key), F.col("g_url").alias(url), "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"),
    )
