"""Data profiles: columns, quantiles, overlaps, pair features and how they separate labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.text import contains_query, coverage, hyphen_tokens, normalize_text
from gleaner.sources.scratch import scratch

SHARES = (0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)
ID_PATTERN = "^[0-9a-f]{16}$"
#: The names of the pair features.
FEATURES = (
    "title_query_coverage", "params_query_coverage", "description_query_coverage", "all_text_query_coverage", "params_filter_coverage", "exact_query_in_title", "exact_query_in_description",
    "category_match", "location_match", "log_reviews", "rating", "phone_visible", "messages_allowed", "log_train_click_frequency",
)


def grouped_quantiles(values: DataFrame, by: list[str], shares: tuple[float, ...] = SHARES) -> DataFrame:
    """(by..., share, quantile): exact quantiles of `value` in each group, linearly interpolated; nulls don't count, nor do groups without
    any value.

    Equal values are summed up on the map side and dealt into ranges in order; sums of the ranges show in which a rank lies, and only
    such ranges are counted through. No task holds a column."""
    spark = values.sparkSession
    counts = values.filter(F.col("value").isNotNull()).groupBy(*by, "value").agg(F.count("*").alias("n"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = scratch(counts.repartitionByRange(parts, *by, "value").withColumn("part", F.spark_partition_id()), "ranges")
    sums = counts.groupBy(*by, "part").agg(F.sum("n").alias("held"))
    # one row for each group and range
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    sums = sums.withColumn("before", F.sum("held").over(group.orderBy("part")) - F.col("held")).withColumn("total", F.sum("held").over(group))
    sums = sums.withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares]))).withColumn("at", F.col("share") * (F.col("total") - 1))
    low, high = F.floor("at"), F.ceil("at")
    ranks = sums.withColumn("rank", F.explode(F.array(low, high))).filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("held")))
    ranks = ranks.select(*[F.col(c).alias(f"r_{c}") for c in by], F.col("part").alias("r_part"), "share", "at", "rank", (F.col("rank") - F.col("before")).alias("place")).distinct()

    def same(a: str, b: str) -> Column:
        out = F.col(f"{a}part") == F.col(f"{b}part")
        for c in by:
            out = out & F.col(f"{a}{c}").eqNullSafe(F.col(f"{b}{c}"))
        return out

    wanted = counts.join(ranks.select("r_part", *[f"r_{c}" for c in by]).distinct(), same("", "r_"), "left_semi")
    wanted = wanted.withColumn("last", F.sum("n").over(Window.partitionBy(*by, "part").orderBy("value")))
    met = wanted.join(ranks, same("", "r_") & (F.col("place") < F.col("last")) & (F.col("place") >= F.col("last") - F.col("n")))
    low_value, high_value = F.min("value"), F.max("value")
    return met.groupBy(*by, "share", "at").agg((low_value + (high_value - low_value) * (F.col("at") - F.floor("at"))).alias("quantile")).select(*by, "share", "quantile")


def quantiles(df: DataFrame, c: Column, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """(share, value) rows of exact quantiles, linearly interpolated; null where there is no value."""
    found = grouped_quantiles(df.select(c.cast("double").alias("value")), [], shares).select(F.col("share").alias("q_share"), F.col("quantile").alias("value"))
    asked = df.sparkSession.createDataFrame([(s,) for s in shares], "share double")
    return asked.join(found, F.col("share") == F.col("q_share"), "left").select("share", "value")


def column_profile(df: DataFrame) -> DataFrame:
    """(column, kind, row_count, nulls, distinct, low, median, high) of every column.

    Numbers are summed up by their values, strings by their lengths, booleans by 0 and 1; others by counts only. Columns become rows
    (column, value) and are counted together: what is shuffled are different values."""
    names, kinds = df.columns, {f.name: f.dataType for f in df.schema}

    def number(name: str) -> Column:
        c, kind = F.col(name), kinds[name]
        if isinstance(kind, T.NumericType):
            return c.cast("double")
        if isinstance(kind, T.BooleanType):
            return c.cast("int").cast("double")
        return F.length(c).cast("double") if isinstance(kind, T.StringType) else F.lit(None).cast("double")

    def text(name: str) -> Column:
        c = F.col(name)
        return (c + F.lit(0.0)).cast("string") if isinstance(kinds[name], (T.DoubleType, T.FloatType)) else c.cast("string") if isinstance(kinds[name], T.AtomicType) else F.to_json(F.struct(c))

    wide = df.agg(F.count("*").alias("row_count"), *[F.count_if(F.col(c).isNull()).alias(f"nulls_{i}") for i, c in enumerate(names)])
    rows = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kinds[c].simpleString()).alias("kind"), F.col("row_count"), F.col(f"nulls_{i}").alias("nulls")) for i, c in enumerate(names)])))
    each = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("d_column"), F.when(F.col(c).isNotNull(), text(c)).alias("text")) for c in names]))).filter(F.col("text").isNotNull())
    different = each.distinct().groupBy("d_column").agg(F.count("*").alias("distinct"))
    values = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("q_column"), number(c).alias("value")) for c in names])))
    found = grouped_quantiles(values, ["q_column"], (0.0, 0.5, 1.0)).groupBy("q_column").pivot("share", [0.0, 0.5, 1.0]).agg(F.first("quantile"))
    found = found.toDF("q_column", "low", "median", "high")
    out = rows.join(different, F.col("column") == F.col("d_column"), "left").join(found, F.col("column") == F.col("q_column"), "left")
    return out.select("column", "kind", "row_count", "nulls", F.coalesce("distinct", F.lit(0)).alias("distinct"), "low", "median", "high")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def group_counts(df: DataFrame, by: list[str], item: str) -> DataFrame:
    """(by..., row_count, items): rows and distinct items of each group."""
    return df.groupBy(*by).agg(F.count("*").alias("row_count"), F.count_distinct(item).alias("items"))


def match_rates(pairs: DataFrame, matches: dict[str, tuple[str, str]]) -> DataFrame:
    """One row: for each name the share of rows whose two columns are equal; nulls equal nothing."""
    return pairs.agg(*[F.avg(F.coalesce(F.col(a) == F.col(b), F.lit(False)).cast("int")).alias(n) for n, (a, b) in matches.items()])


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row (left_ids, right_ids, both): distinct ids of two tables and those in common."""
    marked = a.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    per = marked.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return per.agg(F.sum("l").alias("left_ids"), F.sum("r").alias("right_ids"), F.sum(F.col("l") * F.col("r")).alias("both"))


def malformed_ids(df: DataFrame, column: str, pattern: str = ID_PATTERN) -> DataFrame:
    """Rows whose id doesn't match the pattern as a whole."""
    return df.filter(~F.coalesce(F.col(column).cast("string").rlike(pattern), F.lit(False)))


def first_rows(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row for each key: the first in an explicit order."""
    first = df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), F.struct(*order)).alias("r"))
    return first.select(key, "r.*")


def pair_features(pairs: DataFrame) -> DataFrame:
    """FEATURES of (query, params, category, location; item fields) pairs, next to the columns given.

    Expects query, query_params, query_category, query_location, title, params, description, item_category,
    item_location, reviews, item_rating, phone_hidden, message_forbidden, clicks. Null and NaN numbers count as 0, null flags as
    false, null texts as empty."""
    norm = pairs
    for c in ("query", "title", "description"):
        norm = norm.withColumn(f"n_{c}", normalize_text(F.col(c)))
    for c in ("query", "query_params", "title", "params", "description"):
        norm = norm.withColumn(f"t_{c}", hyphen_tokens(F.col(c)))
    everything = F.concat("t_title", "t_params", "t_description")
    number = lambda c: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(0.0))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    features = {
        "title_query_coverage": coverage(F.col("t_query"), F.col("t_title")),
        "params_query_coverage": coverage(F.col("t_query"), F.col("t_params")),
        "description_query_coverage": coverage(F.col("t_query"), F.col("t_description")),
        "all_text_query_coverage": coverage(F.col("t_query"), everything),
        "params_filter_coverage": coverage(F.col("t_query_params"), F.col("t_params")),
        "exact_query_in_title": contains_query(F.col("n_query"), F.col("n_title")),
        "exact_query_in_description": contains_query(F.col("n_query"), F.col("n_description")),
        "category_match": flag(F.col("query_category") == F.col("item_category")),
        "location_match": flag(F.col("query_location") == F.col("item_location")),
        "log_reviews": F.log1p(number("reviews")),
        "rating": number("item_rating"),
        "phone_visible": flag(~F.col("phone_hidden")),
        "messages_allowed": flag(~F.col("message_forbidden")),
        "log_train_click_frequency": F.log1p(number("clicks")),
    }
    return norm.select(*pairs.columns, *[v.alias(k) for k, v in features.items()])


def separation(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, mean_positive, mean_negative, difference, correlation) with a 0/1 label, in one aggregation."""
    y = F.col(label).cast("double")
    aggs = []
    for f in features:
        x = F.col(f).cast("double")
        aggs += [F.avg(F.when(y == 1, x)).alias(f"{f}__p"), F.avg(F.when(y == 0, x)).alias(f"{f}__n"), F.corr(x, y).alias(f"{f}__c")]
    wide = rows.agg(*aggs)
    out = [
        F.struct(F.lit(f).alias("feature"), F.col(f"{f}__p").alias("mean_positive"), F.col(f"{f}__n").alias("mean_negative"), (F.col(f"{f}__p") - F.col(f"{f}__n")).alias("difference"), F.col(f"{f}__c").alias("correlation"))
        for f in features
    ]
    return wide.select(F.inline(F.array(*out)))


def zero_vectors(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """One row (n, zero): vectors, and those of zeros only."""
    return rows.agg(F.count("*").alias("n"), F.count_if(F.forall(vector, lambda x: x == 0)).alias("zero"))


def same_ids(a: DataFrame, b: DataFrame, key: str) -> bool:
    """Whether two tables hold the same ids, equally often."""
    return a.select(key).exceptAll(b.select(key)).isEmpty() and b.select(key).exceptAll(a.select(key)).isEmpty()
