"""An extension: popularity over a stream of events. The batch operators have no streaming counterpart to match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_popularity(events: DataFrame, by: list[str], window: str = "1 day", late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Counts of each group by time window; rows later than `late` are dropped. Works on batches and streams."""
    # watermarks are kept on instants only
    stream = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events
    counts = stream.groupBy(F.window(ts, window).alias("w"), *by).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), *by, "n")
