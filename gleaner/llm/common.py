"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.sources.scratch import drop, scratch  # noqa: F401

#: A word, wherever the contracts count words.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES, BATCH_ROWS = 8 << 20, 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write a narrow frame out and read it back: it cuts the lineage (see scratch)."""
    return scratch(df, "cut")


def small_frame(spark: SparkSession, rows: pa.Table) -> DataFrame:
    """Driver-made rows as a local relation: Spark knows its size and broadcasts it only below its threshold."""
    return spark.createDataFrame(rows)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def bounded_batches(df: DataFrame) -> DataFrame:
    """For frames with texts on their way to Python: lower the session's Arrow batches to BATCH_BYTES and BATCH_ROWS, as a
    worker holds a batch several times over (smaller settings stay). Spark has this as a setting of the session only, so it
    also holds for the session's other frames; build_session sets the same values from the start."""
    conf = df.sparkSession.conf
    in_bytes = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if in_bytes(conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
