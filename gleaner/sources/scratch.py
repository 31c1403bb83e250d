"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names. A temporary folder of this machine only where none is named and driver and
    executors are one process (tests); elsewhere executors would write where no other can read."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[0-9*, ]+\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="gleaner-checkpoint-"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the checkpoint folder. It is deleted when the application ends, if not before."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, on whatever file system it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet into the checkpoint folder and read it again: later steps don't repeat the work before it, a lost
    executor costs a re-read, not a recomputation, and Spark plans with the size it has."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete what scratch() wrote for this very frame, once nothing reads it any more."""
    if df is not None and getattr(df, "_scratch", None):
        delete(df.sparkSession, df._scratch)
