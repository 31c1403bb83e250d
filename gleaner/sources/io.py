"""Reading and writing tables, reports, checkpoints and model files."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table; only the named columns are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table that comes in fewer pieces than there are cores (one small file, say) dealt out by a key; others as they are.

    On a cluster's tables of many files this does nothing: texts are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def read_csv_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a header, all strings; empty fields are empty strings, as nothing is read as missing."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.csv(path, header=True, schema=schema, enforceSchema=False, escape='"', multiLine=True)
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def read_csv_typed(spark: SparkSession, path: str) -> DataFrame:
    """A small CSV of metrics, with inferred types."""
    return spark.read.csv(path, header=True, inferSchema=True)


def best_row(metrics: DataFrame, metric: str, where: str | None = None, ties: list[str] | None = None) -> dict[str, Any] | None:
    """The row with the largest metric, among those that `where` selects."""
    rows = metrics.filter(where) if where else metrics
    found = rows.orderBy(F.desc(metric), *(ties or [c for c in metrics.columns if c != metric])).limit(1).collect()
    return found[0].asDict() if found else None


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, in a folder; for results of report size."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def write_report(report: dict[str, Any], path: str) -> None:
    """A small result as JSON on the driver."""
    Path(path).write_text(json.dumps(report, ensure_ascii=False, indent=2, default=_plain) + "\n", encoding="utf-8")


def _plain(x: Any) -> Any:
    if hasattr(x, "asDict"):
        return x.asDict(recursive=True)
    if hasattr(x, "item"):
        return x.item()
    return str(x)


def fingerprint(df: DataFrame, columns: Iterable[str] | None = None) -> str:
    """A digest of a table's rows that doesn't depend on their order or partitions: SHA-256 of the columns' names, the number of
    rows, and the exclusive or and the sum of 60 bits of each row's MD5, which is that of its values' MD5s ("null" for none)."""
    cols = list(columns or df.columns)
    row = F.concat(*[F.coalesce(F.md5(F.col(c).cast("string").cast("binary")), F.lit("null")) for c in cols])
    h = F.conv(F.substring(F.md5(row.cast("binary")), 1, 15), 16, 10).cast("long")
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return hashlib.sha256(f"{','.join(cols)}|{r['n']}|{r['x']}|{r['s']}".encode()).hexdigest()


class CandidateStore:
    """Candidates by (channel, mode) as Parquet, valid for one fingerprint of the data.

    Every save writes a folder of its own; the metadata names it and is written last. So a save that breaks off leaves what was valid
    before, or, if it breaks off in the metadata, nothing valid. A table counts as complete if its metadata has this fingerprint and the
    folder that it names was finished (_SUCCESS). All is written by Spark, so any file system that Spark writes to will do."""

    def __init__(self, spark: SparkSession, root: str, data_fingerprint: str):
        self.spark, self.root, self.fingerprint = spark, root.rstrip("/"), data_fingerprint

    def _folder(self, channel: str, mode: str) -> str:
        return f"{self.root}/{channel}/{mode}"

    def _path(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _data(self, channel: str, mode: str, write_id: str) -> str:
        return f"{self._folder(channel, mode)}/candidates-{write_id}"

    def diagnostics(self, channel: str, mode: str) -> dict[str, Any] | None:
        files, where = self._path(f"{self._folder(channel, mode)}/metadata/_SUCCESS")
        if not files.exists(where):
            return None
        rows = self.spark.read.json(f"{self._folder(channel, mode)}/metadata").collect()
        return rows[0].asDict(recursive=True) if rows else None

    def complete(self, channel: str, mode: str) -> bool:
        found = self.diagnostics(channel, mode)
        if found is None or found.get("fingerprint") != self.fingerprint:
            return False
        files, where = self._path(f"{self._data(channel, mode, found['write_id'])}/_SUCCESS")
        return files.exists(where)

    def save(self, channel: str, mode: str, candidates: DataFrame, **diagnostics: Any) -> None:
        """Write the candidates to a new folder, then the metadata that makes it the valid one; older folders go afterwards."""
        write_id = uuid.uuid4().hex
        candidates.write.parquet(self._data(channel, mode, write_id))
        meta = json.dumps(diagnostics | {"fingerprint": self.fingerprint, "channel": channel, "mode": mode, "write_id": write_id})
        self.spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self._folder(channel, mode)}/metadata")
        files, where = self._path(self._folder(channel, mode))
        for f in files.listStatus(where):
            if f.getPath().getName().startswith("candidates-") and not f.getPath().getName().endswith(write_id):
                files.delete(f.getPath(), True)

    def load(self, channel: str, mode: str) -> DataFrame:
        if not self.complete(channel, mode):
            raise ValueError(f"no candidates of this data for {channel}, {mode}")
        return self.spark.read.parquet(self._data(channel, mode, self.diagnostics(channel, mode)["write_id"]))


class EmbeddingCache:
    """Embeddings as Parquet with array<float>, valid for one key (model, revision, data)."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.store = CandidateStore(spark, path, key)

    def get_or_make(self, field: str, make) -> DataFrame:
        if not self.store.complete("embeddings", field):
            self.store.save("embeddings", field, make())
        return self.store.load("embeddings", field)


def file_sha256(path: str, block: int = 1 << 20) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(block):
            digest.update(part)
    return digest.hexdigest()


def verified_model(path: str, sha256: str, load, dimension: int | None = None):
    """Load a local model file, if its digest and then its dimension are as expected."""
    found = file_sha256(path)
    if found != sha256:
        raise ValueError(f"{path} has SHA-256 {found}, expected {sha256}")
    model = load(path)
    if dimension is not None and getattr(model, "dimension", dimension) != dimension:
        raise ValueError(f"{path} has dimension {model.dimension}, expected {dimension}")
    return model
