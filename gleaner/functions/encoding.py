"""Encoding texts by a model that the caller brings (a sentence encoder, say): none is built in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Makes the model in a Python worker: a function from a list of texts to a matrix of their vectors.
MakeEncoder = Callable[[], Callable[[list[str]], np.ndarray]]


def join_fields(*fields: Column) -> Column:
    """Fields joined by spaces; null and blank ones leave no gap."""
    return F.concat_ws(" ", *[F.nullif(F.trim(f), F.lit("")) for f in fields])


def encode(rows: DataFrame, make_encoder: MakeEncoder, key: str, text: str = "text", batch_size: int = 32) -> DataFrame:
    """(key, vector): L2-normalised vectors of the texts; the model is made once for each task, and a zero vector
    stays as it is. Texts are encoded `batch_size` at a time, which bounds the model's memory."""
    base = rows.select(F.col(key), F.coalesce(text, F.lit("")).alias("g_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_encoder()
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                part = batch.slice(at, batch_size)
                v = np.asarray(model(part.column(1).to_pylist()), np.float64)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                v = np.divide(v, norm, out=v.copy(), where=norm > 0)
                yield pa.record_batch([part.column(0), pa.array(v.tolist(), pa.list_(pa.float64()))], [key, "vector"])

    return base.mapInArrow(run, f"{key} {base.schema[key].dataType.simpleString()}, vector array<double>")
