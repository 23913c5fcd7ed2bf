"""Vectors gathered into blocks: one row holds many vectors as bytes, for matrix products in Python workers."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@contextmanager
def arrow_rows(spark, rows: int):
    """Arrow batches of so many rows at most, for what runs inside: rows that are large blocks."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def usable(vector: Column) -> Column:
    """False for null vectors and for those with a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def pad(vectors: list[np.ndarray], width: int, dtype) -> np.ndarray:
    """Rows of one width; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), width), dtype=dtype)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def chunks(frames, size: int):
    """The rows of an iterator of frames in frames of size rows; the last may be shorter."""
    rest, n = [], 0
    for frame in frames:
        while len(frame):
            head, frame = frame.iloc[: size - n], frame.iloc[size - n :]
            rest.append(head)
            n += len(head)
            if n == size:
                yield pd.concat(rest, ignore_index=True)
                rest, n = [], 0
    if n:
        yield pd.concat(rest, ignore_index=True)


def widest(df: DataFrame, vector: str) -> int:
    return df.agg(F.coalesce(F.max(F.size(vector)), F.lit(0))).first()[0]
