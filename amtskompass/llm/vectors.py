"""Vectors as whole numbers, and matrices of them inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1024


def usable(rows: DataFrame, key: str, vector: str, offset: int = 0) -> DataFrame:
    """``id`` and ``x``: every component ``c``, as double, becomes ``floor(1024 * c) + offset``.

    Rows whose vector is null or holds a null, NaN or infinite component are left out; other columns are not read.
    """
    parts = F.col("v")
    kept = rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    fine = F.forall(parts, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return kept.where(parts.isNotNull() & fine).select("id", F.transform(parts, lambda c: F.floor(c * SCALE) + F.lit(offset)).alias("x"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int, fill: int = 0) -> np.ndarray:
    """Rows of a list column as an int64 matrix; a list shorter than ``width`` is continued by ``fill``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.full((len(size), width), fill, dtype=np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(size)), size), at] = flat
    return out
