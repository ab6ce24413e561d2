"""Embedding vectors as whole numbers."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Entries beyond this are held at it, so that they fit 64-bit integers.
LARGEST = float(1 << 62)


def usable(rows: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Columns vec_id and embedding (doubles) of the rows whose vector is not null and holds neither null, NaN nor an infinity."""
    v = F.col(vector).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.where(v.isNotNull() & ~odd).select(F.col(id).cast("long").alias("vec_id"), v.alias("embedding"))


def longest(vectors: DataFrame) -> tuple[int, int]:
    """The number of vectors and the length of the longest."""
    n, dims = vectors.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    return n, dims or 0


def scaled(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * entry) as a matrix of 64-bit integers. Shorter vectors count as filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    whole = np.clip(np.floor(flat * float(scale)), -LARGEST, LARGEST).astype(np.int64)
    if (lengths == dims).all():
        return whole.reshape(-1, dims)
    out = np.zeros((len(lengths), dims), np.int64)
    starts = np.cumsum(lengths) - lengths
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(starts, lengths)] = whole
    return out
