"""What the operators on embeddings share: which vectors take part, and equal ones as one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _takes_part():
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= 1.7976931348623157e308))
    return F.coalesce(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))


def _doubles(vectors: DataFrame, key: str, value: str) -> DataFrame:
    return vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(value).cast("array<double>").alias("v"))


def usable(vectors: DataFrame, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>), node (hash of v): rows whose vector is whole, finite and not zero."""
    # Adding 0 makes -0 and 0 one value.
    return _doubles(vectors, key, value).where(_takes_part()).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("node", F.xxhash64("v"))


def unusable(vectors: DataFrame, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """vec_id of the other rows."""
    return _doubles(vectors, key, value).where(~_takes_part()).select("vec_id")


def rows_of(column) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The arrays of an Arrow list column as matrices: (dimension, indices, matrix) for each length."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks)
    off = arr.offsets.to_numpy()
    size = np.diff(off)
    flat = arr.values.to_numpy(zero_copy_only=False).astype(np.float64)
    out = []
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        out.append((d, at, flat[off[at][:, None] + np.arange(d)]))
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaling by the largest component first keeps huge and tiny ones in range."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with the same row of y, in double precision."""
    dot = np.einsum("ij,ij->i", x, y)
    return dot / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
