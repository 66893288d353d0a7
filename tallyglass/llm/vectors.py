"""Vectors of a table as arrays of doubles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import pick


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of every row, v in doubles; null where it takes no part.

    That is a null or empty vector, one of zeros only, one with a null, NaN or infinite component, and one whose length
    is not the most frequent length of the others (the smaller of equally frequent ones).
    """
    v = pick(rows, id=id_col, v=vector_col).withColumn("v", F.col("v").cast("array<double>"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.withColumn("v", F.when(finite & F.exists("v", lambda x: x != 0), F.col("v")))
    sizes = v.filter("v IS NOT NULL").groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return v.withColumn("v", F.when(F.size("v") == (sizes["size"] if sizes else 0), F.col("v")))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column without nulls as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def as_lists(values: np.ndarray) -> pa.Array:
    n, d = values.shape
    offsets = np.arange(0, n * d + 1, d, dtype=np.int32) if d else np.zeros(n + 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).ravel()))


def rotation(size: int, seed: int) -> np.ndarray:
    """A random rotation, uniform among all."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))
