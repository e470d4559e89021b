"""Vectors with whole components, for operators whose results are exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: floats hold whole numbers up to here exactly
EXACT = 2**53


def integer_vectors(vectors: DataFrame, scale: int, offset: int = 0) -> DataFrame:
    """``vec_id`` and ``x``: each component c, as a double, as the long floor(scale * c) + offset.

    Left out are rows whose vector is null or holds a null or non-finite component; nothing else is.
    A null vec_id and an empty vector stay. A component whose whole number is beyond 2**53, where
    doubles have gaps, is an error. Other columns are ignored.
    """
    plain = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))

    def whole(c: Column) -> Column:
        scaled = F.floor(c * F.lit(float(scale)))
        problem = F.raise_error(F.concat(F.lit("component too large: "), c.cast("string"))).cast("bigint")
        return F.when(F.abs(c) * scale < EXACT, scaled + F.lit(offset).cast("bigint")).otherwise(problem)

    return plain.filter(F.col("v").isNotNull() & finite).select("vec_id", F.transform("v", whole).alias("x"))


def matrices(batch: pa.RecordBatch, column: str = "x") -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Per length in the batch: the length, the rows that have it, and their vectors as a matrix."""
    vectors = batch.column(column)
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    found = []
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        found.append((length, rows, values[starts[rows][:, None] + np.arange(length)]))
    return found


def largest(matrix: np.ndarray) -> int:
    """Largest absolute entry."""
    return int(np.abs(matrix).max()) if matrix.size else 0


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of whole numbers: in doubles where these are exact, else in Python's integers."""
    if largest(a) * largest(b) * max(1, a.shape[1]) < EXACT:
        return (a.astype(float) @ b.astype(float)).astype(np.int64)
    return a.astype(object) @ b.astype(object)
