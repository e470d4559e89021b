"""Helpers shared by the operators: text batches in tasks, fixed row ids, groups of one partition."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesteward.session import saved, workspace  # noqa: F401

#: bytes of text that a task works on at once; one longer text is taken whole
SLICE_BYTES = 1 << 20
REMOVE_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def text_column(name: str = "text") -> Column:
    """A text with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def numbered(df: DataFrame, label: str, name: str = "row") -> DataFrame:
    """``df`` stored with a row number that is unique and, being stored, stays as it is."""
    return saved(df.withColumn(name, F.monotonically_increasing_id()), label)


@contextmanager
def shuffle_files_removed(spark: SparkSession) -> Iterator[None]:
    """Until the end, each query's shuffle files go with the query.

    Otherwise they go when the driver collects its garbage, and those of many steps take disk at a time.
    """
    before = spark.conf.get(REMOVE_CONF, None)
    spark.conf.set(REMOVE_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(REMOVE_CONF)
        else:
            spark.conf.set(REMOVE_CONF, before)


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column of texts or bytes into runs of rows: first row, end row, bytes, offsets in them."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    low, n = 0, len(column)
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE_BYTES, "right")) - 1)
        high = min(high, n)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One list per row out of its rows' concatenated values."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def key_runs(batches: Iterator[pa.RecordBatch], key: str, limit: int) -> Iterator[pa.Table]:
    """Tables of about ``limit`` rows that never cut a run of equal keys, out of batches sorted by key."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < limit:
            continue
        table = pa.Table.from_batches(held)
        keys = table[key].to_numpy()
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            rows = table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)
