"""Compaction and vacuum."""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesteward.operators.ordering import with_ties_placed
from lakesteward.session import saved
from lakesteward.sources.manifest import storage_opener, storage_options


def file_count_for(total_bytes: int, target_bytes: int = 512 * 1024 * 1024) -> int:
    return max(1, math.ceil(total_bytes / target_bytes))


def compact(df: DataFrame, files: int, cluster_cols: list[str], from_scan: bool = False) -> DataFrame:
    """The same rows in ``files`` partitions, ranged and sorted on ``cluster_cols``.

    Range bounds also tell rows of equal values apart, so a value that holds a third of the rows,
    or a row repeated that often, is spread over its share of the files. Choosing the bounds
    reads the input once more. ``from_scan`` as in ``with_ties_placed``.
    """
    placed, ties = with_ties_placed(df, cluster_cols, from_scan)
    ranged = placed.repartitionByRange(files, *cluster_cols, *ties)
    return ranged.sortWithinPartitions(*cluster_cols, *ties).drop(*ties)


def vacuum_plan(
    manifest: DataFrame, referenced: DataFrame, cutoff: datetime | int, key: str = "path", age: str = "mtime"
) -> DataFrame:
    """Files that nothing refers to and that are older than ``cutoff``.

    Age is tested before the anti join, so recent files are not shuffled.
    """
    names = referenced.select(key).filter(F.col(key).isNotNull()).distinct()
    return manifest.filter(F.col(age) < F.lit(cutoff)).join(names, key, "left_anti")


def _delete(batches: Iterator, options: dict[str, str]) -> Iterator:
    import pyarrow as pa

    schema = pa.schema([("path", pa.string()), ("status", pa.string()), ("error", pa.string())])
    open_path = storage_opener(options)
    for batch in batches:
        paths, states, errors = batch.column("path").to_pylist(), [], []
        for path in paths:
            state, error = "deleted", None
            try:
                store, inner = open_path(path)
                store.delete_file(inner)
            except FileNotFoundError:
                pass  # an earlier attempt of this task got that far
            except OSError as problem:
                state, error = "failed", str(problem)
            states.append(state)
            errors.append(error)
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(states, pa.string()), pa.array(errors, pa.string())],
            schema=schema,
        )


def vacuum_execute(plan: DataFrame, dry_run: bool = True) -> DataFrame:
    """Delete the planned files inside the tasks; returns (path, status, error) per file.

    The plan is fixed in the shared folder first: what is deleted cannot change because the
    listing is evaluated again. Deleting is idempotent, so a lost executor does no harm.
    """
    paths = plan.select("path")
    if dry_run:
        return paths.select("path", F.lit("planned").alias("status"), F.lit(None).cast("string").alias("error"))
    fixed = saved(paths, "vacuum-plan")
    # spread evenly and by number, as AQE would merge small rows that are slow to serve
    tasks = max(1, min(fixed.count(), plan.sparkSession.sparkContext.defaultParallelism))
    fixed = fixed.repartition(tasks, F.xxhash64("path"))
    delete = partial(_delete, options=storage_options(plan.sparkSession))
    return saved(fixed.mapInArrow(delete, "path STRING, status STRING, error STRING"), "vacuum-outcome")
