"""Writers that replace, version or lay out data."""

from __future__ import annotations

import os
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesteward.sources.catalog import point_table_at


def _bare(path: str) -> str:
    if path.startswith("file:") or ":" not in path.split("/", 1)[0]:
        return os.path.abspath(re.sub("^file:/+", "/", path)).rstrip("/") + "/"
    return re.sub("^s3[an]?://", "s3://", path).rstrip("/") + "/"


def lies_below(path: str, folder: str) -> bool:
    """Whether ``path`` is ``folder`` or below it, however their schemes are spelt."""
    return _bare(path).startswith(_bare(folder))


def same_or_nested(a: str, b: str) -> bool:
    """Whether one of two paths is the other or lies below it."""
    return lies_below(a, b) or lies_below(b, a)


def overwrite_sink(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: list[str] | None = None,
    replace: str = "all",
    options: dict[str, str] | None = None,
    rebalance: bool = False,
) -> DataFrame:
    """Replace ``path`` (or, with ``replace="partitions"``, only the partitions written) and read it back.

    ``rebalance`` gathers rows by partition into files of AQE's advisory size, splitting a huge
    partition over many tasks. Without it every task writes a file to each partition it meets,
    which is right only where the input is already laid out that way.
    """
    if replace not in ("all", "partitions"):
        raise ValueError(f"replace must be 'all' or 'partitions', not {replace!r}")
    if rebalance and partition_by:
        df = df.hint("rebalance", *(F.col(c) for c in partition_by))
    mode = "dynamic" if replace == "partitions" else "static"
    writer = df.write.format(fmt).mode("overwrite").option("partitionOverwriteMode", mode)
    writer = writer.options(**(options or {}))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    # the declared types are kept: inferring them from paths would turn "006" into 6
    return df.sparkSession.read.format(fmt).schema(df.schema).load(path)


def version_path(root: str) -> str:
    """A new directory for a version below ``root``."""
    return f"{root.rstrip('/')}/version-{uuid.uuid4().hex}"


def publish_version(
    df: DataFrame,
    table: str,
    root: str,
    fmt: str = "parquet",
    partition_by: list[str] | None = None,
    rebalance: bool = True,
    check: Callable[[int], None] | None = None,
) -> str:
    """Write a new directory below ``root``, then point the catalog entry at it.

    Readers never see a half-written path, and a failed job leaves the table as it was; so does a
    ``check`` that raises, which gets the number of rows written. A table without partitions is
    switched in one step, a partitioned one partition by partition. Only a table whose columns,
    format or partitions change is missing from the catalog for a moment, as its entry is made anew.
    Superseded directories are for ``vacuum_plan`` to find.
    """
    location = version_path(root)
    written = overwrite_sink(df, location, fmt, partition_by, rebalance=rebalance)
    if check:
        check(written.count())
    point_table_at(df.sparkSession, table, df.schema, location, fmt, partition_by)
    return location


LOG_PARTITIONS = ["vc_id", "jr_id", "stream"]


def write_run_logs(
    lines: DataFrame, root: str, order: list[str] | None = None, mode: str = "overwrite"
) -> None:
    """Gzip text below ``vc_id=/jr_id=/stream=/batch=`` from rows (vc_id, jr_id, stream, line_no, line).

    Range partitioning over the ids and the order keeps a run's lines in sequence while letting a
    huge run span many tasks: its part files are numbered in line order, which ``read_run_logs``
    relies on. Choosing the ranges evaluates the input once more, so save an expensive one first.
    ``order`` names other columns than ``line_no`` to sequence the lines by. The batch is the time of
    the call in microseconds: with ``mode="append"`` the new lines come after all earlier ones.
    """
    keys = [*LOG_PARTITIONS, *(order or ["line_no"])]
    (
        lines.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select(*LOG_PARTITIONS, F.lit(time.time_ns() // 1000).alias("batch"), F.col("line").alias("value"))
        .write.mode(mode)
        .partitionBy(*LOG_PARTITIONS, "batch")
        .option("compression", "gzip")
        .text(root)
    )
