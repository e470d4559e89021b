"""Orderings, top rows and global numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesteward.functions.names import spare_names
from lakesteward.session import saved


def priority_rank(column: str, order: list[str]) -> Column:
    """Position in ``order``; anything else, null included, ranks last."""
    position = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return F.coalesce(F.nullif(position, F.lit(0).cast("bigint")), F.lit(len(order) + 1).cast("bigint"))


def with_ties_placed(df: DataFrame, order: list[str | Column], from_scan: bool = False) -> tuple[DataFrame, list[str]]:
    """Add a hash and a place, which tell rows of equal ``order`` apart, even copies; also their names.

    As last columns of a range partitioning they spread a hot value over tasks. The place of a
    row is its position in its task, taken after a sort within the task: a task that is repeated
    after an executor is lost may read its input in another order, and must still give the same
    number of copies to each range. With ``from_scan`` the caller states that ``df`` is a scan with
    filters and projections at most; its order repeats by itself and needs no sort.
    """
    ties = spare_names(df.columns, "_hash", "_place")
    comparable = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    hashed = df.withColumn(ties[0], F.xxhash64(*(F.col(f"`{c}`") for c in comparable)))
    repeatable = hashed if from_scan else hashed.sortWithinPartitions(*order, ties[0])
    return repeatable.withColumn(ties[1], F.monotonically_increasing_id()), ties


def priority_order(
    df: DataFrame, column: str, order: list[str], then: list[str] | None = None, from_scan: bool = False
) -> DataFrame:
    """Sort by a custom order, unknown values last, with ``then`` breaking ties.

    Rows that are still equal are told apart, so that a hot value is sorted by many tasks.
    """
    keys = [priority_rank(column, order), *(then or [])]
    placed, ties = with_ties_placed(df, keys, from_scan)
    return placed.orderBy(*keys, *ties).drop(*ties)


def first_n(df: DataFrame, order: list[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows: each task keeps its own ``n`` and only those are merged."""
    return df.orderBy(*order).limit(n)


def ordinal_of_total(df: DataFrame, order: list[str], from_scan: bool = False) -> DataFrame:
    """Add a global 1-based ``idx`` in ``order`` and the row count ``total``; an input with such columns is refused.

    A global window would run in one task. Instead the rows are range-sorted once and saved to
    the shared folder, so that the row ids given there stay fixed; each sorted partition then
    needs only an offset, and there are no more offsets than partitions. Rows with equal order
    values are told apart, so a hot value also spreads.
    """
    if {"idx", "total"} & {c.lower() for c in df.columns}:
        raise ValueError("the input has a column idx or total")
    placed, ties = with_ties_placed(df, order, from_scan)
    ranged = placed.sort(*order, *ties).drop(*ties)
    row, task, first = spare_names([*df.columns, "idx", "total"], "_row", "_part", "_offset")
    rows = saved(ranged.withColumn(row, F.monotonically_increasing_id()), "ordinal")
    part, within = F.shiftright(row, 33), F.col(row).bitwiseAND(2**33 - 1)
    before = Window.orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(part.alias(task)).agg(F.count("*").alias("_n"))
    offsets = sizes.select(
        task,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(first),
        F.sum("_n").over(Window.partitionBy()).alias("total"),
    )
    # one row per partition of the sort, a number the session's settings bound
    return (
        rows.withColumn(task, part)
        .join(F.broadcast(offsets), task)
        .withColumn("idx", F.col(first) + within + 1)
        .select(*(rows[f"`{c}`"] for c in df.columns), "idx", offsets["total"])
    )
