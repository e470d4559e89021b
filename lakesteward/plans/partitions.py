"""Changes of a catalogued table that rewrite only the partitions they touch."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesteward.operators.matching import upsert
from lakesteward.operators.quality import row_count
from lakesteward.operators.tenants import TenantTable, ownership
from lakesteward.plans.offboard import CountMismatch
from lakesteward.session import saved
from lakesteward.sources.basic import rows_source
from lakesteward.sources.catalog import switch_partitions, written_partitions
from lakesteward.sources.sinks import overwrite_sink, publish_version, version_path

REPORT_SCHEMA = "tbl STRING, partitions INT, n_before BIGINT, n_after BIGINT, n_deleted BIGINT"

#: beyond this many partitions they are joined instead of written into the predicate
MAX_LITERAL_PARTITIONS = 1000


def partition_columns(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]


def in_partitions(df: DataFrame, columns: list[str], touched: DataFrame) -> DataFrame:
    """Rows of the partitions in ``touched``, which holds each of them once; other partitions' files are not opened.

    A short list becomes a predicate on the partition columns, and a long one a semi join that
    prunes the scan while it runs.
    """
    keys = touched.limit(MAX_LITERAL_PARTITIONS + 1).collect()
    if len(keys) > MAX_LITERAL_PARTITIONS:
        same = reduce(and_, (df[c].eqNullSafe(touched[c]) for c in columns))
        return df.join(touched, same, "left_semi")
    if not keys:
        return df.filter(F.lit(False))

    def one(key: tuple) -> Column:
        return reduce(and_, (F.col(f"`{c}`").eqNullSafe(F.lit(v).cast(df.schema[c].dataType)) for c, v in zip(columns, key, strict=True)))

    # values as text: a Python time without a zone would mean the zone of this process
    return df.filter(reduce(or_, (one(tuple(r)) for r in touched.select(*(F.col(f"`{c}`").cast("string") for c in columns)).collect())))


def rewrite_partitions(
    spark: SparkSession,
    table: str,
    root: str,
    touched: DataFrame,
    rewrite: Callable[[DataFrame], DataFrame],
    check: Callable[[int, int], None] | None = None,
) -> int:
    """Replace the partitions in ``touched`` by ``rewrite`` of their rows; returns how many there are.

    New directories are written below ``root``, one version for all partitions; ``check`` gets the
    numbers of rows before and after; then the catalog entries of these partitions move there. One
    without rows left leaves the catalog, and one that is new enters it. Other partitions keep
    their files, and old directories stay for a vacuum. The rows of ``rewrite`` must lie in the
    touched partitions, or in ones that had no rows.
    """
    columns = partition_columns(spark, table)
    fixed = saved(touched.select(*columns).distinct(), "touched-partitions")
    current = spark.table(table)
    rows = in_partitions(current, columns, fixed)
    location = version_path(root)
    written = overwrite_sink(rewrite(rows).select(*current.columns), location, partition_by=columns, rebalance=True)
    if check:
        check(row_count(rows).first()["n"], row_count(written).first()["n"])
    moved = written_partitions(spark, location)
    gone = fixed.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in columns)).toLocalIterator()
    emptied = {tuple(v if v != "" else None for v in r) for r in gone} - set(moved)
    switch_partitions(spark, table, columns, moved, emptied)
    return len(set(moved) | emptied)


def delete_tenants(
    spark: SparkSession, tables: list[TenantTable], tenant_keys: DataFrame | Iterable, root: str
) -> DataFrame:
    """``tenant_delete`` on catalogued tables, named by ``TenantTable.name``, partition by partition.

    A partition is touched if it holds a row of the tenants, found by a semi join on the key column
    and the partition columns alone. Tables without partitions are rewritten whole. Rows are counted
    before an entry moves, and a table whose counts do not add up stays as it was. Children are
    marked before anything changes. Reports touched partitions and rows before, after and deleted,
    of the touched partitions only.
    """
    marks = ownership(tables, tenant_keys, save=lambda df, name: saved(df, f"owned-{name.rpartition('.')[2]}"))
    owned = {t.name: marks[t.name].owned(t.df) for t in tables}
    deleted = {t.name: row_count(owned[t.name]).first()["n"] for t in tables}
    touched = {}
    for t in tables:
        columns = partition_columns(spark, t.name)
        touched[t.name] = saved(owned[t.name].select(*columns).distinct(), "touched-partitions") if columns else None
    report = []
    for t in tables:
        mark, counts = marks[t.name], []

        def check(before: int, after: int, name: str = t.name, counts: list = counts) -> None:
            counts += [before, after]
            if before - after != deleted[name]:
                raise CountMismatch(f"{name}: {before} rows less {deleted[name]} owned ones, but {after} written")

        if touched[t.name] is not None:
            n = rewrite_partitions(spark, t.name, root, touched[t.name], mark.others, check)
        elif deleted[t.name]:
            n = 0
            before = row_count(t.df).first()["n"]
            publish_version(mark.others(t.df), t.name, root, check=lambda after, before=before, check=check: check(before, after))
        else:
            n, counts = 0, [0, 0]
        report.append((t.name, n, *counts, deleted[t.name]))
    return rows_source(spark, report, REPORT_SCHEMA)


def upsert_table(spark: SparkSession, table: str, updates: DataFrame, key: str | list[str], root: str, order: str | None = None) -> int:
    """``upsert`` into a partitioned catalogued table; returns the number of touched partitions.

    Touched are the partitions of the rows that are updated, and those that updated and new rows go
    to: an update may move a row to another partition.
    """
    keys = [key] if isinstance(key, str) else list(key)
    columns = partition_columns(spark, table)
    current = spark.table(table)
    stored = saved(updates, "upsert-updates")
    held = saved(current.select(*dict.fromkeys([*keys, *columns])).join(stored.select(*keys), keys, "left_semi"), "upsert-held")
    carried = [c for c in columns if c in stored.columns]
    if len(carried) == len(columns):
        targets = stored.select(*(F.col(f"`{c}`").cast(current.schema[c].dataType).alias(c) for c in columns))
    else:
        # a column that the updates lack keeps its value, or is null in a new row
        named = stored.select(*dict.fromkeys([*keys, *carried]))
        kept = [c for c in columns if c not in carried]
        targets = named.join(held.select(*dict.fromkeys([*keys, *kept])), keys, "left").select(
            *(F.col(f"`{c}`").cast(current.schema[c].dataType).alias(c) for c in columns)
        )
    touched = held.select(*columns).unionByName(targets).distinct()
    return rewrite_partitions(spark, table, root, touched, lambda rows: upsert(rows, stored, keys, order).drop("action"))
