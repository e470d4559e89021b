"""Removing a tenant from a set of tables as one job."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from lakesteward.operators.quality import row_count
from lakesteward.operators.tenants import TenantTable, ownership
from lakesteward.plans.journal import Journal
from lakesteward.session import saved
from lakesteward.sources.basic import rows_source
from lakesteward.sources.catalog import point_table_at
from lakesteward.sources.sinks import overwrite_sink

REPORT_SCHEMA = "tbl STRING, n_before BIGINT, n_after BIGINT, n_deleted BIGINT, location STRING"


class CountMismatch(RuntimeError):
    """A rewritten table does not have the number of rows it should have."""


class OtherRequest(ValueError):
    """The journal belongs to another request."""


def offboard_tenant(
    spark: SparkSession,
    tables: list[TenantTable],
    tenant_keys: DataFrame | Iterable,
    root: str,
    catalog_names: dict[str, str] | None = None,
    journal: str | None = None,
) -> DataFrame:
    """Delete the tenants' rows everywhere and report rows before, after and deleted per table.

    Three phases, so that no table is switched unless all are right: write a new version of each
    table below ``root``; check that the rows written and the rows owned add up to the rows there
    were; then move the catalog entries given in ``catalog_names``. Whole-table counts come from
    Parquet footers and the owned rows are counted over the key column alone.

    ``journal`` names a folder in the shared storage for the finished steps. A job that died is
    started again with the same arguments and goes on behind the last finished step: key sets,
    versions and counts are taken from before, and no table is written or counted twice. The same
    journal with other tables, another root or other listed keys is refused; keys in a DataFrame
    are those of the first start.
    """
    steps = Journal(spark, journal)
    listed = not isinstance(tenant_keys, DataFrame)
    if listed:
        tenant_keys = list(tenant_keys)
    request = {
        "tables": [[t.name, t.tenant_col, t.key, t.parent, t.fk, list(t.partition_by)] for t in tables],
        "root": root, "catalog": catalog_names or {}, "keys": sorted({str(k) for k in tenant_keys if k is not None}) if listed else None,
    }
    if steps.once("request", lambda: request) != request:
        raise OtherRequest(f"{journal} is the journal of another request")
    if journal is None:
        marks = ownership(tables, tenant_keys, save=lambda df, name: saved(df, f"owned-{name}"))
    else:
        if not listed:
            tenant_keys = steps.stored(tenant_keys, "keys")
        marks = ownership(tables, tenant_keys, save=lambda df, name: steps.stored(df, f"owned-{name}"))

    def write(table: TenantTable) -> dict:
        overwrite_sink(
            marks[table.name].others(table.df),
            os.path.join(root, table.name),
            partition_by=list(table.partition_by),
            # a predicate leaves the rows where the scan found them, a join may scatter them
            rebalance=isinstance(marks[table.name].values, DataFrame),
        )
        return {}

    def count(table: TenantTable) -> dict:
        written = spark.read.schema(table.df.schema).parquet(os.path.join(root, table.name))
        parts = {"n_before": table.df, "n_after": written, "n_deleted": marks[table.name].owned(table.df)}
        return {part: row_count(df).first()["n"] for part, df in parts.items()}

    def switch(table: TenantTable, entry: str) -> dict:
        point_table_at(spark, entry, table.df.schema, os.path.join(root, table.name), partition_by=list(table.partition_by))
        return {}

    for table in tables:
        steps.once(f"written-{table.name}", lambda table=table: write(table))
    report = []
    for table in tables:
        found = steps.once(f"counted-{table.name}", lambda table=table: count(table))
        before, after, deleted = (found[p] for p in ("n_before", "n_after", "n_deleted"))
        if before - after != deleted:
            raise CountMismatch(f"{table.name}: {before} rows less {deleted} owned ones, but {after} written")
        report.append((table.name, before, after, deleted, os.path.join(root, table.name)))
    for table in tables:
        entry = (catalog_names or {}).get(table.name)
        if entry:
            steps.once(f"switched-{table.name}", lambda table=table, entry=entry: switch(table, entry))
    return rows_source(spark, report, REPORT_SCHEMA)
