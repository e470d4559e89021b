"""Compaction and vacuum of catalogued tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesteward.functions.paths import canonical_path
from lakesteward.operators.maintenance import compact, file_count_for, vacuum_execute, vacuum_plan
from lakesteward.operators.manifests import manifest_summary
from lakesteward.plans.packing import table_files, table_folders
from lakesteward.sources.catalog import catalogued_tables, referenced_locations, table_location
from lakesteward.sources.manifest import MANIFEST_SCHEMA, file_manifest, path_exists
from lakesteward.sources.sinks import lies_below, publish_version, same_or_nested


def compact_table(
    spark: SparkSession,
    table: str,
    root: str,
    cluster_cols: list[str],
    target_bytes: int = 512 * 1024 * 1024,
) -> str:
    """Rewrite a catalogued table into files of about ``target_bytes`` and publish the result.

    A partitioned table keeps its partitions: they lead the clustering, so that each task writes
    to few of them and a huge one is shared out over many tasks.
    """
    size = manifest_summary(table_files(spark, table)).first()["bytes"]
    partitions = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    order = [*partitions, *(c for c in cluster_cols if c not in partitions)]
    packed = compact(spark.table(table), file_count_for(size, target_bytes), order, from_scan=True)
    return publish_version(packed, table, root, partition_by=partitions, rebalance=False)


def referenced_files(spark: SparkSession, tables: list[str]) -> DataFrame:
    """Manifest of all files that the tables' entries refer to, hidden ones of their folders included."""
    found = None
    for table in tables:
        spark.catalog.refreshTable(table)
        partitioned = any(c.isPartition for c in spark.catalog.listColumns(table))
        location = table_location(spark, table)
        if partitioned:
            own = file_manifest(spark, folders, recursive=False) if (folders := table_folders(spark, table)) else None
        else:
            own = file_manifest(spark, [location]) if location and path_exists(spark, location) else None
        if own is not None:
            found = own if found is None else found.unionByName(own)
    return spark.createDataFrame([], MANIFEST_SCHEMA) if found is None else found


def canonical_name(spark: SparkSession, table: str) -> str:
    """``database.table`` in lower case, the current database where none is named."""
    database, _, name = table.rpartition(".")
    return f"{database or spark.catalog.currentDatabase()}.{name}".lower()


def vacuum_tables(
    spark: SparkSession, request: dict[str, list[str]], root: str, cutoff: datetime, dry_run: bool = True
) -> DataFrame:
    """Files below ``root`` that no current location of the requested tables contains.

    ``request`` has the form ``{"vacuum_delta_tables": ["db.table", …]}``. ``root`` must hold
    versions of these tables only, and the current version of each; if any other catalogued table
    lies there, or contains ``root``, nothing is planned. The partitions of a table may lie in
    several versions; what the catalog refers to are the files of all of them. Files are matched by the
    canonical form of their paths, as a catalog may spell a location differently.
    """
    tables = request["vacuum_delta_tables"]
    live = referenced_locations(spark, tables)
    outside = [location for location in live if not lies_below(location, root)]
    if outside or not live:
        raise ValueError(f"the tables' locations are not below {root}: {outside or request}")

    asked = {canonical_name(spark, t) for t in request["vacuum_delta_tables"]}
    strangers = []
    for name in catalogued_tables(spark):
        location = None if canonical_name(spark, name) in asked else table_location(spark, name)
        if location and same_or_nested(location, root):
            strangers.append(name)
    if strangers:
        raise ValueError(f"{root} also holds tables that were not asked for: {strangers}")

    def keyed(manifest: DataFrame) -> DataFrame:
        return manifest.withColumn("key", canonical_path(F.col("path")))

    plan = vacuum_plan(keyed(file_manifest(spark, [root])), keyed(referenced_files(spark, tables)), cutoff, key="key")
    return vacuum_execute(plan, dry_run)
