"""Which published versions of a table are kept: the newest, the young, and those that readers hold."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakesteward.functions.paths import canonical_path
from lakesteward.operators.maintenance import vacuum_execute, vacuum_plan
from lakesteward.plans.upkeep import referenced_files
from lakesteward.sources.manifest import file_manifest, path_exists, qualified
from lakesteward.sources.sinks import publish_version

HISTORY = "tbl STRING, location STRING, published TIMESTAMP"
LEASES = "lease STRING, location STRING, until TIMESTAMP"


def _folder(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/_{name}"


def publish_recorded(df: DataFrame, table: str, root: str, **options) -> str:
    """``publish_version``, with the version entered in the history below ``root``."""
    location = publish_version(df, table, root, **options)
    row = df.sparkSession.range(1).select(F.lit(table).alias("tbl"), F.lit(location).alias("location"), F.current_timestamp().alias("published"))
    row.coalesce(1).write.mode("append").parquet(_folder(root, "history"))
    return location


def version_history(spark: SparkSession, root: str) -> DataFrame:
    """tbl, location and time of every version published below ``root``, ever."""
    folder = _folder(root, "history")
    return spark.read.schema(HISTORY).parquet(folder) if path_exists(spark, folder) else spark.createDataFrame([], HISTORY)


def lease_version(spark: SparkSession, root: str, location: str, seconds: int) -> str:
    """Hold a version for ``seconds``, so that no vacuum takes its files; returns the lease."""
    lease = uuid.uuid4().hex
    until = F.timestamp_seconds(F.unix_timestamp() + seconds)
    row = spark.range(1).select(F.lit(lease).alias("lease"), F.lit(location).alias("location"), until.alias("until"))
    # a folder per lease, so that leasing and releasing never rewrite what others wrote
    row.coalesce(1).write.parquet(f"{_folder(root, 'leases')}/{lease}")
    return lease


def release_version(spark: SparkSession, root: str, lease: str) -> None:
    """Give a lease back; one that is gone already is none."""
    folder = f"{_folder(root, 'leases')}/{lease}"
    if path_exists(spark, folder):
        vacuum_execute(file_manifest(spark, [folder]), dry_run=False)


def leased_versions(spark: SparkSession, root: str) -> DataFrame:
    """Leases that have neither been released nor run out."""
    folder = _folder(root, "leases")
    if not path_exists(spark, folder):
        return spark.createDataFrame([], LEASES)
    return spark.read.schema(LEASES).option("recursiveFileLookup", True).parquet(folder).filter(F.col("until") > F.current_timestamp())


def kept_versions(spark: SparkSession, root: str, newest: int, younger_than: datetime) -> DataFrame:
    """Distinct ``location`` of the ``newest`` versions of each table, of those published at or after ``younger_than``, and of the leased ones."""
    order = Window.partitionBy("tbl").orderBy(F.desc("published"), F.desc("location"))
    recorded = version_history(spark, root).withColumn("place", F.row_number().over(order))
    kept = recorded.filter((F.col("place") <= newest) | (F.col("published") >= F.lit(younger_than))).select("location")
    return kept.unionByName(leased_versions(spark, root).select("location")).distinct()


def vacuum_versions(
    spark: SparkSession, tables: list[str], root: str, newest: int, younger_than: datetime, dry_run: bool = True
) -> DataFrame:
    """Delete the files of versions below ``root`` that are neither kept nor referred to by the ``tables``' entries.

    Only folders that the history names are touched: what else lies below ``root`` stays, as does a
    version that is being written. A partition that a later version did not touch lies in an old one and is referred
    to. Files count as the catalog's by their path, and as a version's by its folder.
    """
    root = qualified(spark, root)

    def keyed(manifest: DataFrame) -> DataFrame:
        return manifest.withColumn("key", canonical_path(F.col("path")))

    known = version_history(spark, root).select(canonical_path(F.col("location")).alias("version")).distinct()
    kept = kept_versions(spark, root, newest, younger_than).select(canonical_path(F.col("location")).alias("version"))
    folder = F.regexp_extract("key", "^(.*/version-[0-9a-f]+)/", 1)
    listed = keyed(file_manifest(spark, [root])).withColumn("version", folder)
    unkept = listed.join(known, "version", "left_semi").join(kept, "version", "left_anti")
    # every file of an unkept version is old enough: its version is what has an age
    plan = vacuum_plan(unkept.withColumn("age", F.lit(0)), keyed(referenced_files(spark, tables)), 1, key="key", age="age")
    return vacuum_execute(plan, dry_run)
