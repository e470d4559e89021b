"""Versions that are kept, held and vacuumed."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lakesteward.operators.tenants import TenantTable
from lakesteward.plans.partitions import delete_tenants
from lakesteward.plans.retention import (
    kept_versions, lease_version, leased_versions, publish_recorded, release_version, vacuum_versions, version_history,
)
from lakesteward.plans.upkeep import compact_table, vacuum_tables

LONG_AGO, SOON = datetime(2000, 1, 1), datetime.now() + timedelta(days=1)


def files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def published(spark, tmp_path, n):
    name = f"kept_{tmp_path.name}".replace("-", "_")
    return name, [publish_recorded(spark.range(10 * (i + 1)), name, str(tmp_path)) for i in range(n)]


def test_a_leased_version_survives_a_vacuum_and_goes_after_its_release(spark, tmp_path):
    name, versions = published(spark, tmp_path, 4)
    assert version_history(spark, str(tmp_path)).count() == 4
    reader = spark.read.parquet(versions[0])
    lease = lease_version(spark, str(tmp_path), versions[0], 3600)
    lease_version(spark, str(tmp_path), versions[1], -1)  # has run out
    planned = vacuum_versions(spark, [name], str(tmp_path), newest=2, younger_than=SOON)
    assert {os.path.dirname(r["path"]) for r in planned.collect()} == {versions[1]} and files(versions[1])
    vacuum_versions(spark, [name], str(tmp_path), newest=2, younger_than=SOON, dry_run=False)
    assert not files(versions[1]) and all(files(versions[i]) for i in (0, 2, 3))
    assert reader.count() == 10 and spark.table(name).count() == 40
    release_version(spark, str(tmp_path), lease)
    release_version(spark, str(tmp_path), lease)
    assert leased_versions(spark, str(tmp_path)).filter(F.col("lease") == lease).isEmpty()
    vacuum_versions(spark, [name], str(tmp_path), newest=2, younger_than=SOON, dry_run=False)
    assert not files(versions[0]) and spark.table(name).count() == 40


def test_young_versions_and_foreign_files_stay(spark, tmp_path):
    name, versions = published(spark, tmp_path, 3)
    spark.range(3).write.parquet(str(tmp_path / "version-abc"))  # nobody published it
    assert {r["location"] for r in kept_versions(spark, str(tmp_path), 1, LONG_AGO).collect()} == set(versions)
    assert vacuum_versions(spark, [name], str(tmp_path), 1, LONG_AGO, dry_run=False).isEmpty()
    # even with nothing kept, what the catalog refers to stays
    vacuum_versions(spark, [name], str(tmp_path), 0, SOON, dry_run=False)
    assert spark.table(name).count() == 30 and files(tmp_path / "version-abc") and not files(versions[1])
    assert kept_versions(spark, str(tmp_path / "none"), 5, LONG_AGO).isEmpty()


def test_partitions_in_several_versions_are_not_vacuumed(spark, tmp_path):
    name = f"mixed_{tmp_path.name}".replace("-", "_")
    rows = spark.range(60).select("id", (F.col("id") % 4).alias("p"), F.when(F.col("id") % 20 < 4, 6).otherwise(7).alias("org"))
    first = publish_recorded(rows, name, str(tmp_path), partition_by=["p"])
    delete_tenants(spark, [TenantTable(name, spark.table(name).filter("p < 2"), tenant_col="org")], [6], str(tmp_path))
    left = sorted(map(tuple, spark.table(name).select("id", "org", "p").collect()))
    assert len(left) == 60 - 6
    before = files(first)
    request = {"vacuum_delta_tables": [name]}
    gone = {r["path"] for r in vacuum_tables(spark, request, str(tmp_path), SOON, dry_run=False).collect()}
    # the two rewritten partitions of the first version go, the two others stay
    assert {p.split("/")[-2] for p in gone if "/p=" in p} == {"p=0", "p=1"} and len(files(first)) == len(before) / 2
    assert sorted(map(tuple, spark.table(name).select("id", "org", "p").collect())) == left
    compact_table(spark, name, str(tmp_path), ["id"])
    assert sorted(map(tuple, spark.table(name).select("id", "org", "p").collect())) == left
    vacuum_tables(spark, request, str(tmp_path), SOON, dry_run=False)
    assert spark.table(name).count() == 54
