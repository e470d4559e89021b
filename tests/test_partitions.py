"""Changes that rewrite touched partitions only."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from lakesteward.operators.tenants import TenantTable
from lakesteward.plans.offboard import CountMismatch
from lakesteward.plans.partitions import delete_tenants, in_partitions, rewrite_partitions, upsert_table
from lakesteward.sources.catalog import catalogued_partitions, table_location
from lakesteward.sources.sinks import publish_version


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names}


def read(spark, table):
    return sorted(map(tuple, spark.table(table).collect()), key=str)


@pytest.fixture
def parted(spark, tmp_path):
    rows = [(i, i % 5, f"t{i % 3}") for i in range(60)] + [(100, None, "t0"), (101, 9, None), (102, 8, "a/b=c %")]
    name = f"parted_{tmp_path.name}".replace("-", "_")
    publish_version(spark.createDataFrame(rows, "id BIGINT, org INT, t STRING"), name, str(tmp_path / "v"), partition_by=["org", "t"])
    return name, rows, tmp_path


def test_deleting_a_tenant_leaves_other_partitions_alone(spark, parted):
    name, rows, root = parted
    before = files(root)
    report = delete_tenants(spark, [TenantTable(name, spark.table(name), tenant_col="org")], [3, 8], str(root / "v")).first()
    assert (report["partitions"], report["n_before"], report["n_after"], report["n_deleted"]) == (4, 13, 0, 13)
    assert read(spark, name) == sorted([(i, o, t) for i, o, t in rows if o not in (3, 8)], key=str)
    after = files(root)
    assert {p: after.get(p) for p in before} == before
    assert not [p for p in set(after) - set(before) if p.endswith(".parquet")]
    assert not {("3", "t0"), ("8", "a/b=c %")} & catalogued_partitions(spark, name)


def test_deleting_children_through_a_parent(spark, parted):
    name, rows, root = parted
    parent = spark.createDataFrame([(i, 6 if i in (7, 8, 100, 102) else 1) for i, _, _ in rows], "id BIGINT, tenant INT")
    publish_version(parent, f"{name}_p", str(root / "p"))
    tables = [
        TenantTable(f"{name}_p", spark.table(f"{name}_p"), tenant_col="tenant", key="id"),
        TenantTable(name, spark.table(name), parent=f"{name}_p", fk="id"),
    ]
    before = files(root / "v")
    report = {r["tbl"]: r for r in delete_tenants(spark, tables, [6], str(root / "v")).collect()}
    assert (report[name]["partitions"], report[name]["n_deleted"], report[f"{name}_p"]["n_deleted"]) == (4, 4, 4)
    assert read(spark, name) == sorted([r for r in rows if r[0] not in (7, 8, 100, 102)], key=str)
    assert {p: t for p, t in files(root / "v").items() if p in before} == before
    # the partitions of one row each are gone, the two others have moved
    assert (None, "t0") not in catalogued_partitions(spark, name)
    # nothing is left to do
    again = delete_tenants(spark, [TenantTable(t.name, spark.table(t.name), t.tenant_col, t.key, t.parent, t.fk) for t in tables], [6], str(root / "v"))
    assert {(r["partitions"], r["n_deleted"]) for r in again.collect()} == {(0, 0)}


def test_wrong_counts_leave_the_table_as_it_was(spark, parted):
    name, rows, root = parted
    touched = spark.createDataFrame([(3, "t0")], "org INT, t STRING")

    def check(before, after):
        raise CountMismatch(f"{before} {after}")

    with pytest.raises(CountMismatch, match="4 2"):
        rewrite_partitions(spark, name, str(root / "v"), touched, lambda df: df.filter("id > 20"), check)
    assert read(spark, name) == sorted(rows, key=str)


def test_upsert_touches_old_and_new_partitions(spark, parted):
    name, rows, root = parted
    before = files(root)
    changes = [(7, 2, "moved"), (200, 1, "t1"), (201, None, None), (102, 8, "a/b=c %")]
    updates = spark.createDataFrame(changes, "id BIGINT, org INT, t STRING")
    # 7: from (2, t1) to (2, moved); 200: to (1, t1); 201 to (null, null); 102 stays
    assert upsert_table(spark, name, updates, "id", str(root / "v")) == 5
    new = {r[0]: r for r in rows} | {c[0]: c for c in changes}
    assert read(spark, name) == sorted(new.values(), key=str)
    assert {p: t for p, t in files(root).items() if p in before} == before
    # without the partition columns rows stay where they are
    assert upsert_table(spark, name, spark.createDataFrame([(7, "again")], "id BIGINT, t STRING"), "id", str(root / "v")) == 2
    assert (7, 2, "again") in [tuple(r) for r in spark.table(name).filter("id = 7").collect()]


def test_only_touched_partitions_are_read(spark, parted):
    name, _, _ = parted
    touched = spark.createDataFrame([(3, "t0"), (None, "t0")], "org INT, t STRING")
    rows = in_partitions(spark.table(name), ["org", "t"], touched)
    assert rows.inputFiles() and rows.count() == 5
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    assert in_partitions(spark.table(name), ["org", "t"], touched.limit(0)).count() == 0


def test_many_touched_partitions_are_joined(spark, parted, monkeypatch):
    from lakesteward.plans import partitions

    name, _, _ = parted
    monkeypatch.setattr(partitions, "MAX_LITERAL_PARTITIONS", 1)
    touched = spark.createDataFrame([(3, "t0"), (None, "t0"), (9, None)], "org INT, t STRING")
    assert in_partitions(spark.table(name), ["org", "t"], touched).count() == 6


def test_a_partitioned_version_is_published_without_a_gap(spark, tmp_path, monkeypatch):
    from lakesteward.sources import catalog

    name = "gapless"
    one = spark.createDataFrame([(1, date(2024, 1, 1)), (2, date(2024, 1, 2))], "id INT, d DATE")
    publish_version(one, name, str(tmp_path), partition_by=["d"])

    def no_gap(*_):
        raise AssertionError("the entry is made anew")

    monkeypatch.setattr(catalog, "register_table", no_gap)
    two = spark.createDataFrame([(3, date(2024, 1, 2)), (4, date(2024, 1, 3))], "id INT, d DATE")
    location = publish_version(two, name, str(tmp_path), partition_by=["d"])
    assert read(spark, name) == sorted(map(tuple, two.collect()), key=str)
    assert catalogued_partitions(spark, name) == {("2024-01-02",), ("2024-01-03",)}
    assert table_location(spark, name).endswith(location)
    assert spark.table(name).filter(F.col("d") == date(2024, 1, 1)).isEmpty()
