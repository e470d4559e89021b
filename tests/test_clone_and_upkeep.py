import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lakesteward.operators.maintenance import compact, file_count_for, vacuum_execute, vacuum_plan
from lakesteward.plans.clone import clone_prefixes, clone_table, remap, remove_others
from lakesteward.plans.upkeep import compact_table, vacuum_tables
from lakesteward.sources.catalog import table_location
from lakesteward.sources.manifest import file_manifest
from lakesteward.sources.sinks import overwrite_sink, publish_version


def names(root):
    return {os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs}


def test_clone_scope_and_replace_modes(spark, sf_dir, tmp_path):
    source, target = f"{sf_dir}/customer.parquet", str(tmp_path / "c")
    customer = spark.read.parquet(source)
    full = clone_table(spark, source, target, partition_by=["c_nationkey"])
    assert full.count() == customer.count()
    one = clone_table(spark, source, target, {"c_nationkey": [6]}, "partitions", partition_by=["c_nationkey"])
    assert one.count() == customer.count()
    only = clone_table(spark, source, target, {"c_nationkey": [6]}, partition_by=["c_nationkey"])
    assert only.count() == customer.filter("c_nationkey = 6").count()
    pruned = spark.read.parquet(target).filter("c_nationkey = 6")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(c_nationkey" in pruned
    with pytest.raises(ValueError, match="overlaps"):
        clone_table(spark, target, target + "/sub")


def test_hot_partition_is_split_over_files(spark, tmp_path):
    rows = spark.range(200000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("t"), F.lit(1).alias("k"))
    overwrite_sink(rows, str(tmp_path / "src"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4m")
    try:
        clone_table(spark, str(tmp_path / "src"), str(tmp_path / "dst"), partition_by=["k"])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128m")
    assert len([n for n in names(tmp_path / "dst" / "k=1") if n.endswith(".parquet")]) > 1


def test_remap():
    assert [remap(p, "qa", "local") for p in ("qa/gold", "qa", "qaX/gold", "common")] == ["local/gold", "local", "qaX/gold", "common"]


def test_clone_prefixes(spark, tmp_path):
    src, dst = tmp_path / "src", tmp_path / "dst"
    rows = spark.createDataFrame([(1, "006"), (2, "6"), (3, "7")], "v INT, organization_id STRING")
    overwrite_sink(rows, str(src / "qa/gold/rollup/valid"), partition_by=["organization_id"])
    overwrite_sink(rows.select("v"), str(src / "qa/silver/flat"))
    overwrite_sink(rows.select("v"), str(src / "common/shared"))
    (dst / "leftover").mkdir(parents=True)
    (dst / "leftover" / "old.parquet").write_text("x")
    total = clone_prefixes(
        spark, str(src), str(dst),
        ["qa/gold/rollup/valid/_delta_log", "qa/gold/rollup/valid/organization_id=006", "common", "qa/absent"],
    ).first()
    assert total["objects"] == sum(n.endswith(".parquet") for n in names(dst)) == 4
    copied = {n.rsplit("/", 1)[0] for n in names(dst) if n.endswith(".parquet")}
    assert copied == {"local/gold/rollup/valid/organization_id=006", "common/shared"}
    clone_prefixes(spark, str(src), str(dst))
    copied = {n.rsplit("/", 1)[0] for n in names(dst) if n.endswith(".parquet")}
    assert copied == {f"local/gold/rollup/valid/organization_id={v}" for v in ("006", "6", "7")} | {"local/silver/flat"}
    both = spark.read.schema("v INT, organization_id STRING").parquet(str(dst / "local/gold/rollup/valid"))
    assert sorted(map(tuple, both.collect())) == [(1, "006"), (2, "6"), (3, "7")]
    with pytest.raises(ValueError):
        clone_prefixes(spark, str(src), str(src / "inside"))


def test_clone_of_escaped_and_null_partitions(spark, tmp_path):
    src, dst = tmp_path / "src", tmp_path / "dst"
    rows = spark.createDataFrame([(1, "a:b"), (2, None), (3, "c"), (4, "a b")], "v INT, p STRING")
    overwrite_sink(rows, str(src / "qa/gold/t"), partition_by=["p"])
    chosen = ["qa/gold/t/p=a%3Ab", "qa/gold/t/p=__HIVE_DEFAULT_PARTITION__", "qa/gold/t/p=c", "qa/gold/t/p=c"]
    assert clone_prefixes(spark, str(src), str(dst), chosen).first()["objects"] == 3
    back = spark.read.schema("v INT, p STRING").parquet(str(dst / "local/gold/t"))
    assert sorted(map(tuple, back.collect())) == [(1, "a:b"), (2, None), (3, "c")]


def test_clone_merges_columns_and_refuses_table_logs(spark, tmp_path):
    src = tmp_path / "src"
    spark.createDataFrame([(1,)], "a INT").write.parquet(str(src / "qa/gold/t"))
    spark.createDataFrame([(2, "x")], "a INT, b STRING").write.mode("append").parquet(str(src / "qa/gold/t"))
    clone_prefixes(spark, str(src), str(tmp_path / "dst"), ["qa/gold"])
    back = spark.read.parquet(str(tmp_path / "dst/local/gold/t"))
    assert sorted(map(tuple, back.select("a", "b").collect())) == [(1, None), (2, "x")]
    (src / "qa/gold/t/_delta_log").mkdir()
    (src / "qa/gold/t/_delta_log/0.json").write_text("{}")
    with pytest.raises(ValueError, match="transaction log"):
        clone_prefixes(spark, str(src), str(tmp_path / "dst"), ["qa/gold"])
    assert spark.read.parquet(str(tmp_path / "dst/local/gold/t")).count() == 2


def test_removing_others_takes_thousands_of_tables(spark, tmp_path):
    (tmp_path / "t1" / "k=1").mkdir(parents=True)
    (tmp_path / "t1" / "k=1" / "x").write_text("x")
    (tmp_path / "t10").mkdir()
    (tmp_path / "t10" / "y").write_text("y")
    remove_others(spark, str(tmp_path), [f"{tmp_path}/t1", *(f"{tmp_path}/u{i}" for i in range(2000))]).collect()
    assert names(tmp_path) == {"t1/k=1/x"}


def test_vacuum_refuses_roots_with_other_tables(spark, tmp_path):
    suffix = os.path.basename(tmp_path).replace("-", "_")
    first, second, root = f"vac_a_{suffix}", f"vac_b_{suffix}", str(tmp_path / "shared")
    publish_version(spark.range(10), first, root)
    publish_version(spark.range(20), second, root)
    soon = datetime.now() + timedelta(days=1)
    with pytest.raises(ValueError, match=second):
        vacuum_tables(spark, {"vacuum_delta_tables": [first]}, root, soon, dry_run=False)
    assert spark.table(second).count() == 20
    assert vacuum_tables(spark, {"vacuum_delta_tables": [first, second]}, root, soon).isEmpty()


@pytest.mark.parametrize("from_scan", [True, False])
def test_compact_keeps_rows_and_splits_a_hot_value(spark, tmp_path, from_scan):
    # two thirds of the rows are copies of one row
    rows = spark.range(30000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"))
    overwrite_sink(rows.repartition(25), str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))
    packed = compact(source, 6, ["k"], from_scan)
    overwrite_sink(packed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.exceptAll(source).isEmpty() and source.exceptAll(back).isEmpty()
    sizes = [r["n"] for r in back.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 6 and max(sizes) < 2 * 30000 / 6


def test_file_count():
    assert [file_count_for(n, 10) for n in (0, 1, 10, 11)] == [1, 1, 1, 2]


def test_vacuum_plan(spark):
    listed = spark.createDataFrame([("a", 1), ("b", 1), ("c", 9), (None, 1)], "path STRING, mtime INT")
    used = spark.createDataFrame([("a",), (None,)], "path STRING")
    got = vacuum_plan(listed, used, 5).collect()
    assert {r["path"] for r in got} == {"b", None}


def test_vacuum_execute(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text("x")
    plan = spark.createDataFrame([(f"{tmp_path}/a",), (f"{tmp_path}/gone",)], "path STRING")
    assert {r["status"] for r in vacuum_execute(plan).collect()} == {"planned"}
    assert names(tmp_path) == {"a", "b"}
    outcome = vacuum_execute(plan, dry_run=False)
    assert [r["status"] for r in outcome.collect()] == ["deleted", "deleted"]
    assert names(tmp_path) == {"b"}


def test_compact_and_vacuum_a_table(spark, tmp_path):
    root, name = str(tmp_path / "versions"), f"upkeep_{os.path.basename(tmp_path).replace('-', '_')}"
    publish_version(spark.range(1000).repartition(20), name, root)
    old = table_location(spark, name)
    compact_table(spark, name, root, ["id"])
    assert spark.table(name).count() == 1000
    new = table_location(spark, name)
    assert old != new and file_manifest(spark, [new]).filter("path LIKE '%.parquet'").count() == 1
    request, soon = {"vacuum_delta_tables": [name]}, datetime.now() + timedelta(days=1)
    assert vacuum_tables(spark, request, root, datetime(2000, 1, 1)).isEmpty()
    with pytest.raises(ValueError, match="not below"):
        vacuum_tables(spark, request, str(tmp_path / "elsewhere"), soon)
    for spelling in (f"file://{root}", f"file:{root}/"):
        assert vacuum_tables(spark, request, spelling, soon).filter("path LIKE '%.parquet'").count() == 20
    planned = vacuum_tables(spark, request, root, soon)
    assert planned.filter("path LIKE '%.parquet'").count() == 20
    assert not any(r["path"].startswith(new.replace("file:", "")) for r in planned.collect())
    vacuum_tables(spark, request, root, soon, dry_run=False)
    spark.catalog.refreshTable(name)
    assert spark.table(name).count() == 1000
    assert all(n.startswith(os.path.basename(new)) for n in names(root))


def test_compacting_keeps_partitions(spark, tmp_path):
    root, name = str(tmp_path / "versions"), f"parted_{os.path.basename(tmp_path).replace('-', '_')}"
    rows = spark.range(900).select("id", (F.col("id") % 3).cast("int").alias("k"))
    publish_version(rows, name, root, partition_by=["k"])
    compact_table(spark, name, root, ["id"])
    assert spark.table(name).count() == 900
    assert [c.name for c in spark.catalog.listColumns(name) if c.isPartition] == ["k"]
    plan = spark.table(name).filter("k = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(k" in plan
