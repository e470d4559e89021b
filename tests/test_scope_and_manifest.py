import os

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from lakesteward.operators import manifests, scope
from lakesteward.sources.basic import range_source, rows_source
from lakesteward.sources.manifest import file_manifest, list_prefix, storage_opener, storage_options


def put(root, *names):
    for name in names:
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write("x" * len(name))


def keys(manifest):
    return sorted(r[0] for r in manifest.select(
        F.expr("substring(path, length(prefix) + 2)")).collect())


def test_sources(spark):
    assert range_source(spark, 1000).count() == 1000
    rows = rows_source(spark, [("seed-1", "local")], "id STRING, env STRING")
    assert [tuple(r) for r in rows.collect()] == [("seed-1", "local")]
    assert "LocalRelation" in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows_source(spark, [], "id STRING").isEmpty()


def test_listing_and_manifest(spark, tmp_path):
    root = str(tmp_path)
    put(root, "a.txt", "_delta_log/0.json", "t/k=1/part-0.parquet", "t/k=1/.part-0.crc", "t/k=2/deep/er/x", "t/_SUCCESS")
    one = {(os.path.basename(r["path"]), r["is_dir"], r["length"]) for r in list_prefix(spark, root).collect()}
    assert {x[:2] for x in one} == {("a.txt", False), ("_delta_log", True), ("t", True)}
    assert ("a.txt", False, 5) in one
    everything = file_manifest(spark, [root])
    assert keys(everything) == sorted(
        ["a.txt", "_delta_log/0.json", "t/k=1/part-0.parquet", "t/k=1/.part-0.crc", "t/k=2/deep/er/x", "t/_SUCCESS"]
    )
    assert everything.filter("mtime IS NULL").isEmpty()
    assert keys(manifests.data_files(everything)) == ["a.txt", "t/k=1/part-0.parquet", "t/k=2/deep/er/x"]
    both = file_manifest(spark, [f"{root}/t/k=1", f"{root}/t/k=2", f"{root}/t/k=1"])
    assert both.groupBy("prefix").count().count() == 2 and both.count() == 3
    assert file_manifest(spark, [root], recursive=False).count() == 1
    total = manifests.manifest_summary(everything).first()
    assert total["objects"] == 6 and total["bytes"] == sum(map(len, keys(everything)))


def test_listing_a_file_or_nothing(spark, tmp_path):
    put(str(tmp_path), "f.txt")
    assert [r["length"] for r in list_prefix(spark, f"{tmp_path}/f.txt").collect()] == [5]
    assert [r["length"] for r in list_prefix(spark, f"file://{tmp_path}/f.txt").collect()] == [5]
    with pytest.raises(PythonException, match="FileNotFoundError"):
        list_prefix(spark, f"{tmp_path}/absent").collect()


def test_empty_manifest_has_totals(spark, tmp_path):
    os.makedirs(tmp_path / "empty")
    assert tuple(manifests.manifest_summary(file_manifest(spark, [str(tmp_path / "empty")])).first()) == (0, 0)


def test_local_uri_forms():
    assert [storage_opener()(p)[1] for p in ("/a/b", "file:/a/b", "file:///a/b")] == ["/a/b"] * 3


def test_table_roots(spark):
    paths = ["/l/gold/t/k=1/j=2/p.parquet", "/l/gold/t/k=3/j=4/p.parquet", "/l/gold/flat/p.parquet"]
    frame = spark.createDataFrame([(p,) for p in paths], "path STRING")
    got = {(r["path"], tuple(r["partition_by"])) for r in manifests.table_roots(frame).collect()}
    assert got == {("/l/gold/t", ("k", "j")), ("/l/gold/flat", ())}


def test_sync_plan(spark):
    def at(n):
        return F.timestamp_seconds(F.lit(n))
    src = spark.createDataFrame([("same", 1), ("new", 1), ("longer", 2), ("newer", 1), ("unknown", None)], "key STRING, length BIGINT")
    dst = spark.createDataFrame([("same", 1), ("longer", 1), ("newer", 1), ("stale", 1), ("unknown", 4)], "key STRING, length BIGINT")
    src = src.withColumn("mtime", F.when(F.col("key") == "newer", at(20)).otherwise(at(10)))
    dst = dst.withColumn("mtime", F.when(F.col("key") == "same", at(15)).otherwise(at(10)))
    def actions(**kw):
        return {r["key"]: r["action"] for r in manifests.sync_plan(src, dst, **kw).collect()}
    expected = {"same": "same", "new": "copy_new", "longer": "copy_changed", "newer": "same", "stale": "stale", "unknown": "copy_changed"}
    assert actions(compare_mtime=False) == expected
    assert actions() == {**expected, "newer": "copy_changed"}
    # once everything is copied, nothing is left to do
    again = manifests.sync_plan(src, src).select("action").distinct().collect()
    assert [r[0] for r in again] == ["same"]


def test_filters(spark):
    defs = spark.createDataFrame([("gold", "a"), ("silver", "a"), ("bronze", "b"), ("other", "c")], "section STRING, name STRING")
    assert scope.filter_sections(defs).count() == 3
    assert scope.filter_sections(defs, ["gold", "absent"]).count() == 1
    assert scope.filter_tables(defs).count() == 4 and scope.filter_tables(defs, []).count() == 4
    assert scope.filter_tables(defs, ["a", "nope"]).count() == 2
    names = rows_source(spark, [("a",), ("a",), ("nope",)], "x STRING")
    assert scope.filter_tables(defs, names).count() == 2


def test_patterns(spark):
    frame = spark.createDataFrame([("a/__pycache__/x",), ("resources/y",), ("dags/vacuum_delta.py",), ("dags/vacuum_deltaXpy",)], "path STRING")
    kept = scope.exclude_globs(frame, ["*/__pycache__/*", "resources/*"])
    assert kept.count() == 2 and scope.exclude_globs(frame, []).count() == 4
    assert [r[0] for r in scope.match_names(frame, ["vacuum_delta.py", "zzz"]).collect()] == ["dags/vacuum_delta.py"]
    assert scope.match_names(frame, []).isEmpty()


def test_parse_scope():
    assert scope.parse_scope("gold/t/valid/organization_id=6") == ("gold/t/valid", {"organization_id": "6"})
    assert scope.parse_scope("qa/gold/") == ("qa/gold", {})


def test_name_collisions(spark):
    frame = spark.createDataFrame([("a/x.py",), ("b/x.py",), ("b/y.py",)], "path STRING")
    assert [tuple(r) for r in manifests.name_collisions(frame, "local").collect()] == [("local_x.py", 2)]


def test_storage_options_follow_the_spark_settings():
    class Context:
        def getConf(self):
            return {
                "spark.hadoop.fs.s3a.endpoint": "http://store:4566",
                "spark.hadoop.fs.s3a.access.key": "k",
                "spark.hadoop.fs.s3a.connection.ssl.enabled": "false",
            }

    class Session:
        sparkContext = Context()

    options = storage_options(Session())
    assert options == {"endpoint_override": "store:4566", "access_key": "k", "scheme": "http"}
    open_path = storage_opener({**options, "secret_key": "s", "region": "eu-west-1"})
    store, inner = open_path("s3a://bucket/a b/c")
    assert open_path("s3://bucket/d")[0] is store
    assert (store.type_name, inner) == ("s3", "bucket/a b/c")


def test_nested_prefixes_are_listed_once(spark, tmp_path):
    for name in ("a/x", "a/b/y", "ab/z"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    roots = [f"{tmp_path}/a/b", f"{tmp_path}/a", f"{tmp_path}/ab/", f"{tmp_path}/a"]
    assert sorted(r["path"] for r in file_manifest(spark, roots).collect()) == [f"{tmp_path}/{n}" for n in ("a/b/y", "a/x", "ab/z")]


def test_negated_sets_keep_later_exclamation_marks():
    import re

    from lakesteward.functions.paths import glob_to_regex

    pattern = re.compile(glob_to_regex("[!!a]").replace(r"\z", r"\Z"))
    assert [bool(pattern.match(t)) for t in ("!", "a", "b")] == [False, False, True]


def _manifests(spark, n, changed):
    source = spark.range(n).select(F.concat(F.lit("a/long/prefix/of/a/key/"), F.col("id")).alias("key"), (F.col("id") % 1000).alias("length"), F.lit(5).alias("mtime"))
    hit = F.pmod(F.xxhash64(F.col("key"), F.lit(1)), F.lit(10_000)) < changed * 10_000
    target = source.filter(~(hit & (F.col("length") % 3 == 0))).withColumn("length", F.when(hit & (F.col("length") % 3 == 1), F.lit(None)).otherwise(F.col("length")))
    target = target.withColumn("mtime", F.when(hit & (F.col("length") % 3 == 2), F.col("length") % 2 * 10).otherwise(F.col("mtime")))
    extra = spark.range(int(n * changed) // 10).select(F.concat(F.lit("extra/"), F.col("id")).alias("key"), F.lit(1).cast("bigint").alias("length"), F.lit(5).alias("mtime"))
    return source, target.unionByName(extra)


@pytest.mark.parametrize("changed", [0.0, 0.01, 1.0])
@pytest.mark.parametrize("compare_mtime", [True, False])
def test_sync_plan_by_ranges_gives_the_same_rows(spark, changed, compare_mtime):
    source, target = _manifests(spark, 20_000, changed)
    for a, b in ((source, target), (target, source), (source, target.limit(0)), (source.limit(0), target)):
        expected = manifests.sync_plan(a, b, compare_mtime=compare_mtime)
        found = manifests.sync_plan_by_ranges(a, b, compare_mtime=compare_mtime)
        assert found.columns == expected.columns
        assert found.exceptAll(expected).isEmpty() and expected.exceptAll(found).isEmpty()


def test_few_keys_are_compared_one_by_one(spark, monkeypatch):
    plan, seen = manifests.sync_plan, []

    def counted(source, target, *rest):
        seen.append(source.count() + target.count())
        return plan(source, target, *rest)

    monkeypatch.setattr(manifests, "sync_plan", counted)
    source, target = _manifests(spark, 100_000, 0.01)
    assert manifests.sync_plan_by_ranges(source, target).count() == 100_100
    assert 0 < seen[0] < 0.08 * 200_000
    # a range in which a row comes twice on one side differs
    twice = source.limit(1)
    assert manifests.differing_ranges(source, source.unionByName(twice).unionByName(twice), "key", ["key", "length"], 10).count() == 1
