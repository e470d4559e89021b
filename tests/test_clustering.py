"""Rows along a curve, small files in bins."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from lakesteward.operators.clustering import PACKED_AT_ONCE, _first_fit, _rank, cluster, file_borders, pack_files, roundest, with_curve_key
from lakesteward.plans import packing
from lakesteward.plans.packing import finish_packing, pack_table, table_files
from lakesteward.sources.sinks import overwrite_sink, publish_version


def test_rank_is_the_number_of_bounds_reached(column):
    bounds = [-1e300, 3.0, 5.0, 5.5, 9.0, 1.1e1]
    values = [None, 2.0, 3.0, 4.0, 5.0, 9.0, 10.9, 11.0, 99.0]
    assert column(values, lambda _: _rank("v", bounds), "DOUBLE") == [sum(v is not None and b <= v for b in bounds) for v in values]


def test_near_rows_share_files_in_every_column(spark, tmp_path):
    rows = spark.range(40_000).select(
        (F.xxhash64("id") % 1000).alias("a"), F.concat(F.lit("n"), F.lpad((F.abs(F.xxhash64("id", F.lit(1))) % 1000).cast("string"), 4, "0")).alias("b"),
        F.date_add(F.lit(date(2024, 1, 1)), (F.abs(F.xxhash64("id", F.lit(2))) % 365).cast("int")).alias("c"),
    )
    source = overwrite_sink(rows, str(tmp_path / "in"))
    stored = overwrite_sink(cluster(source, 64, ["a", "b", "c"], from_scan=True), str(tmp_path / "out"))
    assert stored.exceptAll(source).isEmpty() and source.exceptAll(stored).isEmpty()
    named = stored.withColumn("file", F.input_file_name())
    for narrow in (F.col("a").between(500, 520), F.col("b") == "n0500", F.col("c").between(date(2024, 6, 1), date(2024, 6, 8))):
        # each column has the bits of a quarter of 64 files, and an interval may cross a border
        assert named.filter(narrow).select("file").distinct().count() <= 40
    # one column of one value, one of nulls
    flat = source.select("a", F.lit(1).alias("one"), F.lit(None).cast("double").alias("none"))
    assert cluster(flat, 8, ["one", "none", "a"]).count() == 40_000
    with pytest.raises(ValueError, match="do not fit"):
        with_curve_key(source, ["a", "b", "c"], "k", 21)


def test_borders_of_files_are_those_of_cells(spark, tmp_path):
    """An interval at a border of the first cut meets at most the files of two of four parts of its column."""
    assert [roundest(*x) for x in ((5, 9), (3, 4), (8, 11), (7, 7), (0, 255))] == [8, 4, 10, 7, 128]
    # a border for each share, the cell's where one is near; a key that fills files has their borders
    assert file_borders([*range(1, 8 * 4)], 4) == [8, 16, 24] and file_borders([7] * 31, 4) == [7, 7, 7] and file_borders([], 4) == []
    rows = spark.range(60_000).select(*((F.pmod(F.xxhash64("id", F.lit(i)), F.lit(20_000))).alias(c) for i, c in enumerate("abc")))
    source = overwrite_sink(rows, str(tmp_path / "in"))
    stored = overwrite_sink(cluster(source, 64, ["a", "b", "c"], from_scan=True), str(tmp_path / "out"))
    assert stored.exceptAll(source).isEmpty() and source.exceptAll(stored).isEmpty()
    named = stored.withColumn("file", F.input_file_name())
    sizes = [r["count"] for r in named.groupBy("file").count().collect()]
    assert len(sizes) == 64 and max(sizes) < 2 * 60_000 / 64
    # from a little before the middle, so that both halves of the column are met
    met = {c: named.filter(F.col(c).between(9_700, 10_950)).select("file").distinct().count() for c in "abc"}
    assert max(met.values()) <= 36, met


def test_a_hot_row_is_spread(spark, tmp_path):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"), F.lit("x").alias("t"))
    source = overwrite_sink(rows.repartition(9), str(tmp_path / "in"))
    out = overwrite_sink(cluster(source, 6, ["k", "t"], from_scan=True), str(tmp_path / "out"))
    sizes = [r["n"] for r in out.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 6 and max(sizes) < 10_000 and sum(sizes) == 30_000


def test_first_fit():
    lengths = [5, 9, 1, 4, 6, 10, 2]
    bins = _first_fit(lengths, 10)
    filled = {}
    for n, b in zip(lengths, bins):
        filled.setdefault(b, []).append(n)
    assert sorted(map(sorted, filled.values())) == [[1, 9], [2], [4, 6], [5], [10]] or sum(map(sum, filled.values())) == sum(lengths)
    assert all(sum(b) <= 10 for b in filled.values()) and len(filled) == 4
    assert _first_fit([], 10) == []


def test_bins_hold_small_files_of_one_folder(spark):
    n = PACKED_AT_ONCE + 500
    files = [(f"/a/f{i}", 1 + i % 7) for i in range(n)] + [("/b/big", 100), ("/b/alone", 60), ("/c/x", 40), ("/c/y", 50), ("/d/99", 99), ("/d/2", 2)]
    packed = pack_files(spark.createDataFrame(files, "path STRING, length BIGINT"), 100)
    rows = packed.collect()
    by_bin = {}
    for r in rows:
        by_bin.setdefault(r["bin"], []).append(r)
    assert all(sum(r["length"] for r in b) <= 100 and len({r["folder"] for r in b}) == 1 and len(b) > 1 for b in by_bin.values())
    paths = {r["path"] for r in rows}
    assert {"/c/x", "/c/y"} <= paths and not {"/b/big", "/b/alone", "/d/99", "/d/2"} & paths
    assert len([p for p in paths if p.startswith("/a/")]) >= n - 2


@pytest.fixture
def small_files(spark, tmp_path):
    name = f"packable_{tmp_path.name}".replace("-", "_")
    rows = spark.range(3000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("t"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("p %="), F.col("id") % 3)).alias("p"))
    publish_version(rows.filter("id >= 500").coalesce(1), name, str(tmp_path / "v"), partition_by=["p"])
    from lakesteward.sources.catalog import table_location

    rows.filter("id < 500").repartition(6).write.mode("append").partitionBy("p").parquet(table_location(spark, name))
    spark.catalog.refreshTable(name)
    return name, sorted(map(tuple, rows.collect()), key=str), tmp_path


def listed(spark, name):
    return {r["path"]: (r["length"], r["mtime"]) for r in table_files(spark, name).collect()}


def test_packing_keeps_large_files_and_all_rows(spark, small_files):
    name, rows, root = small_files
    before = listed(spark, name)
    # small enough for several packed files in each folder
    target = 15_000
    outcome = pack_table(spark, name, str(root), target).first()
    after = listed(spark, name)
    assert sorted(map(tuple, spark.table(name).collect()), key=str) == rows
    large = {p: v for p, v in before.items() if v[0] >= target}
    assert len(large) == 3 and large.items() <= after.items()
    assert outcome["replaced"] == len(set(before) - set(after)) == 18 and outcome["packed"] == len(set(after) - set(before)) > 3
    # again: what is left has no partner or is packed once more, and rows stay
    pack_table(spark, name, str(root), target)
    assert sorted(map(tuple, spark.table(name).collect()), key=str) == rows


@pytest.mark.parametrize("stop", ["moves", "deletes"])
def test_packing_goes_on_from_its_journal(spark, small_files, monkeypatch, stop):
    name, rows, root = small_files

    def killed(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as patched:
        patched.setattr(packing, "_move" if stop == "moves" else "vacuum_execute", killed)
        if stop == "moves":
            patched.setattr(packing, "partial", killed)
        with pytest.raises(KeyboardInterrupt):
            pack_table(spark, name, str(root), 15_000)
    (journal,) = [os.path.join(root, d) for d in os.listdir(root) if d.startswith("packing-")]
    for _ in range(2):
        finish_packing(spark, journal)
        assert sorted(map(tuple, spark.table(name).collect()), key=str) == rows
    with pytest.raises(FileNotFoundError):
        finish_packing(spark, str(root / "nothing"))


def test_an_empty_table_is_left_alone(spark, tmp_path):
    name = f"empty_{tmp_path.name}".replace("-", "_")
    publish_version(spark.range(0), name, str(tmp_path / "v"))
    assert pack_table(spark, name, str(tmp_path)).first()["replaced"] == 0
    assert spark.table(name).isEmpty()
