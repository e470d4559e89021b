"""Expectations measured in parts and merged."""

import pytest
from pyspark.sql import functions as F

from lakesteward.operators.measures import KEY_ERROR, drift, measured, measured_report, merged_measures
from lakesteward.operators.quality import HasCount, Holds, NonEmpty, Unique, expectations


def rules(n):
    return [HasCount(n), NonEmpty(), Holds("small", F.col("v") < 900), Unique(("id",), "id_unique"), Unique(("v", "w"), "pair_unique")]


@pytest.fixture
def rows(spark):
    return spark.range(40_000).select("id", (F.col("id") % 1000).alias("v"), F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("w"))


def test_merged_parts_report_as_the_whole(spark, rows):
    own = rules(40_000)
    parts = None
    for i in range(5):
        part = measured(rows.filter(F.pmod("id", F.lit(5)) == i), own, ["v", "w"])
        parts = part if parts is None else parts.unionByName(part)
    # first some, then the rest
    stored = spark.createDataFrame(parts.collect(), parts.schema)
    merged = merged_measures(stored)
    exact = {r["rule"]: (r["ok"], r["message"]) for r in expectations(rows, own).collect()}
    found = {r["rule"]: (r["ok"], r["message"]) for r in measured_report(merged, own).collect()}
    assert {k: found[k] for k in ("row_count", "non_empty", "small")} == {k: exact[k] for k in ("row_count", "non_empty", "small")}
    assert {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in exact.items()} and not found["pair_unique"][0]
    keys = merged.filter("kind = 'keys'").select("measure", F.hll_sketch_estimate("keys").alias("e")).collect()
    counts = {"id_unique": 40_000, "pair_unique": rows.select("v", "w").distinct().count()}
    assert all(abs(r["e"] - counts[r["measure"]]) <= KEY_ERROR * counts[r["measure"]] for r in keys) and len(keys) == 2
    again = merged_measures(merged_measures(stored.limit(12)).unionByName(merged_measures(stored.exceptAll(stored.limit(12)))))
    assert sorted((r["rule"], r["ok"]) for r in measured_report(again, own).collect()) == sorted((k, v[0]) for k, v in found.items())


def test_drift_between_versions(spark, rows):
    def spread(df):
        return measured(df, [], ["v", "w"])

    same = {r["column"]: r for r in drift(spread(rows), spread(rows.filter("id % 2 = 0"))).collect()}
    assert not any(r["drifted"] for r in same.values()) and all(r["distance"] < 0.03 for r in same.values())
    moved = rows.withColumn("v", F.col("v") + 300).withColumn("w", F.when(F.col("id") % 3 > 1, F.col("w")))
    found = {r["column"]: r for r in drift(spread(rows), spread(moved)).collect()}
    assert abs(found["v"]["distance"] - 0.3) < 0.03 and abs(found["w"]["distance"] - 1 / 3) < 0.03
    assert all(r["drifted"] for r in found.values())
    empty = drift(spread(rows), spread(rows.limit(0))).collect()
    assert [(r["distance"], r["drifted"]) for r in empty] == [(None, None)] * 2


def test_no_rows(spark, rows):
    found = {r["rule"]: r["ok"] for r in measured_report(merged_measures(measured(rows.limit(0), rules(0), ["v"])), rules(0)).collect()}
    assert found == {"row_count": True, "non_empty": False, "small": True, "id_unique": True, "pair_unique": True}
