import pytest
from pyspark.sql import functions as F

from lakesteward.operators import ordering
from lakesteward.operators.quality import HasCount, Holds, NonEmpty, Unique, batch_failures, batch_outcome, expectations, row_count


def test_expectations(spark):
    frame = spark.createDataFrame([(1, 1.0), (2, None), (2, -1.0)], "k INT, v DOUBLE")
    rules = [HasCount(3), HasCount(4, "four"), NonEmpty(), Holds("v_known", F.col("v").isNotNull()), Holds("v_positive", F.col("v") > 0), Unique(("k",)), Unique(("k", "v"), "pair")]
    got = {r["rule"]: (r["ok"], r["message"]) for r in expectations(frame, rules).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        "row_count": True, "four": False, "non_empty": True, "v_known": False, "v_positive": False, "key_unique": False, "pair": True,
    }
    assert got["four"][1] == "expected 4, got 3" and got["v_positive"][1] == "2 rows violate it"
    assert row_count(frame).first()["n"] == 3


def test_strict_expectations_fail_the_job(spark):
    assert expectations(spark.range(5), [HasCount(5), NonEmpty()], strict=True).count() == 2
    with pytest.raises(Exception, match="non_empty: 0 rows"):
        expectations(spark.range(0), [NonEmpty()], strict=True).collect()


def test_batch_outcome(spark):
    def outcome(rows, group=None):
        frame = spark.createDataFrame(rows, "g STRING, path STRING, error STRING")
        return sorted(map(tuple, batch_outcome(frame, group).collect()))

    assert outcome([("a", "p", None)]) == [(1, 0, 0)]
    assert outcome([("a", "p", "x"), ("a", "q", "y")]) == [(2, 2, 1)]
    assert outcome([]) == [(0, 0, 0)]
    assert outcome([("a", "p", None), ("b", "q", "")], ["g"]) == [("a", 1, 0, 0), ("b", 1, 1, 1)]
    frame = spark.createDataFrame([("a", "p", None), ("b", "q", "boom")], "g STRING, path STRING, error STRING")
    assert [tuple(r) for r in batch_failures(frame, ["g"]).collect()] == [("b", "q", "boom")]


def test_priority_order(spark):
    frame = spark.createDataFrame([("common",), ("zzz",), ("gold",), (None,), ("silver",), ("bronze",)], "layer STRING")
    got = [r[0] for r in ordering.priority_order(frame, "layer", ["gold", "silver", "bronze", "common"], ["layer"]).collect()]
    assert got == ["gold", "silver", "bronze", "common", None, "zzz"]


def test_first_n(spark):
    frame = spark.range(1000).repartition(7)
    top = ordering.first_n(frame, [F.desc("id")], 3)
    assert [r[0] for r in top.collect()] == [999, 998, 997]
    assert "TakeOrdered" in top._jdf.queryExecution().executedPlan().toString()


def test_ordinal_numbers_a_hot_value_across_partitions(spark):
    # a third of the rows are identical copies
    frame = spark.range(9000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("v")).repartition(5)
    numbered = ordering.ordinal_of_total(frame, ["v"])
    rows = sorted(numbered.collect(), key=lambda r: r["idx"])
    assert [r["idx"] for r in rows] == list(range(1, 9001)) and {r["total"] for r in rows} == {9000}
    assert [r["v"] for r in rows] == sorted(r["v"] for r in rows)
    assert ordering.ordinal_of_total(frame.limit(0), ["v"]).isEmpty()


def test_ordinal_spreads_the_hot_value(spark):
    frame = spark.range(60000).select(F.lit("hot").alias("v")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = ordering.ordinal_of_total(frame, ["v"])
        assert len(numbered.inputFiles()) > 1
        assert numbered.agg(F.count_distinct("idx")).first()[0] == 60000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_inputs_with_helper_names_keep_their_columns(spark):
    from lakesteward.operators.maintenance import compact

    rows = spark.createDataFrame([(i % 3, i, i, i, i, i) for i in range(20)], "k INT, _hash INT, _place INT, _row INT, _part INT, _offset INT")
    expected = sorted(map(tuple, rows.collect()))
    assert sorted(map(tuple, compact(rows, 3, ["k"]).collect())) == expected
    assert sorted(map(tuple, ordering.priority_order(rows, "k", [2, 0]).collect())) == expected
    numbered = ordering.ordinal_of_total(rows, ["k", "_hash"])
    assert numbered.columns == [*rows.columns, "idx", "total"]
    assert sorted(tuple(r)[:-2] for r in numbered.collect()) == expected
    with pytest.raises(ValueError):
        ordering.ordinal_of_total(rows.withColumn("idx", F.lit(1)), ["k"])
