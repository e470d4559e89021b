"""One key with a third of the rows: the joins on it must be split, and results stay whole."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from lakesteward.operators import matching, runs
from lakesteward.operators.tenants import Mark
from lakesteward.session import saved

ROWS = 300_000
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "24",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
}


@contextmanager
def settings(spark, values):
    old = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.fixture(scope="module")
def skewed(spark):
    hot = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))
    lines = spark.range(0, ROWS, 1, 6).select(hot.alias("k"), F.col("id"), F.sha1(F.col("id").cast("string")).alias("t"))
    keys = spark.range(ROWS).filter("id % 2 = 1").select(F.col("id").alias("k"))
    return saved(lines, "skew-lines"), saved(keys, "skew-keys")


def run(spark, df):
    out = df.agg(F.count("*").alias("n"), F.max("t"))
    with settings(spark, SETTINGS):
        n = out.collect()[0]["n"]
        return n, out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_anti_join(spark, skewed):
    lines, keys = skewed
    n, plan = run(spark, Mark("k", keys).others(lines))
    assert n == sum(1 for i in range(ROWS) if i % 3 and i % 2 == 0)
    assert "skew=true" in plan


def test_upsert(spark, skewed):
    lines, keys = skewed
    n, plan = run(spark, matching.upsert(lines.select("k", "t"), keys.select("k", F.lit("new").alias("t")), "k"))
    created = sum(1 for i in range(1, ROWS, 2) if i % 3 == 0 and i != 7)
    assert n == ROWS + created
    assert "skew=true" in plan


def test_runs_with_cluster(spark, skewed):
    lines, keys = skewed
    clusters = keys.select(F.col("k").alias("id"), F.lit("n").alias("name"), F.lit("s").alias("state"))
    n, plan = run(spark, matching.runs_with_cluster(lines.withColumnRenamed("k", "virtualClusterId"), clusters))
    assert n == ROWS
    assert "skew=true" in plan


def test_first_of_token(spark, skewed):
    lines, _ = skewed
    records = lines.select(
        F.lit("vc").alias("virtualClusterId"), F.col("k").cast("string").alias("clientToken"), "id", F.col("id").alias("createdAt"), "t"
    )
    n, plan = run(spark, runs.first_of_token(records))
    assert n == sum(1 for i in range(ROWS) if i % 3)
    # the first run itself is part of the join key, so that one token's runs do not meet in one task
    assert "hashpartitioning(struct(createdAt" in plan
    # no run has a token: none is joined
    n, _ = run(spark, runs.first_of_token(records.withColumn("clientToken", F.lit(""))))
    assert n == ROWS
