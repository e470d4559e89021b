import zlib

import pytest
from pyspark.sql import functions as F

from lakesteward.llm.compression import accepted, fit, held_out, quality_scores


@pytest.fixture
def labelled(spark, documents, words):
    docs, labels = [], []
    for i in range(120):
        text = " ".join(words(80, i))
        good = i % 3 != 0
        docs.append((i, text + "." if good else text.upper().replace(" ", "!! ")))
        labels.append((i, int(good), 0))
    return documents(docs), spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT")


def test_tells_held_out_texts_apart(labelled):
    docs, labels = labelled
    found = {r["doc_id"]: r for r in quality_scores(docs, labels).collect()}
    assert len(found) == 120
    held = [i for i in found if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(found[i]["held_out"] for i in held) and sum(r["held_out"] for r in found.values()) == len(held)
    assert sum(found[i]["predicted"] == (i % 3 != 0) for i in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found.values())


def test_learns_nothing_from_held_out_rows(labelled):
    docs, labels = labelled
    wrong = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert fit(docs, labels) == fit(docs, wrong)


def test_accuracy_on_the_test_tables(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_scores(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.85 * len(rows)


def test_odd_rows(spark, documents, labelled):
    docs, labels = labelled
    odd = documents([(None, "a b"), (1000, None), (1000, ""), (1001, "x " * 200_000)])
    found = quality_scores(docs.unionByName(odd), labels.unionByName(spark.createDataFrame([(None, 1, 0), (5, None, 0), (1, 0, 0), (2, 7, 0)], labels.schema)))
    assert found.count() == 124
    assert found.filter("score IS NULL").count() == 0
    empty = spark.createDataFrame([], labels.schema)
    assert {r["score"] for r in quality_scores(odd, empty).collect()} == {0.5}
    assert quality_scores(docs.limit(0), labels).collect() == []


def test_accepted_keeps_columns(labelled):
    docs, labels = labelled
    kept = accepted(docs, labels)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sum(i % 3 != 0 for i in ids) == 80 and len(ids) <= 84


def test_accepted_takes_columns_named_like_its_own(spark, sf_dir):
    from lakesteward.llm.compression import accepted

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    plain = {r["doc_id"] for r in accepted(docs, labels).collect()}
    clashing = docs.withColumn("score", docs["doc_id"] * 2).withColumn("predicted", docs["lang"])
    found = accepted(clashing, labels)
    assert found.columns == clashing.columns
    assert {r["doc_id"] for r in found.collect()} == plain and all(r["score"] == 2 * r["doc_id"] for r in found.collect())
