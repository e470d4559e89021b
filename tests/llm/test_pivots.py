import math
import random

import numpy as np
import pytest

from lakesteward.llm.pivots import nearest_vectors

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, row STRING, v INT"


def brute_force(rows, every, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    out = {}
    for a, (i, x) in enumerate(good):
        if i % every == 0:
            scores = [(-float(x @ y) / math.sqrt(x @ x) / math.sqrt(y @ y), j) for b, (j, y) in enumerate(good) if a != b and len(x) == len(y)]
            out.setdefault(i, []).append([(j, -s) for s, j in sorted((round(s, 12), j) for s, j in scores)[:k]])
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "r", 2) for i, v in rows], SCHEMA).repartition(3)


def test_recall_on_the_test_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    expected = brute_force(rows, 5, 5)
    found = nearest_vectors(table, every=5).collect()
    hits = sum(r["vec_id"] in {j for j, _ in expected[r["query_id"]][0]} for r in found)
    assert len(found) == 5 * len(expected) and hits >= 0.9 * len(found)
    exact = {(q, j): s for q, lists in expected.items() for j, s in lists[0]}
    assert all(abs(exact[r["query_id"], r["vec_id"]] - r["score"]) < 1e-9 for r in found if (r["query_id"], r["vec_id"]) in exact)


@pytest.mark.parametrize("options", [{}, {"pivots": 4, "nearest": 3, "chunk": 2, "share": 1.0, "least": 1000}])
def test_odd_vectors_ties_and_few_candidates(spark, options):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(1, 30)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(9)]
    rows += [(50, [1e-30] * 6), (200, None), (201, [0.0] * 6), (202, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (203, [math.nan] * 6), (204, [math.inf] * 6), (None, [1.0] * 6), (205, [1.0, 2.0]), (206, [])]
    rows += [(300 + i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(14)]
    rows += [(10, rows[9][1])]
    found = nearest_vectors(vectors(spark, rows), every=10, k=5, **options).collect()
    expected = brute_force(rows, 10, 5)
    assert len(found) == 5 * sum(map(len, expected.values()))
    for q, lists in expected.items():
        own = sorted((r["rank"], r["vec_id"]) for r in found if r["query_id"] == q)
        assert own == sorted((n, j) for best in lists for n, (j, _) in enumerate(best, 1))


def test_too_few_vectors(spark):
    assert nearest_vectors(vectors(spark, [])).collect() == []
    assert nearest_vectors(vectors(spark, [(50, [1.0, 0.0])])).collect() == []
    found = nearest_vectors(vectors(spark, [(50, [1.0, 0.0]), (7, [0.0, 2.0]), (8, [3.0, 0.0])])).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found] == [(50, 1, 8, 1.0), (50, 2, 7, 0.0)]
