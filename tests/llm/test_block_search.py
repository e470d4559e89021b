import math
import random

import numpy as np
import pytest

from lakesteward.llm.block_search import Blocks, search_group, top_products

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, row STRING, x INT, place STRING, length STRING, round DOUBLE"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "r", 1, "p", "l", 0.5) for i, v in rows], SCHEMA).repartition(parts)


def brute_force(rows, every, k):
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and None not in v and all(map(math.isfinite, v))]
    out = []
    for a, (i, x) in enumerate(good):
        if i is not None and i % every == 0:
            scores = [(-sum(p * q for p, q in zip(x, y, strict=True)), j is None, j or 0, j) for b, (j, y) in enumerate(good) if a != b and len(x) == len(y)]
            out += [(i, n, j, -s) for n, (s, _, _, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(str, out))


def found(frame, **options):
    return sorted(str(tuple(r)) for r in top_products(frame, **options).select("query_id", "rank", "vec_id", "score").collect())


SMALL = {"centres": 3, "block_rows": 2, "group_rows": 7, "round_bytes": 200}


@pytest.mark.parametrize("options", [{}, SMALL])
def test_odd_vectors_ties_and_lengths(spark, options):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(1, 40)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(12)]
    rows += [(10, rows[9][1]), (None, [1.0] * 6), (None, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])]
    rows += [(50, [0.0] * 6), (200, None), (210, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (220, [math.nan] * 6), (230, [math.inf] * 6)]
    rows += [(240, [0.5, -0.5]), (241, [0.25, 0.75]), (250, []), (251, []), (260, [7.0])]
    assert found(frame(spark, rows), every=10, **options) == brute_force(rows, 10, 5)


def test_large_components_are_exact(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-(2**22), 2**22)) for _ in range(3)]) for i in range(60)]
    assert found(frame(spark, rows), every=7, **SMALL) == brute_force(rows, 7, 5)


def test_too_few_vectors(spark):
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(50, [1.0])])) == []
    assert found(frame(spark, [(50, [1.0]), (1, [-1.0])])) == ["(50, 1, 1, -65536)"]


def test_one_vector_repeated(spark):
    rows = [(i, [0.5, -0.25, 1.0]) for i in range(300)]
    assert found(frame(spark, rows), every=50, **SMALL) == brute_force(rows, 50, 5)


def group(matrix):
    n = len(matrix)
    return {"length": matrix.shape[1], "vec_ids": np.arange(n).tobytes(), "id_nulls": bytes(n), "rows": np.arange(n).tobytes(), "vectors": matrix.astype(np.int64).tobytes()}


@pytest.mark.parametrize("k", [1, 5])
def test_blocks_below_the_threshold_are_skipped(k):
    rng = np.random.default_rng(3)
    centres = rng.integers(-200, 200, (64, 32))
    matrix = np.repeat(centres, 32, axis=0) + rng.integers(-5, 6, (64 * 32, 32))
    queries = centres + rng.integers(-5, 6, centres.shape)
    blocks = Blocks(group(matrix), 32)
    best, scored = search_group(blocks, queries, np.full(len(queries), -1), k, None, False)
    assert scored < 0.1 * len(queries) * len(blocks.starts)
    scores = queries @ matrix.T
    for q in range(len(queries)):
        order = np.lexsort((np.arange(len(matrix)), -scores[q]))[:k]
        assert best.ids[q].tolist() == order.tolist() and best.scores[q].tolist() == scores[q][order].tolist()
    # a threshold from elsewhere rules out all but what reaches it
    floor = scores.max(1)
    some, fewer = search_group(blocks, queries, np.full(len(queries), -1), k, floor, False)
    assert fewer <= scored and (some.scores[:, 0] == floor).all()
