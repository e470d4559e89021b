import math
import random

import numpy as np
import pytest

from lakesteward.llm.whitening import orthogonal_columns, pivoted_cholesky, principal_components, whitened

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, x STRING, w INT, length STRING, component DOUBLE, n STRING"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "x", 1, "l", 0.5, "n") for i, v in rows], SCHEMA).repartition(parts)


def check(found, rows, most=8):
    """Rows of one vector length against numpy's eigenvectors and Python's integers."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(col) for col in zip(*x, strict=True)]
    centred = np.array([[a * n - s for a, s in zip(r, sums, strict=True)] for r in x], float) / n
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(most, d)
    own = sorted((r for r in found), key=lambda r: (r["vec_id"], r["component"]))
    assert len(own) == n * k and {r["n"] for r in own} == {n}
    order = sorted(range(n), key=lambda i: rows[i][0])
    got = np.array([math.nan if r["whitened"] is None else r["whitened"] for r in own]).reshape(n, k)
    for j in range(k):
        column = [r for r in own if r["component"] == j + 1]
        if values[j] > 1e-9 * max(values[0], 1e-300):
            wanted = (centred @ axes[:, j] / math.sqrt(values[j]))[order]
            # tied eigenvalues leave the component open
            if all(abs(values[j] - values[i]) > 1e-6 * values[0] for i in range(d) if i != j):
                assert np.allclose(got[:, j] * np.sign(got[:, j] @ wanted), wanted, atol=1e-9)
            assert all(abs(r["explained"] - values[j] / values.sum()) <= 1e-9 for r in column)
            assert all(r["identity_error"] <= 1e-9 for r in column)
        else:
            assert all(r["whitened"] is None and r["explained"] in (0.0, None) for r in column)
    for at, i in enumerate(order):
        deviation = sum((n * a - s) ** 2 for a, s in zip(x[i], sums, strict=True))
        assert {r["deviation"] for r in own[at * k : at * k + k]} == {deviation}


def test_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    check(whitened(table).collect(), rows)


def test_left_out_rows_lengths_and_clashing_names(spark):
    rng = random.Random(1)
    four = [(i, [rng.gauss(0, 1 + j) for j in range(4)]) for i in range(30)]
    ten = [(100 + i, [rng.gauss(0.5, 1 + j) for j in range(10)]) for i in range(40)]
    odd = [(200, None), (201, [1.0, None, 2.0, 3.0]), (202, [math.nan] * 4), (203, [math.inf] + [0.0] * 3), (204, [])]
    found = whitened(frame(spark, four + odd + ten)).collect()
    assert {r["vec_id"] for r in found} == set(range(30)) | set(range(100, 140))
    check([r for r in found if r["vec_id"] < 100], four)
    check([r for r in found if r["vec_id"] >= 100], ten)


def test_repeated_rows_and_null_ids_count(spark):
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [0.25, -1.0]), (2, [3.0, 0.0])]
    found = whitened(frame(spark, rows)).collect()
    assert len(found) == 8 and {r["n"] for r in found} == {4}
    assert sorted(str(r["vec_id"]) for r in found if r["component"] == 1) == ["1", "1", "2", "None"]


def test_without_variance(spark):
    columns = "vec_id, component, n, deviation, whitened, explained, identity_error".split(", ")
    assert whitened(frame(spark, [])).columns == columns and whitened(frame(spark, [])).collect() == []
    one = whitened(frame(spark, [(7, [0.5, 0.25])])).collect()
    assert sorted(map(tuple, one)) == [(7, 1, 1, 0, None, None, None), (7, 2, 1, 0, None, None, None)]
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(6)]
    check(whitened(frame(spark, line)).collect(), line)


def test_large_components(spark):
    far = [(i, [2.0**30 * i, -(2.0**29) * i, 1.0, 0.5 * (i % 2)]) for i in range(5)]
    found = whitened(frame(spark, far)).collect()
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in far]
    sums = [sum(c) for c in zip(*x, strict=True)]
    for r in found:
        exact = sum((5 * a - s) ** 2 for a, s in zip(x[r["vec_id"]], sums, strict=True))
        assert r["deviation"] == (exact if exact < 2**63 else None)
    with pytest.raises(Exception, match="component too large"):
        whitened(frame(spark, [(1, [1e30])])).collect()


@pytest.mark.parametrize("d, rank", [(1, 1), (2, 2), (7, 7), (40, 40), (12, 5)])
def test_factor_and_rotation(d, rank):
    rng = np.random.default_rng(d)
    half = rng.normal(size=(d, rank)) * np.logspace(0, -3, rank)
    scatter = half @ half.T
    factor, order = pivoted_cholesky(scatter)
    assert factor.shape == (d, rank) and np.allclose(factor @ factor.T, scatter[order][:, order], atol=1e-12)
    assert np.allclose(np.triu(factor, 1), 0)
    rotated = orthogonal_columns(factor)
    products = rotated.T @ rotated
    assert np.allclose(products, np.diag(products.diagonal()), atol=1e-13)
    values, axes = principal_components(scatter)
    assert np.allclose(values, np.linalg.eigvalsh(scatter)[::-1][:rank], rtol=1e-8)
    assert np.allclose(scatter @ axes, axes * values, atol=1e-12)


def test_sums_do_not_depend_on_the_order_of_tasks(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    key = lambda r: (r["vec_id"], r["component"])
    a, b = (sorted(whitened(t).collect(), key=key) for t in (table, table.repartition(7)))
    exact = ["vec_id", "component", "n", "deviation", "explained"]
    assert [[r[c] for c in exact] for r in a] == [[r[c] for c in exact] for r in b]
    # products of differently cut batches may differ in the last bit
    assert np.allclose([r["whitened"] for r in a], [r["whitened"] for r in b], rtol=0, atol=1e-13)
