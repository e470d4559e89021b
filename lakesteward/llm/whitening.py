"""Whitened vectors by a pivoted Cholesky factor and one-sided Jacobi rotations.

Tasks sum the vectors, then the products of the vectors centred at the rounded mean: both are sums
of whole numbers, so they are exact and do not depend on the order of the tasks. What the rounding
of the mean leaves out is taken off exactly. The scatter matrix, whose size depends on the
dimensions alone, is factored as P L L' P'; rotations from the right make the columns of L
orthogonal. Their squared norms are the eigenvalues, and the normalised columns the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesteward.llm.common import saved
from lakesteward.llm.integer_vectors import EXACT, exact_product, integer_vectors, largest, matrices

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8

TOTAL = pa.decimal128(38, 0)
LONG_MOST = 2**63 - 1


def pivoted_cholesky(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``factor`` and ``order`` with scatter[order][:, order] = factor @ factor.T, factor lower trapezoidal.

    The largest remaining diagonal entry is the next pivot; it ends when that is rounding noise.
    """
    left = scatter.astype(float).copy()
    d = len(left)
    order = np.arange(d)
    factor = np.zeros((d, d))
    noise = d * np.finfo(float).eps * max(float(left.diagonal().max(initial=0.0)), 0.0)
    for k in range(d):
        p = k + int(np.argmax(left.diagonal()[k:]))
        if left[p, p] <= noise:
            return factor[:, :k], order
        for a in (left, left.T, factor):
            a[[k, p]] = a[[p, k]]
        order[[k, p]] = order[[p, k]]
        factor[k, k] = np.sqrt(left[k, k])
        factor[k + 1 :, k] = left[k + 1 :, k] / factor[k, k]
        left[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def orthogonal_columns(factor: np.ndarray, most_sweeps: int = 60) -> np.ndarray:
    """``factor`` times a rotation, with columns orthogonal to rounding, by falling norm.

    A sweep takes every pair of columns once, in rounds of disjoint pairs that are rotated together.
    """
    a = factor.copy()
    r = a.shape[1]
    small = np.finfo(float).eps * np.sqrt(max(1, len(a)))
    seats = np.arange(r + r % 2)
    for _ in range(most_sweeps if r > 1 else 0):
        turned = False
        for _ in range(len(seats) - 1):
            p, q = np.sort(np.stack([seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]]), axis=0)
            real = q < r
            p, q = p[real], q[real]
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            far = np.abs(gamma) > small * np.sqrt(alpha * beta)
            if far.any():
                turned = True
                p, q, x, y = p[far], q[far], x[:, far], y[:, far]
                zeta = (beta[far] - alpha[far]) / (2 * gamma[far])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
            seats[1:] = np.roll(seats[1:], 1)
        if not turned:
            break
    norms = np.sqrt((a * a).sum(0))
    return a[:, np.argsort(-norms, kind="stable")]


def principal_components(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``scatter``, falling, and unit eigenvectors as columns; only those above rounding noise."""
    factor, order = pivoted_cholesky(scatter)
    rotated = orthogonal_columns(factor)
    norms = np.sqrt((rotated * rotated).sum(0))
    components = np.empty_like(rotated)
    components[order] = rotated / norms
    return norms * norms, components


def _sums(vectors: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Per length: number of vectors and sum per dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for length, rows, x in matrices(batch):
                counts[length] = counts.get(length, 0) + len(rows)
                # a batch of components below 2**53 could pass a long only beyond a thousand rows of the largest
                exact = x if largest(x) * len(x) <= LONG_MOST else x.astype(object)
                totals[length] = totals.get(length, 0) + exact.sum(0).astype(object)
        for length, total in totals.items():
            # dimension -1 carries the count, as an empty vector has no dimension
            values = [counts[length], *map(int, total)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([length] * len(values), pa.int32()), pa.array(range(-1, length), pa.int32()), pa.array(values, TOTAL)],
                ["length", "dim", "total"],
            )

    partial = vectors.select("x").mapInArrow(add, "length INT, dim INT, total DECIMAL(38,0)")
    found: dict[int, tuple[int, list[int]]] = {}
    for r in partial.groupBy("length", "dim").agg(F.sum("total").alias("total")).orderBy("length", "dim").collect():
        if r["dim"] < 0:
            found[r["length"]] = (int(r["total"]), [])
        else:
            found[r["length"]][1].append(int(r["total"]))
    return found


def _scatters(vectors: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Per length: n times the sum of the products of the centred vectors, divided by n * n, so the covariance."""
    centres = {length: np.array([round(s / n) for s in total], np.int64) for length, (n, total) in sums.items()}

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for length, _, x in matrices(batch):
                z = x - centres[length]
                rows = max(1, min(len(z), EXACT // max(1, largest(z) ** 2)))
                for low in range(0, len(z), rows):
                    part = z[low : low + rows]
                    totals[length] = totals.get(length, 0) + exact_product(part.T, part).astype(object)
        for length, total in totals.items():
            i, j = np.triu_indices(length)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), length, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(list(map(int, total[i, j])), TOTAL)],
                ["length", "i", "j", "total"],
            )

    partial = vectors.select("x").mapInArrow(multiply, "length INT, i INT, j INT, total DECIMAL(38,0)")
    found = {length: np.zeros((length, length)) for length in sums}
    for r in partial.groupBy("length", "i", "j").agg(F.sum("total").alias("total")).collect():
        length, i, j = r["length"], r["i"], r["j"]
        n, total = sums[length]
        rest_i, rest_j = (total[k] - n * int(centres[length][k]) for k in (i, j))
        # whole numbers up to the one division
        found[length][i, j] = found[length][j, i] = (n * int(r["total"]) - rest_i * rest_j) / (n * n)
    return found


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each vector and component.

    Components are numbered from 1 by falling eigenvalue, up to ``components`` and the number of
    dimensions. ``identity_error`` is measured on the whitened values themselves. Vectors of
    different lengths have no common covariance: each length is fitted and whitened on its own, and
    ``n`` counts its vectors. Rows that repeat an id or a vector count as often as they occur. A
    component without variance (one vector, equal vectors, fewer independent dimensions) has null
    ``whitened``; ``explained`` is 0, or null where no dimension varies; ``identity_error`` is over
    the components with variance, null without any. A vector without dimensions gives no row, as it
    has no component. ``deviation`` is null where it exceeds a long. See ``integer_vectors`` for
    what is left out; an empty table gives no rows.
    """
    stored = saved(integer_vectors(vectors, SCALE, OFFSET), "whitening-input")
    sums = _sums(stored)
    fitted = {}
    for length, covariance in _scatters(stored, sums).items():
        values, axes = principal_components(covariance)
        k, trace = min(components, length), float(np.trace(covariance))
        fitted[length] = (values[:k], axes[:, :k], k, trace)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id")
            for length, rows, x in matrices(batch):
                n, total = sums[length]
                values, axes, k, trace = fitted[length]
                if not k:
                    continue
                safe = n * largest(x) + max(map(abs, total)) < 2**62
                y = n * x - np.array(total) if safe else n * x.astype(object) - np.array(total, object)
                exact = y if length * largest(y) ** 2 <= LONG_MOST else y.astype(object)
                deviation = [v if v <= LONG_MOST else None for v in map(int, (exact * exact).sum(1))]
                scores = np.zeros((len(x), k))
                scores[:, : len(values)] = (y.astype(float) / n) @ axes / np.sqrt(values)
                missing = np.broadcast_to(np.arange(k) >= len(values), scores.shape)
                flat = pa.array(scores.ravel(), pa.float64(), mask=missing.ravel())
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
                share = [float(v) / trace if trace else None for v in values] + [0.0 if trace else None] * (k - len(values))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(rows)), pa.array(np.full(len(x), length, np.int32)), pa.array([n] * len(x), pa.int64()),
                        pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(offsets, flat),
                        pa.array([share] * len(x), pa.list_(pa.float64())),
                    ],
                    ["vec_id", "length", "n", "deviation", "w", "shares"],
                )

    schema = "vec_id BIGINT, length INT, n BIGINT, deviation BIGINT, w ARRAY<DOUBLE>, shares ARRAY<DOUBLE>"
    rows = saved(stored.mapInArrow(project, schema), "whitened")
    errors = _identity_errors(rows, {length: len(f[0]) for length, f in fitted.items()})
    error = F.lit(None).cast("double")
    for length, value in errors.items():
        error = F.when(F.col("length") == length, F.lit(value)).otherwise(error)
    each = rows.select("vec_id", "n", "deviation", "length", "shares", F.posexplode("w").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
        F.get("shares", F.col("at")).alias("explained"), error.alias("identity_error"),
    )


def _identity_errors(rows: DataFrame, used: dict[int, int]) -> dict[int, float]:
    """Per length: largest absolute entry of the covariance of the whitened values minus the identity."""
    found = {}
    for length, k in used.items():
        if not k:
            continue
        own = rows.filter(F.col("length") == length)
        mean = own.agg(*(F.avg(F.col("w")[i]) for i in range(k))).first()
        centred = [F.col("w")[i] - F.lit(mean[i]) for i in range(k)]
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        products = own.agg(*(F.avg(centred[i] * centred[j]) for i, j in pairs)).first()
        found[length] = max(abs(v - (i == j)) for v, (i, j) in zip(products, pairs, strict=True))
    return found
