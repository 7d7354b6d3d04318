"""Exact components against float eigenvectors, and the parts against plain arithmetic."""

import math
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest

from sievework.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(vectors)], SCHEMA)


def det(rows):
    a, sign, before = [list(r) for r in rows], 1, 1
    for k in range(len(a) - 1):
        i = next((r for r in range(k, len(a)) if a[r][k]), None)
        if i is None:
            return 0
        if i != k:
            a[i], a[k], sign = a[k], a[i], -sign
        for r in range(k + 1, len(a)):
            for c in range(k + 1, len(a)):
                a[r][c] = (a[r][c] * a[k][k] - a[r][k] * a[k][c]) // before
        before = a[k][k]
    return sign * a[-1][-1]


def test_polynomial_is_the_determinant(spark):
    rng = np.random.default_rng(3)
    b = rng.integers(-10**9, 10**9, (5, 9)).astype(object)
    m = [[int(x) for x in row] for row in b.T @ b]  # rank 5 of 9
    m[0][0] += 0
    poly = w.charpoly(spark, m)
    for t in (0, 1, -7, 10**12):
        assert sum(c * t**i for i, c in enumerate(poly)) == det([[(t if i == j else 0) - m[i][j] for j in range(9)] for i in range(9)])
    assert w.roots_above(poly, 0) == 5 and poly[:4] == [0] * 4


def test_roots_with_their_multiplicity():
    poly = [1]
    for root in (7, 7, 7, 100, 3, 0, 0):
        poly = [(poly[i - 1] if i else 0) - root * (poly[i] if i < len(poly) else 0) for i in range(len(poly) + 1)]
    assert [w.roots_above(poly, t) for t in (-1, 0, 2, 3, 6, 7, 99, 100)] == [7, 5, 5, 4, 4, 1, 1, 0]
    found, bits = w.largest_roots(poly, 124, 3)
    assert [(m, times) for m, times in found] == [(100 << bits, 1), (7 << bits, 3)]


def test_products_of_large_numbers_are_exact():
    y = np.array([[2**61 + 3, -5], [-(2**62), 2**40 + 1], [7, 2**20]] * 2000, np.int64)
    want = [[sum(int(r[i]) * int(r[j]) for r in y) for j in range(2)] for i in range(2)]
    assert w.products(y).tolist() == want


def test_eigenvectors_of_close_and_equal_roots():
    q = [[3, 4, 0], [-4, 3, 0], [0, 0, 5]]  # columns of length 5
    for values in ((10**12, 10**12 - 1, 5), (8, 8, 1)):
        m = [[sum(q[i][k] * values[k] * q[j][k] for k in range(3)) for j in range(3)] for i in range(3)]
        root = Decimal(25 * values[0])
        times = 2 if values[0] == values[1] else 1
        basis = w.null_space(m, root, times)
        for a in basis:
            assert all(abs(float(sum(m[i][j] * a[j] for j in range(3)) - root * a[i])) < 1e-20 for i in range(3))
        if times == 2:
            assert abs(float(sum(x * y for x, y in zip(*basis, strict=True)))) < 1e-40


def test_whitening_equals_float_algebra(spark):
    rng = np.random.default_rng(11)
    given = (rng.normal(size=(300, 20)) @ np.diag(np.linspace(0.9, 0.1, 20)) @ rng.normal(size=(20, 20)) / 5).astype(np.float32)
    rows = frame(spark, given).repartition(7)
    out = w.whitened_embeddings(rows).toPandas().sort_values(["component", "vec_id"])
    assert len(out) == 300 * 8 and set(out.n) == {300}
    x = np.floor(given.astype(np.float64) * 1024) + 100000
    value, vector = np.linalg.eigh(np.cov(x.T, bias=True))
    want = (x - x.mean(0)) @ vector[:, ::-1][:, :8] / np.sqrt(value[::-1][:8])
    got = out.whitened.to_numpy().reshape(8, 300).T
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-9
    assert np.abs(np.cov(got.T, bias=True) - np.eye(8)).max() < 1e-12 and out.identity_error.iloc[0] < 1e-12
    assert np.allclose(out.explained.to_numpy().reshape(8, 300)[:, 0], value[::-1][:8] / value.sum(), rtol=1e-12)
    s = [int(v) for v in x.sum(0)]
    exact = [sum((300 * int(a) - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    assert out.deviation[out.component == 1].tolist() == exact
    again = w.whitened_embeddings(rows.repartition(3)).toPandas().sort_values(["component", "vec_id"])
    assert (again.whitened.to_numpy() == out.whitened.to_numpy()).all()


def test_equal_variances_and_constant_columns(spark):
    axes = [[s if i == j else 0 for j in range(4)] + [0.5] for i in range(3) for s in (1, -1)]  # three equal, one without, one constant
    out = w.whitened_embeddings(frame(spark, axes)).toPandas()
    assert sorted(set(out.component)) == [1, 2, 3, 4, 5]
    none = out[out.component > 3]
    assert none.whitened.isna().all() and (none.explained == 0).all()
    some = out[out.component <= 3].pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(some.T @ some / 6 - np.eye(3)).max() < 1e-12
    assert np.allclose(out[out.component <= 3].explained, 1 / 3)


def test_edge_cases(spark):
    odd = [None, [], [1, None], [1, math.nan], [math.inf, 1], [1], [0.5, 0.25], [0.5, 0.25], [3e38, -3e38]]
    rows = frame(spark, odd).selectExpr("if(vec_id = 7, null, vec_id) as vec_id", "embedding", "1 as key", "2 as v", "3 as n", "4 as whitened", "5 as p")
    out = w.whitened_embeddings(rows).toPandas()
    assert len(out) == 6 and out.vec_id.isna().sum() == 2 and set(out.n) == {3}
    assert out[out.component == 2].whitened.isna().all() and out.deviation.isna().all()
    one = w.whitened_embeddings(frame(spark, [[1, 2]])).toPandas()
    assert len(one) == 2 and one.whitened.isna().all() and (one.deviation == 0).all() and one.identity_error.isna().all()
    empty = w.whitened_embeddings(rows.where("false"))
    assert empty.isEmpty() and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@pytest.mark.parametrize("n", [3, 10])
def test_deviation_is_exact_where_sums_leave_the_doubles(n):
    y = np.array([[2**28 + 1, -3], [5, 2**27]], np.int64)
    sums = [2**28 * n + 7, 11]
    assert w.deviations(y, n, sums) == [int(sum((Fraction(n * int(a)) - b) ** 2 for a, b in zip(r, sums, strict=True))) for r in y]
