"""Whitening against eigenvectors of the exact covariance."""

import math
from fractions import Fraction

import numpy as np
import pytest

from chronopanel.llm import whitening

FIELDS = "vec_id long, embedding array<double>, label int, n int, d string"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in zip(ids, vectors)], FIELDS).repartition(3)


def exact(vectors):
    """Integer rows, n, sums, eigenvalues and eigenvectors; the covariance is summed in fractions."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    away = [[n * r[j] - sums[j] for j in range(d)] for r in x]
    cov = np.array([[float(Fraction(sum(a[i] * a[j] for a in away), n**3)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    return np.array(away, float) / n, [sum(v * v for v in a) for a in away], values[::-1], vectors[:, ::-1]


@pytest.mark.parametrize("n,d,stretch", [(300, 12, 1.0), (200, 5, 30.0), (50, 8, 1.0), (400, 10, 5.0)])
def test_components(spark, n, d, stretch):
    r = np.random.default_rng(d)
    base = r.normal(size=(n, d)) * np.geomspace(40, 40 / stretch**2, d) + r.normal(size=d) * 50
    vectors = (base @ np.linalg.qr(r.normal(size=(d, d)))[0]).tolist()
    centred, deviation, values, components = exact(vectors)
    out = sorted(whitening.whitened(frame(spark, vectors)).collect(), key=lambda x: (x.vec_id, x.component))
    k = min(d, 8)
    got = np.array([x.whitened for x in out]).reshape(n, k)
    want = centred @ components[:, :k] / np.sqrt(values[:k])
    sign = np.sign((got * want).sum(0))
    assert np.abs(got - want * sign).max() < 1e-8
    assert [x.component for x in out] == list(range(1, k + 1)) * n and {x.n for x in out} == {n}
    assert [x.deviation for x in out[::k]] == deviation
    assert np.allclose([x.explained for x in out[:k]], values[:k] / values.sum(), rtol=1e-9)
    error = {x.identity_error for x in out}
    assert len(error) == 1 and error.pop() < 1e-9


def test_badly_conditioned_rows(spark):
    """Columns that nearly depend on each other: one plain Gram factor would lose them."""
    r = np.random.default_rng(4)
    base = r.normal(size=(500, 4)) * 1e6
    vectors = np.hstack([base, base[:, :2] + r.normal(size=(500, 2)) * 0.01]).tolist()
    centred, _, values, components = exact(vectors)
    out = sorted(whitening.whitened(frame(spark, vectors)).collect(), key=lambda x: (x.vec_id, x.component))
    got = np.array([x.whitened for x in out]).reshape(500, 6)
    assert np.abs(got.T @ got / 500 - np.eye(6)).max() < 1e-6
    assert values[0] / abs(values[-1]) > 1e12
    want = centred @ components[:, :4] / np.sqrt(values[:4])
    assert np.abs(np.abs(got[:, :4]) - np.abs(want)).max() < 1e-6


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0], [2.0, 2.0], [3.0, 2.0], None, [nan, 1.0], [inf, 0.0], [], [1.0], [1.0], [None, 1.0], [1e300, 1.0], [1e14, 1.0, 2.0], [1e14, 5.0, 2.0]]
    out = whitening.whitened(frame(spark, vectors, [1, 2, None, 4, 5, 6, 7, 8, 8, 10, 11, 12, 12])).collect()
    rows = sorted(((x.vec_id, x.component, x.n, x.whitened is None, x.deviation) for x in out), key=str)
    assert rows == sorted(
        [(i, c, 3, c == 2, dev) for i, dev in ((1, 9437184), (2, 0), (None, 9437184)) for c in (1, 2)]
        + [(8, 1, 2, True, 0)] * 2 + [(12, c, 2, c > 1, 16777216) for c in (1, 2, 3)] * 2, key=str,
    )
    assert all(x.identity_error < 1e-12 for x in out)
    assert whitening.whitened(frame(spark, vectors).limit(0)).collect() == []
    assert whitening.whitened(frame(spark, [[5.0, 6.0]])).collect()[0].whitened is None


def test_deviation_beyond_a_long_is_null(spark):
    out = whitening.whitened(frame(spark, [[1e9, 0.0], [-1e9, 0.0], [0.0, 0.0]])).collect()
    assert {x.vec_id: x.deviation for x in out} == {0: None, 1: None, 2: 0}
    assert max(x.whitened for x in out if x.whitened is not None) == pytest.approx(math.sqrt(1.5))


def test_substitution_solves(spark):
    r = np.random.default_rng(0)
    factor = np.triu(r.normal(size=(7, 7))) + 5 * np.eye(7)
    rows = r.normal(size=(20, 7))
    assert np.allclose(whitening.solved(rows.copy(), factor) @ factor, rows)
