"""Whitening against a dense eigendecomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cashplan.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, vectors, ids=None):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 0) for i, v in zip(ids or range(len(vectors)), vectors, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def dense(vectors):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(np.float64)) + 100_000
    centred = x - x.mean(axis=0)
    value, vector = np.linalg.eigh(centred.T @ centred / len(x))
    return x.astype(np.int64), centred, value[::-1], vector[:, ::-1]


def test_components_are_the_covariances(spark, make_docs):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(500, 12)) * np.linspace(0.1, 1, 12) + 3).astype(np.float32)
    got = whitening.whitened(frame(spark, vectors)).toPandas().sort_values(["component", "vec_id"])
    x, centred, value, vector = dense(vectors)
    assert got.n.eq(500).all() and got.component.max() == 8 and len(got) == 4000 and got.identity_error.max() < 1e-12
    s = x.sum(axis=0).astype(object)
    want = [sum(int(v) ** 2 for v in 500 * row.astype(object) - s) for row in x]
    for k in range(8):
        mine = got[got.component == k + 1]
        z = centred @ vector[:, k] / np.sqrt(value[k])
        sign = np.sign(z @ mine.whitened.to_numpy())
        np.testing.assert_allclose(mine.whitened, sign * z, atol=1e-9)
        np.testing.assert_allclose(mine.explained, value[k] / value.sum(), rtol=1e-10)
        assert [int(v) for v in mine.deviation] == want


def test_directions_without_variance_have_no_component(spark, make_docs):
    rng = np.random.default_rng(2)
    part = rng.normal(size=(200, 3))
    vectors = np.hstack([part, part[:, :2], np.ones((200, 4))]).astype(np.float32)  # copies and constants
    got = whitening.whitened(frame(spark, vectors)).toPandas()
    assert sorted(got.component.unique()) == [1, 2, 3] and got.identity_error.max() < 1e-9
    value = dense(vectors)[2]
    want = value[:3] / value.sum()
    np.testing.assert_allclose(got.groupby("component").explained.first(), want, rtol=1e-9)


def test_ill_conditioned_rows(spark, make_docs):
    """Variances over 14 orders of magnitude, so that the first Gram matrix alone has lost the small ones."""
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    vectors = rng.normal(size=(400, 6)) * 10.0 ** np.array([7, 6, 4, 3, 1, 0]) @ turn
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    got = whitening.whitened(rows).toPandas()
    assert sorted(got.component.unique()) == [1, 2, 3, 4, 5, 6]
    x = (np.floor(1024 * vectors) + 100_000).astype(np.longdouble)
    singular = np.linalg.svd((x - x.mean(axis=0)).astype(np.float64), compute_uv=False)
    want = singular**2 / (singular**2).sum()
    np.testing.assert_allclose(got.groupby("component").explained.first(), want, rtol=1e-6)
    # rows are projected as they are, so the smallest components keep what rounding leaves of them
    assert got.identity_error.max() < 1e-4


def test_odd_rows(spark, make_docs):
    vectors = [[1, 2], None, [1, None], [float("nan"), 1], [float("inf"), 1], [], [3, 1], [1, 2], [1, 2, 3], [1e30, 0], [0, 5]]
    ids = [1, 2, 3, 4, 5, 6, None, 1, 8, 9, 10]
    extra = frame(spark, vectors, ids).withColumns({name: F.lit("clash") for name in ("x", "size", "vector", "n", "component", "place")})
    got = whitening.whitened(extra).toPandas()
    assert len(got) == 8 and got.n.eq(4).all() and got.vec_id.isna().sum() == 2 and (got.vec_id == 1).sum() == 4


@pytest.mark.parametrize("vectors", [[], [None], [[1, 2]], [[1, 2], [1, 2], [1, 2]]])
def test_nothing_to_whiten(spark, make_docs, vectors):
    got = whitening.whitened(frame(spark, vectors) if vectors else spark.createDataFrame([], SCHEMA))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.collect() == []


def test_deviations_are_exact_at_any_size():
    for n, spread in ((7, 1000), (10**12, 10**6), (10**9, 10**15)):
        rng = np.random.default_rng(4)
        x = rng.integers(-spread, spread, (5, 3))
        sums = [int(v) * n // 5 + 3 for v in x.sum(axis=0)]
        want = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
        assert whitening.Centre.of(n, sums).deviations(x) == want


def test_triangular_solves_and_pivots():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(300, 150))
    r = np.linalg.qr(a)[1]
    np.testing.assert_allclose(whitening.divided(a, r) @ r, a, atol=1e-9)
    b = np.hstack([a[:, :3], a[:, :1]])
    kept, rows = whitening.pivoted_cholesky(b.T @ b, 1e-8)
    assert len(kept) == 3
    np.testing.assert_allclose(rows.T @ rows, b.T @ b, atol=1e-9)
    np.testing.assert_allclose(np.tril(rows[:, kept], -1), 0)
