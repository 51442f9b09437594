"""Whitening against dense eigenvectors, and on odd rows."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainfield.llm import queries, whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def dense(x: np.ndarray):
    """Eigenvalues, falling, and eigenvectors of the covariance of integer rows, centred exactly."""
    n = len(x)
    mean = [Fraction(int(s), n) for s in x.sum(0)]
    z = np.array([[float(int(v) - m) for v, m in zip(r, mean)] for r in x])
    e, v = np.linalg.eigh(z.T @ z / n)
    return z, e[::-1], v[:, ::-1]


def check(rows, got, top=8):
    """Rows of the operator against the dense form; got: rows by id."""
    x = np.array([[int(np.floor(float(np.float32(c)) * 1024)) + 100_000 for c in r[1]] for r in rows])
    z, e, v = dense(x)
    n, s = len(x), x.sum(0)
    want = z @ v[:, :top] / np.sqrt(e[:top])
    assert len(got) == n * top
    by = {(r["vec_id"], r["component"]): r for r in got}
    white = np.array([[by[r[0], k + 1]["whitened"] for k in range(top)] for r in rows])
    sign = np.sign((white * want).sum(0))
    assert np.abs(white * sign - want).max() < 1e-8
    for i, r in enumerate(rows):
        own = by[r[0], 1]
        assert own["n"] == n and own["deviation"] == int(((n * x[i].astype(object) - s) ** 2).sum())
    for k in range(top):
        assert abs(by[rows[0][0], k + 1]["explained"] / (e[k] / e.sum()) - 1) < 1e-9
    error = {r["identity_error"] for r in got}
    assert len(error) == 1 and error.pop() < 1e-10


@pytest.mark.parametrize("dim", [9, 70])
def test_whitening(spark, dim):
    rng = np.random.default_rng(dim)
    x = (rng.normal(size=(400, dim)) * np.geomspace(3, 0.05, dim)) @ np.linalg.qr(rng.normal(size=(dim, dim)))[0] + 7
    rows = [(i, [float(c) for c in r], 1) for i, r in enumerate(x)]
    bad = [(900, None, 1), (901, [1.0] * (dim - 1) + [None], 1), (902, [float("nan")] * dim, 2), (903, [float("inf")] + [0.0] * (dim - 1), 2)]
    df = spark.createDataFrame(rows + bad, VECTORS).withColumn("component", F.lit("x")).repartition(3)
    check(rows, whitening.whiten(df).collect())


def test_registered_query(spark, sf_dir):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect() if r["embedding"] is not None and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    check(rows, queries.QUERIES["op12_whitening"](spark, sf_dir).collect())


def test_odd_tables(spark):
    """No rows, equal rows, fewer rows than dimensions, equal dimensions, empty and short vectors, huge entries."""
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert make([]) == [] and make([(1, None, 1), (2, [], 1)]) == [] and make([(1, [0.5, 0.25], 1)] * 3) == []
    got = make([(1, [0.5, 0.25, 0.25], 1), (2, [0.0, 1.0, 1.0], 1), (None, [0.25], 1), (2, [], 1)])
    assert {r["component"] for r in got} == {1, 2} and len(got) == 8 and {r["n"] for r in got} == {4} and got[0]["identity_error"] < 1e-12
    got = make([(1, [3e38, 1.0], 1), (2, [-3e38, 0.0], 1), (3, [0.0, 0.5], 1)])
    assert len(got) in (3, 6) and [r["deviation"] for r in got if r["vec_id"] == 1][0] is None
    assert [r["deviation"] for r in make([(1, [1.0], 1), (2, [0.0], 1)])] == [1024 * 1024] * 2


def test_factors():
    """A graded matrix keeps the digits of its small eigenvalues; a singular one shows its rank."""
    rng = np.random.default_rng(1)
    d = np.geomspace(1, 1e-6, 12)
    q = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    b = q * d @ q.T
    a = (d[:, None] * (np.eye(12) + 0.1 * b)) * d
    low, order = whitening.pivoted_cholesky(a)
    moved, unit = a[np.ix_(order, order)], np.sqrt(np.diag(a)[order])
    assert np.abs((low @ low.T - moved) / np.outer(unit, unit)).max() < 1e-14 and (np.triu(low, 1) == 0).all() and low.shape == (12, 12)
    turned = whitening.one_sided_jacobi(low)
    inner = turned.T @ turned
    norms = np.sqrt(np.diag(inner))
    assert np.abs(inner / np.outer(norms, norms) - np.eye(12)).max() < 1e-13 and (np.diff(norms) <= 0).all()
    assert whitening.pivoted_cholesky(b[:, :5] @ b[:, :5].T)[0].shape[1] <= 5
