"""Sparse rows, leading factors of wide models, and rotations of many components, against dense algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainfield.functions.grid import GridSpec
from grainfield.operators import algebra, leading
from grainfield.operators.leading import feature_sums, leading_eigen, product
from grainfield.operators.model import fit, fit_leading, moments_of
from grainfield.operators.moments import SIDES, add_blocks, both_triangles, gram_blocks, matrix_of
from grainfield.operators.sparse import dense_of, pair_sums, project_sparse, sparse_gram_blocks, sparse_rows, sparse_voxelize
from grainfield.operators.voxels import voxelize


def sparse_table(spark, x, parts=3):
    rows = [(i, [int(k) for k in np.flatnonzero(r)], [float(v) for v in r[r != 0]]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "voxel_id long, idx array<int>, n array<double>").repartition(parts)


def dense_table(spark, x, parts=3):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "voxel_id long, x array<double>").repartition(parts)


def phases(n, k, groups, seed=0, per=10):
    """Counts of n voxels, about ``per`` types each, whose types come from one of some groups with different weights."""
    rng = np.random.default_rng(seed)
    x = np.zeros((n, k))
    weights = rng.dirichlet(np.full(k, 0.15), groups)
    share = np.arange(1, groups + 1) / sum(range(1, groups + 1))
    for i in range(n):
        own = rng.choice(k, per, p=weights[rng.choice(groups, p=share)])
        np.add.at(x[i], own, 1)
    return x


def scores_of(model, m):
    return np.array([r["scores"] for r in model.transform(m).orderBy("voxel_id").collect()])


def test_sparse_rows(spark):
    counts = spark.createDataFrame([(1, 4, 2.0), (1, 0, 1.0), (1, 4, 3.0), (2, 1, 0.0), (3, 2, None), (4, 9, -1.0), (5, 1, 2.0), (5, 1, -2.0)], "voxel_id long, feature_idx int, n double")
    got = {r["voxel_id"]: (list(r["idx"]), list(r["n"])) for r in sparse_rows(counts).collect()}
    assert got == {1: ([0, 4], [1.0, 5.0]), 4: ([9], [-1.0])}
    assert [list(r["x"]) for r in dense_of(sparse_rows(counts), 6).where("voxel_id = 1").collect()] == [[1, 0, 0, 0, 5, 0]]


def test_sparse_voxelize(spark):
    grid, names = GridSpec((0, 0, 0), (1, 1, 1), (4, 3, 2)), [f"t{i}" for i in range(6)]
    ions = spark.range(500).select(*[((F.col("id") * k) % n - 1).cast("float").alias(c) for k, c, n in ((7, "x", 6), (3, "y", 5), (5, "z", 4))], F.concat(F.lit("t"), (F.col("id") % 8).cast("string")).alias("ion"))
    types = spark.createDataFrame(list(enumerate(names)), "feature_idx int, ion string")
    got = {r["voxel_id"]: list(r["x"]) for r in dense_of(sparse_voxelize(ions, types, grid), 6).collect()}
    assert got == {r["voxel_id"]: list(r["x"]) for r in voxelize(ions, names, grid).collect() if any(r["x"])} and len(got) > 10


def test_sparse_voxelize_joins_counts(spark):
    """Not ions are joined to their types, but counts of each cell and type: one row of them here. Types may share a feature or be listed twice."""
    ions = spark.range(0, 9000, 1, 4).select(*[(F.col("id") % 2 / 4).cast("float").alias(c) for c in "xyz"], F.concat(F.lit("t"), (F.col("id") % 1).cast("string")).alias("ion"))
    types = spark.createDataFrame([(0, "t0"), (2, "t0"), (2, "t0"), (1, "u")], "feature_idx int, ion string")
    rows = sparse_voxelize(ions, types, GridSpec((0, 0, 0), (1, 1, 1), (4, 3, 2)))
    assert [(list(r["idx"]), list(r["n"])) for r in rows.collect()] == [([0, 2], [9000.0, 18000.0])]
    own = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(k for k, x in enumerate(own) if "Join" in x)
    assert any("Aggregate" in x and "ion" in x for x in own[join + 1 :])
    assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("k", [7, 1000])
def test_sparse_moments(spark, k):
    """Ten types a voxel of as many as 1000: equal moments."""
    x = phases(400, k, 3)
    x[5] = 0
    sparse = sparse_table(spark, x)
    y = np.hstack([x, np.ones((400, 1))])
    assert (matrix_of(sparse_gram_blocks(sparse, k)) == y.T @ y).all()
    assert (matrix_of(gram_blocks(dense_table(spark, x), k)) == y.T @ y).all()
    mean, second, n = moments_of(sparse, k)
    assert n == 400 and np.allclose(mean, x.mean(0)) and np.allclose(second, x.T @ x / 400)
    w = np.random.default_rng(1).normal(size=(k, 3))
    got = np.array([r["scores"] for r in project_sparse(sparse, w).orderBy("voxel_id").collect()])
    assert np.allclose(got, x @ w)
    with pytest.raises(ValueError):
        sparse_gram_blocks(sparse, 5000)


@pytest.mark.parametrize("tile", [3, 256])
def test_pair_sums_of_many_features(spark, tile):
    """More features than a task holds pairs of, voxels of several tiles, one of just a tile, and one without any."""
    k = 5000
    x = phases(60, k, 3)
    x[5], x[6] = 0, 0
    x[6, 10:13] = 2
    got = {(r["i"], r["j"]): r["value"] for r in both_triangles(pair_sums(sparse_table(spark, x), tile)).collect()}
    want = x.T @ x
    assert got == {(int(i), int(j)): want[i, j] for i, j in zip(*np.nonzero(want))}


def test_second_moments_of_many_suppliers(spark, sf_dir, tmp_path):
    """Five thousand suppliers, in two copies of the orders that share none."""
    from grainfield.plans.wide_queries import sparse_second_moments

    own = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    small = {tuple(r) for r in sparse_second_moments(spark, sf_dir).collect()}
    far = own.withColumns({"l_orderkey": F.col("l_orderkey") + 10**7, "l_suppkey": F.col("l_suppkey") + 5000})
    own.unionByName(far).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(5100).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    rows = sparse_second_moments(spark, str(tmp_path)).collect()
    assert len(rows) == 2 * len(small) and {tuple(r) for r in rows} == small | {(i + 5000, j + 5000, v) for i, j, v in small}


def test_sparse_fit(spark):
    x = phases(300, 12, 3)
    dense, sparse = dense_table(spark, x), sparse_table(spark, x)
    a, b = fit(dense, 12, 3, 1e-14), fit(sparse, 12, 3, 1e-14)
    assert np.allclose(a.eigenvalues, b.eigenvalues) and np.abs(scores_of(a, dense) - scores_of(b, sparse)).max() < 1e-6
    assert (a.n, a.converged) == (b.n, b.converged) == (300, True)


def test_leading_eigenvalues_of_a_wide_model(spark):
    """Five thousand features: the largest eigenvalues are those of the dense matrix (by its equal, voxels x voxels)."""
    k, n, p = 5000, 500, 5
    x = phases(n, k, 4, seed=3, per=40)
    sparse = sparse_table(spark, x)
    mean, count = feature_sums(sparse, k)
    assert count == n and np.allclose(mean, x.mean(0))
    got_mean, values, vectors, rows, converged = leading_eigen(sparse, k, p)
    active = mean > 0
    z = x[:, active] / np.sqrt(mean[active])
    want = np.linalg.eigvalsh(z @ z.T / n)[::-1][:p]
    assert converged and rows == n and np.abs(values / want - 1).max() < 1e-6
    assert np.abs(vectors.T @ (mean[:, None] * vectors) - np.eye(p)).max() < 1e-8
    assert np.abs(x.T @ (x @ vectors) / n - mean[:, None] * vectors * values).max() < 1e-5 * values[0]


def test_leading_sums_by_cores(spark, monkeypatch):
    """However many parts the rows have, sums as wide as the model come from as many tasks as there are cores."""
    k, given = 5000, []
    x = phases(300, k, 3)
    m = sparse_table(spark, x, 40)

    def counted(parts, *args, **kwargs):
        given.append(parts.count())
        return add_blocks(parts, *args, **kwargs)

    monkeypatch.setattr(leading, "add_blocks", counted)
    q = np.random.default_rng(2).normal(size=(k, 2))
    assert np.allclose(product(m, k, q), x.T @ (x @ q))
    mean, n = feature_sums(m, k)
    assert n == 300 and np.allclose(mean, x.mean(0))
    assert len(given) == 2 and max(given) <= SIDES * spark.sparkContext.defaultParallelism


def test_leading_fit_is_the_fit(spark):
    x = phases(300, 30, 3, seed=5)
    x[:, 7] = 0
    sparse = sparse_table(spark, x)
    a, b = fit(sparse, 30, 3, 1e-14), fit_leading(sparse, 30, 3, 1e-14, eigen_tol=1e-11)
    assert b.converged and np.allclose(a.eigenvalues[:3], b.eigenvalues, rtol=1e-9)
    assert np.abs(a.loadings - b.loadings).max() < 1e-6 * np.abs(a.loadings).max() and np.abs(scores_of(a, sparse) - scores_of(b, sparse)).max() < 1e-4
    assert fit_leading(sparse, 30, 20).components == 20
    for p in (29, 31):
        with pytest.raises(ValueError):
            fit_leading(sparse, 30, p)
    assert fit_leading(sparse_table(spark, np.zeros((0, 30)), 1), 30, 0).n == 0


@pytest.mark.parametrize("sparse", [False, True])
def test_rotation_by_passes(spark, sparse):
    """Sixty components: each pass gives what moments of order four would, so the rotation is the dense one step for step."""
    n, k, p, steps = 500, 64, 60, 6
    x = np.random.default_rng(7).poisson(3, (n, k)).astype(float) + 5 * phases(n, k, 8, seed=7)
    m = (sparse_table if sparse else dense_table)(spark, x)
    model = fit(m, k, p, 1e-14, steps)
    assert model.steps == steps and not model.converged
    mean = x.mean(0)
    values, vectors = algebra.noise_eigen(mean, x.T @ x / n)
    f = algebra.orthonormal_factors(algebra.raw_factors(mean, values, vectors, n, p), values, n)
    t = x @ f.to_scores
    r = np.eye(p)
    for _ in range(steps):
        y = t @ r
        left, _, right = np.linalg.svd(t.T @ (y**3 - y * (y * y).mean(0)))
        r = left @ right
    want = algebra.orient(algebra.rotated(f, r))
    assert np.abs(scores_of(model, m) - x @ want.to_scores * 1000).max() < 1e-4


def test_both_rotations_agree(spark):
    x = phases(300, 12, 3)
    m = dense_table(spark, x)
    a, b = fit(m, 12, 3, 1e-12), fit(m, 12, 3, 1e-12, many=1)
    assert a.converged and b.converged and np.abs(a.to_scores - b.to_scores).max() < 1e-6 * np.abs(a.to_scores).max()


def test_rotation_row_tells(spark, sf_dir):
    """The rows of varimax_scores_3 are not those of a fit without its rotation."""
    from grainfield.plans.queries import _matrix
    from grainfield.plans.wide_queries import varimax_scores_3

    m = _matrix(spark, sf_dir, "phase3")
    bare = fit(m, 3, 3, max_iter=0).transform(m)
    bare = {(r["voxel_id"], *(round(x, 2) for x in sorted(r["scores"]))) for r in bare.collect()}
    rows = {tuple(r) for r in varimax_scores_3(spark, sf_dir).collect()}
    assert len(rows & bare) < 0.2 * len(rows)
