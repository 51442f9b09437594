import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainfield.functions.grid import GridSpec, voxel_id
from grainfield.operators import algebra, report
from grainfield.operators.model import fit, load_model, project
from grainfield.operators.moments import gram_blocks, matrix_of, mean_spectrum, second_moments
from grainfield.operators.select import select_ions
from grainfield.operators.voxels import dense_rows, ion_type_counts, nonempty_voxels, voxel_counts, voxelize
from grainfield.plans.queries import explode_grid_q
from grainfield.sources.tables import assign_ion_id, explode_grid, read_ion_types, read_ions, type_names, write_results
from grainfield.streaming.select import select_stream, to_parquet

GRID = GridSpec((10, 20, 30), (2, 2, 2), (3, 2, 2))
A = [[4, 0], [2, 2], [0, 6], [1, 1]]
B = [[9, 1, 0], [8, 2, 1], [1, 7, 0], [0, 9, 2], [1, 1, 8], [2, 0, 6]]


def matrix(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "voxel_id long, x array<double>")


def scores_of(model, m):
    return np.array([r["scores"] for r in model.transform(m).orderBy("voxel_id").collect()])


@pytest.mark.parametrize(
    ("pos", "wrap", "strict"),
    [
        ((10, 20, 30), 0, 0),
        ((11.9, 21.9, 31.9), 0, 0),
        ((12, 22, 32), 10, 10),
        ((15.99, 23.99, 33.99), 11, 11),
        ((9.1, 20, 30), 0, None),
        ((16, 20, 30), 3, None),
        ((10, 24, 30), 6, None),
        ((10, 20, 34), 12, None),
        ((7.9, 20, 30), -1, None),
        ((None, 20, 30), None, None),
        ((float("nan"), 20, 30), None, None),
        ((1e30, 20, 30), None, None),
    ],
)
def test_cells(spark, pos, wrap, strict):
    df = spark.createDataFrame([tuple(None if v is None else float(v) for v in pos)], "x float, y float, z float")
    row = df.select(*[voxel_id(F.col("x"), F.col("y"), F.col("z"), GRID, b).alias(b) for b in ("wrap", "strict")]).first()
    assert (row["wrap"], row["strict"]) == (wrap, strict)


def test_cells_use_32_bit_floats(spark):
    grid = GridSpec((0, 0, 0), (0.1, 1, 1), (100, 1, 1))
    df = spark.createDataFrame([(v,) for v in (0.3, 0.6, 0.7, 0.9)], "x double")
    got = [r[0] for r in df.select(voxel_id(F.col("x"), F.lit(0.0), F.lit(0.0), grid)).collect()]
    assert got == [3, 6, 7, 9]


def test_bad_parameters(spark):
    with pytest.raises(ValueError):
        GridSpec((0, 0, 0), (1, 0, 1), (1, 1, 1))
    with pytest.raises(ValueError):
        voxel_id(F.lit(0.0), F.lit(0.0), F.lit(0.0), GRID, "loose")
    with pytest.raises(ValueError):
        report.component_scores(spark.createDataFrame([], "voxel_id long, scores array<double>"), -1)


def test_golden_a(spark):
    m = matrix(spark, A)
    model = fit(m, 2, 1)
    assert model.eigenvalues == pytest.approx([4.778659, 2.776896], abs=1e-6)
    assert scores_of(model, m)[:, 0] == pytest.approx([230.889923, 402.917105, 862.416431, 201.458553], abs=1e-5)
    assert model.loadings[:, 0] == pytest.approx([0.00193085, 0.00618179], abs=1e-8)
    two = fit(m, 2, 2, tol=1e-15)
    want = np.array([(-94.9767, 880.7204), (268.8499, 420.1470), (949.0148, -60.6395), (134.4250, 210.0735)])
    assert np.sort(scores_of(two, m)) == pytest.approx(np.sort(want), abs=1e-3)
    loose = fit(m, 2, 2)
    assert np.sort(scores_of(loose, m)) == pytest.approx(np.sort(scores_of(two, m)), abs=0.05)


def test_golden_b(spark):
    m = matrix(spark, B)
    one = fit(m, 3, 1)
    assert one.eigenvalues == pytest.approx([9.841079, 5.410684, 4.915184], abs=1e-6)
    assert scores_of(one, m)[:, 0] == pytest.approx([440.250022, 476.514711, 337.108193, 453.905990, 395.693511, 320.729967], abs=1e-5)
    two = scores_of(fit(m, 3, 2, tol=1e-15), m)
    want = np.array([(718.2984, -97.2811), (635.1841, 37.5445), (-3.9212, 481.6125), (-88.9883, 732.5125), (150.6214, 409.4799), (223.5338, 230.0604)])
    assert np.sort(two) == pytest.approx(np.sort(want), abs=1e-3)
    three = fit(m, 3, 3, tol=1e-15)
    assert scores_of(three, m) @ three.loadings.T == pytest.approx(np.array(B, float), abs=1e-9)


def oracle(x, p):
    """The factor model by plain dense algebra on all rows."""
    x = x[(x != 0).any(1)]
    n, k = x.shape
    mean, c = x.mean(0), x.T @ x / n
    root = np.sqrt(mean)
    values, z = np.linalg.eigh(c / np.outer(root, root))
    values, z = values[::-1], z[:, ::-1]
    v = z[:, :p] / root[:, None]
    t, load = x @ v, mean[:, None] * v
    u, s, w = np.linalg.svd(t @ load.T, full_matrices=False)
    t, load = u[:, :p], w[:p].T * s[:p]
    r, best = np.eye(p), 0
    for _ in range(2000):
        b = t @ r
        left, s, right = np.linalg.svd(t.T @ (b**3 - b * (b**2).mean(0)))
        r = left @ right
        if s.sum() <= best * (1 + 1e-15):
            break
        best = s.sum()
    t, load = t @ r, load @ r
    sign = np.where(2 * (load**2 * (load > 0)).sum(0) < (load**2).sum(0), -1, 1)
    return values, t * sign * 1000, load * sign / 1000


@pytest.mark.parametrize(("k", "p", "seed"), [(4, 1, 1), (4, 2, 2), (5, 3, 3)])
def test_against_dense_algebra(spark, k, p, seed):
    rng = np.random.default_rng(seed)
    x = rng.poisson(rng.gamma(2, 4, (200, p + 1)) @ rng.gamma(1, 1, (p + 1, k)))
    m = matrix(spark, x.tolist())
    model = fit(m.repartition(3), k, p, tol=1e-15)
    values, scores, loads = oracle(x.astype(float), p)
    assert model.eigenvalues == pytest.approx(values, rel=1e-9)
    own = scores_of(model, m)
    order, want = np.argsort(model.loadings[0]), np.argsort(loads[0])
    assert model.loadings[:, order] == pytest.approx(loads[:, want], abs=1e-6)
    assert own[:, order] == pytest.approx(scores[:, want], abs=1e-3)
    t = own / 1000
    assert t.T @ t == pytest.approx(np.eye(p), abs=1e-9)
    assert model.eigenvalues.sum() == pytest.approx(((x**2).mean(0) / x.mean(0)).sum())
    wide = project(m, np.hstack([model.to_scores] * 60)).orderBy("voxel_id").first()["scores"][:p]
    assert wide == pytest.approx(own[0].tolist())


def test_edges_of_the_model(spark):
    rows = [*A, [0, 0], [-1, 0]]
    m = matrix(spark, rows)
    assert [r["voxel_id"] for r in nonempty_voxels(m).orderBy("voxel_id").collect()] == [0, 1, 2, 3, 5]
    inactive = fit(matrix(spark, [[*r[:1], 0, *r[1:]] for r in A]), 3, 1)
    assert inactive.loadings[1, 0] == 0 and inactive.eigenvalues[2] == 0
    none = fit(matrix(spark, A), 2, 0)
    assert none.components == 0 and none.loading_rows(spark).count() == 0
    assert none.transform(matrix(spark, A)).first()["scores"] == []
    for rows, p in ((A, 3), (A[:1], 2), ([[1, 1], [2, 2], [3, 3]], 2)):
        with pytest.raises(ValueError):
            fit(matrix(spark, rows), 2, p)
    with pytest.raises(ValueError):
        fit(matrix(spark, []), 2, 1)
    assert fit(matrix(spark, []), 2, 0).eigenvalues.tolist() == [0, 0]
    half = algebra.Factors(np.eye(2), np.array([[1.0], [-1.0]]))
    assert algebra.orient(half).loadings[0, 0] == 1


def ions(spark, n=400, seed=5):
    rng = np.random.default_rng(seed)
    names = [None, "A", "B", "C"]
    rows = [(i, *map(float, rng.uniform((9, 19, 29), (17, 25, 35))), names[rng.integers(4)]) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, 20.0, 30.0, "A")], "ion_id long, x float, y float, z float, ion string")


def test_counts(spark):
    own, names = ions(spark), ["B", "A"]
    wide = {r["voxel_id"]: r["x"] for r in voxelize(own, names, GRID).collect()}
    long = {r["voxel_id"]: r["x"] for r in dense_rows(voxel_counts(own, names, GRID), 2).collect()}
    assert wide == long and set(wide) <= set(range(12)) and wide
    total = sum(v for x in wide.values() for v in x)
    assert total == own.where("x >= 10 and x < 16 and y >= 20 and y < 24 and z >= 30 and z < 34 and ion in ('A', 'B')").count()
    many = [f"i{k}" for k in range(70)] + names
    assert {r["voxel_id"]: r["x"][70:] for r in voxelize(own, many, GRID).collect()} == wide
    types = spark.createDataFrame([(0, "A"), (1, "Z")], "feature_idx int, ion string")
    got = {r["ion"]: (r["n"], r["total"]) for r in ion_type_counts(own, types).collect()}
    a = own.where("ion = 'A'").count()
    assert got == {"A": (a, a), "Z": (0, a)}


def test_moments(spark):
    m, x = matrix(spark, B).repartition(4), np.array(B, float)
    sums = matrix_of(gram_blocks(m, 3))
    assert sums[:3, :3] == pytest.approx(x.T @ x) and sums[3, 3] == 6
    assert {r["feature_idx"]: r["mean"] for r in mean_spectrum(m, 3).collect()} == pytest.approx(dict(enumerate(x.mean(0))))
    assert {(r["i"], r["j"]): r["value"] for r in second_moments(m, 3).collect()}[0, 2] == pytest.approx((x[:, 0] * x[:, 2]).mean())
    assert matrix_of(gram_blocks(matrix(spark, []), 3)).size == 0


def test_selection(spark):
    own = ions(spark)
    scores = spark.createDataFrame([(0, [1.0]), (1, [0.5]), (3, [2.0]), (12, [5.0])], "voxel_id long, scores array<double>")
    hit = {r["ion_id"] for r in select_ions(own, scores, GRID).collect()}
    rest = {r["ion_id"] for r in select_ions(own, scores, GRID, invert=True).collect()}
    cells = {r["ion_id"]: r["v"] for r in own.select("ion_id", voxel_id(F.col("x"), F.col("y"), F.col("z"), GRID).alias("v")).collect()}
    assert hit == {i for i, v in cells.items() if v in (0, 3, 12)} and hit
    assert not hit & rest and len(hit | rest) == own.count() and 400 in rest
    strict = {r["ion_id"] for r in select_ions(own, scores, GRID, bounds="strict").collect()}
    assert strict < hit
    assert select_ions(own, scores, GRID, component=1).count() == 0
    assert select_ions(own, scores, GRID, component=1, invert=True).count() == own.count()
    assert {cells[r["ion_id"]] for r in select_ions(own, scores, GRID, isovalue=-1).collect()} <= {0, 1, 3, 12}


def test_reports(spark):
    m = matrix(spark, A)
    model = fit(m, 2, 1)
    types = spark.createDataFrame([(0, "A"), (1, "B")], "feature_idx int, ion string")
    rows = {r["ion"]: r["label"] for r in report.loadings_table(model, types).collect()}
    assert rows == {"A": "0.002", "B": "0.006"}
    with pytest.raises(ValueError):
        report.loadings_table(model, types.where("feature_idx = 0"))
    scores = model.transform(m)
    assert report.score_bounds(scores, 0).first()["max"] == pytest.approx(862.416431)
    assert report.score_bounds(scores, 1).first().asDict() == {"component": 1, "min": None, "max": None}
    assert report.component_scores(scores, 1).count() == 0


@pytest.mark.parametrize(("values", "want"), [([0.0, 0.005, 0.01, 0.02], [2, 2]), ([3.0, 3.0], [2]), ([0.0, 0.05, None], [1, 0, 0, 0, 1]), ([], [])])
def test_histogram(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "s float")
    got = [r["n"] for r in report.score_histogram(df, "s").orderBy("bin").collect()]
    assert got == want


def test_row_numbers(spark):
    rng = np.random.default_rng(1)
    rows = [(int(v), i) for i, v in enumerate(rng.integers(0, 50, 300))]
    got = assign_ion_id(spark.createDataFrame(rows, "a int, b int").repartition(5), ["a", "b"]).orderBy("ion_id").collect()
    assert [(r["a"], r["b"]) for r in got] == sorted(rows) and [r["ion_id"] for r in got] == list(range(300))


def test_tables(spark, tmp_path):
    grid = spark.createDataFrame([(0, [0.0, 2.0, None]), (1, [1.5, 0.0, -1.0])], "feature_idx int, counts array<float>")
    assert sorted(map(tuple, explode_grid(grid).collect())) == [(0, 1, 1.5), (1, 0, 2.0), (2, 1, -1.0)]
    own = ions(spark, 20)
    types = spark.createDataFrame([(1, "B"), (0, "A")], "feature_idx int, ion string")
    write_results(str(tmp_path), ions=own, types=types)
    assert read_ions(spark, f"{tmp_path}/ions").count() == 21
    assert type_names(read_ion_types(spark, f"{tmp_path}/types")) == ["A", "B"]
    with pytest.raises(ValueError):
        type_names(types.where("feature_idx = 1"))


def test_stream_equals_batch(spark, tmp_path):
    own = ions(spark).repartition(3)
    write_results(str(tmp_path), ions=own)
    scores = spark.createDataFrame([(0, [1.0]), (3, [2.0])], "voxel_id long, scores array<double>")
    for invert in (False, True):
        stream = select_stream(read_ions(spark, f"{tmp_path}/ions", stream=True), scores, GRID, invert=invert)
        to_parquet(stream, f"{tmp_path}/out{invert}", f"{tmp_path}/state{invert}").awaitTermination()
        got = {r["ion_id"] for r in spark.read.parquet(f"{tmp_path}/out{invert}").collect()}
        assert got == {r["ion_id"] for r in select_ions(own, scores, GRID, invert=invert).collect()}
    with pytest.raises(ValueError):
        select_stream(own, scores, GRID)


def test_varimax_leaves_one_component(spark):
    t = np.array([[0.6], [0.8]])
    r, settled, _ = algebra.varimax(algebra.fourth_moments(algebra.pair_products(t).T @ algebra.pair_products(t), 1), 2)
    assert abs(r[0, 0]) == pytest.approx(1) and settled and math.isfinite(r[0, 0])


def test_event_grid_has_all_users(spark, tmp_path):
    users = [-300, -1, 0, 63, 64, 255, 256, 700, 700, 10**12, None]
    rows = [(u, t) for i, u in enumerate(users) for t in ["click", "view", "other"][: 1 + i % 3]]
    spark.createDataFrame(rows, "user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for u, t in rows:
        if u is not None and t != "other":
            want[u, {"click": 0, "view": 4}[t]] = want.get((u, {"click": 0, "view": 4}[t]), 0) + 1
    got = explode_grid_q(spark, str(tmp_path)).collect()
    assert {(r["voxel_id"], r["feature_idx"]): r["n"] for r in got} == want and len(got) == len(want)


def test_histogram_without_infinities(spark):
    rows = [(0.0,), (1.0,), (float("inf"),), (float("-inf"),), (float("nan"),), (None,)]
    got = report.score_histogram(spark.createDataFrame(rows, "v double"), "v", 0.5).orderBy("bin").collect()
    assert [(r["bin"], r["n"]) for r in got] == [(0, 1), (1, 1)]
    assert report.score_histogram(spark.createDataFrame(rows[2:], "v double"), "v", 0.5).count() == 0
    with pytest.raises(ValueError):
        report.score_histogram(spark.createDataFrame([(0.0,), (1e12,)], "v double"), "v", 0.01)


def test_saved_model(spark, tmp_path):
    m = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate([[9, 1, 0], [8, 2, 1], [1, 7, 0], [0, 9, 2], [1, 1, 8], [2, 0, 6]])], "voxel_id long, x array<double>")
    for p in (0, 1, 3):
        one = fit(m, 3, p)
        one.save(f"{tmp_path}/{p}", spark)
        two = load_model(spark, f"{tmp_path}/{p}")
        assert all(np.array_equal(getattr(one, c), getattr(two, c)) for c in ("eigenvalues", "to_scores", "loadings", "mean"))
        assert (one.n, one.converged, one.steps, one.components) == (two.n, two.converged, two.steps, two.components)


def test_wide_gram(spark):
    """The two-level sum of blocks: equal to dense sums, in rows a task that do not grow with the width."""
    rng = np.random.default_rng(2)
    x = rng.poisson(0.4, (300, 150)).astype(float)
    m = matrix(spark, x.tolist()).repartition(5)
    blocks = gram_blocks(m, 150)
    y = np.hstack([x, np.ones((300, 1))])
    assert (matrix_of(blocks) == y.T @ y).all()
    assert blocks.count() == 36 and gram_blocks(matrix(spark, []), 150).count() == 0
    got = second_moments(m, 150).where("i > j").collect()
    assert len(got) == 150 * 149 / 2 and all(math.isclose(r["value"], (y.T @ y)[r["i"], r["j"]] / 300) for r in got)
