"""Fitting a factor model in two aggregate passes, and scoring voxels in a narrow one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import Snapshots
from . import algebra
from .leading import leading_eigen
from .moments import cross_blocks, gram_blocks, matrix_of, rows_of, tall_matrix
from .sparse import project_sparse, sparse_gram_blocks
from .voxels import nonempty_voxels

#: Scores are stored times this, loadings divided by it.
SCALE = 1000.0


@dataclass(frozen=True)
class Model:
    """A fitted model. eigenvalues: of all features, or of the components alone; to_scores, loadings: features x components, scaled; n: voxels; mean: of each
    feature; converged, steps: of the rotation."""

    eigenvalues: np.ndarray
    to_scores: np.ndarray
    loadings: np.ndarray
    mean: np.ndarray
    n: int
    converged: bool
    steps: int

    @property
    def components(self) -> int:
        return self.loadings.shape[1]

    def transform(self, m: DataFrame) -> DataFrame:
        """(voxel_id, scores) of the non-empty voxels: a projection, without a shuffle."""
        return project_sparse(m, self.to_scores) if is_sparse(m) else project(nonempty_voxels(m), self.to_scores)

    def eigenvalue_table(self, spark: SparkSession) -> DataFrame:
        """(idx, eigenvalue), largest first."""
        return spark.createDataFrame([(i, float(v)) for i, v in enumerate(self.eigenvalues)], "idx int, eigenvalue double")

    def loading_rows(self, spark: SparkSession) -> DataFrame:
        """(component, feature_idx, loading)."""
        rows = [(c, k, float(self.loadings[k, c])) for c in range(self.components) for k in range(len(self.mean))]
        return spark.createDataFrame(rows, "component int, feature_idx int, loading double")

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The model as tables: eigenvalues, features (mean, weights and loadings of each) and fit."""
        rows = [(i, float(self.mean[i]), [float(x) for x in self.to_scores[i]], [float(x) for x in self.loadings[i]]) for i in range(len(self.mean))]
        fit = [(self.n, self.components, self.converged, self.steps)]
        return {"eigenvalues": self.eigenvalue_table(spark), "features": spark.createDataFrame(rows, FEATURES), "fit": spark.createDataFrame(fit, FIT)}

    def save(self, path: str, spark: SparkSession) -> None:
        """Writes ``tables`` below path, in place; ``load_model`` reads them. ``publish_model`` saves while others read."""
        for name, df in self.tables(spark).items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")


#: Columns of a saved model's tables.
VALUES = "idx int, eigenvalue double"
FEATURES, FIT = "feature_idx int, mean double, to_scores array<double>, loadings array<double>", "n long, components int, converged boolean, steps int"


def load_model(spark: SparkSession, path: str) -> Model:
    """The model that ``Model.save`` wrote."""
    return _model_of(*(spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in (("eigenvalues", VALUES), ("features", FEATURES), ("fit", FIT))))


def publish_model(results: Snapshots, model: Model, **tables: DataFrame) -> int:
    """The model's tables, and others, as the next version of results; its number."""
    return results.publish(**model.tables(results.spark), **tables)


def read_model(results: Snapshots, version: int | None = None) -> Model:
    """The model of a version of results, the newest if none is given."""
    version = results.latest() if version is None else version
    return _model_of(*(results.read(name, version) for name in ("eigenvalues", "features", "fit")))


def _model_of(eigenvalues: DataFrame, features: DataFrame, fit: DataFrame) -> Model:
    """A model from its tables, which are as long as the features; these bound the width of the rows."""
    values = eigenvalues.orderBy("idx").collect()
    own = features.orderBy("feature_idx").collect()
    how = fit.first()
    shape = (len(own), how["components"])
    to_scores, loadings = (np.array([r[c] for r in own], np.float64).reshape(shape) for c in ("to_scores", "loadings"))
    return Model(np.array([r["eigenvalue"] for r in values]), to_scores, loadings, np.array([r["mean"] for r in own]), how["n"], how["converged"], how["steps"])


def project(m: DataFrame, to_scores: np.ndarray) -> DataFrame:
    """(voxel_id, scores) with scores = x @ to_scores; as generated code for small models, as matrix products of Arrow batches for others."""
    k, p = to_scores.shape
    if k * p <= 256:
        own = [reduce(lambda a, b: a + b, [F.get("x", F.lit(i)) * float(to_scores[i, c]) for i in range(k)]) for c in range(p)]
        return m.select("voxel_id", F.array(*own).cast("array<double>").alias("scores"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = rows_of(batch.column(1), k) @ to_scores
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(t.ravel()), p).cast(pa.list_(pa.float64()))], names=["voxel_id", "scores"])

    return m.select("voxel_id", "x").mapInArrow(run, "voxel_id long, scores array<double>")


def moments_of(m: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, second moments and number of the voxels, (voxel_id, x) or (voxel_id, idx, n)."""
    sums = matrix_of(sparse_gram_blocks(m, width) if is_sparse(m) else gram_blocks(m, width))
    if not len(sums):
        return np.zeros(width), np.zeros((width, width)), 0
    n = int(sums[-1, -1])
    return sums[-1, :-1] / n, sums[:-1, :-1] / n, n


def is_sparse(m: DataFrame) -> bool:
    """Whether voxels are rows of indices and counts."""
    return {"idx", "n"} <= set(m.columns)


#: Components up to which the rotation takes moments of order four; with more, it reads the voxels once a step.
MANY = 24


def _scored(m: DataFrame, start: np.ndarray, image: Callable[[np.ndarray], np.ndarray], make: Callable[[DataFrame, int, Callable], DataFrame]) -> DataFrame:
    """make(rows, width, function of a matrix of rows) for the scores of m, in one Python step where rows are dense."""
    if is_sparse(m):
        return make(project_sparse(m, start).select(F.col("scores").alias("x")), start.shape[1], image)
    return make(m, len(start), lambda x: image(x @ start))


def _rotated(m: DataFrame, f: algebra.Factors, n: int, tol: float, max_iter: int, many: int) -> tuple[algebra.Factors, bool, int]:
    """The factors with simple scores: from moments of order four, p ** 4 sums in one pass, or p ** 2 sums in each of several."""
    start, p = f.to_scores, f.to_scores.shape[1]
    if p <= many:
        pairs = matrix_of(_scored(m, start, algebra.pair_products, gram_blocks))[:-1, :-1]
        r, converged, steps = algebra.varimax(algebra.fourth_moments(pairs, p), n, tol, max_iter)
    else:
        cubes = lambda r: tall_matrix(_scored(m, start, lambda t: (t, (t @ r) ** 3), cross_blocks), p, p)
        r, converged, steps = algebra.rotation(cubes, p, n, tol, max_iter)
    return algebra.rotated(f, r), converged, steps


def _from_eigen(m: DataFrame, mean: np.ndarray, values: np.ndarray, vectors: np.ndarray, n: int, components: int, tol: float, max_iter: int, many: int) -> Model:
    """Factors of given eigenvectors: orthonormal scores, rotated, with their signs, scaled."""
    raw = algebra.raw_factors(mean, values, vectors, n, components)
    if not components:
        return Model(values, raw.to_scores, raw.loadings, mean, n, True, 0)
    f, converged, steps = algebra.orthonormal_factors(raw, values, n), True, 0
    if components > 1:
        f, converged, steps = _rotated(m, f, n, tol, max_iter, many)
    f = algebra.orient(f)
    return Model(values, f.to_scores * SCALE, f.loadings / SCALE, mean, n, converged, steps)


@contextmanager
def _kept(m: DataFrame, when: bool) -> Iterator[DataFrame]:
    """m, kept for several passes (rows of a lost executor are made again)."""
    keep = when and not m.is_cached
    own = m.persist(StorageLevel.MEMORY_AND_DISK) if keep else m
    try:
        yield own
    finally:
        if keep:
            own.unpersist()


def fit(m: DataFrame, width: int, components: int, tol: float = 1e-8, max_iter: int = 500, many: int = MANY) -> Model:
    """A model with so many components (0: eigenvalues only) of (voxel_id, x) rows of width counts, or of sparse rows (voxel_id, idx, n).

    Pass 1: mean and second moments. From two components on, for the rotation: up to ``many`` components one pass for moments of order
    four of the scores, with more a pass a step. Raises ValueError for more components than features, voxels or rank.
    """
    with _kept(m if is_sparse(m) else nonempty_voxels(m), components > 1) as own:
        mean, c, n = moments_of(own, width)
        values, vectors = algebra.noise_eigen(mean, c)
        return _from_eigen(own, mean, values, vectors, n, components, tol, max_iter, many)


def fit_leading(m: DataFrame, width: int, components: int, tol: float = 1e-8, max_iter: int = 500, many: int = MANY, eigen_tol: float = 1e-8, passes: int = 60) -> Model:
    """The model of ``fit`` for sparse rows of any width: no sums of all pairs of features, but ``passes`` over the rows at most.

    Its eigenvalues are those of its components; it has converged if these did (see ``leading_eigen``) and so did the rotation.
    """
    with _kept(m, True) as own:
        mean, values, vectors, n, found = leading_eigen(own, width, components, tol=eigen_tol, passes=passes)
        if len(values) < components:
            raise ValueError(f"{components} components of {int((mean > 0).sum())} features and {n} voxels")
        model = _from_eigen(own, mean, values, vectors, n, components, tol, max_iter, many)
        return replace(model, converged=model.converged and found)
