"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries become integers x = floor(1024 * c) + 100000. One pass gives n and the exact sums S of each dimension, a second the
scatter matrix of x less its rounded mean: differences of integers, multiplied after centring, so the large offset never enters
a product, and sums are exact up to 2^53 in any order of tasks. What rounding the mean left over (at most a half) goes out as one outer
product. Both passes give numbers as many as the dimensions (or their products), in blocks, never rows, to the driver.

The scatter A is factored as P'AP = L L' by Cholesky with diagonal pivots, which shows the rank. Plane rotations from the right then
make the columns of L itself orthogonal (one-sided Jacobi, all disjoint pairs of a round at once): L J = U s. As A = P L L' P', the
squared norms of the rotated columns are its eigenvalues, and the columns by their norms, P U, its eigenvectors. No product L'L is made, so
small eigenvalues keep their digits. Rows are projected in Arrow batches and written once; the error of the result is measured by
Spark's covar_pop on what was written.

Nulls and odd rows: a vector that is null or holds null, NaN or an infinite entry is dropped; an empty one isn't. Shorter vectors have 0 for
missing entries. Ids may be null or repeat; each row has its own result. x stays within 2^53 in size. Directions without any variance (fewer rows
than dimensions, constant or repeated dimensions) are no components: a table has as many as its rank, 8 at most, and where all
vectors are equal, or there are none, the result is empty. A deviation that no long holds is null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.moments import BLOCK, add_blocks, matrix_of, triangle_blocks
from .common import written
from .vectors import matrix

#: x = floor(SCALE * c) + OFFSET, kept within LIMIT in size.
SCALE, OFFSET, LIMIT = 1024, 100_000, 1 << 53
#: Sums are made of numbers of so many bits, so that no sum of a long passes 63 bits.
_HALF = 26
_SUMS = "j int, high long, low long, n long"
_WHITE = "vec_id long, deviation long, white array<double>"


def finite(df: DataFrame, vector: str, vec_id: str) -> DataFrame:
    """(vec_id, v): rows whose vector is there and holds finite numbers only; it may be empty."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(fine, F.lit(False)))


def quantised(vectors: pa.Array, dim: int) -> np.ndarray:
    """x of each entry, as longs."""
    with np.errstate(over="ignore"):
        x = np.floor(matrix(vectors, dim) * SCALE)
    return np.clip(x, -LIMIT, LIMIT - 2 * OFFSET).astype(np.int64) + OFFSET


def _sums(dim: int):
    """Of each dimension: the sums of high and low bits of x, and the number of rows, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(dim, np.int64), np.zeros(dim, np.int64), 0
        for batch in batches:
            x = quantised(batch.column(0), dim)
            high, low, n = high + (x >> _HALF).sum(0), low + (x & ((1 << _HALF) - 1)).sum(0), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(high), pa.array(low), pa.array(np.full(dim, n))], names=["j", "high", "low", "n"])

    return run


def _scatter(dim: int, middle: np.ndarray):
    """Sums of products of x - middle, as blocks of the triangle, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = (quantised(batch.column(0), dim) - middle).astype(np.float64)
            total = y.T @ y + (0 if total is None else total)
        if total is not None:
            yield triangle_blocks(total)

    return run


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with a[order][:, order] = L L'; L has as many columns as a's rank to working precision."""
    a, n = a.copy(), len(a)
    order, low = np.arange(n), np.zeros((n, n))
    floor = n * np.finfo(float).eps * max(np.diag(a).max(initial=0.0), 0.0)
    for k in range(n):
        left = np.diag(a)[k:]
        p = k + int(left.argmax())
        if a[p, p] <= floor:
            return low[:, :k], order
        for rows in (a, low, order):
            rows[[k, p]] = rows[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        low[k, k] = np.sqrt(a[k, k])
        low[k + 1 :, k] = a[k + 1 :, k] / low[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(low[k + 1 :, k], low[k + 1 :, k])
    return low, order


def one_sided_jacobi(low: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """low times a product of plane rotations, with orthogonal columns, longest first.

    Each round of a sweep takes disjoint pairs of columns, by the circle method of tournaments; it ends when no pair turns.
    """
    cols = low.T.copy()
    r = len(cols)
    ring = list(range(r)) + [-1] * (r % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(max(1, len(ring) - 1)):
            pairs = [(a, b) for a, b in zip(ring[: len(ring) // 2], ring[len(ring) // 2 :][::-1]) if a >= 0 and b >= 0]
            ring = [ring[0], ring[-1], *ring[1:-1]] if len(ring) > 2 else ring
            if not pairs:
                continue
            i, j = np.array(pairs).T
            x, y = cols[i], cols[j]
            xx, yy, xy = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            on = np.abs(xy) > np.finfo(float).eps * np.sqrt(xx * yy)
            if not on.any():
                continue
            turned = True
            i, j, x, y = i[on], j[on], x[on], y[on]
            zeta = (yy[on] - xx[on]) / (2 * xy[on])
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            s = (c * t)[:, None]
            cols[i], cols[j] = c[:, None] * x - s * y, s * x + c[:, None] * y
        if not turned:
            break
    return cols[np.argsort(-(cols * cols).sum(1), kind="stable")].T


@dataclass(frozen=True)
class Whitening:
    """n: fitted rows; sums: exact sums of x; middle: rounded means; rest: mean less middle; values: eigenvalues, falling; vectors: unit
    columns; trace: of the covariance."""

    n: int
    sums: list[int]
    middle: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def dim(self) -> int:
        return len(self.sums)

    def transform(self, rows: DataFrame, components: int) -> DataFrame:
        """(vec_id, deviation, white) of (vec_id, v) rows: the squared distance to the mean times n, and the whitened components."""
        k = min(components, len(self.values))
        to_white, sums, n, dim, middle, rest = self.vectors[:, :k] / np.sqrt(self.values[:k]), np.array(self.sums, object), self.n, self.dim, self.middle, self.rest

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = quantised(batch.column(1), dim)
                off = x - middle
                most = float(np.abs(off).max(initial=0)) + 1
                if dim * (n * most) ** 2 < 2.0**62:
                    own = (n * off - (sums - n * middle.astype(object)).astype(np.int64)) ** 2
                    deviation = own.sum(1).tolist()
                else:
                    deviation = [d if d < 1 << 63 else None for d in ((n * off.astype(object) - (sums - n * middle.astype(object))) ** 2).sum(1).tolist()]
                white = (off - rest) @ to_white
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), pa.array(list(white), pa.list_(pa.float64()))], names=["vec_id", "deviation", "white"])

        return rows.mapInArrow(run, _WHITE)


def fit(rows: DataFrame) -> Whitening | None:
    """The whitening of all (vec_id, v) rows; None without rows or dimensions."""
    dim = rows.agg(F.max(F.size("v")).alias("d")).first()["d"]
    if not dim:
        return None
    own = rows.select("v")
    found = own.mapInArrow(_sums(dim), _SUMS).groupBy("j").agg(*[F.sum(c).alias(c) for c in ("high", "low", "n")]).orderBy("j").collect()
    n, sums = found[0]["n"], [(r["high"] << _HALF) + r["low"] for r in found]
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = np.array([(s - n * int(m)) / n for s, m in zip(sums, middle)])
    scatter = matrix_of(add_blocks(own.mapInArrow(_scatter(dim, middle), BLOCK), dim)) - n * np.outer(rest, rest)
    low, order = pivoted_cholesky(scatter / n)
    turned = one_sided_jacobi(low)
    norms = np.sqrt((turned * turned).sum(0))
    vectors = np.zeros_like(turned)
    vectors[order] = turned / norms
    return Whitening(n, sums, middle, rest, norms**2, vectors, float(np.trace(scatter) / n))


def whiten(df: DataFrame, components: int = 8, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and each of the first components."""
    spark, rows = df.sparkSession, finite(df, vector, vec_id)
    w = fit(rows)
    k = 0 if w is None else min(components, len(w.values))
    if not k:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    white = written(w.transform(rows, components), "whitened")
    at = [F.get("white", F.lit(i)) for i in range(k)]
    cov = [F.abs(F.covar_pop(at[i], at[j]) - (1.0 if i == j else 0.0)) for i in range(k) for j in range(i + 1)]
    error = white.agg(F.array_max(F.array(*cov)).alias("e")).first()["e"]
    share = F.array(*[F.lit(float(v / w.trace)) for v in w.values[:k]])
    own = white.select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened"))
    return own.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"))


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """All embeddings on their first eight components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
