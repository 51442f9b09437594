"""The leading factors of wide models, without a matrix of all features.

With A = D^-1/2 C D^-1/2 as in ``algebra``, A Q = D^-1/2 X'(X D^-1/2 Q) / n for any few columns Q: a pass over the rows gives as many numbers as
features times columns. Products of one block after another, each made orthogonal to all before it, span a Krylov space; the eigenvectors of A
within it (Rayleigh-Ritz) are the leading ones once their residuals are small. When the space is full, it begins anew from its best
vectors (thick restart).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .moments import BLOCK, add_blocks, tall_matrix, tall_slices
from .sparse import entries_of, times, transposed_times


def _gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of that many entries or more, so that what a batch costs besides them, a number a feature, is not paid for a few."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column(0).flatten())
        if size >= least:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _summed(m: DataFrame, width: int, cols: int, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of part(batch), width x cols, over batches of all rows' (idx, n).

    A task's sums are as wide as the model, so there are as many tasks as cores (which read what is kept where it is), not as the data has parts:
    what is shuffled grows with the features alone.
    """
    tasks = m.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in _gathered(batches, width):
            own = part(batch)
            total = own if total is None else np.add(total, own, out=total)
        if total is not None:
            yield tall_slices(total)

    return tall_matrix(add_blocks(m.select("idx", "n").coalesce(tasks).mapInArrow(run, BLOCK), tasks=tasks), width, cols)


def feature_sums(m: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """Mean of each feature and number of rows, from (idx, n) rows."""

    def part(batch: pa.RecordBatch) -> np.ndarray:
        idx, n, _ = entries_of(batch.column(0), batch.column(1))
        return np.append(np.bincount(idx, n, width), len(batch))[:, None]

    sums = _summed(m, width + 1, 1, part)[:, 0]
    n = int(sums[-1])
    return sums[:-1] / max(n, 1), n


def product(m: DataFrame, width: int, q: np.ndarray) -> np.ndarray:
    """X'(X q) over all rows."""
    shared = m.sparkSession.sparkContext.broadcast(q)  # features times a few columns

    def part(batch: pa.RecordBatch) -> np.ndarray:
        idx, n, row = entries_of(batch.column(0), batch.column(1))
        return transposed_times(idx, n, row, width, times(idx, n, row, len(batch), shared.value))

    try:
        return _summed(m, width, q.shape[1], part)
    finally:
        shared.unpersist()


def leading_eigen(m: DataFrame, width: int, components: int, extra: int = 8, tol: float = 1e-8, passes: int = 60, space: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, bool]:
    """Mean, the largest eigenvalues, eigenvectors v with v'Dv = 1 as columns, number of rows, and whether residuals came below tol.

    m: (voxel_id, idx, n), read once a pass; keep it. extra: columns of a block beyond the components; space: blocks held at once.
    """
    mean, n = feature_sums(m, width)
    active = np.flatnonzero(mean > 0)
    if not components or components > min(len(active), n):
        return mean, np.zeros(0), np.zeros((width, 0)), n, True
    root = np.sqrt(mean[active])
    many = min(components + extra, len(active))

    def apply(q: np.ndarray) -> np.ndarray:
        wide = np.zeros((width, q.shape[1]))
        wide[active] = q / root[:, None]
        return product(m, width, wide)[active] / root[:, None] / n

    def fresh(q: np.ndarray, basis: np.ndarray) -> np.ndarray:
        """What of q is new to the basis, orthonormal."""
        norm = np.linalg.norm(q, axis=0).max(initial=0)
        for _ in range(2):
            q = q - basis @ (basis.T @ q)
        left, s, _ = np.linalg.svd(q, full_matrices=False)
        return left[:, s > 1e-12 * max(norm, 1e-300)]

    basis = images = np.zeros((len(active), 0))
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(len(active), many)))[0]
    converged = False
    for _ in range(passes):
        basis, images = np.hstack([basis, q]), np.hstack([images, apply(q)])
        h = basis.T @ images
        values, s = np.linalg.eigh((h + h.T) / 2)
        values, s = values[::-1][:many], s[:, ::-1][:, :many]
        vectors, turned = basis @ s, images @ s
        rest = turned - vectors * values
        if (np.linalg.norm(rest[:, :components], axis=0) <= tol * values[0]).all():
            converged = True
            break
        if basis.shape[1] + many > space * many:
            basis, images = vectors, turned
        q = fresh(rest, basis)
        if not q.shape[1]:
            converged = True  # the space is closed: these are eigenvectors
            break
    out = np.zeros((width, components))
    out[active] = vectors[:, :components] / root[:, None]
    return mean, values[:components], out, n, converged
