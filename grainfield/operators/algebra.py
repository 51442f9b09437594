"""The small matrices of a factor model: as wide as the features or the components, never as long as the data.

With X the counts of n voxels, mu their mean, C = X'X / n and D = diag(mu): the noise of a count is Poisson, so D is its
covariance, and factors come from C v = lambda D v. All that needs rows of X is in C and, for the rotation, in the
moments of order four of the scores.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Factors:
    """to_scores: features x components, so that scores are X @ to_scores; loadings: features x components."""

    to_scores: np.ndarray
    loadings: np.ndarray


def noise_eigen(mean: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in descending order and eigenvectors v with v' D v = 1 as columns.

    Features with mean 0 take no part: they have entries 0, and as many eigenvalues 0 stand at the end.
    """
    active = mean > 0
    root = np.sqrt(mean[active])
    values, z = np.linalg.eigh(c[np.ix_(active, active)] / np.outer(root, root))
    vectors = np.zeros((len(mean), len(mean)))
    vectors[np.flatnonzero(active), : len(root)] = z[:, ::-1] / root[:, None]
    return np.concatenate([values[::-1], np.zeros(len(mean) - len(root))]), vectors


def raw_factors(mean: np.ndarray, values: np.ndarray, vectors: np.ndarray, n: int, p: int) -> Factors:
    """The first p eigenvectors, and D times them. Raises ValueError where there are not p factors."""
    if p > min(len(mean), n) or p < 0:
        raise ValueError(f"{p} components of {len(mean)} features and {n} voxels")
    if p and values[p - 1] <= 1e-12 * values[0]:
        raise ValueError(f"{p} components, but the counts have a lower rank")
    return Factors(vectors[:, :p], mean[:, None] * vectors[:, :p])


def orthonormal_factors(raw: Factors, values: np.ndarray, n: int) -> Factors:
    """The same product of scores and loadings, with orthonormal scores and orthogonal loadings.

    Raw scores have T'T = n diag(values), so the decomposition of T P' follows from that of p x p matrices.
    """
    p = raw.loadings.shape[1]
    q, r = np.linalg.qr(raw.loadings)
    squares, w = np.linalg.eigh(n * (r * values[:p]) @ r.T)
    order = np.argsort(-squares)
    s, w = np.sqrt(squares[order]), w[:, order]
    return Factors(raw.to_scores @ r.T @ w / s, q @ w * s)


def pair_products(t: np.ndarray) -> np.ndarray:
    """Products of every two columns a <= b."""
    a, b = np.triu_indices(t.shape[1])
    return t[:, a] * t[:, b]


def fourth_moments(pairs: np.ndarray, p: int) -> np.ndarray:
    """Sums of t_i t_a t_b t_c as a p x p x p x p array from the Gram matrix of the pair products."""
    a, b = np.triu_indices(p)
    at = np.zeros((p, p), int)
    at[a, b] = at[b, a] = np.arange(len(a))
    return pairs[at[:, :, None, None], at[None, None]]


def rotation(cubes: Callable[[np.ndarray], np.ndarray], p: int, n: int, tol: float = 1e-8, max_iter: int = 500) -> tuple[np.ndarray, bool, int]:
    """Rotation that makes the columns of the scores simple, whether it settled, and the steps taken.

    cubes(r): sums over all rows of t_i (t r)_j ** 3. The columns of t are orthonormal over n rows, so a column's mean square is 1 / n in any
    rotation.
    """
    r, reached = np.eye(p), 0.0
    for step in range(1, max_iter + 1):
        left, s, right = np.linalg.svd(cubes(r) - r / n)
        r = left @ right
        if s.sum() <= reached * (1 + tol):
            return r, True, step
        reached = s.sum()
    return r, False, max_iter


def varimax(moments: np.ndarray, n: int, tol: float = 1e-8, max_iter: int = 500) -> tuple[np.ndarray, bool, int]:
    """``rotation`` from the moments of order four, p x p x p x p: no pass over rows a step."""
    return rotation(lambda r: np.einsum("iabc,aj,bj,cj->ij", moments, r, r, r, optimize=True), len(moments), n, tol, max_iter)


def orient(f: Factors) -> Factors:
    """Each component with the sign with which positive loadings hold more than half of its squared loading; as it is at exactly half."""
    squares = f.loadings**2
    sign = np.where(2 * (squares * (f.loadings > 0)).sum(0) < squares.sum(0), -1.0, 1.0)
    return Factors(f.to_scores * sign, f.loadings * sign)


def rotated(f: Factors, r: np.ndarray) -> Factors:
    return Factors(f.to_scores @ r, f.loadings @ r)
