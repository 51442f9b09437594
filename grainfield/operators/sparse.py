"""Voxels with few of many ion types: rows of (indices, counts) instead of one number a type."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import GridSpec
from .moments import BLOCK, add_blocks, triangle_blocks
from .voxels import located

#: Features up to which a task holds the sums of all pairs (as many doubles, squared); wider models take ``leading``, and sums ``pair_sums``.
MOST = 4096
#: Features of a voxel whose pairs are made in one step of ``pair_sums``; those of voxels with more are made in tiles, over all tasks.
TILE = 256
#: Products of pairs that one step makes.
_STEP = 1 << 21


def sparse_rows(counts: DataFrame) -> DataFrame:
    """(voxel_id, idx, n): feature numbers, ascending, and counts of each voxel, from (voxel_id, feature_idx, n).

    Rows of one voxel and feature are added up; zero and null counts are left out, and voxels without any other. A row is as long as its
    voxel has features.
    """
    own = counts.groupBy("voxel_id", "feature_idx").agg(F.sum(F.col("n").cast("double")).alias("n")).where("n <> 0")
    own = own.groupBy("voxel_id").agg(F.array_sort(F.collect_list(F.struct(F.col("feature_idx").cast("int").alias("i"), "n"))).alias("f"))
    return own.select("voxel_id", F.col("f.i").alias("idx"), F.col("f.n").alias("n"))


def sparse_voxelize(ions: DataFrame, ion_types: DataFrame, grid: GridSpec) -> DataFrame:
    """(voxel_id, idx, n) of ions inside the grid, of the types in (feature_idx, ion): a join, however many types there are.

    Ions are counted before they are joined, and types, which a model has on the driver too, go to all tasks: a shuffle of ions by their type
    would have as many tasks as there are types.
    """
    own = located(ions, grid, "strict").where("voxel_id is not null").groupBy("voxel_id", "ion").agg(F.count("*").alias("n"))
    return sparse_rows(own.join(F.broadcast(ion_types.select("feature_idx", "ion")), "ion"))


def dense_of(m: DataFrame, k: int) -> DataFrame:
    """(voxel_id, x) with arrays of k counts."""
    at = F.map_from_arrays("idx", "n")
    return m.select("voxel_id", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.try_element_at(at, i), F.lit(0.0))).alias("x"))


def entries_of(idx: pa.Array, n: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, counts and row number of all entries of a batch."""
    sizes = np.asarray(idx.value_lengths(), np.int64) if len(idx) else np.zeros(0, np.int64)
    return np.asarray(idx.flatten(), np.int64), np.asarray(n.flatten(), np.float64), np.repeat(np.arange(len(sizes)), sizes)


def times(idx: np.ndarray, n: np.ndarray, row: np.ndarray, rows: int, q: np.ndarray) -> np.ndarray:
    """The rows times a matrix, features x columns."""
    out = np.empty((rows, q.shape[1]))
    for c in range(q.shape[1]):
        out[:, c] = np.bincount(row, n * q[idx, c], rows)
    return out


def transposed_times(idx: np.ndarray, n: np.ndarray, row: np.ndarray, width: int, t: np.ndarray) -> np.ndarray:
    """The transposed rows times a matrix, rows x columns."""
    out = np.empty((width, t.shape[1]))
    for c in range(t.shape[1]):
        out[:, c] = np.bincount(idx, n * t[row, c], width)
    return out


def sparse_gram_blocks(m: DataFrame, width: int) -> DataFrame:
    """``gram_blocks`` of sparse rows: work and rows by the pairs of features that a voxel has, not by the square of the width.

    Raises ValueError for more than MOST features.
    """
    if width > MOST:
        raise ValueError(f"{width} features have too many pairs for one task; fit leading components")
    size = width + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            sizes = np.asarray(batch.column(0).value_lengths(), np.int64) if len(batch) else np.zeros(0, np.int64)
            idx, n, _ = entries_of(batch.column(0), batch.column(1))
            ends = np.cumsum(sizes)
            total = np.zeros(size * size) if total is None else total
            for length in np.unique(sizes).tolist():
                first = ends[sizes == length] - length
                a, b = np.triu_indices(length + 1)
                step = max(1, _STEP // len(a))
                for at in range(0, len(first), step):
                    place = first[at : at + step, None] + np.arange(length)
                    i = np.hstack([idx[place], np.full((len(place), 1), width)])
                    v = np.hstack([n[place], np.ones((len(place), 1))])
                    total += np.bincount((i[:, a] * size + i[:, b]).ravel(), (v[:, a] * v[:, b]).ravel(), size * size)
        if total is not None:
            upper = total.reshape(size, size)
            yield triangle_blocks(upper + np.triu(upper, 1).T)

    return add_blocks(m.select("idx", "n").mapInArrow(run, BLOCK), size)


def pair_sums(m: DataFrame, tile: int = TILE) -> DataFrame:
    """(i, j, value): sums over all voxels of n_i n_j for i <= j, of features that any voxel has both; for any number of features.

    Pairs are made from each row and added up by a shuffle after partial sums, so no task holds more than pairs that occur. A voxel of more
    than ``tile`` features is cut into tiles, dealt out over all tasks.
    """
    f = F.arrays_zip("idx", "n").alias("f")
    left = F.sequence(F.lit(0), F.floor((F.size("f") - 1) / tile).cast("int"))
    part = lambda at: F.slice("f", at * tile + 1, F.lit(tile))
    own = m.select("voxel_id", f)
    cut = own.where(F.size("f") > tile).select("voxel_id", F.transform(left, part).alias("parts"))
    tiles = cut.select("voxel_id", "parts", F.posexplode("parts").alias("a", "p"))
    tiles = tiles.select("voxel_id", "a", "p", F.posexplode(F.slice("parts", F.col("a") + 1, F.size("parts"))).alias("b", "q"))  # each with itself and those right of it
    tiles = tiles.repartition("voxel_id", "a", "b").select("p", "q")
    both = own.where(F.size("f") <= tile).select(F.col("f").alias("p"), F.col("f").alias("q")).union(tiles)
    pairs = both.select(F.explode("p").alias("p"), "q").select("p", F.explode("q").alias("q")).where("p.idx <= q.idx")
    return pairs.groupBy(F.col("p.idx").alias("i"), F.col("q.idx").alias("j")).agg(F.sum(F.col("p.n") * F.col("q.n")).alias("value"))


def project_sparse(m: DataFrame, to_scores: np.ndarray) -> DataFrame:
    """(voxel_id, scores) with scores = x @ to_scores."""
    p = to_scores.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = times(*entries_of(batch.column(1), batch.column(2)), len(batch), to_scores)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(t.ravel()), p).cast(pa.list_(pa.float64()))], names=["voxel_id", "scores"])

    return m.select("voxel_id", "idx", "n").mapInArrow(run, "voxel_id long, scores array<double>")
