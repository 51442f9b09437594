"""Sums of products over all voxels, in blocks of the triangle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks along each side of a matrix of sums: a task gives SIDES * (SIDES + 1) / 2 rows at most, however wide the data is.
SIDES = 8
#: Groups of tasks whose blocks are added up first; then the groups.
GROUPS = 64
#: Sizes of a matrix up to which its sums are added up one by one, in generated code.
NARROW = 64
#: One block of the upper triangle: rows from i, columns from j, so many columns, the sums row by row.
BLOCK = "i int, j int, cols int, v array<double>"


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    """A list column whose rows all have the same length, as a matrix."""
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def triangle_blocks(total: np.ndarray) -> pa.RecordBatch:
    """The upper triangle of a matrix in blocks; those on the diagonal are whole squares."""
    size = len(total)
    edges = np.unique(np.linspace(0, size, min(SIDES, size) + 1).astype(int)).tolist()
    at = [(a, b, c, d) for k, (a, b) in enumerate(zip(edges, edges[1:])) for c, d in list(zip(edges, edges[1:]))[k:]]
    i, j, cols = (pa.array(x, pa.int32()) for x in zip(*((a, c, d - c) for a, _, c, d in at)))
    return pa.RecordBatch.from_arrays([i, j, cols, pa.array([total[a:b, c:d].ravel() for a, b, c, d in at], pa.list_(pa.float64()))], names=["i", "j", "cols", "v"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of all rows of a group, as they come."""
    total, last = None, None
    for batch in batches:
        part = rows_of(batch.column("v"), len(batch.column("v")[0])).sum(0)
        total, last = part if total is None else total + part, batch
    if last is not None:
        yield pa.RecordBatch.from_arrays([*(last.column(c).slice(0, 1) for c in ("i", "j", "cols")), pa.array([total], pa.list_(pa.float64()))], names=["i", "j", "cols", "v"])


def _upper(blocks: DataFrame) -> DataFrame:
    """(i, j, value) of the upper triangle."""
    own = blocks.select("i", "j", "cols", F.posexplode("v").alias("at", "value"))
    return own.select((F.col("i") + F.floor(F.col("at") / F.col("cols"))).cast("int").alias("i"), (F.col("j") + F.col("at") % F.col("cols")).cast("int").alias("j"), "value").where("i <= j")


def add_blocks(parts: DataFrame, size: int = NARROW + 1, tasks: int = GROUPS + 1) -> DataFrame:
    """Blocks of tasks added up: those of a narrow matrix, of that size, entry by entry, as blocks of one entry; others in two levels, so that
    no task adds up those of all tasks, or in one, if it is known that so many tasks or fewer give any and these are at most GROUPS."""
    if size <= NARROW:
        return _upper(parts).groupBy("i", "j").agg(F.array(F.sum("value")).alias("v")).select("i", "j", F.lit(1).alias("cols"), "v")
    if tasks <= GROUPS:
        return parts.groupBy("i", "j").applyInArrow(_added, BLOCK)
    level = parts.withColumn("g", F.spark_partition_id() % GROUPS)
    once = level.groupBy("i", "j", "g").applyInArrow(_added, BLOCK)
    return once.groupBy("i", "j").applyInArrow(_added, BLOCK)


def gram_blocks(m: DataFrame, width: int, image: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(i, j, cols, v): sums over all rows of y_i y_j for y = image(x), and of y with one more entry, 1, as the last number.

    Every task gives its sums once, one BLAS product a batch, as blocks of the upper triangle; they are added up in two levels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = rows_of(batch.column(0), width)
            y = image(x) if image else x
            y = np.hstack([y, np.ones((len(y), 1))])
            total = y.T @ y + (0 if total is None else total)
        if total is not None:
            yield triangle_blocks(total)

    return add_blocks(m.select("x").mapInArrow(run, BLOCK), width + 1)


def tall_slices(total: np.ndarray) -> pa.RecordBatch:
    """A matrix of few columns in blocks of rows. Each counts as right of the diagonal, so it is taken whole."""
    edges = np.unique(np.linspace(0, len(total), min(SIDES, len(total)) + 1).astype(int)).tolist()
    n, cols = len(edges) - 1, total.shape[1]
    columns = [pa.array(edges[:-1], pa.int32()), pa.array([len(total)] * n, pa.int32()), pa.array([cols] * n, pa.int32())]
    return pa.RecordBatch.from_arrays([*columns, pa.array([total[a:b].ravel() for a, b in zip(edges, edges[1:])], pa.list_(pa.float64()))], names=["i", "j", "cols", "v"])


def tall_matrix(slices: DataFrame, rows: int, cols: int) -> np.ndarray:
    """Blocks of ``tall_slices`` as a matrix on the driver: features or components times a few columns."""
    out = np.zeros((rows, cols))
    for r in slices.collect():
        part = np.asarray(r["v"]).reshape(-1, cols)
        out[r["i"] : r["i"] + len(part)] = part
    return out


def cross_blocks(m: DataFrame, width: int, images: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Sums over all rows of y_i z_j for (y, z) = images(x), as ``tall_slices``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y, z = images(rows_of(batch.column(0), width))
            total = y.T @ z + (0 if total is None else total)
        if total is not None:
            yield tall_slices(total)

    return add_blocks(m.select("x").mapInArrow(run, BLOCK))


def both_triangles(upper: DataFrame) -> DataFrame:
    """(i, j, value) of both triangles from those of the upper one."""
    sides = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return upper.select(F.explode(sides).alias("s"), "value").select("s.i", "s.j", "value")


def entries(blocks: DataFrame) -> DataFrame:
    """(i, j, value) of both triangles from blocks."""
    return both_triangles(_upper(blocks))


def gram(m: DataFrame, width: int, image: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(i, j, value) of ``gram_blocks``."""
    return entries(gram_blocks(m, width, image))


def matrix_of(blocks: DataFrame) -> np.ndarray:
    """Blocks as a matrix on the driver; as wide as the features, not as the data."""
    rows = blocks.collect()
    size = max((r["j"] + r["cols"] for r in rows), default=0)
    out = np.zeros((size, size))
    for r in rows:
        part = np.asarray(r["v"]).reshape(-1, r["cols"])
        out[r["i"] : r["i"] + len(part), r["j"] : r["j"] + r["cols"]] = part
    upper = np.triu(out)
    return upper + np.triu(out, 1).T


def mean_spectrum(m: DataFrame, width: int) -> DataFrame:
    """(feature_idx, mean, n): mean count of each feature over the voxels, and their number."""
    sums = gram(m, width)
    n = sums.where((F.col("i") == width) & (F.col("j") == width)).select(F.col("value").alias("n"), F.lit(width).alias("j"))
    return sums.where((F.col("j") == width) & (F.col("i") < width)).join(n, "j").select(F.col("i").alias("feature_idx"), (F.col("value") / F.col("n")).alias("mean"), F.col("n").cast("long").alias("n"))


def second_moments(m: DataFrame, width: int) -> DataFrame:
    """(i, j, value): means of x_i x_j over the voxels, not centred."""
    sums = gram(m, width)
    n = sums.where((F.col("i") == width) & (F.col("j") == width)).select(F.col("value").alias("n"), F.lit(1).alias("one"))
    return sums.where((F.col("i") < width) & (F.col("j") < width)).withColumn("one", F.lit(1)).join(n, "one").select("i", "j", (F.col("value") / F.col("n")).alias("value"))
