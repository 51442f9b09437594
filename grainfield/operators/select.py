"""Selecting ions by the scores of their voxels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import GridSpec, score_at_least, voxel_id


def hit_voxels(scores: DataFrame, component: int, isovalue: float) -> DataFrame:
    """(voxel_id) of the scored voxels whose score on the component reaches the isovalue."""
    return scores.where(score_at_least(F.col("scores"), component, isovalue)).select("voxel_id")


def select_ions(ions: DataFrame, scores: DataFrame, grid: GridSpec, component: int = 0, isovalue: float = 1.0, invert: bool = False, bounds: str = "wrap") -> DataFrame:
    """The rows of ions (x, y, z and any others; a batch or a stream) in hit voxels or, inverted, all others.

    Ions of any type are selected. Without a voxel, in an empty voxel, or without such a component an ion is never hit.
    Hits are filtered before the join. Spark broadcasts them if it measures them to be small, and joins by shuffle,
    with skewed cells split, if not.
    """
    hits = hit_voxels(scores, component, isovalue).withColumnRenamed("voxel_id", "_sel_voxel")
    own = ions.withColumn("_sel_cell", voxel_id(F.col("x"), F.col("y"), F.col("z"), grid, bounds))
    return own.join(hits, F.col("_sel_cell") == F.col("_sel_voxel"), "left_anti" if invert else "left_semi").drop("_sel_cell")
