"""Cell arithmetic on a regular 3-D grid and predicates on scores, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridSpec:
    """A regular grid: lower corner, cell size and number of cells along x, y and z. x runs fastest in cell ids."""

    min: tuple[float, float, float]
    size: tuple[float, float, float]
    bins: tuple[int, int, int]

    def __post_init__(self):
        if any(s <= 0 for s in self.size) or any(b < 1 for b in self.bins):
            raise ValueError(f"sizes must be positive and bins at least 1, not {self.size} and {self.bins}")


def voxel_id(x: Column, y: Column, z: Column, grid: GridSpec, bounds: str = "wrap") -> Column:
    """Cell of a position, computed in 32-bit floats and truncated toward zero.

    bounds: "wrap" checks nothing, so a position past one axis lands in the next row of cells; "strict" gives null outside
    the grid. Null, NaN and positions too far for an integer give null.
    """
    if bounds not in ("wrap", "strict"):
        raise ValueError(f"bounds is wrap or strict, not {bounds}")
    cell, inside, step = None, F.lit(True), 1
    for pos, low, size, bins in zip((x, y, z), grid.min, grid.size, grid.bins, strict=True):
        inverse = np.float32(1) / np.float32(size)
        place = pos.cast("float") * F.lit(float(inverse)).cast("float") + F.lit(float(-np.float32(low) * inverse)).cast("float")
        along = place.try_cast("int").cast("long") * step
        cell = along if cell is None else cell + along
        inside = inside & (place >= 0) & (place < bins)
        step *= bins
    return cell if bounds == "wrap" else F.when(inside, cell)


def component_score(scores: Column, k: int) -> Column:
    """Score on component k, counted from 0; null if there is no such component."""
    if k < 0:
        raise ValueError(f"a component is at least 0, not {k}")
    return F.get(scores, F.lit(k))


def score_at_least(scores: Column, k: int, isovalue: float = 1.0) -> Column:
    """Whether the score on component k reaches the isovalue; null without that component."""
    return component_score(scores, k) >= F.lit(float(isovalue))


def loading_label(loading: Column) -> Column:
    """A loading with three decimals."""
    return F.format_string("%.3f", loading)
