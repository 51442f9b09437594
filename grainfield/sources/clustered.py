"""Ions laid out by where they are, so that a selection reads the files of hit cells only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import GridSpec, component_score, voxel_id
from ..operators.select import hit_voxels
from .log import Log, store_rows, stored_rows

#: Blocks of a layout at most; each is a folder, and hit blocks are sent to all tasks.
MOST = 1 << 16
#: Block of cells that are outside the grid.
OUTSIDE = -1


def block_of(cell: Column, grid: GridSpec, side: tuple[int, int, int]) -> Column:
    """Number of the block of side cells along each axis that a cell id belongs to; OUTSIDE for ids outside the grid, null for null.

    It depends on the id alone: positions that alias to one cell share its block, and so does the scored voxel of that id.
    """
    nx, ny, nz = grid.bins
    bx, by, _ = (-(-n // s) for n, s in zip(grid.bins, side, strict=True))
    x, y, z = cell % nx, F.floor(cell / nx) % ny, F.floor(cell / (nx * ny))
    along = [F.floor(a / s) for a, s in zip((x, y, z), side, strict=True)]
    block = (along[0] + along[1] * bx + along[2] * (bx * by)).cast("int")
    return F.when(cell.isNull(), F.lit(None)).when((cell < 0) | (cell >= nx * ny * nz), OUTSIDE).otherwise(block)


class ClusteredIons:
    """A table of ions in one folder for each block of cells, and the grid that it was laid out for."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        record = Log(spark, f"{self.path}/_layout").get(0)
        if record is None:
            raise ValueError(f"no layout in {path}")
        self.grid = GridSpec(*(tuple(x) for x in record["grid"]))
        self.side, self.bounds, self.kept = tuple(record["side"]), record["bounds"], record["rows"]

    @staticmethod
    def write(ions: DataFrame, path: str, grid: GridSpec, side: tuple[int, int, int], bounds: str = "wrap") -> ClusteredIons:
        """Lays ions (x, y, z and any others but ``block`` and ``cell``) out at a new path, in blocks of side cells along each axis.

        Rows are rebalanced by block: small blocks share a task, and a crowded one is split over several, each of which writes a file. Raises
        ValueError for more than MOST blocks or columns of those names.
        """
        path = path.rstrip("/")
        blocks = 1
        for n, s in zip(grid.bins, side, strict=True):
            if s < 1:
                raise ValueError(f"a block has at least one cell along each axis, not {s}")
            blocks *= -(-n // s)
        if blocks > MOST:
            raise ValueError(f"{blocks} blocks; take larger ones")
        if taken := {"block", "cell"} & set(ions.columns):
            raise ValueError(f"ions have columns {sorted(taken)}")
        own = ions.withColumn("cell", voxel_id(F.col("x"), F.col("y"), F.col("z"), grid, bounds))
        own = own.withColumn("block", block_of(F.col("cell"), grid, side)).hint("rebalance", "block").sortWithinPartitions("block", "cell")
        own.write.partitionBy("block").parquet(f"{path}/data")
        kept = {"path": f"{path}/data", "schema": own.schema.json()}
        Log(ions.sparkSession, f"{path}/_layout").add(0, {"grid": [grid.min, grid.size, grid.bins], "side": side, "bounds": bounds, "rows": kept})
        return ClusteredIons(ions.sparkSession, path)

    def table(self) -> DataFrame:
        """All columns with cell and block."""
        return stored_rows(self.spark, [self.kept])

    def read(self) -> DataFrame:
        """The ions as they were given."""
        return self.table().drop("cell", "block")

    def select(self, scores: DataFrame, component: int = 0, isovalue: float = 1.0, invert: bool = False) -> DataFrame:
        """The rows of ``select_ions`` with the layout's grid and bounds.

        Hit blocks, of which there are at most as many as the layout has, are broadcast; the scan takes them as a dynamic filter of its folders, and
        cells are compared in what is left. An inverted selection reads every block, but only rows of hit blocks are compared. Scores are computed
        once, now, and stored beside the data: they are used twice, Spark then knows their size, and blocks and cells are no filters of the rows
        that scores are made from, where they would be worked out for each ion.
        """
        own = scores.select("voxel_id", F.array(component_score(F.col("scores"), component)).alias("scores"))
        kept = stored_rows(self.spark, [store_rows(own, f"{self.path}/scores-{uuid.uuid4().hex}")])
        hits = hit_voxels(kept, 0, isovalue).select(F.col("voxel_id").alias("_hit_cell"), block_of(F.col("voxel_id"), self.grid, self.side).alias("_hit_block"))
        blocks = F.broadcast(hits.select("_hit_block").distinct())
        own = self.table()
        if invert:
            marked = own.join(blocks, F.col("block") == F.col("_hit_block"), "left")
            out = marked.join(hits.select("_hit_cell"), F.col("_hit_block").isNotNull() & (F.col("cell") == F.col("_hit_cell")), "left_anti")
        else:
            near = own.join(blocks, F.col("block") == F.col("_hit_block"), "left_semi")
            out = near.join(hits, (F.col("cell") == F.col("_hit_cell")) & (F.col("block") == F.col("_hit_block")), "left_semi")
        return out.select(*[F.col(f"`{c}`") for c in own.columns if c not in ("cell", "block")])
