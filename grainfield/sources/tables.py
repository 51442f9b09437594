"""Reading ions, ion types and dense grids; writing results; numbering ions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.durable import durable

IONS = "ion_id long, x float, y float, z float, ion string"
ION_TYPES = "feature_idx int, ion string"


def read_ions(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The ion table, as a batch or, by files as they come, as a stream."""
    return (spark.readStream if stream else spark.read).schema(IONS).parquet(path)


def read_ion_types(spark: SparkSession, path: str) -> DataFrame:
    """The ordered feature table."""
    return spark.read.schema(ION_TYPES).parquet(path)


def type_names(ion_types: DataFrame, most: int = 1000) -> list[str]:
    """Names in feature order; at most ``most``, which bounds the model's width. Raises ValueError for gaps or repeats in the numbers."""
    rows = ion_types.orderBy("feature_idx").limit(most + 1).collect()
    if [r["feature_idx"] for r in rows] != list(range(len(rows))) or len(rows) > most:
        raise ValueError(f"feature numbers must run from 0 without gaps, and be at most {most}")
    return [r["ion"] for r in rows]


def explode_grid(grid_dense: DataFrame) -> DataFrame:
    """(voxel_id, feature_idx, n) of the cells that are not zero; the place in ``counts`` is the cell id. Null counts are zero.

    A grid cut into several rows a feature has the id of each row's first cell in ``first_cell``.
    """
    first = F.col("first_cell") if "first_cell" in grid_dense.columns else F.lit(0)
    cells = grid_dense.select("feature_idx", first.cast("long").alias("first_cell"), F.posexplode("counts").alias("place", "n"))
    return cells.where("n <> 0").select((F.col("first_cell") + F.col("place")).alias("voxel_id"), F.col("feature_idx").cast("int").alias("feature_idx"), F.col("n").cast("double").alias("n"))


def write_results(path: str, **tables: DataFrame) -> None:
    """Each table (eigenvalues, loadings, scores, selected) as Parquet in its folder below path."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def assign_ion_id(df: DataFrame, order_cols: list[str], name: str = "ion_id") -> DataFrame:
    """df with numbers from 0 in the order of order_cols.

    A range sort, the row count of each partition, and an offset added: no window over all rows. The sorted rows
    are checkpointed, since sampling for the range sort may cut differently when it runs again.
    """
    mid = "_id_place"
    placed = durable(df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols).withColumn(mid, F.monotonically_increasing_id()))
    part = F.shiftright(mid, 33)
    counts = placed.groupBy(part.alias("_id_part")).agg(F.count("*").alias("_id_n"))
    before = W.orderBy("_id_part").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    offsets = counts.select("_id_part", F.coalesce(F.sum("_id_n").over(before), F.lit(0)).alias("_id_before"))
    own = placed.withColumn("_id_part", part).join(offsets, "_id_part")
    return own.withColumn(name, F.col("_id_before") + F.col(mid).bitwiseAND((1 << 33) - 1)).drop("_id_part", "_id_before", mid)
