"""Counting ions on the grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import GridSpec, voxel_id

#: Ion types up to which one aggregate makes dense rows; with more, counts are made in long form first.
WIDE = 64


def located(ions: DataFrame, grid: GridSpec, bounds: str = "wrap") -> DataFrame:
    """ions with voxel_id."""
    return ions.withColumn("voxel_id", voxel_id(F.col("x"), F.col("y"), F.col("z"), grid, bounds))


def voxel_counts(ions: DataFrame, names: list[str], grid: GridSpec) -> DataFrame:
    """(voxel_id, feature_idx, n): ions inside the grid, of listed types, by cell and type."""
    idx = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("ion")).cast("int") - 1
    own = located(ions, grid, "strict").select("voxel_id", idx.alias("feature_idx")).where("voxel_id is not null and feature_idx >= 0")
    return own.groupBy("voxel_id", "feature_idx").agg(F.count("*").cast("double").alias("n"))


def dense_rows(counts: DataFrame, k: int) -> DataFrame:
    """(voxel_id, x): one array of k counts a voxel, from (voxel_id, feature_idx, n); missing and null counts are 0."""
    if k <= WIDE:
        cells = [F.sum(F.when(F.col("feature_idx") == i, F.col("n"))) for i in range(k)]
        return counts.groupBy("voxel_id").agg(F.array(*[F.coalesce(c, F.lit(0.0)).cast("double") for c in cells]).alias("x"))
    own = counts.groupBy("voxel_id").agg(F.map_from_entries(F.collect_list(F.struct("feature_idx", "n"))).alias("m"))
    return own.select("voxel_id", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("x"))


def voxelize(ions: DataFrame, names: list[str], grid: GridSpec) -> DataFrame:
    """(voxel_id, x): counts of each listed ion type in every cell that has any.

    One shuffle on voxel_id after partial counts, so a dense cell is one row of each task. Ions outside the grid and of other
    types are not counted.
    """
    if len(names) > WIDE:
        return dense_rows(voxel_counts(ions, names, grid), len(names))
    own = located(ions, grid, "strict").where(F.col("voxel_id").isNotNull() & F.col("ion").isin(names))
    return own.groupBy("voxel_id").agg(F.array(*[F.count_if(F.col("ion") == x).cast("double") for x in names]).alias("x"))


def nonempty_voxels(m: DataFrame) -> DataFrame:
    """Rows with any value that is not 0."""
    return m.where(F.exists("x", lambda v: v != 0))


def ion_type_counts(ions: DataFrame, ion_types: DataFrame) -> DataFrame:
    """(feature_idx, ion, n, total): ions of each listed type, 0 included, and of all listed types."""
    counts = ions.groupBy("ion").agg(F.count("*").alias("n"))
    own = ion_types.join(counts, "ion", "left").select("feature_idx", "ion", F.coalesce("n", F.lit(0)).alias("n"))
    total = own.agg(F.sum("n").alias("total")).withColumn("_one", F.lit(1))  # one row
    return own.withColumn("_one", F.lit(1)).join(total, "_one").drop("_one")
