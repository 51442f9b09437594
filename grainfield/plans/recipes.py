"""Tables of the driver as ions: lineitem on a grid, and events by user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import GridSpec

GRID = GridSpec(min=(0.5, -0.005, -0.005), size=(5.0, 0.02, 0.02), bins=(10, 6, 5))
ISOVALUE = 60.0

# fixed values: ion types of the recipes; the same text is Spark SQL and DuckDB SQL
PHASE2 = "CASE WHEN l_quantity > 30 AND l_discount > 0.045 THEN CASE WHEN l_linenumber <= 5 THEN 'B' ELSE 'A' END ELSE CASE WHEN l_linenumber <= 6 THEN 'A' ELSE 'B' END END"
PHASE3 = (
    "CASE WHEN l_quantity > 30 AND l_discount > 0.045 THEN CASE WHEN l_linenumber <= 5 THEN 'B' WHEN l_linenumber = 6 THEN 'C' ELSE 'A' END "
    "WHEN l_quantity <= 15 THEN CASE WHEN l_linenumber <= 4 THEN 'C' WHEN l_linenumber <= 6 THEN 'A' ELSE 'B' END "
    "ELSE CASE WHEN l_linenumber <= 5 THEN 'A' WHEN l_linenumber = 6 THEN 'B' ELSE 'C' END END"
)
NAMES = {"phase2": ["A", "B"], "phase3": ["A", "B", "C"], "plain7": [f"t{i}" for i in range(1, 8)]}
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def ion(recipe: str) -> Column:
    """Ion type of a lineitem row."""
    return F.concat(F.lit("t"), F.col("l_linenumber").cast("string")) if recipe == "plain7" else F.expr({"phase2": PHASE2, "phase3": PHASE3}[recipe])


def as_ions(lineitem: DataFrame, recipe: str) -> DataFrame:
    """(l_orderkey, l_linenumber, x, y, z, ion); a batch or a stream."""
    place = [F.col(c).cast("float").alias(n) for c, n in (("l_quantity", "x"), ("l_discount", "y"), ("l_tax", "z"))]
    return lineitem.select("l_orderkey", "l_linenumber", *place, ion(recipe).alias("ion"))


def lineitem_ions(spark: SparkSession, sf_dir: str, recipe: str) -> DataFrame:
    return as_ions(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), recipe)


def ion_types(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), "feature_idx int, ion string")


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(voxel_id, feature_idx, n): events of each user (as voxel) by type (as feature)."""
    idx = F.array_position(F.array(*[F.lit(x) for x in EVENT_TYPES]), F.col("event_type")).cast("int") - 1
    own = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("long").alias("voxel_id"), idx.alias("feature_idx"))
    return own.where("feature_idx >= 0").groupBy("voxel_id", "feature_idx").agg(F.count("*").cast("double").alias("n"))
