"""Tables of a fitted model: loadings with names, score bounds, score histogram."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import component_score, loading_label
from .model import Model


def loadings_table(model: Model, ion_types: DataFrame) -> DataFrame:
    """(component, feature_idx, ion, loading, label). Raises ValueError if there are not as many names as features."""
    named = ion_types.select("feature_idx", "ion")
    if (n := named.count()) != len(model.mean):
        raise ValueError(f"{n} names for {len(model.mean)} features")
    rows = model.loading_rows(ion_types.sparkSession).join(named, "feature_idx")
    return rows.select("component", "feature_idx", "ion", "loading", loading_label(F.col("loading")).alias("label"))


def component_scores(scores: DataFrame, k: int) -> DataFrame:
    """(voxel_id, score) on component k; no rows if there is no such component."""
    return scores.select("voxel_id", component_score(F.col("scores"), k).alias("score")).where("score is not null")


def score_bounds(scores: DataFrame, k: int) -> DataFrame:
    """(component, min, max): one row, null without such a component."""
    own = component_score(F.col("scores"), k)
    return scores.agg(F.min(own).alias("min"), F.max(own).alias("max")).select(F.lit(k).alias("component"), "min", "max")


def score_histogram(df: DataFrame, col: str, bin_size: float = 0.01) -> DataFrame:
    """(bin, left_edge, n): counts in bins from the smallest value on, empty bins included.

    The largest value is in the last bin; equal values make one bin. Arithmetic is in the column's own type. Nulls, NaN and
    infinite values are not counted; without values there are no bins. Raises ValueError for more bins than an int can number.
    """
    kind = "float" if df.schema[col].dataType.simpleString() == "float" else "double"

    def ratio(span):
        """span over the bin size; Spark divides floats as doubles, and rounding that once more is the quotient of floats."""
        return (span / F.lit(bin_size).cast(kind)).cast(kind)

    own = df.select(F.col(col).cast(kind).alias("v")).where(F.abs("v") < float("inf"))
    low = own.agg(F.min("v").alias("low"), F.max("v").alias("high")).select("low", F.ceil(ratio(F.col("high") - F.col("low"))).alias("bins")).first()
    spark = df.sparkSession
    if low["low"] is None:
        return spark.createDataFrame([], "bin int, left_edge double, n long")
    last = max(1, math.ceil(low["bins"])) - 1
    if last >= 1 << 31:
        raise ValueError(f"{last + 1} bins")
    start = F.lit(low["low"]).cast(kind)
    at = F.least(ratio(F.col("v") - start).cast("long"), F.lit(last)).cast("int")
    counts = own.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    bins = spark.range(last + 1).select(F.col("id").cast("int").alias("bin"))
    edge = F.lit(low["low"]).cast("double") + F.col("bin") * F.lit(float(bin_size))
    return bins.join(counts, "bin", "left").select("bin", edge.alias("left_edge"), F.coalesce("n", F.lit(0)).alias("n"))
