"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_tasks, remove, scratch_path, stored


def connected_components(edges: DataFrame, rows: int | None = None, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node.

    edges: long columns u and v, in either order; repeated edges and loops do no harm. rows: a bound of their number, if known. Every round hangs each
    node's larger neighbours, then its smaller ones, on its smallest neighbour; rounds grow with the logarithm of the
    longest path. A node's neighbours are never gathered: both steps are a minimum by key and a join. The minima are
    written before they are joined, since Spark splits the partition of a hub only where both sides of a join come straight from a
    shuffle. A round's tables go when the next one's are written.
    """
    spark = edges.sparkSession

    def table(df: DataFrame, name: str, rows: int | None) -> tuple[DataFrame, str]:
        path = scratch_path(spark, f"cc-{name}")
        return stored(df if rows is None else few_tasks(df, rows), path), path

    e, path = table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", rows)
    state = _state(e)
    for _ in range(max_rounds):
        n = state[0]
        if not n:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low, path_low = table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low", 2 * n)
        large, path_large = table(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large", n)
        near, path_near = table(large.groupBy("u").agg(F.min("v").alias("m")), "near", n)
        # every node has one smaller neighbour, and that is a root: nothing moves any more
        if near.count() == n and _state(large) == state:
            for old in (path_low, path_large, path_near):
                remove(spark, old)
            break
        moved = large.join(near, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, new = table(near.select("u", F.col("m").alias("v")).union(moved).distinct(), "edges", 2 * n)
        for old in (path, path_low, path_large, path_near):
            remove(spark, old)
        path, state = new, _state(e)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(e: DataFrame) -> tuple:
    """Count and an order-free digest of an edge list."""
    row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["s"]


def join_roots(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The forest with the trees of i and j joined pairwise; every node points to its root."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return parent
        i, j = i[apart], j[apart]
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
