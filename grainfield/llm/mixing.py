"""Mixing sources to target weights with hash-threshold histograms.

Each document gets a hash. Tokens are summed by source and hash bucket; where the running sum of a source
passes its budget, only that boundary bucket is summed again by finer hash bits, three times. What comes out is one
threshold a source, and a document is taken if its hash is below it: a filter, without any sort. A larger budget
has a larger threshold, so the documents of a smaller budget are among those of a larger one.

Nulls and odd cases: a null source is a source of its own, ordered last. A null text has size 0, and like an
empty one is taken as often as its hash says, never above the most epochs. Rows with
equal id and text have equal hashes and are taken together. A source without words has target 0, and nothing is
taken of it. Empty tables give empty results. Other columns pass through; columns named ``_mix_*`` are
reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import word_count, written

#: Hash bits of one level, and levels.
BITS, LEVELS = 12, 3
#: Most bytes of sources' rows (keys and numbers) that are broadcast to the documents; with more of them the joins are by shuffle.
SMALL = 16 << 20


def doc_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of a digest of id and text as a long."""
    own = F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(own, 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """A text that is never null and differs for null and the empty text."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source.cast("string")))


def sized(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, _mix_source, _mix_key, _mix_size, _mix_hash) of each document."""
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("_mix_source"),
        source_key(F.col(source)).alias("_mix_key"),
        word_count(F.col(text)).alias("_mix_size"),
        doc_hash(F.col(doc_id), F.col(text)).alias("_mix_hash"),
    )


def cyclic_weights(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Adds _mix_weight: the weights in turn over the sources in code-point order, null last.

    One row a source, some 100 bytes, goes through one task here and in ``targets``, which sort them: good for some ten million
    sources. Documents never do.
    """
    w = W.orderBy(F.col("_mix_source").isNull(), F.col("_mix_source"))
    turn = (F.row_number().over(w) - 1) % len(weights)
    return sources.withColumn("_mix_weight", F.element_at(F.array(*[F.lit(x) for x in weights]), (turn + 1).cast("int")).cast("long"))


def targets(sources: DataFrame, budget_share: float, max_epochs: int) -> DataFrame:
    """Adds _mix_target to (_mix_source_size, _mix_weight) rows.

    All targets sum to budget_share of all sizes, in proportion to weights, but no target passes max_epochs
    times its source's size; what is cut off is shared again by weight. Sources in order of cap over weight:
    the first ones are capped, and all others get the same level times their weight.
    """
    cap = (F.lit(max_epochs) * F.col("_mix_source_size")).alias("_mix_cap")
    order = W.orderBy(F.col("_mix_cap") / F.col("_mix_weight"), "_mix_key")
    before, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    every = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        sources.select("*", cap)
        .withColumn("_mix_budget", F.lit(float(budget_share)) * F.sum("_mix_source_size").over(every))
        .withColumn("_mix_level", (F.col("_mix_budget") - F.coalesce(F.sum("_mix_cap").over(before), F.lit(0))) / F.sum("_mix_weight").over(rest))
        .withColumn("_mix_capped", F.col("_mix_level") * F.col("_mix_weight") >= F.col("_mix_cap"))
        # the level of the first source that is not capped holds for all after it
        .withColumn("_mix_level", F.min(F.when(~F.col("_mix_capped"), F.struct(F.col("_mix_cap") / F.col("_mix_weight"), F.col("_mix_level").alias("level")))).over(every)["level"])
        .withColumn("_mix_target", F.when(F.col("_mix_capped"), F.col("_mix_cap").cast("double")).otherwise(F.col("_mix_level") * F.col("_mix_weight")))
        .drop("_mix_cap", "_mix_budget", "_mix_level", "_mix_capped")
    )


def by_source(rows: DataFrame, sources: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """Joins a row a source to documents. Broadcast where the sources have been counted, so a hot source is in many tasks."""
    return rows.join(F.broadcast(sources) if small else sources, "_mix_key", how)


def thresholds(sizes: DataFrame, goals: DataFrame, small: bool = False) -> DataFrame:
    """goals plus _mix_base (times that the whole source is taken) and _mix_cut (exclusive bound of the hash prefix for one more time).

    sizes: (_mix_key, _mix_size, _mix_hash). goals: (_mix_key, _mix_source_size, _mix_target). A level reads
    the documents of the boundary buckets only; a window has at most 2**BITS rows of a source.
    """
    base = F.when(F.col("_mix_source_size") > 0, F.floor(F.col("_mix_target") / F.col("_mix_source_size"))).otherwise(0)
    goals = goals.withColumn("_mix_base", base.cast("long")).withColumn("_mix_need", F.col("_mix_target") - F.col("_mix_base") * F.col("_mix_source_size"))
    at = goals.select("_mix_key", "_mix_need", F.lit(0).cast("long").alias("_mix_prefix"))
    for level in range(1, LEVELS + 1):
        prefix = F.shiftright("_mix_hash", 60 - BITS * level)
        inside = sizes.where("_mix_size > 0").withColumn("_mix_cell", prefix)
        inside = by_source(inside, at, small)
        if level > 1:
            inside = inside.where(F.shiftright("_mix_cell", BITS) == F.col("_mix_prefix"))
        cells = inside.groupBy("_mix_key", "_mix_cell").agg(F.sum("_mix_size").alias("_mix_tokens"), F.first("_mix_need").alias("_mix_need"))
        running = W.partitionBy("_mix_key").orderBy("_mix_cell")
        cells = cells.withColumn("_mix_sum", F.sum("_mix_tokens").over(running)).where("_mix_sum > _mix_need")
        first = F.min(F.struct("_mix_cell", "_mix_sum", "_mix_tokens", "_mix_need")).alias("b")
        found = cells.groupBy("_mix_key").agg(first).select("_mix_key", "b.*")
        left = F.col("_mix_need") - (F.col("_mix_sum") - F.col("_mix_tokens"))
        at = found.select("_mix_key", left.alias("_mix_need"), F.col("_mix_cell").alias("_mix_prefix"), F.col("_mix_tokens").alias("_mix_last"))
    # the last cell counts as a whole: in, if that comes nearer to the target
    cut = F.col("_mix_prefix") + F.when(F.col("_mix_last") < 2 * F.col("_mix_need"), 1).otherwise(0)
    return goals.drop("_mix_need").join(at.select("_mix_key", cut.alias("_mix_cut")), "_mix_key", "left")


def plan(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget_share: float = 1.5, max_epochs: int = 2) -> tuple[DataFrame, bool]:
    """One row a source: key, size, target, base and cut; and whether they are SMALL. sizes: the rows of ``sized``, as a written table."""
    sources = sizes.groupBy("_mix_key").agg(F.first("_mix_source").alias("_mix_source"), F.sum("_mix_size").alias("_mix_source_size"))
    goals = targets(cyclic_weights(sources, weights), budget_share, max_epochs)
    goals = written(goals.select("_mix_key", "_mix_source_size", "_mix_target"), "mix-goals")
    small = (goals.agg(F.sum(F.octet_length("_mix_key") + 64).alias("n")).first()["n"] or 0) <= SMALL
    return written(thresholds(sizes, goals, small), "mix-plan"), small


def copies() -> Column:
    """How often a document is taken; needs _mix_hash and the columns of ``plan``."""
    below = F.shiftright("_mix_hash", 60 - BITS * LEVELS) < F.coalesce(F.col("_mix_cut"), F.lit(0))
    # a source whose need is a whole number of times its size, or nothing, has no document more
    more = below & (F.col("_mix_target") > F.col("_mix_base") * F.col("_mix_source_size"))
    return (F.col("_mix_base") + F.coalesce(more, F.lit(False)).cast("long")).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget_share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """The mixed documents: each row of docs as often as it is taken (0 to max_epochs times), with its own columns."""
    own, small = plan(written(sized(docs), "mix-sizes"), weights, budget_share, max_epochs)
    keyed = docs.select("*", source_key(F.col("source")).alias("_mix_key"), doc_hash(F.col("doc_id"), F.col("text")).alias("_mix_hash"))
    taken = by_source(keyed, own.select("_mix_key", "_mix_base", "_mix_cut", "_mix_target", "_mix_source_size"), small).withColumn("_mix_copies", copies()).where("_mix_copies > 0")
    return taken.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """Size, source size, target and words taken of every document."""
    sizes = written(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")), "mix-sizes")
    own, small = plan(sizes)
    return by_source(sizes, own, small).select(
        "doc_id",
        F.col("_mix_size").alias("size"),
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"),
        (F.col("_mix_size") * copies()).alias("taken"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT k, source, sum(size)::BIGINT AS source_size FROM d GROUP BY k, source),
r AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::BIGINT AS w, 2 * source_size AS cap FROM s),
l AS (SELECT *, ((SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
             / (sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM r),
g AS (SELECT *, CASE WHEN level * w >= cap THEN cap::DOUBLE ELSE (SELECT arg_min(level, cap / w) FROM l WHERE level * w < cap) * w END AS target FROM l),
t AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS base FROM g),
c AS (SELECT d.k, h >> 24 AS cell, sum(size) AS tokens, any_value(target - base * source_size) AS need FROM d JOIN t USING (k) WHERE size > 0 GROUP BY ALL),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY k ORDER BY cell) AS upto FROM c),
b AS (SELECT k, min(cell) AS cell, arg_min(tokens, cell) AS tokens, arg_min(upto, cell) AS upto, any_value(need) AS need FROM u WHERE upto > need GROUP BY k)
SELECT doc_id, size, source_size, target,
       size * (base + CASE WHEN h >> 24 < coalesce(b.cell + CASE WHEN b.tokens < 2 * (b.need - (b.upto - b.tokens)) THEN 1 ELSE 0 END, 0) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM d JOIN t USING (k) LEFT JOIN b USING (k)
"""
