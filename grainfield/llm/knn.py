"""Exact top-k by inner product over a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance r from it; the distances of a pivot are cut into annuli.
A cell (pivot, annulus) knows its least and largest r and its largest norm. For a query q and a cell of pivot p

    q.v <= q.p + |q| r_max                                           (Cauchy-Schwarz for v - p)
    q.v <= (|q|^2 + n_max^2 - gap^2) / 2, gap = distance of |q - p| from [r_min, r_max]   (triangle inequality)
    q.v <= |q| n_max

A query takes the cells in the order of their bounds, in rounds: first as many as hold ``FIRST`` rows for every answer, then ``GROWTH``
times as many each round. After a round its k-th score so far is its floor, and it stops as soon as the bound of its next cell is below
that. Results are exact. In a round the queries travel to the blocks of the cells that they need, a few bytes a component; a
block is sent once a round, however many queries ask for it, and a query that has stopped costs nothing.

Only the pivots come from a bounded sample (``SAMPLE`` rows chosen by hash); every row is in the index. Cells number
at most ``PIVOTS`` * ``ANNULI``, so their bounds fit on the driver and in every task, whatever the number of rows; a
cell's rows are split into blocks of about ``BLOCK``. What the bounds rule out depends on the vectors: ``Index.looked`` counts the
pairs of a query and a row that were scored.

Nulls and odd cases: rows with a null id, and vectors that are null, empty or hold null or non-finite components take no
part. Missing last components of shorter vectors count as 0. Rows that share a query's id count as the query itself; a
query id that repeats is asked once, with its smallest vector. Equal candidates are ordered by id. Scores beyond
64 bits are cut to the ends of that range. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written
from .vectors import matrix, usable

SAMPLE, PIVOTS, ANNULI, BLOCK, QUERIES = 4096, 512, 16, 2048, 128
#: Rows that a query's first round looks at for each answer, and how many times as many the next round reaches.
FIRST, GROWTH = 4, 16


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) in doubles (whole numbers; beyond 2**53 as exact as doubles are)."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(scale * x))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors as int64, cut to its range."""
    top = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if top < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(v) for v in row] for row in a], object).reshape(a.shape) @ np.array([[int(v) for v in row] for row in b], object).reshape(b.shape).T
    return np.array([[max(-(2**63), min(2**63 - 1, int(v))) for v in row] for row in exact], np.int64).reshape(len(a), len(b))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows, each the farthest from those before it."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    picked = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(picked) < n and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[picked[-1]]) ** 2).sum(1))
    return sample[picked]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * x @ pivots.T))


class Cells:
    """Bounds of all cells and the blocks of each; rows: cell, pivot, n, low, high, norm."""

    def __init__(self, rows: list, pivots: np.ndarray):
        self.pivots = pivots
        self.cell, self.pivot, self.n = (np.array([r[c] for r in rows], np.int64) for c in ("cell", "pivot", "n"))
        self.chunks = -(-self.n // BLOCK)
        self.low, self.high, self.norm = (np.array([r[c] for r in rows], np.float64) for c in ("low", "high", "norm"))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """No score of a query with a member of a cell is above this; one row a query, one column a cell."""
        length, far = np.sqrt((q**2).sum(1))[:, None], _distances(q, self.pivots)[:, self.pivot]
        gap = np.maximum(0, np.maximum(far - self.high, self.low - far))
        # what rounding can add to a distance, in terms of its square
        slack = 1e-9 * (1 + length**2 + self.norm**2) + 1e-6 * (length + self.norm)
        ball = (q @ self.pivots.T)[:, self.pivot] + length * self.high
        return np.minimum(np.minimum(ball, (length**2 + self.norm**2 - gap**2) / 2), length * self.norm) + slack


class Index:
    """The written index. rows: (vec_id, vector, pivot, r, norm, cell); blocks: packed cells; cells: their bounds."""

    def __init__(self, vectors: DataFrame, scale: float = 64.0):
        own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
        own = own.where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
        size = own.agg(F.max(F.size("vector")).alias("dim"), F.count("*").alias("n")).first()
        self.dim, self.n = size["dim"] or 1, size["n"]
        self.looked = own.sparkSession.sparkContext.accumulator(0)
        sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
        pivots = choose_pivots(whole(matrix(sample.column("vector"), self.dim), scale), int(min(PIVOTS, max(8, self.n**0.5))))
        annuli = int(min(ANNULI, max(1, self.n // (64 * len(pivots)))))
        dim = self.dim

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = whole(matrix(batch.column(1), dim), scale)
                d = _distances(x, pivots)
                at = d.argmin(1) if len(x) else np.zeros(0, np.int64)
                vector = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dim).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), vector, pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(x)), at]), pa.array(np.sqrt((x**2).sum(1)))], names=["vec_id", "vector", "pivot", "r", "norm"])

        keyed = written(own.mapInArrow(key, "vec_id long, vector array<double>, pivot int, r double, norm double"), "knn-keyed")
        # one row a pivot, then one a cell: never more than PIVOTS and PIVOTS * ANNULI rows are broadcast
        cuts = keyed.groupBy("pivot").agg(F.percentile_approx("r", [i / annuli for i in range(1, annuli)] or [0.5]).alias("cuts"))
        annulus = F.size(F.filter("cuts", lambda e: e < F.col("r"))) if annuli > 1 else F.lit(0)
        placed = keyed.join(F.broadcast(written(cuts, "knn-cuts", PIVOTS)), "pivot").withColumn("cell", (F.col("pivot") * annuli + annulus).cast("int")).drop("cuts")
        self.rows = placed
        bounds = self.rows.groupBy("cell", "pivot").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high"), F.max("norm").alias("norm"))
        bounds = written(bounds, "knn-bounds", PIVOTS * ANNULI)
        self.cells = Cells(bounds.orderBy("cell").collect(), pivots)
        chunks = bounds.select("cell", F.ceil(F.col("n") / BLOCK).alias("chunks"))
        dealt = self.rows.join(F.broadcast(chunks), "cell").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int"))
        self.blocks = written(packed(dealt, ["cell", "chunk"]), "knn-blocks")


def packed(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row a group: by, ids and vectors as bytes, ordered by id."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        x = matrix(table.column("vector"), len(table.column("vector")[0]))[order]
        narrow = x.astype(np.int16) if np.abs(x).max(initial=0) < 2**15 else x
        out = {c: table.column(c).slice(0, 1) for c in by}
        return pa.table(out | {"ids": [ids[order].astype("<i8").tobytes()], "vectors": [narrow.tobytes()], "wide": [narrow.dtype == np.float64]})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", ids binary, vectors binary, wide boolean"
    return rows.select(*by, "vec_id", "vector").groupBy(*by).applyInArrow(run, schema)


def _unpack(ids: bytes, vectors: bytes, wide: bool, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(vectors, np.float64 if wide else np.int16).astype(np.float64).reshape(-1, dim)


def top(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query index, candidate index) of each query's k best candidates of at least its least score, ties to smaller ids (ids ascend)."""
    ok = (scores >= least[:, None]) & (ids[None] != own[:, None])
    many = ok.sum(1) > k
    for i in np.flatnonzero(many):
        at = np.flatnonzero(ok[i])
        best = at[np.argsort(-scores[i, at].astype(np.float64) if np.abs(scores[i, at]).max() < 2**53 else [-int(s) for s in scores[i, at]], kind="stable")[:k]]
        ok[i] = False
        ok[i, best] = True
    return np.nonzero(ok)


def _search(asked: DataFrame, index: Index, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best of each block for the queries that need its cell."""
    dim, looked = index.dim, index.looked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vectors, wide, q_ids, q_vectors, q_wide, least in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, x = _unpack(ids, vectors, wide, dim)
                own, q = _unpack(q_ids, q_vectors, q_wide, dim)
                looked.add(len(ids) * len(own))
                scores = products(q, x)
                i, j = top(scores, ids, own, np.frombuffer(least, "<i8"), k)
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(ids[j]), pa.array(scores[i, j])], names=["query_id", "vec_id", "score"])

    # Spark takes the questions to be as small as the queries' table, which they outgrow: neither side may be broadcast on that guess
    asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")  # a large cell is as many keys as blocks
    joined = asked.hint("merge").join(index.blocks.select("cell", "chunk", "ids", "vectors", "wide").hint("merge"), ["cell", "chunk"])
    return joined.select("ids", "vectors", "wide", "q_ids", "q_vectors", "q_wide", "least").mapInArrow(run, "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


class Round:
    """The cells that a query takes when it has looked at ``seen`` rows and may look at ``reach``; both count whole cells in its own order."""

    def __init__(self, cells, dim: int, seen: int, reach: int):
        self.cells, self.dim, self.seen, self.reach = cells, dim, seen, reach  # cells: a broadcast

    def _parts(self, batch: pa.RecordBatch):
        """Slices of the queries with, for each query and cell, the bound and the number of rows in cells that come before it."""
        c = self.cells.value
        for s in range(0, len(batch), QUERIES):
            part = batch.slice(s, QUERIES)
            x = matrix(part.column("vector"), self.dim)
            bounds = c.bounds(x)
            order = np.argsort(-bounds, 1, kind="stable")
            before = np.empty(bounds.shape, np.int64)
            np.put_along_axis(before, order, np.cumsum(c.n[order], 1) - c.n[order], 1)
            least = part.column("least").to_numpy()
            yield part, x, before, bounds >= least[:, None], least

    def asked(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each cell that a query of a slice needs, with those queries."""
        c = self.cells.value
        for batch in batches:
            for part, x, before, possible, least in self._parts(batch):
                need = possible & (before >= self.seen) & (before < self.reach)
                ids = part.column("vec_id").to_numpy().astype("<i8")
                wide = bool(np.abs(x).max(initial=0) >= 2**15)
                x = x if wide else x.astype(np.int16)
                for at in np.flatnonzero(need.any(0)):
                    own = need[:, at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([c.cell[at]], pa.int32()), pa.array([c.chunks[at]], pa.int32()), pa.array([ids[own].tobytes()]), pa.array([x[own].tobytes()]), pa.array([wide]), pa.array([least[own].astype("<i8").tobytes()])],
                        names=["cell", "chunks", "q_ids", "q_vectors", "q_wide", "least"],
                    )

    def going_on(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries whose next cell may hold an answer."""
        for batch in batches:
            for part, _, before, possible, _ in self._parts(batch):
                yield part.filter(pa.array((possible & (before >= self.reach)).any(1)))


def top_k(index: Index, queries: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for the indexed rows for which ``queries`` holds (a condition on vec_id)."""
    cells = index.rows.sparkSession.sparkContext.broadcast(index.cells)  # at most PIVOTS * ANNULI cells
    state = "vec_id long, vector array<double>, least long"
    asked = index.rows.where(queries).groupBy("vec_id").agg(F.min(F.struct("vector", "pivot")).alias("s"))
    asked = asked.select("vec_id", "s.vector", F.lit(np.iinfo(np.int64).min).cast("long").alias("least"), "s.pivot").sortWithinPartitions("pivot", "vec_id").drop("pivot")
    asked, best, step = written(asked, "knn-queries"), None, Round(cells, index.dim, 0, FIRST * max(1, k))
    while True:
        pairs = asked.mapInArrow(step.asked, "cell int, chunks int, q_ids binary, q_vectors binary, q_wide boolean, least binary")
        found = _search(pairs, index, k)
        best = written(_ranked(found if best is None else best.drop("rank").union(found), k), "knn-best")
        if step.reach >= index.n:
            break
        floor = best.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
        raised = asked.join(floor, "vec_id", "left").select("vec_id", "vector", F.coalesce("floor", "least").alias("least"))
        asked = written(raised.mapInArrow(step.going_on, state), "knn-queries")
        if asked.isEmpty():
            break
        step = Round(cells, index.dim, step.reach, step.reach * GROWTH)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 rows with the highest scores for every vector whose id is divisible by 20."""
    return top_k(Index(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), F.col("vec_id") % 20 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda y: floor(64 * y::DOUBLE)) AS z FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.z, b.z)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 20
"""
