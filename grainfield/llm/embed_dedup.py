"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Every unit vector u is rounded once, before vectors are dealt, to s * q with whole numbers q from -127 to 127; what is left
is rounded the same way to t * r. The lengths of both rounding errors, e and f, are known exactly. Vectors of one label are
dealt into tiles by hash; a pair of tiles is one group of work, and the int8 codes are all that it is sent. For two vectors

    |u.v - s_u s_v q_u.q_v| <= |e_u| + |s_u q_u| |e_v|

and the products of q are exact. Pairs that this leaves open are estimated by s q + t r, with f in place of e; pairs that are
open then, and they alone, are computed in double precision, by joins that fetch their vectors. What a bound decides is certain.

Equal vectors of a label are one vector with a weight, so copies make no pairs. A tile pair gives counts of links
and a spanning forest of its links, never the links themselves.

Nulls and odd cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do
rows with a null label or a null id; they are components of their own (null for a null id) and are kept. Vectors of
different lengths never link. Rows that share an id count as one vector when components are formed. Empty tables give
empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from .common import written
from .components import connected_components, join_roots
from .vectors import matrix, usable

#: Vectors of a tile, and of a block inside a tile product.
TILE, BLOCK = 2048, 1024


#: What rounding in doubles can add to a bound, with room to spare.
SLACK = 1e-9


def _rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of every row, their scale, and what is left of the row."""
    top = np.abs(x).max(1)
    scale = np.where(top > 0, top / 127, 1.0)
    codes = np.rint(x / scale[:, None])
    return codes.astype(np.int8), scale, x - codes * scale[:, None]


def _length(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision; no square can overflow."""
    x, y = (np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1]) for v in (x, y))
    return np.einsum("ij,ij->i", x, y) / (_length(x) * _length(y))


#: Numbers of a vector beside its codes.
NUMBERS = ["scale", "error", "length", "fine_scale", "fine_error"]


class Quantised:
    """Unit vectors as two layers of int8 codes, q and r, with scales, lengths of the errors, and the length of the first layer."""

    def __init__(self, q: np.ndarray, r: np.ndarray, **numbers: np.ndarray):
        self.q, self.r = q, r
        self.scale, self.error, self.length, self.fine_scale, self.fine_error = (numbers[c] for c in NUMBERS)

    @classmethod
    def of(cls, x: np.ndarray) -> Quantised:
        x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
        unit = x / _length(x)[:, None]
        q, scale, left = _rounded(unit)
        r, fine_scale, least = _rounded(left)
        return cls(q, r, scale=scale, error=_length(left), length=_length(unit - left), fine_scale=fine_scale, fine_error=_length(least))

    def take(self, rows: np.ndarray) -> Quantised:
        return Quantised(self.q[rows], self.r[rows], **{c: getattr(self, c)[rows] for c in NUMBERS})

    def factor(self, rows: slice) -> np.ndarray:
        """The int8 rows in the narrowest floats in which products are exact."""
        return self.q[rows].astype(np.float32 if self.q.shape[1] * 127 * 127 < 1 << 24 else np.float64)

    def fine(self, rows: np.ndarray) -> np.ndarray:
        """Both layers of the rows, in doubles."""
        return self.q[rows] * self.scale[rows, None] + self.r[rows] * self.fine_scale[rows, None]


def compared(a: Quantised, b: Quantised, threshold: float, same: bool):
    """Yields (i, j, certain): pairs with a cosine of at least the threshold, and pairs that may have one; only i < j where a and b are the same."""
    for s in range(0, len(a.q), BLOCK):
        left = a.factor(slice(s, s + BLOCK))
        for t in range(s if same else 0, len(b.q), BLOCK):
            about = (left @ b.factor(slice(t, t + BLOCK)).T).astype(np.float64)
            about *= a.scale[s : s + BLOCK, None]
            about *= b.scale[None, t : t + BLOCK]
            most = about + a.error[s : s + BLOCK, None]
            most += a.length[s : s + BLOCK, None] * b.error[None, t : t + BLOCK]
            i, j = np.nonzero(most >= threshold - SLACK)
            if same and s == t:
                i, j = i[i < j], j[i < j]
            certain = 2 * about[i, j] - most[i, j] >= threshold + SLACK
            i, j = i + s, j + t
            if certain.any():
                yield i[certain], j[certain], True
            i, j = i[~certain], j[~certain]
            for k in range(0, len(i), 1 << 16):
                p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                closer = np.einsum("ij,ij->i", a.fine(p), b.fine(q))
                room = a.fine_error[p] + (1 + a.fine_error[p]) * b.fine_error[q] + SLACK
                certain, still = closer - room >= threshold, np.abs(closer - threshold) < room
                if certain.any():
                    yield p[certain], q[certain], True
                if still.any():
                    yield p[still], q[still], False


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, dim, rep, weight, k1, vector to the same with codes in place of the vector."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            own = batch.take(pa.array(np.flatnonzero(dims == dim)))
            x = Quantised.of(matrix(own.column("vector"), int(dim)))
            layers = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(int(dim)), len(c), [None, pa.py_buffer(np.ascontiguousarray(c))]).cast(pa.binary()) for c in (x.q, x.r)]
            names = [*CODED, "q", "r", *NUMBERS]
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in CODED), *layers, *(pa.array(getattr(x, c)) for c in NUMBERS)], names=names)


CODED = ["label", "dim", "rep", "weight", "k1"]
#: Results of comparisons. kind 0: u has ``links`` more links; 1: u and v are linked, in a forest; 2: u and v are still open.
FOUND = "kind int, u long, v long, links long, ku long, kv long"


def _found(**columns) -> pa.Table:
    n = len(columns["u"])
    none = pa.nulls(n, pa.int64())
    rest = {c: pa.array(columns[c], pa.int64()) if c in columns else none for c in ("u", "v", "links", "ku", "kv")}
    return pa.table({"kind": pa.array(np.full(n, columns["kind"], np.int32))} | rest)


def _tile_pair(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        side = table.column("tile").to_numpy() == table.column("lo")[0].as_py()
        same = bool(table.column("lo")[0].as_py() == table.column("hi")[0].as_py())
        ids, weight, key = (table.column(c).to_numpy() for c in ("rep", "weight", "k1"))
        q, r = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int8).reshape(len(ids), -1) for c in "qr")
        all_rows = Quantised(q, r, **{c: table.column(c).to_numpy() for c in NUMBERS})
        first, second = np.flatnonzero(side), np.flatnonzero(side if same else ~side)
        links, parent, still = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
        a = all_rows.take(first)
        b = a if same else all_rows.take(second)
        for i, j, certain in compared(a, b, threshold, same):
            i, j = first[i], second[j]
            if certain:
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                parent = join_roots(parent, i, j)
            else:
                still.append((i, j))
        some, child = np.flatnonzero(links), np.flatnonzero(parent != np.arange(len(ids)))
        i, j = (np.concatenate([p[k] for p in still]) if still else np.zeros(0, np.int64) for k in (0, 1))
        return pa.concat_tables([
            _found(kind=0, u=ids[some], links=links[some]),
            _found(kind=1, u=ids[child], v=ids[parent[child]]),
            _found(kind=2, u=ids[i], v=ids[j], ku=key[i], kv=key[j]),
        ])

    return run


def _decide(threshold: float):
    """(u, v, wu, wv, x, y): the pairs of open ones that are linked, by their cosine in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = batch.take(pa.array(np.flatnonzero(dims == dim)))
                keep = pa.array(cosines(matrix(own.column("x"), int(dim)), matrix(own.column("y"), int(dim))) >= threshold)
                u, v, wu, wv = (own.column(c).filter(keep) for c in ("u", "v", "wu", "wv"))
                for rows in (dict(kind=0, u=u, links=wv), dict(kind=0, u=v, links=wu), dict(kind=1, u=u, v=v)):
                    yield from _found(**rows).to_batches()

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; vectors: vec_id, embedding, label."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("vector"))
    able = usable(F.col("vector")) & F.exists("vector", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # the seed comes first: hashes fold from left to right, and after one of 64 bits no seed could tell two vectors apart
    keys = [F.when(able, F.xxhash64(F.lit(s), "label", "vector")).alias(f"k{s}") for s in (1, 2)]
    keyed = own.select("vec_id", "label", F.when(able, F.col("vector")).alias("vector"), *keys)
    distinct = keyed.where("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    distinct = written(distinct.withColumn("dim", F.size("vector")), "ed-distinct")
    coded = StructType([distinct.schema[c] for c in CODED] + [StructField(c, BinaryType()) for c in "qr"] + [StructField(c, DoubleType()) for c in NUMBERS])
    codes = written(distinct.select(*CODED, "vector").mapInArrow(_quantise, coded), "ed-codes")
    tiles = distinct.groupBy("label", "dim").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    dealt = codes.join(tiles, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("k1"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select(*CODED, "q", "r", *NUMBERS, "tile", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"))
    dealt = dealt.repartition("label", "dim", "lo", "hi")  # else the join's partitions by label would stand, and a label be one task's work
    found = written(dealt.groupBy("label", "dim", "lo", "hi").applyInArrow(_tile_pair(threshold), FOUND), "ed-found")
    ends = [distinct.select(F.col("rep").alias(e), F.col("k1").alias(f"k{e}"), F.col("weight").alias(f"w{e}"), F.col("vector").alias(x), *extra) for e, x, extra in (("u", "x", ["dim"]), ("v", "y", []))]
    still = found.where("kind = 2").select("u", "v", "ku", "kv").join(ends[0], ["u", "ku"]).join(ends[1], ["v", "kv"])
    decided = written(still.select("u", "v", "wu", "wv", "dim", "x", "y").mapInArrow(_decide(threshold), FOUND), "ed-decided")
    found = found.where("kind < 2").union(decided)
    links = found.where("kind = 0").groupBy("u").agg(F.sum("links").alias("links"))
    edges = found.where("kind = 1").select("u", "v")
    components = connected_components(edges, edges.count())
    label = distinct.select("k1", "k2", "rep", "weight").join(links.withColumnRenamed("u", "rep"), "rep", "left").join(components.withColumnRenamed("node", "rep"), "rep", "left")
    label = label.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = keyed.select("vec_id", "k1", "k2").join(label, ["k1", "k2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all vectors with equal labels."""
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
    AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
p AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.93),
r AS (SELECT u, w FROM p UNION SELECT r.u, p.w FROM r JOIN p ON r.w = p.u)
SELECT vec_id, (SELECT count(*) FROM p WHERE p.u = vec_id)::BIGINT AS n_links,
       least(vec_id, coalesce((SELECT min(w) FROM r WHERE r.u = vec_id), vec_id))::BIGINT AS component_id,
       vec_id <= coalesce((SELECT min(w) FROM r WHERE r.u = vec_id), vec_id) AS kept
FROM embeddings
"""
