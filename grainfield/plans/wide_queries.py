"""Registered queries of sparse rows, wide models and rotations of three components, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.model import fit, fit_leading
from ..operators.moments import both_triangles
from ..operators.sparse import dense_of, pair_sums, sparse_rows, sparse_voxelize
from .queries import _M3, _matrix, _rows
from .recipes import GRID, NAMES, PHASE3, ion_types, lineitem_ions


def _orders(spark, d) -> DataFrame:
    """Orders as voxels and suppliers as features: a few of many in each."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("voxel_id"), F.col("l_suppkey").cast("int").alias("feature_idx"), F.lit(1.0).alias("n"))
    return sparse_rows(lines)


def _suppliers(spark, d) -> int:
    """The number of features of ``_orders``."""
    return int(spark.read.parquet(f"{d}/supplier.parquet").agg(F.max("s_suppkey").alias("m")).first()["m"]) + 1


def sparse_voxel_matrix(spark, d):
    """The matrix of voxel_matrix, counted as sparse rows and written out."""
    own = sparse_voxelize(lineitem_ions(spark, d, "phase3"), ion_types(spark, NAMES["phase3"]), GRID)
    return dense_of(own, 3).select("voxel_id", *[F.col("x")[i].cast("long").alias(c) for i, c in enumerate("abc")])


def sparse_second_moments(spark, d):
    """Sums of products of counts of every two suppliers over all orders, where there are any."""
    sums = both_triangles(pair_sums(_orders(spark, d)))
    return sums.select("i", "j", F.col("value").cast("long").alias("total"))


def leading_scores_1(spark, d):
    """Scores of orders on the first factor of their suppliers, without a matrix of suppliers."""
    own = _orders(spark, d)
    model = fit_leading(own, _suppliers(spark, d), 1, eigen_tol=1e-11)
    return model.transform(own).select("voxel_id", F.round(F.get("scores", F.lit(0)), 2).alias("score"))


def _three(spark, d, many: int):
    m = _matrix(spark, d, "phase3")
    return fit(m, 3, 3, 1e-15, many=many).transform(m).select("voxel_id", *[F.round(F.get(F.array_sort("scores"), F.lit(i)), 2).alias(c) for i, c in enumerate(("lo", "mid", "hi"))])


def varimax_scores_3(spark, d):
    """Scores on three rotated components, each voxel's in ascending order: other rotations give other rows."""
    return _three(spark, d, 24)


def varimax_passes_3(spark, d):
    """The same with a pass over the voxels for each step of the rotation."""
    return _three(spark, d, 1)


QUERIES = {
    "sparse_voxel_matrix": sparse_voxel_matrix,
    "sparse_second_moments": sparse_second_moments,
    "leading_scores_1": leading_scores_1,
    "varimax_scores_3": varimax_scores_3,
    "varimax_passes_3": varimax_passes_3,
}


def _varimax_sql(sweeps: int = 20) -> str:
    """Plane rotations of every two of three orthonormal columns, by their moments of order four (81 numbers), until none turns."""
    at = lambda *i: f"m[{27 * i[0] + 9 * i[1] + 3 * i[2] + i[3] + 1}]"
    pairs = [(0, 1), (0, 2), (1, 2)]
    angle = " ".join(f"WHEN {k} THEN atan2(4 * ({at(i, i, i, j)} - {at(i, j, j, j)}), {at(i, i, i, i)} + {at(j, j, j, j)} - 6 * {at(i, i, j, j)}) / 4" for k, (i, j) in enumerate(pairs))

    def plane(i: int, j: int) -> str:
        cell = lambda a, b: "cos(f)" if a == b and a in (i, j) else "sin(f)" if (a, b) == (j, i) else "-sin(f)" if (a, b) == (i, j) else str(float(a == b))
        return "[" + ", ".join(cell(a, b) for a in range(3) for b in range(3)) + "]"

    planes = " ".join(f"WHEN {k} THEN {plane(i, j)}" for k, (i, j) in enumerate(pairs))
    digit = lambda x, k: f"{x} // {3**k} % 3"
    turn = " * ".join(f"g[({digit('e', k)}) * 3 + {digit('q', k)} + 1]" for k in (3, 2, 1, 0))
    column = lambda c: " + ".join(f"y[{k + 1}] * r[{3 * k + c + 1}]" for k in range(3))
    load = lambda c: "[" + ", ".join(f"sum({x} * t[{c + 1}])" for x in "abc") + "]"
    sign = lambda c: f"CASE WHEN 2 * list_sum(list_transform(l{c}, lambda z: CASE WHEN z > 0 THEN z * z ELSE 0 END)) < list_dot_product(l{c}, l{c}) THEN -1000 ELSE 1000 END AS s{c}"
    return f"""WITH RECURSIVE {_M3}, x AS (SELECT voxel_id, a::DOUBLE AS a, b::DOUBLE AS b, c::DOUBLE AS c FROM m),
g1 AS (SELECT *, a / sqrt(sum(a * a) OVER ()) AS p FROM x), g2 AS (SELECT *, b - p * sum(b * p) OVER () AS b1 FROM g1), g3 AS (SELECT *, b1 / sqrt(sum(b1 * b1) OVER ()) AS q FROM g2),
g4 AS (SELECT *, c - p * sum(c * p) OVER () - q * sum(c * q) OVER () AS c1 FROM g3), y AS (SELECT voxel_id, a, b, c, [p, q, c1 / sqrt(sum(c1 * c1) OVER ())] AS y FROM g4),
o AS (SELECT k, sum(y[{digit("k", 3)} + 1] * y[{digit("k", 2)} + 1] * y[{digit("k", 1)} + 1] * y[{digit("k", 0)} + 1]) AS s FROM y, range(81) AS u(k) GROUP BY k),
w AS (SELECT 0 AS step, (SELECT list(s ORDER BY k) FROM o) AS m, [1.0::DOUBLE, 0, 0, 0, 1, 0, 0, 0, 1] AS r UNION ALL
  SELECT step + 1, list_transform(range(81), lambda q: list_sum(list_transform(range(81), lambda e: m[e + 1] * {turn}))), list_transform(range(9), lambda q: list_sum(list_transform(range(3), lambda e: r[q // 3 * 3 + e + 1] * g[e * 3 + q % 3 + 1])))
  FROM (SELECT step, m, r, CASE step % 3 {planes} END AS g FROM (SELECT *, CASE step % 3 {angle} END AS f FROM w WHERE step < {3 * sweeps}))),
t AS (SELECT voxel_id, a, b, c, [{column(0)}, {column(1)}, {column(2)}] AS t FROM y, (SELECT r FROM w WHERE step = {3 * sweeps})),
l AS (SELECT {load(0)} AS l0, {load(1)} AS l1, {load(2)} AS l2 FROM t), s AS (SELECT {sign(0)}, {sign(1)}, {sign(2)} FROM l),
z AS (SELECT voxel_id, list_sort([t[1] * s0, t[2] * s1, t[3] * s2]) AS z FROM t, s)
SELECT voxel_id, round(z[1], 2) AS lo, round(z[2], 2) AS mid, round(z[3], 2) AS hi FROM z"""


_ORDERS = "c AS (SELECT l_orderkey AS voxel_id, l_suppkey AS k, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL)"

ORACLE = {
    "sparse_voxel_matrix": f"WITH {_rows(PHASE3)} SELECT voxel_id, count(*) FILTER (ion = 'A') AS a, count(*) FILTER (ion = 'B') AS b, count(*) FILTER (ion = 'C') AS c FROM ions GROUP BY voxel_id",
    "sparse_second_moments": f"WITH {_ORDERS} SELECT p.k::INT AS i, q.k::INT AS j, sum(p.n * q.n)::BIGINT AS total FROM c p JOIN c q USING (voxel_id) GROUP BY ALL",
    # power iteration on the noise-weighted second moments, from the vector of ones
    "leading_scores_1": f"""WITH RECURSIVE {_ORDERS}, v AS (SELECT count(DISTINCT voxel_id) AS rows FROM c), mu AS (SELECT k, sum(n) / any_value(rows) AS mu FROM c, v GROUP BY k),
g AS (SELECT p.k AS i, q.k AS j, sum(p.n * q.n) / any_value(rows) AS v FROM c p JOIN c q USING (voxel_id), v GROUP BY ALL),
r AS (SELECT a.k AS i, list(coalesce(g.v, 0) / sqrt(a.mu * b.mu) ORDER BY b.k) AS r FROM mu a CROSS JOIN mu b LEFT JOIN g ON g.i = a.k AND g.j = b.k GROUP BY a.k),
p AS (SELECT 0 AS step, list(r ORDER BY i) AS g, list(1::DOUBLE ORDER BY i) AS v FROM r UNION ALL
  SELECT step + 1, g, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM (SELECT step, g, list_transform(g, lambda row: list_dot_product(row, v)) AS w FROM p WHERE step < 60)),
f AS (SELECT k, v[row_number() OVER (ORDER BY k)] / sqrt(mu) AS f FROM mu, (SELECT v FROM p WHERE step = 60)),
t AS (SELECT voxel_id, sum(n * f) AS t FROM c JOIN f USING (k) GROUP BY voxel_id)
SELECT voxel_id, round(1000 * t / sqrt(sum(t * t) OVER ()), 2) AS score FROM t""",
}
ORACLE["varimax_scores_3"] = ORACLE["varimax_passes_3"] = _varimax_sql()
