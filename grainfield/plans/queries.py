"""Registered queries of the factor jobs, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durable import shared_folder
from ..functions.grid import GridSpec, voxel_id
from ..operators import algebra, report
from ..operators.model import Model, fit, load_model, moments_of
from ..operators.moments import mean_spectrum, second_moments
from ..operators.select import select_ions
from ..operators.voxels import dense_rows, ion_type_counts, nonempty_voxels, voxel_counts, voxelize
from ..sources.tables import assign_ion_id, explode_grid, read_ion_types, read_ions, write_results
from ..streaming.select import select_stream, to_parquet
from .recipes import EVENT_TYPES, GRID, ISOVALUE, NAMES, PHASE2, PHASE3, as_ions, event_counts, ion_types, lineitem_ions


def _matrix(spark: SparkSession, d: str, recipe: str) -> DataFrame:
    return voxelize(lineitem_ions(spark, d, recipe), NAMES[recipe], GRID)


def _fitted(spark: SparkSession, d: str, recipe: str = "phase2", p: int = 1, tol: float = 1e-8) -> tuple[DataFrame, Model]:
    m = _matrix(spark, d, recipe)
    return m, fit(m, len(NAMES[recipe]), p, tol)


def _scores(spark: SparkSession, d: str) -> DataFrame:
    m, model = _fitted(spark, d)
    return model.transform(m)


def voxel_ids(spark, d):
    ions = lineitem_ions(spark, d, "phase2")
    return ions.select("l_orderkey", "l_linenumber", voxel_id(F.col("x"), F.col("y"), F.col("z"), GRID, "strict").alias("voxel_id"))


def voxel_counts_q(spark, d):
    return voxel_counts(lineitem_ions(spark, d, "phase3"), NAMES["phase3"], GRID)


def voxel_matrix(spark, d):
    x = F.col("x")
    return _matrix(spark, d, "phase3").select("voxel_id", *[x[i].cast("long").alias(c) for i, c in enumerate("abc")])


def ion_type_counts_q(spark, d):
    return ion_type_counts(lineitem_ions(spark, d, "plain7"), ion_types(spark, NAMES["plain7"]))


def nonempty_voxels_q(spark, d):
    counts = event_counts(spark, d)
    padded = dense_rows(counts.union(counts.select(-F.col("voxel_id") - 1, "feature_idx", F.lit(0.0))), len(EVENT_TYPES))
    return nonempty_voxels(padded).select("voxel_id", F.aggregate("x", F.lit(0.0), lambda a, b: a + b).cast("long").alias("total"))


#: Cells of one array of the event grid.
CELLS = 256


def _event_grid(spark, d):
    """A dense grid by event type: counts of all users, zeros where there are none, in rows of CELLS users from first_cell on.

    Rows without any count are left out. An event without a user has no cell.
    """
    own = event_counts(spark, d).where("voxel_id is not null")
    place = F.pmod("voxel_id", F.lit(CELLS))
    own = own.select("feature_idx", (F.col("voxel_id") - place).alias("first_cell"), place.alias("place"), "n")
    cells = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0.0)).cast("float"))
    rows = own.groupBy("feature_idx", "first_cell").agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("m"))
    return rows.select("feature_idx", "first_cell", cells.alias("counts"))


def explode_grid_q(spark, d):
    return explode_grid(_event_grid(spark, d))


def mean_spectrum_q(spark, d):
    return mean_spectrum(_matrix(spark, d, "phase3"), 3).select("feature_idx", F.round("mean", 6).alias("mean"), "n")


def second_moments_q(spark, d):
    return second_moments(_matrix(spark, d, "phase3"), 3).select("i", "j", F.round("value", 4).alias("value"))


def noise_eigenvalues(spark, d):
    m = _matrix(spark, d, "phase3")
    return fit(m, 3, 0).eigenvalue_table(spark).select("idx", F.round("eigenvalue", 5).alias("eigenvalue"))


def scree(spark, d):
    """Eigenvalues with their share of the sum."""
    m, model = _fitted(spark, d, p=0)
    total = float(model.eigenvalues.sum())
    return model.eigenvalue_table(spark).select("idx", F.round("eigenvalue", 5).alias("eigenvalue"), F.round(F.col("eigenvalue") / total, 6).alias("share"))


def _small(spark, factors: algebra.Factors, names: tuple[str, str], digits: tuple[int, int]):
    """A one-component model as rows, with the largest entry positive."""
    sign = float(np.sign(factors.to_scores[np.abs(factors.to_scores[:, 0]).argmax(), 0]))
    rows = [(i, float(factors.to_scores[i, 0]) * sign, float(factors.loadings[i, 0]) * sign) for i in range(len(factors.loadings))]
    df = spark.createDataFrame(rows, f"feature_idx int, {names[0]} double, {names[1]} double")
    return df.select("feature_idx", F.round(names[0], digits[0]).alias(names[0]), F.round(names[1], digits[1]).alias(names[1]))


def raw_factors(spark, d):
    mean, c, n = moments_of(_matrix(spark, d, "phase2"), 2)
    values, vectors = algebra.noise_eigen(mean, c)
    return _small(spark, algebra.raw_factors(mean, values, vectors, n, 1), ("vector", "loading"), (8, 6))


def orthonormal_factors(spark, d):
    mean, c, n = moments_of(_matrix(spark, d, "phase2"), 2)
    values, vectors = algebra.noise_eigen(mean, c)
    return _small(spark, algebra.orthonormal_factors(algebra.raw_factors(mean, values, vectors, n, 1), values, n), ("to_score", "loading"), (10, 4))


def fit_scores_1(spark, d):
    return _scores(spark, d).select("voxel_id", F.round(F.get("scores", F.lit(0)), 6).alias("score"))


def fit_loadings_1(spark, d):
    _, model = _fitted(spark, d)
    return model.loading_rows(spark).select("component", "feature_idx", F.round("loading", 7).alias("loading"))


def varimax_scores_2(spark, d):
    m, model = _fitted(spark, d, p=2, tol=1e-15)
    s = F.col("scores")
    return model.transform(m).select("voxel_id", F.round(F.least(s[0], s[1]), 3).alias("lo"), F.round(F.greatest(s[0], s[1]), 3).alias("hi"))


def _chosen(df):
    return df.select("l_orderkey", "l_linenumber")


def select_ions_q(spark, d):
    return _chosen(select_ions(lineitem_ions(spark, d, "phase2"), _scores(spark, d), GRID, 0, ISOVALUE))


def select_ions_inverted(spark, d):
    return _chosen(select_ions(lineitem_ions(spark, d, "phase2"), _scores(spark, d), GRID, 0, ISOVALUE, invert=True))


def score_bounds_q(spark, d):
    return report.score_bounds(_scores(spark, d), 0).select("component", F.round("min", 6).alias("min"), F.round("max", 6).alias("max"))


def component_scores_q(spark, d):
    own = report.component_scores(_scores(spark, d), 0)
    return own.select("voxel_id", F.round("score", 6).alias("score"), (F.col("score") >= ISOVALUE).alias("hit"))


def loadings_table_q(spark, d):
    _, model = _fitted(spark, d)
    own = report.loadings_table(model, ion_types(spark, NAMES["phase2"]))
    return own.select("component", "feature_idx", "ion", F.round("loading", 7).alias("loading"), "label")


def score_histogram_q(spark, d):
    return report.score_histogram(spark.read.parquet(f"{d}/events.parquet"), "value", 0.5)


def fit_events_1(spark, d):
    """Scores of users on the first factor of their events by type: five features, none of them from the grid."""
    m = dense_rows(event_counts(spark, d), len(EVENT_TYPES))
    model = fit(m, len(EVENT_TYPES), 1)
    return model.transform(m).select("voxel_id", F.round(F.get("scores", F.lit(0)), 5).alias("score"))


def fit_phase3_3(spark, d):
    """Three rotated components of three features, in forms that no rotation, order or sign changes: the counts, which scores times loadings
    give back, and the squared length of each voxel's scores."""
    m, model = _fitted(spark, d, "phase3", 3)
    t = F.col("scores")
    back = [F.round(sum(t[c] * float(model.loadings[k, c]) for c in range(3)), 6).cast("long").alias(n) for k, n in enumerate("abc")]
    return model.transform(m).select("voxel_id", *back, F.round(sum(t[c] * t[c] for c in range(3)), 3).alias("squared_length"))


def fit_plain7_3(spark, d):
    """Three rotated components of seven features: number and sum of squares of each component's scores, which are orthonormal (times
    1000), and the sum of all eigenvalues."""
    m, model = _fitted(spark, d, "plain7", 3)
    total = float(model.eigenvalues.sum())
    own = model.transform(m).select(F.posexplode("scores").alias("component", "score"))
    return own.groupBy("component").agg(F.count("*").alias("n"), F.round(F.sum(F.col("score") * F.col("score")), 3).alias("sum_squares")).withColumn("eigenvalue_sum", F.lit(round(total, 6)))


def assign_ion_id_q(spark, d):
    own = assign_ion_id(spark.read.parquet(f"{d}/events.parquet").select("event_id"), ["event_id"])
    return own.select("event_id", "ion_id")


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _streamed(spark, d, invert):
    """A selection from a stream of the rows of lineitem; the result is read back from its sink. Scores are a written table."""
    folder = _folder(spark, "stream")
    schema = spark.read.parquet(f"{d}/lineitem.parquet").schema
    lines = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(d)
    write_results(folder, scores=_scores(spark, d))
    picked = _chosen(select_stream(as_ions(lines, "phase2"), spark.read.parquet(f"{folder}/scores"), GRID, 0, ISOVALUE, invert))
    to_parquet(picked, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(picked.schema).parquet(f"{folder}/out")


def stream_select_ions(spark, d):
    """The selection of select_ions, from a stream of the same rows."""
    return _streamed(spark, d, False)


def stream_select_ions_inverted(spark, d):
    """All other rows, from a stream."""
    return _streamed(spark, d, True)


def ions_round_trip(spark, d):
    """Ions written as a result table and read by the reader of ions."""
    folder = _folder(spark, "ions")
    ions = lineitem_ions(spark, d, "phase3").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ion_id"), "x", "y", "z", "ion")
    write_results(folder, ions=ions)
    return read_ions(spark, f"{folder}/ions").select("ion_id", *[F.col(c).cast("double").alias(c) for c in "xyz"], "ion")


def ion_types_round_trip(spark, d):
    """The distinct types of all ions, numbered in their order, written and read by the reader of types; with the number of ions of each."""
    folder = _folder(spark, "types")
    ions = lineitem_ions(spark, d, "plain7")
    types = assign_ion_id(ions.select("ion").distinct(), ["ion"], "feature_idx")
    write_results(folder, types=types.select(F.col("feature_idx").cast("int"), "ion"))
    return ion_type_counts(ions, read_ion_types(spark, f"{folder}/types")).select("feature_idx", "ion", "n")


def results_round_trip(spark, d):
    """A fit's scores and selected ions written as results, and the scores of the selected ions' voxels read back."""
    folder = _folder(spark, "results")
    scores = _scores(spark, d)
    write_results(folder, scores=scores, selected=select_ions(lineitem_ions(spark, d, "phase2"), scores, GRID, 0, ISOVALUE))
    cell = voxel_id(F.col("x"), F.col("y"), F.col("z"), GRID)
    own = spark.read.parquet(f"{folder}/selected").groupBy(cell.alias("voxel_id")).agg(F.count("*").alias("n"))
    return own.join(spark.read.parquet(f"{folder}/scores"), "voxel_id").select("voxel_id", "n", F.round(F.get("scores", F.lit(0)), 6).alias("score"))


def saved_model(spark, d):
    """Scores by a model that was saved and loaded again: no second fit."""
    m, model = _fitted(spark, d)
    folder = _folder(spark, "model")
    model.save(folder, spark)
    return load_model(spark, folder).transform(m).select("voxel_id", F.round(F.get("scores", F.lit(0)), 6).alias("score"))


#: Fewer cells along each axis than the data has: most positions pass an axis and land in another row of cells.
NARROW = GridSpec(min=GRID.min, size=GRID.size, bins=(4, 2, 5))


def voxel_ids_wrapped(spark, d):
    """Cell ids without bounds, where positions alias past an axis."""
    ions = lineitem_ions(spark, d, "phase2")
    return ions.select("l_orderkey", "l_linenumber", voxel_id(F.col("x"), F.col("y"), F.col("z"), NARROW).alias("voxel_id"))


QUERIES = {
    "voxel_ids": voxel_ids,
    "voxel_counts": voxel_counts_q,
    "voxel_matrix": voxel_matrix,
    "ion_type_counts": ion_type_counts_q,
    "nonempty_voxels": nonempty_voxels_q,
    "explode_grid": explode_grid_q,
    "mean_spectrum": mean_spectrum_q,
    "second_moments": second_moments_q,
    "noise_eigenvalues": noise_eigenvalues,
    "scree": scree,
    "raw_factors": raw_factors,
    "orthonormal_factors": orthonormal_factors,
    "fit_scores_1": fit_scores_1,
    "fit_loadings_1": fit_loadings_1,
    "fit_events_1": fit_events_1,
    "fit_phase3_3": fit_phase3_3,
    "fit_plain7_3": fit_plain7_3,
    "varimax_scores_2": varimax_scores_2,
    "select_ions": select_ions_q,
    "select_ions_inverted": select_ions_inverted,
    "score_bounds": score_bounds_q,
    "component_scores": component_scores_q,
    "loadings_table": loadings_table_q,
    "score_histogram": score_histogram_q,
    "assign_ion_id": assign_ion_id_q,
    "stream_select_ions": stream_select_ions,
    "stream_select_ions_inverted": stream_select_ions_inverted,
    "ions_round_trip": ions_round_trip,
    "ion_types_round_trip": ion_types_round_trip,
    "results_round_trip": results_round_trip,
    "saved_model": saved_model,
    "voxel_ids_wrapped": voxel_ids_wrapped,
}

_CELL = "CAST(trunc((l_quantity - 0.5) / 5) AS BIGINT) + 10 * CAST(trunc((l_discount + 0.005) / 0.02) AS BIGINT) + 60 * CAST(trunc((l_tax + 0.005) / 0.02) AS BIGINT)"


def _rows(case: str) -> str:
    return f"ions AS (SELECT l_orderkey, l_linenumber, {_CELL} AS voxel_id, {case} AS ion FROM lineitem)"


_M3 = f"{_rows(PHASE3)}, m AS (SELECT voxel_id, count(*) FILTER (ion = 'A') AS a, count(*) FILTER (ion = 'B') AS b, count(*) FILTER (ion = 'C') AS c FROM ions GROUP BY voxel_id)"
#: Two features, one component in closed form: (ab, l - aa) is the eigenvector of the 2 x 2 matrix.
_M2 = (
    f"{_rows(PHASE2)}, m AS (SELECT voxel_id, (count(*) FILTER (ion = 'A'))::DOUBLE AS a, (count(*) FILTER (ion = 'B'))::DOUBLE AS b FROM ions GROUP BY voxel_id), "
    "u AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(a * a) / avg(a) AS aa, avg(b * b) / avg(b) AS bb, avg(a * b) / sqrt(avg(a) * avg(b)) AS ab, count(*) AS n FROM m), "
    "e AS (SELECT *, (aa + bb) / 2 + sqrt(((aa - bb) / 2) ** 2 + ab * ab) AS l, (aa + bb) / 2 - sqrt(((aa - bb) / 2) ** 2 + ab * ab) AS l2 FROM u), "
    "t AS (SELECT voxel_id, a, b, a * ab / sqrt(ma) + b * (l - aa) / sqrt(mb) AS t FROM m, e), "
    "s AS (SELECT voxel_id, a, b, 1000 * t / sqrt((SELECT sum(t * t) FROM t)) AS score FROM t)"
)
_FACTORS = f"WITH {_M2}, z AS (SELECT *, ab / sqrt(ab * ab + (l - aa) ** 2) AS za, (l - aa) / sqrt(ab * ab + (l - aa) ** 2) AS zb FROM e)"
_LOADS = "(SELECT 0 AS feature_idx, 'A' AS ion, sum(a * score) / 1e6 AS loading FROM s UNION ALL SELECT 1, 'B', sum(b * score) / 1e6 FROM s)"
_TYPES = "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(EVENT_TYPES)) + ") AS k(feature_idx, event_type)"
_HITS = f"WITH {_M2} SELECT l_orderkey, l_linenumber FROM ions WHERE"

def _power_sql(k: int, steps: int = 60) -> str:
    """SQL of the scores on the first factor of k features: power iteration on the noise-weighted second moments, from the vector of ones."""
    names = [f"c{i}" for i in range(k)]
    cell = lambda i, j: f"coalesce(avg({names[i]} * {names[j]}) / nullif(sqrt(avg({names[i]}) * avg({names[j]})), 0), 0) AS g{i}_{j}"
    row = lambda i: " + ".join(f"g{i}_{j} * v{j}" for j in range(k))
    length = "sqrt(" + " + ".join(f"({row(i)}) ** 2" for i in range(k)) + ")"
    counts = ", ".join(f"(count(*) FILTER (event_type = '{t}'))::DOUBLE AS {n}" for n, t in zip(names, EVENT_TYPES, strict=True))
    types = ", ".join(f"'{t}'" for t in EVENT_TYPES)
    return f"""WITH RECURSIVE m AS (SELECT user_id::BIGINT AS voxel_id, {counts} FROM events WHERE event_type IN ({types}) GROUP BY user_id),
g AS (SELECT {", ".join(cell(i, j) for i in range(k) for j in range(k))}, {", ".join(f"avg({n}) AS m{i}" for i, n in enumerate(names))} FROM m),
p AS (SELECT 0 AS step, {", ".join(f"1::DOUBLE AS v{i}" for i in range(k))} UNION ALL
      SELECT step + 1, {", ".join(f"({row(i)}) / {length}" for i in range(k))} FROM p, g WHERE step < {steps}),
t AS (SELECT voxel_id, {" + ".join(f"coalesce({n} * v{i} / nullif(sqrt(m{i}), 0), 0)" for i, n in enumerate(names))} AS t FROM m, g, p WHERE step = {steps})
SELECT voxel_id, round(1000 * t / sqrt((SELECT sum(t * t) FROM t)), 5) AS score FROM t"""


ORACLE = {
    "voxel_ids": f"SELECT l_orderkey, l_linenumber, {_CELL} AS voxel_id FROM lineitem",
    "voxel_counts": f"WITH {_rows(PHASE3)} SELECT voxel_id, CASE ion WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE 2 END AS feature_idx, count(*)::DOUBLE AS n FROM ions GROUP BY ALL",
    "voxel_matrix": f"WITH {_M3} SELECT voxel_id, a, b, c FROM m",
    "ion_type_counts": "SELECT (l_linenumber - 1)::INT AS feature_idx, 't' || l_linenumber AS ion, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total FROM lineitem WHERE l_linenumber BETWEEN 1 AND 7 GROUP BY l_linenumber",
    "nonempty_voxels": f"SELECT user_id::BIGINT AS voxel_id, count(*) AS total FROM events WHERE event_type IN (SELECT event_type FROM {_TYPES}) GROUP BY user_id",
    "explode_grid": f"SELECT user_id::BIGINT AS voxel_id, feature_idx::INT AS feature_idx, count(*)::DOUBLE AS n FROM events JOIN {_TYPES} USING (event_type) WHERE user_id IS NOT NULL GROUP BY ALL",
    "mean_spectrum": f"WITH {_M3} SELECT feature_idx::INT AS feature_idx, round(avg(x), 6) AS mean, count(*) AS n FROM (SELECT 0 AS feature_idx, a AS x FROM m UNION ALL SELECT 1, b FROM m UNION ALL SELECT 2, c FROM m) GROUP BY feature_idx",
    "second_moments": f"WITH {_M3}, x AS (SELECT voxel_id, 0 AS i, a AS v FROM m UNION ALL SELECT voxel_id, 1, b FROM m UNION ALL SELECT voxel_id, 2, c FROM m) SELECT p.i::INT AS i, q.i::INT AS j, round(avg((p.v * q.v)::DOUBLE), 4) AS value FROM x p JOIN x q USING (voxel_id) GROUP BY ALL",
    "noise_eigenvalues": f"""WITH {_M3},
u AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(a * a) / avg(a) AS aa, avg(b * b) / avg(b) AS bb, avg(c * c) / avg(c) AS cc,
      avg(a * b) / sqrt(avg(a) * avg(b)) AS ab, avg(a * c) / sqrt(avg(a) * avg(c)) AS ac, avg(b * c) / sqrt(avg(b) * avg(c)) AS bc FROM m),
q AS (SELECT *, (aa + bb + cc) / 3 AS q FROM u),
p AS (SELECT *, sqrt(((aa - q) ** 2 + (bb - q) ** 2 + (cc - q) ** 2 + 2 * (ab * ab + ac * ac + bc * bc)) / 6) AS p FROM q),
r AS (SELECT *, ((aa - q) * ((bb - q) * (cc - q) - bc * bc) - ab * (ab * (cc - q) - bc * ac) + ac * (ab * bc - (bb - q) * ac)) / (2 * p * p * p) AS r FROM p),
f AS (SELECT q, p, acos(least(1, greatest(-1, r))) / 3 AS f FROM r)
SELECT idx::INT AS idx, round(q + 2 * p * cos(f + CASE idx WHEN 0 THEN 0 WHEN 1 THEN 4 * pi() / 3 ELSE 2 * pi() / 3 END), 5) AS eigenvalue FROM f, range(3) AS k(idx)""",
    "scree": f"WITH {_M2} SELECT 0::INT AS idx, round(l, 5) AS eigenvalue, round(l / (l + l2), 6) AS share FROM e UNION ALL SELECT 1, round(l2, 5), round(l2 / (l + l2), 6) FROM e",
    "raw_factors": f"{_FACTORS} SELECT 0::INT AS feature_idx, round(za / sqrt(ma), 8) AS vector, round(za * sqrt(ma), 6) AS loading FROM z UNION ALL SELECT 1, round(zb / sqrt(mb), 8), round(zb * sqrt(mb), 6) FROM z",
    "orthonormal_factors": f"{_FACTORS} SELECT 0::INT AS feature_idx, round(za / sqrt(ma * n * l), 10) AS to_score, round(za * sqrt(ma * n * l), 4) AS loading FROM z UNION ALL SELECT 1, round(zb / sqrt(mb * n * l), 10), round(zb * sqrt(mb * n * l), 4) FROM z",
    "fit_scores_1": f"WITH {_M2} SELECT voxel_id, round(score, 6) AS score FROM s",
    "fit_loadings_1": f"WITH {_M2} SELECT 0::INT AS component, feature_idx::INT AS feature_idx, round(loading, 7) AS loading FROM {_LOADS}",
    "varimax_scores_2": f"""WITH {_M2},
x AS (SELECT voxel_id, a, b, score / 1000 AS x FROM s),
y0 AS (SELECT *, a - x * (SELECT sum(a * x) FROM x) AS y FROM x),
y AS (SELECT voxel_id, a, b, x, y / sqrt((SELECT sum(y * y) FROM y0)) AS y FROM y0),
f AS (SELECT atan2(2 * sum((x * x - y * y) * 2 * x * y), sum((x * x - y * y) ** 2 - (2 * x * y) ** 2)) / 4 AS f FROM y),
g AS (SELECT voxel_id, a, b, x * cos(f) + y * sin(f) AS p, y * cos(f) - x * sin(f) AS q FROM y, f),
o AS (SELECT sum(a * p) AS ap, sum(b * p) AS bp, sum(a * q) AS aq, sum(b * q) AS bq FROM g),
d AS (SELECT CASE WHEN 2 * (CASE WHEN ap > 0 THEN ap * ap ELSE 0 END + CASE WHEN bp > 0 THEN bp * bp ELSE 0 END) < ap * ap + bp * bp THEN -1000 ELSE 1000 END AS sp,
             CASE WHEN 2 * (CASE WHEN aq > 0 THEN aq * aq ELSE 0 END + CASE WHEN bq > 0 THEN bq * bq ELSE 0 END) < aq * aq + bq * bq THEN -1000 ELSE 1000 END AS sq FROM o)
SELECT voxel_id, round(least(sp * p, sq * q), 3) AS lo, round(greatest(sp * p, sq * q), 3) AS hi FROM g, d""",
    "select_ions": f"{_HITS} voxel_id IN (SELECT voxel_id FROM s WHERE score >= 60)",
    "select_ions_inverted": f"{_HITS} voxel_id NOT IN (SELECT voxel_id FROM s WHERE score >= 60)",
    "score_bounds": f"WITH {_M2} SELECT 0::INT AS component, round(min(score), 6) AS min, round(max(score), 6) AS max FROM s",
    "component_scores": f"WITH {_M2} SELECT voxel_id, round(score, 6) AS score, score >= 60 AS hit FROM s",
    "loadings_table": f"WITH {_M2} SELECT 0::INT AS component, feature_idx::INT AS feature_idx, ion, round(loading, 7) AS loading, format('{{:.3f}}', loading) AS label FROM {_LOADS}",
    "score_histogram": """WITH r AS (SELECT min(value) AS lo, greatest(1, ceil((max(value) - min(value)) / 0.5::DOUBLE))::INT AS bins FROM events),
c AS (SELECT least(trunc((value - lo) / 0.5::DOUBLE)::INT, bins - 1) AS bin, count(*) AS n FROM events, r WHERE value IS NOT NULL GROUP BY 1)
SELECT k.bin::INT AS bin, lo + k.bin * 0.5::DOUBLE AS left_edge, coalesce(n, 0) AS n FROM r, generate_series(0, bins - 1) AS k(bin) LEFT JOIN c ON c.bin = k.bin""",
    "assign_ion_id": "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS ion_id FROM events",
}
ORACLE |= {
    "fit_events_1": _power_sql(len(EVENT_TYPES)),
    # x' (X'X)^-1 x in closed form for three features
    "fit_phase3_3": f"""WITH {_M3}, s AS (SELECT sum(a * a)::DOUBLE AS aa, sum(b * b)::DOUBLE AS bb, sum(c * c)::DOUBLE AS cc, sum(a * b)::DOUBLE AS ab, sum(a * c)::DOUBLE AS ac, sum(b * c)::DOUBLE AS bc FROM m),
i AS (SELECT bb * cc - bc * bc AS xx, aa * cc - ac * ac AS yy, aa * bb - ab * ab AS zz, ac * bc - ab * cc AS xy, ab * bc - ac * bb AS xz, ab * ac - aa * bc AS yz,
             aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM s)
SELECT voxel_id, a, b, c, round(1e6::DOUBLE * (a * a * xx + b * b * yy + c * c * zz + 2 * (a * b * xy + a * c * xz + b * c * yz)) / det, 3) AS squared_length FROM m, i""",
    "fit_plain7_3": f"""WITH ions AS (SELECT {_CELL} AS voxel_id, l_linenumber AS k FROM lineitem WHERE l_linenumber BETWEEN 1 AND 7),
m AS (SELECT voxel_id, k, count(*)::DOUBLE AS n FROM ions GROUP BY ALL), v AS (SELECT count(DISTINCT voxel_id) AS n FROM m),
e AS (SELECT k, (sum(n * n) / any_value((SELECT n FROM v))) / (sum(n) / any_value((SELECT n FROM v))) AS x FROM m GROUP BY k)
SELECT c.component::INT AS component, (SELECT n FROM v) AS n, 1e6::DOUBLE AS sum_squares, (SELECT round(sum(x), 6) FROM e) AS eigenvalue_sum FROM range(3) AS c(component)""",
    "stream_select_ions": ORACLE["select_ions"],
    "stream_select_ions_inverted": ORACLE["select_ions_inverted"],
    "ions_round_trip": f"SELECT l_orderkey * 8 + l_linenumber AS ion_id, l_quantity::FLOAT::DOUBLE AS x, l_discount::FLOAT::DOUBLE AS y, l_tax::FLOAT::DOUBLE AS z, {PHASE3} AS ion FROM lineitem",
    "ion_types_round_trip": "SELECT (row_number() OVER (ORDER BY ion) - 1)::INT AS feature_idx, ion, n FROM (SELECT 't' || l_linenumber AS ion, count(*) AS n FROM lineitem GROUP BY ALL)",
    "results_round_trip": f"WITH {_M2} SELECT voxel_id, (SELECT count(*) FROM ions WHERE ions.voxel_id = s.voxel_id) AS n, round(score, 6) AS score FROM s WHERE score >= 60",
    "saved_model": ORACLE["fit_scores_1"],
    "voxel_ids_wrapped": "SELECT l_orderkey, l_linenumber, CAST(trunc((l_quantity - 0.5) / 5) AS BIGINT) + 4 * CAST(trunc((l_discount + 0.005) / 0.02) AS BIGINT) + 8 * CAST(trunc((l_tax + 0.005) / 0.02) AS BIGINT) AS voxel_id FROM lineitem",
}
