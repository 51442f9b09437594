"""Registered queries of versioned results, numbered batches, bitmaps and clustered ions, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bitmap import hit_bitmaps, select_by_bitmap
from ..operators.model import fit, publish_model, read_model
from ..operators.select import hit_voxels
from ..operators.voxels import voxelize
from ..sources.clustered import ClusteredIons
from ..sources.log import store_rows, stored_rows
from ..sources.numbering import NumberedTable
from ..sources.snapshots import Snapshots
from ..streaming.select import read_selected, select_newest, to_parquet
from .queries import _CELL, _HITS, _M2, _chosen, _folder, _scores
from .recipes import GRID, ISOVALUE, NAMES, as_ions, lineitem_ions

#: Rows of lineitem that come first where a query takes them in two parts.
EARLY = "l_orderkey % 2 = 0"


def versioned_results(spark, d):
    """Hits at two thresholds saved one after the other beside the same scores; both versions read afterwards."""
    store, scores = Snapshots(spark, _folder(spark, "versions")), _scores(spark, d)
    store.publish(scores=scores, hits=hit_voxels(scores, 0, ISOVALUE))
    store.publish(hits=hit_voxels(store.read("scores"), 0, ISOVALUE - 20))
    both = [store.read("hits", v).join(store.read("scores", v), "voxel_id").select(F.lit(v).alias("version"), "voxel_id", F.round(F.get("scores", F.lit(0)), 6).alias("score")) for v in (0, 1)]
    return both[0].union(both[1])


def _halves(spark, d) -> list[DataFrame]:
    ions = lineitem_ions(spark, d, "phase2")
    return [ions.where(EARLY), ions.where(f"NOT ({EARLY})")]


def versioned_model(spark, d):
    """Models of the early rows and of all rows, saved as versions of one store; scores of all voxels by each as it is read back."""
    store, ions = Snapshots(spark, _folder(spark, "models")), lineitem_ions(spark, d, "phase2")
    for own in (ions.where(EARLY), ions):
        publish_model(store, fit(voxelize(own, NAMES["phase2"], GRID), 2, 1))
    m = voxelize(ions, NAMES["phase2"], GRID)
    both = [read_model(store, v).transform(m).select(F.lit(v).alias("version"), "voxel_id", F.round(F.get("scores", F.lit(0)), 6).alias("score")) for v in (0, 1)]
    return both[0].union(both[1])


def stream_newest_model(spark, d):
    """A stream of early rows, then of the others; between them a model of all rows is saved, after one of the early rows."""
    folder, early_late = _folder(spark, "newest"), _halves(spark, d)
    store, ions = Snapshots(spark, f"{folder}/results"), lineitem_ions(spark, d, "phase2")
    for own, part in zip((early_late[0], ions), early_late, strict=True):
        m = voxelize(own, NAMES["phase2"], GRID)
        store.publish(scores=fit(m, 2, 1).transform(m))
        part.write.mode("append").parquet(f"{folder}/ions")
        stream = spark.readStream.schema(ions.schema).parquet(f"{folder}/ions")
        select_newest(stream, store, GRID, f"{folder}/out", f"{folder}/state", 0, ISOVALUE).awaitTermination()
    return read_selected(spark, f"{folder}/out").select("l_orderkey", "l_linenumber", "version")


def _numbered(spark, d) -> tuple[NumberedTable, list[DataFrame]]:
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id")
    return NumberedTable(spark, _folder(spark, "numbered")), [events.where(F.pmod("event_id", F.lit(3)) == k) for k in range(3)]


def numbered_batches(spark, d):
    """Events appended in three batches, the second one twice; numbers go on."""
    table, parts = _numbered(spark, d)
    for k in (0, 1, 1, 2):
        table.append(parts[k], ["event_id"], k)
    return table.read()


def stream_numbered(spark, d):
    """The same batches as micro-batches of a stream."""
    table, parts = _numbered(spark, d)
    folder = _folder(spark, "events")
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{folder}/in")
        stream.writeStream.foreachBatch(table.writer(["event_id"])).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return table.read()


def _bitmaps(spark, d, isovalue: float) -> DataFrame:
    return stored_rows(spark, [store_rows(hit_bitmaps(_scores(spark, d), 0, isovalue), _folder(spark, "bitmaps"))])


def select_ions_bitmap(spark, d):
    """The selection of select_ions from bitmaps."""
    return _chosen(select_by_bitmap(lineitem_ions(spark, d, "phase2"), _bitmaps(spark, d, ISOVALUE), GRID))


def select_ions_bitmap_inverted(spark, d):
    return _chosen(select_by_bitmap(lineitem_ions(spark, d, "phase2"), _bitmaps(spark, d, ISOVALUE), GRID, invert=True))


def select_ions_bitmap_all(spark, d):
    """At isovalue 0, where nearly all cells are hits."""
    return _chosen(select_by_bitmap(lineitem_ions(spark, d, "phase2"), _bitmaps(spark, d, 0.0), GRID))


def stream_select_bitmap(spark, d):
    """The same from a stream of the rows of lineitem."""
    folder, schema = _folder(spark, "stream-bitmap"), spark.read.parquet(f"{d}/lineitem.parquet").schema
    lines = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(d)
    picked = _chosen(select_by_bitmap(as_ions(lines, "phase2"), _bitmaps(spark, d, ISOVALUE), GRID))
    to_parquet(picked, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(picked.schema).parquet(f"{folder}/out")


def _laid_out(spark, d) -> ClusteredIons:
    return ClusteredIons.write(lineitem_ions(spark, d, "phase2"), _folder(spark, "clustered"), GRID, (5, 2, 2))


def clustered_blocks(spark, d):
    """Ions of each block of a clustered layout."""
    return _laid_out(spark, d).table().groupBy("block").agg(F.count("*").alias("n"))


def select_ions_clustered(spark, d):
    """The selection of select_ions from a clustered layout, whose scan takes hit blocks only."""
    return _chosen(_laid_out(spark, d).select(_scores(spark, d), 0, ISOVALUE))


def select_ions_clustered_inverted(spark, d):
    return _chosen(_laid_out(spark, d).select(_scores(spark, d), 0, ISOVALUE, invert=True))


QUERIES = {
    "versioned_results": versioned_results,
    "versioned_model": versioned_model,
    "stream_newest_model": stream_newest_model,
    "numbered_batches": numbered_batches,
    "stream_numbered": stream_numbered,
    "select_ions_bitmap": select_ions_bitmap,
    "select_ions_bitmap_inverted": select_ions_bitmap_inverted,
    "select_ions_bitmap_all": select_ions_bitmap_all,
    "stream_select_bitmap": stream_select_bitmap,
    "clustered_blocks": clustered_blocks,
    "select_ions_clustered": select_ions_clustered,
    "select_ions_clustered_inverted": select_ions_clustered_inverted,
}

_EARLY_M2 = _M2.replace("FROM lineitem", f"FROM lineitem WHERE {EARLY}")
_NUMBERED = "SELECT event_id, row_number() OVER (ORDER BY event_id % 3, event_id) - 1 AS ion_id FROM events"

ORACLE = {
    "versioned_results": f"WITH {_M2} SELECT 0::INT AS version, voxel_id, round(score, 6) AS score FROM s WHERE score >= 60 UNION ALL SELECT 1, voxel_id, round(score, 6) FROM s WHERE score >= 40",
    # the early model's scores of all voxels: its weights over its own norm
    "versioned_model": f"""WITH {_M2}, w AS (WITH {_EARLY_M2} SELECT ab / sqrt(ma) AS wa, (l - aa) / sqrt(mb) AS wb, (SELECT sqrt(sum(t * t)) FROM t) AS norm FROM e)
SELECT 0::INT AS version, voxel_id, round(1000 * (a * wa + b * wb) / norm, 6) AS score FROM m, w UNION ALL SELECT 1, voxel_id, round(score, 6) FROM s""",
    "stream_newest_model": f"""WITH i AS (SELECT l_orderkey, l_linenumber, {_CELL} AS voxel_id FROM lineitem)
SELECT l_orderkey, l_linenumber, 0::INT AS version FROM i WHERE {EARLY} AND voxel_id IN (WITH {_EARLY_M2} SELECT voxel_id FROM s WHERE score >= 60)
UNION ALL SELECT l_orderkey, l_linenumber, 1 FROM i WHERE NOT ({EARLY}) AND voxel_id IN (WITH {_M2} SELECT voxel_id FROM s WHERE score >= 60)""",
    "numbered_batches": _NUMBERED,
    "stream_numbered": _NUMBERED,
    "select_ions_bitmap": f"{_HITS} voxel_id IN (SELECT voxel_id FROM s WHERE score >= 60)",
    "select_ions_bitmap_inverted": f"{_HITS} voxel_id NOT IN (SELECT voxel_id FROM s WHERE score >= 60)",
    "select_ions_bitmap_all": f"{_HITS} voxel_id IN (SELECT voxel_id FROM s WHERE score >= 0)",
    "stream_select_bitmap": f"{_HITS} voxel_id IN (SELECT voxel_id FROM s WHERE score >= 60)",
    "clustered_blocks": f"SELECT (voxel_id % 10 // 5 + voxel_id // 10 % 6 // 2 * 2 + voxel_id // 60 // 2 * 6)::INT AS block, count(*) AS n FROM (SELECT {_CELL} AS voxel_id FROM lineitem) GROUP BY 1",
    "select_ions_clustered": f"{_HITS} voxel_id IN (SELECT voxel_id FROM s WHERE score >= 60)",
    "select_ions_clustered_inverted": f"{_HITS} voxel_id NOT IN (SELECT voxel_id FROM s WHERE score >= 60)",
}
