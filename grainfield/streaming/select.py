"""Phase selection on a stream of ions against scores fitted beforehand."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.grid import GridSpec
from ..operators.select import select_ions
from ..sources.log import Log, store_rows, stored_rows
from ..sources.snapshots import Snapshots


def select_stream(ions: DataFrame, scores: DataFrame, grid: GridSpec, component: int = 0, isovalue: float = 1.0, invert: bool = False, bounds: str = "wrap") -> DataFrame:
    """The selected rows of a stream of ions: a stateless stream-static join, so each micro-batch yields its rows at once."""
    if not ions.isStreaming or scores.isStreaming:
        raise ValueError("ions must be a stream, and scores a table")
    return select_ions(ions, scores, grid, component, isovalue, invert, bounds)


def to_parquet(selected: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts writing a stream to Parquet, exactly once; with available_now it ends when the input there is has been read."""
    writer = selected.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def select_newest(ions: DataFrame, results: Snapshots, grid: GridSpec, path: str, checkpoint: str, component: int = 0, isovalue: float = 1.0, invert: bool = False, bounds: str = "wrap", available_now: bool = True) -> StreamingQuery:
    """Starts a selection in which each micro-batch uses the newest version of ``scores`` that there is when it begins.

    The version is noted under the batch's number before the batch runs, so a batch that is run again, after a failure, takes the same scores
    and gives the same rows; versions must stay until then. A finished batch is noted too and never written twice. ``read_selected``
    reads the rows, with the version that chose them.
    """
    if not ions.isStreaming:
        raise ValueError("ions must be a stream")
    path = path.rstrip("/")

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done, pinned = Log(spark, f"{path}/_batches"), Log(spark, f"{path}/_versions")
        if done.get(number) is not None:
            return
        own = Snapshots(spark, results.path)
        pinned.add(number, {"version": own.latest()})
        version = pinned.get(number)["version"]
        picked = select_ions(batch, own.read("scores", version), grid, component, isovalue, invert, bounds)
        done.add(number, store_rows(picked.withColumn("version", F.lit(version)), f"{path}/data/{uuid.uuid4().hex}"))

    writer = ions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_selected(spark: SparkSession, path: str) -> DataFrame:
    """All rows that finished batches have chosen, with ``version``. Raises ValueError before the first one."""
    log = Log(spark, f"{path.rstrip('/')}/_batches")
    kept = [log.get(n) for n in log.numbers()]
    if not kept:
        raise ValueError(f"no batch in {path}")
    return stored_rows(spark, kept)
