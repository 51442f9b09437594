"""Row numbers that go on from one appended batch to the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .log import Log, store_rows, stored_rows
from .tables import assign_ion_id


class NumberedTable:
    """A table of batches whose rows are numbered from 0 without gaps over all batches.

    Each batch is one record (source, batch, start, rows, where its rows are); the high-water mark is where the last one ends. Within a
    batch numbers follow the order columns. A batch that is given again, as after a failure, keeps the numbers it has: nothing is written. Two
    writers at once get their numbers one after the other: who comes second shifts what it has written.
    """

    def __init__(self, spark: SparkSession, path: str, name: str = "ion_id"):
        self.spark, self.path, self.name = spark, path.rstrip("/"), name
        self.log = Log(spark, f"{self.path}/_batches")

    def mark(self) -> int:
        """The number that the next row gets."""
        last = self.log.last()
        return 0 if last is None else self._end(self.log.get(last))

    @staticmethod
    def _end(record: dict) -> int:
        return record["start"] + record["rows"]

    def _have(self, source: str, batch: int) -> dict | None:
        """The record of a batch; batches of a source ascend, so the search ends at an earlier one."""
        for n in reversed(self.log.numbers()):
            record = self.log.get(n)
            if record["source"] == source and record["batch"] <= batch:
                return record if record["batch"] == batch else None
        return None

    def append(self, df: DataFrame, order_cols: list[str], batch: int, source: str = "") -> tuple[int, int]:
        """Adds a batch; returns its first number and number of rows. batch: ascending numbers of a source's batches."""
        if have := self._have(source, batch):
            return have["start"], have["rows"]
        numbered, mark = assign_ion_id(df, order_cols, self.name), self.mark()
        while True:
            kept = store_rows(numbered.withColumn(self.name, F.col(self.name) + F.lit(mark)), f"{self.path}/data/{uuid.uuid4().hex}")
            rows = stored_rows(self.spark, [kept]).count()
            last = self.log.last()
            start = 0 if last is None else self._end(self.log.get(last))
            if start == mark and self.log.add(0 if last is None else last + 1, {"source": source, "batch": batch, "start": start, "rows": rows, **kept}):
                return start, rows
            self.log.remove(kept["path"])  # another batch came first
            mark = self.mark()

    def writer(self, order_cols: list[str], source: str = "") -> Callable[[DataFrame, int], None]:
        """A function for ``foreachBatch``: numbers each micro-batch once, also when it is run again."""

        def write(df: DataFrame, batch: int) -> None:
            self.append(df, order_cols, batch, source)

        return write

    def read(self) -> DataFrame:
        """All rows that are there now. Raises ValueError before the first batch."""
        records = [self.log.get(n) for n in self.log.numbers()]
        if not records:
            raise ValueError(f"no batch in {self.path}")
        return stored_rows(self.spark, records)
