"""Versions of a model's results, so that a job may save while others read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .log import Log, store_rows, stored_rows


class Snapshots:
    """Tables below a path in numbered versions.

    ``publish`` writes tables to folders of their own and then adds one record that names them: the new version is there as a whole
    or not at all, and nothing that an earlier version reads is touched. A reader keeps the version that it began with. ``expire`` deletes old
    versions when nobody needs them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = Log(spark, f"{self.path}/_versions")

    def publish(self, carry: bool = True, **tables: DataFrame) -> int:
        """Writes tables as the next version and returns its number. With carry, tables of the version before that are not given again
        belong to the new one too."""
        own = {name: store_rows(df, f"{self.path}/data/{uuid.uuid4().hex}/{name}") for name, df in tables.items()}
        while True:
            last = self.log.last()
            before = self.log.get(last)["tables"] if carry and last is not None else {}
            number = 0 if last is None else last + 1
            if self.log.add(number, {"tables": before | own}):
                return number

    def latest(self) -> int:
        """Number of the newest version. Raises ValueError where there is none."""
        last = self.log.last()
        if last is None:
            raise ValueError(f"no version in {self.path}")
        return last

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table of a version, the newest if none is given. Raises ValueError without such a version or table."""
        version = self.latest() if version is None else version
        record = self.log.get(version)
        if record is None or name not in record["tables"]:
            raise ValueError(f"no {name} in version {version} of {self.path}")
        return stored_rows(self.spark, [record["tables"][name]])

    def expire(self, keep: int) -> list[int]:
        """Deletes all versions but the newest keep, and the data that no other version names; returns their numbers."""
        if keep < 1:
            raise ValueError("the newest version stays")
        numbers = self.log.numbers()
        old, stay = numbers[:-keep], numbers[-keep:]
        records = {n: self.log.get(n) for n in numbers}
        needed = {t["path"] for n in stay for t in records[n]["tables"].values()}
        for n in old:
            self.log.drop(n)  # the record first: no reader finds a version whose data is going
        for path in {t["path"] for n in old for t in records[n]["tables"].values()} - needed:
            self.log.remove(path)
        return old
