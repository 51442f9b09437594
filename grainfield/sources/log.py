"""Numbered records beside a table: each is written once and never changed, so readers and repeated writers agree."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Log:
    """Records (dictionaries) by number in a folder of any file system that Spark reaches.

    A record is written aside and then renamed to its number, which fails where the number is taken. So of two writers of one number one wins,
    and a reader sees a record whole or not at all. (As safe as the file system's rename: atomic on HDFS; on a local disk, for one writer a
    moment.) Only names are listed; a record is read when asked for.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        where = self._path(self.folder)
        conf = spark._jsc.hadoopConfiguration()
        self._fs = where.getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri() if where.isAbsolute() and where.toUri().getScheme() else self._fs.getUri(), conf)
        none = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        self._never_replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        self._never_replace[0] = none

    def _name(self, number: int) -> str:
        return f"{self.folder}/{number:012}.json"

    def add(self, number: int, record: dict) -> bool:
        """Writes a record; False, without any change, if there is one of that number."""
        if number < 0:
            raise ValueError(f"numbers start at 0, not {number}")
        if self._fs.exists(self._path(self._name(number))):
            return False
        aside = self._path(f"{self.folder}/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, True)
        try:
            out.write(bytearray(json.dumps(record).encode()))
        finally:
            out.close()
        try:
            self._context.rename(aside, self._path(self._name(number)), self._never_replace)
        except Exception as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def get(self, number: int) -> dict | None:
        """The record of a number, or None."""
        where = self._path(self._name(number))
        if not self._fs.exists(where):
            return None
        data = self._fs.open(where)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(data)))
        finally:
            data.close()

    def numbers(self) -> list[int]:
        """All numbers, ascending."""
        where = self._path(self.folder)
        if not self._fs.exists(where):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(where)]
        return sorted(int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit())

    def last(self) -> int | None:
        """The largest number, or None."""
        return max(self.numbers(), default=None)

    def drop(self, number: int) -> None:
        """Deletes a record."""
        self._fs.delete(self._path(self._name(number)), False)

    def remove(self, path: str) -> None:
        """Deletes a folder of data that no record names any more."""
        self._fs.delete(self._path(path), True)


def store_rows(df: DataFrame, path: str) -> dict:
    """Writes df to a new folder; what a record keeps of it: path and schema, so that tables without rows or files read alike."""
    df.write.parquet(path)
    return {"path": path, "schema": df.schema.json()}


def stored_rows(spark: SparkSession, kept: list[dict]) -> DataFrame:
    """The rows of one or more folders of one schema."""
    from pyspark.sql.types import StructType

    return spark.read.schema(StructType.fromJson(json.loads(kept[0]["schema"]))).parquet(*[k["path"] for k in kept])
