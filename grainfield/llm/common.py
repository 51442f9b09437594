"""What the operators share: scratch tables, word counts, and words of Arrow text as arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step takes at a time (a longer text is a step of its own).
STEP_BYTES = 1 << 19
#: Removes a query's shuffle files as soon as its result is written.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The folder of the innermost ``scratch_folder`` of this thread.
_folder: ContextVar[str | None] = ContextVar("folder", default=None)


def _base(spark: SparkSession) -> str:
    """The shared folder: that of ``spark.checkpoint.dir``; where it is unset, a temporary folder of a local session. Raises ValueError on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        return spark.sparkContext.getCheckpointDir().rstrip("/")
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, inside the folder of the innermost ``scratch_folder``."""
    return f"{_folder.get() or _base(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what is at a path of the shared folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch_folder(spark: SparkSession, name: str):
    """Gathers the scratch tables made inside in one folder, which is deleted at the end."""
    path = scratch_path(spark, name)
    before = _folder.set(path)
    try:
        yield
    finally:
        _folder.reset(before)
        remove(spark, path)


def stored(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df as a Parquet table at path, read back: its lineage ends there, whatever executor is lost later. Its shuffles go at once."""
    spark = df.sparkSession
    clean = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(_CLEAN, clean)
    return spark.read.schema(df.schema).parquet(path).select(*[F.col(f"`{c}`") for c in df.columns])


#: Rows of a table that one task writes, and of a table smaller than that for each core.
TASK_ROWS, FEW_ROWS = 1 << 16, 1 << 13


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """df in a task for every FEW_ROWS of at most rows up to one a core, then for every TASK_ROWS: a small table takes no more tasks, and files, than it is worth."""
    return df.coalesce(max(1, min(df.sparkSession.sparkContext.defaultParallelism, rows // FEW_ROWS), rows // TASK_ROWS))


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df as a table in the shared folder, read back; in few tasks where a bound of its rows is given."""
    return stored(df if rows is None else few_tasks(df, rows), scratch_path(df.sparkSession, name))


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(MULT), -1, 1 << 64))
_pow = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _pow.get(int(base))
    if have is None or len(have) < n:
        m = max(n, 1 << 16)
        have = np.full(m, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if m <= 4 * STEP_BYTES:
            _pow[int(base)] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def steps(texts: pa.Array, size: int = 0) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of a string array in slices of about size bytes, STEP_BYTES if not given."""
    texts = texts.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + (size or STEP_BYTES), "right")) - 1)
        yield i, texts.slice(i, j - i)
        i = j


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large_string array one after another, and where each text starts and the last ends. Null: empty."""
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = texts.buffers()[2]
    if texts.null_count:
        valid = texts.is_valid().to_numpy(zero_copy_only=False)
        if ((off[1:] > off[:-1]) & ~valid).any():
            return utf8(texts.fill_null(""))
    if buf is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(buf, np.uint8)[off[0] : off[-1]], off - off[0]


class Words:
    """Words of a slice of texts: byte bounds, the row each is of, and a 64-bit hash.

    starts, ends: byte positions; row: index of the text, ascending; hash: uint64; data: the bytes;
    first: first word of each row and, at the end, the number of words.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        data, off = utf8(texts)
        if lower:
            data = _LOWER[data]
        n = len(data)
        space = _SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        begin = ~space
        begin[1:] &= space[:-1] | edge[1:n]
        stop = ~space
        stop[:-1] &= space[1:] | edge[1:n]
        self.data, self.offsets = data, off
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.starts, off)
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.first))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(MULT, n), out=total[1:])
        h = (total[self.ends] - total[self.starts]) * powers(_INV, n + 1)[self.starts]
        self.hash = mix64(h ^ ((self.ends - self.starts).astype(np.uint64) << np.uint64(48)))

    def grams(self, k: int, seed: int = 0) -> np.ndarray:
        """Hash of the k words from each place on where all k follow (also across rows: see ``same``)."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        base = np.uint64((0xD6E8FEB86659FD93 + 2 * seed) & (2**64 - 1) | 1)
        total = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(mix64(self.hash + np.uint64(seed)) * powers(base, len(self.hash)), out=total[1:])
        inv = np.uint64(pow(int(base), -1, 1 << 64))
        return mix64((total[k:] - total[:-k]) * powers(inv, n))

    def same(self, k: int) -> np.ndarray:
        """Whether the k words from each place on are all of one row."""
        return self.row[k - 1 :] == self.row[: len(self.row) - k + 1] if len(self.row) >= k else np.zeros(0, bool)

    def runs(self, seed: int) -> RunHash:
        """Hashes of runs of words of any length."""
        return RunHash(self.hash, seed)


class RunHash:
    """Hashes of any runs of words, from sums over all words before each place."""

    def __init__(self, hashes: np.ndarray, seed: int):
        self.base = np.uint64((0xA0761D6478BD642F + 2 * seed) & (2**64 - 1) | 1)
        self.total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix64(hashes + np.uint64(seed)) * powers(self.base, len(hashes)), out=self.total[1:])
        self.inv = powers(np.uint64(pow(int(self.base), -1, 1 << 64)), len(hashes) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.total[end] - self.total[start]) * self.inv[start] + (end - start).astype(np.uint64))


def slide(a: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op (minimum or maximum) over each width neighbours."""
    span = 1
    while 2 * span <= width:
        a = op(a[:-span], a[span:])
        span *= 2
    return op(a[: len(a) - (width - span)], a[width - span :]) if width > span else a


def pack(a: np.ndarray) -> bytes:
    """A column as compressed planes of the bytes of 64-bit numbers."""
    import zstandard

    planes = np.ascontiguousarray(a if a.dtype.itemsize == 8 else a.astype(np.int64)).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes, kind=np.int64) -> np.ndarray:
    """The column that ``pack`` was given."""
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def hash_parts(h: np.ndarray, n: int) -> np.ndarray:
    """Partition of each 64-bit hash, ascending with it."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
