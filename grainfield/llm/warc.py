"""WARC archives: writing captures as records, reading archives back, and assembling transactions.

A capture is three records: a response (or a revisit, which has no payload of its own), a request and a metadata
record, of which the latter two name the first in WARC-Concurrent-To. ``write`` makes them with built-in functions and
Spark's text writer, whose line separator is the end of a record; so archives go to any store that Spark writes to.
``read`` takes whole archive files of bounded size and parses records by their lengths. ``assemble`` joins requests and
metadata to their captures, and revisits to the response they refer to, and gives one nested row a capture.

Payloads of at least ``smallest`` bytes that are equal are kept once: the capture with the smallest page id (null last, then
the first in the input's order) is the response, the others revisit it.

Nulls and odd cases: a null html is an empty payload; null urls and ids are left out of the records and are null when
read back; line ends in a url become %0D and %0A. Repeated rows are captures of their own. An archive that ends inside a record, or a record without a
valid length, raises ValueError. Empty tables give empty archives and results. Other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, written

# fixed values: record syntax
VERSION, EOL = "WARC/1.1", "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_id(*parts: Column) -> Column:
    """A URN made from a digest of the parts."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def _record(kind: Column, headers: dict[str, Column], block: Column) -> Column:
    lines = [F.concat(F.lit("WARC-Type: "), kind)] + [F.concat(F.lit(f"{k}: "), v) for k, v in headers.items()]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws(EOL, F.lit(VERSION), *lines, length), F.lit(EOL + EOL), block)  # null headers are left out


def captures(pages: DataFrame, smallest: int = 100) -> DataFrame:
    """(page_id, url, html, uid, digest) of each row of pages (page_id, url, html), with the response that it revisits, if any, in first_page
    and first_uid. The rows are written once with their numbers, so that all that is made of them agrees."""
    url = F.regexp_replace(F.regexp_replace(F.col("url").cast("string"), "\r", "%0D"), "\n", "%0A")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), F.monotonically_increasing_id().alias("uid"))
    own = written(own.withColumn("digest", F.sha2("html", 256)), "warc-pages")
    large = own.where(F.octet_length("html") >= smallest).select("digest", "page_id", "uid")
    # copies meet as one aggregate row in each task before any shuffle; with equal ids the smaller number is first
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "uid")
    first = large.groupBy("digest").agg(F.min(order).alias("f"), F.count("*").alias("n")).where("n > 1")
    first = written(first.select("digest", F.col("f.page_id").alias("first_page"), F.col("f.uid").alias("first_uid")), "warc-first")
    return own.join(first, "digest", "left")


def records(typed: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(value) three records for each row of ``captures``; see the module for which are revisits."""
    revisit = F.coalesce(F.col("uid") != F.col("first_uid"), F.lit(False))
    typed = typed.withColumn("revisit", revisit).withColumn("id", record_id(F.lit("capture"), F.col("page_id"), F.col("uid")))
    kind = F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))
    common = {"WARC-Target-URI": F.col("url"), "WARC-Date": F.lit(date)}
    refers = F.when(F.col("revisit"), record_id(F.lit("capture"), F.col("first_page"), F.col("first_uid")))
    capture = _record(
        kind,
        {"WARC-Record-ID": F.col("id"), **common, "WARC-Payload-Digest": F.concat(F.lit("sha256:"), "digest"), "WARC-Refers-To": refers, "WARC-Profile": F.when(F.col("revisit"), F.lit(PROFILE)), "Content-Type": F.lit("application/http;msgtype=response")},
        F.concat(F.lit(HTTP), F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html"))),
    )
    request = _record(
        F.lit("request"),
        {"WARC-Record-ID": record_id(F.lit("request"), F.col("page_id"), F.col("uid")), **common, "WARC-Concurrent-To": F.col("id"), "Content-Type": F.lit("application/http;msgtype=request")},
        F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")),
    )
    metadata = _record(
        F.lit("metadata"),
        {"WARC-Record-ID": record_id(F.lit("metadata"), F.col("page_id"), F.col("uid")), **common, "WARC-Concurrent-To": F.col("id"), "Content-Type": F.lit("application/warc-fields")},
        F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(EOL)), F.lit("")),
    )
    return typed.select(F.explode(F.array(request, capture, metadata)).alias("value"))


def write(pages: DataFrame, path: str, records_per_file: int = 6000, file_bytes: int = 1 << 28, date: str = "2024-01-01T00:00:00Z", smallest: int = 100) -> None:
    """Writes the captures of pages as gzipped archives of at most so many records, and of about so many bytes before they are packed, since
    a task of ``read`` takes whole files. Pages too long for as many records are classed by powers of two of their size, and each class's archives
    have half the records of the class before; so one long page sets no other page's archives."""
    typed = captures(pages, smallest)
    bound = file_bytes // records_per_file
    size = lambda html: F.greatest(F.lit(0), F.ceil(F.log2(F.octet_length(html) / bound))).cast("int")
    found = pages.select(F.coalesce(size(F.col("html").cast("string")), F.lit(0)).alias("k")).distinct().collect()  # some thirty at most
    for nth, k in enumerate(sorted(r["k"] for r in found) or [0]):
        own = typed.where(F.coalesce(size(F.col("html")), F.lit(0)) == k)
        out = records(own, date).write.option("lineSep", EOL + EOL).option("compression", "gzip").option("maxRecordsPerFile", max(1, records_per_file >> k))
        out.mode("append" if nth else "errorifexists").text(path)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers, with lower-case names, and block of each record of an archive, gzipped or plain. It is unpacked as records are taken: a
    megabyte is held besides a record."""
    source = gzip.GzipFile(fileobj=io.BytesIO(archive)) if archive[:2] == b"\x1f\x8b" else io.BytesIO(archive)
    held, at = bytearray(), 0

    def there(n: int) -> bool:
        while len(held) < n:
            more = source.read(max(1 << 20, n - len(held)))
            if not more:
                return False
            held.extend(more)
        return True

    while there(1):
        end = held.find(b"\r\n\r\n")
        while end < 0 and there(len(held) + 1):
            end = held.find(b"\r\n\r\n")
        head = held[:end].decode("utf-8", "replace").split(EOL) if end > 0 else [""]
        headers = dict((k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in head[1:]))
        if not head[0].startswith("WARC/") or not headers.get("content-length", "").isdigit():
            raise ValueError(f"no record at byte {at}")
        begin = end + 4
        stop = begin + int(headers["content-length"])
        if not there(stop):
            raise ValueError(f"the archive ends inside the record at byte {at + begin}")
        yield headers, memoryview(bytes(held[begin:stop]))
        there(stop + 4)
        del held[: stop + 4]
        at += stop + 4


_TEXTS = ["record_id", "record_type", "target_uri", "date", "concurrent_to", "refers_to", "declared_digest", "payload_digest", "fields"]


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row a record: ids, type, url, date, links, payload_bytes, digest as declared and as computed, text of the block of
    requests and metadata, and the payload of captures if asked for. The payload is what follows the HTTP header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                texts, sizes, payloads, held = [], [], [], 0
                for h, block in parse(archive.as_py()):
                    capture = h.get("warc-type") in ("response", "revisit", "resource")
                    start = 0
                    if h.get("content-type", "").startswith("application/http") and capture:
                        start = bytes(block).find(b"\r\n\r\n") + 4
                    payload = block[start:]
                    digest = h.get("warc-payload-digest")
                    texts.append((h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), digest and digest.rpartition(":")[2], hashlib.sha256(payload).hexdigest() if capture else None, None if capture else bytes(block).decode("utf-8", "replace")))
                    sizes.append(len(payload))
                    if with_payload:
                        payloads.append(bytes(payload) if capture else None)
                        held += len(payload)
                    if len(sizes) >= 2000 or held > 1 << 24:
                        yield frame(texts, sizes, payloads)
                        texts, sizes, payloads, held = [], [], [], 0
                if sizes:
                    yield frame(texts, sizes, payloads)

    def frame(texts: list, sizes: list, payloads: list) -> pa.RecordBatch:
        columns = [pa.array(c, pa.string()) for c in zip(*texts, strict=True)]
        more = [pa.array(payloads, pa.binary())] if with_payload else []
        return pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), *more], names=[*_TEXTS, "payload_bytes", *(["payload"] if with_payload else [])])

    schema = ", ".join(f"{c} string" for c in _TEXTS) + ", payload_bytes long" + (", payload binary" if with_payload else "")
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def assemble(rows: DataFrame) -> DataFrame:
    """(record_id, record_type, target_uri, response, requests, metadata, original): one nested row a capture.

    response: size and digests of the own payload; requests, metadata: the records that name the capture in
    WARC-Concurrent-To; original: for revisits, size, digest and metadata of the response referred to.
    """
    own = rows.where(F.col("record_type").isin("response", "revisit"))
    kept = [c for c in rows.columns if c in ("payload_bytes", "payload_digest", "declared_digest", "payload")]
    captures = own.select("record_id", "record_type", "target_uri", "date", "refers_to", F.struct(*kept).alias("response"))
    linked = rows.where(F.col("record_type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    group = [F.sort_array(F.collect_list(F.when(F.col("record_type") == k, F.struct("record_id", "fields")))).alias(n) for k, n in (("request", "requests"), ("metadata", "metadata"))]
    linked = linked.groupBy(F.col("concurrent_to").alias("record_id")).agg(*group)
    captures = captures.join(linked, "record_id", "left")
    revisits = captures.where("record_type = 'revisit'")
    names = ["record_id", "record_type", "target_uri", "date", "response", "requests", "metadata"]
    originals = captures.where("record_type = 'response'").join(revisits.select(F.col("refers_to").alias("record_id")).distinct(), "record_id", "left_semi")
    originals = written(originals.select(F.col("record_id").alias("refers_to"), F.struct("response.payload_bytes", "response.payload_digest", "metadata").alias("original")), "warc-originals")
    alone = captures.where("record_type = 'response'").select(*names, F.lit(None).cast(originals.schema["original"].dataType).alias("original"))
    return alone.union(revisits.join(originals, "refers_to", "left").select(*names, "original"))


def page_id(metadata: Column) -> Column:
    """The page id that a capture's metadata records hold."""
    return F.regexp_extract(F.coalesce(F.get(metadata, F.lit(0))["fields"], F.lit("")), r"page-id: (-?\d+)", 1).try_cast("long")


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    path = scratch_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    rows = written(read(spark, path), "warc-records")
    revisit = F.col("record_type") == "revisit"
    return assemble(rows).select(
        page_id(F.col("metadata")).alias("page_id"),
        F.when(revisit, F.col("original.payload_bytes")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("original.payload_digest")).otherwise(F.col("response.payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(revisit, page_id(F.col("original.metadata"))).alias("refers_to"),
    )


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
