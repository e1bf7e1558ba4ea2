"""WARC archives with revisit resolution.

Headers - payload digest, length, key, address - are shuffled by digest to find each repeated payload's original and
are joined to it; payloads stay where they are. A revisit record has no payload, so it is written from its header
alone; responses are written from the rows that no header calls a revisit. Archives are written with fresh headers by
Spark's own writer into the shared folder. Reading parses them by Content-Length alone.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import counted_join, read, shared_dir, staged

#: Payloads of fewer bytes are always written whole.
LEAST_BYTES = 1000
#: Records and bytes of payload of one archive file at most, which bounds what a reading task holds.
FILE_RECORDS, FILE_BYTES = 2_000, 256 << 20
#: Revisits up to which their keys are held in every task; more are joined by shuffle.
HELD_REVISITS = 2_000_000
CRLF = "\r\n"
PIECE = 1 << 20


def headers_of(pages: DataFrame, *, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """key, url, payload_bytes, payload_digest and the payload of every row; null html is an empty payload."""
    address = F.col(url) if url in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(key).alias("key"), address.alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    return rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1(F.col("payload").cast("binary")))


def revisits(headers: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """key, url, payload_bytes, payload_digest, refers_to of the rows that revisit another, from headers alone, staged.

    Of equal payloads of ``least`` bytes or more the largest key is the response; rows that tie on it, or whose key is
    null where all are null, are responses too. A digest of very many rows is joined by broadcast.
    """
    own = staged(headers.where(F.col("payload_bytes") >= least).select("key", "url", "payload_bytes", "payload_digest"), "headers")
    originals = own.groupBy("payload_digest").agg(F.max("key").alias("refers_to"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    joined = counted_join(own, originals, "payload_digest", own.count()).drop("n")
    return staged(joined.where(F.col("refers_to").isNotNull() & ~F.col("key").eqNullSafe(F.col("refers_to"))), "revisits")


def resolved(pages: DataFrame, *, key: str = "page_id", html: str = "html", url: str = "url", least: int = LEAST_BYTES) -> DataFrame:
    """Rows key, url, payload (null of revisits), payload_bytes, payload_digest, record_type, refers_to.

    All rows of one key and digest are of one type, so the pair tells which rows are revisits.
    """
    rows = headers_of(pages, key=key, html=html, url=url)
    again = revisits(rows, least)
    names = again.select(F.col("key").alias("__key"), F.col("payload_digest").alias("__digest")).distinct()
    names = F.broadcast(names) if again.count() <= HELD_REVISITS else names
    responses = rows.join(names, (F.col("payload_digest") == F.col("__digest")) & F.col("key").eqNullSafe(F.col("__key")), "left_anti")
    first = responses.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast(again.schema["refers_to"].dataType)})
    return first.unionByName(again.withColumns({"record_type": F.lit("revisit"), "payload": F.lit(None).cast("string")}))


def record(rows: DataFrame, date: str) -> DataFrame:
    """One string column: each row as a WARC/1.1 record without its last CRLF CRLF."""

    def uri(column: str) -> F.Column:
        return F.regexp_replace(F.coalesce(F.col(column), F.lit("urn:none")), r"[\x00-\x20]", "%20")

    def record_id(column: str) -> F.Column:
        h = F.sha1(F.concat(F.lit("page "), F.coalesce(F.col(column).cast("string"), F.lit("none"))).cast("binary"))
        return F.concat(F.lit("<urn:uuid:"), *[x for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.lit("-" if i > 1 else ""), F.substring(h, i, n))], F.lit(">"))

    def header(name: str, value: F.Column) -> F.Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    is_response = F.col("record_type") == "response"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.when(is_response, F.concat(http, F.coalesce("payload", F.lit("")))).otherwise(http)
    fields = [
        F.lit(f"WARC/1.1{CRLF}"),
        header("WARC-Type", F.col("record_type")),
        header("WARC-Record-ID", record_id("key")),
        header("WARC-Date", F.lit(date)),
        header("WARC-Target-URI", uri("url")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(is_response, F.lit("")).otherwise(
            F.concat(header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), header("WARC-Refers-To", record_id("refers_to")), header("X-Refers-To-Key", F.coalesce(F.col("refers_to").cast("string"), F.lit(""))))
        ),
        header("X-Key", F.coalesce(F.col("key").cast("string"), F.lit(""))),
        header("X-Payload-Length", F.col("payload_bytes").cast("string")),
        header("Content-Type", F.lit("application/http; msgtype=response")),
        header("Content-Length", F.octet_length("block").cast("string")),
        F.lit(CRLF),
        F.col("block"),
    ]
    return rows.withColumn("block", block).select(F.concat(*fields).alias("value"))


def write_archives(pages: DataFrame, path: str | None = None, *, date: str = "2024-01-01T00:00:00Z", records: int = FILE_RECORDS, size: int = FILE_BYTES, **names) -> str:
    """Write deduplicated gzip archives of ``pages`` under ``path`` (default: the shared folder).

    A file holds at most ``records`` records, and so few that they stay under ``size`` bytes of payload even if all are as
    large as the largest; a larger single record has a file of its own.
    """
    path = path or f"{shared_dir(pages.sparkSession).rstrip('/')}/factloom/warc-{uuid.uuid4().hex}"
    rows = resolved(pages, **names)
    html = names.get("html", "html")
    largest = pages.agg(F.max(F.octet_length(html))).first()[0] or 0
    few = max(1, min(records, size // (largest + 1)))
    record(rows, date).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", few).option("compression", "gzip").text(path)
    return path


HEAD_END = b"\r\n\r\n"


def inflated(content: bytes) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, in pieces."""
    data = memoryview(content)
    while len(data):
        unzip = zlib.decompressobj(31)
        while not unzip.eof and len(data):
            out = unzip.decompress(data, PIECE)
            data = memoryview(unzip.unconsumed_tail) if unzip.unconsumed_tail else memoryview(unzip.unused_data)
            if out:
                yield out
        tail = unzip.flush()
        if tail:
            yield tail


def records_of(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive; raises on a broken one."""
    held = bytearray()

    def need(n: int) -> bool:
        for piece in pieces:
            held.extend(piece)
            if len(held) >= n:
                break
        return len(held) >= n

    while True:
        while (end := held.find(HEAD_END)) < 0:
            if not need(len(held) + 1):
                if held.strip():
                    raise ValueError("an archive ends inside a header")
                return
        lines = bytes(held[:end]).decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        head = {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        if len(held) < end + 4 + size + 4 and not need(end + 4 + size + 4):
            raise ValueError("an archive ends inside a record")
        yield head, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 8 + size]


def parsed(content: bytes) -> Iterator[tuple]:
    """(key, payload_bytes, payload_digest, record_type, refers_to) of each record of a gzip archive."""
    for head, block in records_of(inflated(content)):
        kind, stated = head["warc-type"], re.sub("^sha1:", "", head["warc-payload-digest"])
        size = int(head["x-payload-length"])
        if kind == "response":
            payload = block[block.index(HEAD_END) + 4 :]
            found = hashlib.sha1(payload).hexdigest()
            if found != stated or len(payload) != size:
                raise ValueError(f"record {head['warc-record-id']}: the payload is not what its header states")
        key, refers = head["x-key"], head.get("x-refers-to-key")
        yield (key or None, size, stated, kind, refers or None)


def read_archives(spark: SparkSession, path: str, *, key: str = "page_id", key_type: str = "long") -> DataFrame:
    """Records of the archives under ``path``; responses are checked against digest and length. A key that was an empty
    string reads as null; an empty folder of archives gives no rows."""

    def rows(batches):
        for batch in batches:
            for content in batch.column(0):
                found = list(zip(*parsed(content.as_py())))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["k", "b", "d", "t", "r"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    found = files.mapInArrow(rows, "k string, b long, d string, t string, r string")
    return found.select(F.col("k").cast(key_type).alias(key), F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"), F.col("t").alias("record_type"), F.col("r").cast(key_type).alias("refers_to"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from its archives."""
    return read_archives(spark, write_archives(read(spark, sf_dir, "pages")))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN g.original IS NOT NULL AND p.page_id IS DISTINCT FROM g.original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.original IS NOT NULL AND p.page_id IS DISTINCT FROM g.original THEN g.original END AS refers_to
FROM p LEFT JOIN g ON g.payload_digest = p.payload_digest
"""
