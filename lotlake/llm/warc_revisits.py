"""Operator 1: WARC archives in which repeated payloads are revisit records.

Only headers (id, payload digest, size) are shuffled by digest to find each payload's first record;
the pages then meet their decision by page id, and the archive is written by Spark's text writer,
whose line separator is the two line ends that close a WARC record. A file holds FILE_RECORDS small records
or one large one, so its bytes are bounded. Reading streams through a file by Content-Length and holds no record.
"""

from __future__ import annotations

import datetime
import gzip
import hashlib
import io
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotlake.llm.common import Scratch, hex_sha256, table

#: Payloads below this many bytes are never revisits.
LEAST_BYTES = 100
#: Records per archive file, and payload bytes above which a record has a file to itself.
FILE_RECORDS, LARGE = 1_000, 256 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = re.compile(rb"<urn:page:(-?\d+|null):([0-9a-f]{64})(?::\d+)?>")
READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string"


def decisions(pages: DataFrame, scratch: Scratch, least: int = LEAST_BYTES) -> DataFrame:
    """Rows (page_id, payload_digest, refers_to) of the records that revisit another, each once.

    The smallest page_id of a payload is the original. Grouping combines on the map side, so a digest that
    a third of all rows share moves as one row per task; its groups are stored, so both sides of the
    join are plain shuffles that adaptive execution can split. Rows without page_id never take part.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    heads = pages.select("page_id", hex_sha256(payload).alias("payload_digest"), F.octet_length(payload).alias("n")).where((F.col("n") >= least) & F.col("page_id").isNotNull())
    groups = heads.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last")
    groups = scratch.save(groups.select("payload_digest", "refers_to"), "groups")
    return heads.join(groups, "payload_digest").where("page_id > refers_to").select("page_id", "payload_digest", "refers_to").distinct()


def write_archives(pages: DataFrame, scratch: Scratch, path: str, least: int = LEAST_BYTES, file_records: int = FILE_RECORDS, large: int = LARGE) -> None:
    """One WARC/1.1 record per row of `pages` (page_id, url, html), in gzip files under `path`.

    A null html is an empty payload, a null url an empty target. Of repeated rows with the smallest
    page_id each is a response; a null page_id is always a response. Record ids are made of page id and digest, with a
    number behind them for repeated rows and for rows without an id, so they are unique and a rerun makes the same. An empty table gives no record.
    The date of the fresh records is that of the job, as the input has none.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), hex_sha256(payload).alias("payload_digest"))
    # rows without an id decide nothing and take no part in the shuffle: many of them may share a payload
    none = rows.where(F.col("page_id").isNull()).withColumn("refers_to", F.lit(None).cast(pages.schema["page_id"].dataType))
    rows = rows.where(F.col("page_id").isNotNull()).join(decisions(pages, scratch, least), ["page_id", "payload_digest"], "left")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    record = lambda page, end: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), F.col("payload_digest"), end)
    copy = F.row_number().over(Window.partitionBy("page_id", "payload_digest").orderBy("url"))  # dealt by these keys already
    rows = rows.withColumn("end", F.when(copy > 1, F.concat(F.lit(":"), copy.cast("string"), F.lit(">"))).otherwise(">"))
    none = none.withColumn("end", F.concat(F.lit(":"), F.monotonically_increasing_id().cast("string"), F.lit(">")))
    rows = rows.unionByName(none.select(rows.columns))
    now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisit = F.col("refers_to").isNotNull()
    # control characters and blanks can't stand in a header line
    target = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "[\\x00-\\x20\\x7f]+", "%20")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.octet_length("payload").cast("string")), F.lit("\r\n")
    )
    block = F.concat("http", F.when(revisit, "").otherwise(F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record(F.col("page_id"), F.col("end"))),
        line("WARC-Date", F.lit(now)),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record(F.col("refers_to"), F.lit(">"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    out = rows.withColumn("http", http).withColumn("block", block).select((F.octet_length("payload") > large).alias("large"), F.concat(head, "block").alias("value"))
    write = lambda part, records, to: part.select("value").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records).text(f"{path}/{to}")
    write(out.where("NOT large"), file_records, "small")
    if not pages.where(F.octet_length("html") > large).isEmpty():
        write(out.where("large"), 1, "large")


def _lines(stream) -> list[bytes]:
    """Header lines up to the empty one."""
    return list(itertools.takewhile(lambda x: x not in (b"\r\n", b""), iter(stream.readline, None)))


def _read(content: bytes):
    """A dict for each record of an archive file, which is decompressed as it is read."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)))
    while head := _lines(stream):
        if not head[0].startswith(b"WARC/"):
            raise ValueError("no WARC record where one should start")
        fields = dict(x.rstrip(b"\r\n").split(b": ", 1) for x in head[1:])
        kind, own = fields[b"WARC-Type"].decode(), _RECORD.fullmatch(fields[b"WARC-Record-ID"])
        digest = fields[b"WARC-Payload-Digest"].removeprefix(b"sha256:").decode()
        http = _lines(stream)
        size = int(next(x for x in http if x.startswith(b"Content-Length: "))[16:])
        left = length = int(fields[b"Content-Length"]) - sum(map(len, http)) - 2
        found = hashlib.sha256()
        while left > 0:
            part = stream.read(min(left, 1 << 20))
            if not part:
                raise ValueError("a WARC record doesn't end where it says")
            found.update(part)
            left -= len(part)
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record doesn't end where it says")
        refers = None
        if kind == "revisit":
            refers = int(_RECORD.fullmatch(fields[b"WARC-Refers-To"])[1])
        elif (size, digest) != (length, found.hexdigest()):
            raise ValueError("a payload differs from its headers")
        yield {
            "page_id": None if own[1] == b"null" else int(own[1]),
            "url": fields[b"WARC-Target-URI"].decode(),
            "payload_bytes": size,
            "payload_digest": digest,
            "record_type": kind,
            "refers_to": refers,
            "record_id": fields[b"WARC-Record-ID"].decode(),
        }


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under `path`; payloads of responses are held against size and digest."""

    def run(batches):
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string())])
        for batch in batches:
            for content in batch.column(0):
                records = _read(content.as_py())
                while some := list(itertools.islice(records, 1_000)):
                    yield pa.RecordBatch.from_pylist(some, schema=schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, READ_SCHEMA)


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    path = scratch.path("archives")
    write_archives(table(spark, sf_dir, "pages"), scratch, path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM f
"""
