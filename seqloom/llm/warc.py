"""Content-addressed WARC archive: payload bytes once by digest, exact headers apart, records by joins.

Tables of an archive: `headers` (rid, page_id, payload, type, refers_rid, head: the record's header block, exact),
`payloads` (payload: SHA-256 of the bytes, body), in buckets by payload, and `layout` (their number). A
record is head, body, CRLF CRLF.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import Work, chunks, tidy

VERSION = "WARC/1.1"  # fixed value
CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Digests that a task remembers; beyond them it hands on some bytes again.
SEEN = 500_000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id, rid: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}|{rid}'.encode()).digest(), version=5)}>"


def header(kind: str, page_id, rid: int, url: str | None, sha1: str, length: int, refers: str | None) -> bytes:
    """The header block with the empty line that ends it."""
    clean = "".join(c for c in url or "" if c not in "\r\n")
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, rid)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{sha1}"]
    if refers:
        lines += [f"WARC-Refers-To: {refers}", f"WARC-Profile: {REVISIT}"]
    lines.append(f"Content-Length: {0 if refers else length}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + CRLF + CRLF


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record; a length that does not fit raises ValueError."""
    head, mark, rest = record.partition(CRLF + CRLF)
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not mark or lines[0] != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != CRLF + CRLF:
        raise ValueError("the record's length does not fit its Content-Length")
    return fields, rest[:n]


def write_archive(pages: DataFrame, work: Work, least: int = 0, id_column: str = "page_id", url_column: str = "url", body_column: str = "html") -> None:
    """One record a row. Null payloads are empty, and null URLs too; other columns are not read. An empty table gives
    an empty archive.

    Of equal payloads of at least `least` bytes the row with the smallest id (nulls last, then the smallest row
    number) becomes the response and the others revisit it; smaller payloads are all responses. Groups of equal
    payloads meet only as (digest, smallest row), pre-aggregated, and a task hands on the bytes of a payload once, so
    a payload that a third of the rows share costs no more than any other. The pages are read twice, for the headers
    and for the bytes, so that bytes are written just once, by the one shuffle into the buckets that they stay in; a
    payload that the second reading lacks fails the records that need it.
    """
    spark = pages.sparkSession
    plain = pages.select(F.col(f"`{id_column}`").cast("long").alias("page_id"), F.col(f"`{url_column}`").alias("url"), F.col(f"`{body_column}`").cast("binary").alias("body"))
    plain = plain.withColumn("rid", F.monotonically_increasing_id())

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "body"):
            body = [x or b"" for x in b.column("body").to_pylist()]
            cols = [pa.array([hashlib.sha256(x).digest() for x in body], pa.binary()), pa.array([sha1_base32(x) for x in body]), pa.array([len(x) for x in body], pa.int64())]
            yield pa.record_batch([b.column("rid"), b.column("page_id"), b.column("url"), *cols], ["rid", "page_id", "url", "payload", "sha1", "length"])

    def bytes_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in chunks(batches, "body"):
            new = {}
            for x in b.column("body").to_pylist():
                d = hashlib.sha256(x or b"").digest()
                if d not in seen:
                    seen.add(d)
                    new[d] = x or b""
            if len(seen) > SEEN:
                seen.clear()
            yield pa.record_batch([pa.array(list(new), pa.binary()), pa.array(list(new.values()), pa.binary())], ["payload", "body"])

    rows = work.table("rows", plain.mapInArrow(tidy(facts), "rid long, page_id long, url string, payload binary, sha1 string, length long"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("late"), "page_id", "rid")).alias("first")
    owners = rows.groupBy("payload").agg(first).select(F.col("payload").alias("digest"), "first")
    # digests and headers only; a merge join, whose hot keys are split, at every size
    marked = rows.join(owners.hint("merge"), F.col("payload") == F.col("digest")).drop("digest")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.to_pydict()
            kinds, out = [], []
            for rid, page, url, sha1, length, own in zip(d["rid"], d["page_id"], d["url"], d["sha1"], d["length"], d["first"]):
                again = length >= least and own["rid"] != rid
                kinds.append("revisit" if again else "response")
                out.append(header(kinds[-1], page, rid, url, sha1, length, record_id(own["page_id"], own["rid"]) if again else None))
            to = [o["rid"] if k == "revisit" else None for o, k in zip(d["first"], kinds)]
            yield pa.record_batch([b.column("rid"), b.column("page_id"), b.column("payload"), pa.array(kinds), pa.array(to, pa.int64()), pa.array(out, pa.binary())], ["rid", "page_id", "payload", "type", "refers_rid", "head"])

    work.table("headers", marked.mapInArrow(tidy(heads), HEADERS))
    # of each payload's bytes, one of the copies that tasks handed on, in the buckets that reading joins by
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    work.table("layout", spark.createDataFrame([(n,)], "buckets int"))
    handed = plain.select("body").mapInArrow(tidy(bytes_once), "payload binary, body binary").repartition(n, "payload")
    kept = handed.groupBy("payload").agg(F.first("body").alias("body"))
    kept.write.insertInto(_payloads(spark, work, n))
    work.drop("rows")


def _payloads(spark: SparkSession, work: Work, buckets: int) -> str:
    """The name under which the session knows the archive's bucketed payloads."""
    name = "seqloom_" + re.sub(r"\W", "_", work.root.rstrip("/").rsplit("/", 1)[-1])
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({PAYLOADS}) USING parquet OPTIONS (compression 'zstd') CLUSTERED BY (payload) INTO {buckets} BUCKETS LOCATION '{work.root}/payloads'")
    return name


HEADERS = "rid long, page_id long, payload binary, type string, refers_rid long, head binary"
PAYLOADS = "payload binary, body binary"


def records(spark: SparkSession, work: Work) -> DataFrame:
    """rid, page_id, payload, type, refers_rid and the exact bytes of each record, joined from the archive. Headers
    are dealt out as the payloads' buckets are, so no payload moves."""
    empty = lambda s: spark.createDataFrame([], s).schema
    heads, buckets = work.read("headers", empty(HEADERS)), work.read("layout", empty("buckets int")).head()[0]
    body = spark.table(_payloads(spark, work, buckets)).select(F.col("payload").alias("digest"), "body").hint("merge")
    full = heads.filter("type = 'response'").join(body, F.col("payload") == F.col("digest"), "left")
    end = F.lit(CRLF + CRLF)
    full = full.select("rid", "page_id", "payload", "type", "refers_rid", F.concat("head", "body", end).alias("record"))
    rest = heads.filter("type = 'revisit'").select("rid", "page_id", "payload", "type", "refers_rid", F.concat("head", end).alias("record"))
    return full.union(rest)


def read_back(records_: DataFrame) -> DataFrame:
    """Parses records and verifies them: rid, page_id, kind, refers_rid, n, sha1, and for responses whether the
    payload has the digests that its header and the store claim; a mismatch fails the job."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, sizes, digests = [], [], []
            for record, want in zip(b.column("record"), b.column("payload").to_pylist()):
                fields, body = parse(record.as_py())
                claimed = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if fields["WARC-Type"] == "response" and (sha1_base32(body) != claimed or hashlib.sha256(body).digest() != want):
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
                kinds.append(fields["WARC-Type"])
                sizes.append(len(body) if kinds[-1] == "response" else None)
                digests.append(claimed)
            yield pa.record_batch([b.column("rid"), b.column("page_id"), b.column("refers_rid"), pa.array(kinds, pa.string()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], ["rid", "page_id", "refers_rid", "record_type", "n", "sha1"])

    return records_.mapInArrow(tidy(check), "rid long, page_id long, refers_rid long, record_type string, n long, sha1 string")


def write_files(records_: DataFrame, path: str) -> None:
    """Plain .warc files through Spark's committed writer: each record ends in the CRLF CRLF that the writer adds."""
    body = F.expr("substring(record, 1, octet_length(record) - 4)")
    records_.select(body.cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of .warc files, cut by their Content-Length; a file is read by one task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                data, at, out = content.as_py(), 0, []
                while at < len(data):
                    end = data.index(CRLF + CRLF, at) + 4
                    head = data[at:end].decode("utf-8", "surrogatepass")
                    n = int(next(x for x in head.split("\r\n") if x.startswith("Content-Length: "))[16:])
                    out.append(data[at : end + n + 4])
                    at = end + n + 4
                yield pa.record_batch([pa.array(out, pa.binary())], ["record"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(tidy(cut), "record binary")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every page's record, read back from the archive."""
    work = Work(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), work)
    rows = work.table("seen", read_back(records(spark, work)))
    first = rows.filter("record_type = 'response'").select(F.col("rid").alias("to_rid"), F.col("page_id").alias("to_page"), F.col("n").alias("to_n"))
    out = rows.join(first.hint("merge"), F.col("refers_rid") == F.col("to_rid"), "left")
    return out.select("page_id", F.coalesce("n", "to_n").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", F.col("to_page").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS o, row_number() OVER (PARTITION BY h ORDER BY page_id) AS k FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, i // 4 * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN o END AS refers_to
FROM d
"""
