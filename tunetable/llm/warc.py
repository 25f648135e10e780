"""WARC archives with revisit resolution.

Records with equal payloads (by SHA-1, shuffled as headers without payloads) keep one response, that with
the largest page_id; the others become revisit records that refer to it. Only digests that occur
more than once are joined to the records, so payloads are not shuffled while that table is small
enough to be broadcast. Archives are written by Spark's text writer in its usual commit protocol, one
record per row with CRLF CRLF between records, gzipped; records are read by their Content-Length, so a
payload may hold anything. Reading joins revisits to the responses that they name.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunetable.llm.base import checked, table
from tunetable.session import scratch_path, ship_package, written

#: Equal payloads of at least so many bytes are resolved.
LEAST_BYTES = 0
RECORDS_PER_FILE = 4000
#: The pages have no capture time; records carry this one.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"

RECORDS = (
    "record_id string, record_type string, page_id long, target_uri string, payload_bytes long, "
    "payload_digest string, refers_to_id string, payload binary"
)


def base32_of_hex(hexadecimal: Column) -> Column:
    """Bare upper-case base32 of a 160-bit value in hexadecimal: four letters per five digits."""

    def letter(i: Column) -> Column:
        digits = F.substring(hexadecimal, F.floor(i / 4).cast("int") * 5 + 1, F.lit(5))
        value = F.conv(digits, 16, 10).cast("int")
        place = F.lit(3) - i % 4
        five = F.floor(value / F.pow(F.lit(32), place)).cast("int") % 32
        return F.substring(F.lit(BASE32), five + 1, F.lit(1))

    return F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(31)), letter))


def _record_id(page_id: Column, uri: Column) -> Column:
    h = F.md5(F.concat_ws("\n", F.coalesce(page_id.cast("string"), F.lit("")), uri))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _clean(uri: Column, page_id: Column) -> Column:
    """A header value: white space and control characters would end it."""
    named = F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")))
    return F.coalesce(F.regexp_replace(uri, r"[\x00-\x20\x7F]", "%20"), named)


def records_of(pages: DataFrame) -> DataFrame:
    """(page_id, target_uri, payload, bytes, digest) per page; a null html is an empty payload.

    The digest is hexadecimal until a header is written.
    """
    page_id = F.col("page_id").cast("long")
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        page_id.alias("page_id"),
        _clean(F.col("url").cast("string"), page_id).alias("target_uri"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("bytes"),
        F.sha1(payload.cast("binary")).alias("digest"),
    )


def originals(records: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(digest, original_id, original_uri) of the payloads that more than one record has.

    The original is the record with the largest page_id (a null one is smaller than any other).
    """
    headers = records.filter(F.col("bytes") >= least_bytes).select("digest", "page_id", "target_uri")
    groups = headers.groupBy("digest").agg(
        F.count("*").alias("n"), F.max(F.struct("page_id", "target_uri")).alias("o")
    )
    return groups.filter("n > 1").select(
        "digest", F.col("o.page_id").alias("original_id"), F.col("o.target_uri").alias("original_uri")
    )


def write_archives(records: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """One WARC record per row, revisits without payload, into gzipped archives below `path`."""
    known = checked(originals(records, least_bytes), "originals")
    joined = records.join(known, "digest", "left")
    is_first = F.col("page_id").eqNullSafe(F.col("original_id"))
    revisit = F.col("original_uri").isNotNull() & ~is_first & (F.col("bytes") >= least_bytes)
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"),
        F.lit(END),
    )
    length = F.octet_length("http") + F.when(F.col("revisit"), 0).otherwise(F.col("bytes"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    refers = F.concat(
        line("WARC-Profile", F.lit(PROFILE)),
        line("WARC-Refers-To", _record_id(F.col("original_id"), F.col("original_uri"))),
        line("WARC-Refers-To-Target-URI", F.col("original_uri")),
        line("WARC-Refers-To-Date", F.lit(DATE)),
    )
    number = F.when(F.col("page_id").isNotNull(), line("X-Page-ID", F.col("page_id").cast("string")))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("target_uri"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.col("target_uri")),
        F.coalesce(number, F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("digest")))),
        F.when(F.col("revisit"), refers).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
    )
    rows = joined.withColumn("revisit", revisit).withColumn("http", http)
    body = F.when(F.col("revisit"), "").otherwise(F.col("payload"))
    (
        rows.select(F.concat(header, F.col("http"), body).alias("value"))
        .write.option("lineSep", END)
        .option("compression", "gzip")
        .option("zlib.compress.level", "BEST_SPEED")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


def parse_archive(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record; gzip members or plain bytes."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
    reader = io.BufferedReader(stream, 1 << 16)
    while True:
        line = reader.readline()
        while line in (b"\r\n", b"\n"):
            line = reader.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        for line in iter(reader.readline, b""):
            line = line.rstrip(b"\r\n")
            if not line:
                break
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        size = int(headers["content-length"])
        block = reader.read(size)
        if len(block) != size:
            raise ValueError(f"a record ends after {len(block)} of {size} bytes")
        yield headers, block


def _payload(headers: dict[str, str], block: bytes) -> tuple[bytes, int]:
    """(payload, bytes of the full payload): what follows the HTTP header in the block."""
    if not headers.get("content-type", "").startswith("application/http"):
        return block, len(block)
    head, _, body = block.partition(b"\r\n\r\n")
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return body, int(value)
    return body, len(body)


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The columns of RECORDS for every record of the archives below `path`.

    The digest of a response is computed from its payload and must equal its header; a revisit has
    the digest and the length that its header names. `payload` is null unless asked for.
    """
    ship_package(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch["content"]:
                rows = []
                for headers, block in parse_archive(raw.as_py()):
                    body, size = _payload(headers, block)
                    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
                    if headers["warc-type"] != "revisit":
                        found = base64.b32encode(hashlib.sha1(body).digest()).decode()
                        if digest and digest != found:
                            raise ValueError(f"{headers['warc-record-id']}: digest {found}")
                        digest = found
                    page = headers.get("x-page-id")
                    rows.append(
                        {
                            "record_id": headers["warc-record-id"],
                            "record_type": headers["warc-type"],
                            "page_id": int(page) if page else None,
                            "target_uri": headers.get("warc-target-uri"),
                            "payload_bytes": size,
                            "payload_digest": digest,
                            "refers_to_id": headers.get("warc-refers-to"),
                            "payload": body if payloads else None,
                        }
                    )
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(parse, RECORDS)


_SCHEMA = pa.schema(
    [
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("page_id", pa.int64()),
        ("target_uri", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to_id", pa.string()),
        ("payload", pa.binary()),
    ]
)


def resolve(records: DataFrame) -> DataFrame:
    """Adds refers_to, the page_id of the response that a revisit names."""
    records = written(records.drop("payload"), "records")
    named = records.select(F.col("refers_to_id").alias("record_id")).filter("record_id is not null")
    targets = records.filter("record_type = 'response'").select("record_id", "page_id")
    targets = targets.join(named.distinct(), "record_id", "left_semi").distinct()
    targets = targets.select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")
    )
    return records.join(checked(targets, "responses"), "refers_to_id", "left")


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as deduplicated archives, reads them back, and resolves the revisits."""
    path = scratch_path(spark, "warc")
    write_archives(records_of(table(spark, sf_dir, "pages")), path)
    return resolve(read_records(spark, path)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


#: The same in SQL; base32 by sums of powers of two over the hexadecimal digits.
SQL = r"""
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as hex from p),
b as (
  select page_id, payload_bytes, hex,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(hex, (5 * (i // 4) + 1)::bigint, 5))::bigint >> (5 * (3 - i % 4))::bigint) & 31) + 1, 1)), '')
      as payload_digest
  from d),
g as (select hex, max(page_id) as original, count(*) as n from b group by hex)
select page_id, payload_bytes, payload_digest,
  case when n > 1 and page_id <> original then 'revisit' else 'response' end as record_type,
  case when n > 1 and page_id <> original then original end as refers_to
from b join g using (hex)
"""
