"""WARC revisit resolution (operator 2).

Only headers (page id, payload digest) are shuffled by digest: a partial aggregate finds digests that occur more
than once and their smallest page id, and the revisits among the headers are joined to it. The payloads move
once, by record key, to the archive they are written to, with headers made afresh. Archives are WARC/1.1 in
gzip, written by Spark's text sink (one record a row, records end with two line ends), so any file system that
Spark reaches will do; reading parses them again record by record and checks each response's digest.

Defined cases: a null payload is empty; equal empty payloads are revisits too, unless min_bytes is above 0; a
row that repeats a page id with the same payload is a revisit of the first; the same id with another payload is
a record of its own; rows without an id never are the response while a row with an id has the payload; a null
url is written as urn:none; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import shared_dir, shuffle_partitions

#: Records of one archive file at most, and payload bytes on average at most: a file is read back as a whole.
ARCHIVE_RECORDS = 5_000
ARCHIVE_BYTES = 64_000_000
#: Groups that equal payloads of rows without an id are dealt to.
SALTS = 64
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex_digest: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 in hex: five hex digits are four base32 letters."""

    def four(g: Column) -> Column:
        bits = F.conv(F.substring(hex_digest, g * 5 + 1, F.lit(5)), 16, 10).cast("int")
        letters = [F.substring(F.lit(_BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
        return F.concat(*letters)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), four), "")


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Records: page_id, url, html, payload_bytes, payload_digest, record_type, refers_to."""
    raw = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    raw = raw.withColumn("hex", F.sha1(F.col("html").cast("binary"))).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    # rows that repeat an id and its payload are told apart by their turn; those without an id may be many
    raw = raw.withColumn("salt", F.when(F.col("page_id").isNull(), F.pmod(F.xxhash64("url"), F.lit(SALTS))).otherwise(0))
    raw = raw.withColumn("rid", F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.lit(":"), F.col("hex")))
    heads = raw.where(F.col("payload_bytes") >= min_bytes).select("rid", "salt", "hex", "page_id")
    copies = heads.groupBy("hex").agg(F.count("*").alias("n"), F.min("page_id").alias("first"), F.min("salt").alias("low")).where("n > 1")
    shared = heads.join(copies, "hex").groupBy("rid", "salt").agg(F.min("first").alias("first"), F.min("low").alias("low"), F.lit(True).alias("shared"))
    turn = F.col("salt") * (1 << 32) + F.row_number().over(Window.partitionBy("rid", "salt").orderBy("url"))
    size = raw.agg(F.sum("payload_bytes")).first()[0] or 0
    files = max(shuffle_partitions(pages.sparkSession), -(-size // ARCHIVE_BYTES))
    found = raw.repartition(files, "rid", "salt").join(shared, ["rid", "salt"], "left").withColumn("turn", turn)
    lowest = F.when(F.col("first").isNull(), F.col("salt") == F.col("low")).otherwise(F.lit(True))
    original = F.col("shared").isNull() | (F.col("page_id").eqNullSafe(F.col("first")) & lowest & (F.col("turn") % (1 << 32) == 1))
    return found.select(
        "page_id", "url", "html", "payload_bytes", base32(F.col("hex")).alias("payload_digest"), "rid", "turn",
        F.when(original, "response").otherwise("revisit").alias("record_type"),
        F.when(~original, F.col("first")).alias("refers_to"),
    )


def _record_id(rid: Column, turn: Column) -> Column:
    h = F.md5(F.concat(rid, F.lit("/"), turn.cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.array_join(F.array(*parts), "-"), F.lit(">"))


def write_archives(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write records as gzip WARC files under path."""
    crlf = "\r\n"
    digest = F.concat(F.lit("sha1:"), F.col("payload_digest"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(crlf * 2)
    )
    fresh = F.col("record_type") == "response"
    block = F.when(fresh, F.concat(http, F.col("html"))).otherwise(http)
    uri = F.regexp_replace(F.coalesce("url", F.lit("urn:none")), r"[\x00-\x20]", "%20")
    first_rid = F.concat(F.col("refers_to").cast("string"), F.lit(":"), F.element_at(F.split("rid", ":"), -1))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(crlf))

    head = F.concat(
        F.lit(f"WARC/1.1{crlf}"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _record_id(F.col("rid"), F.col("turn"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", uri), line("WARC-Payload-Digest", digest),
        F.when(fresh, "").otherwise(F.concat(
            line("WARC-Profile", F.lit(_REVISIT)),
            F.coalesce(line("WARC-Refers-To", _record_id(first_rid, F.lit(1))), F.lit("")),
            F.coalesce(line("X-Refers-To-Page", F.col("refers_to")), F.lit("")),
        )),
        F.coalesce(line("X-Page-Id", F.col("page_id")), F.lit("")), line("X-Payload-Bytes", F.col("payload_bytes")),
        F.lit(f"Content-Type: application/http;msgtype=response{crlf}"), line("Content-Length", F.octet_length(block)), F.lit(crlf),
    )
    lines = records.select(F.concat(head, block).alias("value"))
    lines.write.option("lineSep", crlf * 2).option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def records_of(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of an open WARC stream."""
    while first := stream.readline():
        if first == b"\r\n":
            continue
        if not first.startswith(b"WARC/1."):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]):
            raise ValueError("a record is cut short")
        yield fields, block


_ROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_archives(spark, path: str) -> DataFrame:
    """Read archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                with gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())) as stream:
                    for fields, block in records_of(io.BufferedReader(stream)):
                        digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                                raise ValueError(f"digest of page {fields.get('x-page-id')} does not match its payload")
                        to = fields.get("x-refers-to-page")
                        page = fields.get("x-page-id")
                        rows.append((page and int(page), int(fields["x-payload-bytes"]), digest, kind, to and int(to)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ROW.types)], schema=_ROW)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc_round_trip(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Resolve revisits, write the archives (to path, or to the shared folder) and read them back."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(resolve(pages, min_bytes), path)
    return read_archives(spark, path)
