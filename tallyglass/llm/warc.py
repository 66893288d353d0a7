"""WARC archives: writing captures as request, response or revisit, and metadata records, and assembling them again.

Writing uses Spark's own text sink with the record terminator as line separator, so archives land in any file system
Spark writes, under its commit protocol. Reading parses whole files in tasks; a capture is then put together from its
records through their concurrent-to identifiers, wherever in the archives they lie.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_folder
from .base import in_workers, materialize, pick

CRLF = "\r\n"
HTTP_REPLY = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed alphabets: digits of a number in base 32, and those of RFC 4648.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Bytes of decompressed archive a task holds before it yields its records.
BATCH_BYTES = 8 << 20
#: Captures in a file at most, and bytes of payloads it is meant to hold, since reading takes a whole file into a task.
MOST_CAPTURES, FILE_BYTES = 10_000, 64 << 20
FIELDS = "record_id kind concurrent_to refers_to uri date stored_digest payload_bytes payload_digest capture_id".split()


def base32_sha1(text: Column) -> Column:
    """SHA-1 of the UTF-8 bytes in upper-case base32: 160 bits are eight groups of 20 bits, each four digits."""
    digest = F.sha1(text)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), DIGITS, BASE32)


def urn(kind: str) -> Column:
    h = F.md5(F.concat(F.lit(kind + ":"), F.col("key")))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def record(kind: str, record_id: Column, headers: dict[str, Column], block: Column) -> Column:
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), record_id]
    for name, value in headers.items():
        lines.append(F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{CRLF}{name}: "), value)))
    lines += [F.lit(CRLF + "Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block]
    return F.concat(*lines)


def write_captures(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    date: str = "2000-01-01T00:00:00Z",
    min_revisit_bytes: int = 0,
    records_per_file: int | None = None,
) -> None:
    """Write every row as a capture of three records into gzip archives below ``folder``.

    Among captures with equal payloads of at least ``min_revisit_bytes`` the one with the largest id is a response and
    the others are revisits that refer to it and hold no payload. A null payload is an empty one, a null URL leaves its
    header out (line breaks in a URL are percent-encoded), a null id ranks below all others. Rows that agree in id, URL
    and payload are written as often as they occur, under the same record identifiers. Other columns are ignored.

    Without ``records_per_file`` the mean size of the payloads decides how many captures go to a file.
    """
    caps = pick(pages, id=id_col, url=url_col, payload=payload_col).select(
        F.col("id").cast("string").alias("id"),
        F.col("id").alias("rank"),
        F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"),
        F.coalesce("payload", F.lit("")).alias("payload"),
    )
    caps = caps.withColumns({"digest": base32_sha1(F.col("payload")), "bytes": F.octet_length("payload")})
    caps = caps.withColumn("key", F.md5(F.concat_ws("|", *[F.coalesce(c, F.lit("-")) for c in ("id", "digest")], F.coalesce("url", F.lit("-")))))
    if records_per_file is None:
        mean = caps.agg(F.avg("bytes")).first()[0] or 0
        records_per_file = max(1, min(MOST_CAPTURES, int(FILE_BYTES / (mean + 1024))))
    narrow = caps.filter(F.col("bytes") >= min_revisit_bytes).select("digest", "rank", "key")
    groups = narrow.groupBy("digest").agg(F.max(F.struct("rank", "key")).alias("first"), F.min("key").alias("a"), F.max("key").alias("b"))
    groups = materialize(groups.filter("a <> b").select("digest", F.col("first.key").alias("target")), "warc-groups")
    revisits = narrow.join(groups, "digest").filter("key <> target").select("key", "target").distinct()
    rows = caps.join(materialize(revisits, "warc-revisits"), "key", "left")

    common = {"WARC-Date": F.lit(date), "WARC-Target-URI": F.col("url")}
    main = urn("response")
    typed = {"Content-Type": F.lit("application/http;msgtype=response"), "WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("digest"))}
    response = record("response", main, common | typed, F.concat(F.lit(HTTP_REPLY), F.col("bytes").cast("string"), F.lit(CRLF * 2), F.col("payload")))
    target_id = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat(F.lit("response:"), F.col("target"))), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))
    again = {"WARC-Refers-To": target_id, "WARC-Profile": F.lit(REVISIT_PROFILE)}
    revisit = record("revisit", main, common | typed | again, F.lit(HTTP_REPLY + "0" + CRLF * 2))
    request = record(
        "request", urn("request"), common | {"WARC-Concurrent-To": main, "Content-Type": F.lit("application/http;msgtype=request")},
        F.lit("GET / HTTP/1.1\r\n\r\n"),
    )
    note = F.concat(F.lit("captureId: "), F.coalesce("id", F.lit("")), F.lit(CRLF + "payloadLength: "), F.col("bytes").cast("string"), F.lit(CRLF))
    metadata = record("metadata", urn("metadata"), common | {"WARC-Concurrent-To": main, "Content-Type": F.lit("application/warc-fields")}, note)
    end = F.lit(CRLF * 2)
    value = F.concat(request, end, F.when(F.col("target").isNull(), response).otherwise(revisit), end, metadata)
    rows.select(value.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(folder)


def unpacked(content: bytes) -> Iterator[bytes]:
    """The bytes of an archive: plain, or gzip with any number of members."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        inflate = zlib.decompressobj(31)
        for at in range(0, len(content), 1 << 20):
            yield inflate.decompress(content[at : at + (1 << 20)])
            if inflate.eof:
                content = inflate.unused_data + content[at + (1 << 20) :]
                break
        else:
            raise ValueError("the archive ends within a gzip member")


class Buffer:
    """Takes chunks of bytes and gives them out by terminator or by length."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.data, self.at = chunks, b"", 0

    def more(self) -> bool:
        for chunk in self.chunks:
            if chunk:
                self.data, self.at = self.data[self.at :] + chunk, 0
                return True
        return False

    def until(self, end: bytes) -> bytes | None:
        seen = 0
        while (found := self.data.find(end, self.at + seen)) < 0:
            seen = max(0, len(self.data) - self.at - len(end) + 1)
            if not self.more():
                return None
        out, self.at = self.data[self.at : found], found + len(end)
        return out

    def take(self, n: int) -> bytes:
        while len(self.data) - self.at < n:
            if not self.more():
                raise ValueError("the archive ends within a record")
        out, self.at = self.data[self.at : self.at + n], self.at + n
        return out


def headers_of(block: bytes) -> dict[str, str]:
    fields = (line.partition(":") for line in block.decode("utf-8", "replace").split(CRLF))
    return {name.strip().lower(): value.strip() for name, colon, value in fields if colon}


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record."""
    buffer = Buffer(unpacked(content))
    while (head := buffer.until(b"\r\n\r\n")) is not None:
        version, _, lines = head.lstrip(b"\r\n").partition(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {version[:40]!r}")
        headers = headers_of(lines)
        block = buffer.take(int(headers["content-length"]))
        buffer.take(4)
        yield headers, block


def read_records(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """One row per record of all archives below ``folder``; ``payload`` adds the bytes of HTTP replies."""

    def row(headers: dict[str, str], block: bytes) -> dict:
        kind = headers.get("warc-type")
        out = {
            "record_id": headers.get("warc-record-id"), "kind": kind, "concurrent_to": headers.get("warc-concurrent-to"),
            "refers_to": headers.get("warc-refers-to"), "uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"),
            "stored_digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        }
        if kind == "response":
            body = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
            out |= {"payload_bytes": len(body), "payload_digest": base64.b32encode(hashlib.sha1(body).digest()).decode()}
            if payload:
                out["payload"] = body
        elif kind == "metadata":
            out["capture_id"] = headers_of(block).get("captureid")
        return out

    types = {f: pa.int64() if f == "payload_bytes" else pa.string() for f in FIELDS} | ({"payload": pa.binary()} if payload else {})
    schema = pa.schema(list(types.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for content in batch.column("content"):
                for headers, block in records(content.as_py()):
                    rows.append(row(headers, block))
                    size += 1000 + len(block) * payload
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return in_workers(files, run, ", ".join(f"{f} {'long' if t == pa.int64() else 'binary' if f == 'payload' else 'string'}" for f, t in types.items()))


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: ``record_id``, ``response`` (or revisit), ``request``, ``metadata`` and how many there are of each.

    Requests and metadata may point at the response, the response may point at its request, and metadata may point at
    the request of either. Of several requests or metadata records the one with the smallest identifier is kept. Records
    whose capture has no response form rows with a null ``response``; those without an identifier are left out.
    """
    is_main = F.col("kind").isin("response", "revisit")
    found = found.filter(F.col("record_id").isNotNull() & F.col("kind").isin("response", "revisit", "request", "metadata"))
    links = found.filter("concurrent_to IS NOT NULL")
    mains = links.filter(is_main).select(F.col("concurrent_to").alias("of"), F.col("record_id").alias("root"))
    to_main = mains.groupBy("of").agg(F.min("root").alias("root"))
    onward = links.filter(~is_main).select(F.col("record_id").alias("of"), F.col("concurrent_to").alias("root"), F.lit(1).alias("rank"))
    both = to_main.withColumn("rank", F.lit(0)).unionByName(onward)
    onward = both.groupBy("of").agg(F.min(F.struct("rank", "root"))["root"].alias("via"))
    rest = found.filter(~is_main).drop("payload")
    rest = rest.join(to_main, rest["record_id"] == to_main["of"], "left").drop("of")
    rest = rest.join(onward, rest["concurrent_to"] == onward["of"], "left").drop("of")
    rest = rest.withColumn("capture", F.coalesce("root", "via", "concurrent_to", "record_id")).drop("root", "via")
    rows = found.filter(is_main).withColumn("capture", F.col("record_id")).unionByName(rest, allowMissingColumns=True)
    whole = F.struct(*[c for c in rows.columns if c not in ("capture", "concurrent_to")])
    one = lambda kind: F.min(F.when(F.col("kind") == kind, whole))
    return rows.groupBy("capture").agg(
        F.min(F.when(is_main, whole)).alias("response"),
        one("request").alias("request"),
        one("metadata").alias("metadata"),
        F.count_if(is_main).alias("n_responses"),
        F.count_if(F.col("kind") == "request").alias("n_requests"),
        F.count_if(F.col("kind") == "metadata").alias("n_metadata"),
    ).withColumnRenamed("capture", "record_id")


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """Per capture of the archives: its id, payload size and digest, record type, and for revisits the id of the response.

    A revisit's size comes from the response it refers to and its digest from its own header. A capture whose response
    occurs n times under one identifier gives n rows.
    """
    rows = assemble(read_records(spark, folder)).filter("response IS NOT NULL")
    rows = rows.select(
        "record_id", F.col("metadata.capture_id").alias("capture_id"), F.col("response.kind").alias("record_type"),
        F.col("response.refers_to").alias("target"), "response.payload_bytes", "n_responses",
        F.coalesce("response.payload_digest", "response.stored_digest").alias("payload_digest"),
    )
    rows = materialize(rows, "warc-captures")
    targets = rows.filter("record_type = 'response'").select(
        F.col("record_id").alias("target"), F.col("capture_id").alias("refers_to"), F.col("payload_bytes").alias("target_bytes")
    )
    rows = rows.join(targets, "target", "left").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_responses"))))
    return rows.select("capture_id", F.coalesce("payload_bytes", "target_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame, id_col: str = "page_id", **columns: str) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and return a row per capture."""
    spark = pages.sparkSession
    folder = scratch_folder(spark, "warc")
    write_captures(pages, folder, id_col, **columns)
    kind = pages.select(F.col(f"`{id_col}`")).schema[0].dataType
    as_id = lambda c: F.nullif(F.col(c), F.lit("")).cast(kind)
    return captures(spark, folder).select(
        as_id("capture_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", as_id("refers_to").alias("refers_to")
    )


#: What :func:`round_trip` gives for ``pages``, for DuckDB.
SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
h AS (SELECT *, sha1(body) AS hex FROM p),
b AS (
  SELECT *, string_agg('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1], '' ORDER BY i)
    OVER (PARTITION BY page_id) AS digest, i
  FROM h, generate_series(0, 31) AS g(i))
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM b WHERE i = 31
"""
