"""WARC archives written and read by Spark, and captures assembled from their records.

Each page becomes a transaction of three records: a request and a metadata record that name the response through
WARC-Concurrent-To, and a response, or a revisit where a page with a larger id has the same payload. Payloads are compared by
their SHA-1; only those that several ids may have (by a bitmap of digests) move for that. Spark's text sink writes the archives (records end with two line breaks, as the format asks), gzipped.

Archives are read whole file by whole file and parsed as streams by Content-Length; a file holds at most
FILE_CAPTURES captures. `captures` joins the records of a transaction through their concurrent-to ids into one nested row, in one pass
over the archives and one aggregation that combines where a transaction's records stand in one file.

Cases: a null payload is empty, a null address gives records without one; a null page id is written without an id and never
makes another page a revisit; repeated rows are captures of their own, and rows that share the largest id of a payload are all
responses; extra records of one kind in a transaction: the one with the smallest record id counts; an empty table gives an
empty one; other columns of the input are not read.
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

from cartlens.llm.storage import kept

FILE_CAPTURES = 4000
DATE = "2024-01-01T00:00:00Z"
SEPARATOR = "\r\n\r\n"
# Bits of the largest bitmap of shared payloads (16 MB), and of one row of it.
BITS = 1 << 27
BLOCK = 1 << 15
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = (
    "record_id string, type string, concurrent_to string, target_uri string, payload_digest string, payload_bytes bigint, "
    "intact boolean, fields map<string, string>, payload binary"
)


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: 40 bits at a time, as eight digits of base 32 in the other alphabet."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _typed(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    ).select(
        "*", F.octet_length("payload").cast("bigint").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest")
    )


def shared_payloads(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """payload_digest and last (the largest page_id) of every payload of several ids, as a kept table."""
    return kept(
        _typed(pages)
        .where(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("last"), F.min("page_id").alias("first"))
        .where("first < last")
        .select("payload_digest", "last"),
        "payloads",
    )


def may_be_shared(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """`rows` with a column `meets`: false only if the payload is not among `shared`.

    It is a bit in a bitmap of their digests, BITS at most, that goes to all tasks; with more digests it lets more others pass."""
    size = 1 << min(max(16 * shared.count(), BLOCK).bit_length(), BITS.bit_length() - 1)
    place = F.pmod(F.xxhash64("payload_digest"), F.lit(size))
    blocks = shared.groupBy((place / BLOCK).cast("bigint").alias("block")).agg(F.bitmap_construct_agg(place % BLOCK).alias("bits"))
    byte = F.conv(F.hex(F.expr(f"substring(bits, cast(place % {BLOCK} div 8 + 1 as int), 1)")), 16, 10).cast("int")
    return (
        rows.withColumn("place", place)
        .withColumn("block", F.expr(f"place div {BLOCK}"))
        .join(F.broadcast(blocks), "block", "left")
        .withColumn("meets", F.coalesce(F.getbit(byte, (F.col("place") % 8).cast("int")) == 1, F.lit(False)))
        .select(*rows.columns, "meets")
    )


def with_types(pages: DataFrame, least_bytes: int = 0, shared: DataFrame | None = None) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, and refers_to (null for responses) of every page.

    Only payloads that may be among `shared` (those of `shared_payloads`) move to be joined."""
    shared = shared_payloads(pages, least_bytes) if shared is None else shared
    rows = may_be_shared(_typed(pages), shared)
    refers = F.when((F.col("payload_bytes") >= least_bytes) & (F.col("page_id") < F.col("last")), F.col("last"))
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest"]
    alone = rows.where("not meets").select(*columns, F.lit(None).cast("bigint").alias("refers_to"))
    return alone.unionAll(rows.where("meets").join(shared, "payload_digest", "left").select(*columns, refers.alias("refers_to")))


def _record(kind: str, headers: dict[str, Column], content: Column) -> Column:
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}\r\n")]
    for name, value in headers.items():
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(content).cast("string"), F.lit("\r\n\r\n"), content)


def write_archives(typed: DataFrame, folder: str) -> None:
    """Archives with the transactions of all rows of `with_types`."""
    number = F.monotonically_increasing_id()
    rows = typed.withColumn("no", F.md5(F.concat(F.lit("capture "), number.cast("string")))).withColumn(
        "uri", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    )
    name = lambda kind: F.concat(F.lit(f"<urn:x-{kind}:"), "no", F.lit(">"))
    size = F.col("payload_bytes").cast("string")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(SEPARATOR))
    digest = F.concat(F.lit("sha1:"), "payload_digest")
    http = F.lit("application/http; msgtype=response")
    response = _record(
        "response",
        {"WARC-Record-ID": name("capture"), "WARC-Target-URI": F.col("uri"), "WARC-Payload-Digest": digest, "Content-Type": http},
        F.concat(head, F.col("payload").cast("string")),
    )
    revisit = _record(
        "revisit",
        {
            "WARC-Record-ID": name("capture"),
            "WARC-Target-URI": F.col("uri"),
            "WARC-Payload-Digest": digest,
            "WARC-Profile": F.lit(PROFILE),
            "Content-Type": http,
        },
        head,
    )
    request = _record(
        "request",
        {
            "WARC-Record-ID": name("request"),
            "WARC-Concurrent-To": name("capture"),
            "WARC-Target-URI": F.col("uri"),
            "Content-Type": F.lit("application/http; msgtype=request"),
        },
        F.concat(F.lit("GET "), F.coalesce("uri", F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")),
    )
    field = lambda key, value: F.coalesce(F.concat(F.lit(f"{key}: "), F.col(value).cast("string"), F.lit("\r\n")), F.lit(""))
    metadata = _record(
        "metadata",
        {
            "WARC-Record-ID": name("metadata"),
            "WARC-Concurrent-To": name("capture"),
            "Content-Type": F.lit("application/warc-fields"),
        },
        F.concat(field("captureId", "page_id"), field("refersToCapture", "refers_to")),
    )
    capture = F.when(F.col("refers_to").isNull(), response).otherwise(revisit)
    (
        rows.select(F.concat_ws(SEPARATOR, request, capture, metadata).alias("value"))
        .write.option("lineSep", SEPARATOR)
        .option("compression", "gzip")
        .option("zlib.compress.level", "BEST_SPEED")
        .option("maxRecordsPerFile", FILE_CAPTURES)
        .text(folder)
    )


def _headers(file) -> dict[str, str] | None:
    """Headers of the next record or HTTP message; none at the end of the file."""
    line = file.readline()
    while line in (b"\r\n", b"\n"):
        line = file.readline()
    if not line:
        return None
    found = {"": line.decode("utf-8", "replace").strip()}
    while (line := file.readline()).strip():
        key, _, value = line.decode("utf-8", "replace").partition(":")
        found[key.strip().lower()] = value.strip()
    return found


def parse(content: bytes, with_payload: bool) -> Iterator[dict]:
    """The records of one archive, gzipped or not."""
    file = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while (head := _headers(file)) is not None:
        if not head[""].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {head['']!r}")
        size = int(head["content-length"])
        block = file.read(size)
        if len(block) < size:
            raise ValueError("the archive ends within a record")
        kind = head["warc-type"]
        row = {
            "record_id": head.get("warc-record-id"),
            "type": kind,
            "concurrent_to": head.get("warc-concurrent-to"),
            "target_uri": head.get("warc-target-uri"),
            "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        }
        if kind in ("response", "revisit"):
            place = block.find(b"\r\n\r\n")
            inner = _headers(io.BytesIO(block[: place + 4])) or {}
            payload = block[place + 4 :]
            if kind == "revisit":
                row["payload_bytes"] = int(inner["content-length"]) if "content-length" in inner else None
            else:
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                row["payload_bytes"] = len(payload)
                row["intact"] = row["payload_digest"] in (None, digest)
                row["payload_digest"] = digest
                row["payload"] = payload if with_payload else None
        elif kind == "metadata":
            lines = block.decode("utf-8", "replace").split("\r\n")
            row["fields"] = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines if x)]
        yield row


def read_records(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """One row per record of all archives below `folder`; `intact` says whether a response agrees with its digest."""
    schema = pa.schema(
        [(c, pa.string()) for c in ("record_id", "type", "concurrent_to", "target_uri", "payload_digest")]
        + [("payload_bytes", pa.int64()), ("intact", pa.bool_()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for row in parse(content.as_py(), with_payload):
                    rows.append(row)
                    size += len(row.get("payload") or b"")
                    if len(rows) == 4096 or size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("content")
    return files.mapInArrow(run, RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per transaction: capture_id (record id of its response or revisit), response, request, metadata.

    The archives are read once: a transaction's records meet under the id that request and metadata name and the response has."""
    columns = [c for c in records.columns if c != "concurrent_to"]

    def part(*kinds: str) -> Column:
        # Fields of a map have no order, so the smallest record id chooses.
        return F.min_by(F.struct(*columns), F.when(F.col("type").isin(*kinds), F.col("record_id")))

    capture_id = F.when(F.col("type").isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to"))
    return (
        records.where(F.col("type").isin("response", "revisit", "request", "metadata"))
        .groupBy(capture_id.alias("capture_id"))
        .agg(part("response", "revisit").alias("response"), part("request").alias("request"), part("metadata").alias("metadata"))
    )
