"""WARC archives: a writer with revisit records and a salvage reader.

Writing: payload digests name the rows with equal payloads; the smallest id of them becomes the response record, the
others revisit it. Records are built in one pass over the rows and written by Spark's own committer, in archives of about
ARCHIVE_BYTES each, so a lost executor's files are never seen half-written.

Reading: every archive is read in one pass. A record, plain or a gzip member of its own, must pass all checks: version
line, header lines, a length that fits, the closing blank lines, the digests of block and payload. After a failed check
the reader searches for the next version line or member at which a whole record passes them, goes on from there and logs
the bytes between as a quarantined gap, with the reason.

Defined cases: a null html is an empty payload; null ids are written as empty record names, read back as null, and sort
last; rows that repeat both id and payload are alike (all responses if theirs is the smallest id); payloads under
min_bytes are always responses; an empty table writes no archive and reads as no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, saved, scratch_path, table
from .exact_dedup import heavy_winners

ARCHIVE_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
_START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def build_record(page_id: object, url: str | None, payload: bytes, refers_to: object = None) -> bytes:
    """A response record, or a revisit of another one: then the payload is left out but for its HTTP header."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20]+', '%20', url or '')}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


# -- salvage reader ---------------------------------------------------------------------------------------------------


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | str:
    """(header, block, end) of the plain record at a place, or which check it fails."""
    if not re.compile(rb"WARC/1\.[01]\r\n").match(data, at):
        return "no version line"
    close = data.find(b"\r\n\r\n", at)
    if close < 0:
        return "no end of the header"
    header: dict[str, str] = {}
    for line in data[at:close].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "a header line without a colon"
        header[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if not {"warc-type", "warc-record-id", "content-length"} <= header.keys() or not header["content-length"].isdigit():
        return "a header field is missing"
    begin = close + 4
    end = begin + int(header["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return "the length doesn't fit"
    block = data[begin:end]
    wanted = header.get("warc-block-digest", "")
    if wanted.startswith("sha1:") and wanted[5:] != base32_sha1(block):
        return "the block's digest differs"
    if header["warc-type"] == "response" and "msgtype=response" in header.get("content-type", ""):
        wanted = header.get("warc-payload-digest", "")
        if wanted.startswith("sha1:") and wanted[5:] != base32_sha1(block.partition(b"\r\n\r\n")[2]):
            return "the payload's digest differs"
    return header, block, end + 4


def parse_member(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | str:
    """(header, block, end) of the record that the gzip member at a place holds, or which check it fails."""
    machine, out, view, upto = zlib.decompressobj(31), [], memoryview(data), at
    try:
        while not machine.eof and upto < len(data):
            out.append(machine.decompress(view[upto : upto + (64 << 10)]))
            upto += 64 << 10
    except zlib.error:
        return "the gzip member is broken"
    if not machine.eof:
        return "the gzip member is cut short"
    inner = b"".join(out)
    record = parse_record(inner, 0)
    if isinstance(record, str):
        return record
    if record[2] != len(inner):
        return "the gzip member holds more than a record"
    return record[0], record[1], min(upto, len(data)) - len(machine.unused_data)


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """("record", start, end, (header, block)) and ("gap", start, end, reason), in order; together they cover all bytes."""
    at, n = 0, len(data)
    while at < n:
        parse = parse_member if data.startswith(b"\x1f\x8b", at) else parse_record
        record = parse(data, at)
        if not isinstance(record, str):
            yield "record", at, record[2], (record[0], record[1])
            at = record[2]
            continue
        reason, upto = record, n
        for found in _START.finditer(data, at + 1):
            start = found.start()
            if not isinstance((parse_member if data[start] == 0x1F else parse_record)(data, start), str):
                upto = start
                break
        yield "gap", at, upto, reason
        at = upto


def _name(value: str | None) -> str | None:
    found = re.fullmatch(r"<urn:page:(.+)>", value or "")
    return found[1] if found else None


def read_archives(spark: SparkSession, path: str, id_type: str = "long", payloads: bool = False) -> DataFrame:
    """A row for each record and each gap of the archives under path.

    (archive, kind, start_byte, end_byte, reason, page_id, url, record_type, refers_to, payload_bytes, payload_digest,
    payload); payload is null unless asked for.
    """
    bounded_batches(spark, 8 << 20)
    names = ["archive", "kind", "start_byte", "end_byte", "reason", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[tuple] = []
                held = 0
                for kind, start, end, what in salvage(content.as_py() or b""):
                    if kind == "gap":
                        rows.append((archive, kind, start, end, what, *[None] * 7))
                    else:
                        header, block = what
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = len(payload)
                        if header["warc-type"] == "revisit":
                            stated = re.search(rb"(?i)\r\nContent-Length:\s*(\d+)", http)
                            length = int(stated[1]) if stated else None
                        digest = header.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        rows.append((archive, kind, start, end, None, _name(header["warc-record-id"]), header.get("warc-target-uri"), header["warc-type"], _name(header.get("warc-refers-to")), length, digest, payload if payloads else None))
                    held += end - start if payloads else 256
                    if held > 4 << 20:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    schema = "archive string, kind string, start_byte long, end_byte long, reason string, page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"
    rows = files.mapInArrow(read, schema)
    return rows.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


# -- writer -----------------------------------------------------------------------------------------------------------


def revisits(pages: DataFrame, id_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """(id, digest, refers_to) of the rows that repeat the payload of a smaller id; payloads themselves aren't shuffled."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = saved(pages.where(F.octet_length(payload) >= min_bytes).select(F.col(id_col).alias("id"), F.unhex(F.sha1(payload)).alias("digest")), "payload-digests")
    winners = saved(heavy_winners(rows, ["id"]), "payload-winners")
    tagged = rows.join(F.broadcast(winners), "digest", "left")
    heavy = tagged.where("winner is not null").select("id", "digest", F.col("winner.id").alias("refers_to"))
    first = F.first("id").over(Window.partitionBy("digest").orderBy(F.col("id").asc_nulls_last()))
    light = tagged.where("winner is null").select("id", "digest", first.alias("refers_to"))
    return saved(heavy.unionByName(light).where("refers_to is not null and not (id <=> refers_to)").distinct(), "revisits")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """A record a row, in archives of about archive_bytes, none larger but by its last record."""
    spark = pages.sparkSession
    bounded_batches(spark, 8 << 20)
    again = revisits(pages, id_col, html_col, min_bytes).select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), F.col("refers_to").alias("__refers"))
    payload = F.coalesce(F.col(html_col), F.lit(""))
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("html"), F.unhex(F.sha1(payload)).alias("digest"))
    # Revisits are few and narrow: Spark broadcasts them if their table's size allows, and else joins by a shuffle.
    rows = own.join(again, F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left").select("id", "url", "html", F.col("__refers").alias("refers_to"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Archives are named by the task that writes them, so there are few however the rows came to it.
        number, size, part = 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            names, texts = [], []
            for page_id, url, html, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size > archive_bytes:
                    number, size = number + 1, 0
                record = build_record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to)
                size += len(record)
                names.append(f"{part}-{number}")
                texts.append(record[:-1])  # the text writer ends each row with the last line feed
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()), pa.array(names, pa.string())], names=["value", "archive"])

    rows.mapInArrow(build, "value string, archive string").write.partitionBy("archive").text(path)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = table(spark, sf_dir, "pages"), scratch_path(spark, "warc")
    write_archives(pages, path)
    rows = saved(read_archives(spark, path), "warc-rows-and-gaps")
    records, written = rows.where("kind = 'record'"), pages.count()
    if (n := records.count()) != written:
        gaps = rows.where("kind = 'gap'").select("archive", "start_byte", "end_byte", "reason").limit(20).collect()
        raise ValueError(f"{written} records were written and {n} read back; the first gaps: {gaps}")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, hex,
  array_to_string(list_transform(string_split(hex, ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', c) - 3, 4)), '') AS bits FROM p),
d AS (SELECT page_id, payload_bytes, hex, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
  + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS INT), 1)), '') AS payload_digest FROM b),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f
"""
