"""WARC writer and salvage reader.

Records are written by Spark's text writer, whose commit protocol survives lost executors.  In
plain files a record's closing blank lines are the line separator; in compressed files every
record is a gzip member of its own, separated by an empty member, so that damage stays local.
The reader takes both.  After a failed check it searches for the next gzip member or version line
that starts a valid record, goes on from there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import logging
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm.scratch import bound_arrow_batches, new_path, staged

#: An archive file is closed once it holds so many bytes; the reader takes a file at a time, of at most 2 GB.
ARCHIVE_BYTES = 16 * 1024 * 1024
#: Payloads of at least so many bytes are stored once; later copies revisit the first.
REVISIT_BYTES = 0
#: Fixed values.  What the archive format prescribes.
VERSION, END, MEMBER = b"WARC/1.", b"\r\n\r\n", b"\x1f\x8b\x08"
DATE = "1970-01-01T00:00:00Z"
#: A gzip member without content.
EMPTY_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000")

_LOG = logging.getLogger(__name__)
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_OUT = "file string, offset long, length long, kind string, reason string, headers map<string,string>, payload_bytes long, payload_digest string, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column."""
    digest = F.sha1(payload)
    groups = ((1, 15, 12), (16, 15, 12), (31, 10, 8))  # first hex digit, hex digits, base32 digits
    parts = [F.lpad(F.conv(F.substring(digest, a, n), 16, 32), width, "0") for a, n, width in groups]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def capture_records(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (null: a response).

    Of pages with equal payloads the one with the largest id is the response.  A null id is
    smaller than any other; a null payload is empty.  Repeated rows with one id are responses alike.
    """
    payload = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest")
    )
    # Only digests are grouped and joined; the grouped side has one row per payload, so a hot payload can be split.
    winners = pages.groupBy("payload_digest").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("copies"))
    winners = staged(winners.where((F.col("copies") > 1) & F.col("winner").isNotNull()).drop("copies"), "winners")
    revisits = (F.col("payload_bytes") >= revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("winner"))
    return pages.join(winners, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(F.col("winner").isNotNull() & revisits, F.col("winner")).alias("refers_to"),
    )


def page_urn(page_id: Column) -> Column:
    """Record id of a page, its id percent-encoded; a null id has no third part."""
    encoded = F.concat(F.lit("<urn:page:"), F.url_encode(page_id.cast("string")), F.lit(">"))
    return F.when(page_id.isNull(), F.lit("<urn:page>")).otherwise(encoded)


def page_of_urn(urn: Column) -> Column:
    return F.when(urn != "<urn:page>", F.url_decode(F.regexp_extract(urn, "^<urn:page:(.*)>$", 1)))


def write_warc(records: DataFrame, path: str, compression: str = "gzip", archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Writes records of ``capture_records`` as archive files below ``path``.

    A revisit has no body; its digest and length headers are those of the full payload.  Each task
    starts another file once its last one holds ``archive_bytes``, so a file is larger only by
    its last record.
    """
    revisit = F.col("refers_to").isNotNull()
    clean = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", page_urn(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, line("WARC-Refers-To", page_urn(F.col("refers_to")))).otherwise(""),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
    )
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    # The text writer puts the separator behind each row, which completes a plain record.
    compressed = compression == "gzip"
    text = records.select(F.concat(head, body).alias("value"))
    dealt = text.mapInArrow(lambda it: _members(it, compressed, archive_bytes), "value binary, part int")
    separator = (EMPTY_MEMBER if compressed else END).decode("iso-8859-1")
    dealt = dealt.select(F.col("value").cast("string"), "part")
    dealt.write.partitionBy("part").option("lineSep", separator).option("encoding", "iso-8859-1").text(path)
    return path


def _members(batches: Iterator[pa.RecordBatch], compressed: bool, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    """Each record, as a gzip member if compressed, with the number of the task's file it goes to."""
    part, size = 0, 0
    for batch in batches:
        values, parts = [], []
        for v in batch.column("value"):
            value = v.as_py().encode()
            values.append(gzip.compress(value + END, mtime=0) if compressed else value)
            parts.append(part)
            size += len(values[-1])
            if size >= archive_bytes:
                part, size = part + 1, 0
        yield pa.record_batch([pa.array(values, pa.binary()), pa.array(parts, pa.int32())], names=["value", "part"])


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Rows of kind ``record`` and ``gap``: file, offset, length, kind, reason, headers and payload.

    Offsets count bytes of the file, or of its decompressed content for records in gzip
    members.  Every byte is either in a record or in a gap; an empty file gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, size = [], 0
                for row in salvage(content.as_buffer()):
                    size += len(row[-1] or b"")
                    rows.append((name.as_py(), *row[:-1], row[-1] if with_payload else None))
                    if size > 4_000_000:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    return files.mapInArrow(read, _OUT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in _OUT.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def salvage(content: bytes | memoryview) -> Iterator[tuple]:
    """Records and gaps of one file: (offset, length, kind, reason, headers, bytes, digest, payload)."""
    data = memoryview(content)
    if bytes(data[:3]) == MEMBER or (bytes(data[:7]) != VERSION and _next_member(data, 0) < len(data)):
        yield from _salvage_members(data)
    else:
        yield from _salvage_records(data, 0)


def _salvage_members(data: memoryview) -> Iterator[tuple]:
    """Goes from gzip member to gzip member; what doesn't inflate is a gap up to the next that does."""
    at, bad = 0, 0
    plain_at = 0  # decompressed bytes before this member
    while at < len(data):
        member = _inflated(data, at)
        if member is None:
            at = _next_member(data, at + 1)
            continue
        if at > bad:
            yield (bad, at - bad, "gap", "no valid gzip member", None, None, None, None)
        content, used = member
        yield from _salvage_records(memoryview(content), plain_at)
        plain_at += len(content)
        at = bad = at + used
    if at > bad:
        yield (bad, len(data) - bad, "gap", "no valid gzip member", None, None, None, None)


def _inflated(data: memoryview, at: int) -> tuple[bytes, int] | None:
    """Content and compressed length of the gzip member at ``at`` if it is whole and its checksum holds."""
    if bytes(data[at : at + 3]) != MEMBER:
        return None
    engine, parts, to = zlib.decompressobj(31), [], at
    try:
        while not engine.eof and to < len(data):
            parts.append(engine.decompress(data[to : to + 16384]))
            to = min(to + 16384, len(data))
    except zlib.error:
        return None
    return (b"".join(parts), to - at - len(engine.unused_data)) if engine.eof else None


def _find(data: memoryview, what: bytes, at: int) -> int:
    """First place of ``what`` from ``at`` on; the end if there is none."""
    step = 1 << 20
    while at < len(data):
        found = bytes(data[at : at + step + len(what) - 1]).find(what)
        if found >= 0:
            return at + found
        at += step
    return len(data)


def _next_member(data: memoryview, at: int) -> int:
    return _find(data, MEMBER, at)


def _salvage_records(data: memoryview, base: int) -> Iterator[tuple]:
    """Goes from record to record; after a failed check, to the next version line with a valid record."""
    at, bad, reason = 0, 0, ""
    while at < len(data):
        record = _parsed(data, at)
        if isinstance(record, str):
            reason = reason or record
            at = _find(data, VERSION, at + 1)
            continue
        if at > bad:
            yield (base + bad, at - bad, "gap", reason, None, None, None, None)
        headers, length, payload, digest = record
        yield (base + at, length, "record", None, list(headers.items()), len(payload), digest, payload)
        at = bad = at + length
        reason = ""
    if at > bad:
        yield (base + bad, len(data) - bad, "gap", reason, None, None, None, None)


def _head_end(data: memoryview, at: int) -> int:
    """End of the header at ``at``, of any length; -1 if another version line or the end comes first."""
    step = 4096
    while True:
        part = bytes(data[at : at + step])
        end, other = part.find(END), part.find(b"\r\n" + VERSION)
        if end >= 0 and not 0 <= other < end:
            return at + end
        if other >= 0 or at + step >= len(data):
            return -1
        step *= 4


def _parsed(data: memoryview, at: int) -> tuple[dict[str, str], int, bytes, str] | str:
    """The record at ``at``: headers, length, payload and its digest; or why there is none."""
    if bytes(data[at : at + len(VERSION)]) != VERSION:
        return "no version line"
    head_end = _head_end(data, at)
    if head_end < 0:
        return "header doesn't end"
    head = bytes(data[at:head_end]).decode("utf-8", "replace").split("\r\n")
    headers = {}
    for line in head[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!-9;-~]+", name):
            return "malformed header"
        headers[name.lower()] = value.strip()
    if not re.fullmatch(r"[0-9]{1,18}", headers.get("content-length", "")):
        return "no content length"
    begin = head_end + len(END)
    end = begin + int(headers["content-length"])
    if bytes(data[end : end + len(END)]) != END:
        return "record doesn't end where it should"
    payload = bytes(data[begin:end])
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    declared = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if headers.get("warc-type") == "response" and declared and declared != digest:
        return "payload digest differs"
    return headers, end + len(END) - at, payload, digest


class LostRecords(RuntimeError):
    """The archives don't give back what was written to them."""


def archive_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per page and reads the archives back: page_id, payload_bytes,
    payload_digest, record_type, refers_to.

    What the reader finds is written as a table, gaps included; if there is a gap, or if there are more
    or fewer records than pages, they are logged and LostRecords is raised.  Ids of any type and
    content come back as they were.  An empty table gives an empty result.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType
    bound_arrow_batches(spark)
    path = write_warc(capture_records(df, id_col, url_col, html_col), new_path(spark, "warc"))
    rows = staged(read_warc(spark, path, with_payload=False), "warcrows")
    check_whole(rows, df.count())
    header = lambda name: F.try_element_at("headers", F.lit(name))
    number = lambda c: page_of_urn(c).cast(kind)
    revisit = header("warc-type") == "revisit"
    return rows.where(F.col("kind") == "record").select(
        number(header("warc-record-id")).alias("page_id"),
        F.when(revisit, header("x-payload-length").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace(header("warc-payload-digest"), "^sha1:", "")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        header("warc-type").alias("record_type"),
        F.when(revisit, number(header("warc-refers-to"))).alias("refers_to"),
    )


def check_whole(rows: DataFrame, expected: int) -> None:
    """Raises LostRecords unless ``rows`` of ``read_warc`` are ``expected`` records and no gap."""
    kinds = {r["kind"]: r for r in rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes")).collect()}
    found, gaps = kinds["record"]["n"] if "record" in kinds else 0, kinds.get("gap")
    if gaps:
        for r in rows.where(F.col("kind") == "gap").select("file", "offset", "length", "reason").limit(20).collect():
            _LOG.error("quarantined %s bytes at %s of %s: %s", r["length"], r["offset"], r["file"], r["reason"])
    if gaps or found != expected:
        raise LostRecords(f"{found} of {expected} records read back, {gaps['n'] if gaps else 0} gaps of {gaps['bytes'] if gaps else 0} bytes")
