"""WARC archives: a writer with revisit records and a reader that salvages.

The writer turns every page into one record of text (WARC/1.1, HTTP block) and
lets Spark's text sink write the archives, records ended by CRLF CRLF.  Of equal
payloads one record is a response; the others are revisits that refer to it.

The reader checks each record: version line, header lines, length, the two line
ends behind the block, digest of the payload.  Where a check fails it looks for
the next version line or gzip member, goes on from there and reports the bytes in
between as a gap.  Archives are read as files of bounded size
(``records_per_file``), so a task holds one archive.

Defined cases: null html is an empty payload; a null url writes no target URI;
null page ids are responses, as nothing can refer to them; rows that repeat a
page are written each and share their type; an empty table gives an empty
archive; columns other than page_id, url and html are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapescope.llm.common import written

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
#: Bytes an archive has on average, and bytes of one batch of read records.
ARCHIVE_BYTES, OUT_BYTES = 16 << 20, 4 << 20
#: Bytes inflated at once around an error, and bytes inflation may have read ahead of what it returned.
PIECE, AHEAD = 1 << 16, 8
#: Copied payloads (about 100 bytes each) that are broadcast at most.
BROADCAST_ROWS = 200_000


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a hexadecimal SHA-1: five hex digits are four characters."""
    def four(i: int) -> list[Column]:
        n = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        return [F.substring(F.lit(BASE32), F.shiftright(n, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]

    return F.concat(*[c for i in range(8) for c in four(i)])


def typed(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages with payload size, digest, record type and the page a revisit refers to."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    own = own.withColumns({"size": F.octet_length("payload").cast("long"), "sha1": F.sha1(F.col("payload").cast("binary"))})
    # one row for each payload that several pages have; large groups of copies are reduced before the shuffle
    first = own.where(F.col("size") >= least_bytes).groupBy("sha1", "size").agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n"))
    first = written(first.where("n > 1").drop("n"), "copied-payloads")
    # few enough of them go to every task, so that payloads stay where they are; else both sides are shuffled
    out = own.join(F.broadcast(first) if first.count() <= BROADCAST_ROWS else first, ["sha1", "size"], "left")
    revisit = F.coalesce(F.col("page_id") < F.col("newest"), F.lit(False))
    return out.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("newest")),
                            "payload_digest": base32_of_hex(F.col("sha1"))}).drop("newest", "sha1")


def _uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def records(pages: DataFrame) -> DataFrame:
    """One ``value`` a page: its record without the ending line ends."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(F.col("record_type") == "revisit", http).otherwise(F.concat(http, F.col("payload")))
    url = F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "%20")  # a header is one line
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _uri(F.col("page_id"))), line("WARC-Date", F.lit(EPOCH)),
        line("WARC-Target-URI", url), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(F.col("record_type") == "revisit", F.concat(line("WARC-Refers-To", _uri(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", F.octet_length("_block").cast("string")), F.lit("\r\n"))
    return pages.withColumn("_block", block).select(F.concat(head, F.col("_block")).alias("value"))


def write(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as archives of about ``archive_bytes`` under ``path``."""
    n, size = pages.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col("html").cast("string"))), F.lit(0))).first()
    per_file = max(1, int(archive_bytes // max(1, size / max(1, n) + 600)))
    records(typed(pages, least_bytes)).write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(path)


# ---- reading

_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_NEXT = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_TERMINATED = re.compile(rb"(?:\r\n){2}")


class Bad(Exception):
    """A record fails a check."""


def parse_record(data: bytes | memoryview, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at ``at``; raises Bad."""
    version = _VERSION.match(data, at)
    if not version:
        raise Bad("no version line")
    stop = data.find(b"\r\n\r\n", version.end() - 2)
    if stop < 0:
        raise Bad("header does not end")
    headers: dict[str, str] = {}
    for line in data[version.end():stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if line and not colon:
            raise Bad("header line without colon")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit() or len(length) > 18:
        raise Bad("no length")
    start = stop + 4
    end = start + int(length)
    if end > len(data):
        raise Bad("block is cut off")
    if not _TERMINATED.match(data, end):
        raise Bad("block is not followed by two line ends")
    block = bytes(data[start:end])
    digest = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and digest.startswith("sha1:") and sha1_base32(payload_of(block)) != digest[5:]:
        raise Bad("payload digest differs")
    return headers, block, end + 4


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP header of a block."""
    return block.partition(b"\r\n\r\n")[2]


def _member(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What inflates of the gzip member at ``at``, its end, and what is wrong with it."""
    inflate = zlib.decompressobj(31)
    try:
        content = inflate.decompress(memoryview(data)[at:])
    except zlib.error as error:
        return _inflated_before_error(data, at), len(data), f"gzip member: {error}"
    return content, len(data) - len(inflate.unused_data), None if inflate.eof else "gzip member is cut off"


def _inflated_before_error(data: bytes, at: int) -> bytes:
    """All bytes that inflate before the member fails: an error loses its whole call, so less is fed at once around it."""
    inflate, parts, piece = zlib.decompressobj(31), [], PIECE
    while piece and at < len(data):
        before = inflate.copy()
        try:
            parts.append(inflate.decompress(data[at:at + piece]))
        except zlib.error:
            inflate, piece = before, piece // 2
            continue
        at += piece
    return b"".join(parts)


def _taken(data: bytes, at: int, inflated: int) -> int:
    """Where in the archive the last of the first ``inflated`` bytes of the member at ``at`` is at hand."""
    inflate = zlib.decompressobj(31)
    inflate.decompress(memoryview(data)[at:], inflated - 1)  # one more could run into the error
    return len(data) - len(inflate.unconsumed_tail)


def _records(content: bytes) -> Iterator[tuple[str, int, int, dict[str, str] | str, bytes]]:
    """Records and gaps over bytes that hold no gzip members."""
    at, gap = 0, None
    while at < len(content):
        try:
            headers, block, end = parse_record(content, at)
        except Bad as bad:
            gap = gap or (at, str(bad))
            following = _VERSION.search(content, at + 1)
            at = following.start() if following else len(content)
            continue
        if gap:
            yield "gap", gap[0], at, gap[1], b""
            gap = None
        yield "record", at, end, headers, block
        at = end
    if gap:
        yield "gap", gap[0], len(content), gap[1], b""


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict[str, str] | str, bytes]]:
    """('record', start, end, headers, block) and ('gap', start, end, reason, b'') over all bytes of an archive.

    A record inside a gzip member has the member's range, and so has a gap between
    such records, whose reason names its range in the inflated bytes.  A member that
    is corrupt or cut gives the records inflated before the first damage (behind it
    bytes may be copies of wrong ones, also in headers, which have no digest) and ends
    with the last; a corrupt or cut member of a single record is a gap.
    """
    at, size = 0, len(data)
    gap: tuple[int, str] | None = None
    while at < size:
        wrong = None
        try:
            if data[at:at + 3] == b"\x1f\x8b\x08":
                content, end, wrong = _member(data, at)
                found = list(_records(content))
                if wrong and len(found) == 1:
                    raise Bad(wrong)  # nothing but one record, which the member's own check covers
                if wrong:
                    found = list(takewhile(lambda x: x[0] == "record", found))
                good = max((x[2] for x in found if x[0] == "record"), default=0)
                if not good and (wrong or content):
                    raise Bad(wrong or found[0][3])
                if wrong:
                    taken = _taken(data, at, good)
                    following = _NEXT.search(data, max(at + 1, taken - AHEAD))
                    end = min(taken, following.start()) if following else taken
            else:
                headers, block, end = parse_record(data, at)
                found = [("record", at, end, headers, block)]
        except Bad as bad:
            gap = gap or (at, str(bad))
            following = _NEXT.search(data, at + 1)
            at = following.start() if following else size
            continue
        if gap:
            yield "gap", gap[0], at, gap[1], b""
            gap = None
        for kind, first, last, what, block in found:
            yield kind, at, end, what if kind == "record" else f"{what} (inflated bytes {first} to {last})", block
        if wrong:
            gap = (end, wrong)
            following = _NEXT.search(data, end)
            end = following.start() if following else size
        at = end
    if gap:
        yield "gap", gap[0], size, gap[1], b""


SCHEMA = ("path string, kind string, start long, end long, reason string, record_type string, record_id string, target_uri string, refers_to string, "
          "digest string, http_length long, payload binary")
_OUT = pa.schema([("path", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string()), ("record_type", pa.string()),
                  ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("http_length", pa.int64()),
                  ("payload", pa.binary())])
_HTTP_LENGTH = re.compile(rb"\r\nContent-Length: *([0-9]{1,18})\r\n", re.IGNORECASE)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of all archives under ``path``: ``kind`` is record or gap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows, held = [], 0
                for kind, start, end, what, block in salvage(content.as_py()):
                    if kind == "gap":
                        rows.append((name.as_py(), kind, start, end, what, *[None] * 7))
                        continue
                    http = _HTTP_LENGTH.search(block[:block.find(b"\r\n\r\n") + 2])
                    rows.append((name.as_py(), kind, start, end, None, what.get("warc-type"), what.get("warc-record-id"), what.get("warc-target-uri"),
                                 what.get("warc-refers-to"), what.get("warc-payload-digest"), int(http.group(1)) if http else None, payload_of(block)))
                    held += len(block)
                    if held >= OUT_BYTES:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, SCHEMA)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)
