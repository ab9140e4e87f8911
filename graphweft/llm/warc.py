"""WARC archives: writing with segments and chunked framing, and segment reassembly (free style).

Pages become response records, or revisit records if an earlier page has the same payload. A record
whose block is longer than a segment is split into continuation records, which carry the identifier
of the record they continue and a segment number. Reading groups the segments by that identifier,
orders them by number, verifies the total length and decodes the chunked transfer framing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.llm.common import materialise, scratch_path, small_batches, tidy

SEGMENT = 1 << 16
CHUNK = 1 << 13
RECORDS_PER_FILE = 2_000  # of a segment at most each: a file has a proven size bound
_END = b"\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(payload[k : k + size]), payload[k : k + size]) for k in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped, broken framing is an error."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        n = int(body[at:line].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + n])
        at = line + 2 + n
        if len(out[-1]) != n or body[at : at + 2] != b"\r\n":
            raise ValueError("broken chunk")
        at += 2


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def _address(url: str) -> str:
    """An address without white space, which would end the field."""
    return re.sub(r"\s", lambda m: quote(m.group()), url)


def records_of(page_id, url: str | None, payload: bytes, refers_to, nonce: str, segment: int = SEGMENT, refers_url: str | None = None) -> list[bytes]:
    """The records of one page, without the two line ends that close each."""
    digest = base32_sha1(payload)
    name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {nonce}')}>"
    common = [("WARC-Date", _DATE), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        common.append(("WARC-Target-URI", _address(url)))
    if page_id is not None:
        common.append(("WARC-Page-ID", str(page_id)))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", name), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page-ID", str(refers_to)), ("WARC-Refers-To-Date", _DATE)]
        fields += [("WARC-Refers-To-Target-URI", _address(refers_url))] if refers_url is not None else []
        return [_record([*fields, *common, ("Content-Type", "application/http;msgtype=response")], http + b"Content-Length: %d\r\n\r\n" % len(payload))]
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("Content-Type", "application/http;msgtype=response")]
    if len(block) <= segment:
        return [_record(fields, block)]
    out = [_record([*fields, ("WARC-Segment-Number", "1")], block[:segment])]
    starts = range(segment, len(block), segment)
    for number, at in enumerate(starts, 2):
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {number}')}>"), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(number))]
        if at == starts[-1]:
            own.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record(own, block[at : at + segment]))
    return out


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, sha, refers_to, refers_url): pages whose payload of at least `least` bytes an earlier page has too."""
    own = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    own = own.filter(F.octet_length("payload") >= least).select("page_id", "url", F.unhex(F.sha1("payload")).alias("sha"))
    first = own.filter("page_id is not null").groupBy("sha").agg(F.min(F.struct("page_id", "url")).alias("first")).select("sha", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"))
    return own.select("page_id", "sha").join(first, "sha").filter("page_id > refers_to or page_id is null").select("page_id", "sha", "refers_to", "refers_url").distinct()


def write_archives(spark: SparkSession, pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT) -> None:
    """Archive files under path, of at most RECORDS_PER_FILE records each.

    A revisit names the response's page, and, as the format has it, its address and date.
    """
    small_batches(spark)
    again = revisits(pages, least).select(F.col("page_id").alias("again_id"), F.col("sha").alias("again_sha"), "refers_to", "refers_url")
    own = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    matched = own.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.unhex(F.sha1("payload")) == F.col("again_sha")), "left")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            out = []
            for page_id, url, payload, refers_to, refers_url in zip(*(c for c in batch.columns)):
                n += 1
                out += records_of(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), f"{part} {n}", segment, refers_url.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    written = matched.select("page_id", "url", "payload", "refers_to", "refers_url").mapInArrow(tidy(records), "record binary")
    # a text row is written as it is: the separator ends each record as the format asks
    written.select(F.col("record").cast("string").alias("value")).write.option("lineSep", _END.decode()).option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)


class Broken(ValueError):
    """A record that can't be read."""


_AT_ONCE = 1 << 16


def _plain(content: bytes) -> Iterator[bytes]:
    """The bytes of a file, plain or of any number of gzip members, some at a time; all there are before an error."""
    if content[:2] != b"\x1f\x8b":
        yield from (content[k : k + _AT_ONCE] for k in range(0, len(content), _AT_ONCE))
        return
    at = 0
    while at < len(content):
        member = zlib.decompressobj(31)
        while not member.eof:
            some = member.unconsumed_tail
            if not some:
                some = content[at : at + _AT_ONCE]
                at += len(some)
            part = member.decompress(some, 8 * _AT_ONCE)
            if not part and not some:
                raise EOFError("a member is cut off")
            yield part
        at -= len(member.unused_data)


class _Stream:
    """Lines and blocks of a sequence of byte strings."""

    def __init__(self, parts: Iterator[bytes]):
        self._parts, self._held, self._at = parts, b"", 0

    def _take(self, n: int) -> bytes:
        out = self._held[self._at : self._at + n]
        self._at += len(out)
        return out

    def _more(self) -> bool:
        for part in self._parts:
            if part:
                self._held, self._at = self._held[self._at :] + part, 0
                return True
        return False

    def readline(self) -> bytes:
        while (end := self._held.find(b"\n", self._at)) < 0:
            if not self._more():
                return self._take(len(self._held))
        return self._take(end + 1 - self._at)

    def read(self, n: int) -> bytes:
        out = [self._take(n)]
        left = n - len(out[0])
        while left and self._more():
            out.append(self._take(left))
            left -= len(out[-1])
        return b"".join(out)


def _until_record(stream: _Stream) -> bytes:
    """The next line that begins a record; empty at the end. Empty lines between records are passed over."""
    while line := stream.readline():
        if line.startswith(b"WARC/"):
            return line
        if line.strip():
            raise Broken("no record where one should begin")
    return b""


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(fields, block) of each record of an archive file, plain or of any number of gzip members; field names in small letters.

    Records are read one after another from the compressed bytes, so that one of them is in memory. A record that
    can't be read has a block of None, and reading goes on at the next line that begins a record; compressed
    bytes that are broken end the file.
    """
    stream = _Stream(_plain(content))
    fields: dict[str, str] = {}
    while True:
        try:
            if not fields.pop("", None) and not _until_record(stream):
                return
            fields = {}
            while (line := stream.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                fields[name.strip().lower()] = value.strip()
            if not fields.get("content-length", "").isdigit():
                raise Broken("no length")
            block = stream.read(int(fields["content-length"]))
            if len(block) != int(fields["content-length"]):
                raise Broken("cut off")
            yield fields, block
            fields = {}
        except Broken:
            yield fields, None
            fields = {}
            while line := stream.readline():
                if line.startswith(b"WARC/"):
                    fields = {"": "begun"}
                    break
            else:
                return
        except (EOFError, zlib.error):
            yield fields, None
            return


def payload_of(block: bytes) -> tuple[bytes, int]:
    """The payload of an HTTP response block, and the length that its header names (-1: none)."""
    head, _, body = block.partition(_END)
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        return unchunked(body), -1
    return body, int(fields.get(b"content-length", b"-1"))


_PARSED = "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary, origin string, segment int, total bigint, block binary"
_PARSED_ARROW = pa.schema(
    [("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())]
)


def _finished(page_id: str | None, block: bytes, with_payload: bool) -> tuple:
    try:
        payload, _ = payload_of(block)
    except ValueError:  # the chunked framing
        return page_id, None, None, "broken", None, None, None, None, None, None
    return page_id, len(payload), base32_sha1(payload), "response", None, payload if with_payload else None, None, None, None, None


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload of each page in the archives.

    Lengths and digests are taken from the reassembled, decoded payload; a revisit record has none
    and gives what its header says. Segments may be in any file and order. A record whose segments
    are not complete, or don't add up to the total length, has null for these columns; one that can't
    be read, or whose chunks are broken, has null and the record_type `broken`, and the others are read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out, size = [], 0
                for fields, block in parse(content.as_py()):
                    kind, page_id = fields.get("warc-type"), fields.get("warc-page-id")
                    if block is None:
                        out.append((page_id, None, None, "broken", *[None] * 6))
                        continue
                    number = fields.get("warc-segment-number")
                    if kind == "revisit":
                        digest = fields.get("warc-payload-digest", "").rpartition(":")[2]
                        out.append((page_id, payload_of(block)[1], digest, "revisit", fields.get("warc-refers-to-page-id"), None, None, None, None, None))
                    elif number is not None and kind in ("response", "continuation"):
                        total = fields.get("warc-segment-total-length")
                        origin = fields.get("warc-segment-origin-id", fields.get("warc-record-id"))
                        out.append((page_id, None, None, None, None, None, origin, int(number), int(total) if total else None, block))
                        size += len(block)
                    elif kind == "response":
                        out.append(_finished(page_id, block, with_payload))
                        size += len(block) if with_payload else 0
                    if size > 16_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PARSED_ARROW)], schema=_PARSED_ARROW)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PARSED_ARROW)], schema=_PARSED_ARROW)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, total, parts in zip(*(c for c in batch.columns)):
                parts = parts.as_py()
                block = b"".join(p["block"] for p in parts)
                whole = [p["segment"] for p in parts] == list(range(1, len(parts) + 1)) and total.as_py() == len(block)
                out.append(_finished(page_id.as_py(), block, with_payload) if whole else (page_id.as_py(), *[None] * 9))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 10, _PARSED_ARROW)], schema=_PARSED_ARROW)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("length") > 0).select("content")
    parsed = materialise(spark, files.mapInArrow(tidy(scan), _PARSED), "warc-records")
    split = parsed.filter("origin is not null").groupBy("origin").agg(
        F.max("page_id").alias("page_id"), F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts")
    )
    joined = split.select("page_id", "total", "parts").mapInArrow(tidy(join), _PARSED)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return parsed.filter("origin is null").select(*columns).unionByName(joined.select(*columns))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """One row per page, from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload. A null page_id stays null; it refers to the first page with its
    payload if there is one. Repeated rows are written each; those that tie for the smallest page_id
    are all responses. No pages give no rows. Other columns are ignored.
    """
    path = scratch_path(spark, "archives")
    write_archives(spark, pages, path)
    kind = pages.schema["page_id"].dataType
    found = read_archives(spark, path, with_payload=False)
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
