"""WARC archives: writing with revisits, and a reader that salvages damaged files.

Writing.  Every row becomes one WARC/1.0 record in a gzip member of its own.  Of the records with equal
payloads (by SHA-1; at least ``min_bytes`` long) the one with the smallest page_id is a ``response``,
the others are ``revisit`` records that refer to it; shorter payloads are always responses.  Archives
go through Spark's text writer, whose lines end in a zero byte: the last byte of a member is the top
byte of its length, so the files are plain concatenated members (after a record of 16 MB or more, one
byte of zero padding follows, which gzip allows).  So any store that Spark can write will do.

Files are bounded by bytes: members are packed, and a file takes ``PACKS`` packs of about ``PACK_BYTES``, or one
record if that is longer.

Reading.  Archives of gzip members, plain records, or both.  A record counts when its checks hold: gzip
CRC, version line, header block of any length, declared length, closing blank lines, payload digest.  After
a failed check the reader goes on at the next byte where a member or a version line starts and whole
checks hold again; the bytes between are logged as a quarantined gap with the reason of the first failure.
Inside a member of several records it does the same.  Of a member that is itself damaged, the part that
can still be inflated is searched too, and records proved by their payload digest are recovered (with
length 0, as the member's bytes are the gap).  The next place of each signature is remembered, and so is how
far a run of header lines is known to fail, so the search takes linear time in a damaged file.

A null html is an empty payload; a null page_id has no id in its record; a null url has no line, and one with
line breaks is written in one line.  Urls and payloads may be of any length up to a file's limit of 2 GB.  Rows that
repeat the smallest page_id of their payload are all responses.  An empty table gives no archive and no
record.  Other columns are not archived, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm.base import slices, stage, work_folder

VERSION, MEMBER, BLANK = b"WARC/1.", b"\x1f\x8b\x08", b"\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
CHUNK = 1 << 16
#: Bytes of a pack of members, and packs of a file; bytes of payload that the reader hands on at once.
PACK_BYTES, PACKS = 1 << 22, 32
HANDED_BYTES = 1 << 24


def digest(payload: bytes) -> str:
    """Base-32 SHA-1 in upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: object) -> str:
    return " ".join(str(value).split())


def page_urn(page_id: object) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """A response record, or a revisit of ``refers_to`` that keeps the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    lines = ["WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {page_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {page_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + BLANK + block + BLANK


def member(record: bytes, level: int = 6) -> bytes:
    """One gzip member without time or name, so that equal records give equal bytes."""
    coder = zlib.compressobj(level, zlib.DEFLATED, 31)
    return coder.compress(record) + coder.flush()


@dataclass
class Record:
    """A sound record: where it lies in the file, its header fields, and its payload."""

    offset: int
    length: int
    fields: dict[str, str]
    payload: bytes
    payload_bytes: int


@dataclass
class Gap:
    """Quarantined bytes and the first check that failed in them."""

    offset: int
    length: int
    reason: str


class Unsound(Exception):
    """A check that failed; of a damaged member, with the records that could be rescued."""

    rescued: list[Record] = []
    until = 0


class Finder:
    """Next places of byte strings; a place stays known until the search has passed it."""

    def __init__(self, data: bytes) -> None:
        self.data, self.known = data, {}
        #: Header lines that begin before here, at a line's start, are known to lead to a fault.
        self.doomed, self.why = 0, ""

    def next(self, what: bytes, at: int) -> int:
        """The first place at or after ``at``, or -1."""
        since, place = self.known.get(what, (0, -2))
        if place == -2 or -1 < place < at:
            place = self.data.find(what, at)
        elif at < since:
            nearer = self.data.find(what, at, since + len(what) - 1)
            if nearer >= 0:
                return nearer
        else:
            return place
        self.known[what] = (at, place)
        return place


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What the member at ``at`` holds, its end, and what is wrong with it, if anything."""
    coder, out, pos = zlib.decompressobj(31), [], at
    try:
        while not coder.eof:
            if pos >= len(data):
                return b"".join(out), pos, "gzip member is cut off"
            out.append(coder.decompress(data[pos : pos + CHUNK]))
            pos += CHUNK
    except zlib.error as e:
        # The faulty chunk once more in small steps, for what comes before the fault.
        coder, again = zlib.decompressobj(31), []
        try:
            for step in range(at, pos, CHUNK):
                coder.decompress(data[step : step + CHUNK])
            for step in range(pos, pos + CHUNK, 64):
                again.append(coder.decompress(data[step : min(step + 64, pos + CHUNK)]))
        except zlib.error:
            pass
        return b"".join(out + again), pos, f"gzip: {e}"
    return b"".join(out), min(pos, len(data)) - len(coder.unused_data), None


def _header(find: Finder, at: int) -> tuple[dict[str, str], int]:
    """Fields of the header block at ``at``, and where its block starts."""
    data, fields = find.data, {}
    stop = find.next(b"\r\n", at)
    if 0 <= stop < find.doomed:
        raise Unsound(find.why)
    try:
        while True:
            if stop < 0:
                raise Unsound("header block doesn't end")
            line = stop + 2
            stop = find.next(b"\r\n", line)
            if stop == line:
                return fields, line + 2
            name, colon, value = data[line:stop].partition(b":") if stop >= 0 else (b"", b":", b"")
            if not colon:
                raise Unsound("header line without a colon")
            fields[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    except Unsound as e:
        # Whatever starts before this line and has no fault of its own before it meets the same lines.
        find.doomed, find.why = len(data) if stop < 0 else line, str(e)
        raise


def parse_record(data: bytes | Finder, at: int = 0) -> tuple[dict[str, str], bytes, int, int]:
    """Fields, payload, payload length and end of the record that starts at ``at``; raises Unsound."""
    find = data if isinstance(data, Finder) else Finder(data)
    data = find.data
    if not data.startswith(VERSION, at):
        raise Unsound("no version line")
    fields, start = _header(find, at)
    if not fields.get("content-length", "").isdecimal() or not {"warc-type", "warc-record-id"} <= fields.keys():
        raise Unsound("a required header is missing")
    end = start + int(fields["content-length"])
    if data[end : end + len(BLANK)] != BLANK:
        raise Unsound("record isn't closed at its declared length")
    payload, size = data[start:end], end - start
    if fields.get("content-type", "").startswith("application/http"):
        head, _, payload = payload.partition(BLANK)
        sizes = [x.partition(b":")[2].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size = int(sizes[0]) if sizes and sizes[0].isdigit() else len(payload)
        if fields["warc-type"] == "response" and size != len(payload):
            raise Unsound("payload differs from its HTTP length")
    said = fields.get("warc-payload-digest", "")
    if said.startswith("sha1:") and fields["warc-type"] != "revisit" and said[5:] != digest(payload):
        raise Unsound("payload digest differs")
    return fields, payload, size, end + len(BLANK)


def _proved(record: Record) -> bool:
    """Whether a digest vouches for the payload."""
    return record.fields["warc-type"] != "revisit" and record.fields.get("warc-payload-digest", "").startswith("sha1:")


def _member(data: bytes, at: int) -> tuple[list[Record | Gap], int]:
    """What the gzip member at ``at`` holds, and its end; raises Unsound with ``rescued`` records if it is damaged."""
    inner, end, wrong = _inflate(data, at)
    found = list(salvage(inner, members=False))
    if wrong is not None or not any(isinstance(x, Record) for x in found):
        fault = Unsound(wrong or next((x.reason for x in found), "empty member"))
        fault.rescued = [Record(at, 0, x.fields, x.payload, x.payload_bytes) for x in found if isinstance(x, Record) and _proved(x)]
        fault.until = min(end + CHUNK, len(data))
        raise fault
    out: list[Record | Gap] = []
    for x in found:
        if isinstance(x, Gap):
            out.append(Gap(at, end - at, f"{x.reason} (bytes {x.offset} to {x.offset + x.length} of the member)"))
        else:
            out.append(Record(at, end - at, x.fields, x.payload, x.payload_bytes))
    return out, end


def salvage(data: bytes, members: bool = True) -> Iterator[Record | Gap]:
    """All sound records of an archive, and the gaps between them, in file order (a damaged member's records before its gap)."""
    find = Finder(data)
    signs = (MEMBER, VERSION) if members else (VERSION,)
    at, gap, reason = 0, None, ""
    twice, until = set(), 0  # a damaged member's records may also stand in its bytes as they are
    while at < len(data):
        if gap is None and data[at] == 0:
            at += 1
            continue
        try:
            if members and data.startswith(MEMBER, at):
                found, end = _member(data, at)
            else:
                fields, payload, size, end = parse_record(find, at)
                found = [Record(at, end - at, fields, payload, size)]
                if at < until and (fields["warc-record-id"], payload) in twice:
                    at = end
                    continue
        except Unsound as e:
            if e.rescued:
                yield from e.rescued
                twice, until = {(x.fields["warc-record-id"], x.payload) for x in e.rescued}, e.until
            if gap is None:
                gap, reason = at, str(e)
            at = min((x for x in (find.next(sign, at + 1) for sign in signs) if x >= 0), default=len(data))
            continue
        if gap is not None:
            yield Gap(gap, at - gap, reason)
            gap = None
        yield from found
        at = end
    if gap is not None:
        yield Gap(gap, len(data) - gap, reason)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, pack_bytes: int = PACK_BYTES, packs: int = PACKS) -> None:
    """Write ``pages`` (page_id, url, html) as archives below ``path``."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("same", F.when(F.octet_length("html") >= min_bytes, F.sha1(F.col("html").cast("binary"))))
    firsts = rows.where("same is not null").groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("same", "first")
    # Written, so that the join stands on two plain exchanges and a hot payload's partition can be split.
    marked = rows.join(stage(firsts, "warc-firsts"), "same", "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packs of members; the zero byte that ends a pack is the text writer's."""
        held, size = [], 0

        def pack() -> pa.RecordBatch:
            whole = b"".join(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([whole[:-1] if whole[-1:] == b"\0" else whole], pa.binary())], names=["pack"])

        for batch in slices(batches, 500):
            for i, u, h, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = member(build_record(i, u, h.encode(), r))
                if held and size + len(new) > pack_bytes:
                    yield pack()
                    size = 0
                held.append(new)
                size += len(new)
        if held:
            yield pack()

    written = marked.mapInArrow(build, "pack binary").select(F.col("pack").cast("string").alias("value"))
    written.write.option("lineSep", "\0").option("maxRecordsPerFile", packs).text(path)


ENTRIES = "file string, position long, length long, gap string, record_type string, page_id long, refers_to long, url string, payload_bytes long, payload_digest string, payload binary"


def _number(urn: str | None) -> int | None:
    inner = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner.lstrip("-").isdecimal() else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per sound record, and one per quarantined gap (``gap`` says why; it has no record fields)."""
    names = [x.split()[0] for x in ENTRIES.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in ENTRIES.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for x in salvage(content.as_py()):
                    if isinstance(x, Gap):
                        rows.append((file, x.offset, x.length, x.reason, *[None] * 7))
                    else:
                        f = x.fields
                        size += len(x.payload)
                        rows.append((file, x.offset, x.length, None, f["warc-type"], _number(f["warc-record-id"]), _number(f.get("warc-refers-to")), f.get("warc-target-uri"), x.payload_bytes, f.get("warc-payload-digest", "").removeprefix("sha1:") or None, x.payload))
                    if len(rows) >= 200 or size >= HANDED_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, ENTRIES)


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    path = f"{work_folder(pages.sparkSession)}/warc-{uuid4().hex}"
    write_archives(pages, path, min_bytes)
    return read_archives(pages.sparkSession, path)
