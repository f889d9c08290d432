"""WARC archives: a writer with revisit records and a salvaging reader.

Each record is a gzip member of its own.  The reader checks every member and
record; where a check fails it searches for the next gzip member or version line
that yields a valid record, goes on from there and logs the bytes in between.  It
takes archives of other writers too: plain ones, members of several records, of
which a damaged one keeps its valid records, headers in any case and digests by
any of the usual algorithms.

Cases: a null payload counts as empty; a null url is written as an empty target;
repeated page_ids give repeated records; no pages give no archives; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._shared import columns, lookup_skewed, make_folder, materialize, scratch
from .token_files import get_file, put_file

VERSION = b"WARC/1.1"
_GZIP = b"\x1f\x8b\x08"
_DATE = "2024-01-01T00:00:00Z"


class Headers(dict):
    """Header fields, whose names are alike in upper and lower case."""

    def __init__(self, fields=()):
        super().__init__()
        for name, value in fields:
            self.setdefault(name.lower(), value)

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def get(self, name: str, default=None):
        return super().get(name.lower(), default)


@dataclass
class Record:
    headers: Headers
    block: bytes


@dataclass
class Salvage:
    """What a reader found: records with their offsets (of their member, if compressed),
    and (start, end, why) of each gap.

    Bytes of a damaged member that its records do not explain are a gap of the
    whole member.
    """

    records: list[tuple[int, Record]] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def digest_differs(said: str | None, data: bytes) -> bool:
    """Whether a digest header is of another content.  Algorithms and encodings that
    are not known can't be checked and count as right."""
    name, colon, value = (said or "").strip().partition(":")
    name = name.lower().replace("-", "")
    if not colon or name not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return False
    made = hashlib.new(name, data).digest()
    known = {made.hex(), base64.b32encode(made).decode().rstrip("=").lower()}
    return value.rstrip("=").lower() not in known and value.rstrip("=") != base64.b64encode(made).decode().rstrip("=")


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    """One record, not compressed, with its length and block digest."""
    lines = {**headers, "WARC-Block-Digest": _sha1(block), "Content-Length": str(len(block))}
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in lines.items())
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[Record, int]:
    """The record that starts at ``at`` and the offset after it; ValueError if it fails a check."""
    if not data.startswith((b"WARC/1.", b"WARC/0."), at):
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("headers do not end")
    fields: list[list[str]] = []
    for line in data[at:end].split(b"\r\n")[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and fields:  # a folded line goes on
            fields[-1][1] = f"{fields[-1][1]} {text.strip()}".strip()
            continue
        name, colon, value = text.partition(":")
        if not colon:
            raise ValueError("bad header line")
        fields.append([name.strip(), value.strip()])
    headers = Headers(fields)
    length = headers.get("Content-Length", "")
    if not (length.isascii() and length.isdigit()):
        raise ValueError("bad length")
    start, size = end + 4, int(length)
    block = data[start : start + size]
    if len(block) < size or data[start + size : start + size + 4] != b"\r\n\r\n":
        raise ValueError("block does not end where its length says")
    if digest_differs(headers.get("WARC-Block-Digest"), block):
        raise ValueError("block digest differs")
    return Record(headers, block), start + size + 4


def _plain(data: bytes, marks: tuple[bytes, ...] = (b"WARC/1.", b"WARC/0.")) -> tuple[list[Record], str]:
    """All valid records of uncompressed bytes, and the first check that failed."""
    found, at, why = [], 0, ""
    while at < len(data):
        try:
            record, at = parse_record(data, at)
            found.append(record)
        except ValueError as e:
            why = why or str(e)
            at = min((m for m in (data.find(x, at + 1) for x in marks) if m >= 0), default=len(data))
    return found, why


def _member(data: bytes, at: int) -> tuple[list[Record], int, str]:
    """Records of the gzip member at ``at``, the offset after it and what is wrong with it.

    Of a member whose stream breaks off or fails its checksum the records up to
    there count, as they have digests or lengths of their own; where it ends is
    then unknown, and given as ``at``.
    """
    inflate, view, parts, end, why = zlib.decompressobj(31), memoryview(data), [], at, ""
    try:
        while not inflate.eof and end < len(data):
            parts.append(inflate.decompress(view[end : end + 4096]))
            end = min(len(data), end + 4096)
    except zlib.error as e:
        why = f"gzip: {e}"
    if not inflate.eof and not why:
        why = "gzip member does not end"
    found, bad = _plain(b"".join(parts))
    if why:
        return [r for r in found if r.headers.get("WARC-Block-Digest")], at, why
    return found, end - len(inflate.unused_data), bad


def read_archive(data: bytes) -> Salvage:
    """All valid records, compressed or not, whatever lies between them."""
    out, at, gap, why = Salvage(), 0, None, ""
    while at < len(data):
        start, end, records, bad = at, at, [], ""
        if data.startswith(_GZIP, at):
            records, end, bad = _member(data, at)
        else:
            try:
                record, end = parse_record(data, at)
                records = [record]
            except ValueError as e:
                bad = str(e)
        if end == at:  # nothing says where this ends: look for the next beginning
            marks = [m for m in (data.find(x, at + 1) for x in (_GZIP, b"WARC/1.", b"WARC/0.")) if m >= 0]
            at = min(marks, default=len(data))
            if gap is None:
                gap, why = start, bad
        else:
            if gap is not None:
                out.gaps.append((gap, start, why))
                gap = None
            if bad:
                out.gaps.append((start, end, bad))
            at = end
        out.records += [(start, r) for r in records]
        out.ends += [end] * len(records)
    if gap is not None:
        out.gaps.append((gap, len(data), why))
    return out


def page_uri(page_id: int | None) -> str:
    """A record id that carries the page_id."""
    low = struct.pack(">q", page_id or 0)
    kind = bytes([0 if page_id is None else 1])
    return f"<urn:uuid:{uuid.UUID(bytes=b'pageid!' + kind + low)}>"


def page_of(uri: str | None) -> int | None:
    """The page_id that ``page_uri`` put into a record id; null for any other id."""
    try:
        raw = uuid.UUID((uri or "").strip("<>").removeprefix("urn:uuid:")).bytes
    except ValueError:
        return None
    return struct.unpack(">q", raw[8:])[0] if raw[:7] == b"pageid!" and raw[7] else None


def classify(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """_page, _url, _html and _first, the response's page_id (null: itself).

    Equal payloads are known by SHA-1 and length.  Sums by digest come first, so
    that a large group of copies reaches the shuffle as a few rows.
    """
    page_id, url, html = columns(pages, "page_id", "url", "html")
    slim = pages.select(page_id.cast("long").alias("_page"), url.alias("_url"), F.coalesce(html, F.lit("")).alias("_html"))
    keyed = slim.withColumn("_key", F.when(F.octet_length("_html") >= least_bytes, F.concat_ws(":", F.sha1(F.col("_html").cast("binary")), F.octet_length("_html"))))
    groups = keyed.where("_key is not null").groupBy("_key").agg(F.max("_page").alias("_first"), F.count("*").alias("_copies")).where("_copies > 1")
    return lookup_skewed(keyed, materialize(groups, "payloads"), "_key", "_copies").drop("_key")


def write_archives(pages: DataFrame, archive_bytes: int = 16 << 20, level: int = 4, folder: str | None = None) -> DataFrame:
    """Write archives; return their manifest (path, records, bytes), materialised.

    Names are unique to each attempt of a task and the manifest is committed by
    Spark: archives of failed or repeated attempts are never read.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    make_folder(pages.sparkSession, folder)

    def pack(page, url, html, first) -> bytes:
        payload = html.encode()
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        revisit = first is not None and page != first
        headers = {
            "WARC-Type": "revisit" if revisit else "response",
            "WARC-Record-ID": page_uri(page),
            "WARC-Date": _DATE,
            "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"),
            "Content-Type": "application/http; msgtype=response",
            "WARC-Payload-Digest": _sha1(payload),
            "X-Payload-Length": str(len(payload)),
        }
        if revisit:
            headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": page_uri(first)}
        squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
        return squeeze.compress(record_bytes(headers, http if revisit else http + payload)) + squeeze.flush()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def close():
            path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
            put_file(path, b"".join(parts))
            return pa.RecordBatch.from_pydict({"path": [path], "records": [len(parts)], "bytes": [size]})

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                for row in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    parts.append(pack(*row))
                    size += len(parts[-1])
                    if size >= archive_bytes:
                        yield close()
                        parts, size = [], 0
        if parts:
            yield close()

    rows = classify(pages).select("_page", "_url", "_html", "_first")
    return materialize(rows.mapInArrow(write, "path string, records long, bytes long"), "archives")


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest (hex), record_type, refers_to, url, path, offset, html, record_id.

    Every valid response, revisit and resource record is a row, from whatever
    writer; other types hold no payload of a page.  html is null for a revisit,
    page_id and refers_to where the record ids are not those of ``page_uri``,
    payload_bytes where a revisit does not say it; payload_digest is that of the
    payload, or what a revisit says.  A record whose payload differs from its
    digest is quarantined with the gaps (see ``read_gaps``).
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = read_archive(get_file(path))
                for at in range(0, len(found.records), 500):
                    yield pa.RecordBatch.from_pylist([row for offset, r in found.records[at : at + 500] if (row := _row(path, offset, r))], _FOUND)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(min(n, 20_000)).mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, path string, offset long, html string, record_id string"
    )


_FOUND = pa.schema([
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("url", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("html", pa.string()), ("record_id", pa.string()),
])
#: Types of records that hold a payload of a page, or say that another one does.
_PAGES = frozenset({"response", "revisit", "resource"})


def payload_of(r: Record) -> bytes:
    """What the record is about: the body of an HTTP message, else the whole block."""
    http = r.headers.get("Content-Type", "").lower().startswith("application/http")
    return r.block.partition(b"\r\n\r\n")[2] if http else r.block


def payload_differs(r: Record) -> bool:
    """A revisit holds no payload to check."""
    return r.headers.get("WARC-Type") != "revisit" and digest_differs(r.headers.get("WARC-Payload-Digest"), payload_of(r))


def _said_hex(said: str | None) -> str | None:
    """A SHA-1 that a header says, in hexadecimal."""
    name, _, value = (said or "").partition(":")
    try:
        raw = bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())
    except ValueError:
        return None
    return raw.hex() if name.lower().replace("-", "") == "sha1" and len(raw) == 20 else None


def _row(path: str, offset: int, r: Record) -> dict | None:
    h = r.headers
    kind = h.get("WARC-Type")
    if kind not in _PAGES or payload_differs(r):
        return None
    row = {"page_id": page_of(h.get("WARC-Record-ID")), "record_type": kind, "refers_to": None, "url": h.get("WARC-Target-URI"), "path": path, "offset": offset, "record_id": h.get("WARC-Record-ID")}
    if kind == "revisit":
        size = h.get("X-Payload-Length", "")
        said = {"payload_bytes": int(size) if size.isascii() and size.isdigit() else None, "payload_digest": _said_hex(h.get("WARC-Payload-Digest"))}
        return row | said | {"refers_to": page_of(h.get("WARC-Refers-To")), "html": None}
    payload = payload_of(r)
    return row | {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "html": payload.decode("utf-8", "replace")}


def read_gaps(manifest: DataFrame) -> DataFrame:
    """The quarantine log: path, start, end and why of all bytes that gave no record."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = read_archive(get_file(path))
                bad = [(at, end, "payload digest differs") for (at, r), end in zip(found.records, found.ends, strict=True) if payload_differs(r)]
                rows = [{"path": path, "start": a, "end": b, "why": w} for a, b, w in found.gaps + bad]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("why", pa.string())]))

    return manifest.select("path").mapInArrow(read, "path string, start long, end long, why string")
