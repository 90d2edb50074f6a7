"""WARC derivatives: from each response a metadata record and a plain-text conversion record, linked to it.

Records are rows: warc_type, record_id, refers_to, target_uri, date, content_type, warc_headers (all header lines),
http_headers (the source's, of responses) and block (bytes). read() makes them from WARC files, from_pages() from a
table of pages, derive() adds derivatives and to_text() gives the records in file form for a text writer.

Digests are SHA-1 in base 32, as is usual in WARC files; ids are name-based, from type, refers-to and digest, so a
task that runs again gives the same records.

read() goes through a file record by record and decompresses no more than it needs for one. Payloads are decoded from
chunks, gzip and deflate before their text is taken; digests are of the payload as it was sent.

Defined results: null html is an empty payload, null urls an empty target; a payload that isn't valid in its charset is
decoded with replacement characters, and as UTF-8 where there is no such charset; damaged files give what records can
be told apart, and rows of the type ``skipped`` for the rest; repeated responses have equal derivatives; records of other types have none; an
empty table gives an empty table; extra columns are ignored (from_pages keeps the key).
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "key long, warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, payload_digest string, content_length long, warc_headers string, http_headers string, block binary"
TYPES = [pa.int64(), *[pa.string()] * 8, pa.int64(), pa.string(), pa.string(), pa.binary()]
NAMES = [x.split()[0] for x in RECORD.split(", ")]

HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.DOTALL | re.IGNORECASE)
BREAK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|tr|ul)\b[^>]*>", re.IGNORECASE)
TAG = re.compile(r"</?[A-Za-z][^>]*>|<![^>]*>")
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.DOTALL | re.IGNORECASE)
LINK = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
CHUNK = re.compile(rb"([0-9A-Fa-f]{1,8})[^\r\n]*\r\n")
#: Bytes that are decompressed at a time, and in which the headers of a record must end.
PIECE, LONGEST_HEADER = 1 << 20, 1 << 20
CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w-]+)", re.IGNORECASE)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(key: int | None, kind: str, refers_to: str | None, uri: str, date: str, content_type: str, block: bytes, payload: bytes, more: list[tuple[str, str]], http: str | None = None) -> tuple:
    own = digest(block)
    record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {refers_to or uri} {own}')}>"
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", uri)]
    lines += [("WARC-Refers-To", refers_to)] * bool(refers_to) + more
    lines += [("WARC-Block-Digest", own), ("WARC-Payload-Digest", digest(payload)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return (key, kind, record_id, refers_to, uri, date, content_type, own, digest(payload), len(block), "WARC/1.1\r\n" + "".join(f"{a}: {b}\r\n" for a, b in lines), http, block)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], NAMES)


def plain_text(page: str) -> str:
    """Visible lines: blocks on lines of their own, white space inside as one space, empty lines dropped."""
    text = TAG.sub("", BREAK.sub("\n", HIDDEN.sub(" ", page).replace("\n", " ")))
    return "\n".join(line for part in text.split("\n") if (line := " ".join(html.unescape(part).split())))


def from_pages(pages: DataFrame, date: str, key_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of pages that were fetched elsewhere; the HTTP header says what is known of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for key, url, page in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    payload = (page or "").encode()
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
                    rows.append(record(key, "response", None, re.sub(r"[\r\n]", " ", url or ""), date, "application/http; msgtype=response", http.encode() + payload, payload, [], http))
                yield batch_of(rows)

    chosen = pages.select(F.col(f"`{key_col}`").cast("long"), F.col(f"`{url_col}`").cast("string"), F.col(f"`{html_col}`").cast("string"))
    return chosen.mapInArrow(run, RECORD)


def derivatives(key: int | None, record_id: str, uri: str, date: str, http: str | None, block: bytes, headers: str | None) -> list[tuple]:
    """The metadata and the conversion record of one response."""
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found:
        head, payload = b"", block
    source = head.decode("latin-1")
    body = decoded_body(source, payload)
    charset = CHARSET.search(source) or CHARSET.search(body[:1024].decode("latin-1"))
    try:
        page = body.decode(charset[1] if charset else "utf-8", "replace")
    except (LookupError, ValueError):  # no such charset, or one that isn't for text
        page = body.decode("utf-8", "replace")
    title = TITLE.search(page)
    links = [next(filter(None, m.groups()), "") for m in LINK.finditer(page)]
    fields = [("source-record", record_id), ("source-payload-digest", digest(payload))]
    fields += [("source-warc-header", x) for x in (headers or "").split("\r\n")[1:] if x] + [("source-http-header", x) for x in source.split("\r\n") if x]
    fields += [("title", " ".join(html.unescape(m[1]).split())) for m in [title] if m] + [("outlink", " ".join(html.unescape(x).split())) for x in links]
    meta = "".join(f"{a}: {b}\r\n" for a, b in fields).encode()
    text = plain_text(page).encode()
    refers = [("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date)]
    return [
        record(key, "metadata", record_id, uri, date, "application/warc-fields", meta, meta, refers),
        record(key, "conversion", record_id, uri, date, "text/plain; charset=utf-8", text, text, [*refers, ("WARC-Source-Payload-Digest", digest(payload))], http or source or None),
    ]


def derive(records: DataFrame) -> DataFrame:
    """Two records for each response. One pass without shuffle; a row is one record, whatever its size."""
    wanted = ("key", "record_id", "target_uri", "date", "http_headers", "block", "warc_headers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True)
                yield batch_of([y for key, record_id, uri, date, http, block, headers in rows for y in derivatives(key, record_id or "", uri or "", date or "", http, block or b"", headers)])

    return records.where("warc_type = 'response'").select(*wanted).mapInArrow(run, RECORD)


def unchunked(body: bytes) -> bytes:
    """The data of a chunked body; what doesn't follow the format ends it, and a body that never does is left as it is."""
    out, at = [], 0
    while m := CHUNK.match(body, at):
        size = int(m[1], 16)
        out.append(body[m.end() : m.end() + size])
        at = m.end() + size
        at += 2 * (body[at : at + 2] == b"\r\n")
        if not size:
            break
    return b"".join(out) if out else body


def inflated(data: bytes, wbits: int) -> bytes:
    """As much as can be decompressed."""
    made, out = zlib.decompressobj(wbits), []
    try:
        for at in range(0, len(data), PIECE):
            out.append(made.decompress(data[at : at + PIECE]))
    except zlib.error:
        pass
    return b"".join(out)


def decoded_body(http: str, payload: bytes) -> bytes:
    """The payload without transfer and content encodings; one of an unknown or wrong encoding stays as it is."""
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(":") for x in http.split("\r\n")[1:])}
    if fields.get("transfer-encoding", "").endswith("chunked"):
        payload = unchunked(payload)
    for name in reversed([x.strip() for x in fields.get("content-encoding", "").split(",")]):
        if name in ("gzip", "x-gzip"):
            payload = inflated(payload, 31) or payload
        elif name == "deflate":
            payload = inflated(payload, 15) or inflated(payload, -15) or payload
    return payload


def file_pieces(data: bytes) -> Iterator[bytes]:
    """A file piece by piece; gzip members one after the other, and damaged ones up to where they fail."""
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), PIECE):
            yield data[at : at + PIECE]
        return
    at = 0
    while at >= 0:
        made, begin = zlib.decompressobj(31), at
        try:
            while not made.eof and at < len(data):
                piece = data[at : at + PIECE]
                yield made.decompress(piece)
                at += len(piece)
            at -= len(made.unused_data)
        except zlib.error:
            at = begin + 2
        at = data.find(b"\x1f\x8b\x08", at)


class Held:
    """Bytes of a file from a point on, of which as many are held as a record needs."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.data, self.ended = pieces, bytearray(), False

    def more(self) -> bool:
        piece = next(self.pieces, None)
        self.ended = piece is None
        self.data += piece or b""
        return not self.ended

    def has(self, size: int) -> bool:
        while len(self.data) < size and self.more():
            pass
        return len(self.data) >= size

    def find(self, what: bytes, start: int, most: int | None = None) -> int:
        """Where something begins from start on, and before most if that is given; -1 if nowhere."""
        while (at := self.data.find(what, start, most)) < 0:
            start = max(start, len(self.data) - len(what) + 1)
            if (most is not None and len(self.data) >= most) or not self.more():
                return self.data.find(what, start, most)
        return at


def records_in(data: bytes) -> Iterator[tuple]:
    """The records of a WARC file, gzipped or not.

    A record with a wrong or missing length ends where the next one begins; the last may be cut short. Bytes that belong
    to no record make one of the type ``skipped`` with their number as its length.
    """
    held = Held(file_pieces(data))
    while held.has(1):
        gap = 0
        while held.has(gap + 1) and held.data[gap] in b"\r\n":
            gap += 1
        del held.data[:gap]
        if not held.has(1):
            return
        end = held.find(b"\r\n\r\n", 0, LONGEST_HEADER) if held.has(5) and held.data[:5] == b"WARC/" else -1
        if end < 0:
            at = held.find(b"\nWARC/", 0)
            lost = at + 1 if at >= 0 else len(held.data)
            yield (None, "skipped", None, None, None, None, None, None, None, lost, None, None, b"")
            del held.data[:lost]
            continue
        lines = bytes(held.data[:end]).decode("utf-8", "replace").split("\r\n")
        h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        begin, stated = end + 4, h.get("content-length", "")
        stop = begin + int(stated) if re.fullmatch(r"[0-9]{1,15}", stated) else -1
        if stop < 0 or not held.has(stop) or (held.has(stop + 5) and not held.data[stop : stop + 5].startswith((b"\r\n\r\n", b"WARC/"))):
            at = held.find(b"\r\n\r\nWARC/", begin)
            stop = at if at >= 0 else stop if 0 <= stop <= len(held.data) else len(held.data)
        block = bytes(held.data[begin:stop])
        kind = h.get("warc-type")
        http = block.partition(b"\r\n\r\n")[0].decode("latin-1") + "\r\n\r\n" if kind == "response" else None
        yield (None, kind, h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), h.get("content-type"), h.get("warc-block-digest"), h.get("warc-payload-digest"), len(block), "\r\n".join(lines) + "\r\n", http, block)
        del held.data[:stop]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, one task a file; key is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for row in records_in(data.as_py()):
                    rows.append(row)
                    if len(rows) == 256:
                        yield batch_of(rows)
                        rows = []
                yield batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def to_text(records: DataFrame) -> DataFrame:
    """Records in file form for ``write.text``: its line end completes the two that end a record. UTF-8 blocks only."""
    return records.select(F.concat("warc_headers", F.lit("\r\n"), F.col("block").cast("string"), F.lit("\r\n\r")).alias("value"))
