"""WARC derivatives: response records become linked metadata and plain-text conversion records.

A response is one WARC/1.1 record (bytes). Both derivatives refer to it by its record id and keep its
target URI, date and digests; the conversion is the page's text, the metadata its source headers.
Record ids are name-based UUIDs, so a repeated task makes the same records again.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import ship

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space
DATE = "1970-01-01T00:00:00Z"
#: Bytes of records in a batch of load().
BATCH_BYTES = 8 << 20
# Elements whose content is not shown, and those that end a line.
_SILENT = {"script", "style", "noscript", "template"}
_BREAK = set("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 article section nav header footer title head body blockquote pre".split())
_TAG = re.compile(r"<(?:(/?)([A-Za-z][A-Za-z0-9]*)|!doctype)", re.I)
_CLOSERS = {name: re.compile(rf"</{name}\s*>", re.I) for name in _SILENT}
_BLANKS = re.compile(r"[ \t\r\f\v ]+")
_LINES = re.compile(r" ?\n[ \n]*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record. Line ends in header values become spaces."""
    lines = [f"{k}: {' '.join(v.split())}" for k, v in [("WARC-Type", kind), *headers, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(data: bytes):
    """(headers with lower-cased names, block) of each record; ValueError at what is none.
    A line that begins with white space continues the one before it."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        headers = {}
        for line in re.sub(rb"\r\n[ \t]+", b" ", data[at:end]).split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers[name.decode().strip().lower()] = value.decode("utf-8", "replace").strip()
        size = int(headers["content-length"])
        if end + 4 + size > len(data):
            raise ValueError(f"record at byte {at} is cut short")
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def response(url: str, page: bytes, date: str = DATE) -> bytes:
    """A response record of a page: HTTP header and body."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(page)).encode() + b"\r\n\r\n"
    return record("response", [("WARC-Record-ID", record_id("response", url, digest(page))), ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Payload-Digest", digest(page)), ("Content-Type", "application/http; msgtype=response")], http + page)


def plain_text(page: str) -> str:
    """What a page shows: no scripts, styles or comments; block elements end lines; references resolved.

    One pass over the page. An unclosed comment or script takes the rest; a tag without its end is text."""
    out, at, end = [], 0, -1
    while (tag := page.find("<", at)) >= 0:
        out.append(page[at:tag])
        if page.startswith("<!--", tag):
            close = page.find("-->", tag + 4)
            out.append(" ")
            at = len(page) if close < 0 else close + 3
            continue
        m = _TAG.match(page, tag)
        if end < tag and end != len(page):
            end = page.find(">", tag)
            end = len(page) if end < 0 else end
        if not m or end == len(page):
            out.append("<")
            at = tag + 1
            continue
        name, at = (m[2] or "").lower(), end + 1
        if name in _SILENT and not m[1]:
            close = _CLOSERS[name].search(page, at)
            at = close.end() if close else len(page)
            out.append(" ")
        else:
            out.append("\n" if name in _BREAK else "" if name else " ")
    out.append(page[at:])
    return _LINES.sub("\n", _BLANKS.sub(" ", html.unescape("".join(out)))).strip()


def derive(data: bytes):
    """(kind, digest of the source's payload, record) for each derivative of the response records in data.

    The source's HTTP header and digests are the metadata's fields. The conversion's own block has another
    digest, so the source's stands under a name of its own there."""
    for headers, block in records(data):
        if headers.get("warc-type") != "response":
            continue
        head, _, body = block.partition(b"\r\n\r\n")
        source, url, date = headers["warc-record-id"], headers.get("warc-target-uri", ""), headers.get("warc-date", DATE)
        payload = headers.get("warc-payload-digest", digest(body))
        linked = [("WARC-Refers-To", source), ("WARC-Target-URI", url), ("WARC-Date", date)]
        lines = head.decode("utf-8", "replace").split("\r\n")
        fields = [f"http-status: {lines[0]}", *(f"http-{x}" for x in lines[1:] if x), f"source-block-digest: {headers.get('warc-block-digest', '')}", f"source-payload-digest: {payload}"]
        yield "metadata", payload, record("metadata", [("WARC-Record-ID", record_id("metadata", source)), *linked, ("Content-Type", "application/warc-fields")], "\r\n".join(fields).encode())
        text = plain_text(body.decode("utf-8", "replace")).encode()
        yield "conversion", payload, record("conversion", [("WARC-Record-ID", record_id("conversion", source)), *linked, ("X-Source-Payload-Digest", payload), ("Content-Type", "text/plain")], text)


_FIELDS = [(n, pa.int64() if n == "content_length" else pa.binary() if n == "record" else pa.string()) for n in ("record_type", "record_id", "refers_to", "target_uri", "content_type", "content_length", "block_digest", "source_payload_digest", "record")]


def _rows(data: bytes):
    for kind, payload, made in derive(data):
        headers, block = next(records(made))
        yield {"record_type": kind, "record_id": headers["warc-record-id"], "refers_to": headers["warc-refers-to"], "target_uri": headers.get("warc-target-uri", ""), "content_type": headers["content-type"], "content_length": len(block), "block_digest": headers["warc-block-digest"], "source_payload_digest": payload, "record": made}


class _Derive:
    """mapInArrow function: the derivatives of each row's response, which `made` gives from its columns."""

    def __init__(self, key: str, columns: list[str], made):
        self.key, self.columns, self.made = key, columns, made

    def __call__(self, batches):
        for batch in batches:
            columns = [batch.column(c).cast(pa.binary()).to_pylist() for c in self.columns]
            for lo in range(0, batch.num_rows, 256):  # records are held for few pages at a time
                at, rows = [], []
                for k in range(lo, min(lo + 256, batch.num_rows)):
                    for row in _rows(self.made(*(c[k] or b"" for c in columns))):
                        at.append(k)
                        rows.append(row)
                yield pa.RecordBatch.from_arrays([batch.column(self.key).take(pa.array(at, pa.int32())), *(pa.array([r[n] for r in rows], t) for n, t in _FIELDS)], [self.key, *(n for n, _ in _FIELDS)])


def _derived(rows: DataFrame, key: str, columns: list[str], made) -> DataFrame:
    ship(rows.sparkSession)
    kind = rows.select(key).schema[0].dataType.simpleString()
    return rows.select(key, *columns).mapInArrow(_Derive(key, columns, made), f"`{key}` {kind}, " + ", ".join(f"{n} {'long' if t == pa.int64() else t}" for n, t in _FIELDS))


def _response_of(url: bytes, page: bytes) -> bytes:
    return response(url.decode("utf-8", "replace"), page)


def _same(data: bytes) -> bytes:
    return data


def derivatives(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Two rows per row of pages (metadata and conversion) with their WARC headers and whole records. A
    table of pages has no HTTP headers or dates: its responses are made with the plainest ones, dated DATE.

    Null urls and pages count as empty: the records stand, with an empty URI or text. Repeated rows give
    equal records, null keys are kept, an empty table gives no rows; other columns are not read."""
    return _derived(pages, key, [url, page], _response_of)


def derivatives_of_records(archived: DataFrame, key: str = "record_id") -> DataFrame:
    """Two rows per response of load(): metadata with that response's own HTTP header, date and digests, and
    conversion. Records of other types and damaged ones (no record) give none."""
    rows = archived.where("record is not null and record_type = 'response'").select(F.col(key).alias("source_id"), "record")
    return _derived(rows, "source_id", ["record"], _same)


_ARCHIVED = [("archive", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("record", pa.binary()), ("error", pa.string())]


class _Read:
    """mapInArrow function over (path): a row for each record of an archive, read as a stream. What is
    damaged ends its archive with a row that says where; other archives are not touched by it."""

    def __call__(self, batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                for row in self._archive(path):
                    rows.append(row)
                    held += len(row[7] or b"")
                    if held >= BATCH_BYTES:
                        yield self._batch(rows)
                        rows, held = [], 0
                if rows:
                    yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_ARCHIVED)], [n for n, _ in _ARCHIVED])

    @staticmethod
    def _archive(path: str):
        from pyarrow import fs

        filesystem, name = fs.FileSystem.from_uri(path)
        at = 0
        try:
            with filesystem.open_input_file(name) as f:
                stream = gzip.GzipFile(fileobj=f) if path.endswith(".gz") else io.BufferedReader(f)
                while first := stream.readline():
                    if not first.strip():  # the blank lines behind a record
                        at += len(first)
                        continue
                    lines = [first]
                    while lines[-1] not in (b"\r\n", b"\n", b""):
                        lines.append(stream.readline())
                    head = b"".join(lines)
                    size = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
                    if not first.startswith(b"WARC/") or not size:
                        raise ValueError("no WARC record")
                    block = stream.read(int(size[1]))
                    if len(block) < int(size[1]):
                        raise ValueError("record is cut short")
                    data = head + block + b"\r\n\r\n"
                    headers, _ = next(records(data))
                    yield (path, at, *(headers.get(h) for h in ("warc-type", "warc-record-id", "warc-target-uri", "warc-date", "warc-payload-digest")), data, None)
                    at += len(head) + len(block)
        except (OSError, EOFError, ValueError, KeyError, zlib.error) as e:
            yield (path, at, None, None, None, None, None, None, f"{type(e).__name__}: {e}")


def load(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the .warc and .warc.gz archives in a folder: archive, offset (in the unpacked
    bytes), record_type, record_id, target_uri, date, payload_digest, record, error. An archive is read
    by one task, in batches of bounded size; archives are dealt out one by one. A damaged archive gives its
    records up to the damage and a row with the error."""
    ship(spark)
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").load(folder).select("path")
    dealt = paths.repartition(max(1, min(4096, paths.count())), "path")
    return dealt.mapInArrow(_Read(), ", ".join(f"{n} {'long' if t == pa.int64() else t}" for n, t in _ARCHIVED))
