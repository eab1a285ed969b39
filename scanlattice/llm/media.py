"""Media columns: PNG members in ZIP archives, read by a data source of byte-range partitions.

The writer's tasks put members into archives of bounded size in the shared folder. The source lists
the archives, cuts each into byte ranges and gives a range the members whose local header starts in
it (by the archive's central directory). Payload batches go to Spark as Arrow; a member that fails is
read again from its own offset, without disturbing the others.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import ship, sliced, utf8_values, work_path

UNIT = 64
ARCHIVE_BYTES = 24 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 8 << 20
TRIES = 3
MANIFEST = "manifest"
_PNG = b"\x89PNG\r\n\x1a\n"  # fixed value: the format's signature


def payload_of(text: bytes) -> bytes:
    """The text and zero bytes up to a positive multiple of UNIT."""
    return text + bytes(-len(text) % UNIT if text else UNIT)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """An 8-bit greyscale PNG, UNIT samples wide, without filters: one sample per byte."""
    rows = np.zeros((len(payload) // UNIT, UNIT + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> bytes:
    """The samples of such a PNG; ValueError for damage or other kinds."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, data, shape = 8, [], None
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    if shape is None or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit greyscale PNG")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, deviation and entropy of the samples and the share of zero ones."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    n, values = counts.sum(), np.arange(256)
    mean = (counts * values).sum() / n
    share = counts[counts > 0] / n
    return f"mean={mean:.4f};std={np.sqrt((counts * (values - mean) ** 2).sum() / n):.4f};entropy={-(share * np.log2(share)).sum():.4f};zero={counts[0] / n:.4f}"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class _Write:
    """mapInArrow function: members into archives; a row for each archive that is whole.

    Names are new in each attempt, so what a lost attempt left behind is in no returned row."""

    def __init__(self, folder: str, doc_id: str, text: str):
        self.folder, self.doc_id, self.text = folder, doc_id, text

    def __call__(self, batches):
        self.buffer, self.many, self.seen = io.BytesIO(), 0, 0
        self.archive = zipfile.ZipFile(self.buffer, "w", zipfile.ZIP_STORED)
        done = []
        for batch in sliced(batches):
            for doc, text in zip(batch.column(self.doc_id).to_pylist(), utf8_values(batch.column(self.text))):
                text = text or b""
                # The row number keeps members of repeated ids apart; the length is what padding hides.
                name = f"{self.seen}_{len(text)}_{'' if doc is None else 'i' + doc.encode().hex()}.png"
                self.archive.writestr(zipfile.ZipInfo(name), encode(payload_of(text)))
                self.many, self.seen = self.many + 1, self.seen + 1
                if self.buffer.tell() >= ARCHIVE_BYTES:
                    done.append(self._close())
        if self.many:
            done.append(self._close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done]), pa.array([b for _, b in done], pa.int64())], ["name", "bytes"])

    def _close(self):
        self.archive.close()
        data, name = self.buffer.getvalue(), f"{uuid.uuid4().hex}.zip"
        filesystem, path = _filesystem(self.folder)
        filesystem.create_dir(path, recursive=True)
        with filesystem.open_output_stream(f"{path}/{name}") as f:
            f.write(data)
        self.buffer, self.many = io.BytesIO(), 0
        self.archive = zipfile.ZipFile(self.buffer, "w", zipfile.ZIP_STORED)
        return name, len(data)


class Range(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


SCHEMA = "member string, archive string, offset long, media binary, error string"


class MediaArchive(DataSource):
    """spark.read.format("media_archive").load(folder): a row for each member of the ZIP archives there.

    A folder that store() made has a manifest (names and sizes, Parquet); then only those archives are
    read. Options: range_bytes, tries."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.step = int(options.get("range_bytes", RANGE_BYTES))
        self.tries = int(options.get("tries", TRIES))

    def partitions(self):
        import pyarrow.parquet as pq
        from pyarrow import fs

        filesystem, path = _filesystem(self.folder)
        found = filesystem.get_file_info(fs.FileSelector(f"{path}/{MANIFEST}", allow_not_found=True))
        if found:  # no listing: what an attempt that did not count leaves behind is never planned
            tables = [pq.read_table(x.path, filesystem=filesystem) for x in found if x.base_name.endswith(".parquet")]
            files = sorted((n, b) for t in tables for n, b in zip(*(t.column(c).to_pylist() for c in ("name", "bytes"))))
        else:
            found = filesystem.get_file_info(fs.FileSelector(path, allow_not_found=True))
            files = sorted((x.base_name, x.size) for x in found if x.base_name.endswith(".zip"))
        return [Range(n, low, min(low + self.step, size)) for n, size in files for low in range(0, size, self.step)] or [Range("", 0, 0)]

    def read(self, partition: Range):
        if not partition.path:
            return
        filesystem, path = _filesystem(self.folder)
        out, held = ([], [], [], [], []), 0
        try:
            with filesystem.open_input_file(f"{path}/{partition.path}") as f:
                members = zipfile.ZipFile(f).infolist()
        except (zipfile.BadZipFile, struct.error, ValueError) as e:  # a damaged archive is one row, of its first range
            if partition.low == 0:
                yield _batch(([None], [partition.path], [0], [None], [f"{type(e).__name__}: {e}"]))
            return
        for m in members:
            if not partition.low <= m.header_offset < partition.high:
                continue
            media, error = self._member(filesystem, f"{path}/{partition.path}", m)
            for column, x in zip(out, (m.filename, partition.path, m.header_offset, media, error)):
                column.append(x)
            held += len(media or b"")
            if held >= BATCH_BYTES:
                yield _batch(out)
                out, held = ([], [], [], [], []), 0
        if out[0]:
            yield _batch(out)

    def _member(self, filesystem, path: str, m) -> tuple[bytes | None, str | None]:
        """The bytes of one member, whose checksum is confirmed; a failure is its own, after all tries."""
        for left in range(self.tries - 1, -1, -1):
            try:
                with filesystem.open_input_file(path) as f:
                    f.seek(m.header_offset)
                    head = f.read(30)
                    if head[:4] != b"PK\x03\x04":
                        raise OSError("no local header")
                    name, extra = struct.unpack_from("<HH", head, 26)
                    f.seek(m.header_offset + 30 + name + extra)
                    data = f.read(m.compress_size)
                if m.flag_bits & 1 or m.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                    return None, "encrypted, or packed by an unknown method"
                if m.compress_type == zipfile.ZIP_DEFLATED:
                    data = zlib.decompressobj(-15).decompress(data, m.file_size + 1)
                if len(data) != m.file_size or zlib.crc32(data) != m.CRC:
                    raise OSError("checksum differs")
                return data, None
            except (OSError, zlib.error, struct.error) as e:
                if not left:
                    return None, str(e)
                time.sleep(0.05)


def _batch(columns) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["member", "archive", "offset", "media", "error"])


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> str:
    """Writes every text of docs as a PNG member; returns the folder, whose manifest names the archives of
    the attempts that counted."""
    spark = docs.sparkSession
    ship(spark)
    folder = work_path(spark, "media")
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    rows.mapInArrow(_Write(folder, "doc_id", "text"), "name string, bytes long").write.parquet(f"{folder}/{MANIFEST}")
    return folder


def load(spark: SparkSession, folder: str, **options) -> DataFrame:
    ship(spark)
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(folder)


class _Features:
    """mapInArrow function over (member, media, error): what is computed from stored bytes."""

    def __call__(self, batches):
        for batch in batches:
            out = ([], [], [], [], [], [], [], [])
            for member, media, error in zip(*(batch.column(n).to_pylist() for n in ("member", "media", "error"))):
                if error is not None:
                    raise OSError(f"{member}: {error}")  # the task is tried again; nothing is left out
                _, size, doc = member.removesuffix(".png").split("_", 2)
                samples = decode(media)
                row = (bytes.fromhex(doc[1:]).decode() if doc else None, int(size), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples))
                for column, x in zip(out, row):
                    column.append(x)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores every text, reads it back through the data source and describes it: one row per row of docs.

    Null and empty texts are UNIT zero bytes; repeated rows, null ids and ids of any type that goes to text
    and back are kept; an empty table gives no rows; other columns are not read. A member that stays
    unreadable fails the job instead of going missing."""
    kind = docs.select(doc_id).schema[0].dataType
    members = load(docs.sparkSession, store(docs, doc_id, text))
    rows = members.select("member", "media", "error").mapInArrow(_Features(), "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return rows.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumnRenamed("doc_id", doc_id)
