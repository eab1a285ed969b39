"""Shared folder, written intermediate tables and byte-level text scanning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from scanlattice.functions.shipping import ship as ship
from scanlattice.functions.tables import clear as clear, shared_dir as shared_dir, work_path as work_path, written as written

#: Bytes of text that one vectorised block holds; bounds a worker's memory, not what is read.
BLOCK_BYTES = 1 << 18
#: Rows of a batch that an operator takes at a time, whatever the session's batch size.
SLICE_ROWS = 2000


def sliced(batches) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most SLICE_ROWS rows: bounds what a worker holds beside the batch itself."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def fresh(name: str, columns: list[str]) -> str:
    """A column name that none of columns has: longer than all of them."""
    return name + "_" * max((len(c) for c in columns), default=0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_values(column: pa.Array) -> list[bytes | None]:
    """The bytes of a string column without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def byte_table(separators: bytes) -> bytes:
    """A translation for bytes.translate: A-Z lower-cased, the separators as spaces, the rest unchanged."""
    out = bytearray(range(256))
    for b in range(0x41, 0x5B):
        out[b] = b + 32
    for b in separators:
        out[b] = 0x20
    return bytes(out)


#: Words of a-z, 0-9 and non-ASCII characters; words between ASCII white space.
ALNUM_WORDS = byte_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
SPACED_WORDS = byte_table(bytes([0x20, *range(0x09, 0x0E)]))

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power_arrays(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            powers = np.full(size, base, np.uint64)
            powers[0] = 1
            _powers[key] = np.cumprod(powers, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class WordBlock:
    """Words of documents lo..hi-1 of a list, as arrays.

    hashes: a 64-bit hash per word; ptr: hi-lo+1 offsets into it; starts, ends: byte offsets in the
    block's buffer; base: the byte offset at which each document begins there; prefixes: for each asked
    length a hash of each word's first bytes."""

    __slots__ = ("lo", "hi", "hashes", "ptr", "starts", "ends", "base", "prefixes")

    def __init__(self, lo, hi, hashes, ptr, starts, ends, base, prefixes):
        self.lo, self.hi, self.hashes, self.ptr = lo, hi, hashes, ptr
        self.starts, self.ends, self.base, self.prefixes = starts, ends, base, prefixes


def _scan(buffer: bytes, heads: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    a = np.frombuffer(buffer, np.uint8)
    gap = np.empty(len(a) + 2, bool)
    gap[0] = gap[-1] = True
    np.equal(a, 32, out=gap[1:-1])
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[0::2], edges[1::2]
    up, down = _power_arrays(len(a) + 1)
    prefix = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=prefix[1:])
    hashes = mix64((prefix[ends] - prefix[starts]) * down[starts])
    prefixes = []
    for k in heads:
        stop = np.minimum(starts + k, ends)
        prefixes.append(mix64((prefix[stop] - prefix[starts]) * down[starts] + np.uint64(k)))
    return hashes, starts, ends, prefixes


def word_blocks(texts: list[bytes | None], words: bytes, heads: tuple[int, ...] = (), limit: int = BLOCK_BYTES) -> Iterator[WordBlock]:
    """Splits documents into words, block by block. Null counts as empty. A document longer than a
    block is scanned in pieces cut between words, and comes alone in a block."""
    lo = 0
    while lo < len(texts):
        hi, size, parts = lo, 0, []
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or b"") < limit):
            parts.append((texts[hi] or b"").translate(words))
            size += len(parts[-1]) + 1
            hi += 1
        base = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
        if size <= 2 * limit:
            hashes, starts, ends, prefixes = _scan(b" ".join(parts), heads)
            ptr = np.append(np.searchsorted(starts, base), len(starts))
        else:
            text, at, pieces = parts[0], 0, []
            while at < len(text):
                stop = len(text) if at + limit >= len(text) else text.rfind(b" ", at, at + limit)
                if stop <= at:
                    stop = text.find(b" ", at + limit)
                    stop = len(text) if stop < 0 else stop
                h, s, e, p = _scan(text[at:stop], heads)
                pieces.append((h, s + at, e + at, *p))
                at = stop + 1
            hashes, starts, ends, *prefixes = (np.concatenate(x) for x in zip(*pieces))
            ptr = np.array([0, len(hashes)])
        yield WordBlock(lo, hi, hashes, ptr, starts, ends, base, prefixes)
        lo = hi
