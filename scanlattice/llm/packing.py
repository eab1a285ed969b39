"""Packing by minimum bin slack.

Documents are tokenised and cut at the window size; only the remainders need packing. The plan is
made from the histogram of remaining lengths, which has at most one row per length whatever the
input: a bitset subset-sum program finds the multiset that fills a window closest to capacity,
backtracking yields its counts, and the pattern is repeated as often as the histogram allows. Pieces
then find their place by their rank among pieces of equal length, which is summed up from per-task
counts, so no group of equal lengths meets in one task.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from codecs import charmap_decode

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import BLOCK_BYTES, fresh, ship, sliced, utf8_values, written

CAPACITY = 2048
CLOSING_ID = 1


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, int]:
    """The public byte-to-letter table of byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others for the letters from U+0100 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 0x100 + n for n, b in enumerate(b for b in range(256) if b not in own)}


#: A stop between a letter up to U+017F (that is no U+0130) and white space: a piece of text of its own, so
#: words are kept without it.
_STOPS = re.compile(rb"[.,](?:(?<=[A-Za-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].)|(?<=\xc4[\x80-\xaf\xb1-\xbf].)|(?<=\xc5[\x80-\xbf].))(?=\s|\Z)")
#: Words of small letters of Latin-1, as UTF-8.
_SMALL = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


class WordIds(dict):
    """Token ids (little-endian unsigned 32-bit) of white-space-separated words, kept for two
    generations of at most `keep` words. The tokenizer drops white space and no token spans it, so a
    text's ids are its words' ids one after another."""

    def __init__(self, path: str, keep: int = 120_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.model, self.keep, self.old = tokenizer.encode, tokenizer.model.tokenize, keep, {}
        letters = _byte_letters()
        self.letters = "".join(chr(letters.get(b, b)) for b in range(256))

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self._ids(word)
        if len(word) <= 64:
            self[word] = ids
        return ids

    def _ids(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters: one piece of text, composed, lower-cased one by one
            low = word.lower()
            if low != word:
                return self[low]
            ids = [t.id for t in self.model(word.decode())]
            return struct.pack(f"<{len(ids)}I", *ids)
        if _SMALL.fullmatch(word):  # composed and small already
            ids = [t.id for t in self.model(charmap_decode(word, "strict", self.letters)[0])]
            return struct.pack(f"<{len(ids)}I", *ids)
        plain = word.decode("utf-8", "replace")
        if len(plain) > 1 and plain[-1] in ".,":
            last = plain[-2]
            # A Latin letter and a stop are never in one token. Others may decompose into a letter and a mark.
            if last < "\u0250" and last != "\u0130" and last.isalpha():
                return self[word[:-1]] + self[word[-1:]]
        if plain.isalpha() and max(plain) < "\u0250" and "\u0130" not in plain:
            # The same for Latin letters: what normalising and splitting leave is the word itself, so the
            # model can be asked at once.
            low = plain.lower()
            if len(low) != len(plain) or low != plain:
                return self[low.encode()]
            ids = [t.id for t in self.model(charmap_decode(word, "strict", self.letters)[0])]
        else:
            ids = self.encode(plain, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def text(self, value: bytes | None) -> bytes:
        """The ids of a text, block by block: a very long one is never a list of all its words at once."""
        value, at, parts = value or b"", 0, []
        while at < len(value):
            stop = at + BLOCK_BYTES
            if stop < len(value):
                cut = max(value.rfind(b" ", at, stop), value.rfind(b"\n", at, stop))
                if cut <= at:
                    cut = min((x for x in (value.find(b" ", stop), value.find(b"\n", stop)) if x >= 0), default=len(value))
                stop = cut
            if len(self) > self.keep:
                self.old = dict(self)
                self.clear()
            parts.append(b"".join(map(self.__getitem__, _STOPS.sub(rb" \g<0>", value[at:stop]).split())))
            at = stop
        return b"".join(parts)


_word_ids: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The one of this process: a worker's later tasks find the words of earlier ones."""
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path]


class _Pieces:
    """mapInArrow function: a row for each piece of each document."""

    def __init__(self, path: str | None, doc_id: str, text: str, capacity: int):
        self.path, self.doc_id, self.text, self.capacity = path, doc_id, text, capacity

    def __call__(self, batches):
        tokenizer, closing, cap = word_ids(self.path or vocabulary_path()), struct.pack("<I", CLOSING_ID), self.capacity
        for batch in sliced(batches):
            texts = utf8_values(batch.column(self.text))
            row, start, length, crc, total = [], [], [], [], []
            for k, value in enumerate(texts):
                ids = memoryview(tokenizer.text(value) + closing)
                n = len(ids) // 4
                for at in range(0, n, cap):
                    piece = min(cap, n - at)
                    row.append(k)
                    start.append(at)
                    length.append(piece)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + piece)]))
                    total.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(self.doc_id).take(pa.array(row, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], [self.doc_id, "start", "length", "ids_crc32", "doc_tokens"])


def fill(room: int, counts: dict[int, int]) -> dict[int, int]:
    """The multiset of lengths from counts whose sum is the largest that is at most room.

    Bit k of `reach` says that some multiset sums to k; multiplicities are split into powers of two."""
    reach, mask, taken = 1, (1 << (room + 1)) - 1, []
    for length in sorted((n for n, c in counts.items() if c > 0 and n <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:
            part_now = min(part, left)
            grown = (reach | (reach << (length * part_now))) & mask
            if grown != reach:
                taken.append((reach, length, part_now))
                reach = grown
            left -= part_now
            part *= 2
        if reach >> room:
            break
    at, out = reach.bit_length() - 1, {}
    for before, length, part in reversed(taken):
        if not (before >> at) & 1:
            at -= length * part
            out[length] = out.get(length, 0) + part
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(multiset of lengths, repetitions) until every piece is placed; the longest piece left is always in."""
    counts, out = {n: c for n, c in histogram.items() if c > 0}, []
    while counts:
        top = max(counts)
        rest = dict(counts)
        rest[top] -= 1
        pattern = fill(capacity - top, rest)
        pattern[top] = pattern.get(top, 0) + 1
        times = min(counts[n] // c for n, c in pattern.items())
        out.append((pattern, times))
        for n, c in pattern.items():
            counts[n] -= c * times
            if not counts[n]:
                del counts[n]
    return out


class _Places:
    """mapInArrow function: rank among equal lengths -> sequence and offset."""

    def __init__(self, patterns, names: list[str]):
        self.patterns, self.names = patterns, names

    def __call__(self, batches):
        by_length: dict[int, list[tuple]] = {}
        base = 0
        for pattern, times in self.patterns.value:
            offset, used = 0, sum(n * c for n, c in pattern.items())
            for n in sorted(pattern, reverse=True):
                by_length.setdefault(n, []).append((pattern[n] * times, pattern[n], base, offset, used))
                offset += n * pattern[n]
            base += times
        tables = {}
        for n, rows in by_length.items():
            t = np.array(rows, np.int64).T
            tables[n] = (np.concatenate(([0], np.cumsum(t[0])[:-1])), *t[1:])
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            sequence, offset, used = (np.zeros(len(length), np.int64) for _ in range(3))
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                first, many, base_of, off, use = tables[int(n)]
                k = np.searchsorted(first, rank[own], side="right") - 1
                inside = rank[own] - first[k]
                sequence[own] = base_of[k] + inside // many[k]
                offset[own] = off[k] + inside % many[k] * n
                used[own] = use[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in self.names), pa.array(sequence), pa.array(offset), pa.array(used)], [*self.names, "sequence_id", "offset", "sequence_tokens"])


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens.

    Null or empty text: only the closing id. A document of more than `capacity` ids is cut into
    windows; repeated rows are each packed; an empty table gives no rows. Other columns are not read."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    names = [doc_id, "start", "length", "ids_crc32", "doc_tokens"]
    cut = docs.select(doc_id, text).mapInArrow(_Pieces(tokenizer, doc_id, text, capacity), schema)
    n, part, many, prior = (fresh(x, names) for x in ("n", "part", "many", "prior"))
    pieces = written(cut.withColumn(n, F.monotonically_increasing_id()), "pieces")
    pieces = pieces.withColumn(part, F.shiftright(n, 33))
    per_task = pieces.groupBy("length", part).agg(F.count("*").alias(many))
    histogram = dict(map(tuple, per_task.groupBy("length").agg(F.sum(many)).collect()))  # at most `capacity` rows
    patterns = spark.sparkContext.broadcast(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("length", part, F.coalesce(F.sum(many).over(before), F.lit(0)).alias(prior))
    inside = Window.partitionBy("length", part).orderBy(n)
    ranked = pieces.join(offsets, ["length", part]).withColumn("rank", F.col(prior) + F.row_number().over(inside) - 1)
    return ranked.select(*names, "rank").mapInArrow(_Places(patterns, names), schema + ", sequence_id long, offset long, sequence_tokens long")
