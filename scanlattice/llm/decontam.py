"""Benchmark decontamination with an FM-index for each training shard.

Test phrases (windows of consecutive words) are found by backward search through wavelet-matrix
ranks; occurrences are located by sampled suffix positions and merged into removal spans. Before a
shard is indexed, words that no benchmark item has are cut out together with runs that are too short
for any window: no occurrence can contain them, so the index stays whole for the question asked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import ALNUM_WORDS, fresh, ship, sliced, utf8_values, word_blocks, written

WINDOW = 10
SHARD_BYTES = 1 << 20
SAMPLE = 8
#: Benchmark words sent to the executors at once; a larger benchmark is taken in several such blocks.
BLOCK_WORDS = 2_000_000


class WaveletMatrix:
    """Ranks over integers below 2**levels; all queries take arrays."""

    def __init__(self, values: np.ndarray, levels: int):
        self.counts, self.zeros, self.levels = [], [], levels
        v = values
        for level in range(levels - 1, -1, -1):
            bits = (v >> level) & 1
            self.counts.append(np.concatenate(([0], np.cumsum(bits, dtype=np.int32))).astype(np.int32))
            self.zeros.append(len(v) - int(self.counts[-1][-1]))
            v = np.concatenate((v[bits == 0], v[bits == 1]))

    def rank(self, symbols: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the position beside it."""
        begin, end = np.zeros_like(upto), upto.copy()
        for at, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((symbols >> level) & 1).astype(bool)
            ones_b, ones_e = self.counts[at][begin], self.counts[at][end]
            begin = np.where(one, self.zeros[at] + ones_b, begin - ones_b)
            end = np.where(one, self.zeros[at] + ones_e, end - ones_e)
        return end - begin


class FMIndex:
    """Index of runs of symbols 1..sigma, each run closed by a 0."""

    def __init__(self, text: np.ndarray, sigma: int):
        n = len(text)
        ends = text == 0
        # Terminators are told apart by position, so equal runs need no comparison beyond their ends.
        rank = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + int(ends.sum()))
        suffixes = np.argsort(rank, kind="stable")
        step = 1
        while True:
            second = np.zeros(n, np.int64)
            second[: n - step] = rank[step:] + 1
            key = rank * np.int64(n + sigma + 2) + second
            suffixes = np.argsort(key, kind="stable")
            ordered = key[suffixes]
            fresh = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
            rank = np.empty(n, np.int64)
            rank[suffixes] = fresh
            if fresh[-1] == n - 1 or step >= n:
                break
            step *= 2
        before = np.concatenate(([0], text[:-1]))
        self.bwt = before[suffixes].astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma + 1)))).astype(np.int64)
        self.tree = WaveletMatrix(self.bwt, max(1, int(sigma).bit_length()))
        self.n = n
        kept = (suffixes % SAMPLE == 0) | (self.bwt == 0)  # run starts too: no step leads past them
        self.kept_rank = np.concatenate(([0], np.cumsum(kept))).astype(np.int64)
        self.kept = kept
        self.samples = suffixes[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [from, to) of equally long phrases, one in each row of the array."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for at in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, at]
            a = self.first[c] + self.tree.rank(c, low[alive])
            b = self.first[c] + self.tree.rank(c, high[alive])
            low[alive], high[alive] = a, b
            alive = alive[b > a]
            if not len(alive):
                break
        found = np.zeros(len(phrases), bool)
        found[alive] = True
        return np.where(found, low, 0), np.where(found, high, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back through the text to a sampled suffix."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.kept[rows])
        while len(open_):
            at = rows[open_]
            c = self.bwt[at]
            rows[open_] = self.first[c] + self.tree.rank(c, at)
            steps[open_] += 1
            open_ = open_[~self.kept[rows[open_]]]
        return self.samples[self.kept_rank[rows]] + steps


class Phrases:
    """Windows of benchmark items over the items' own vocabulary. Items without words or id have none."""

    def __init__(self, items: list[tuple[object, bytes | None]], window: int = WINDOW):
        items = [(i, t) for i, t in items if i is not None]
        self.ids = [i for i, _ in items]
        rows = []
        for block in word_blocks([t for _, t in items], ALNUM_WORDS):
            rows += [block.hashes[a:b] for a, b in zip(block.ptr[:-1], block.ptr[1:])]
        self.vocabulary = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.uint64)
        seen: dict[int, dict[bytes, set[int]]] = {}
        for k, hashes in enumerate(rows):
            words = np.searchsorted(self.vocabulary, hashes).astype(np.int64) + 1
            size = min(window, len(words))
            for at in range(len(words) - size + 1 if size else 0):
                seen.setdefault(size, {}).setdefault(words[at : at + size].tobytes(), set()).add(k)
        self.by_size = {n: (np.frombuffer(b"".join(w), np.int64).reshape(-1, n), [sorted(x) for x in w.values()]) for n, w in seen.items()}
        self.least = min(self.by_size, default=0)
        bits = np.zeros(1 << 20, bool)
        bits[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.bits = bits

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers from 1, 0 for other words."""
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.bits[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(maybe) and len(self.vocabulary):
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[at] == hashes[maybe], at + 1, 0)
        return out


def _occurrences(phrases: Phrases, hashes: np.ndarray, ptr: np.ndarray) -> Iterator[tuple[np.ndarray, int, list[list[int]], np.ndarray]]:
    """(first words, length, items of each phrase, phrase of each occurrence) for each window length."""
    if not phrases.least:
        return
    symbols = phrases.symbols(hashes)
    known = np.zeros(len(symbols) + 2, bool)
    known[1:-1] = symbols > 0
    cut = known[1:] != known[:-1]
    cut[ptr] |= known[ptr] & known[np.minimum(ptr + 1, len(known) - 1)]  # a run ends with its document
    # Run starts are known words after a cut; run ends are the places after which a cut stands.
    inside = known[1:-1]
    starts = np.flatnonzero(inside & cut[:-1])
    ends = np.flatnonzero(inside & cut[1:]) + 1
    long_enough = ends - starts >= phrases.least
    starts, ends = starts[long_enough], ends[long_enough]
    if not len(starts):
        return
    sizes = ends - starts + 1
    first = np.cumsum(sizes) - sizes
    place = np.repeat(starts - first, sizes) + np.arange(int(sizes.sum()))
    text = symbols[np.minimum(place, len(symbols) - 1)]
    text[first + sizes - 1] = 0
    index = FMIndex(text, len(phrases.vocabulary))
    for size, (rows, items) in phrases.by_size.items():
        low, high = index.search(rows)
        many = high - low
        if many.sum():
            which = np.repeat(np.arange(len(rows)), many)
            at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            yield place[index.locate(at)], size, items, which


class _Scanner:
    """mapInArrow function: adds the overlap columns, or cuts the overlaps out of the text."""

    def __init__(self, phrases, names: list[str], text: str, cut: str | None):
        self.phrases, self.names, self.text, self.cut = phrases, names, text, cut

    def __call__(self, batches):
        phrases = self.phrases.value
        for batch in sliced(batches):
            at = batch.schema.get_field_index(self.text)
            texts = utf8_values(batch.column(at))
            n_words, n_hit, found, spans = (np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [[] for _ in texts], [[] for _ in texts])
            for block in word_blocks(texts, ALNUM_WORDS, limit=SHARD_BYTES):
                self._block(phrases, block, n_words, n_hit, found, spans)
            if self.cut:
                kept = [t if t is None or not s else _without(t, s) for t, s in zip(texts, spans)]
                columns = batch.columns
                columns[at] = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_hit)], [*batch.schema.names, self.cut])
            else:
                extra = [pa.array(n_words), pa.array(n_hit), pa.array([[str(phrases.ids[i]) for i in f] for f in found], pa.list_(pa.string())), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], SPANS)]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in self.names), *extra], [*self.names, "n_words", "n_hit", "items", "spans"])

    def _block(self, phrases, block, n_words, n_hit, found, spans):
        ptr = block.ptr
        n_words[block.lo : block.hi] = np.diff(ptr)
        edge, pairs = np.zeros(len(block.hashes) + 1, np.int64), []
        for places, size, items, which in _occurrences(phrases, block.hashes, ptr):
            np.add.at(edge, places, 1)
            np.add.at(edge, places + size, -1)
            docs = np.searchsorted(ptr, places, side="right") - 1
            for doc, phrase in np.unique(np.stack((docs, which), 1), axis=0):
                pairs.append((int(doc), items[phrase]))
        if not pairs:
            return
        hit = np.cumsum(edge)[:-1] > 0
        total = np.concatenate(([0], np.cumsum(hit)))
        n_hit[block.lo : block.hi] = total[ptr[1:]] - total[ptr[:-1]]
        by_doc: dict[int, set[int]] = {}
        for doc, items in pairs:
            by_doc.setdefault(doc, set()).update(items)
        for doc, items in by_doc.items():
            found[block.lo + doc] = sorted(items)
            words = hit[ptr[doc] : ptr[doc + 1]]
            change = np.flatnonzero(np.diff(np.concatenate(([False], words, [False])).astype(np.int8))) + ptr[doc]
            base = int(block.base[doc])
            spans[block.lo + doc] = [(int(block.starts[a]) - base, int(block.ends[b - 1]) - base) for a, b in zip(change[::2], change[1::2])]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def _phrase_blocks(bench: DataFrame, item: str, text: str, window: int, block_words: int) -> Iterator[Phrases]:
    """The benchmark in blocks of bounded size, so that what is broadcast never grows with it."""
    rows, size = [], 0
    for item_id, value in bench.select(F.col(item), F.encode(F.col(text), "UTF-8")).toLocalIterator():
        rows.append((item_id, None if value is None else bytes(value)))
        size += len(rows[-1][1] or b"") // 2 + 1
        if size >= block_words:
            yield Phrases(rows, window)
            rows, size = [], 0
    yield Phrases(rows, window)


def overlaps(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (ids as strings, sorted), spans (byte
    ranges of the UTF-8 text to remove, merged).

    A null or empty text has no words; an item without words or id has no windows; repeated items
    are each reported; repeated documents are each scanned. Extra columns are not read. A benchmark
    beyond block_words is taken in blocks, whose spans are merged per document."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
    read = docs.select(doc_id, text)
    blocks = [spark.sparkContext.broadcast(p) for p in _phrase_blocks(bench, item_id, item_text, window, block_words)]
    if len(blocks) == 1:
        return read.mapInArrow(_Scanner(blocks[0], [doc_id], text, None), schema).withColumn("items", F.array_sort("items"))
    joined, _, found = _found_in_blocks(read, text, blocks)
    return joined.mapInArrow(_Recount(doc_id, text, found), schema)


def _found_in_blocks(docs: DataFrame, text: str, blocks: list) -> tuple[DataFrame, str, str]:
    """docs with a row id and a struct (items, spans) of what all blocks find in a row's text (null where
    nothing), and the names of both columns. The ids are written first, so every block sees the same."""
    row, found = fresh("__row", docs.columns), fresh("__found", docs.columns)
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    schema = f"`{row}` long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
    union = None
    for block in blocks:
        part = numbered.select(row, text).mapInArrow(_Scanner(block, [row], text, None), schema).where("n_hit > 0")
        union = part if union is None else union.unionByName(part)
    merged = union.groupBy(row).agg(F.struct(F.array_sort(F.flatten(F.collect_list("items"))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")).alias(found))
    return numbered.join(merged, row, "left"), row, found


def _union(text: bytes, spans: list[dict]) -> list[tuple[int, int]]:
    """Sorted spans without overlaps; those with no word between them become one, as within a block."""
    out: list[list[int]] = []
    for s in spans:
        if out and (s["start"] <= out[-1][1] or not text[out[-1][1] : s["start"]].translate(ALNUM_WORDS).split()):
            out[-1][1] = max(out[-1][1], s["end"])
        else:
            out.append([s["start"], s["end"]])
    return [(a, b) for a, b in out]


class _Recount:
    """mapInArrow function: the columns of overlaps from the spans of all blocks."""

    def __init__(self, doc_id: str, text: str, found: str):
        self.doc_id, self.text, self.found = doc_id, text, found

    def __call__(self, batches):
        count = lambda t: len(t.translate(ALNUM_WORDS).split())
        for batch in sliced(batches):
            words, hits, items, spans = [], [], [], []
            for t, f in zip(utf8_values(batch.column(self.text)), batch.column(self.found).to_pylist()):
                t, f = t or b"", f or {"items": [], "spans": []}
                union = _union(t, f["spans"])
                words.append(count(t))
                hits.append(sum(count(t[a:b]) for a, b in union))
                items.append(f["items"])
                spans.append([{"start": a, "end": b} for a, b in union])
            yield pa.RecordBatch.from_arrays([batch.column(self.doc_id), pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, SPANS)], [self.doc_id, "n_words", "n_hit", "items", "spans"])


def remove_overlaps(docs: DataFrame, bench: DataFrame, text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with every removal span cut out of text; other columns and all rows stay, and n_chars, where
    there is such a column, follows the text. The spans of all blocks of a large benchmark are found
    in the original texts, merged for each row and cut at once."""
    spark = docs.sparkSession
    ship(spark)
    hit = fresh("__hit", docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(hit, T.LongType())])
    blocks = [spark.sparkContext.broadcast(p) for p in _phrase_blocks(bench, "item_id", "text", window, block_words)]
    if len(blocks) == 1:
        out = docs.mapInArrow(_Scanner(blocks[0], [], text, hit), schema)
    else:
        joined, row, found = _found_in_blocks(docs, text, blocks)
        out = joined.drop(row).mapInArrow(_Cut(text, found, hit), schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(hit) > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(hit)


class _Cut:
    """mapInArrow function: cuts the spans of all blocks out of the text and tells how many there were."""

    def __init__(self, text: str, found: str, hit: str):
        self.text, self.found, self.hit = text, found, hit

    def __call__(self, batches):
        for batch in sliced(batches):
            names = [n for n in batch.schema.names if n != self.found]
            columns, kept, hits = {n: batch.column(n) for n in names}, [], []
            for t, f in zip(utf8_values(columns[self.text]), batch.column(self.found).to_pylist()):
                union = _union(t, f["spans"]) if f else []
                kept.append(_without(t, union) if union else t)
                hits.append(len(union))
            columns[self.text] = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(hits, pa.int64())], [*names, self.hit])


def item_digest(items):
    """SHA-256 of the comma-joined item ids."""
    return F.sha2(F.array_join(items, ","), 256)


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """(doc_id, n_words, n_hit, sorted items) by comparing all places; for tests."""
    import re

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    out = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(window, len(v))
            for i in range(len(v) - n + 1 if n and item is not None else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[i : i + n]:
                        hit.update(range(j, j + n))
                        names.add(str(item))
        out.append((doc, len(w), len(hit), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()))
    return out


ORACLE = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT *, least(len(w), 10) AS n FROM items WHERE len(w) > 0 AND item_id IS NOT NULL),
starts AS (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM sized),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS v FROM starts),
places AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM words JOIN (SELECT DISTINCT n FROM sized) z ON len(w) >= n),
found AS (SELECT p.doc_id, p.i, p.n, windows.item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS v FROM places) p JOIN windows USING (n, v)),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
