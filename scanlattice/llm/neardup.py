"""Near-duplicate documents by MinHash with tensored banding.

Two collections of m half-keys (each of a few minhash values) are computed for a document; table
(i, j) is keyed by half-key i of the first and j of the second, so m*m tables cost 2m half-keys.
Documents with equal shingle sets are one node from the start. In every bucket the members are
compared with one centre only, first; then, where a bucket still holds several components, members
whose own shingles rule out any link are set aside, and the
members outside its largest component are compared with those of other components. Pairs in one
component need no comparison, so this finds the same components as comparing all pairs of a bucket.
Every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import SPACED_WORDS, mix64, ship, sliced, utf8_values, word_blocks, written
from .components import components

SHINGLE = 5
HALF = 2
#: A pair at the threshold shares no table with at most this probability.
MISS = 1e-4
#: Bits of the one-bit minhash sketches that come before the comparison of left-over pairs.
SKETCH = 2048
#: Documents compared with one centre in one task before the next task takes over.
CHUNK = 256

_PLACE = np.random.default_rng(20240131).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def side_for(percent: int) -> int:
    """Half-keys of each collection: the fewest that keep to MISS at the threshold (8 for 85, 10 for 80)."""
    side, half = 1, (percent / 100) ** HALF
    while 1 - (1 - (1 - half) ** side) ** 2 > MISS:
        side += 1
    return side


@functools.cache
def _draws(side: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Factors and addends of the minhashes, and one order of documents for each first half-key, so that
    tables differ in their centres."""
    rng = np.random.default_rng(20240131)
    rng.integers(1, 1 << 63, len(_PLACE), dtype=np.uint64)
    mul = rng.integers(1, 1 << 63, 2 * side * HALF, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(1, 1 << 63, 2 * side * HALF, dtype=np.uint64)
    return mul, add, [int(x) for x in rng.integers(0, 1 << 62, side)]


def shingle_sets(texts: list[bytes | None], k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; one for the whole sequence if it has fewer than k words."""
    for block in word_blocks(texts, SPACED_WORDS):
        h, ptr = block.hashes, block.ptr
        n = len(h) - k + 1
        if n > 0:
            rolled = h[:n] * _PLACE[0]
            for i in range(1, k):
                rolled += h[i : i + n] * _PLACE[i]
            rolled = mix64(rolled)
        for a, b in zip(ptr[:-1], ptr[1:]):
            if b - a >= k:
                s = np.sort(rolled[a : b - k + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                whole = (h[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True)
                yield mix64(whole + _PLACE[k + 1 : k + 2] * np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def _half_keys(shingles: np.ndarray, side: int) -> np.ndarray:
    mul, add, _ = _draws(side)
    least = np.empty(len(mul), np.uint64)
    for at in range(len(mul)):
        least[at] = (shingles * mul[at] + add[at]).min()
    parts = least.reshape(2 * side, HALF)
    return mix64((parts * _PLACE[:HALF]).sum(axis=1, dtype=np.uint64) + np.arange(2 * side, dtype=np.uint64)).view(np.int64)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


class _Signatures:
    def __init__(self, doc_id: str, text: str, side: int):
        self.doc_id, self.text, self.side = doc_id, text, side

    def __call__(self, batches):
        for batch in sliced(batches):
            count, digest, first, second = [], [], [], []
            for s in shingle_sets(utf8_values(batch.column(self.text))):
                count.append(len(s))
                if len(s):
                    keys = _half_keys(s, self.side).tolist()
                    digest.append(_digest(s))
                    first.append(keys[: self.side])
                    second.append(keys[self.side :])
                else:
                    digest.append(None)
                    first.append(None)
                    second.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(self.doc_id), pa.array(count, pa.int64()), pa.array(digest, pa.binary()), pa.array(first, pa.list_(pa.int64())), pa.array(second, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "first", "second"])


class _Compare:
    """mapInArrow function over rows sorted by (centre, salt, centre's own row first)."""

    def __call__(self, batches):
        held, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            centres, salts, docs = (batch.column(n).to_pylist() for n in ("centre", "salt", "doc"))
            out: tuple[list, list, list, list] = ([], [], [], [])
            for centre, salt, doc, s in zip(centres, salts, docs, shingle_sets(utf8_values(batch.column("text")))):
                if doc is None:
                    held, own = (centre, salt), s
                    continue
                assert held == (centre, salt)
                common = len(np.intersect1d(own, s, assume_unique=True))
                for column, value in zip(out, (doc, centre, common, len(own) + len(s) - common)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc", "centre", "common", "together"])


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs(doc, centre), texts(doc, text) -> doc, centre, common, together: sizes of intersection
    and union of the full sets. A centre with many partners is dealt to several tasks."""
    # Only centres beyond a chunk are dealt out; there is one for each CHUNK pairs at most. The table is written
    # first, so that its join with the pairs has plain exchanges, which a very common centre can be split over.
    many = written(pairs.groupBy("centre").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("salts")).where("salts > 1"), "many")
    dealt = written(pairs.join(many, "centre", "left").select("centre", F.pmod(F.xxhash64("doc"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), "doc"), "dealt")  # read twice below
    members = dealt.join(texts, "doc").select("centre", "salt", "doc", "text")
    heads = dealt.select("centre", "salt").distinct().join(texts.withColumnRenamed("doc", "centre"), "centre").select("centre", "salt", F.lit(None).cast("long").alias("doc"), "text")
    ordered = members.unionByName(heads).repartition("centre", "salt").sortWithinPartitions("centre", "salt", F.col("doc").asc_nulls_first())
    return ordered.mapInArrow(_Compare(), "doc long, centre long, common long, together long")


def _table_bits(side: int) -> int:
    return (side * side - 1).bit_length()


def _table_of(side: int) -> tuple[Column, Column]:
    """(i, j) of the table that a bucket's key has in its lowest bits."""
    number = F.col("key").bitwiseAND((1 << _table_bits(side)) - 1).cast("int")
    return F.floor(number / side).cast("int"), number % side


def _bucket_rows(nodes: DataFrame, side: int) -> DataFrame:
    """(key, doc): a row for each of a document's side*side tables, with the table's number in the key."""
    number = lambda i, j: (i * side + j).cast("long")
    key = lambda a, b, n: F.shiftleft(F.xxhash64(a, b, n), _table_bits(side)).bitwiseOR(n)
    tables = F.flatten(F.transform("first", lambda a, i: F.transform("second", lambda b, j: key(a, b, number(i, j)))))
    return nodes.select(F.explode(tables).alias("key"), "doc")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Links documents with 100 * intersection >= percent * union of their five-word shingle sets.
    A document without words, or with null text, has no shingles and is linked with nothing. Repeated
    rows are one node and are each returned; a doc_id that repeats with other texts is one node with
    the links of all of them. A null doc_id is linked with nothing and has a null component. Extra
    columns are not read. Ids of any type with an order will do; integers come back as long. A pair at the threshold shares none of the tables with probability of at most MISS.
    Within a bucket that still holds several components after the first round, sketches of all members
    outside the largest component are compared (in the join, by XOR of longs); few pairs leave it."""
    ship(docs.sparkSession)
    side = side_for(percent)
    kind = docs.schema[doc_id].dataType
    if not isinstance(kind, T.IntegralType):
        return _by_number(docs, doc_id, text, percent)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = written(source.mapInArrow(_Signatures("doc_id", "text", side), "doc_id long, n_shingles long, digest binary, first array<long>, second array<long>"), "signatures")
    sets = signed.where("digest is not null and doc_id is not null")
    # Written first, so that the join has plain exchanges on both sides, which a very common set can be split over.
    classes = written(sets.groupBy("digest").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n")).where("n > 1").select("digest", "doc"), "classes")
    tagged = written(sets.join(classes, "digest", "left").select(F.col("doc_id"), F.coalesce("doc", "doc_id").alias("doc"), F.when(F.coalesce("doc", "doc_id") == F.col("doc_id"), F.col("first")).alias("first"), "second"), "tagged")
    nodes = tagged.where("first is not null").select("doc", "first", "second")

    order = F.element_at(F.array(*[F.lit(x) for x in _draws(side)[2]]), _table_of(side)[0] + 1)
    rows = _bucket_rows(nodes, side)
    buckets = rows.groupBy("key").agg(F.min(F.col("doc").bitwiseXOR(order)).alias("low"), F.max(F.col("doc").bitwiseXOR(order)).alias("high")).where("low < high").select("key", F.col("low").bitwiseXOR(order).alias("centre"))
    shared = written(rows.join(buckets, "key").select("key", "doc", "centre"), "buckets")
    pairs = written(shared.where("doc != centre").select("doc", "centre").distinct(), "pairs")

    involved = pairs.select("doc").union(pairs.select(F.col("centre").alias("doc"))).distinct()
    texts = written(source.join(involved.withColumnRenamed("doc", "doc_id").hint("shuffle_hash"), "doc_id").select(F.col("doc_id").alias("doc"), "text"), "texts")
    seen = written(compared(pairs, texts), "compared")
    linked = F.col("common") * 100 >= F.col("together") * percent
    links = seen.where(linked).select(F.col("doc").alias("u"), F.col("centre").alias("v"))
    repeats = tagged.where("doc_id != doc").select(F.col("doc_id").alias("u"), F.col("doc").alias("v"))
    first = components(links.union(repeats))

    rest = written(_left_over(shared, seen, first, texts, percent, side), "rest")
    second = written(compared(rest, texts), "compared")
    more = second.where(linked).select(F.col("doc").alias("u"), F.col("centre").alias("v"))
    joined = components(first.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
    out = signed.select("doc_id", "n_shingles").join(joined, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"))


def _by_number(docs: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """near_duplicates for ids that are no integers: by numbers in the ids' order."""
    ids = docs.select(F.col(doc_id).alias("id")).where("id is not null").distinct().orderBy("id")
    numbers = written(written(ids, "ids").withColumn("number", F.monotonically_increasing_id()), "numbers")
    numbered = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(numbers, "id", "left").select(F.col("number").alias("doc_id"), "text")
    found = near_duplicates(numbered, percent=percent)
    named = found.join(numbers.select(F.col("number").alias("doc_id"), "id"), "doc_id", "left").join(numbers.select(F.col("number").alias("component_id"), F.col("id").alias("component")), "component_id", "left")
    return named.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


class _AddDigest:
    """mapInArrow function: adds the digest of the shingle set, null for a text without words."""

    def __init__(self, text: str, name: str):
        self.text, self.name = text, name

    def __call__(self, batches):
        for batch in sliced(batches):
            digests = [_digest(s) if len(s) else None for s in shingle_sets(utf8_values(batch.column(self.text)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], [*batch.schema.names, self.name])


def with_digest(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """docs with a column more: equal for rows of equal shingle sets, null for those without words."""
    ship(docs.sparkSession)
    return docs.mapInArrow(_AddDigest(text, name), T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))


class _Explode:
    """mapInArrow function: (doc, size of its set, shingle)."""

    def __call__(self, batches):
        for batch in batches:
            docs = batch.column("doc").to_numpy(zero_copy_only=False)
            for doc, s in zip(docs, shingle_sets(utf8_values(batch.column("text")))):
                for at in range(0, len(s), 1 << 18):
                    part = s[at : at + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), doc)), pa.array(np.full(len(part), len(s))), pa.array(part.view(np.int64))], ["doc", "n", "shingle"])


def _words(side: int) -> list[str]:
    return [*(f"s{i}" for i in range(SKETCH // 64)), *(f"h{i}" for i in range(2 * side))]


class _Sketch:
    """mapInArrow function: (doc, SKETCH bits), each from a minhash value of its own, and the half-keys."""

    def __init__(self, side: int):
        self.side = side

    def __call__(self, batches):
        rng = np.random.default_rng(97)
        mul = rng.integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        add = rng.integers(1, 1 << 63, SKETCH, dtype=np.uint64)
        for batch in sliced(batches):
            rows, halves = np.empty((batch.num_rows, SKETCH), np.uint8), np.empty((batch.num_rows, 2 * self.side), np.int64)
            for k, s in enumerate(shingle_sets(utf8_values(batch.column("text")))):
                least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(s), 4096):
                    for lo in range(0, SKETCH, 64):
                        np.minimum(least[lo : lo + 64], (s[at : at + 4096, None] * mul[None, lo : lo + 64] + add[None, lo : lo + 64]).min(axis=0), out=least[lo : lo + 64])
                halves[k] = _half_keys(s, self.side)
                rows[k] = (least >> np.uint64(17)) & np.uint64(1)
            words = np.packbits(rows, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(words[:, i]) for i in range(SKETCH // 64)), *(pa.array(halves[:, i]) for i in range(2 * self.side))], ["doc", *_words(self.side)])


def _linkable(docs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of docs(doc), with distinct sets, those that may have a link among each other.

    Shingles that no other of the documents has are outside every intersection; a document with too
    many of them has no link and goes. As long as that takes out a good part, the rest is asked again."""
    left, size = written(docs, "linkable"), None
    while True:
        before = size if size is not None else left.count()
        shingles = left.join(texts, "doc").select("doc", "text").mapInArrow(_Explode(), "doc long, n long, shingle long")
        alone = shingles.groupBy("shingle").agg(F.count("*").alias("k"), F.min("doc").alias("doc"), F.min("n").alias("n")).where("k = 1").groupBy("doc", "n").agg(F.count("*").alias("alone"))
        gone = alone.where((F.col("n") - F.col("alone")) * 100 < F.col("n") * percent).select("doc")
        left = written(left.join(gone, "doc", "left_anti"), "linkable")
        size = left.count()
        if size >= 0.9 * before:
            return left


def _left_over(shared: DataFrame, seen: DataFrame, first: DataFrame, texts: DataFrame, percent: int, side: int) -> DataFrame:
    """Pairs of a bucket in different components, once each, that were not compared and that the
    triangle inequality of the Jaccard distance (by their distances to the bucket's centre) allows.
    Documents whose own shingles rule out any link are left out first, and pairs whose sketches differ
    by five deviations more than those of a pair at the threshold (one such pair in 3 million is lost). One of the two is always outside the bucket's largest component."""
    words = _words(side)
    labelled = shared.join(first, F.col("doc") == F.col("node"), "left").select("key", "doc", "centre", F.coalesce("component", "doc").alias("component"))
    labelled = written(labelled, "labelled")
    only = lambda rows: rows.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("key")
    suspects = labelled.join(only(labelled), "key", "left_semi")
    suspects = suspects.join(_linkable(suspects.select("doc").distinct(), texts, percent), "doc", "left_semi")
    labelled = written(suspects.select("key", "doc", "centre", "component"), "suspects")
    rows = labelled.join(only(labelled), "key", "left_semi").join(seen.select("doc", "centre", (F.col("common") / F.col("together")).alias("likeness")), ["doc", "centre"], "left").withColumn("likeness", F.when(F.col("doc") == F.col("centre"), 1.0).otherwise(F.col("likeness")))
    sketches = rows.select("doc").distinct().join(texts, "doc").mapInArrow(_Sketch(side), "doc long, " + ", ".join(f"{w} long" for w in words))
    rows = written(rows.join(sketches, "doc"), "mixed")
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    rows = rows.join(largest, "key")
    few = rows.where("component != largest").select("key", F.col("doc").alias("d1"), F.col("component").alias("c1"), F.col("likeness").alias("l1"), *(F.col(w).alias(f"o{w}") for w in words))
    # Bits differ with probability (1 - J) / 2; five deviations above that of J at the threshold lose no pair in practice.
    expect = SKETCH * (1 - percent / 100) / 2
    most = expect + 5 * (expect * (1 + percent / 100) / 2) ** 0.5
    differ = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"o{w}"))) for w in words[: SKETCH // 64]), F.lit(0))
    # A pair that shares several tables is taken at the first half-keys that it shares, so it comes once.
    agree = lambda at: F.coalesce(*[F.when(F.col(f"h{at + n}") == F.col(f"oh{at + n}"), n) for n in range(side)])
    i, j = _table_of(side)
    once = (agree(0) == i) & (agree(side) == j)
    slack = 1 - percent / 100 + 1e-9
    pairs = few.join(rows, "key").where((F.col("c1") != F.col("component")) & ((F.col("component") == F.col("largest")) | (F.col("d1") < F.col("doc"))) & (F.abs(F.col("l1") - F.col("likeness")) <= slack) & once & (differ <= most))
    pairs = pairs.select(F.greatest("d1", "doc").alias("doc"), F.least("d1", "doc").alias("centre")).distinct()
    done = seen.select(F.greatest("doc", "centre").alias("doc"), F.least("doc", "centre").alias("centre"))
    return pairs.join(done, ["doc", "centre"], "left_anti")


ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM words UNION SELECT reach.doc_id, links.v FROM reach JOIN links ON links.u = reach.other)
SELECT words.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, c.component_id, words.doc_id = c.component_id AS kept
FROM words JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
