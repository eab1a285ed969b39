"""Language identification by error-correcting output codes.

Languages get binary codewords that differ in many places. For each bit a linear classifier over
hashed byte n-grams (naive Bayes log-odds of the languages whose bit is 1 against the others) is
fitted; a text's bits are decoded to the codeword of least weighted logistic loss. A text whose two
nearest codewords cost about the same is flagged as ambiguous.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BLOCK_BYTES, ship, sliced, utf8_values

BITS = 15
SIZE = 1 << BITS
ORDERS = (2, 3, 4)
#: Most labelled documents of a language that the classifiers are fitted on (chosen by a hash of the id).
PER_LANGUAGE = 3000
AMBIGUOUS = 0.7
_GAP = b"    "
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b < 0x41 or 0x5B <= b <= 0x60 or 0x7B <= b < 0x80 else b for b in range(256))
_SPACES = re.compile(rb" +")
_MULTIPLY = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(0x27D4EB2F))


def has_letter(text: str) -> bool:
    """Whether a character is a letter (Unicode category L; numerals such as ½ or Ⅷ are none)."""
    return any(map(str.isalpha, text))


def features(buffer: bytes, n: int) -> np.ndarray:
    """Hashed n-grams that begin at the first n places of a buffer, (len(ORDERS), n); beyond its end is padding."""
    a = np.frombuffer(buffer + _GAP, np.uint8).astype(np.uint32) + np.uint32(1)
    out, mixed = np.empty((len(ORDERS), n), np.int32), a[:n] * _MULTIPLY[0]
    for k in range(1, max(ORDERS)):
        mixed = (mixed ^ (a[k : n + k] * _MULTIPLY[k % 4])) * np.uint32(0x01000193)
        if k + 1 in ORDERS:
            out[ORDERS.index(k + 1)] = mixed >> np.uint32(32 - BITS)
    return out


def _blocks(texts: list[bytes | None]):
    """(number of the document, cleaned text, places) in pieces of bounded size: letters, one space for all
    else. A piece runs on past its places as far as the n-grams that begin there, so a cut changes nothing."""
    for k, t in enumerate(texts):
        clean = _SPACES.sub(b" ", b" " + (t or b"").translate(_LOWER) + b" ")
        for at in range(0, len(clean), BLOCK_BYTES):
            yield k, clean[at : at + BLOCK_BYTES + max(ORDERS) - 1], min(BLOCK_BYTES, len(clean) - at)


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1 with large mutual distance: exhaustive for few languages, else the best
    of several seeded random codes. No bit is constant."""
    if n <= 2:
        return np.array([[1.0], [-1.0]][:n])
    if n <= 6:
        wide = (1 << (n - 1)) - 1
        return np.array([[1.0 if row == 0 or not ((column + 1) >> (row - 1)) & 1 else -1.0 for column in range(wide)] for row in range(n)])
    rng, wide, best, most = np.random.default_rng(7), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, wide))
        code[0, np.abs(code.sum(0)) == n] *= -1
        distance = (wide - code @ code.T) / 2 + wide * np.eye(n)
        if distance.min() > most:
            best, most = code, distance.min()
    return best


class Model:
    """Codewords, a weight for each bit and hashed n-gram, and a weight for each bit's loss."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: (languages, orders * SIZE) n-gram counts."""
        self.languages, self.code = languages, codewords(len(languages))
        share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
        bits = []
        for column in self.code.T:
            one = share[column > 0].mean(axis=0) if (column > 0).any() else share.mean(axis=0)
            zero = share[column < 0].mean(axis=0) if (column < 0).any() else share.mean(axis=0)
            bits.append(np.clip(np.log(one) - np.log(zero), -4, 4))
        self.weights = np.array(bits).reshape(len(bits), len(ORDERS), SIZE).astype(np.float32)
        # A bit's loss weighs as its classifier's expected margin over the languages it was fitted on.
        margins = np.array([[(share[k] * w).sum() * c[k] for k in range(len(languages))] for w, c in zip(bits, self.code.T)])
        self.trust = np.clip(margins.mean(axis=1), 0.01, None)
        self.trust /= self.trust.sum()

    def sums(self, piece: bytes, n: int) -> np.ndarray:
        f = features(piece, n)
        return np.array([sum(float(w[o][f[o]].sum()) for o in range(len(ORDERS))) for w in self.weights])

    def decode(self, sums: np.ndarray, n: int) -> tuple[str, float, bool]:
        """(language, share of the nearest codeword, ambiguous)."""
        margin = sums / (len(ORDERS) * np.sqrt(n + 8.0))
        loss = (np.logaddexp(0, -self.code * margin) * self.trust).sum(axis=1)
        shares = np.exp(-(loss - loss.min()) * 8)
        shares /= shares.sum()
        best = int(np.argmax(shares))
        return self.languages[best], float(shares[best]), bool(shares[best] < AMBIGUOUS and len(self.languages) > 1)


class _Count:
    def __call__(self, batches):
        counts: dict[str, np.ndarray] = {}
        for batch in sliced(batches):
            langs = batch.column("lang").to_pylist()
            for k, piece, places in _blocks(utf8_values(batch.column("text"))):
                own = counts.setdefault(langs[k], np.zeros((len(ORDERS), SIZE), np.int64))
                f = features(piece, places)
                for o in range(len(ORDERS)):
                    own[o] += np.bincount(f[o], minlength=SIZE)
        for lang, own in counts.items():
            at = np.flatnonzero(own.ravel())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(own.ravel()[at])], ["lang", "feature", "n"])


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from rows with text and language; at most about per_language documents of each, taken
    by a hash of doc_id. None if no row has both. What is collected is bounded by languages * features.
    Repeated rows count each time they are drawn; a text under several languages counts for each."""
    ship(labelled.sparkSession)
    rows = labelled.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.lit(1.0)
    for name, n in sizes.items():
        if n > per_language:
            share = F.when(F.col("lang") == name, F.lit(per_language / n)).otherwise(share)
    drawn = rows.where(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit("")), F.lit(11)), F.lit(1_000_000)) < share * 1_000_000)
    sums = drawn.select("text", "lang").mapInArrow(_Count(), "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(sums["lang"].unique())
    if not names:
        return None
    counts = np.zeros((len(names), len(ORDERS) * SIZE))
    for k, name in enumerate(names):
        own = sums[sums["lang"] == name]
        counts[k, own["feature"].to_numpy()] = own["n"].to_numpy()
    return Model(names, counts)


class _Predict:
    def __init__(self, model, names: list[str], text: str, added: tuple[str, str, str]):
        self.model, self.names, self.text, self.added = model, names, text, added

    def __call__(self, batches):
        model = self.model.value
        for batch in sliced(batches):
            column = batch.column(self.text)
            texts = utf8_values(column)
            sums: dict[int, list] = {}
            if model:
                for k, piece, places in _blocks(texts):
                    own = sums.setdefault(k, [0.0, 0])
                    own[0] = own[0] + model.sums(piece, places)
                    own[1] += places
            out: tuple[list, list, list] = ([], [], [])
            for k, value in enumerate(column.to_pylist()):
                if value is None or not model or not has_letter(value):
                    found = ("und", 0.0, False)
                else:
                    found = model.decode(*sums[k])
                for column_, x in zip(out, found):
                    column_.append(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in self.names), pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.bool_())], [*self.names, *self.added])


def predict(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text", added: tuple[str, str, str] = ("__lang", "__score", "__ambiguous")) -> DataFrame:
    """The columns `keep` and, by the names in `added`, language, score and whether the nearest codeword is
    no clear winner, for every row; whole texts are read. ValueError if `keep` has one of those names.

    Null texts and texts without a letter get `und` and 0; without a model all texts do. Repeated rows
    get equal values. Of codewords of equal loss the first language in order wins."""
    if set(keep) & set(added):
        raise ValueError(f"a column is already named one of {added}")
    spark = docs.sparkSession
    ship(spark)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    read = list(dict.fromkeys([*keep, text]))
    return docs.select(*read).mapInArrow(_Predict(spark.sparkContext.broadcast(model), keep, text, added), fields + f", `{added[0]}` string, `{added[1]}` double, `{added[2]}` boolean")
