"""Toxicity by maximum-scoring segments.

Every word has a signed score: the log-odds, with an informative Dirichlet prior of the pooled counts,
of its occurring in toxic against clean documents. Words whose log-odds are no larger than what topics
and languages alone bring about, within their standard deviations, are scored as one: by the log-odds of
all of them together. A rare word takes the score of its longest beginning that has one. A linear-time
scan finds all maximal scoring segments of a text; Karlin-Altschul statistics, whose parameters are
estimated from clean documents, turn a segment's score into an expectation for a text of that length,
and the expectations of the significant segments make up the document's score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ALNUM_WORDS, ship, sliced, utf8_values, word_blocks, written

#: Most labelled documents that are learned from (chosen by a hash of the id).
SAMPLE = 16_000
#: Lengths of word beginnings, in bytes, and occurrences from which on a word or beginning is a feature.
HEADS = (4, 5, 6, 7, 8)
LEAST_COUNT = 5
#: Prior mass as a share of the class's words, spread as the pooled counts, and mass of each feature besides.
PRIOR, FLOOR = 0.1, 0.5
#: Standard deviations that log-odds must have, and their least size: words that merely go with a topic
#: or a language of toxic documents differ by less, and are scored by the log-odds of all such words together.
SURE, EFFECT = 3.0, 2.0
#: How far below zero the mean score of clean text is at least.
MARGIN = 0.01
SIGNIFICANT = 0.05


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, past the last, sum), disjoint, in order; linear time.

    Only runs of equal sign count for the candidates, so the loop sees one step per such run."""
    kept: list[tuple[float, float, int, int]] = []  # (sum before, sum after, first, past the last)
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    breaks = np.flatnonzero(np.diff(positive) > 1)
    firsts = positive[np.concatenate(([0], breaks + 1))]
    lasts = positive[np.concatenate((breaks, [len(positive) - 1]))] + 1
    links: list[int] = []  # for each kept segment the nearest earlier one with a smaller sum before
    for first, last in zip(firsts.tolist(), lasts.tolist()):
        low, high = float(sums[first]), float(sums[last])
        while True:
            at = len(kept) - 1
            while at >= 0 and kept[at][0] >= low:
                at = links[at]
            if at < 0 or kept[at][1] >= high:
                kept.append((low, high, first, last))
                links.append(at)
                break
            low, first = kept[at][0], kept[at][2]
            del kept[at:], links[at:]
    return [(f, e, high - low) for low, high, f, e in kept]


class Model:
    """Feature hashes with signed scores, the score of words without any, statistics of segments in clean
    text and a calibration."""

    def __init__(self, hashes: np.ndarray, odds: np.ndarray, drift: float):
        order = np.argsort(hashes)
        self.hashes, self.odds, self.drift = hashes[order], odds[order], drift
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.hashes & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        self.decay, self.scale, self.slope, self.shift = 0.0, 1.0, 1.0, -3.0

    def token_scores(self, columns: list[np.ndarray]) -> np.ndarray:
        """A score for each word: that of the first of its features (the word, then its beginnings from
        long to short) that is known; the drift where none is."""
        out, open_ = np.full(len(columns[0]), self.drift), np.ones(len(columns[0]), bool)
        for h in columns if len(self.hashes) else []:
            maybe = np.flatnonzero(self.bits[(h & np.uint64((1 << 22) - 1)).astype(np.int64)] & open_)
            at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            good = self.hashes[at] == h[maybe]
            out[maybe[good]] = self.odds[at[good]]
            open_[maybe[good]] = False
        return out

    def evidence(self, score: float, words: int) -> float:
        """A segment's score in nats above what the largest of a clean text of that length is expected to have."""
        return self.decay * score - np.log(self.scale * max(words, 1))

    def document(self, scores: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
        """(evidence of the significant segments, those segments). Segments' expectations are
        multiplied as of independent finds: their evidences above the threshold are summed."""
        found = [(a, b, self.evidence(s, len(scores))) for a, b, s in maximal_segments(scores)]
        if not found:
            return -10.0, []
        most = max(e for _, _, e in found)
        good = [(a, b, e) for a, b, e in found if e > -np.log(SIGNIFICANT)]
        return max(most, sum(e + np.log(SIGNIFICANT) for _, _, e in good) - np.log(SIGNIFICANT) if good else most), good

    def score(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * min(max(evidence, -10), 60) + self.shift, -500, 500))))


def _features(block) -> list[np.ndarray]:
    """The features of each word: one of each order."""
    return [block.hashes, *reversed(block.prefixes)]


class _Count:
    """mapInArrow function: per task, how often each feature stands in toxic and in clean documents."""

    def __call__(self, batches):
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in sliced(batches):
            toxic = np.array(batch.column("toxic").to_pylist(), np.int64)
            for block in word_blocks(utf8_values(batch.column("text")), ALNUM_WORDS, HEADS):
                of = np.repeat(toxic[block.lo : block.hi], np.diff(block.ptr))
                for which in (0, 1):
                    for h in _features(block):
                        parts.append(_tally(h[of == which], which))
                if len(parts) > 200:
                    parts = [_summed(parts)]
        if parts:
            words, counts = _summed(parts)
            for lo in range(0, len(words), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(words[lo : lo + (1 << 16)].view(np.int64)), *(pa.array(counts[lo : lo + (1 << 16), k]) for k in (0, 1))], ["h", "clean", "toxic"])


def _tally(hashes: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    values, many = np.unique(hashes, return_counts=True)
    out = np.zeros((len(values), 2), np.int64)
    out[:, which] = many
    return values, out


def _summed(parts) -> tuple[np.ndarray, np.ndarray]:
    values = np.concatenate([v for v, _ in parts])
    distinct, where = np.unique(values, return_inverse=True)
    sums = np.zeros((len(distinct), 2), np.int64)
    np.add.at(sums, where, np.concatenate([c for _, c in parts]))
    return distinct, sums


class _Look:
    """mapInArrow function: for each document its class, its words, those without a feature, the sum of
    all scores, the best segment's score and, once extremes are known, the evidence."""

    def __init__(self, model):
        self.model = model

    def __call__(self, batches):
        model = self.model.value
        for batch in sliced(batches):
            rows = []
            for block in word_blocks(utf8_values(batch.column("text")), ALNUM_WORDS, HEADS):
                scores = model.token_scores(_features(block))
                for a, b in zip(block.ptr[:-1], block.ptr[1:]):
                    own = scores[a:b]
                    best = max((s for _, _, s in maximal_segments(own)), default=0.0)
                    rows.append((int(b - a), int((own == model.drift).sum()), float(own.sum()), best, model.document(own)[0] if model.decay else 0.0))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["toxic", "words", "rest", "total", "best", "evidence"])


def draw(labels: DataFrame, doc_id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """About `sample` labelled ids at most, by a hash of the id: small enough to send everywhere."""
    rows = labels.select(doc_id, F.col(label).cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col(doc_id).isNotNull())
    share = min(1.0, sample / max(rows.count(), 1))
    return rows.where(F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit(5)), F.lit(1_000_000)) < F.lit(1_000_000 * share))


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds of each feature in toxic against clean text, their standard deviations) from its counts in
    both and the words of both. Each class has a Dirichlet prior of PRIOR of its words, spread as the
    pooled counts, and of FLOOR for a feature, dealt to the classes by their size."""
    share, odds, spread = (toxic + clean) / (n_toxic + n_clean), 0.0, 0.0
    for sign, counts, n in ((1, toxic, n_toxic), (-1, clean, n_clean)):
        prior, weight = PRIOR * n * share + FLOOR * n / (n_toxic + n_clean), PRIOR * n + FLOOR
        odds = odds + sign * np.log((counts + prior) / (n + weight - counts - prior))
        spread = spread + 1 / (counts + prior)
    return odds, np.sqrt(spread)


def fit(drawn: DataFrame, text: str = "text", label: str = "toxic") -> Model | None:
    """A model from labelled texts, as many as draw() gives; None if a class is absent. Words are counted
    on the executors; counts of the words of the drawn documents and five numbers of each document reach
    the driver. Null texts and labels other than 0 and 1 are not learned from; repeated rows count each
    time; equal texts with both labels count on both sides."""
    spark = drawn.sparkSession
    ship(spark)
    rows = drawn.select(F.col(text).alias("text"), F.col(label).cast("int").alias("toxic")).where("text is not null and toxic in (0, 1)")
    drawn = written(rows, "drawn")  # several passes over few documents instead of over all
    if drawn.select("toxic").distinct().count() < 2:
        return None

    def looked(model):
        return drawn.mapInArrow(_Look(spark.sparkContext.broadcast(model)), "toxic int, words long, rest long, total double, best double, evidence double").toPandas()

    sums = drawn.mapInArrow(_Count(), "h long, clean long, toxic long").groupBy("h").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sums = written(sums, "counts")
    orders = len(HEADS) + 1  # each word counts once in each order
    n_toxic, n_clean = ((x or 0) / orders for x in sums.agg(F.sum("toxic"), F.sum("clean")).first())
    if not n_toxic or not n_clean:
        return None
    counts = sums.where(F.col("clean") + F.col("toxic") >= LEAST_COUNT).toPandas()
    toxic, clean = counts["toxic"].to_numpy(float), counts["clean"].to_numpy(float)
    odds, deviation = log_odds(toxic, clean, n_toxic, n_clean)
    telling = (np.abs(odds) >= SURE * deviation) & (np.abs(odds) >= EFFECT)
    model = Model(counts["h"].to_numpy(np.int64).view(np.uint64)[telling], np.clip(odds[telling], -6, 6), -MARGIN)
    seen = looked(model)
    rest = [float(seen["rest"][seen["toxic"] == y].sum()) for y in (1, 0)]
    # All other words are one frequent outcome: the ratio of its probabilities, as odds would blow it up.
    shares = [(y + PRIOR * n * sum(rest) / (n_toxic + n_clean)) / (n * (1 + PRIOR)) for y, n in zip(rest, (n_toxic, n_clean))]
    model.drift = float(np.log(shares[0] / shares[1])) if all(shares) else -MARGIN
    calm = seen[seen["toxic"] == 0]
    mean = (float(calm["total"].sum()) + (model.drift + MARGIN) * rest[1]) / max(float(calm["words"].sum()), 1.0)
    if mean > -MARGIN:  # the segments' statistics ask for a negative mean
        model.odds, model.drift = model.odds - mean - MARGIN, model.drift - mean - MARGIN
    _extremes(model, looked(model))
    _curve(model, looked(model))
    return model


def _extremes(model: Model, seen) -> None:
    """Decay and scale of the extreme-value law, from two quantiles of the clean documents' best
    segments, which mislabelled documents hardly move."""
    toxic, words, best = (seen[n].to_numpy() for n in ("toxic", "words", "best"))
    clean = (toxic == 0) & (words > 0)
    middle, high = np.quantile(best[clean], [0.5, 0.95]) if clean.any() else (0.0, 1.0)
    model.decay = 2.6037 / max(float(high - middle), 1.5)  # distance of the two quantiles of the unit law
    centre = float(middle) - 0.3665 / model.decay
    model.scale = float(np.exp(model.decay * centre) / max(np.mean(words[clean]), 1.0))


def _curve(model: Model, seen) -> None:
    """A logistic curve from evidence to the share of toxic documents."""
    y, x = seen["toxic"].to_numpy(float), np.clip(seen["evidence"].to_numpy(), -10, 60)
    mean, dev = float(x.mean()), max(float(x.std()), 1e-6)
    u, a, b = (x - mean) / dev, 1.0, 0.0
    for _ in range(60):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-(a * u + b)))
        w = p * (1 - p) + 1e-6
        g = np.array([((y - p) * u).sum() - 0.1 * a, (y - p).sum()])
        h = np.array([[(w * u * u).sum() + 0.1, (w * u).sum()], [(w * u).sum(), w.sum()]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    slope, shift = max(a, 0.05) / dev, b - max(a, 0.05) * mean / dev
    model.slope, model.shift = float(slope), float(shift)


class _Score:
    def __init__(self, model, doc_id: str, text: str):
        self.model, self.doc_id, self.text = model, doc_id, text

    def __call__(self, batches):
        model = self.model.value
        for batch in sliced(batches):
            scores, spans = [], []
            for block in word_blocks(utf8_values(batch.column(self.text)), ALNUM_WORDS, HEADS):
                tokens = model.token_scores(_features(block)) if model else None
                for k, (a, b) in enumerate(zip(block.ptr[:-1], block.ptr[1:])):
                    evidence, found = model.document(tokens[a:b]) if model else (-10.0, [])
                    scores.append(model.score(evidence) if model else 0.0)
                    base = int(block.base[k])
                    spans.append([{"start": int(block.starts[a + i]) - base, "end": int(block.ends[a + j - 1]) - base, "evidence": float(e)} for i, j, e in found])
            yield pa.RecordBatch.from_arrays([batch.column(self.doc_id), pa.array(scores, pa.float64()), pa.array(spans, _SPANS)], [self.doc_id, "score", "passages"])


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))


def score(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1), passages (byte ranges of the UTF-8 text of all
    significant segments). Null and empty texts have no passage and the lowest score; without a
    model all scores are 0. Repeated rows get equal scores; other columns are not read."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(_Score(spark.sparkContext.broadcast(model), doc_id, text), f"`{doc_id}` {kind}, score double, passages array<struct<start:long,end:long,evidence:double>>")
