"""Credentials in texts: provider tokens, high-entropy assignments, allow marks and lists.

Detection walks bytes with state (open quotes, escapes), so it runs on Arrow batches; what follows it
(allow list, counts, masking) is joins and expressions."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from scanlattice.functions import text as T
from scanlattice.functions.shipping import ship

# providers' prefixes, alphabets and least and greatest lengths.
PROVIDERS = (
    ("github_personal_access_token", "ghp_", "A-Za-z0-9", 40, 40),
    ("gitlab_personal_access_token", "glpat-", "A-Za-z0-9_-", 26, 128),
    ("slack_token", "xoxb-", "A-Za-z0-9_-", 25, 128),
)
GENERIC = "generic_high_entropy_assignment"
# Words that make the name of an assigned value a sensitive one.
SENSITIVE = ("password", "passwd", "secret", "api_key", "apikey", "access_token", "auth_token", "client_secret", "private_key")
# What marks a placeholder.
PLACEHOLDERS = ("example", "sample", "dummy", "placeholder", "replace", "redacted", "changeme", "not-a-real", "not_real", "fake", "${")
LEAST, MOST, LEAST_ENTROPY = 16, 256, 3.5
REDACTED = "[REDACTED]"

_QUOTED = re.compile(rb"""(['"`])(?:[^\\]|\\.)*?(?:\1|\Z)|[:=]""", re.S)
_UUID = re.compile(rb"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_SENSITIVE = re.compile("|".join(SENSITIVE).encode())
_BARE = re.compile(rb"""(?:[^\s,;/]|/(?!/))*""")


def separator(line: bytes) -> int | None:
    """Place of the first `=` outside quotes that is part of no comparison or arrow, else of the first such `:`."""
    colon = None
    for m in _QUOTED.finditer(line):
        if m[0] == b":":
            colon = m.start() if colon is None else colon
        elif m[0] == b"=" and line[m.start() - 1 : m.start()] not in (b"=", b"!", b"<", b">") and line[m.end() : m.end() + 1] not in (b"=", b">"):
            return m.start()
    return colon


def value_range(line: bytes) -> tuple[int, int] | None:
    """The value that a line assigns to a sensitive name: up to the closing quote, or to white space,
    a comma, a semicolon or a `//`."""
    at = separator(line)
    if at is None or not _SENSITIVE.search(line[:at].lower()):
        return None
    start = at + 1
    while line[start : start + 1].isspace():
        start += 1
    quote = line[start : start + 1]
    if quote in (b"'", b'"', b"`"):
        start += 1
        end = line.find(quote, start)
        end = len(line) if end < 0 else end
    else:
        end = _BARE.match(line, start).end()
    return (start, end) if end > start else None


def is_placeholder(value: bytes) -> bool:
    low = value.lower()
    return any(p.encode() in low for p in PLACEHOLDERS) or len(set(value)) == 1


def entropy(value: bytes) -> float:
    """Bits for each byte."""
    n = len(value)
    return sum(-k / n * math.log2(k / n) for k in Counter(value).values())


def is_generic(value: bytes) -> bool:
    if not LEAST <= len(value) <= MOST or not value.isascii() or re.search(rb"[\s'\"`,;<>]", value) or is_placeholder(value) or _UUID.fullmatch(value) or b"://" in value:
        return False
    classes = sum(bool(re.search(p, value)) for p in (rb"[a-z]", rb"[A-Z]", rb"[0-9]", rb"[^a-zA-Z0-9]"))
    return len(set(value)) >= 8 and classes >= 2 and entropy(value) >= LEAST_ENTROPY


def candidates(source: bytes) -> list[tuple[int, int, str, int | None]]:
    """(start, stop, detector, thousandths of a bit) by start, stop and detector; a generic find that
    overlaps a provider's is left out."""
    found = []
    for detector, prefix, alphabet, least, most in PROVIDERS:
        for m in re.finditer(rf"(?<![{alphabet}]){re.escape(prefix)}[{alphabet}]*+".encode(), source):
            if least <= len(m[0]) <= most and not is_placeholder(m[0]):
                found.append((m.start(), m.end(), detector, None))
    taken, base = list(found), 0
    for line in source.split(b"\n"):
        span = value_range(line.rstrip(b"\r"))
        if span and is_generic(line[span[0] : span[1]]):
            start, stop = base + span[0], base + span[1]
            if not any(start < b and stop > a for a, b, *_ in taken):
                found.append((start, stop, GENERIC, min(math.floor(entropy(source[start:stop]) * 1000 + 0.5), 65535)))
        base += len(line) + 1
    return sorted(set(found), key=lambda x: x[:3])


class _Detect:
    def __init__(self, marker: str | None):
        self.marker = marker.lower().encode() if marker else None

    def __call__(self, batches):
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.bool_())
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                for start, stop, detector, bits in candidates(text or b""):
                    low, high = text.rfind(b"\n", 0, start) + 1, text.find(b"\n", start)
                    marked = bool(self.marker) and self.marker in text[low : high if high >= 0 else len(text)].lower()
                    rows.append((path, start, stop, text.count(b"\n", 0, start) + 1, detector, bits, text[start:stop], marked))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["path", "start", "stop", "line", "detector", "entropy_millibits", "value", "marked"])


def detect(files: DataFrame, path: str = "path", text: str = "text", marker: str | None = None, allowed: list[tuple[str, str]] = ()) -> DataFrame:
    """files -> path, start, stop (bytes), line, detector, rule, confidence, entropy_millibits, length,
    fingerprint, id, redacted, suppressed. A find is suppressed, not dropped, if its line has the marker
    or the allow list, pairs (kind, value), has its fingerprint, detector or a glob of its path.

    Null texts have no finds; equal paths are searched each; the value itself is in no column."""
    ship(files.sparkSession)
    rows = files.select(F.col(path).cast("string").alias("path"), F.col(text).alias("text")).mapInArrow(_Detect(marker), "path string, start long, stop long, line long, detector string, entropy_millibits long, value binary, marked boolean")
    provider = F.col("detector") != GENERIC
    rule = F.concat(F.lit("secret-"), F.replace(F.col("detector"), F.lit("_"), F.lit("-")))
    rows = rows.withColumn("fingerprint", F.concat(F.lit("sec-fnv1a64-"), T.fnv1a_hex(F.col("value").cast("string")))).withColumn("rule", rule)
    of = {k: [v for kind, v in allowed if kind == k] for k in ("fingerprint", "detector", "path")}
    listed = F.col("fingerprint").isin(of["fingerprint"]) | F.col("detector").isin(of["detector"])
    for glob in of["path"]:
        listed = listed | F.col("path").rlike(T.glob_regex(glob))
    rows = rows.withColumn("marked", F.col("marked") | listed)
    return rows.select(
        "path", "start", "stop", "line", "detector", "rule", F.when(provider, "high").otherwise("medium").alias("confidence"), "entropy_millibits", (F.col("stop") - F.col("start")).alias("length"),
        "fingerprint", T.fnv_id("ev-", F.col("path"), F.col("rule"), F.col("start").cast("string"), F.col("stop").cast("string")).alias("id"), F.lit(REDACTED).alias("redacted"), F.col("marked").alias("suppressed"),
    )


def allow_list(contents: str) -> tuple[list[tuple[str, str]], list[str]]:
    """(kind, value) of the lines `kind=value`, and a warning for each line that is none."""
    known = {GENERIC, *(p[0] for p in PROVIDERS)}
    rows, warnings = [], []
    for n, raw in enumerate(contents.splitlines(), 1):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        kind, sign, value = (x.strip() for x in line.partition("="))
        value = value.replace("\\", "/") if kind == "path" else value
        good = {
            "fingerprint": re.fullmatch(r"sec-fnv1a64-[0-9a-fA-F]{16}", value) is not None,
            "detector": value in known,
            "path": bool(value) and not value.startswith("/") and value[1:2] != ":" and ".." not in value.split("/"),
        }
        if not sign or not good.get(kind, False):
            warnings.append(f"line {n}: " + ("kind=value expected" if not sign else f"unknown kind {kind!r}" if kind not in good else f"invalid {kind}"))
        else:
            rows.append((kind, value))
    return rows, warnings


def masked(text: Column, spans: Column) -> Column:
    """A text with the spans of a sorted array of (start, stop), in bytes, replaced by the mark."""
    data, mark = F.encode(text, "UTF-8"), F.encode(F.lit(REDACTED), "UTF-8")
    zero = F.struct(F.encode(F.lit(""), "UTF-8").alias("out"), F.lit(0).cast("long").alias("at"))
    piece = lambda a, b: F.substring(data, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    step = lambda acc, s: F.struct(F.concat(acc["out"], piece(acc["at"], s["start"]), mark).alias("out"), s["stop"].alias("at"))
    return F.aggregate(spans, zero, step, lambda acc: F.decode(F.concat(acc["out"], F.substring(data, (acc["at"] + 1).cast("int"), F.lit(2147483647))), "UTF-8"))


def counts(found: DataFrame) -> DataFrame:
    """Finds and suppressed finds of each detector."""
    return found.groupBy("detector").agg(F.count_if(~F.col("suppressed")).alias("reported"), F.count_if(F.col("suppressed")).alias("suppressed"))
