"""Locked packages against advisories: names join, version requirements decide."""

from __future__ import annotations

import hashlib
import re
import tomllib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from scanlattice.functions import text as T
from scanlattice.functions.shipping import ship

# The registries whose packages the advisories are about.
REGISTRIES = ("registry+https://github.com/rust-lang/crates.io-index", "sparse+https://index.crates.io/")
LIMIT = 1 << 20
_VERSION = re.compile(T.SEMVER)
_COMPARATOR = re.compile(r"(\^|~|>=|<=|>|<|=)?\s*(\d+|\*)(?:\.(\d+|\*|x))?(?:\.(\d+|\*|x))?(-[0-9A-Za-z.-]+)?(?:\+\S+)?")


def parsed(version: str) -> tuple | None:
    m = _VERSION.match(version or "")
    if not m:
        return None
    pre = tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in (m[4] or "").split(".") if p)
    return (int(m[1]), int(m[2]), int(m[3]), not m[4], pre)


def _bounds(comparator: str) -> tuple[tuple, tuple] | None:
    """[low, high) of a comparator; a release bound is below its version's prereleases only if it has one itself."""
    m = _COMPARATOR.fullmatch(comparator.strip())
    if not m:
        raise ValueError(f"not a version requirement: {comparator!r}")
    op, top = m[1] or "^", (10**9,)
    if m[2] == "*":
        return (0, 0, 0), top
    numbers = [int(x) for x in m.groups()[1:4] if x and x.isdigit()]
    if len(numbers) < 3 and not m[1]:
        op = "=" if any(x in ("*", "x") for x in m.groups()[1:4] if x) else op
    full = (*numbers, 0, 0)[:3]
    after = lambda k: (*full[:k], full[k] + 1)
    last = len(numbers) - 1
    if op == "=":
        return full, (after(last) if last < 2 else (*full, 1))
    if op == "~":
        return full, after(min(last, 1))
    if op == "^":
        lead = next((k for k, x in enumerate(numbers) if x), last)
        return full, after(lead)
    if op == ">=":
        return full, top
    if op == ">":
        return (after(last) if last < 2 else (*full, 1)), top
    return (0, 0, 0), (full if op == "<" else after(last) if last < 2 else (*full, 1))


def satisfies(version: str, requirement: str) -> bool:
    """Whether a release version meets all comparators of a requirement. Prereleases are judged apart."""
    v = parsed(version)
    if v is None or not v[3]:
        return False
    own = (*v[:3], 0)
    for comparator in requirement.split(","):
        low, high = _bounds(comparator)
        if not tuple(low) <= own[: len(low)] + own[len(low) :] or not own < tuple(high):
            return False
    return True


@pandas_udf(BooleanType())
def _any_met(version: pd.Series, requirements: pd.Series) -> pd.Series:
    return pd.Series([any(satisfies(v, r) for r in rs) for v, rs in zip(version, requirements)], dtype="boolean")


def lockfile(text: str) -> tuple[list[tuple[str, str, str]], str]:
    """(name, version, source) of each locked package, and the file's SHA-256; ValueError for what is no lock file."""
    found = tomllib.loads(text).get("package")
    if not isinstance(found, list):
        raise ValueError("no package records")
    rows = []
    for p in found:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", p.get("name", "")) or "version" not in p:
            raise ValueError("a package without a valid name and version")
        rows.append((p["name"], p["version"], p.get("source", "")))
    return rows, hashlib.sha256(text.encode()).hexdigest()


SCHEMA = "path string, sha256 string, id string, package string, title string, kind string, informational string, withdrawn boolean, patched array<string>, unaffected array<string>, error string"


def _advisory(path: str, text: str) -> tuple:
    own = hashlib.sha256(text.encode()).hexdigest()
    try:
        if len(text.encode()) > LIMIT:
            raise ValueError("an advisory over 1 MiB")
        fence = re.match(r"(?s)﻿?.*?```toml\n(.*?)```(.*)", text)
        if not fence:
            raise ValueError("no TOML block")
        doc = tomllib.loads(fence[1])
        a, v = doc["advisory"], doc["versions"]
        for r in (*v.get("patched", []), *v.get("unaffected", [])):
            satisfies("0.0.0", r)
        kind = "malicious" if "malicious" in a.get("categories", []) else a.get("informational", "vulnerability")
        title = next((x[2:].strip() for x in fence[2].splitlines() if x.startswith("# ")), a["id"])
        return (path, own, a["id"], a["package"], title, kind, a.get("informational"), "withdrawn" in a, list(v.get("patched", [])), list(v.get("unaffected", [])), None)
    except (ValueError, KeyError, TypeError) as e:
        return (path, own, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")


class _Parse:
    def __call__(self, batches):
        kinds = [pa.string()] * 7 + [pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
        for batch in batches:
            rows = [_advisory(p, t or "") for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [c.split()[0] for c in SCHEMA.split(", ")])


def database(files: DataFrame) -> DataFrame:
    """files(path, text) of advisories in Markdown with a TOML block -> a row each; unreadable ones have an error."""
    ship(files.sparkSession)
    return files.select("path", "text").mapInArrow(_Parse(), SCHEMA)


def checked(packages: DataFrame) -> DataFrame:
    """packages(name, version, source), each once, with a status: excluded (another source), prerelease (to be assessed
    apart), invalid, or checked."""
    status = F.when(~F.coalesce("source", F.lit("")).isin(*REGISTRIES), "excluded").when(~F.col("version").rlike(T.SEMVER), "invalid").when(T.is_prerelease(F.col("version")), "prerelease").otherwise("checked")
    return packages.distinct().withColumn("status", status)


def findings(packages: DataFrame, advisories: DataFrame, informational: bool = False) -> DataFrame:
    """(name, version, id, kind, title): advisories of a checked package that neither a patched nor an unaffected
    requirement excuses. Withdrawn ones do not count, informational ones only on demand (malicious ones always)."""
    ship(packages.sparkSession)
    a = advisories.where("error is null and not withdrawn")
    if not informational:
        a = a.where("informational is null or kind = 'malicious'")
    met = checked(packages).where("status = 'checked'").join(a.withColumnRenamed("package", "name"), "name")
    return met.where(~_any_met(F.col("version"), F.concat("patched", "unaffected"))).select("name", "version", "id", "kind", "title")
