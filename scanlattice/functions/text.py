"""Scalar text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def substring_range(c: Column, start: int | None, end: int | None) -> Column:
    """Characters start..end-1; negative positions count from the end; out of range is clamped."""
    n = F.length(c)
    place = lambda p, default: default if p is None else F.greatest(F.lit(0), F.least(n, F.lit(p) if p >= 0 else n + p))
    a, b = place(start, F.lit(0)), place(end, n)
    return F.when(a >= b, F.lit("")).otherwise(F.substring(c, a + 1, b - a))


def words(c: Column) -> Column:
    """Pieces between case changes, dashes, dots, slashes, spaces and underscores."""
    split = F.regexp_replace(F.regexp_replace(c, r"([A-Z]+)([A-Z][a-z])", "$1 $2"), r"([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(split, r"[-./ _]+"), lambda w: w != "")


def capitalize(c: Column) -> Column:
    """First character in upper case, the rest unchanged."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def convert(c: Column, case: str) -> Column:
    if case in ("lower", "upper"):
        return getattr(F, case)(c)
    if case == "capitalize":
        return capitalize(c)
    low = F.transform(words(c), lambda w: F.lower(w))
    if case in ("snake", "kebab"):
        return F.array_join(low, "_" if case == "snake" else "-")
    if case == "pascal":
        return F.array_join(F.transform(low, capitalize), "")
    if case == "camel":
        return F.array_join(F.transform(low, lambda w, i: F.when(i == 0, w).otherwise(capitalize(w))), "")
    raise ValueError(f"unknown case {case}")


def octets(c: Column) -> Column:
    """The UTF-8 bytes as two-digit hexadecimal strings."""
    return F.filter(F.split(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "$1,"), ","), lambda x: x != "")


def entropy_millibits(c: Column) -> Column:
    """Shannon entropy of a value's bytes, in thousandths of a bit."""
    letters = octets(c)
    n = F.size(letters)
    share = lambda x: F.size(F.filter(letters, lambda y: y == x)) / n
    total = F.aggregate(F.transform(F.array_sort(F.array_distinct(letters)), lambda x: -share(x) * F.log2(share(x))), F.lit(0.0), lambda a, b: a + b)
    return F.round(total * 1000).cast("long")


def glob_regex(glob: str) -> str:
    """`*` any but a slash, `**` any, `?` one but a slash."""
    out = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in re.findall(r"\*\*|\*|\?|[^*?]+", glob))
    return f"^{out}$"


def basis_points(n: Column, d: Column) -> Column:
    """n/d in truncated ten-thousandths; 0 for an empty denominator, 10,000 beyond 2^32-1. Whole numbers
    throughout; the product saturates at 2^64-1 instead of overflowing."""
    whole = lambda c: c.cast("decimal(38,0)")
    product = F.least((whole(n) * 10000).cast("decimal(38,0)"), F.lit("18446744073709551615").cast("decimal(38,0)"))
    large = product >= (whole(d) * 4294967296).cast("decimal(38,0)")
    quotient = F.call_function("div", product, F.when((d != 0) & ~large, whole(d)))
    return F.when(d == 0, F.lit(0)).when(large, F.lit(10000)).otherwise(quotient).cast("long")


def row_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\u0001", *parts), 256), 1, 16))


def fnv_id(prefix: str, *parts: Column) -> Column:
    """prefix and FNV-1a of the parts joined by NUL, so that no two lists of parts are one text."""
    return F.concat(F.lit(prefix), fnv1a_hex(F.array_join(F.array(*parts), "\u0000", "")))


# Fixed value: the grammar of a semantic version.
SEMVER = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"


def semver(c: Column) -> Column:
    """(major, minor, patch, whole, pre) in the order of precedence: a prerelease comes before its release,
    numbers before words, fewer identifiers before more. Null where it is no version."""
    part = lambda k: F.regexp_extract(c, SEMVER, k)
    number = lambda x: x.rlike(r"^\d+$")
    pre = F.transform(F.filter(F.split(part(4), r"\."), lambda x: x != ""), lambda x: F.struct((~number(x)).alias("word"), F.when(number(x), x.cast("decimal(38,0)")).alias("number"), F.when(~number(x), x).alias("text")))
    fields = [part(k).cast("long").alias(n) for k, n in ((1, "major"), (2, "minor"), (3, "patch"))]
    return F.when(c.rlike(SEMVER), F.struct(*fields, (part(4) == "").alias("whole"), pre.alias("pre")))


def is_prerelease(c: Column) -> Column:
    return c.rlike(SEMVER) & (F.regexp_extract(c, SEMVER, 4) != "")


def markdown_escape(c: Column) -> Column:
    """Prose for a Markdown report: on one line, with what would be emphasis, a link or a tag escaped. Spans in
    backticks stay as they are."""
    def prose(x: Column) -> Column:
        return F.replace(F.replace(F.regexp_replace(F.regexp_replace(x, r"([\\\\*_\[\]])", r"\\$1"), r"[\r\n]", " "), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    # Pieces between backticks: those at odd places are spans, unless the last one is not closed.
    parts = F.split(c, "`", -1)
    code = lambda i: (i % 2 == 1) & (i < F.size(parts) - 1)
    return F.array_join(F.transform(parts, lambda x, i: F.when(code(i), x).otherwise(prose(x))), "`")


def file_class(path: Column) -> Column:
    """Class of a path by its name and extension; see sources.repository."""
    from scanlattice.sources import repository

    return repository.classify(path, include_nonproduction=True)


def is_test_path(path: Column) -> Column:
    """Whether a path is of code that is not shipped; see sources.repository."""
    from scanlattice.sources import repository

    return repository.is_excluded(path)


def fnv1a_hex(c: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, 64 bits, as 16 hex digits. Kept as two 32-bit halves, so no product overflows."""
    values = F.transform(octets(c), lambda x: F.conv(x, 16, 10).cast("long"))
    mask = 0xFFFFFFFF

    def step(h: Column, b: Column) -> Column:
        low = h["lo"].bitwiseXOR(b)
        product = low * 0x1B3
        carry = F.shiftright(product, 32)
        return F.struct((h["hi"] * 0x1B3 + low * 256 + carry).bitwiseAND(mask).alias("hi"), product.bitwiseAND(mask).alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    return F.aggregate(values, start, step, lambda h: F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0"))))


def line_of(text: Column, offset: Column) -> Column:
    """Line, from 1, of a character offset."""
    return (F.length(F.substring(text, F.lit(1), offset)) - F.length(F.replace(F.substring(text, F.lit(1), offset), F.lit("\n"), F.lit(""))) + 1).cast("long")


def column_of(text: Column, offset: Column) -> Column:
    """Column, from 1, of a character offset, in characters."""
    return (F.length(F.substring_index(F.substring(text, F.lit(1), offset), "\n", -1)) + 1).cast("long")


def byte_position(text: Column, offset: Column) -> Column:
    """(line, column, offset) of a byte offset at the start of a character: both from 1, columns in characters."""
    head = F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), offset.cast("int")), "UTF-8")
    line = F.length(F.regexp_replace(head, "[^\n]", "")) + 1
    column = F.length(F.substring_index(head, "\n", -1)) + 1
    return F.struct(line.cast("long").alias("line"), column.cast("long").alias("column"), offset.cast("long").alias("offset"))


def relative_path(c: Column) -> Column:
    """Slashes for backslashes, without leading `./`."""
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def uri_path(c: Column) -> Column:
    """Percent-encoded path; slashes stay."""
    return F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def is_uuid(c: Column) -> Column:
    return c.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")


def looks_random(c: Column) -> Column:
    """16 to 256 characters, at least 8 distinct ones, of at least two of four classes."""
    classes = sum((c.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", "[^a-zA-Z0-9]")), F.lit(0))
    return F.length(c).between(16, 256) & (F.size(F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))) >= 8) & (classes >= 2)


def split_reason(c: Column, most: int = 500) -> Column:
    """Pieces of at most `most` characters, cut at white space where there is any; no word is lost."""
    pieces = F.regexp_extract_all(c, F.lit(rf"(?s)\S.{{0,{most - 1}}}(?:\s|$)|\S{{{most}}}"), F.lit(0))
    return F.transform(pieces, lambda x: F.regexp_replace(x, r"\s+$", ""))


def url_scheme(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lit(""))


def url_host(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)), F.lit(""))
