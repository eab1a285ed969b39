"""License scans: an Aho-Corasick automaton finds identifier tags and notice phrases in one pass
over a text's words; a shunting-yard parser evaluates and/or/with expressions after a tag."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ALNUM_WORDS, ship, sliced, utf8_values

# Phrases of the contract and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Further notice phrases of the method and their labels.
NOTICES = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl", "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd", "permission is hereby granted free of charge": "mit",
    "creative commons attribution": "cc-by", "released into the public domain": "public-domain", "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
# identifiers' families, by prefix of the lower-cased identifier.
FAMILIES = {"cc-by-nc": "cc-by-nc", "cc-by-nd": "cc-by-nd", "cc-by-sa": "cc-by-sa", "agpl": "agpl", "lgpl": "lgpl", "gpl": "gpl", "apache": "apache", "cc-by": "cc-by", "cc0": "public-domain", "mit": "mit", "bsd": "bsd", "mpl": "mpl", "unlicense": "public-domain", "isc": "isc", "licenseref": "custom", "0bsd": "bsd", "zlib": "zlib", "bsl-1": "bsl"}
PERMISSIVE = {"apache", "mit", "bsd", "isc", "public-domain", "cc-by", "zlib", "bsl"}
# SPDX identifiers that have neither a digit nor a hyphen.
PLAIN = """AAL Abstyles AdaCore Afmparse AMDPLPA AML AMPAS APAFML Bahyph Barr Beerware blessing Borceux Caldera checkmk ClArtistic Crossword CrystalStacker
Cube curl diffmark DOC Dotseqn DSDP dtoa dvipdfm eGenix Entessa EUDatagrid Fair FreeImage FSFUL FSFULLR FTL Giftware Glide Glulxe gnuplot HaskellReport HPND
ICU IJG ImageMagick iMatix Intel IPA ISC JPNIC JSON Leptonica Libpng libtiff MakeIndex MirOS MITNFA Motosoto MTLL Multics Mup Naumen NCSA NetCDF Newsletr
NGPL NLPL Nokia Noweb NRL NTP OGTSL OML OpenSSL Plexus PostgreSQL psfrag psutils Qhull Rdisc RSCPL Ruby Saxpath SCEA Sendmail Sleepycat SMLNJ SNIA Spencer
SWL TCL TMate TOSL TTWL Unlicense UPL Vim VOSTROM Wsuipa WTFPL Xerox xinetd Xnet xpp XSkat Zed Zlib""".split()
_PLAIN_LOW = {x.lower() for x in PLAIN}
_IDENTIFIER = re.compile(r"(?:DocumentRef-[A-Za-z0-9.-]+:)?(?=[0-9.+-]*[A-Za-z])[A-Za-z0-9][A-Za-z0-9.+-]*")
_PRIORITY = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9.+:-]+)")
_TAG_TEXT = re.compile(r"spdx-license-identifier:", re.I)


def family(identifier: str) -> str | None:
    """The family of a whole identifier: a prefix with a version or variant behind it, no longer word."""
    low = identifier.lower()
    return next((label for prefix, label in FAMILIES.items() if low.startswith(prefix) and re.match(r"(?:v\d|[^a-z]|$)", low[len(prefix) :])), None)


def is_identifier(token: str, prose: bool = False) -> bool:
    """Whether a token can be an operand: one of a known family, or of the form of an SPDX identifier
    (with a digit or a hyphen, or listed in PLAIN). prose: behind a small and/or, where running text may
    follow, it must be spelled as listed, or have a digit or a capital first."""
    if family(token):
        return True
    if not _IDENTIFIER.fullmatch(token):
        return False
    if prose:
        return token in PLAIN or any(c.isdigit() for c in token) or "-" in token and token[0].isupper()
    return token.lower() in _PLAIN_LOW or "-" in token or any(c.isdigit() for c in token)


def parse(text: str, at: int = 0) -> list[str] | None:
    """The expression at a place of text in reverse Polish order, None if there is none. It ends at
    the first token that cannot continue it; operators compare in either case."""
    return read(text, at)[0]


def read(text: str, at: int = 0) -> tuple[list[str] | None, bool]:
    """(what parse gives, whether more was meant: a capital operator without an operand, or an open bracket)."""
    out: list[str] = []
    stack: list[str] = []
    operand, good, depth, prose = True, None, 0, False
    while m := _TOKEN.match(text, at):
        token = m[1]
        low = token.lower()
        if operand:
            if token == "(":
                stack.append(token)
                depth += 1
            elif token == ")" or low in _PRIORITY or not (is_identifier(token, prose) or (stack and stack[-1] == "with")):
                break
            else:
                out.append(token)
                operand = False
        elif low in _PRIORITY:
            while stack and stack[-1] != "(" and _PRIORITY[stack[-1]] >= _PRIORITY[low]:
                out.append(stack.pop())
            stack.append(low)
            operand, prose = True, token == low
        elif token == ")" and depth:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        else:
            break
        at = m.end()
        if not operand and not depth:  # whole so far: what follows may turn out to be prose
            good = out + [x for x in reversed(stack)]
    return good, bool(depth or (operand and stack and not prose))


def evaluate(rpn: list[str]) -> tuple[set[str], bool]:
    """(labels of all identifiers, whether the terms can be met under permissive ones alone). An identifier
    of no known family is its own label and not permissive."""
    stack: list[tuple[set[str], bool]] = []
    for token in rpn:
        if token in _PRIORITY and len(stack) >= 2:
            b, a = stack.pop(), stack.pop()
            if token == "with":
                stack.append(a)  # an exception only adds permissions
            else:
                stack.append((a[0] | b[0], a[1] and b[1] if token == "and" else a[1] or b[1]))
        else:
            label = family(token) or token.lower()
            stack.append(({label}, label in PERMISSIVE))
    return stack[-1] if stack else (set(), False)


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase, label in BASE.items():
        found.add_word(f" {phrase} ", (label, True, phrase.count(" ") + 1))
    for phrase, label in NOTICES.items():
        found.add_word(f" {phrase} ", (label, False, phrase.count(" ") + 1))
    found.add_word(f" {TAG} ", (None, False, TAG.count(" ") + 1))
    found.make_automaton()
    return found


def scan_text(value: bytes | None, automaton) -> dict:
    """Findings in one text: word positions of base phrases, labels, expressions after tags, score."""
    words = (value or b"").translate(ALNUM_WORDS).split()
    joined = " " + " ".join([b" ".join(words).decode("utf-8", "replace"), ""])
    starts, base, labels, tagged, notices, terms = [], set(), set(), False, 0, []
    at = count = 0
    for end, (label, is_base, size) in automaton.iter(joined):
        count += joined.count(" ", at, end + 1)
        at = end + 1
        first = count - 1 - size
        if label is None:
            tagged = True
            continue
        labels.add(label)
        notices += 1
        if is_base:
            starts.append(first)
            base.add(label)
    if tagged:
        text = value.decode("utf-8", "replace")
        for m in _TAG_TEXT.finditer(text):
            rpn, cut = read(text, m.end())
            if rpn:
                found, permissive = evaluate(rpn)
                labels |= found
                terms.append((" ".join(rpn), None if cut else permissive))
    score = 1 - 0.5**notices * (0.1 if terms else 1.0) if notices or terms else 0.0
    return {"n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "expressions": "; ".join(t for t, _ in terms), "permissive": any(p for _, p in terms) if terms and all(p is not None for _, p in terms) else None, "score": score}


_FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("expressions", pa.string()), ("permissive", pa.bool_()), ("score", pa.float64())]


class _Scan:
    def __init__(self, doc_id: str, text: str):
        self.doc_id, self.text = doc_id, text

    def __call__(self, batches):
        automaton = _automaton()
        for batch in sliced(batches):
            rows = [scan_text(v, automaton) for v in utf8_values(batch.column(self.text))]
            yield pa.RecordBatch.from_arrays([batch.column(self.doc_id), *(pa.array([r[n] for r in rows], t) for n, t in _FIELDS)], [self.doc_id, *(n for n, _ in _FIELDS)])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs, repeated rows and null ids included. Null and empty texts have no words
    and score 0. Labels are distinct and sorted; permissive is null without an expression or where one is cut
    short. score is 1 less 0.5 for each notice, multiplied, and less 0.9 of the rest for a parsed
    expression: 0 without evidence, below 1 always."""
    ship(docs.sparkSession)
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(_Scan(doc_id, text), f"`{doc_id}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expressions string, permissive boolean, score double")
