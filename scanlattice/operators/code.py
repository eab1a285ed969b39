"""Trees of Python sources and code patterns with metavariables.

A source becomes a concrete tree: the nodes of the language's own parser, in between them the tokens that
it has no node for (operators, brackets, keywords, names of attributes) and comments. The table of nodes has the columns
that trees and selectors need, so relations, positions and selectors work on it; a pattern is matched in the
same pass that parses a source, and its captures come as rows."""

from __future__ import annotations

import ast
import io
import keyword
import re
import sys
import tokenize
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field as default

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from scanlattice.functions.shipping import ship

#: Stands for the dollar sign while a pattern is parsed: a letter that names may have.
_DOLLAR = "\u01bb"


@dataclass(slots=True)
class Node:
    kind: str
    start: int
    stop: int
    named: bool
    field: str = ""
    children: list["Node"] = default(default_factory=list)
    text: str = ""
    parent: "Node | None" = None
    sib: int = 0

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    @property
    def extra(self) -> bool:
        return self.kind == "comment"


def parse(source: str) -> Node:
    """The tree of a source; offsets count characters. SyntaxError if it is no Python."""
    starts, at = [], 0
    for line in source.splitlines(keepends=True) or [""]:
        starts.append(at)
        at += len(line)
    starts.append(at)
    lines = source.splitlines(keepends=True)
    ascii_ = source.isascii()

    def place(line: int, column: int) -> int:  # the parser counts bytes, the tokenizer characters
        return starts[line - 1] + (column if ascii_ else len(lines[line - 1].encode()[:column].decode()))

    tokens = []
    depth = 0  # of format strings, which are leaves
    for t in tokenize.generate_tokens(io.StringIO(source).readline):
        if t.type == tokenize.FSTRING_START:
            depth += 1
            first = t if depth == 1 else first
        if t.type == tokenize.FSTRING_END:
            depth -= 1
            if not depth:
                tokens.append(("string", starts[first.start[0] - 1] + first.start[1], starts[t.end[0] - 1] + t.end[1], True))
            continue
        if depth or t.type in (tokenize.NEWLINE, tokenize.NL, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER, tokenize.ENCODING):
            continue
        kind = "comment" if t.type == tokenize.COMMENT else "identifier" if t.type == tokenize.NAME and not keyword.iskeyword(t.string) else "number" if t.type == tokenize.NUMBER else "string" if t.type == tokenize.STRING else t.string
        tokens.append((kind, starts[t.start[0] - 1] + t.start[1], starts[t.end[0] - 1] + t.end[1], kind in ("comment", "identifier", "number", "string")))

    def convert(item: ast.AST, name: str) -> list[Node]:
        below = []
        for f in item._fields:
            v = getattr(item, f, None)
            for x in v if isinstance(v, list) else (v,):
                if isinstance(x, ast.AST) and not isinstance(x, ast.expr_context):
                    below += convert(x, f)
        if not hasattr(item, "lineno"):
            for n in below:
                n.field = n.field if not isinstance(item, ast.Module) else name or n.field
            return below
        start, stop = place(item.lineno, item.col_offset), place(item.end_lineno, item.end_col_offset)
        if isinstance(item, ast.JoinedStr) or getattr(ast, "TemplateStr", ()) and isinstance(item, ast.TemplateStr):
            below = []
        if below:
            start, stop = min(start, *(n.start for n in below)), max(stop, *(n.stop for n in below))
        if getattr(item, "decorator_list", None):  # they stand before, and so does their sign
            start = source.rfind("@", 0, start)
        below.sort(key=lambda n: (n.start, n.stop))
        return [Node(type(item).__name__, start, stop, True, name, below)]

    root = Node("Module", 0, len(source), True, "", convert(ast.parse(source), ""))
    cursor = 0

    def fill(node: Node) -> None:
        """Tokens of a node's span that none of its children covers become leaves of it."""
        nonlocal cursor
        out = []
        for child in [*node.children, None]:
            until = child.start if child else node.stop
            while cursor < len(tokens) and tokens[cursor][1] < until:
                kind, a, b, named = tokens[cursor]
                out.append(Node(kind, a, b, named, text=source[a:b]))
                cursor += 1
            if child:
                fill(child)
                out.append(child)
        if len(out) == 1 and not out[0].children and (out[0].start, out[0].stop) == (node.start, node.stop) and node.kind in ("Name", "Constant", "JoinedStr", "TemplateStr", "arg", "alias", "Pass", "Break", "Continue"):
            node.text, out = out[0].text, []
        node.children = out
        for k, child in enumerate(out):
            child.parent, child.sib = node, k

    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 20_000))
    try:
        fill(root)
    finally:
        sys.setrecursionlimit(limit)
    for node in root.walk():
        node.text = node.text or source[node.start : node.stop]
    return root


# --- parts of sources ----------------------------------------------------------------------------

#: What a source is not cut at: strings and statements over several lines, and other ends of lines than the usual one.
_WHOLE = re.compile("\"\"\"|\'\'\'|\\\\\n|[\x00\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]")
#: What stands at the margin and goes on with a statement.
_GOES_ON = re.compile(r"(?:elif|else|except|finally)\b")
#: Nodes of the parts that a worker keeps (some 300 bytes each with what is found in them), and of a part worth keeping.
KEPT, LARGEST = 400_000, 2_000


class Part:
    """Statements of a source's margin as a tree; offsets, lines and numbers count from where it begins.

    numbered: its nodes in order, with the root only if the part is a whole source; lasts: the number of each one's last
    descendant; kept: what was found in it, by what was looked for."""

    def __init__(self, text: str, whole: bool):
        self.text, self.whole, self.root, self.kept = text, whole, parse(text), {}
        every = list(self.root.walk())
        number = {id(n): k for k, n in enumerate(every)}
        lasts = list(range(len(every)))
        for k in range(len(every) - 1, 0, -1):
            up = number[id(every[k].parent)]
            lasts[up] = max(lasts[up], lasts[k])
        self.numbered, self.lasts = (every, lasts) if whole else (every[1:], [x - 1 for x in lasts[1:]])
        self.size, self.lines = len(self.numbered), text.count("\n")

    def line(self, node: Node) -> int:
        return self.text.count("\n", 0, node.start)


_PARTS: dict[str, Part] = {}
_SIZE = 0


def parts(source: str, whole: bool = False) -> list[tuple[Part, int, int, int, int]]:
    """(part, start, line, pre, place) for the parts of a source: the offset, line and number where it begins and how many
    nodes stand at the margin before it. SyntaxError if it is no Python.

    Statements at the margin are parsed one by one and kept, as sources repeat them. Parts that parse alone are
    the same statements together: brackets, strings and blocks are closed at each end. If one does not, or the
    source has what is not cut at, the whole source is the only part."""
    global _SIZE
    if not whole:
        out, at, line, pre, place, plain = [], 0, 0, 1, 0, False
        try:
            for text in _cut(source):
                part = _PARTS.get(text)
                if part is None:
                    # None of it lies across a cut, so a source of kept parts needs no look.
                    if not plain and _WHOLE.search(source):
                        break
                    part, plain = Part(text, False), True
                    if part.size <= LARGEST:
                        if _SIZE > KEPT:
                            _PARTS.clear()
                            _SIZE = 0
                        _PARTS[text] = part
                        _SIZE += part.size
                out.append((part, at, line, pre, place))
                at += len(text)
                line += part.lines
                pre += part.size
                place += len(part.root.children)
            else:
                return out
        except (SyntaxError, tokenize.TokenError, ValueError, RecursionError):
            pass  # the whole source decides
    return [(Part(source, True), 0, 0, 0, 0)]


def _cut(source: str) -> list[str]:
    """The source cut where a statement begins at the margin, its decorators first."""
    lines, begins, decorated = source.split("\n"), [], False
    for k, line in enumerate(lines):
        first = line[:1]
        if not first or first in "#)]}" or first.isspace() or (first in "ef" and _GOES_ON.match(line)):
            decorated = False
            continue
        if not decorated:
            begins.append(k)
        decorated = first == "@"
    ends = begins[1:]
    return [*(lines[a] + "\n" if b == a + 1 else "\n".join(lines[a:b]) + "\n" for a, b in zip([0, *ends], ends)), "\n".join(lines[ends[-1] if ends else 0 :])]


# --- patterns ------------------------------------------------------------------------------------


def variable(text: str) -> tuple[str, str, bool] | None:
    """(one | many, name or empty, named) of a metavariable: $A, $_A, $$A, $$$, $$$A, $$$_A; else None."""
    m = re.fullmatch(r"(\$\$\$|\$\$|\$)([A-Z0-9_]*)", text)
    if not m or (m[1] != "$$$" and not re.match("[A-Z_]", m[2])):
        return None
    return ("many" if m[1] == "$$$" else "one", "" if m[2].startswith("_") else m[2], m[1] != "$$")


@dataclass(frozen=True)
class Strictness:
    """What a pattern may overlook. bare: tokens count on neither side; pass_tokens, pass_comments: those of the
    source may stand where the pattern has none; kinds, texts: these are compared; rest: what may follow
    the last node asked for."""

    bare: bool = False
    pass_tokens: bool = True
    pass_comments: bool = True
    kinds: bool = True
    texts: bool = True
    rest: str = "all"


LEVELS = {
    "cst": Strictness(pass_tokens=False, pass_comments=False, rest="none"),
    "smart": Strictness(),
    "ast": Strictness(bare=True, pass_comments=False, rest="none"),
    "relaxed": Strictness(bare=True, rest="comments"),
    "signature": Strictness(bare=True, texts=False, rest="comments"),
    "template": Strictness(kinds=False, rest="comments"),
}


class Pattern:
    """A code pattern, its strictness and, for a contextual one, the kind of the node that it takes."""

    def __init__(self, text: str, strictness: str = "smart", selector: str | None = None):
        if strictness not in LEVELS:
            raise ValueError(f"unknown strictness {strictness}")
        self.level, self.loose_root = LEVELS[strictness], strictness == "smart"
        try:
            root = parse(text.replace("$", _DOLLAR))
        except (SyntaxError, tokenize.TokenError) as e:
            raise ValueError(f"not a pattern: {text!r}") from e
        if selector:
            found = [n for n in root.walk() if n.kind == selector]
            if not found:
                raise ValueError(f"no {selector} in {text!r}")
            self.root = found[0]
        else:
            if len([c for c in root.children if c.named and not c.extra]) != 1:
                raise ValueError(f"a pattern is one node: {text!r}")
            self.root = _inner(root.children[0])
        #: The kind of all nodes that can match, None if there is no such kind.
        self.kind = None if _variable(self.root) or not self.level.kinds else self.root.kind
        self.variables = {v[1] for n in self.root.walk() if (v := _variable(n)) and v[1]}

    def match(self, node: Node) -> dict | None:
        """Captures of a node that matches (name -> node, or list of nodes), None if it does not."""
        if node.extra and self.level.pass_comments and not (self.loose_root and _variable(self.root)):
            return None
        return next(self._node(self.root, node, {}), None)

    def _node(self, goal: Node, node: Node, env: dict) -> Iterator[dict]:
        """The ways in which a node meets a goal, as captures."""
        found = _variable(goal)
        if found:
            many, name, named = found[0] == "many", found[1], found[2]
            if (node.named or not (named or many)) and (name not in env or same(env[name], node)):
                yield {**env, name: node} if name else env
        elif not goal.children:
            kind = not self.level.kinds or goal.kind == node.kind
            if kind and (not goal.named or not self.level.texts or goal.text == node.text) and (goal.named or self.level.kinds or goal.text == node.text):
                yield env
        elif node.children and (not self.level.kinds or goal.kind == node.kind):
            yield from self._list(self._seen(goal.children), self._seen(node.children), env)

    def _seen(self, nodes: list[Node]) -> list[Node]:
        return [n for n in nodes if n.named or n.children or _variable(n)] if self.level.bare else nodes

    def _passes(self, node: Node) -> bool:
        return self.level.pass_comments if node.extra else self.level.pass_tokens and not node.named

    def _list(self, goals: list[Node], nodes: list[Node], env: dict) -> Iterator[dict]:
        """Goals in order against children in order. Only a variable for many nodes has a choice."""
        if not goals:
            if all(self.level.rest == "all" or (self.level.rest == "comments" and n.extra) for n in nodes):
                yield env
            return
        found = _variable(goals[0])
        if found and found[0] == "many":
            yield from self._several(found[1], goals[1:], nodes, env)
            return
        for at, node in enumerate(nodes):
            ways = list(self._node(goals[0], node, env)) if not (node.extra and self.level.pass_comments) else []
            if ways:
                for way in ways:
                    yield from self._list(goals[1:], nodes[at + 1 :], way)
                return
            if not self._passes(node):
                return

    def _several(self, name: str, goals: list[Node], nodes: list[Node], env: dict) -> Iterator[dict]:
        if not goals:
            taken = [x for x in nodes if x.named]
            if not (name and name in env) or (len(env[name]) == len(taken) and all(map(same, env[name], taken))):
                yield {**env, name: taken} if name else env
            return
        tokens = 0  # separators behind an empty list are not asked for
        while tokens < len(goals) and not goals[tokens].named and not goals[tokens].children and not _variable(goals[tokens]) and tokens + 1 < len(goals):
            tokens += 1
        for n in range(len(nodes) + 1):
            taken = [x for x in nodes[:n] if x.named]
            if name and name in env and not (len(env[name]) == len(taken) and all(map(same, env[name], taken))):
                continue
            bound = {**env, name: taken} if name else env
            if n == 0 and tokens and goals[0].text == ",":
                yield from self._list(goals[tokens:], nodes, bound)
            yield from self._list(goals, nodes[n:], bound)


def _variable(node: Node):
    """The metavariable that a node of a pattern is; a statement of nothing else counts too."""
    return variable(node.text.strip().replace(_DOLLAR, "$")) if _DOLLAR in node.text and len(node.text) < 80 else None


def _inner(node: Node) -> Node:
    while len(node.children) == 1 and (node.children[0].start, node.children[0].stop) == (node.start, node.stop):
        node = node.children[0]
    return node


def same(a: Node, b: Node) -> bool:
    """Whether two nodes are equal in kinds and leaves; comments and layout do not count."""
    if not a.children and not b.children:
        return a.kind == b.kind and a.text == b.text
    x, y = ([c for c in n.children if not c.extra] for n in (a, b))
    return a.kind == b.kind and len(x) == len(y) and all(map(same, x, y))


# --- tables --------------------------------------------------------------------------------------

SCHEMA = "doc string, pre int, parent int, last int, depth int, sib int, kind string, text string, named boolean, field string, start int, stop int, line int, column int, end_line int, end_column int"


def _positions(source: str):
    import bisect

    breaks = [-1, *(k for k, c in enumerate(source) if c == "\n")]

    def at(offset: int) -> tuple[int, int]:
        line = bisect.bisect_left(breaks, offset) - 1
        return line, offset - breaks[line] - 1

    return at


def rows(root: Node, source: str) -> list[tuple]:
    """Nodes in order with pre rank, parent, last descendant, depth and place among siblings."""
    out, at = [], _positions(source)
    stack = [(root, -1, 0, 0)]
    numbers: dict[int, int] = {}
    while stack:
        node, parent, depth, sib = stack.pop()
        pre = len(out)
        numbers[id(node)] = pre
        out.append([pre, parent, pre, depth, sib, node.kind, node.text, node.named, node.field, node.start, node.stop, *at(node.start), *at(node.stop)])
        stack.extend((c, pre, depth + 1, k) for k, c in reversed(list(enumerate(node.children))))
    for r in reversed(out):
        if r[1] >= 0:
            out[r[1]][2] = max(out[r[1]][2], r[2])
    return out


def _joined(source: str) -> list[list]:
    """rows() of a source from those of its parts."""
    split = parts(source)
    if split[0][0].whole:
        return rows(split[0][0].root, source)
    below = []
    for part, start, line, pre, place in split:
        if "rows" not in part.kept:
            part.kept["rows"] = rows(part.root, part.text)[1:]
        for r in part.kept["rows"]:
            top = r[1] == 0
            below.append([r[0] + pre - 1, 0 if top else r[1] + pre - 1, r[2] + pre - 1, r[3], r[4] + place if top else r[4], *r[5:9], r[9] + start, r[10] + start, r[11] + line, r[12], r[13] + line, r[14]])
    at = _positions(source)
    return [[0, -1, len(below), 0, 0, "Module", source, True, "", 0, len(source), *at(0), *at(len(source))], *below]


class _Nodes:
    def __call__(self, batches):
        kinds = [pa.int32()] * 5 + [pa.string(), pa.string(), pa.bool_(), pa.string()] + [pa.int32()] * 6
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for doc, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found = _joined(source or "")
                except (SyntaxError, tokenize.TokenError, ValueError, RecursionError):
                    continue
                for lo in range(0, len(found), 8192):
                    part = found[lo : lo + 8192]
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(part), pa.string()), *(pa.array([r[k] for r in part], t) for k, t in enumerate(kinds))], names)


def nodes(sources: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """A row for each node of every source that parses. Write it once and query that table: the relations
    of trees and selectors join it with itself. Inner nodes have their whole text too."""
    ship(sources.sparkSession)
    return sources.select(F.col(key).cast("string"), text).mapInArrow(_Nodes(), SCHEMA)


class _Failed:
    def __call__(self, batches):
        for batch in batches:
            out = []
            for doc, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    parse(source or "")
                except (SyntaxError, tokenize.TokenError, ValueError, RecursionError) as e:
                    out.append((doc, type(e).__name__))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in (0, 1)], ["doc", "reason"])


def failures(sources: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(doc, reason) of sources that do not parse: rows of a coverage table, not errors."""
    ship(sources.sparkSession)
    return sources.select(F.col(key).cast("string"), text).mapInArrow(_Failed(), "doc string, reason string")


MATCHES = "doc string, rule string, pre int, last int, start int, stop int, line int, text string, captures map<string,struct<text:string,start:int,stop:int,indent:int>>"


_CAPTURE = pa.struct([("text", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("indent", pa.int32())])


def _capture(found: Node | list[Node], source: str) -> dict:
    """A capture's text, from the first to the last of its nodes, and the indent of the line where it begins."""
    nodes = [found] if isinstance(found, Node) else found
    if not nodes:
        return {"text": "", "start": None, "stop": None, "indent": 0}
    start, stop = nodes[0].start, nodes[-1].stop
    line = source[source.rfind("\n", 0, start) + 1 : start]
    return {"text": source[start:stop], "start": start, "stop": stop, "indent": len(line) - len(line.lstrip())}


def _captures(rows: list[list[tuple[str, dict, int]]]) -> pa.Array:
    """Maps of captures; each comes with the offset that its part begins at."""
    flat = [c for r in rows for c in r]
    at = [0]
    for r in rows:
        at.append(at[-1] + len(r))
    fields = [pa.array([c[1]["text"] for c in flat], pa.string()), *(pa.array([None if c[1][k] is None else c[1][k] + c[2] for c in flat], pa.int32()) for k in ("start", "stop")), pa.array([c[1]["indent"] for c in flat], pa.int32())]
    return pa.MapArray.from_arrays(pa.array(at, pa.int32()), pa.array([c[0] for c in flat], pa.string()), pa.StructArray.from_arrays(fields, fields=list(_CAPTURE)))


_FOUND = {"rule": pa.string(), "pre": pa.int32(), "last": pa.int32(), "start": pa.int32(), "stop": pa.int32(), "line": pa.int32(), "text": pa.string(), "captures": pa.map_(pa.string(), _CAPTURE)}


def found_columns(rows: list[tuple], names: Iterable[str]) -> list[pa.Array]:
    """Arrays of hits (rule, pre, last, start, stop, line, text, captures)."""
    place = list(_FOUND)
    return [_captures([r[7] for r in rows]) if n == "captures" else pa.array([r[place.index(n)] for r in rows], _FOUND[n]) for n in names]


def placed(hits: list[tuple], start: int, line: int, pre: int) -> list[tuple]:
    """Hits of a part as hits of the source."""
    return [(h[0], h[1] + pre, h[2] + pre, h[3] + start, h[4] + start, h[5] + line, h[6], [(x, c, start) for x, c in h[7]]) for h in hits]


class _Match:
    """Hits of patterns: a row each, or, with listed, an array behind the columns of the source."""

    def __init__(self, patterns: dict[str, tuple], columns: list[str], listed: tuple[int, str] | None = None):
        self.patterns, self.columns, self.listed = patterns, columns, listed

    def hits(self, part: Part, patterns: dict[str, Pattern]) -> list[tuple]:
        out = []
        for k, node in enumerate(part.numbered):
            for name, p in patterns.items():
                if p.kind is not None and p.kind != node.kind:
                    continue
                env = p.match(node)
                if env is not None:
                    out.append((name, k, part.lasts[k], node.start, node.stop, part.line(node), node.text, [(x, _capture(v, part.text)) for x, v in env.items()]))
        return out

    def __call__(self, batches):
        patterns = {name: Pattern(*p) for name, p in self.patterns.items()}
        whole = any(p.kind in (None, "Module") for p in patterns.values())
        key = ("match", *((n, *p) for n, p in self.patterns.items()))

        def of(source: str) -> list[tuple]:
            out = []
            try:
                for part, start, line, pre, _ in parts(source, whole):
                    hits = part.kept.get(key)
                    if hits is None:
                        hits = part.kept[key] = self.hits(part, patterns)
                    if hits:
                        out += placed(hits, start, line, pre)
            except (SyntaxError, tokenize.TokenError, ValueError, RecursionError):
                return []
            return out

        for batch in batches:
            if self.listed:
                place, name = self.listed
                lists = [of(source or "") for source in batch.column(place).to_pylist()]
                at = [0]
                for x in lists:
                    at.append(at[-1] + len(x))
                items = pa.StructArray.from_arrays(found_columns([h for x in lists for h in x], self.columns), names=self.columns)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(at, pa.int32()), items)], [*batch.schema.names, name])
                continue
            docs, out = [], []
            for doc, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hits = of(source or "")
                docs += [doc] * len(hits)
                out += hits
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), *found_columns(out, self.columns)], ["doc", *self.columns])


class _Count:
    """How many nodes of a source each pattern matches; the counts of a part are kept."""

    def __init__(self, patterns: dict[str, tuple]):
        self.patterns = patterns

    def __call__(self, batches):
        patterns = {name: Pattern(*p) for name, p in self.patterns.items()}
        whole = any(p.kind in (None, "Module") for p in patterns.values())
        key, match = ("count", *((n, *p) for n, p in self.patterns.items())), _Match(self.patterns, [])

        def of(part: Part) -> list[int]:
            names = [h[0] for h in match.hits(part, patterns)]
            part.kept[key] = [names.count(n) for n in patterns]
            return part.kept[key]

        for batch in batches:
            out = []
            for source in batch.column(1).to_pylist():
                try:
                    out.append([sum(x) for x in zip(*[p[0].kept.get(key) or of(p[0]) for p in parts(source or "", whole)])])
                except (SyntaxError, tokenize.TokenError, ValueError, RecursionError):
                    out.append([0] * len(patterns))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], pa.int64()) for k in range(len(patterns)))], ["doc", *patterns])


def counted(sources: DataFrame, patterns: dict[str, str | dict], key: str = "path", text: str = "text") -> DataFrame:
    """A row for each source: doc and, by the name of each pattern, how many nodes it matches; 0 where a source does not parse."""
    ship(sources.sparkSession)
    plain = _plain(patterns)
    return sources.select(F.col(key).cast("string").alias("doc"), text).mapInArrow(_Count(plain), ", ".join(["doc string", *(f"`{n}` long" for n in plain)]))


def _plain(patterns: dict[str, str | dict]) -> dict[str, tuple]:
    plain = {}
    for name, p in patterns.items():
        p = {"pattern": p} if isinstance(p, str) else p
        plain[name] = (p["pattern"], p.get("strictness", "smart"), p.get("selector"))
        Pattern(*plain[name])
    return plain


def schema_of(columns: list[str]) -> str:
    """The types of those columns of MATCHES, as they are written in a schema."""
    kinds = dict(c.split(" ", 1) for c in re.split(r", (?=\w+ )", MATCHES))
    return ", ".join(f"{c} {kinds[c]}" for c in columns)


def matches(sources: DataFrame, patterns: dict[str, str | dict], key: str = "path", text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """A row for each node that a pattern matches, with its captures; all patterns in one pass over a source.

    patterns: name -> text, or {pattern, strictness, selector}. They are compiled here first, so that one that
    cannot be read is an error before any job. pre and last are those of nodes(). columns: those wanted besides doc."""
    ship(sources.sparkSession)
    columns = list(_FOUND) if columns is None else columns
    return sources.select(F.col(key).cast("string"), text).mapInArrow(_Match(_plain(patterns), columns), schema_of(["doc", *columns]))


def matched(sources: DataFrame, patterns: dict[str, str | dict], text: str = "text", into: str = "found", columns: list[str] | None = None) -> DataFrame:
    """Sources with their matches in an array column, in order of place: for work on a source and its matches without a join."""
    from pyspark.sql.types import ArrayType, StructType

    ship(sources.sparkSession)
    columns = list(_FOUND) if columns is None else columns
    schema = StructType(list(sources.schema.fields)).add(into, ArrayType(StructType.fromDDL(schema_of(columns))))
    return sources.mapInArrow(_Match(_plain(patterns), columns, (sources.columns.index(text), into)), schema)


# --- outlines ------------------------------------------------------------------------------------

# Kinds of nodes that define a symbol.
DEFINITIONS = ("FunctionDef", "AsyncFunctionDef", "ClassDef")


def outline(tree: DataFrame) -> DataFrame:
    """Functions and classes: doc, pre, last, kind, name, line, end_line, container (dotted names around it)."""
    own = tree.where(F.col("kind").isin(*DEFINITIONS))
    first = tree.where("kind = 'identifier'").groupBy("doc", F.col("parent").alias("pre")).agg(F.min_by("text", "sib").alias("name"))
    named = own.join(first, ["doc", "pre"]).select("doc", "pre", "last", "kind", "name", "line", "end_line", "start", "stop")
    o = named.select("doc", F.col("pre").alias("o_pre"), F.col("last").alias("o_last"), F.col("name").alias("o_name"))
    around = named.join(o, "doc").where((F.col("o_pre") < F.col("pre")) & (F.col("pre") <= F.col("o_last"))).groupBy("doc", "pre").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_pre", "o_name"))), lambda x: x["o_name"]), ".").alias("container"))
    return named.join(around, ["doc", "pre"], "left").withColumn("container", F.coalesce("container", F.lit("")))


def enclosing(symbols: DataFrame, places: DataFrame) -> DataFrame:
    """places(doc, line) -> the smallest symbol around each, null where there is none."""
    s = symbols.select("doc", F.col("line").alias("s_line"), "end_line", "name", "container", "kind")
    found = places.join(s, "doc").where((F.col("line") >= F.col("s_line")) & (F.col("line") <= F.col("end_line")))
    best = found.groupBy("doc", "line").agg(F.min_by(F.struct("name", "container", "kind"), F.struct(F.col("end_line") - F.col("s_line"), -F.col("s_line"))).alias("symbol"))
    return places.join(best, ["doc", "line"], "left")


def imports(tree: DataFrame) -> DataFrame:
    """(doc, line, module, name, alias) of every import; name is null for a whole module."""
    text = F.regexp_replace("text", r"\s+", " ")
    own = tree.where(F.col("kind").isin("Import", "ImportFrom")).select("doc", "pre", "kind", "line", text.alias("statement"))
    names = tree.where("kind = 'alias'").select("doc", F.col("parent").alias("pre"), F.regexp_replace("text", r"\s+", " ").alias("item"))
    item, alias = F.regexp_extract("item", r"^\S+", 0), F.regexp_extract("item", r" as (\S+)$", 1)
    whole = F.col("kind") == "Import"
    module = F.when(whole, item).otherwise(F.regexp_replace(F.regexp_extract("statement", r"^from (.*?) ?import ", 1), " ", ""))
    last = F.when(whole, F.substring_index(item, ".", 1)).otherwise(item)
    return own.join(names, ["doc", "pre"]).select("doc", "line", module.alias("module"), F.when(~whole, item).alias("name"), F.when(alias != "", alias).otherwise(last).alias("alias"))


def calls(tree: DataFrame) -> DataFrame:
    """(doc, pre, line, callee, arguments): call sites with the texts of their positional arguments and keywords."""
    own = tree.where("kind = 'Call'").select("doc", "pre", "line")
    below = tree.select("doc", F.col("parent").alias("pre"), "sib", F.col("field").alias("f"), F.regexp_replace("text", r"\s+", " ").alias("t")).where("f in ('func', 'args', 'keywords')")
    parts = below.groupBy("doc", "pre").agg(F.max(F.when(F.col("f") == "func", F.col("t"))).alias("callee"), F.transform(F.sort_array(F.collect_list(F.when(F.col("f") != "func", F.struct("sib", "t")))), lambda x: x["t"]).alias("arguments"))
    return own.join(parts, ["doc", "pre"])


def resolved(sites: DataFrame, imported: DataFrame) -> DataFrame:
    """Call sites with the canonical name of the callee: its first part through the file's imports, the last
    import of a name deciding; else as written."""
    last = imported.groupBy("doc", F.col("alias").alias("head")).agg(F.max_by(F.struct("module", "name"), "line").alias("from"))
    cut = sites.withColumn("head", F.substring_index("callee", ".", 1))
    rest = F.substring(F.col("callee"), F.length("head") + 1, F.length("callee"))
    base = F.when(F.col("from.name").isNull(), F.when(F.col("from.module").startswith(F.concat(F.col("head"), F.lit("."))), F.col("head")).otherwise(F.col("from.module"))).otherwise(F.concat_ws(".", "from.module", "from.name"))
    joined = cut.join(last, ["doc", "head"], "left")
    return joined.withColumn("canonical", F.when(F.col("from").isNull(), F.col("callee")).otherwise(F.concat(base, rest))).withColumn("method", F.when(F.col("from").isNull(), "as_written").otherwise("import")).drop("head", "from")


_BLANKS = re.compile("[ \t\n\x0b\f\r]+")


def add_heads(heads: dict[str, tuple], imported: list[tuple], line: int) -> None:
    """Adds the imports of a part that begins at a line: name -> (line, module, imported name), the last one deciding."""
    for at, alias, module, name in imported:
        if alias not in heads or heads[alias][0] <= at + line:
            heads[alias] = (at + line, module, name)


def canonical(callee: str, heads: dict[str, tuple]) -> tuple[str, str]:
    """(canonical, method) of a callee, as in resolved()."""
    head = callee.split(".", 1)[0]
    if head not in heads:
        return callee, "as_written"
    _, module, name = heads[head]
    base = f"{module}.{name}" if name is not None else head if module.startswith(head + ".") else module
    return base + callee[len(head) :], "import"


class _Sites:
    """resolved(calls, imports) of a source, its parts' calls and imports kept."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def found(self, part: Part) -> tuple[list, list]:
        called, imported = [], []
        for k, node in enumerate(part.numbered):
            if node.kind == "Call":
                below = [(c.field, _BLANKS.sub(" ", c.text)) for c in node.children if c.field in ("func", "args", "keywords")]
                called.append((k, part.line(node), max(t for f, t in below if f == "func"), [t for f, t in below if f != "func"]))
            elif node.kind == "alias" and node.parent.kind in ("Import", "ImportFrom"):
                item, whole = _BLANKS.sub(" ", node.text), node.parent.kind == "Import"
                name, other = re.match(r"\S*", item)[0], re.search(r" as (\S+)$", item)
                origin = re.match(r"from (.*?) ?import ", _BLANKS.sub(" ", node.parent.text))
                module = name if whole else origin[1].replace(" ", "") if origin else ""
                imported.append((part.line(node.parent), other[1] if other else name.split(".")[0] if whole else name, module, None if whole else name))
        return called, imported

    def of(self, source: str) -> list[tuple]:
        called, heads = [], {}
        for part, _, line, pre, _ in parts(source):
            if "sites" not in part.kept:
                part.kept["sites"] = self.found(part)
            own, imported = part.kept["sites"]
            add_heads(heads, imported, line)
            called += [(pre + k, at + line, callee, arguments) for k, at, callee, arguments in own]
        return [(*c, *canonical(c[2], heads)) for c in called]

    def __call__(self, batches):
        kinds = {"pre": pa.int32(), "line": pa.int32(), "callee": pa.string(), "arguments": pa.list_(pa.string()), "canonical": pa.string(), "method": pa.string()}
        place = list(kinds)
        for batch in batches:
            docs, out = [], []
            for doc, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found = self.of(source or "")
                except (SyntaxError, tokenize.TokenError, ValueError, RecursionError):
                    continue
                docs += [doc] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), *(pa.array([r[place.index(c)] for r in out], kinds[c]) for c in self.columns)], ["doc", *self.columns])


SITES = {"pre": "int", "line": "int", "callee": "string", "arguments": "array<string>", "canonical": "string", "method": "string"}


def sites(sources: DataFrame, key: str = "path", text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """resolved(calls(nodes), imports(nodes)) in the pass that parses the sources, without a node table. Of imports of a
    name in one line the last decides. columns: those wanted besides doc."""
    ship(sources.sparkSession)
    columns = list(SITES) if columns is None else columns
    return sources.select(F.col(key).cast("string"), text).mapInArrow(_Sites(columns), ", ".join(["doc string", *(f"{c} {SITES[c]}" for c in columns)]))
