"""Tree operators over parsed documents, as joins on pre/post ranks.

nodes: doc, id, parent, pre, post, depth, sib, kind, attrs, text. An ancestor holds the pre ranks of its
descendants between its own pre and last, so relations are range joins within one document."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from scanlattice.functions.shipping import ship
from scanlattice.functions.tables import written

# Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Nodes that go to Spark at once.
BATCH = 8192
SCHEMA = "doc long, pre int, parent int, last int, depth int, sib int, kind string, text string"


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.open, self.children = [], [], {-1: 0}

    def _add(self, kind, text=""):
        parent = self.open[-1] if self.open else -1
        sib = self.children.get(parent, 0)
        self.children[parent] = sib + 1
        self.rows.append([len(self.rows), parent, len(self.rows), len(self.open), sib, kind, text])
        return len(self.rows) - 1

    def handle_starttag(self, tag, attrs):
        at = self._add(tag, " ".join(f"{k}={v}" for k, v in attrs))
        if tag not in VOID:
            self.open.append(at)

    def handle_startendtag(self, tag, attrs):
        self._add(tag, " ".join(f"{k}={v}" for k, v in attrs))

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[depth]][5] == tag:
                for at in self.open[depth:]:
                    self.rows[at][2] = len(self.rows) - 1
                del self.open[depth:]
                return

    def handle_comment(self, data):
        self._add("#comment", data)

    def handle_data(self, data):
        if data.strip():
            self._add("#text", data)

    def done(self):
        self.close()
        for at in self.open:
            self.rows[at][2] = len(self.rows) - 1
        return self.rows


class _Parse:
    def __call__(self, batches):
        out = []
        for batch in batches:
            for doc, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                builder = _Builder()
                builder.feed(page or "")
                rows = builder.done()
                out += [(doc, *r) for r in rows]
                if len(out) >= BATCH:
                    yield self._batch(out)
                    out = []
            if out:
                yield self._batch(out)
                out = []

    @staticmethod
    def _batch(rows):
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc", "pre", "parent", "last", "depth", "sib", "kind", "text"])


def parse_html(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """The nodes of every page. The relations join this table with itself, so it is written once and pages are
    parsed once; Spark then sizes its joins by the nodes themselves."""
    ship(pages.sparkSession)
    return written(pages.select(F.col(key).cast("long"), page).mapInArrow(_Parse(), SCHEMA), "nodes")


def kind(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.col("kind") == name)


def _other(nodes: DataFrame) -> DataFrame:
    return nodes.select(*[F.col(c).alias(f"o_{c}") for c in ("doc", "pre", "parent", "last", "sib")])


_RELATIONS = {
    "inside": lambda: (F.col("o_pre") < F.col("pre")) & (F.col("pre") <= F.col("o_last")),
    "parent": lambda: F.col("o_pre") == F.col("parent"),
    "has": lambda: (F.col("pre") < F.col("o_pre")) & (F.col("o_pre") <= F.col("last")),
    "child": lambda: F.col("o_parent") == F.col("pre"),
    "follows": lambda: (F.col("o_parent") == F.col("parent")) & (F.col("o_sib") < F.col("sib")),
    "precedes": lambda: (F.col("o_parent") == F.col("parent")) & (F.col("o_sib") > F.col("sib")),
    "next_to": lambda: (F.col("o_parent") == F.col("parent")) & (F.col("o_sib") == F.col("sib") - 1),
}


def related(nodes: DataFrame, relation: str, others: DataFrame, negate: bool = False) -> DataFrame:
    """Nodes that stand in a relation to one of the others (or to none)."""
    o = _other(others)
    return nodes.join(o, (nodes.doc == o.o_doc) & _RELATIONS[relation](), "left_anti" if negate else "left_semi")


def nth_child(nodes: DataFrame, step: int, offset: int, reverse: bool = False, of: Column | None = None) -> DataFrame:
    """Nodes at An+B among their siblings (elements, or those that `of` holds for), from either end."""
    order = F.col("sib").desc() if reverse else F.col("sib")
    named = nodes.where(~F.col("kind").startswith("#") if of is None else of)
    placed = named.withColumn("n", F.row_number().over(Window.partitionBy("doc", "parent").orderBy(order)))
    hit = F.col("n") == offset if step == 0 else ((F.col("n") - offset) % step == 0) & ((F.col("n") - offset) / step >= 0)
    return placed.where(hit).drop("n")
