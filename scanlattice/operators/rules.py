"""Rules over node tables: atomic, relational and composite ones, utilities, captures, transforms and fixes.

A rule is a mapping as a rule file has it (kind, regex, pattern, nthChild, range, inside, has, precedes,
follows, all, any, not, matches); it becomes joins of the node table with itself. Patterns are matched once for all rules,
in the pass that parses the sources; here they are a table too."""

from __future__ import annotations

import contextlib
import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from scanlattice.functions import text as T

from . import code, selectors

KEY = ["doc", "pre"]
ATOMIC = ("kind", "regex", "pattern", "nthChild", "range")
RELATIONAL = ("inside", "has", "precedes", "follows")
COMPOSITE = ("all", "any", "not", "matches", "where")


def load(text: str) -> list[dict]:
    """Rules of a file: a JSON list or object, or YAML documents where a YAML reader is installed."""
    try:
        found = json.loads(text)
        return found if isinstance(found, list) else [found]
    except json.JSONDecodeError:
        import yaml  # optional

        return [d for d in yaml.safe_load_all(text) if d]


def patterns_of(spec) -> dict[str, dict]:
    """All patterns in a rule, wherever they stand, by a name of their own."""
    out: dict[str, dict] = {}
    if isinstance(spec, dict):
        for k, v in spec.items():
            if k == "pattern":
                p = {"pattern": v} if isinstance(v, str) else {"pattern": v["context"], "selector": v.get("selector"), "strictness": v.get("strictness", "smart")}
                out[json.dumps(p, sort_keys=True)] = p
            else:
                out |= patterns_of(v)
    elif isinstance(spec, list):
        for v in spec:
            out |= patterns_of(v)
    return out


def _pattern_name(v) -> str:
    return next(iter(patterns_of({"pattern": v})))


class Utilities:
    """Named rules. A name may have parameters: a mapping {rule, arguments} whose `$NAME` strings are
    filled in by `matches: {name: ..., NAME: value}`. Unknown names and cycles are errors before any job."""

    def __init__(self, rules: dict[str, dict] | None = None):
        self.rules = rules or {}
        state: dict[str, int] = {}

        def visit(name: str) -> None:
            if name not in self.rules:
                raise ValueError(f"unknown utility {name}")
            if state.get(name) == 1:
                raise ValueError(f"utility {name} refers to itself")
            if name not in state:
                state[name] = 1
                for other in self._references(self.rules[name]):
                    visit(other)
                state[name] = 2

        for name in self.rules:
            visit(name)

    @staticmethod
    def _references(spec) -> list[str]:
        if isinstance(spec, list):
            return [n for v in spec for n in Utilities._references(v)]
        if not isinstance(spec, dict):
            return []
        own = [spec["matches"] if isinstance(spec["matches"], str) else spec["matches"]["name"]] if "matches" in spec else []
        return own + [n for k, v in spec.items() if k != "matches" for n in Utilities._references(v)]

    def body(self, call) -> dict:
        name, given = (call, {}) if isinstance(call, str) else (call["name"], {k: v for k, v in call.items() if k != "name"})
        if name not in self.rules:
            raise ValueError(f"unknown utility {name}")
        spec = self.rules[name]
        if "arguments" not in spec:
            return spec
        if set(given) != set(spec["arguments"]):
            raise ValueError(f"utility {name} takes {spec['arguments']}")

        def filled(x):
            if isinstance(x, dict):
                return {k: filled(v) for k, v in x.items()}
            if isinstance(x, list):
                return [filled(v) for v in x]
            return given.get(x[1:], x) if isinstance(x, str) and x.startswith("$") else x

        return filled(spec["rule"])


class Engine:
    """Evaluates rules over one node table. found: the matches of patterns_of(...) of all rules, or None."""

    def __init__(self, tree: DataFrame, found: DataFrame | None = None, utilities: dict[str, dict] | None = None):
        self.tree, self.found, self.utilities = tree, found, Utilities(utilities)

    def nodes(self, spec: dict, local: dict[str, dict] | None = None) -> DataFrame:
        """Nodes that meet every key of a rule."""
        utilities = Utilities({**self.utilities.rules, **local}) if local else self.utilities
        return self._rule(spec, utilities)

    def _rule(self, spec: dict, u: Utilities) -> DataFrame:
        unknown = set(spec) - {*ATOMIC, *RELATIONAL, *COMPOSITE, "stopBy", "field"}
        if unknown or not set(spec) & {*ATOMIC, *RELATIONAL, *COMPOSITE}:
            raise ValueError(f"not a rule: {sorted(unknown) or spec}")
        out = self.tree
        if "kind" in spec:
            out = out.where(F.col("kind") == spec["kind"])
        if "regex" in spec:
            out = out.where(F.col("text").rlike(spec["regex"]))
        if "range" in spec:
            (a, b), (c, d) = ((spec["range"][side]["line"], spec["range"][side]["column"]) for side in ("start", "end"))
            out = out.where((F.col("line") == a) & (F.col("column") == b) & (F.col("end_line") == c) & (F.col("end_column") == d))
        if "pattern" in spec:
            own = self.found.where(F.col("rule") == _pattern_name(spec["pattern"])).select(*KEY).distinct()
            out = out.join(own, KEY, "left_semi")
        if "nthChild" in spec:
            out = selectors.all_of(out, self._position(spec["nthChild"], u))
        for r in RELATIONAL:
            if r in spec:
                out = self._relation(out, r, spec[r], u)
        for other in spec.get("all", []):
            out = selectors.all_of(out, self._rule(other, u))
        if "any" in spec:
            out = selectors.all_of(out, selectors.any_of(*[self._rule(x, u).select(*KEY) for x in spec["any"]]))
        if "not" in spec:
            out = selectors.none_of(out, self._rule(spec["not"], u))
        if "where" in spec:  # a predicate of one's own: a function from the node table to a condition
            out = out.where(spec["where"](out))
        if "matches" in spec:
            out = selectors.all_of(out, self._rule(u.body(spec["matches"]), u))
        return out

    def _position(self, spec, u: Utilities) -> DataFrame:
        spec = spec if isinstance(spec, dict) else {"position": spec}
        step, offset = (0, spec["position"]) if isinstance(spec["position"], int) else selectors._position(spec["position"])
        among = self._rule(spec["ofRule"], u) if "ofRule" in spec else self.tree
        order = F.col("sib").desc() if spec.get("reverse") else F.col("sib")
        placed = among.where("named").withColumn("n_", F.row_number().over(Window.partitionBy("doc", "parent").orderBy(order)))
        hit = F.col("n_") == offset if step == 0 else ((F.col("n_") - offset) % step == 0) & ((F.col("n_") - offset) / step >= 0)
        return placed.where(hit).drop("n_")

    def _relation(self, rows: DataFrame, relation: str, spec: dict, u: Utilities) -> DataFrame:
        """Rows for which a node in the relation meets the rest of spec, no further than stopBy says: neighbor
        (default), end, or a rule whose first node is the last that is looked at."""
        stop, field = spec.get("stopBy", "neighbor"), spec.get("field")
        rest = {k: v for k, v in spec.items() if k not in ("stopBy", "field")}
        others = self._rule(rest, u) if rest else self.tree
        o = others.select("doc", *[F.col(c).alias(f"o_{c}") for c in ("pre", "parent", "last", "depth", "sib", "field")])
        inner = relation in ("inside", "has")
        a, b = ("o_", "") if relation == "inside" else ("", "o_")
        if inner:
            holds = (F.col(f"{a}pre") < F.col(f"{b}pre")) & (F.col(f"{b}pre") <= F.col(f"{a}last"))
        else:
            holds = (F.col("parent") == F.col("o_parent")) & (F.col("o_sib") > F.col("sib") if relation == "precedes" else F.col("o_sib") < F.col("sib"))
        if field is not None and inner:
            # The node below, or the one that leads to it, is the child by that name.
            child = self.tree.select("doc", F.col("pre").alias("f_pre"), F.col("last").alias("f_last"), F.col("parent").alias("f_parent"), F.col("field").alias("f_field"))
            pairs = rows.select("doc", "pre", "last", "depth").join(o, "doc").where(holds).join(child.where(F.col("f_field") == field), "doc").where((F.col("f_parent") == F.col(f"{a}pre")) & (F.col(f"{b}pre") >= F.col("f_pre")) & (F.col(f"{b}pre") <= F.col("f_last")))
            if stop == "neighbor":
                pairs = pairs.where(F.col(f"{b}pre") == F.col("f_pre"))
            return rows.join(pairs.select("doc", "pre").distinct(), KEY, "left_semi")
        if stop == "neighbor":
            near = F.col(f"{b}parent") == F.col(f"{a}pre") if inner else F.abs(F.col("o_sib") - F.col("sib")) == 1
            return rows.join(o, (rows.doc == o.doc) & holds & near, "left_semi")
        if stop == "end":
            return rows.join(o, (rows.doc == o.doc) & holds, "left_semi")
        s = self._rule(stop, u).select("doc", *[F.col(c).alias(f"s_{c}") for c in ("pre", "parent", "last", "depth", "sib")])
        pairs = rows.select("doc", "pre", "last", "parent", "depth", "sib").join(o, "doc").where(holds)
        low, high = ("o_pre", "pre") if relation == "inside" else ("pre", "o_pre")
        if inner:  # a stop strictly between the two hides the farther one
            between = (F.col("s_pre") > F.col(low)) & (F.col("s_pre") < F.col(high)) & (F.col(high) <= F.col("s_last"))
        else:
            between = (F.col("s_parent") == F.col("parent")) & (F.col("s_sib") > F.least("sib", "o_sib")) & (F.col("s_sib") < F.greatest("sib", "o_sib"))
        seen = pairs.join(s, (pairs.doc == s.doc) & between, "left_anti")
        return rows.join(seen.select(*KEY).distinct(), KEY, "left_semi")

    def captured(self, pattern, constraints: dict[str, dict] | None = None) -> DataFrame:
        """Matches of a pattern whose captured nodes meet the constraints."""
        out = self.found.where(F.col("rule") == _pattern_name(pattern))
        for name, spec in (constraints or {}).items():
            good = self._rule(spec, self.utilities).select("doc", F.col("start").alias("c_start"), F.col("stop").alias("c_stop")).distinct()
            c = F.col("captures").getItem(name)
            out = out.join(good, (out.doc == good.doc) & (c["start"] == F.col("c_start")) & (c["stop"] == F.col("c_stop")), "left_semi")
        return out


def captured_of(found: DataFrame, *alternatives) -> DataFrame:
    """Matches of several patterns; a node that more than one matches has the captures of the first."""
    ranks = F.element_at(F.create_map(*[x for k, p in enumerate(alternatives) for x in (F.lit(_pattern_name(p)), F.lit(k))]), F.col("rule"))
    ranked = found.where(F.col("rule").isin([_pattern_name(p) for p in alternatives])).withColumn("rank", ranks)
    best = ranked.groupBy(*KEY).agg(F.min("rank").alias("rank"))
    return ranked.join(best, [*KEY, "rank"], "left_semi")


# --- variables, transforms, fixes ----------------------------------------------------------------

_USE = re.compile(r"\$\$\$([A-Z_][A-Z0-9_]*)|\$([A-Z_][A-Z0-9_]*)")


def uses(template: str) -> list[str]:
    return [a or b for a, b in _USE.findall(template)]


def check_variables(config: dict) -> None:
    """ValueError if a constraint, transform, fix, message or label uses a variable that no pattern captures and
    no transform makes."""
    known = {v for p in patterns_of(config["rule"]).values() for v in code.Pattern(p["pattern"], p.get("strictness", "smart"), p.get("selector")).variables}
    wrong = set(config.get("constraints", {})) - known
    for name in order(config.get("transform", {})):
        wrong |= {v for v in uses(config["transform"][name]["source"]) if v not in known}
        known.add(name)
    for part in ("fix", "message"):
        wrong |= {v for v in uses(config.get(part) or "") if v not in known}
    wrong |= set(config.get("labels", {})) - known
    if wrong:
        raise ValueError(f"undefined variables: {sorted(wrong)}")


def order(transforms: dict[str, dict]) -> list[str]:
    """Transforms with what they need first; ValueError for a cycle."""
    out, state = [], {}

    def visit(name: str) -> None:
        if state.get(name) == 1:
            raise ValueError(f"transform {name} needs itself")
        if name in transforms and name not in state:
            state[name] = 1
            for v in uses(transforms[name]["source"]):
                visit(v)
            state[name] = 2
            out.append(name)

    for name in transforms:
        visit(name)
    return out


def transformed(found: DataFrame, transforms: dict[str, dict]) -> DataFrame:
    """Matches with the transforms' results among their captures. A transform: {source: $VAR, substring: [a, b]},
    {source, replace: [regex, by]}, {source, convert: case}."""
    for name in order(transforms):
        found = found.withColumn("captures", _with(F.col("captures"), name, transforms[name]))
    return found


def _with(captures: Column, name: str, t: dict) -> Column:
    """Captures and the result of a transform."""
    value = captures.getItem(uses(t["source"])[0])["text"]
    if "substring" in t:
        value = T.substring_range(value, *t["substring"])
    elif "replace" in t:
        value = F.regexp_replace(value, *t["replace"])
    else:
        value = T.convert(value, t["convert"])
    made = F.map_from_arrays(F.array(F.lit(name)), F.array(F.struct(value.alias("text"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("stop"), F.lit(0).alias("indent"))))
    return F.map_concat(captures, made)


def interpolated(template: str, indented: bool = False, captures: Column | None = None) -> Column:
    """A template with `$VAR` and `$$$VAR` filled in; unknown variables are empty. indented: further lines of a
    capture move from the indent that they had to that of the template's line."""
    out, at = [], 0
    for m in _USE.finditer(template):
        line = template[template.rfind("\n", 0, m.start()) + 1 : m.start()]
        c = (F.col("captures") if captures is None else captures).getItem(m[1] or m[2])
        value = F.coalesce(c["text"], F.lit(""))
        if indented:
            lead = line[: len(line) - len(line.lstrip())]
            value = F.regexp_replace(value, F.concat(F.lit("\n[ \t]{0,"), F.coalesce(c["indent"], F.lit(0)).cast("string"), F.lit("}")), F.lit("\n" + lead))
        out += [F.lit(template[at : m.start()]), value]
        at = m.end()
    return F.concat(*out, F.lit(template[at:]))


def indented(text: Column, by: int) -> Column:
    """Lines after the first moved right (or left, as far as they have blanks)."""
    return F.regexp_replace(text, F.lit("\n"), F.lit("\n" + " " * by)) if by >= 0 else F.regexp_replace(text, rf"\n[ ]{{0,{-by}}}", "\n")


def edits(found: DataFrame, template: str) -> DataFrame:
    """(doc, start, stop, text): a fix for each match; further lines get the indent of the line it replaces at."""
    return found.select("doc", "start", "stop", interpolated(template, True).alias("text"))


def expanded(changes: DataFrame, tree: DataFrame, after: str) -> DataFrame:
    """Edits that also take the next sibling, if its text matches: a separator behind a deleted item."""
    own = changes.join(tree.select("doc", "start", "stop", "parent", F.col("last").alias("own_last")), ["doc", "start", "stop"])
    following = tree.select("doc", F.col("parent"), F.col("pre").alias("n_pre"), F.col("stop").alias("n_stop"), F.col("text").alias("n_text"))
    near = own.join(following, ["doc", "parent"], "left").where(F.col("n_pre").isNull() | (F.col("n_pre") == F.col("own_last") + 1))
    taken = near.where(F.col("n_text").rlike(after)).groupBy("doc", "start", "stop").agg(F.max("n_stop").alias("to"))
    return changes.join(taken, ["doc", "start", "stop"], "left").select("doc", "start", F.coalesce("to", "stop").alias("stop"), "text")


def applied(sources: DataFrame, changes: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Sources with their edits made. Of edits that overlap the first stays, of equal starts the longest; the
    others are left for another pass. Sources without edits come back as they are."""
    before = Window.partitionBy("doc").orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    kept = changes.distinct().withColumn("so_far", F.max("stop").over(before)).where("so_far is null or start >= so_far")
    lists = kept.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "stop", F.col("text").alias("by")))).alias("edits"))
    joined = sources.join(lists, F.col(key) == F.col("doc"), "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, e: F.struct(F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, e["start"] - acc["at"]), e["by"]).alias("out"), e["stop"].alias("at"))
    done = F.aggregate("edits", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.lit(2147483647))))
    return joined.select(*[F.col(c) for c in sources.columns if c != text], F.when(F.col("edits").isNull(), F.col(text)).otherwise(done).alias(text))


class _Fix:
    """Texts with the fixes of a pattern's matches made, part by part: a fix depends on the captures of its match alone."""

    def __init__(self, pattern: tuple, template: str, transforms: list[tuple[str, str, str]], place: int):
        self.pattern, self.template, self.transforms, self.place = pattern, template, transforms, place

    def by(self, captures: dict[str, dict]) -> str:
        for name, source, case in self.transforms:
            text = captures.get(source, {}).get("text", "")
            captures[name] = {"text": getattr(text, case)(), "indent": 0}
        out, at = [], 0
        for m in _USE.finditer(self.template):
            line = self.template[self.template.rfind("\n", 0, m.start()) + 1 : m.start()]
            lead = line[: len(line) - len(line.lstrip())]
            c = captures.get(m[1] or m[2], {"text": "", "indent": 0})
            out += [self.template[at : m.start()], re.sub(f"\n[ \t]{{0,{c['indent']}}}", "\n" + lead, c["text"])]
            at = m.end()
        return "".join(out) + self.template[at:]

    def __call__(self, batches):
        import pyarrow as pa

        match, patterns = code._Match({"fix": self.pattern}, []), {"fix": code.Pattern(*self.pattern)}
        whole = patterns["fix"].kind in (None, "Module")
        key = ("fix", self.pattern, self.template, tuple(self.transforms))

        def part_of(part: code.Part) -> str:
            out, at = [], 0
            for h in sorted(match.hits(part, patterns), key=lambda h: (h[3], -h[4])):
                if h[3] >= at:
                    out += [part.text[at : h[3]], self.by(dict(h[7]))]
                    at = h[4]
            return "".join(out) + part.text[at:]

        def of(source: str | None) -> str | None:
            try:
                split = code.parts(source or "", whole)
            except (SyntaxError, code.tokenize.TokenError, ValueError, RecursionError):
                return source
            out = []
            for part, *_ in split:
                if key not in part.kept:
                    part.kept[key] = part_of(part)
                out.append(part.kept[key])
            return None if source is None else "".join(out)

        for batch in batches:
            texts = pa.array([of(x) for x in batch.column(self.place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == self.place else c for k, c in enumerate(batch.columns)], batch.schema.names)


def fixed(sources: DataFrame, pattern: str | dict, template: str, transforms: dict[str, dict] | None = None, text: str = "text") -> DataFrame:
    """Sources with the fix of every match of one pattern made: applied(edits(transformed(matches))) in the pass that parses
    them, for transforms to lower and upper case. Sources that do not parse, and those without a match, come back as they are."""
    check_variables({"rule": {"pattern": pattern}, "transform": transforms or {}, "fix": template})
    plain = []
    for name in order(transforms or {}):
        t = transforms[name]
        if t.get("convert") not in ("lower", "upper"):
            raise ValueError(f"transform {name}: only lower and upper go with the pass; use transformed, edits and applied")
        plain.append((name, uses(t["source"])[0], t["convert"]))
    code.ship(sources.sparkSession)
    wanted = code._plain({"fix": next(iter(patterns_of({"pattern": pattern}).values()))})["fix"]
    return sources.mapInArrow(_Fix(wanted, template, plain, sources.columns.index(text)), sources.schema)


def rewritten(found: DataFrame, variable: str, parts: DataFrame, joiner: str | None = None) -> DataFrame:
    """(doc, pre, text): the capture with the edits inside it made, or, with a joiner, the edits' texts alone."""
    c = F.col("captures").getItem(variable)
    whole = found.select("doc", "pre", c["start"].alias("c_start"), c["stop"].alias("c_stop"), c["text"].alias("whole"))
    e = parts.select("doc", F.col("start").alias("e_start"), F.col("stop").alias("e_stop"), F.col("text").alias("by"))
    inner = whole.join(e, "doc").where((F.col("e_start") >= F.col("c_start")) & (F.col("e_stop") <= F.col("c_stop")))
    outermost = Window.partitionBy("doc", "pre").orderBy("e_start", F.desc("e_stop")).rowsBetween(Window.unboundedPreceding, -1)
    inner = inner.withColumn("so_far", F.max("e_stop").over(outermost)).where("so_far is null or e_start >= so_far")
    lists = inner.groupBy("doc", "pre").agg(F.sort_array(F.collect_list(F.struct((F.col("e_start") - F.col("c_start")).alias("start"), (F.col("e_stop") - F.col("c_start")).alias("stop"), "by"))).alias("edits"))
    rows = whole.join(lists, ["doc", "pre"], "left")
    if joiner is not None:
        return rows.select("doc", "pre", F.coalesce(F.array_join(F.transform("edits", lambda x: x["by"]), joiner), F.lit("")).alias("text"))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, x: F.struct(F.concat(acc["out"], F.substring(F.col("whole"), acc["at"] + 1, x["start"] - acc["at"]), x["by"]).alias("out"), x["stop"].alias("at"))
    made = F.aggregate("edits", zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col("whole"), acc["at"] + 1, F.lit(2147483647))))
    return rows.select("doc", "pre", F.when(F.col("edits").isNull(), F.col("whole")).otherwise(made).alias("text"))


def outline(engine: Engine, extractors: list[dict]) -> DataFrame:
    """(doc, pre, last, symbol, name, line, end_line) of nodes that extractors {symbol, rule, name} find: name is the kind of
    the child that names the node. A node that several find is the first one's."""
    parts = []
    for rank, x in enumerate(extractors):
        own = engine.nodes(x["rule"]).select("doc", "pre", "last", "line", "end_line")
        names = engine.tree.where(F.col("kind") == x.get("name", "identifier")).groupBy("doc", F.col("parent").alias("pre")).agg(F.min_by("text", "sib").alias("name"))
        parts.append(own.join(names, KEY, "left").select("doc", "pre", "last", F.lit(rank).alias("rank"), F.lit(x["symbol"]).alias("symbol"), "name", "line", "end_line"))
    rows = reduce(DataFrame.unionByName, parts)
    best = rows.groupBy(*KEY).agg(F.min("rank").alias("rank"))
    return rows.join(best, [*KEY, "rank"], "left_semi").drop("rank")


def labels(found: DataFrame, named: dict[str, dict]) -> DataFrame:
    """Matches with an array of labelled spans: those named (style, message), else the match as primary."""
    if not named:
        return found.withColumn("labels", F.array(F.struct(F.lit("primary").alias("style"), "start", "stop", F.lit(None).cast("string").alias("message"))))
    spans = []
    for name, x in named.items():
        c = F.col("captures").getItem(name)
        spans.append(F.struct(F.lit(x.get("style", "primary")).alias("style"), c["start"].alias("start"), c["stop"].alias("stop"), F.lit(x.get("message")).cast("string").alias("message")))
    return found.withColumn("labels", F.filter(F.array(*spans), lambda x: x["start"].isNotNull()))


def _allowed(c: dict, path: str) -> Column:
    hit = reduce(lambda a, g: a | F.col(path).rlike(T.glob_regex(g)), c["files"], F.lit(False)) if c.get("files") else F.lit(True)
    for g in c.get("ignores", []):
        hit = hit & ~F.col(path).rlike(T.glob_regex(g))
    return hit


def applicable(paths: DataFrame, configs: list[dict], path: str = "path") -> DataFrame:
    """(path, rule): rules whose `files` has a glob of the path (all, if there is none) and whose `ignores` has none."""
    tests = [F.when(_allowed(c, path), F.lit(c["id"])) for c in configs]
    return paths.select(path, F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("rule"))


def findings(sources: DataFrame, configs: list[dict], utilities: dict[str, dict] | None = None, tree: DataFrame | None = None, key: str = "path", text: str = "text") -> DataFrame:
    """(doc, rule, severity, message, start, stop, line) of all configs {id, rule, constraints, transform, message,
    severity, files, ignores, utils}. A rule with one pattern at its top has captures for its message."""
    for c in configs:
        check_variables(c)
    if tree is None:
        with contextlib.suppress(ValueError):  # of rules that need a node table
            return _in_one_pass(sources, configs, utilities, key, text)
    wanted = {n: p for c in configs for n, p in patterns_of([c["rule"], c.get("constraints", {}), c.get("utils", {}), utilities or {}]).items()}
    tree = code.nodes(sources, key, text) if tree is None else tree
    found = code.matches(sources, wanted, key, text) if wanted else None
    engine, out = Engine(tree, found, utilities), []
    may = applicable(sources.select(key).distinct(), configs, key).withColumnRenamed(key, "doc")
    for c in configs:
        hit = engine.nodes(c["rule"], c.get("utils"))
        if "pattern" in c["rule"]:
            m = transformed(engine.captured(c["rule"]["pattern"], c.get("constraints")), c.get("transform", {}))
            hit = hit.join(m.select("doc", "pre", "captures"), KEY)
        else:
            hit = hit.withColumn("captures", F.create_map().cast("map<string,struct<text:string,start:int,stop:int,indent:int>>"))
        rows = hit.select("doc", F.lit(c["id"]).alias("rule"), F.lit(c.get("severity", "hint")).alias("severity"), interpolated(c.get("message", "")).alias("message"), "start", "stop", "line")
        out.append(rows)
    return reduce(DataFrame.unionByName, out).join(may, ["doc", "rule"], "left_semi").where("severity != 'off'")


def _in_one_pass(sources: DataFrame, configs: list[dict], utilities: dict[str, dict] | None, key: str, text: str) -> DataFrame:
    on = [c for c in configs if c.get("severity") != "off"]
    if any(c.get("utils") for c in on) or not on:
        raise ValueError("utilities of one rule need a node table")
    found = hits(sources, {c["id"]: c for c in on}, utilities, key, text, ["rule", "start", "stop", "line", "captures"])
    severity, message, may = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False)
    for c in on:
        own = F.col("rule") == c["id"]
        captures = F.col("captures")
        for name in order(c.get("transform", {})):
            captures = _with(captures, name, c["transform"][name])
        severity = F.when(own, c.get("severity", "hint")).otherwise(severity)
        message = F.when(own, interpolated(c.get("message", ""), captures=captures)).otherwise(message)
        may = F.when(own, _allowed(c, "doc")).otherwise(may)
    return found.where(may).select("doc", "rule", severity.alias("severity"), message.alias("message"), "start", "stop", "line")


# --- rules in the pass that parses -----------------------------------------------------------------


class _Beyond(Exception):
    """What is asked for lies outside of the part that is looked at."""


_SIMPLE = re.compile(r"(?:[A-Za-z0-9_ ,:;=<>!@%&~#'\"`/-]|\^|\$|\||\((?:\?:)?|\)|[*+?](?![*+?])|\\[^A-Za-z0-9\s]|\[\^?[A-Za-z0-9_]+(?:-[A-Za-z0-9])?[A-Za-z0-9_]*\])*")


def _regex(text: str) -> re.Pattern:
    """An expression that means the same to Java and Python; ValueError for others."""
    if not _SIMPLE.fullmatch(text):
        raise ValueError(f"not for one pass: {text!r}")
    return re.compile(re.sub(r"(?<!\\)\$", "(?=(?:\r\n|(?<!\r)\n|[\r\u0085\u2028\u2029])?\\\\Z)", text))


class _Hits:
    """Rules on a source: what a part decides alone is kept with it, the rest is asked again among its neighbours."""

    def __init__(self, configs: dict[str, dict], utilities: dict[str, dict], columns: list[str]):
        self.configs, self.u, self.columns = configs, Utilities(utilities), columns
        self.whole, self.top, self.regexes = False, None, {}
        self.patterns = {n: (p["pattern"], p.get("strictness", "smart"), p.get("selector")) for n, p in patterns_of([configs, utilities]).items()}
        self.ready = {}

    def check(self) -> None:
        """ValueError for rules that need a node table: predicates of one's own and expressions of Java's own."""

        def visit(spec) -> None:
            for v in spec if isinstance(spec, list) else []:
                visit(v)
            for k, v in spec.items() if isinstance(spec, dict) else []:
                if k == "where":
                    raise ValueError("a predicate needs a node table")
                if k == "regex":
                    _regex(v)
                elif k == "matches":
                    visit(self.u.body(v))
                elif k != "pattern":
                    visit(v)

        for c in self.configs.values():
            for spec in (c["rule"], *c.get("constraints", {}).values()):
                visit(spec)
                self._known(spec)
        for p in self.patterns.values():
            code.Pattern(*p)

    def _known(self, spec) -> None:
        unknown = set(spec) - {*ATOMIC, *RELATIONAL, *COMPOSITE, "stopBy", "field"}
        if unknown or not set(spec) & {*ATOMIC, *RELATIONAL, *COMPOSITE}:
            raise ValueError(f"not a rule: {sorted(unknown) or spec}")

    def never_module(self, spec: dict) -> bool:
        return spec.get("kind", "Module") != "Module" or ("pattern" in spec and self.pattern(spec["pattern"]).kind not in (None, "Module")) or any(map(self.never_module, spec.get("all", []))) or ("any" in spec and all(map(self.never_module, spec["any"]))) or ("matches" in spec and self.never_module(self.u.body(spec["matches"])))

    def pattern(self, v) -> code.Pattern:
        name = _pattern_name(v)
        if name not in self.ready:
            self.ready[name] = code.Pattern(*self.patterns[name])
        return self.ready[name]

    def siblings(self, node, at: int) -> tuple[list, int]:
        up = node.parent
        if up is None:
            return [(node, at)], 0
        if up.parent is None and not self.whole:
            if self.top is None:
                raise _Beyond
            return self.top, at + node.sib
        return [(c, at) for c in up.children], node.sib

    def test(self, spec: dict, node, at: int) -> bool:
        if "kind" in spec and node.kind != spec["kind"]:
            return False
        if node.parent is None and not self.whole and set(spec) & {"regex", "range", "pattern", "nthChild", "has"}:
            raise _Beyond
        if "regex" in spec:
            found = self.regexes.get(spec["regex"]) or self.regexes.setdefault(spec["regex"], _regex(spec["regex"]))
            if not found.search(node.text):
                return False
        if "range" in spec:
            if not self.whole:
                raise _Beyond
            (a, b), (c, d) = ((spec["range"][side]["line"], spec["range"][side]["column"]) for side in ("start", "end"))
            if self.place(node.start) != (a, b) or self.place(node.stop) != (c, d):
                return False
        if "pattern" in spec and self.pattern(spec["pattern"]).match(node) is None:
            return False
        if "nthChild" in spec and not self.position(spec["nthChild"], node, at):
            return False
        for r in RELATIONAL:
            if r in spec and not self.relation(r, spec[r], node, at):
                return False
        return all(self.test(x, node, at) for x in spec.get("all", [])) and ("any" not in spec or any(self.test(x, node, at) for x in spec["any"])) and ("not" not in spec or not self.test(spec["not"], node, at)) and ("matches" not in spec or self.test(self.u.body(spec["matches"]), node, at))

    def position(self, spec, node, at: int) -> bool:
        spec = spec if isinstance(spec, dict) else {"position": spec}
        step, offset = (0, spec["position"]) if isinstance(spec["position"], int) else selectors._position(spec["position"])
        fits = lambda x, k: x.named and ("ofRule" not in spec or self.test(spec["ofRule"], x, k))
        if not fits(node, at):
            return False
        among, own = self.siblings(node, at)
        n = 1 + sum(fits(*x) for x in (among[own + 1 :] if spec.get("reverse") else among[:own]))
        return n == offset if step == 0 else (n - offset) % step == 0 and (n - offset) / step >= 0

    def relation(self, relation: str, spec: dict, node, at: int) -> bool:
        stop, field = spec.get("stopBy", "neighbor"), spec.get("field")
        rest = {k: v for k, v in spec.items() if k not in ("stopBy", "field")}
        fits = lambda x, k: not rest or self.test(rest, x, k)
        if relation in ("precedes", "follows"):
            among, own = self.siblings(node, at)
            for x in among[own + 1 :] if relation == "precedes" else reversed(among[:own]):
                if fits(*x):
                    return True
                if stop == "neighbor" or (stop != "end" and self.test(stop, *x)):
                    return False
            return False
        if relation == "inside":
            below, above = node, node.parent
            while above is not None:
                if (field is None or below.field == field) and fits(above, at):
                    return True
                if stop == "neighbor" or (field is None and stop != "end" and self.test(stop, above, at)):
                    return False
                below, above = above, above.parent
            return False
        stack = [c for c in reversed(node.children) if field is None or c.field == field]
        while stack:
            x = stack.pop()
            if fits(x, at):
                return True
            if stop != "neighbor" and not (field is None and stop != "end" and self.test(stop, x, at)):
                stack.extend(reversed(x.children))
        return False

    def hit(self, name: str, part, k: int, at: int) -> tuple | None:
        c, node = self.configs[name], part.numbered[k]
        if not self.test(c["rule"], node, at):
            return None
        env = {}
        if "pattern" in c["rule"]:
            env = {x: code._capture(v, part.text) for x, v in self.pattern(c["rule"]["pattern"]).match(node).items()}
            for x, spec in c.get("constraints", {}).items():
                span = (env[x]["start"], env[x]["stop"]) if x in env else (None, None)
                if span == (0, len(part.text)) and not self.whole:
                    raise _Beyond
                if not any((n.start, n.stop) == span and self.test(spec, n, at) for n in part.numbered):
                    return None
        return name, k, part.lasts[k], node.start, node.stop, part.line(node), node.text, list(env.items())

    def of(self, source: str, key, whole: bool) -> list[tuple]:
        split = code.parts(source, whole)
        self.whole, self.top, out = split[0][0].whole, None, []
        if self.whole:
            self.place = code._positions(source)
            part = split[0][0]
            return code.placed([h for n in self.configs for k in range(part.size) if (h := self.hit(n, part, k, 0))], 0, 0, 0)
        for part, *_ in split:
            if key not in part.kept:
                sure, open_ = [], []
                for n in self.configs:
                    for k in range(part.size):
                        try:
                            h = self.hit(n, part, k, 0)
                            sure += [h] if h else []
                        except _Beyond:
                            open_.append((n, k))
                part.kept[key] = (sure, open_)
        self.top = [(node, place) for part, _, _, _, place in split for node in part.root.children]
        try:
            for part, start, line, pre, place in split:
                sure, open_ = part.kept[key]
                hits = sure + [h for n, k in open_ if (h := self.hit(n, part, k, place))]
                if hits:
                    out += code.placed(hits, start, line, pre)
            return out
        except _Beyond:
            return self.of(source, key, True)

    def __call__(self, batches):
        import pyarrow as pa

        whole = not all(self.never_module(c["rule"]) for c in self.configs.values())
        key = ("rules", json.dumps([self.configs, self.u.rules], sort_keys=True))
        for batch in batches:
            docs, out = [], []
            for doc, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    hits = self.of(source or "", key, whole)
                except (SyntaxError, code.tokenize.TokenError, ValueError, RecursionError):
                    continue
                docs += [doc] * len(hits)
                out += hits
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), *code.found_columns(out, self.columns)], ["doc", *self.columns])


def hits(sources: DataFrame, configs: dict[str, dict], utilities: dict[str, dict] | None = None, key: str = "path", text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """(doc, rule, pre, last, start, stop, line, text, captures) of the nodes that meet rules {rule, constraints}, as Engine.nodes and
    Engine.captured find them, in the pass that parses the sources: no node table and no join. ValueError for rules that need
    one: predicates of one's own, expressions that Java and Python may read differently. columns: those wanted besides doc."""
    columns = list(code._FOUND) if columns is None else columns
    f = _Hits({n: {"rule": c["rule"], "constraints": c.get("constraints", {})} for n, c in configs.items()}, utilities or {}, columns)
    f.check()
    f.ready = {}
    code.ship(sources.sparkSession)
    return sources.select(F.col(key).cast("string"), text).mapInArrow(f, code.schema_of(["doc", *columns]))
