"""Security rules over sources: a catalog of patterns and symbols, and the evidence that they find.

The result has the columns that relations need, so a scan is: sources -> evidence -> paths."""

from __future__ import annotations

import tokenize
from collections import defaultdict
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from scanlattice.functions import text as T
from scanlattice.functions.shipping import ship
from scanlattice.functions.tables import written

from . import code, flows, relations

# Kinds of evidence and degrees of confidence.
KINDS = ("source", "sink", "protection", "security_configuration", "context")
CONFIDENCE = ("high", "medium", "low")
BRANCHES = ("If", "For", "While", "Try", "With", "Match")
CATALOG = "id string, version int, title string, language string, kind string, capability string, confidence string, cwes array<string>, tags array<string>, patterns int, symbols int"


def check(rules: list[dict]) -> None:
    """ValueError for rules without an id of their own, of unknown kinds, without anything to match, or with a capture
    of a variable that the pattern does not have."""
    seen = set()
    for r in rules:
        if r["id"] in seen or r["kind"] not in KINDS or r.get("confidence", "high") not in CONFIDENCE:
            raise ValueError(f"{r['id']}: a repeated id, or an unknown kind or confidence")
        seen.add(r["id"])
        patterns = r.get("match", {}).get("any", [])
        if not patterns and not r.get("symbols"):
            raise ValueError(f"{r['id']}: neither patterns nor symbols")
        for p in patterns:
            own = code.Pattern(p.get("context", p["pattern"]), p.get("strictness", "smart"), p.get("selector"))
            if not set(p.get("captures", {}).values()) <= own.variables:
                raise ValueError(f"{r['id']}: captures {p['captures']} are not in {p['pattern']!r}")


def catalog(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """The rules as a table, checked."""
    check(rules)
    rows = [(r["id"], r.get("version", 1), r.get("title", ""), r.get("language", "python"), r["kind"], r["capability"], r.get("confidence", "high"), list(r.get("cwe", [])), list(r.get("tags", [])), len(r.get("match", {}).get("any", [])), len(r.get("symbols", []))) for r in rules]
    return spark.createDataFrame(rows, CATALOG)


def roles(rules: list[dict]) -> dict[str, set[str]]:
    """Roles that the rules of a capability capture: what relations are checked against."""
    out: dict[str, set[str]] = {}
    for r in rules:
        own = out.setdefault(r["capability"], set())
        for p in [*r.get("match", {}).get("any", []), *r.get("symbols", [])]:
            own |= set(p.get("captures", {}))
    return out


def _patterns(rules: list[dict]) -> tuple[dict[str, dict], dict[str, dict]]:
    """Patterns of the rules, named by rule and place, and the variables that they capture, by role."""
    patterns, roles_of = {}, {}
    for r in rules:
        for n, p in enumerate(r.get("match", {}).get("any", [])):
            name = f"{r['id']}#{n}"
            patterns[name] = {"pattern": p.get("context", p["pattern"]), "strictness": p.get("strictness", "smart"), "selector": p.get("selector")}
            roles_of[name] = p.get("captures", {})
    return patterns, roles_of


def scan(sources: DataFrame, rules: list[dict], tree: DataFrame | None = None, key: str = "path", text: str = "text") -> DataFrame:
    """sources -> evidence(id, path, scope, language, kind, capability, start, stop, line, end_line, rule, cwes, tags,
    confidence, captures, reachability, related). A place that several patterns of a rule find is one row.

    Scopes are the functions around a place (their dotted names and line), else the file."""
    check(rules)
    spark = sources.sparkSession
    tree = written(code.nodes(sources, key, text), "nodes") if tree is None else tree
    patterns, roles_of = _patterns(rules)
    parts = []
    capture = "array<struct<role:string,text:string,start:int,stop:int>>"
    if patterns:
        found = code.matches(sources, patterns, key, text)
        made = F.array().cast(capture)
        for name, captures in roles_of.items():
            if captures:
                own = [F.struct(F.lit(role).alias("role"), *[F.col("captures")[v][c].alias(c) for c in ("text", "start", "stop")]) for role, v in sorted(captures.items())]
                made = F.when(F.col("rule") == name, F.filter(F.array(*own), lambda c: c["start"].isNotNull()).cast(capture)).otherwise(made)
        parts.append(found.select(F.col("doc"), F.regexp_replace("rule", r"#\d+$", "").alias("rule"), "pre", "start", "stop", made.alias("captures")))
    symbols = [(r["id"], s["canonical"], role, index) for r in rules for s in r.get("symbols", []) for role, index in (s.get("captures") or {"": -1}).items()]
    if symbols:
        table = spark.createDataFrame(symbols, "rule string, canonical string, role string, place int")
        sites = code.resolved(code.calls(tree), code.imports(tree)).select("doc", "pre", "canonical")
        arguments = tree.where("field in ('args')").select("doc", F.col("parent").alias("pre"), "sib", F.col("text").alias("a_text"), F.col("start").alias("a_start"), F.col("stop").alias("a_stop"))
        lists = arguments.groupBy("doc", "pre").agg(F.sort_array(F.collect_list(F.struct("sib", "a_text", "a_start", "a_stop"))).alias("args"))
        place = tree.select("doc", "pre", "start", "stop")
        met = sites.join(F.broadcast(table), "canonical").join(place, ["doc", "pre"]).join(lists, ["doc", "pre"], "left")
        arg = F.try_element_at("args", F.col("place") + 1)
        one = F.when((F.col("place") >= 0) & arg.isNotNull(), F.struct(F.col("role"), arg["a_text"].alias("text"), arg["a_start"].alias("start"), arg["a_stop"].alias("stop")))
        parts.append(met.groupBy("doc", "rule", "pre", "start", "stop").agg(F.sort_array(F.collect_list(one)).cast(capture).alias("captures")))
    rows = reduce(DataFrame.unionByName, parts)
    rows = rows.groupBy("doc", "rule", "start", "stop").agg(F.min_by("captures", "pre").alias("captures"), F.min("pre").alias("pre"))
    lines = tree.select("doc", "pre", "line", "end_line")
    rows = rows.join(lines, ["doc", "pre"])
    outline = code.outline(tree).where("kind != 'ClassDef'").select(F.col("doc").alias("o_doc"), F.col("pre").alias("o_pre"), "last", F.concat_ws(".", F.nullif("container", F.lit("")), "name").alias("name"), F.col("line").alias("o_line"))
    around = rows.select("doc", "pre").distinct().join(outline, (F.col("doc") == F.col("o_doc")) & (F.col("pre") > F.col("o_pre")) & (F.col("pre") <= F.col("last")))
    scope = around.groupBy("doc", "pre").agg(F.max_by(F.concat_ws(":", "name", "o_line"), "o_pre").alias("scope"))
    facts = F.broadcast(catalog(spark, rules).select(F.col("id").alias("rule"), "language", "kind", "capability", "confidence", "cwes", "tags"))
    out = rows.join(scope, ["doc", "pre"], "left").join(facts, "rule")
    own = T.fnv_id("ev-", F.col("doc"), F.col("rule"), F.col("start").cast("string"), F.col("stop").cast("string"))
    return out.select(own.alias("id"), F.col("doc").alias("path"), F.coalesce("scope", F.lit("")).alias("scope"), "language", "kind", "capability", "start", "stop", (F.col("line") + 1).alias("line"), (F.col("end_line") + 1).alias("end_line"), "rule", "cwes", "tags", "confidence", "captures", F.lit(None).cast("string").alias("reachability"), F.array().cast("array<string>").alias("related"))


def assignments(tree: DataFrame) -> DataFrame:
    """edges(path, scope, left, right, at, conditional) for bounded propagation: plain assignments to one name, a row for
    each name that the value reads (null if none); conditional inside if, loops and try."""
    top = tree.where("kind = 'Assign'").select("doc", "pre", "last", F.col("start").alias("at"))
    left = tree.where("kind = 'Name' and field = 'targets'").select("doc", F.col("parent").alias("pre"), F.col("text").alias("left"))
    reads = tree.where("kind = 'Name' and (field is null or field != 'targets')").select(F.col("doc").alias("r_doc"), F.col("pre").alias("r_pre"), F.col("text").alias("right"))
    rows = top.join(left, ["doc", "pre"]).join(reads, (F.col("doc") == F.col("r_doc")) & (F.col("r_pre") > F.col("pre")) & (F.col("r_pre") <= F.col("last")), "left").select("doc", "pre", "at", "left", "right").distinct()
    branch = tree.where(F.col("kind").isin(*BRANCHES)).select(F.col("doc").alias("b_doc"), F.col("pre").alias("b_pre"), F.col("last").alias("b_last"))
    inside = top.join(branch, (F.col("doc") == F.col("b_doc")) & (F.col("pre") > F.col("b_pre")) & (F.col("pre") <= F.col("b_last"))).select("doc", "pre").distinct().withColumn("conditional", F.lit(True))
    outline = code.outline(tree).where("kind != 'ClassDef'").select(F.col("doc").alias("o_doc"), F.col("pre").alias("o_pre"), F.col("last").alias("o_last"), F.concat_ws(".", F.nullif("container", F.lit("")), "name").alias("name"), F.col("line").alias("o_line"))
    scope = top.join(outline, (F.col("doc") == F.col("o_doc")) & (F.col("pre") > F.col("o_pre")) & (F.col("pre") <= F.col("o_last"))).groupBy("doc", "pre").agg(F.max_by(F.concat_ws(":", "name", "o_line"), "o_pre").alias("scope"))
    out = rows.join(inside, ["doc", "pre"], "left").join(scope, ["doc", "pre"], "left")
    return out.select(F.col("doc").alias("path"), F.coalesce("scope", F.lit("")).alias("scope"), "left", "right", "at", F.coalesce("conditional", F.lit(False)).alias("conditional"))


def reached(evidence: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """Names that the sources reach: (path, scope, source, name, at, until, steps), for relations.security_paths. A source
    begins at the assignment whose value it stands in, with all its names; until is where the name is assigned next, in a branch too."""
    key = F.concat_ws("\u0001", "path", "scope")
    e = edges.select(key.alias("scope"), "left", "right", "at", "conditional").distinct()
    starts = evidence.where("kind = 'source'").select("id", key.alias("scope"), "path", F.col("start").alias("s_start"))
    first = starts.join(edges.where("not conditional").select(key.alias("scope"), "left", "at").distinct(), "scope").where(F.col("at") <= F.col("s_start"))
    first = first.groupBy("id", "scope", "at").agg(F.collect_set("left").alias("names"))
    first = first.groupBy("id", "scope").agg(F.max_by(F.struct(F.col("names"), F.col("at")), "at").alias("a")).select("id", "scope", F.explode("a.names").alias("name"), "a.at")
    found = flows.propagate(first.select("scope", "name", "at").distinct(), e, depth or flows.DEPTH)
    own = first.select("id", "scope", F.col("name").alias("origin"), F.col("at").alias("origin_at"))
    met = own.join(found, ["scope", "origin"]).where(F.col("at") >= F.col("origin_at"))
    ends = e.select("scope", F.col("left").alias("name"), "at").distinct().withColumn("until", F.lead("at").over(Window.partitionBy("scope", "name").orderBy("at")))
    met = met.join(ends, ["scope", "name", "at"], "left")
    cut = F.split("scope", "\u0001")
    return met.select(cut[0].alias("path"), cut[1].alias("scope"), F.col("id").alias("source"), "name", F.col("at").cast("int").alias("at"), F.col("until").cast("int").alias("until"), F.col("steps").cast("int").alias("steps"))


# --- a whole scan in one pass ------------------------------------------------------------------------

_PLACE = {"rule": pa.string(), "start": pa.int32(), "stop": pa.int32(), "line": pa.int32(), "end_line": pa.int32()}
_GUARDS = pa.list_(pa.struct([(c, _PLACE[c]) for c in ("rule", "start", "stop")]))


class _Paths:
    """Paths of sources. What is found in a part is kept with it, and so are the paths inside its functions; only what
    stands at the margin is related for each source anew.

    A piece of evidence is (rule, start, stop, line, end_line, scope, captures), an assignment (scope, left, right, at,
    conditional) and a path (place of the relation, source, sink, state, hops, protections)."""

    def __init__(self, rules: list[dict], contracts: list[dict], depth: int):
        self.rules, self.contracts, self.depth = rules, contracts, depth

    def __call__(self, batches):
        self.kind = {r["id"]: (r["kind"], r["capability"]) for r in self.rules}
        named, self.roles = _patterns(self.rules)
        self.patterns = {n: code.Pattern(p["pattern"], p["strictness"], p["selector"]) for n, p in named.items()}
        self.symbols = defaultdict(lambda: defaultdict(list))
        for r in self.rules:
            for s in r.get("symbols", []):
                self.symbols[s["canonical"]][r["id"]] += list(s.get("captures", {}).items())
        self.key = ("paths", repr((self.rules, self.contracts, self.depth)))
        whole = any(p.kind in (None, "Module") for p in self.patterns.values())
        for batch in batches:
            docs, out = [], []
            for doc, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found = self.of(code.parts(source or "", whole))
                except (SyntaxError, tokenize.TokenError, ValueError, RecursionError):
                    continue
                docs += [doc] * len(found)
                out += found
            columns = [pa.array(docs, pa.string()), pa.array([r[0] for r in out], pa.int32()), pa.array([r[3] for r in out], pa.string()), pa.array([r[4] for r in out], pa.int32())]
            names = ["path", "r", "state", "hops"]
            for side, at in (("s", 1), ("k", 2)):
                columns += [pa.array([r[at][n] for r in out], t) for n, t in enumerate(_PLACE.values())]
                names += [f"{side}_{c}" for c in _PLACE]
            guards = [[dict(zip(("rule", "start", "stop"), g)) for g in r[5]] for r in out]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(guards, _GUARDS)], [*names, "guards"])

    def of(self, split: list[tuple]) -> list[tuple]:
        heads: dict[str, tuple] = {}
        for part, _, line, _, _ in split:
            if self.key not in part.kept:
                part.kept[self.key] = (self.found(part), {})
            code.add_heads(heads, part.kept[self.key][0][2], line)
        out, evidence, edges = [], [], []
        for part, start, line, _, _ in split:
            (_, calls, _, _), known = part.kept[self.key]
            names = tuple(code.canonical(c[0], heads)[0] for c in calls)
            if names not in known:
                known[names] = self.inside(part, names)
            paths, around, left = known[names]
            out += [(r, _moved(s, start, line), _moved(k, start, line), state, hops, [_moved(g, start, line) for g in guards]) for r, s, k, state, hops, guards in paths]
            evidence += [(*_moved(e, start, line), None, [(role, text, a + start, b + start) for role, text, a, b in e[6]]) for e in around]
            edges += [(None, name, right, at + start, c) for _, name, right, at, c in left]
        return out + self.related(evidence, edges) if evidence else out

    def found(self, part: code.Part) -> tuple[list, list, list, list]:
        """(evidence of patterns with its number, calls of a name with what a symbol's evidence needs, imports, assignments)."""
        evidence, edges = [], set()
        place = lambda n: (n.start, n.stop, part.line(n), part.text.count("\n", 0, n.stop), _scope(part, n))
        for k, node in enumerate(part.numbered):
            for name, p in self.patterns.items():
                env = p.match(node) if p.kind is None or p.kind == node.kind else None
                if env is not None:
                    took = [(role, code._capture(env[v], part.text)) for role, v in sorted(self.roles[name].items()) if v in env]
                    evidence.append((k, name.rpartition("#")[0], *place(node), [(role, c["text"], c["start"], c["stop"]) for role, c in took if c["start"] is not None]))
            if node.kind == "Assign":
                inside = any(a.kind in BRANCHES for a in _around(node))
                reads = {n.text for n in node.walk() if n.kind == "Name" and n.field != "targets"} or {None}
                edges |= {(_scope(part, node), c.text, r, node.start, inside) for c in node.children if c.kind == "Name" and c.field == "targets" for r in reads}
        called, imported = code._Sites([]).found(part)
        calls = []
        for k, _, callee, _ in called if self.symbols else ():
            node = part.numbered[k]
            calls.append((callee, k, place(node), [(c.text, c.start, c.stop) for c in node.children if c.field == "args"]))
        return evidence, calls, imported, sorted(edges, key=repr)

    def inside(self, part: code.Part, names: tuple[str, ...]) -> tuple[list, list, list]:
        """(paths inside the functions, evidence at the margin, assignments at the margin) of a part whose calls have these
        canonical names. The first node of several at one place is the evidence."""
        evidence, calls, _, edges = part.kept[self.key][0]
        for name, (_, k, at, arguments) in zip(names, calls):
            for rule, captures in self.symbols.get(name, {}).items():
                evidence = [*evidence, (k, rule, *at, sorted((role, *arguments[n]) for role, n in captures if 0 <= n < len(arguments)))]
        first = {}
        for k, *e in sorted(evidence, key=lambda e: e[0]):
            first.setdefault(tuple(e[:3]), tuple(e))
        evidence = list(first.values())
        margin = [e for e in evidence if e[5] is None], [e for e in edges if e[0] is None]
        return self.related([e for e in evidence if e[5] is not None], [e for e in edges if e[0] is not None]), *margin

    def related(self, evidence: list[tuple], edges: list[tuple]) -> list[tuple]:
        """relations.security_paths of evidence and assignments of one source."""
        out, scopes, assigned = [], defaultdict(lambda: defaultdict(list)), defaultdict(list)
        for e in evidence:
            scopes[e[5]][self.kind[e[0]][0]].append(e)
        for e in edges:
            assigned[e[0]].append(e[1:])
        for scope, kinds in scopes.items():
            if not kinds["source"] or not kinds["sink"]:
                continue
            reached = _reached(kinds["source"], assigned[scope], self.depth)
            for at, c in enumerate(self.contracts):
                accepted = c["source"].get("capabilities") or [c["source"]["capability"]]
                guard = c.get("protection") or {}
                sources = [s for s in kinds["source"] if self.kind[s[0]][1] in accepted]
                guards = [g for g in kinds["protection"] if self.kind[g[0]][1] == guard.get("capability")] if guard else []
                for k in (k for k in kinds["sink"] if self.kind[k[0]][1] == c["sink"]["capability"]):
                    inputs = [x for x in k[6] if x[0] in c["sink"]["input_roles"]]
                    texts = {x[1] for x in inputs}
                    for s in sources:
                        hops = 0
                        state = "direct" if any(s[1] >= x[2] and s[2] <= x[3] for x in inputs) else "propagated"
                        if state != "direct":
                            near = [steps for name, a, until, steps in reached.get(s[:3], ()) if name in texts and a <= k[1] and (until is None or k[1] < until)]
                            if not near:
                                continue
                            hops = min(near)
                        out.append((at, s[:5], k[:5], state, hops, [g[:5] for g in guards if _attached(guard, g, s, k, inputs)]))
        return out


def _moved(e: tuple, start: int, line: int) -> tuple:
    return e[0], e[1] + start, e[2] + start, e[3] + line, e[4] + line


def _around(node: code.Node):
    while (node := node.parent) is not None:
        yield node


def _scope(part: code.Part, node: code.Node) -> tuple[str, int] | None:
    """The dotted name and line of the innermost function around a node."""
    over = [n for n in _around(node) if n.kind in code.DEFINITIONS]
    while over and over[0].kind == "ClassDef":
        over = over[1:]
    return (".".join(next(c.text for c in n.children if c.kind == "identifier") for n in reversed(over)), part.line(over[0])) if over else None


def _attached(guard: dict, g: tuple, s: tuple, k: tuple, inputs: list[tuple]) -> bool:
    if guard["application"] == "related_capture":
        role = guard["relation_role"]
        return bool({x[1] for x in g[6] if x[0] == role} & {x[1] for x in k[6] if x[0] == role})
    return g[1] <= s[1] and g[2] >= s[2] and any(g[1] >= x[2] and g[2] <= x[3] for x in inputs)


def _reached(sources: list[tuple], edges: list[tuple], depth: int) -> dict[tuple, list[tuple]]:
    """reached() of one scope: source -> (name, at, until, steps)."""
    places, reads, plain = defaultdict(set), defaultdict(set), set()
    for left, right, at, conditional in edges:
        places[left].add(at)
        if not conditional:
            plain.add((at, left))
            reads[right].add((left, at))
    ends = {(name, a): b for name, found in places.items() for a, b in zip(sorted(found), [*sorted(found)[1:], None])}
    first = {}
    for s in sources:
        before = max((at for at, _ in plain if at <= s[1]), default=None)
        first[s[:3]] = [x for x in plain if x[0] == before]
    chains = {}
    for origin in {name for found in first.values() for _, name in found}:
        level = {(name, at) for found in first.values() for at, name in found if name == origin}
        steps = dict.fromkeys(level, 0)
        for step in range(1, depth + 1):
            level = {(left, e_at) for name, at in level for left, e_at in reads[name] if e_at > at and (ends[name, at] is None or e_at <= ends[name, at])} - steps.keys()
            steps |= dict.fromkeys(level, step)
        chains[origin] = steps
    return {s: [(*x, ends[x], n) for at, origin in found for x, n in chains[origin].items() if x[1] >= at] for s, found in first.items()}


def paths(sources: DataFrame, rules: list[dict], contracts: list[dict], depth: int | None = None, key: str = "path", text: str = "text") -> DataFrame:
    """relations.security_paths of scan() and reached() in the pass that parses the sources, without a node table: a
    path does not leave its source. Each row is a source of its own."""
    check(rules)
    relations.catalog(sources.sparkSession, contracts, roles(rules))
    ship(sources.sparkSession)
    kinds = ("string", "int", "int", "int", "int")
    schema = "path string, r int, state string, hops int, " + ", ".join(f"{side}_{c} {t}" for side in "sk" for c, t in zip(_PLACE, kinds)) + ", guards array<struct<rule:string,start:int,stop:int>>"
    found = sources.select(F.col(key).cast("string"), text).mapInArrow(_Paths(rules, contracts, depth or flows.DEPTH), schema)
    own = lambda rule, start, stop: T.fnv_id("ev-", F.col("path"), rule, start.cast("string"), stop.cast("string"))
    ids = {side: own(*(F.col(f"{side}_{c}") for c in ("rule", "start", "stop"))) for side in "sk"}
    guards = F.array_sort(F.transform("guards", lambda g: own(g["rule"], g["start"], g["stop"])))
    of = lambda values: F.element_at(F.array(*values), F.col("r") + 1)
    relation, capability = of([F.lit(c["id"]) for c in contracts]), of([F.lit(c["sink"]["capability"]) for c in contracts])
    cwes = of([F.array(*map(F.lit, c["cwe_candidates"])).cast("array<string>") for c in contracts])
    state = F.when(F.size("guards") > 0, "protected").otherwise(F.col("state"))
    step = lambda p: F.struct("path", (F.col(f"{p}_line") + 1).alias("line"), (F.col(f"{p}_end_line") + 1).alias("end_line"), ids[p].alias("evidence"))
    return found.select(T.fnv_id("path-", relation, ids["s"], ids["k"]).alias("id"), relation.alias("relation"), "path", capability.alias("capability"), cwes.alias("cwes"), state.alias("state"), "hops", ids["s"].alias("source"), ids["k"].alias("sink"), guards.alias("protections"), F.array(step("s"), step("k")).alias("steps"))
