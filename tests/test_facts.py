"""Facts beside trees, and whole scans from sources to paths, on hand-made frames."""

import ast

import pytest
from pyspark.sql import functions as F

from scanlattice.operators import code, facts, relations, scanning


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_build_symbols(spark):
    text = '[{"directory": "/r/src", "file": "a.c", "arguments": ["cc", "-DX=1", "-D", "Y", "-UZ", "a.c"]}, {"directory": "/r", "file": "src/a.c", "command": "cc -DX=0 -DY src/a.c"}, {"directory": "/r", "file": "src/b.cpp", "command": "c++ -DQ"}, {"directory": "/r", "file": "x.txt", "command": "y"}]'
    commands = facts.compile_commands(spark, text, "/r")
    files = spark.createDataFrame([("src/a.c",), ("src/new.h",), ("other/z.c",)], "path string")
    got = {r["path"]: r["symbols"] for r in facts.build_symbols(files, commands).collect()}
    assert got == {"src/a.c": {"Y": True}, "src/new.h": {}, "other/z.c": {}}
    for bad in ("{}", "x"):
        with pytest.raises(ValueError):
            facts.compile_commands(spark, bad)
    profiles = facts.build_profiles(spark, [("CMakeLists.txt", "add_definitions(-DA -DB=0) # -DC\nif(X)\n add_definitions(-DD)\nendif()\ntarget_compile_definitions(t PRIVATE E)"), ("lib/BUILD", 'cc_library(defines = ["F=1"], copts = ["-UA", "-O2"])')])
    got = {r["path"]: r["symbols"] for r in facts.build_symbols(spark.createDataFrame([("x.c",), ("lib/y.c",)], "path string"), profiles).collect()}
    assert got == {"x.c": {"A": True, "B": False, "E": True}, "lib/y.c": {"F": True, "A": False}}


def test_conditional_lines(spark):
    text = "#if A && !B\none\n# ifdef C\ntwo\n#else\nthree\n#endif\n#elif U || A\nfour\n#else\nfive\n#endif\n#ifndef A\nsix\n#endif\n#if defined(A) && (1)\nseven\n#endif"
    got = {text.split("\n")[a - 1]: s for a, b, s, _ in facts.conditional_lines(text, {"A": True, "B": False, "C": False}) if a <= b}
    assert got == {"one": "included", "two": "excluded", "three": "included", "four": "excluded", "five": "excluded", "six": "excluded", "seven": "included"}
    got = {text.split("\n")[a - 1]: s for a, b, s, _ in facts.conditional_lines(text, {"B": False})}
    assert got == {"one": "conditional", "two": "conditional", "three": "conditional", "four": "conditional", "five": "conditional", "six": "conditional", "seven": "conditional"}
    assert facts.truth("A || U", {"A": True}) is True and facts.truth("A && U", {"A": False}) is False and facts.truth("U", {}) is None and facts.truth("A == 2", {"A": True}) is None and facts.truth("!(A && B)", {"A": True, "B": False}) is True
    files = spark.createDataFrame([("f.c", text, {"A": False}), ("g.c", None, None)], "path string, text string, symbols map<string,boolean>")
    evidence = spark.createDataFrame([("e1", "f.c", 2), ("e2", "f.c", 14), ("e3", "g.c", 2), ("e4", "f.c", 4)], "id string, path string, line long")
    assert {r["id"]: r["availability"] for r in facts.availability(evidence, facts.conditional(files)).collect()} == {"e1": "excluded", "e2": "included", "e3": "included", "e4": "excluded"}


@pytest.mark.parametrize(
    "source, want",
    [
        ("'a' 'b'", ("known", "ab")), ("1_000", ("known", 1000)), ("-2", ("known", -2)), ("None", ("known", None)), ("[1, 'a', x]", ("partial", [1, "a", None])), ("{'a': [True]}", ("known", {"a": [True]})), ("{'a': y}", ("partial", ["a"])), ("'a' + B + 'c'", ("known", "abc")),
        ("'a' + x + 'c' + 'd'", ("partial", ["a", None, "cd"])), ("f'{B}-{x}'", ("partial", ["b-", None])), ("f'{B:>3}'", ("unknown", None)), ("x + y", ("unknown", None)), ("1 + 2", ("unknown", None)), ("CYCLE", ("unknown", None)), ("TWICE", ("unknown", None)), ("f(1)", ("unknown", None)), ("b'x'", ("unknown", None)),
    ],
)
def test_literals(source, want):
    tree = ast.parse(f"B = 'b'\nCYCLE = CYCLE2\nCYCLE2 = CYCLE\nTWICE = 1\nTWICE = 2\nv = {source}")
    assert facts.literal(tree.body[-1].value, facts._bound_once(tree)) == want


def test_literal_arguments_and_urls(spark):
    sources = spark.createDataFrame([("f", "U = 'https://h/'\nget(U + x, 'a')\nget(x)\nget('http://' + x)"), ("bad", "("), ("none", None)], "path string, text string")
    rows = facts.literals(sources).withColumn("url", facts.url_certainty(F.col("prefix"), F.col("state") == "known"))
    assert [(r["line"], r["argument"], r["state"], r["url"]) for r in rows.orderBy("line", "argument").collect()] == [(2, 0, "partial", "fixed_authority"), (2, 1, "known", "open"), (3, 0, "unknown", "open"), (4, 0, "partial", "fixed_scheme")]
    for text, whole, want in (("https://h", False, "fixed_scheme"), ("https://h", True, "fixed_authority"), ("https://u@h/", False, "fixed_scheme"), ("/a", False, "fixed_path"), ("//h/", False, "open"), ("/", True, "fixed_path"), ("/\\x", False, "open"), ("mailto:x", False, "fixed_scheme"), ("x", True, "open")):
        assert value(spark, facts.url_certainty(F.lit(text), F.lit(whole))) == want, text
    assert [value(spark, facts.normalized_symbol(F.lit(s))) for s in (" node:fs/promises.readFile ", "global::A::B", "a/b.c", "fs/promises")] == ["fs.promises.readFile", "A.B", "a/b.c", "fs.promises"]


def test_provenance_imported_facts_and_generated_lines(spark):
    files = spark.createDataFrame([("p/package.json", '{"main": "./lib/i.js", "bin": {"x": "bin/x.js", "y": "/abs"}}'), ("q/package.json", '{"main": "gone.js", "bin": "x.js"}'), ("d/a.js.map", '{"version": 3, "sourceRoot": "../", "sources": ["src/a.ts", "http://h/x"]}'), ("d/g.py", "# Generated from ../src/a.ts\nx"), ("bad/package.json", "{")], "path string, text string")
    listing = spark.createDataFrame([(p,) for p in ("p/lib/i.js", "p/bin/x.js", "q/x.js", "src/a.ts")], "path string")
    assert {tuple(r) for r in facts.provenance(files, listing).select("path", "origin", "kind").collect()} == {("p/package.json", "p/lib/i.js", "main"), ("p/package.json", "p/bin/x.js", "bin"), ("q/package.json", "q/x.js", "bin"), ("d/a.js.map", "src/a.ts", "source_map"), ("d/g.py", "src/a.ts", "generated_header")}
    texts, found = spark.createDataFrame([("f", "t")], "path string, text string"), spark.createDataFrame([("e",)], "id string")
    good = value(spark, F.sha2(F.lit("t"), 256))
    rows = spark.createDataFrame([("f", good, "e", "type", "T"), ("f", "0", "e", "type", "T"), ("g", good, "e", "type", "T"), ("f", good, "z", "type", "T")], "path string, sha256 string, evidence string, name string, value string")
    kept, refused = facts.compiler_facts(rows, texts, found)
    assert kept.count() == 1 and sorted(r["refused"] for r in refused.collect()) == ["other_text", "unknown_evidence", "unknown_file"]
    evidence = spark.createDataFrame([("e1", "gen.cs", 12), ("e2", "gen.cs", 40)], "id string, path string, line long")
    mapping = spark.createDataFrame([("gen.cs", 10, 15, "v.cshtml", 3)], "path string, first long, last long, original string, original_first long")
    assert [tuple(r) for r in facts.original_lines(evidence, mapping).select("id", "path", "line").collect()] == [("e1", "v.cshtml", 5)]


def test_embedded_blocks_and_page_checks(spark):
    page = '<p onclick="x()">\n<script src=a>\nvar x;</script >z<script>1</script><script>open'
    pages = spark.createDataFrame([(1, page), (2, None), (3, "none")], "page_id long, html string")
    got = facts.islands(pages, "<script[^>]*>", r"</script\s*>").orderBy("n").collect()
    assert [(r["line"], r["attributes"], r["body"]) for r in got] == [(2, "src=a", "\nvar x;"), (3, "", "1"), (3, "", "open")] and all(page[r["start"] :].startswith(r["body"]) for r in got)
    assert [r["body"] for r in facts.islands(spark.createDataFrame([(1, "a <% b %> <%= c %>")], "page_id long, html string"), "<%", "%>").orderBy("n").collect()] == [" b ", "= c "]
    text = "<form method=post><input></form><form method='post'>csrf</form><a href='javascript:x'><iframe src='http://h'></iframe>@Html.Raw(x)"
    checks = facts.page_checks(spark.createDataFrame([(1, page), (2, text)], "page_id long, html string"))
    assert {tuple(r) for r in checks.collect()} == {(1, "inline_handler", 1), (2, "form_without_token", 1), (2, "script_url", 1), (2, "frame_without_sandbox", 1), (2, "plain_resource", 1), (2, "raw_output", 1)}


RULES = [
    {"id": "flask-request", "kind": "source", "capability": "request", "match": {"any": [{"pattern": "request.args.get($NAME)"}, {"pattern": "request.args[$NAME]"}]}},
    {"id": "sql-execute", "kind": "sink", "capability": "query", "cwe": ["CWE-89"], "match": {"any": [{"pattern": "$DB.execute($QUERY, $$$REST)", "captures": {"query": "QUERY"}}, {"pattern": "$DB.execute($QUERY)", "captures": {"query": "QUERY"}}]}},
    {"id": "quote", "kind": "protection", "capability": "quoting", "symbols": [{"canonical": "dblib.safe.quote", "captures": {"value": 0}}]},
    {"id": "shell", "kind": "sink", "capability": "process", "cwe": ["CWE-78"], "symbols": [{"canonical": "subprocess.run", "captures": {"command": 0}}]},
]
SOURCE = '''from dblib.safe import quote as q
import subprocess

def direct(db):
    db.execute("select " + request.args.get("a"))

def quoted(db):
    db.execute(q(request.args["b"]))

def flow(db):
    x = request.args.get("c")
    y = "select " + x
    db.execute(y)

def killed(db):
    x = request.args.get("c")
    x = "fixed"
    db.execute(x)

def branch(db):
    x = request.args.get("c")
    if x:
        y = x
    db.execute(y)

def other():
    subprocess.run(request.args.get("d"))
    local.run(request.args.get("e"))
'''
RELATIONS = [
    {"id": "sql", "version": 1, "source": {"capability": "request"}, "sink": {"capability": "query", "input_roles": ["query"]}, "protection": {"capability": "quoting", "application": "value_transform", "relation_role": "value"}, "cwe_candidates": ["CWE-89"], "strategy": "bounded_local_value"},
    {"id": "cmd", "version": 1, "source": {"capability": "request"}, "sink": {"capability": "process", "input_roles": ["command"]}, "cwe_candidates": ["CWE-78"], "strategy": "bounded_local_value"},
]


def test_scans_from_sources_to_paths(spark):
    sources = spark.createDataFrame([("a.py", SOURCE), ("bad.py", "def (")], "path string, text string")
    tree = code.nodes(sources).cache()
    evidence = scanning.scan(sources, RULES, tree).cache()
    rows = evidence.collect()
    assert sorted((r["rule"], r["scope"].split(":")[0]) for r in rows if r["kind"] != "source") == [("quote", "quoted"), ("shell", "other"), *[("sql-execute", s) for s in ("branch", "direct", "flow", "killed", "quoted")]]
    assert all(SOURCE[c["start"] : c["stop"]] == c["text"] for r in rows for c in r["captures"]) and len({r["id"] for r in rows}) == len(rows)
    catalog = relations.catalog(spark, RELATIONS, scanning.roles(RULES))
    edges = scanning.assignments(tree)
    assert {(r["left"], r["right"], r["conditional"]) for r in edges.where("scope like 'branch%'").collect()} == {("x", "request", False), ("y", "x", True)}
    paths = relations.security_paths(evidence, catalog, scanning.reached(evidence, edges))
    by = {r["id"]: r["scope"].split(":")[0] for r in rows}
    assert sorted((by[r["sink"]], r["state"], r["relation"]) for r in paths.collect()) == [("direct", "direct", "sql"), ("flow", "propagated", "sql"), ("other", "direct", "cmd"), ("quoted", "protected", "sql")]
    assert scanning.catalog(spark, RULES).count() == 4 and scanning.roles(RULES)["query"] == {"query"}
    for bad in ({"id": "x", "kind": "nope"}, {"id": "x", "kind": "sink"}, {"id": "x", "kind": "sink", "match": {"any": [{"pattern": "f($A)", "captures": {"r": "B"}}]}}, {"id": "x", "kind": "sink", "confidence": "sure"}):
        with pytest.raises(ValueError):
            scanning.check([bad | {"capability": "c"}])
    with pytest.raises(ValueError):
        scanning.check([RULES[0], RULES[0]])
    sites = code.resolved(code.calls(tree), code.imports(tree))
    assert [r["callee"] for r in facts.exact_symbols(sites, ["dblib.safe.quote"]).collect()] == ["q"]
    bindings = spark.createDataFrame([("a.py", "local", "shop.Runner"), ("a.py", "db", "x.Db"), ("a.py", "db", "y.Db")], "doc string, name string, canonical string")
    assert {r["callee"] for r in facts.receiver_gate(sites, bindings, ["shop.Runner", "x.Db"]).collect()} == {"local.run"}


def test_admission_and_timing(spark):
    rows = [("a", "sink", "query", [], None), ("b", "sink", "query", ["closed-query"], None), ("c", "source", "request", [], None), ("d", "sink", "logging", [], "unreachable"), ("e", "source", "request", [], None), ("f", "note", "x", ["comment"], None)]
    evidence = spark.createDataFrame(rows, "id string, kind string, capability string, tags array<string>, reachability string")
    paths = spark.createDataFrame([("c", "a", [])], "source string, sink string, protections array<string>")
    got = {r["id"]: (r["disposition"], r["reason"], r["excluded_from_comprehensive"]) for r in facts.admission(evidence, paths).collect()}
    assert got == {"a": ("review", None, None), "b": ("inventory_only", "closed_operand", None), "c": ("review", None, None), "d": ("inventory_only", "unconnected_log", "unreachable"), "e": ("inventory_only", "context_only", None), "f": ("review", None, "comment")}
    rules = spark.createDataFrame([("a", "js"), ("b", "js"), ("a", "py")], "id string, language string")
    assert facts.compiled_rules(rules, {"js": ["a"]}).count() == 2
    assert facts.pass_timing(spark.createDataFrame([("p", 2), ("p", 3)], "name string, microseconds long")).first()[:] == ("p", 2, 5)


def test_modules_and_links(spark):
    files = spark.createDataFrame([("package.json", '{"name": "root"}'), ("lib/ui/package.json", '{"name": "@org/ui", "main": "src/main.js"}'), ("lib/copy/ui/package.json", '{"name": "@org/ui"}'), ("lib/ui/src/main.js", ""), ("lib/ui/x.ts", ""), ("app/a.ts", ""), ("app/b/index.js", ""), ("app/c.js", ""), ("app/c.ts", "")], "path string, text string")
    known = facts.packages(files)
    assert {tuple(r) for r in known.collect()} == {("root", "", "index"), ("@org/ui", "lib/ui/", "src/main.js")}
    rows = [("app/a.ts", s) for s in ("./b", "./c", "../lib/ui/x", "@org/ui", "@org/ui/x", "react", "./gone", "../../../c")]
    got = {r["specifier"]: r["target"] for r in facts.module_targets(spark.createDataFrame(rows, "path string, specifier string"), files, known).collect()}
    assert got == {"./b": "app/b/index.js", "./c": "app/c.ts", "../lib/ui/x": "lib/ui/x.ts", "@org/ui": "lib/ui/src/main.js", "@org/ui/x": "lib/ui/x.ts", "react": None, "./gone": None, "../../../c": None}
    opened = spark.createDataFrame([("1", "a", "f", "g"), ("2", "b", "f", "g"), ("3", "c", "f", "h")], "id string, symbol string, path string, function string")
    closed = spark.createDataFrame([("a", None), ("b", "g"), ("c", "g")], "symbol string, function string")
    assert [r["id"] for r in facts.unreleased(opened, closed).collect()] == ["3"]


MORE = '''import subprocess
from flask import request
from dblib.safe import quote
u = v = request.args.get("m")
db.execute(v + "x")
w = "a" + u
subprocess.run(w)
class Box:
    @wrap("x")
    def put(self):
        a = request.args.get("é")
        def inner():
            b = request.args.get("f")
            subprocess.run(b, a)
        if a:
            a = "none"
        db.execute(a)
    async def get(self): a, b = request.args.get("g"), 1; c = a; db.execute(quote(request.args.get(c)))

def long():
    x = request.args.get("h")
    x = x + "1"
    a = x
    b = a
    c = b
    db.execute(c)
    d = c
    db.execute(d)
'''


def test_paths_in_one_pass_equal_those_of_the_tables(spark):
    sources = spark.createDataFrame([("a.py", SOURCE), ("b.py", MORE), ("c.py", MORE.replace("from flask import request\n", "") + SOURCE), ("d.py", SOURCE + MORE), ("e.py", "def ("), ("f.py", None), ("g.py", SOURCE)], "path string, text string")
    contracts = [*RELATIONS, RELATIONS[0] | {"id": "same", "protection": {"capability": "quoting", "application": "related_capture", "relation_role": "query"}}]
    tree = code.nodes(sources).cache()
    evidence = scanning.scan(sources, RULES, tree).cache()
    slow = relations.security_paths(evidence, relations.catalog(spark, contracts, scanning.roles(RULES)), scanning.reached(evidence, scanning.assignments(tree)))
    fast = scanning.paths(sources, RULES, contracts)
    assert fast.dtypes == slow.dtypes
    by = {r["id"]: r for r in slow.collect()}
    found = fast.collect()
    assert len(found) == len(by) and {r["id"]: r for r in found} == by
    assert {r["state"] for r in found} == {"direct", "protected", "propagated"} and {r["hops"] for r in found} >= {0, 1, 4} and len({r["path"] for r in found}) == 5
    deep = relations.security_paths(evidence, relations.catalog(spark, contracts), scanning.reached(evidence, scanning.assignments(tree), 2))
    assert sorted(r["id"] for r in scanning.paths(sources, RULES, contracts, 2).collect()) == sorted(r["id"] for r in deep.collect()) != sorted(by)
    with pytest.raises(ValueError):
        scanning.paths(sources, RULES, [RELATIONS[0] | {"strategy": "none"}])


def test_source_scans_have_no_joins(spark):
    import __spark_entry__

    plan = __spark_entry__.queries()["source_scans"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
