"""Code trees, patterns, rules, transforms and fixes on hand-made sources."""

import itertools
import re
import tokenize

import pytest
from pyspark.sql import functions as F

from scanlattice.operators import code, rules

SOURCE = '''import os.path
import numpy as np
from a.b import c as d, e

# a comment
class Box(Base):
    def first(self, x, y=1):
        if x == x:
            print(x, y)  # trailing
            os.path.join(x, y)
        return d(x)

    @property
    def second(self):
        np.load(self.name)
        print("a")
        return [print(z) for z in range(3)]


def alone():
    pass
'''


def found(pattern, source, strictness="smart", selector=None):
    p = code.Pattern(pattern, strictness, selector)
    out = []
    for node in code.parse(source).walk():
        env = p.match(node)
        if env is not None:
            out.append({k: v.text if isinstance(v, code.Node) else [x.text for x in v] for k, v in env.items()})
    return out


@pytest.mark.parametrize(
    "pattern, source, want",
    [
        ("$A + $A", "x = 1+1; y = 1+2; z = f(a)+f( a )", [{"A": "1"}, {"A": "f( a )"}]),
        ("f($$$ARGS)", "f(1, 2); f(); g(1)", [{"ARGS": ["1", "2"]}, {"ARGS": []}]),
        ("f($A, $$$B)", "f(1, 2, 3)", [{"A": "1", "B": ["2", "3"]}]),
        ("f($$$, $B)", "f(1, 2, 3); f(1)", [{"B": "3"}, {"B": "1"}]),
        ("f($A)", "f(a, b); f(a,)", [{"A": "a"}]),
        ("def $F($$$P): return $X", "def g(a, b): return a\ndef h(): return 1", [{"F": "g", "P": ["a", "b"], "X": "a"}, {"F": "h", "P": [], "X": "1"}]),
        ("if $C: $$$B", "if a:\n  x()\n  y()", [{"C": "a", "B": ["x()", "y()"]}]),
        ("$A.$B", "x.y.z", [{"A": "x.y", "B": "z"}, {"A": "x", "B": "y"}]),
        ("$_ == $_", "a == b", [{}]),
        ("g($$$A, $$$A)", "g(1, 1); g(1, 2)", [{"A": ["1"]}]),
        ("x = $A", "x = y = 1", [{"A": "y"}]),
    ],
)
def test_patterns(pattern, source, want):
    assert found(pattern, source) == want


@pytest.mark.parametrize(
    "strictness, hits",
    [("cst", "100000"), ("smart", "111000"), ("ast", "110000"), ("relaxed", "111000"), ("signature", "111100"), ("template", "111000")],
)
def test_strictness(strictness, hits):
    sources = ("f(a)", "f(a,)", "f(  # why\n a)", "g(b)", "f(a, b)", "f()")
    assert "".join(str(int(bool([x for x in code.parse(s).walk() if code.Pattern("f(a)", strictness).match(x) is not None and x.kind == "Call"]))) for s in sources) == hits


def test_contextual_patterns_and_errors():
    assert found("class X:\n  $A = $B", "class Y:\n  p = 1\nq = 2", selector="Assign") == [{"A": "p", "B": "1"}, {"A": "q", "B": "2"}]
    for bad in (("a b", "smart", None), ("x", "nope", None), ("x = 1; y = 2", "smart", None), ("x", "smart", "Call")):
        with pytest.raises(ValueError):
            code.Pattern(*bad)
    assert code.variable("$$A") == ("one", "A", False) and code.variable("$a") is None and code.variable("$$$_X") == ("many", "", True) and code.variable("$1") is None


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([("pkg/box.py", SOURCE), ("bad.py", "def ("), ("empty.py", ""), ("none.py", None), ("ü.py", "é = 'ü' + é\n")], "path string, text string")


@pytest.fixture(scope="module")
def tree(spark, sources, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('t')}/nodes"
    code.nodes(sources).write.parquet(path)
    return spark.read.parquet(path)


def test_node_tables_cover_their_sources(spark, sources, tree):
    assert {r["doc"] for r in tree.select("doc").distinct().collect()} == {"pkg/box.py", "empty.py", "none.py", "ü.py"}
    for r in tree.where("doc in ('pkg/box.py', 'ü.py')").collect():
        text = SOURCE if r["doc"] == "pkg/box.py" else "é = 'ü' + é\n"
        assert text[r["start"] : r["stop"]] == r["text"] and r["line"] == text.count("\n", 0, r["start"])
    leaves = [r["text"] for r in tree.where("doc = 'pkg/box.py' and pre = last").orderBy("pre").collect()]
    assert "".join("".join(leaves).split()) == "".join(SOURCE.split())
    assert [r["doc"] for r in code.failures(sources).collect()] == ["bad.py"]


def texts(rows):
    return sorted(r["text"].split("\n")[0] for r in rows.select("text").collect())


def test_rules(spark, sources, tree):
    specs = {
        "atomic": ({"kind": "Call", "regex": "^print"}, ['print("a")', "print(x, y)", "print(z)"]),
        "pattern": ({"pattern": "print($A)"}, ['print("a")', "print(z)"]),
        "range": ({"kind": "Call", "range": {"start": {"line": 8, "column": 12}, "end": {"line": 8, "column": 23}}}, ["print(x, y)"]),
        "inside": ({"kind": "Call", "regex": "^print", "inside": {"kind": "If", "stopBy": "end"}}, ["print(x, y)"]),
        "neighbor": ({"kind": "Call", "inside": {"kind": "Return"}}, ["d(x)"]),
        "field": ({"kind": "Compare", "inside": {"kind": "If", "field": "test"}}, ["x == x"]),
        "stop": ({"kind": "Call", "regex": "^print", "inside": {"kind": "ClassDef", "stopBy": {"kind": "If"}}}, ['print("a")', "print(z)"]),
        "has": ({"kind": "FunctionDef", "has": {"pattern": "print($$$)", "stopBy": "end"}}, ["@property", "def first(self, x, y=1):"]),
        "has_stop": ({"kind": "FunctionDef", "has": {"kind": "Call", "regex": "^print", "stopBy": {"kind": "If"}}}, ["@property"]),
        "has_stop_itself": ({"kind": "FunctionDef", "has": {"kind": "If", "stopBy": {"kind": "If"}}}, ["def first(self, x, y=1):"]),
        "precedes": ({"kind": "FunctionDef", "precedes": {"kind": "FunctionDef"}}, ["def first(self, x, y=1):"]),
        "follows": ({"kind": "FunctionDef", "follows": {"kind": "ImportFrom", "stopBy": "end"}}, ["def alone():"]),
        "follows_stop": ({"kind": "FunctionDef", "follows": {"kind": "Import", "stopBy": {"kind": "ImportFrom"}}}, []),
        "any_not": ({"any": [{"kind": "Import"}, {"kind": "ImportFrom"}], "not": {"regex": "numpy"}}, ["from a.b import c as d, e", "import os.path"]),
        "nth": ({"kind": "arg", "nthChild": {"position": "2n+1", "ofRule": {"kind": "arg"}}}, ["self", "self", "y"]),
        "nth_last": ({"kind": "arg", "nthChild": {"position": 1, "reverse": True, "ofRule": {"kind": "arg"}}}, ["self", "y"]),
        "where": ({"kind": "Call", "where": lambda nodes: F.length("text") > 15}, ["np.load(self.name)", "os.path.join(x, y)"]),
        "util": ({"matches": "printing", "inside": {"matches": {"name": "within", "KIND": "If"}, "stopBy": "end"}}, ["print(x, y)"]),
    }
    utilities = {"printing": {"kind": "Call", "regex": "^print"}, "within": {"arguments": ["KIND"], "rule": {"kind": "$KIND"}}}
    patterns = rules.patterns_of([s for s, _ in specs.values()])
    engine = rules.Engine(tree, code.matches(sources, patterns), utilities)
    for name, (spec, want) in specs.items():
        assert texts(engine.nodes(spec)) == want, name
    for bad in ({"nope": 1}, {"matches": "absent"}, {"matches": {"name": "within", "OTHER": "If"}}):
        with pytest.raises(ValueError):
            engine.nodes(bad)
    with pytest.raises(ValueError):
        rules.Utilities({"a": {"matches": "b"}, "b": {"any": [{"matches": "a"}]}})


def test_captures_constraints_transforms_and_fixes(spark, sources, tree):
    pattern = "print($A)"
    found = code.matches(sources, rules.patterns_of({"pattern": pattern}))
    engine = rules.Engine(tree, found)
    assert [r["captures"]["A"]["text"] for r in engine.captured(pattern, {"A": {"kind": "Constant"}}).collect()] == ['"a"']
    transforms = {"SHOUT": {"source": "$CUT", "convert": "upper"}, "CUT": {"source": "$A", "replace": ['"', "'"]}}
    assert rules.order(transforms) == ["CUT", "SHOUT"]
    made = rules.transformed(engine.captured(pattern), transforms)
    assert sorted(r[0] for r in made.select(rules.interpolated("$SHOUT of $A")).collect()) == ["'A' of \"a\"", "Z of z"]
    with pytest.raises(ValueError):
        rules.order({"X": {"source": "$Y"}, "Y": {"source": "$X"}})
    patched = {r["path"]: r["text"] for r in rules.applied(sources, rules.edits(made, "log($A, $SHOUT)")).collect()}
    assert patched["pkg/box.py"] == SOURCE.replace('print("a")', "log(\"a\", 'A')").replace("print(z)", "log(z, Z)") and patched["none.py"] is None and patched["bad.py"] == "def ("
    for config in ({"rule": {"pattern": pattern}, "message": "$B"}, {"rule": {"pattern": pattern}, "constraints": {"Z": {"kind": "x"}}}, {"rule": {"kind": "Call"}, "fix": "$A"}):
        with pytest.raises(ValueError):
            rules.check_variables(config)
    rules.check_variables({"rule": {"pattern": pattern}, "transform": transforms, "fix": "$SHOUT", "labels": {"A": {}}})
    spans = rules.labels(engine.captured(pattern), {"A": {"style": "secondary", "message": "here"}}).select(F.explode("labels").alias("l")).select("l.*").collect()
    assert {SOURCE[r["start"] : r["stop"]] for r in spans} == {'"a"', "z"}


def test_indent_expansion_and_rewriting(spark):
    docs = spark.createDataFrame([("m.py", "def f():\n    if a:\n        x = [\n            1,\n            g(2), g(g(3)),\n        ]\n")], "path string, text string")
    tree = code.nodes(docs)
    found = code.matches(docs, rules.patterns_of([{"pattern": "x = $V"}, {"pattern": "g($N)"}]))
    engine = rules.Engine(tree, found)
    fixed = rules.applied(docs, rules.edits(engine.captured("x = $V"), "with y:\n    z = $V")).first()["text"]
    assert fixed == "def f():\n    if a:\n        with y:\n    z = [\n        1,\n        g(2), g(g(3)),\n    ]\n"
    inner = rules.edits(engine.captured("g($N)"), "h($N)")
    assert rules.rewritten(engine.captured("x = $V"), "V", inner).first()["text"] == "[\n            1,\n            h(2), h(g(3)),\n        ]"
    assert rules.rewritten(engine.captured("x = $V"), "V", inner, "; ").first()["text"] == "h(2); h(g(3))"
    gone = rules.expanded(tree.where("kind = 'Constant' and text = '1'").select("doc", "start", "stop", F.lit("").alias("text")), tree, "^,$")
    assert rules.applied(docs, gone).first()["text"] == docs.first()["text"].replace("1,", "")
    assert spark.range(1).select(rules.indented(F.lit("a\nb\n  c"), 2), rules.indented(F.lit("a\n    b\n  c"), -3)).first()[:] == ("a\n  b\n    c", "a\n b\nc")


def test_findings_by_config(spark, sources, tree):
    configs = [
        {"id": "same", "rule": {"pattern": "$A == $A"}, "message": "$A twice", "severity": "error"},
        {"id": "elsewhere", "rule": {"kind": "Call"}, "files": ["lib/**"]},
        {"id": "ignored", "rule": {"kind": "Call"}, "ignores": ["pkg/*"]},
        {"id": "off", "rule": {"kind": "Call"}, "severity": "off"},
        {"id": "here", "rule": {"kind": "Return"}, "files": ["pkg/*.py"], "message": "leaves"},
    ]
    got = rules.findings(sources, configs, tree=tree).orderBy("line").collect()
    assert [(r["rule"], r["severity"], r["message"], r["line"]) for r in got] == [("same", "error", "x twice", 7), ("here", "hint", "leaves", 10), ("here", "hint", "leaves", 16)]
    assert rules.load('{"id": "a"}') == [{"id": "a"}]


def test_outline_imports_and_calls(tree):
    symbols = code.outline(tree)
    own = rules.outline(rules.Engine(tree), [{"symbol": "method", "rule": {"kind": "FunctionDef", "inside": {"kind": "ClassDef"}}}, {"symbol": "function", "rule": {"kind": "FunctionDef"}}, {"symbol": "class", "rule": {"kind": "ClassDef"}}])
    assert sorted((r["symbol"], r["name"]) for r in own.collect()) == [("class", "Box"), ("function", "alone"), ("method", "first"), ("method", "second")]
    assert sorted((r["container"], r["name"]) for r in symbols.collect()) == [("", "Box"), ("", "alone"), ("Box", "first"), ("Box", "second")]
    places = tree.sparkSession.createDataFrame([("pkg/box.py", 8), ("pkg/box.py", 5), ("pkg/box.py", 0)], "doc string, line int")
    assert {r["line"]: r["symbol"] and r["symbol"]["name"] for r in code.enclosing(symbols, places).collect()} == {8: "first", 5: "Box", 0: None}
    own = code.imports(tree)
    assert sorted(tuple(x or "" for x in r[2:]) for r in own.collect()) == sorted([("os.path", "", "os"), ("numpy", "", "np"), ("a.b", "c", "d"), ("a.b", "e", "e")])
    got = {(r["callee"], r["canonical"], tuple(r["arguments"])) for r in code.resolved(code.calls(tree), own).collect()}
    assert {("os.path.join", "os.path.join", ("x", "y")), ("np.load", "numpy.load", ("self.name",)), ("d", "a.b.c", ("x",)), ("range", "range", ("3",))} <= got


@pytest.mark.parametrize(
    "source, cut",
    [
        ("a = f(1)\na = f(1)\nif x:\n  a = f(1)\nelse:\n  # c\n  b\n# d\n\n@d\ndef g(): return 1; z\n", 4), ("x = [\n1,\n2]\ny\n", 1), ("x = '''\na\n'''\ny\n", 1), ("x \\\n= 1\ny\n", 1), ("def f():\n  a\n# c\n  b\nx\n", 2), ("try:\n  a\nexcept B:\n  b\nfinally:\n  c\né = 'ü'; é\nz", 3),
        ("x\n@d(\n 1)\ndef f(): pass\n", 1), ("", 1), ("  # only\n", 1), ("x\r\ny\n", 1), ("match x:\n  case 1:\n    a\ncase(2)\n", 2),
    ],
)
def test_parts_of_sources_are_the_source(source, cut):
    split = code.parts(source)
    assert len(split) == cut and "".join(p.text for p, *_ in split) == source
    assert [list(r) for r in code._joined(source)] == code.rows(code.parse(source), source)


def test_repeated_statements_are_parsed_once(monkeypatch):
    code._PARTS.clear()
    asked = []
    parse = code.parse
    monkeypatch.setattr(code, "parse", lambda text: asked.append(text) or parse(text))
    for n in range(50):
        code.parts(f"import os\nrun(1)\nrun({n % 2})\n")
    assert sorted(asked) == ["import os\n", "run(0)\n", "run(1)\n"]
    with pytest.raises((SyntaxError, tokenize.TokenError)):
        code.parts("import os\nrun(\n")


def test_matches_across_parts_have_the_places_of_the_source(spark):
    text = "import os\nrun(1)\nif a:\n    x = run(1, 'é')\n\nrun(1)\n"
    docs = spark.createDataFrame([("a", text), ("b", None), ("c", "run(")], "path string, text string")
    rows = code.matches(docs, {"r": "run($$$A)"}).orderBy("start").collect()
    tree = {(r["pre"], r["last"], r["start"], r["stop"], r["line"], r["text"]) for r in code.nodes(docs).where("doc = 'a' and kind = 'Call'").collect()}
    assert {(r["pre"], r["last"], r["start"], r["stop"], r["line"], r["text"]) for r in rows} == tree and len(rows) == 3
    assert all(text[c["start"] : c["stop"]] == c["text"] in ("1", "1, 'é'") for c in (r["captures"]["A"] for r in rows)) and [r["captures"]["A"]["indent"] for r in rows] == [0, 4, 0]
    assert [r[:] for r in code.matches(docs, {"r": "run($$$A)"}, columns=["rule"]).collect()] == [("a", "r")] * 3
    assert [len(r["found"]) for r in code.matched(docs, {"r": "run($$$A)"}).orderBy("path").collect()] == [3, 0, 0]
    assert [r["text"] for r in code.matches(docs, {"r": "$A"}, columns=["pre", "text"]).where("pre = 0 and doc = 'a'").collect()] == [text]


def test_fixes_in_one_pass(spark, sources):
    more = sources.unionByName(spark.createDataFrame([("nested.py", "g(g(1))\nif a:\n    g([\n        1,\n    ])\ng(2); g(3)\n"), (None, "g(4)\n")], "path string, text string"))
    transforms = {"SHOUT": {"source": "$A", "convert": "upper"}}
    for pattern, template in (("g($A)", "h($SHOUT,\n  $A)"), ("print($A)", "log($A)  # $SHOUT")):
        found = rules.transformed(code.matches(more, rules.patterns_of({"pattern": pattern})), transforms)
        want = {r["path"]: r["text"] for r in rules.applied(more, rules.edits(found, template)).collect() if r["path"]}
        got = {r["path"]: r["text"] for r in rules.fixed(more, pattern, template, transforms).collect()}
        assert got.pop(None) == ("h(4,\n  4)\n" if pattern[0] == "g" else "g(4)\n")
        assert got == want and got["none.py"] is None and got["bad.py"] == "def ("
    with pytest.raises(ValueError):
        rules.fixed(more, "g($A)", "$B")
    with pytest.raises(ValueError):
        rules.fixed(more, "g($A)", "$S", {"S": {"source": "$A", "convert": "snake"}})


def test_sites_in_one_pass_are_those_of_the_node_table(spark, sources):
    more = sources.unionByName(spark.createDataFrame([("m.py", "import a.b, c.d as e\nfrom  . x import (y as z,\n  w)\na.b.f(1, *p, k=2)\ne.g(\n  1)\nz(w(3))(4)\nfrom q import w\nw()\n")], "path string, text string"))
    tree = code.nodes(more)
    want, got = code.resolved(code.calls(tree), code.imports(tree)), code.sites(more)
    order = lambda rows: sorted(map(str, rows.select("doc", *code.SITES).collect()))
    assert order(got) == order(want) and got.count() > 12 and code.sites(more, columns=["method"]).columns == ["doc", "method"]


def test_rules_in_one_pass_are_those_of_the_node_table(spark, sources, tree):
    b = "a = 1\nb = 2\nif c:\n    a = p(1, 2)\n    b = p(2)\n# x\na = p(1)\n\nif d:\n    pass\nb = 2\nb = 2\n"
    more = sources.unionByName(spark.createDataFrame([("s.py", b), ("w.py", "x = '''\n'''\n" + b), ("one.py", "a")], "path string, text string"))
    nodes = code.nodes(more).localCheckpoint()
    utilities = {"call": {"kind": "Call", "regex": "^p"}, "within": {"arguments": ["KIND"], "rule": {"inside": {"kind": "$KIND", "stopBy": "end"}}}}
    assign = {"kind": "Assign"}
    specs = [
        {"kind": "Call", "regex": "^p"}, {"matches": "call", "not": {"inside": {"kind": "If"}}}, {"matches": {"name": "within", "KIND": "If"}, "kind": "Call"}, {**assign, "precedes": {"kind": "If"}}, {**assign, "follows": {"kind": "If", "stopBy": "end"}}, {**assign, "follows": {"kind": "If", "stopBy": {"regex": "^b"}}},
        {**assign, "nthChild": {"position": "2n+1", "ofRule": assign}}, {"any": [assign, {"kind": "If"}], "inside": {"kind": "Module"}, "nthChild": {"position": 1, "reverse": True}}, {"kind": "If", "has": {"pattern": "p(1, $$$)", "stopBy": "end"}}, {"kind": "FunctionDef", "has": {"kind": "Call", "regex": "^print", "stopBy": {"kind": "If"}}},
        {"kind": "Compare", "inside": {"kind": "If", "field": "test"}}, {"kind": "Call", "inside": {"kind": "Module", "has": {"kind": "Pass", "stopBy": "end"}, "stopBy": "end"}}, {"regex": "^a$"}, {"kind": "Module"}, {"kind": "If", "range": {"start": {"line": 2, "column": 0}, "end": {"line": 4, "column": 12}}}, {"kind": "Call", "inside": {"kind": "ClassDef", "stopBy": {"kind": "If"}}},
    ]
    engine = rules.Engine(nodes, code.matches(more, rules.patterns_of(specs)), utilities)
    got = {}
    for r in rules.hits(more, {str(k): {"rule": s} for k, s in enumerate(specs)}, utilities).collect():
        got.setdefault(int(r["rule"]), []).append((r["doc"], r["pre"], r["last"], r["start"], r["stop"], r["line"], r["text"]))
    for k, s in enumerate(specs):
        want = sorted(tuple(r) for r in engine.nodes(s).select("doc", "pre", "last", "start", "stop", "line", "text").collect())
        assert sorted(got.get(k, [])) == want and want, s
    pattern, constraints = "$A = $B", {"A": {"regex": "^[ax]$"}, "B": {"kind": "Call"}}
    found = rules.Engine(nodes, code.matches(more, rules.patterns_of({"pattern": pattern}))).captured(pattern, constraints)
    one = rules.hits(more, {"r": {"rule": {"pattern": pattern}, "constraints": constraints}})
    order = lambda rows: sorted((r["doc"], r["pre"], str(sorted(r["captures"].items()))) for r in rows.collect())
    assert order(one) == order(found) and one.count() == 4
    for bad in ({"kind": "Call", "where": len}, {"regex": r"\p{L}"}, {"nope": 1}, {"matches": "absent"}):
        with pytest.raises(ValueError):
            rules.hits(more, {"r": {"rule": bad}}, utilities)


def test_findings_in_one_pass_are_those_of_the_node_table(spark, sources):
    configs = [
        {"id": "same", "rule": {"pattern": "$A == $A"}, "transform": {"B": {"source": "$A", "replace": ["x", "y"]}}, "message": "$A twice, or $B", "severity": "error"}, {"id": "elsewhere", "rule": {"kind": "Call"}, "files": ["lib/**"]}, {"id": "ignored", "rule": {"kind": "Call"}, "ignores": ["pkg/*"]},
        {"id": "off", "rule": {"kind": "Call"}, "severity": "off"}, {"id": "here", "rule": {"matches": "leaving"}, "files": ["pkg/*.py"], "message": "leaves"},
    ]
    utilities = {"leaving": {"kind": "Return"}}
    want, got = rules.findings(sources, configs, utilities, tree=code.nodes(sources)), rules.findings(sources, configs, utilities)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 3
    plan = got._jdf.queryExecution().toString()
    assert "Join" not in plan and plan.count("MapInArrow") < want._jdf.queryExecution().toString().count("MapInArrow")


def test_counts_of_each_source_equal_its_matches(spark):
    texts = ["f(1)\nf(2)\n", "@w\n@v\ndef g(x):\n    return f(x)\nf(3)", "if f(1):\n    f(2)\nelse:\n    f(3)\n", "a = '''\nf(9)\n'''\nf(1)", "f(1) \\\n  + f(2)\nf(1)\n", "f(", "", None, "# f(1)\nf(2)  # f(3)\n", "x = 1\r\nf(4)\n"]
    sources = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts * 2)], "path string, text string").repartition(1)
    patterns = {"any": "f($A)", "one": {"pattern": "f(1)", "strictness": "cst"}}
    counts = code.counted(sources, patterns)
    assert counts.dtypes == [("doc", "string"), ("any", "bigint"), ("one", "bigint")]
    got = sorted(map(tuple, counts.collect()))
    found = code.matches(sources, patterns).collect()
    assert got == sorted((str(k), *(sum(r["doc"] == str(k) and r["rule"] == n for r in found) for n in patterns)) for k in range(2 * len(texts)))
    assert [x[1:] for x in sorted(got, key=lambda x: int(x[0]))[:10]] == [(2, 1), (2, 0), (3, 1), (1, 1), (3, 2), (0, 0), (0, 0), (0, 0), (1, 0), (1, 0)]


def test_cuts_stand_where_statements_begin():
    begin = re.compile(r"^(?:@[^\n]*\n)*(?!elif\b|else\b|except\b|finally\b)[^\s#)\]}]", re.M)
    lines = ["a = 1", "@w", "", "# c", "  b", "else:", "elsewhere()", ")", "def f():", "finally", "\tx"]
    for chosen in itertools.product(lines, repeat=4):
        source = "\n".join(chosen)
        cuts = [m.start() for m in begin.finditer(source)][1:]
        assert code._cut(source) == [source[a:b] for a, b in zip([0, *cuts], [*cuts, len(source)])]


def test_code_strictness_deals_sources_out_once(spark):
    import __spark_entry__

    plan = __spark_entry__.queries()["code_strictness"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan
