"""Operators of the engine on hand-made frames with the results that their definitions give."""

import json
import os

import pytest
from pyspark.sql import functions as F

from scanlattice.functions import text as T
from scanlattice.operators import advisories, budgets, credentials, evaluation, ledgers, lookups, queues, relations, reports, state
from scanlattice.sources import repository


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


# --- credentials -----------------------------------------------------------------------------------

TOKEN = "ghp_" + "a1B2c3D4e5" * 3 + "f6G7h8"
RANDOM = "q8Zr2LmX9vTb4WnK"


@pytest.mark.parametrize(
    "line, found",
    [
        (f"x {TOKEN} y", ["github_personal_access_token"]),
        (f"x {TOKEN}0 y", []),
        (f"a{TOKEN}", []),
        (f"_{TOKEN}", ["github_personal_access_token"]),
        (TOKEN[:4] + "example" + TOKEN[11:], []),
        ("glpat-" + "a1-B_" * 4, ["gitlab_personal_access_token"]),
        ("glpat-" + "a1-B_" * 3, []),
        ("xoxb-" + "1a" * 70, []),
        ('password = "aaaaaaaaaaaaaaaaaaaa"', []),
        ('password = "3f2b8c1e-9d47-4a6b-8e21-0c5d7f9a1b3e"', []),
        ('password = "https://user:Xy9Kq2@host/p4th"', []),
        (f'PASSWORD = "{RANDOM}"', [credentials.GENERIC]),
        (f"my_api_key: {RANDOM}, next", [credentials.GENERIC]),
        (f"if password == '{RANDOM}':", []),
        (f"secret => '{RANDOM}'", []),
        (f"'a=b' secret='{RANDOM}'", [credentials.GENERIC]),
        (f"'secret' + x = {RANDOM}", [credentials.GENERIC]),
        (f"name = '{RANDOM}'", []),
        (f"client_secret=`{RANDOM}`", [credentials.GENERIC]),
        (f"secret = {RANDOM}//x", [credentials.GENERIC]),
        ("secret = fake" + RANDOM, []),
        ("secret = " + "ab1" * 6, []),
        (f'secret = "{RANDOM} {RANDOM}"', []),
        (f"auth_token = {TOKEN}", ["github_personal_access_token"]),
        ("secret =", []),
        ("secret", []),
    ],
)
def test_credential_lines(line, found):
    assert [d for _, _, d, _ in credentials.candidates(line.encode())] == found


def test_credentials_are_suppressed_counted_and_masked(spark):
    text = f"ü = 1\r\nsecret = '{RANDOM}'\nsecret = '{RANDOM}' # scan: ALLOW\n{TOKEN}"
    files = spark.createDataFrame([("a/x.py", text), ("b/y.py", text), ("none", None), ("empty", "")], "path string, text string")
    found = credentials.detect(files, marker="scan: allow")
    rows = found.where("path = 'a/x.py'").orderBy("start").collect()
    assert [(r["line"], r["suppressed"], r["confidence"], r["length"]) for r in rows] == [(2, False, "medium", 16), (3, True, "medium", 16), (4, False, "high", 40)]
    assert [text.encode()[r["start"] : r["stop"]].decode() for r in rows] == [RANDOM, RANDOM, TOKEN] and rows[0]["entropy_millibits"] == 4000
    assert RANDOM not in str(rows) and rows[0]["fingerprint"] == rows[1]["fingerprint"] != rows[2]["fingerprint"] and len({r["id"] for r in rows}) == 3
    allowed, warnings = credentials.allow_list(f"# x\nfingerprint={rows[2]['fingerprint']}\npath = b/**\ndetector=slack_token\npath=/abs\nnope=1\nfingerprint=zz\nline\n")
    assert len(allowed) == 3 and len(warnings) == 4
    counts = {r["detector"]: (r["reported"], r["suppressed"]) for r in credentials.counts(credentials.detect(files, allowed=allowed)).collect()}
    assert counts == {credentials.GENERIC: (2, 2), "github_personal_access_token": (0, 2)}
    assert value(spark, credentials.masked(F.lit("abcdef"), F.expr("array(named_struct('start', 1L, 'stop', 3L))"))) == "a[REDACTED]def"


# --- repository --------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "path, kind",
    [
        ("src/a.py", "python"), ("src/App.vue", "vue"), ("a.H", "cpp"), (".env", "secret_only"), (".env.local", "secret_only"), ("Dockerfile", "secret_only"), ("x/README.md", "secret_only"), ("a.rb", "unsupported_source"),
        ("Makefile", "ignored"), (".gitignore", "ignored"), ("tests/a.py", "secret_only"), ("a/test_x.py", "secret_only"), ("a/x_test.go", "secret_only"), ("a/contest.py", "python"), ("src/UserTest.java", "secret_only"),
        ("src/main/java/com/example/App.java", "java"), ("example/src/main/java/com/App.java", "secret_only"), ("src/main/kotlin/com/samples/A.kt", "kotlin"), ("src/jvmMain/kotlin/com/samples/A.kt", "kotlin"), ("src/jvmTest/kotlin/A.kt", "secret_only"),
        ("lib/a.min.js", "secret_only"), ("types/a.d.ts", "secret_only"), ("src/app/test/route.ts", "typescript"), ("src/app/test/page.ts", "secret_only"), ("x.spec.ts", "secret_only"), ("A.Designer.cs", "secret_only"), ("testing.java", "secret_only"), ("a.json", "secret_only"),
    ],
)
def test_classes(spark, path, kind):
    assert value(spark, repository.classify(F.lit(path))) == kind


def test_walk_ignores_prunes_and_reads(spark, tmp_path):
    root = tmp_path / "repo.d+x"
    for path, data in {
        "src/a.py": b"x = 1\n", "src/latin.py": "é".encode("latin-1"), "src/zero.py": b"a\x00b", "src/ctl.txt": b"\x01" * 3 + b"a" * 50, "src/big.txt": b"a" * 200, "node_modules/m/a.js": b"1", "src/build/out.js": b"1", ".git/config": b"1",
        ".gitignore": b"*.log\n/src/gen/\n!keep.log\nsub/*.tmp\n# c\n", "a.log": b"1", "keep.log": b"1", "src/gen/x.py": b"1", "src/gen/keep.log": b"1", "other/src/gen/x.py": b"1", "sub/a.tmp": b"1", "src/.gitignore": b"*.py\n!a.py\n", "src/deep/b.py": b"1",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(data)
    uri = f"file://{root}"
    listed = repository.listing(spark, uri)
    assert listed.where("path = 'src/a.py'").count() == 1
    texts = repository.read_texts(listed, 100)
    rules = repository.ignore_rules(texts.select("path", "text"))
    files, pruned = repository.walk(listed, rules=rules)
    assert {r["path"] for r in pruned.collect()} == {"node_modules/", "src/build/"}
    assert {r["path"] for r in files.collect()} == {"src/a.py", "src/ctl.txt", "src/big.txt", ".gitignore", "keep.log", "src/.gitignore", "other/src/gen/x.py"}
    got = {r["path"]: (r["skipped"], r["text"]) for r in texts.collect()}
    assert got["src/a.py"] == (None, "x = 1\n") and got["src/latin.py"] == ("not UTF-8", None) and got["src/zero.py"][0] == got["src/ctl.txt"][0] == "binary content" and "200 bytes is greater than 100" in got["src/big.txt"][0]
    assert {r["path"] for r in repository.walk(listed, selected="src/deep")[0].collect()} == {"src/deep/b.py"}
    for bad in ("/etc", "../x", "c:/x"):
        with pytest.raises(ValueError):
            repository.selection(bad)
    everything = repository.walk(listed)[0].withColumn("skipped", F.lit(None).cast("string")).withColumn("parse_failed", F.col("path") == "src/a.py")
    covered = repository.coverage(everything)
    assert repository.totals(covered).first()[:] == (14, 5, 8, 0, 1, 0, 0)
    assert {r["extension"]: r["non_source"] for r in repository.omitted_by_extension(covered).collect()}["log"] == 3
    os.symlink(root / "src", root / "link")
    assert [r["length"] for r in repository.listing(spark, uri).where("path like 'link%'").collect()] == [None]


def test_changes_between_snapshots(spark):
    before = spark.createDataFrame([("a", "1\n2\n3\n4"), ("gone", "z"), ("old", "moved"), ("same", "s")], "path string, text string")
    after = spark.createDataFrame([("a", "1\nx\ny\n3\n4\n4"), ("new", "n\nm"), ("sub/old", "moved"), ("same", "s")], "path string, text string")
    got = {r["path"]: (r["status"], r["previous_path"], [tuple(x) for x in r["changed_lines"]]) for r in repository.changes(before, after).collect()}
    assert got == {"a": ("modified", None, [(2, 3), (6, 6)]), "new": ("added", None, [(1, 2)]), "gone": ("deleted", None, []), "sub/old": ("renamed", "old", [])}
    assert repository.changed_list(spark, [{"path": "a\\b", "status": "modified", "changed_lines": [(1, 2)]}]).first()["path"] == "a/b"
    with pytest.raises(ValueError):
        repository.changed_list(spark, [{"path": "a", "status": "modified", "changed_lines": [(3, 2)]}])
    assert value(spark, repository.is_generated_javascript(F.lit("a.js"), F.concat(F.repeat(F.lit("x"), 70000), F.lit("\n//# sourceMappingURL=a")))) and not value(spark, repository.is_generated_javascript(F.lit("a.js"), F.repeat(F.lit("x\n"), 70000)))


# --- relations -----------------------------------------------------------------------------------------

CONTRACT = {"id": "sql", "version": 1, "source": {"capability": "request"}, "sink": {"capability": "query", "input_roles": ["query"]}, "protection": {"capability": "parameters", "application": "related_capture", "relation_role": "query"}, "cwe_candidates": ["CWE-89"], "strategy": "bounded_local_value"}
EVIDENCE = "id string, path string, scope string, language string, kind string, capability string, start int, stop int, line int, end_line int, rule string, cwes array<string>, captures array<struct<role:string,text:string,start:int,stop:int>>, reachability string, related array<string>"


def evidence(spark):
    row = lambda id, scope, kind, capability, start, stop, line, captures=(), reach=None, related=(): (id, "f.py", scope, "python", kind, capability, start, stop, line, line, "r", ["CWE-89"] if kind == "sink" else [], list(captures), reach, list(related))
    return spark.createDataFrame([
        row("s1", "f", "source", "request", 12, 18, 1), row("k1", "f", "sink", "query", 10, 30, 1, [("query", "q + s", 11, 25), ("other", "x", 26, 29)]), row("s2", "f", "source", "request", 27, 28, 2), row("s3", "g", "source", "request", 12, 18, 3),
        row("p1", "f", "protection", "parameters", 0, 40, 4, [("query", "q + s", 1, 2)]), row("p2", "g", "protection", "parameters", 0, 40, 4, [("query", "q + s", 1, 2)]), row("k2", "f", "sink", "query", 50, 70, 9, [("query", "name", 55, 60)], None, ("p2",)),
        row("k3", "f", "sink", "query", 10, 31, 1, [("query", "z", 11, 25)], "unreachable"),
    ], EVIDENCE)


def test_paths_by_containment_propagation_and_protection(spark):
    rels, rows = relations.catalog(spark, [CONTRACT]), evidence(spark)
    reached = spark.createDataFrame([("f.py", "f", "s1", "name", 40, 2), ("f.py", "f", "s1", "name", 45, 1), ("f.py", "f", "s2", "name", 60, 1)], "path string, scope string, source string, name string, at int, steps int")
    paths = relations.security_paths(rows, rels, reached)
    got = {(r["source"], r["sink"]): (r["state"], r["hops"], r["protections"]) for r in paths.collect()}
    assert got == {("s1", "k1"): ("protected", 0, ["p1"]), ("s1", "k2"): ("propagated", 1, [])}
    barrier = spark.createDataFrame([("f.py", 11, 20)], "path string, start int, stop int")
    assert relations.security_paths(rows, rels, None, barrier).count() == 0
    report = {r["id"]: r for r in relations.candidates(paths, rows).collect()}
    assert len(report) == 2 and all(r["source_evidence"]["id"] == "s1" for r in report.values())
    assert relations.dangling(paths, rows.where("id != 'p1'")).collect()[0]["evidence"] == "p1"
    with pytest.raises(Exception, match="missing evidence"):
        relations.candidates(paths, rows.where("id != 'p1'")).collect()
    assert {tuple(r) for r in relations.funnel(rows, paths).collect()} >= {("query", 0, 3, 2), ("request", 3, 0, 0)}
    assert {(r["histogram"], r["key"], r["n"]) for r in relations.measurement(rows, paths).collect()} >= {("cwe", "CWE-89", 2), ("capability", "query", 3)}
    rules = spark.createDataFrame([(["CWE-89", "CWE-1"], "go")], "cwes array<string>, language string")
    assert {r["cwe"]: (r["declarative"], r["observed"], r["languages"]) for r in relations.cwe_coverage(rules, rows).collect()} == {"CWE-89": (["go"], ["python"], ["go", "python"]), "CWE-1": (["go"], [], ["go"])}
    assert [r["id"] for r in relations.union(rows.where("kind = 'sink'"), rows).collect()][0] in ("p1", "p2") and relations.union(rows, rows).count() == 8


def test_value_transforms_and_bad_contracts(spark):
    contract = CONTRACT | {"protection": {"capability": "parameters", "application": "value_transform", "relation_role": "query"}}
    rows = evidence(spark).withColumn("start", F.when(F.col("id") == "p1", 11).otherwise(F.col("start"))).withColumn("stop", F.when(F.col("id") == "p1", 24).otherwise(F.col("stop")))
    assert relations.security_paths(rows, relations.catalog(spark, [contract])).first()["state"] == "protected"
    assert relations.security_paths(evidence(spark), relations.catalog(spark, [contract])).first()["state"] == "direct"
    for bad in ({"source": {}}, {"source": {"capability": "a", "capabilities": ["b"]}}, {"source": {"capabilities": ["a", "a"]}}, {"strategy": "x"}, {"protection": {"application": "x"}}):
        with pytest.raises(ValueError):
            relations.catalog(spark, [CONTRACT | bad])
    with pytest.raises(ValueError):
        relations.catalog(spark, [CONTRACT], {"query": {"other"}})
    assert relations.catalog(spark, [CONTRACT], {"query": {"query"}}).count() == 1


def test_changes_keep_paths_with_what_they_need(spark):
    rows = evidence(spark)
    paths = relations.security_paths(rows, relations.catalog(spark, [CONTRACT]), spark.createDataFrame([("f.py", "f", "s1", "name", 45, 1)], "path string, scope string, source string, name string, at int, steps int"))
    changed = lambda ranges: spark.createDataFrame([("f.py", "modified", None, ranges)], "path string, status string, previous_path string, changed_lines array<struct<low:int,high:int>>")
    kept, own = relations.changed_results(rows, paths, changed([(9, 9)]))
    assert [(r["source"], r["sink"]) for r in own.collect()] == [("s1", "k2")] and {r["id"] for r in kept.collect()} == {"s1", "k2", "p2"}
    assert relations.changed_results(rows, paths, changed([]))[1].count() == 2 and relations.changed_results(rows, paths, changed([(5, 8)]))[1].count() == 0
    files = spark.createDataFrame([(p,) for p in ("a/x.py", "a/y.py", "b/z.py", "c/w.py", *(f"big/{i}.py" for i in range(21)))], "path string")
    edges = spark.createDataFrame([("b/z.py", "a/x.py"), ("outside.py", "a/x.py")], "importer string, imported string")
    one = spark.createDataFrame([("a/x.py", "modified"), ("big/1.py", "modified")], "path string, status string")
    included, verdict = relations.impact_scope(files, one, edges)
    assert {tuple(r) for r in included.collect()} == {("a/x.py", "changed"), ("a/y.py", "same_directory_context"), ("b/z.py", "direct_dependent"), ("big/1.py", "changed")}
    assert verdict.first()["full_scan"] is False
    assert relations.impact_scope(files, one.withColumn("status", F.lit("deleted")), edges)[1].first()["reasons"] == ["a deletion or rename"]
    assert relations.impact_scope(files.where("path not like 'c%'").limit(20), spark.createDataFrame([(f"big/{i}.py", "modified") for i in range(15)], "path string, status string"), edges)[1].first()["full_scan"]


# --- evaluation ------------------------------------------------------------------------------------------


def test_scores_of_predictions(spark):
    trials = spark.createDataFrame([("t1", "c", "m", "completed", 10, 5, 1, 100), ("t2", "c", "m", "error", 1, 1, 1, 1), ("t3", "c", "n", None, 0, 0, 0, 0)], "trial string, case string, mode string, status string, input_tokens long, output_tokens long, requests long, latency_ms long")
    p = lambda o, line, cwe="X", d="confirmed", cited=True: ("t1", o, cwe, d, "./f", line, cited, 2, int(cited))
    predictions = spark.createDataFrame([p(0, 1), p(1, 20), p(2, 31), p(3, 31), p(4, 32, cited=False), p(5, 40), p(6, 31, "Y")], "trial string, ordinal long, cwe string, disposition string, file string, line long, cited boolean, citations long, valid_citations long")
    expected = spark.createDataFrame([("c", 0, "X", "confirmed", "f", 30, 31), ("c", 1, "X", "confirmed", "f", 30, 35), ("c", 2, "Z", "confirmed", "f", 50, 60)], "case string, expectation long, cwe string, disposition string, file string, start_line long, end_line long")
    regions = spark.createDataFrame([("c", "ignored", None, "f", 1, 2), ("c", "safe", "X", "f", 1, 25)], "case string, kind string, cwe string, file string, start_line long, end_line long")
    got = {r["mode"]: r for r in evaluation.score(trials, predictions, expected, regions).collect()}
    m = got["m"]
    assert (m["true_positives"], m["false_positives"], m["safe_region_false_positives"], m["ignored_predictions"], m["false_negatives"], m["errors"], m["true_positives_cited"]) == (2, 4, 1, 1, 4, 1, 2)
    assert (m["recall_bp"], m["precision_bp"], m["citation_accuracy_bp"], m["citation_coverage_bp"], m["input_tokens"]) == (3333, 3333, 4285, 10000, 11)
    assert (got["n"]["missing"], got["n"]["false_negatives"], got["n"]["recall_bp"]) == (1, 3, 0)


def test_truth_cases(spark):
    cases = spark.createDataFrame([("a", ".\\f", 5, "X", "q", None, None, "vulnerable", 1), ("b", "f", 9, "X", "q", None, None, "vulnerable", 1), ("c", "f", 5, "X", "q", 2, 7, "safe", 0), ("d", "f", 5, "X", "q", 3, None, "safe", 0)], "case string, file string, line long, cwe string, capability string, source_line long, source_column long, disposition string, expected_paths long")
    paths = spark.createDataFrame([("p", "q", ["X", "X"], 2, 7, "f", 4, 6), ("o", "other", ["X"], 2, 7, "f", 4, 6)], "id string, capability string, cwes array<string>, source_line long, source_column long, file string, sink_line long, sink_end_line long")
    got = evaluation.truth(cases, paths)
    assert {r["case"]: (r["classification"], r["baseline_matched"]) for r in got.collect()} == {"a": ("true_positive", True), "b": ("false_negative", False), "c": ("false_positive", False), "d": ("true_negative", True)}
    assert evaluation.confusion(got).first()[:] == (1, 1, 1, 1, 5000, 5000)
    runs = spark.createDataFrame([("x", 1, 0, 2), ("x", 3, None, 4)], "model string, input_tokens long, cached_input_tokens long, output_tokens long")
    assert evaluation.consolidated(runs, "model").first()[:] == ("x", 2, 4, None, 6)


# --- budgets ---------------------------------------------------------------------------------------------

EVENTS = "budget string, sequence long, at double, op string, lease string, lane string, owner string, calls long, tokens double, cost double"


def event(n, op, lease=None, lane=None, owner=None, calls=None, tokens=None, cost=None, at=0.0, budget="b"):
    return (budget, n, at, op, lease, lane, owner, calls, tokens, cost)


def outcomes(spark, events, **policy):
    rows = budgets.fold(spark.createDataFrame(events, EVENTS), budgets.Policy(**policy)).orderBy("sequence").collect()
    return [r["outcome"] for r in rows]


def test_budget_admission(spark):
    e = event
    assert outcomes(spark, [e(1, "reserve", "a"), e(2, "reserve", "b"), e(3, "reserve", "c"), e(4, "finish", "a", tokens=5.0), e(5, "reserve", "d")], max_calls=2) == ["admitted", "admitted", "call_limit", "settled", "call_limit"]
    # A refused reservation uses up nothing: one that fits is admitted later.
    assert outcomes(spark, [e(1, "reserve", "a"), e(2, "reserve", "b"), e(3, "finish", "a", tokens=1.0), e(4, "reserve", "c")], input_limit=150, reservation=100, max_call_tokens=200) == ["admitted", "input_limit", "settled", "admitted"]
    assert outcomes(spark, [e(1, "reserve", "a"), e(2, "reserve", "b"), e(3, "finish", "a"), e(4, "reserve", "c"), e(5, "finish", "b", tokens=1.0)]) == ["admitted", "admitted", "unknown", "unknown_usage", "settled"]
    assert outcomes(spark, [e(1, "reserve", "a"), e(2, "finish", "a", tokens=9.0), e(3, "reserve", "b"), e(4, "finish", "a", tokens=1.0), e(5, "finish", "z")], max_call_tokens=8)[1:] == ["settled", "oversized_call", "already_settled", "unknown_lease"]
    assert outcomes(spark, [e(1, "reserve", "a", at=5.0), e(2, "reserve", "b", at=6.0)], deadline=6.0) == ["admitted", "deadline"]
    assert outcomes(spark, [e(1, "reserve", "a"), e(2, "abandon", "a"), e(3, "reserve", "b")], max_calls=1) == ["admitted", "released", "call_limit"]
    lanes = [e(1, "reserve", "a", "native"), e(2, "reserve", "b", "native"), e(3, "reserve", "c", "ai"), e(4, "complete_lane", lane="ai"), e(5, "reserve", "d", "native"), e(6, "reserve", "e", "ai"), e(7, "reserve", "f", "x")]
    assert outcomes(spark, lanes, max_calls=4, native_percent=25) == ["admitted", "lane_share", "admitted", "lane_complete", "admitted", "lane_complete", "unknown_lane"]
    holds = [e(1, "hold", owner="o", calls=2), e(2, "reserve", "a"), e(3, "reserve", "b"), e(4, "reserve", "c", owner="o"), e(5, "release", owner="o"), e(6, "reserve", "d"), e(7, "hold", owner="o", calls=1)]
    assert outcomes(spark, holds, max_calls=3) == ["held_2", "admitted", "call_limit", "admitted", "released", "admitted", "refused_hold"]
    assert outcomes(spark, [e(1, "reserve", "a"), e(2, "finish", "a", tokens=1.0, cost=60.0), e(3, "reserve", "b")], cost_limit=100, cost_reservation=50) == ["admitted", "settled", "cost_limit"]


def test_costs(spark):
    rates = {"input": "2.5", "cached": "0.25", "output": "10"}
    rows = spark.createDataFrame([(3, 1, 1), (1, 2, 0), (None, 0, 0), (1, 0, 0)], "t long, c long, o long")
    assert [r[0] for r in rows.select(budgets.cost(rates, F.col("t"), F.col("c"), F.col("o"))).collect()] == [16, None, None, 3]
    assert budgets.reservation(rates, 1000, 10) == 2600
    for bad in (True, "x", -1, "NaN"):
        with pytest.raises(ValueError):
            budgets.rate(bad)
    lanes = spark.createDataFrame([("b", "native", 4, 1, True, True), ("b", "ai", 2, 0, False, True)], "budget string, lane string, allocation int, used int, complete boolean, enabled boolean")
    assert {tuple(r) for r in budgets.transferred(lanes).collect()} == {("b", "native", 1), ("b", "ai", 5)}


def run_stream(spark, source, schema, made, check, target):
    query = made(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", target).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_streams_go_on_after_a_restart(spark, tmp_path):
    e = event
    parts = [[e(1, "reserve", "a"), e(2, "reserve", "b"), e(1, "reserve", "a", budget="c")], [e(3, "reserve", "c"), e(4, "finish", "a", tokens=5.0)]]
    for part in parts:
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run_stream(spark, f"{tmp_path}/in", EVENTS, lambda s: budgets.stream(s, budgets.Policy(max_calls=2)), f"{tmp_path}/check", f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, got.select("budget", "sequence", "outcome").collect())) == [("b", 1, "admitted"), ("b", 2, "admitted"), ("b", 3, "call_limit"), ("b", 4, "settled"), ("c", 1, "admitted")]
    commands = [command(1, "claim", attempt="a1", snapshot="x", generation=0), command(2, "record", attempt="a1", decision="d1", subject="s", generation=1)], [command(3, "record", attempt="a1", decision="d1", subject="s", generation=1, operation="o2"), command(4, "claim", attempt="a2", snapshot="y", generation=0)]
    for part in commands:
        spark.createDataFrame(part, state.COMMAND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/cin")
        run_stream(spark, f"{tmp_path}/cin", state.COMMAND, state.stream, f"{tmp_path}/ccheck", f"{tmp_path}/cout")
    got = spark.read.parquet(f"{tmp_path}/cout").orderBy("sequence").select("outcome").collect()
    assert [r[0] for r in got] == ["claimed", "recorded", "replayed", "generation_changed"]


# --- state -----------------------------------------------------------------------------------------------


def command(n, kind, operation=None, **more):
    names = [c.split()[0] for c in state.COMMAND.split(", ")]
    row = {"stream": "s", "sequence": n, "operation": operation or f"o{n}", "kind": kind} | more
    return tuple(row.get(x) for x in names)


def test_commands_of_a_stream(spark):
    rows = [
        command(1, "claim", attempt="a1", snapshot="x", generation=0), command(2, "claim", attempt="a9", snapshot="x", generation=1), command(3, "record", attempt="a1", generation=1, decision="d1", subject="s1", settled=True),
        command(4, "record", "o3", attempt="a1", generation=1, decision="d1", subject="s1", settled=True), command(5, "record", "o3", attempt="a1", generation=1, decision="d2", subject="s1"), command(6, "record", attempt="a1", generation=9, decision="d2", subject="s1"),
        command(7, "record", attempt="a1", generation=1, decision="d2", subject="s1", supersedes=["d1"]), command(8, "record", attempt="a1", generation=1, decision="d3", subject="s1", supersedes=["zz"]), command(9, "allocate", attempt="a1", generation=1, assignment="w1", reviews=["r1", "r2"], calls=2),
        command(10, "allocate", attempt="a1", generation=1, assignment="w2", reviews=["r2"]), command(11, "release", attempt="a1", generation=1, assignment="w1"), command(12, "allocate", attempt="a1", generation=1, assignment="w2", reviews=["r2"]), command(13, "allocate", attempt="a1", generation=1, assignment="w3", reviews=["s1"]),
        command(14, "claim", attempt="a1", snapshot="y", generation=1), command(15, "claim", attempt="a2", snapshot="y", generation=1), command(16, "record", attempt="a1", generation=1, decision="d4", subject="s1"), command(17, "finish", attempt="a2", generation=2), command(18, "record", attempt="a2", generation=2, decision="d5", subject="s1"),
        command(19, "record", owner="wrong", attempt="a2", generation=2, decision="d5", subject="s1"),
    ]
    got = [r["outcome"] for r in state.fold(spark.createDataFrame(rows, state.COMMAND)).orderBy("sequence").collect()]
    assert got == ["claimed", "coalesced", "recorded", "replayed", "operation_conflict", "stale", "recorded", "unknown_supersession", "allocated", "overlapping_lease", "released", "allocated", "already_settled", "attempt_reused", "claimed", "stale", "finished", "stale", "stale"]


def test_journals(spark, tmp_path):
    rows = state.transactions([("o1", "c1", "r1"), ("o2", "c2", "r2"), ("o3", "c3", "r3")])
    names = ("sequence", "previous_hash", "operation", "command", "result", "hash")
    lines = [json.dumps(dict(zip(names, r))) for r in rows]
    path = tmp_path / "j.jsonl"

    def read(content, **more):
        path.write_text(content)
        spark.catalog.clearCache()
        return state.read_journal(spark, f"file://{path}", **more)

    assert read("\n".join(lines) + "\n").count() == 3 and read("\n".join(lines) + "\n", through=2).count() == 2
    broken = ["\n".join(lines), "\n".join([lines[0], "", lines[1]]) + "\n", "\n".join(lines[1:]) + "\n", "\n".join([lines[0], lines[2]]) + "\n", "\n".join(lines).replace("c2", "c9") + "\n", "\n".join([*lines, lines[2]]) + "\n"]
    for content in broken:
        with pytest.raises(ValueError):
            read(content)
    with pytest.raises(ValueError):
        read("\n".join(lines) + "\n", through=9)
    assert state.transactions([("o4", "c", "r")], (3, rows[2][5]))[0][:2] == (4, rows[2][5])
    commands = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, "b", "x")], "sequence long, operation string, command string")
    assert [(r["outcome"], r["receipt"]) for r in state.receipts(commands).orderBy("sequence").collect()] == [("applied", 1), ("replayed", 1), ("conflict", 1), ("applied", 4)]


def test_views(spark):
    decisions = spark.createDataFrame([("s", "a", "1", 1, "issue", [], True), ("s", "a", "2", 2, "not_issue", ["1"], True), ("s", "b", "3", 1, "issue", [], True), ("s", "c", "4", 2, "issue", [], True), ("s", "c", "5", 2, "issue", [], True), ("s", "d", "6", 1, "issue", [], False), ("s", "d", "7", 2, "issue", [], True)], "stream string, subject string, decision string, generation long, verdict string, supersedes array<string>, settled boolean")
    subjects = spark.createDataFrame([("s", x) for x in "abcde"], "stream string, subject string")
    view = state.subject_view(subjects, decisions, decisions.where("generation = 2"))
    assert {r["subject"]: (r["state"], r["verdict"]) for r in view.collect()} == {"a": ("recorded", "not_issue"), "b": ("unassessed", None), "c": ("conflict", None), "d": ("awaiting_supersession", None), "e": ("unassessed", None)}
    inputs = lambda *rows: spark.createDataFrame([("s", *r) for r in rows], "stream string, subject string, fingerprint string")
    assert [r["decision"] for r in state.reused(decisions, inputs(("a", "1"), ("b", "1"), ("c", "1")), inputs(("a", "2"), ("b", "1"), ("c", "1"))).collect()] == ["3"]
    assert state.completion(subjects, view).first()[:] == ("s", 5, 4, 0, 0, False)
    questions = spark.createDataFrame([("q1", 1), ("q2", 1), ("q3", 1)], "question string, generation long")
    facts = spark.createDataFrame([("f1", "q2", 1, "x"), ("f2", "q2", 1, "y"), ("f3", "q3", 1, "x"), ("f4", "q1", 0, "x")], "fact string, question string, generation long, answer string")
    assert {tuple(r)[0::2] for r in state.pending(questions, facts, spark.createDataFrame([("f3",)], "fact string")).collect()} == {("q1", "awaiting_evidence", False), ("q2", "evidence_available", True), ("q3", "pending_after_revalidation", False)}
    none = F.array().cast("array<string>")
    assert value(spark, state.is_settled(F.lit("issue"), none, F.lit(None).cast("array<string>"))) and not value(spark, state.is_settled(F.lit("issue"), F.array(F.lit("c")), none)) and not value(spark, state.is_settled(F.lit("needs_review"), none, none))
    revisions = spark.createDataFrame([("i", 1, "a"), ("i", 2, "b")], "item string, revision long, text string")
    assert state.knowledge_heads(revisions).first()[:] == ("i", 2, "b", 2)
    got = state.assessments_now(*(spark.createDataFrame(r, s) for r, s in (([("b1",), ("b2",), ("b3",)], "batch string"), ([("x", "b1"), ("y", "b2"), ("z", "b3")], "assessment string, batch string"), ([("b1", "f", "1"), ("b2", "f", "1"), ("b2", "g", "2")], "batch string, path string, digest string"), ([("f", "1"), ("g", "3")], "path string, digest string"))))
    assert {tuple(r) for r in got.collect()} == {("x", "unchanged"), ("y", "changed"), ("z", "unknown")}
    events = spark.createDataFrame([(n, json.dumps({"a": {"b": "k" if n % 2 else "l"}})) for n in range(1, 8)], "seq long, payload string")
    assert [r["seq"] for r in state.after(events, 2, 5, 2).collect()] == [3, 4] and state.latest(events.withColumn("pr", F.lit(1)), "payload", {"$.a.b": "k"}, "pr").first()["seq"] == 7


# --- reports ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("end", ["\n", "\r", "\r\n"])
def test_line_hashes(end):
    text = end.join([" hello; \t", "world!!!", "", "", "  \t\tGreetings", " End", ""])
    assert [h for _, h in reports.line_hashes(text)] == ["e9496ae3ebfced30:1", "fb7c023a8b9ccb3f:1", "ce8ba1a563dcdaca:1", "e20e36e16fcb0cc8:1", "b3edc88f2938467e:1", "c8e28b0b4002a3a0:1", "c129715d7a2bc9a3:1"]
    assert reports.line_hashes("") == [(1, "c129715d7a2bc9a3:1")]
    repeated = dict(reports.line_hashes("Lorem ipsum dolor sit amet.\n" * 10))
    assert (repeated[2], repeated[6], repeated[11]) == ("a7f2ff13bc495cf2:2", "a7f2ff13bc495cf2:6", "c129715d7a2bc9a3:1")


def test_sarif_logs(spark, tmp_path):
    step = [("src/a b.py", 1, 1), ("src/a b.py", 3, 4)]
    rows = [("p2", "query", ["CWE-89"], "direct", "src/a b.py", 3, 4, "m2", step, "warning"), ("p1", "query", ["CWE-89"], "direct", "x.py", 1, 1, 'm "1"', step, "warning"), ("p3", "command", [], "protected", "x.py", 1, 1, "m3", step, "note")]
    candidates = spark.createDataFrame(rows, "id string, capability string, cwes array<string>, state string, path string, line int, end_line int, message string, steps array<struct<path:string,line:int,end_line:int>>, level string")
    hashes = reports.fingerprints(spark.createDataFrame([("x.py", "a\nb")], "path string, text string"))
    reports.write_sarif(reports.sarif(candidates, {"count": 3}, hashes=hashes, automation=reports.partition_id("a/b", "1")), f"{tmp_path}/log.json")
    log = json.loads((tmp_path / "log.json").read_text())
    (run,) = log["runs"]
    assert log["version"] == "2.1.0" and [r["id"] for r in run["tool"]["driver"]["rules"]] == ["CWE-89.QUERY", "REVIEW.COMMAND"] and run["automationDetails"] == {"id": "a/b/1"} and run["properties"] == {"count": 3}
    assert [(r["properties"]["candidateId"], r["ruleIndex"]) for r in run["results"]] == [("p1", 0), ("p2", 0), ("p3", 1)]
    assert run["results"][1]["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "src/a%20b.py"}, "region": {"startLine": 3, "endLine": 4}}
    assert run["results"][0]["partialFingerprints"]["primaryLocationLineHash"] == reports.line_hashes("a\nb")[0][1] and "partialFingerprints" not in run["results"][1]
    assert len(run["results"][0]["codeFlows"][0]["threadFlows"][0]["locations"]) == 2
    for bad in (("a b", "1"), ("a//b", "1"), ("a", "")):
        with pytest.raises(ValueError):
            reports.partition_id(*bad)


def test_markdown_groups_bundles_and_journals(spark, tmp_path):
    rows = [(0, "issue", "B*", "c", "fix", ["2"], "f", 1, "s_0"), (1, "needs_review", "A", "c", None, [], "f", 2, "s1"), (2, "issue", "A", "c", None, ["1"], "f", 3, "s2"), (3, "issue", "B*", "c", "fix", ["1"], "g", 4, "s3"), (4, "not_issue", "Z", "c", None, [], "g", 5, "s4")]
    findings = spark.createDataFrame(rows, "ordinal long, decision string, title string, category string, remediation string, cwes array<string>, path string, line int, summary string")
    assert [(r["title"], r["instances"], r["cwes"], r["place"]) for r in reports.finding_groups(findings).orderBy("place").collect()] == [("B*", 2, ["1", "2"], 1), ("A", 1, ["1"], 2)]
    reports.write_lines(reports.markdown(findings, "Report"), f"{tmp_path}/r.md")
    lines = (tmp_path / "r.md").read_text().splitlines()
    assert lines[0] == "# Report" and "| Confirmed findings | 3 |" in lines and lines[lines.index("## Review next") + 1] == "- `f:2` A: s1"
    assert lines[lines.index("## Confirmed") + 1 :] == ["### B\\* (2; 1, 2)", "- `f:1` s\\_0", "- `g:4` s3", "### A (1; 1)", "- `f:3` s2"]
    requests = spark.createDataFrame([("r", n, b) for n, b in enumerate((5, 5, 1, 20, 1, 1, 1, 1))], "run string, ordinal long, bytes long")
    paged = reports.bundles(requests, 10, 3)
    assert [r["page"] for r in paged.orderBy("ordinal").collect()] == [0, 0, 1, 2, 3, 3, 3, 4] and reports.manifest(paged).count() == 5
    calls = spark.createDataFrame([("a", "e", True, 0, 1), ("a", None, True, 0, 2), ("a", None, False, 0, 3), ("a", None, False, 1, 4)], "operation string, error string, truncated boolean, results int, elapsed_ms long")
    assert reports.journal_summary(reports.journal(calls), "operation").first()[:] == ("a", 4, 1, 1, 1, 10)
    assert value(spark, reports.portable(F.lit('{"a":"/r/x/f.py","b":"/r/x","c":"/r/xy"}'), "/r/x/")) == '{"a":"f.py","b":".","c":"/r/xy"}'
    assert value(spark, T.markdown_escape(F.lit("a*b `c*d` <e>\n[f] `g"))) == "a\\*b `c*d` &lt;e&gt; \\[f\\] `g"


# --- advisories, lookups, queues ---------------------------------------------------------------------------


def test_advisories(spark):
    def text(id, package, versions, more=""):
        return f'```toml\n[advisory]\nid = "{id}"\npackage = "{package}"\n{more}\n[versions]\n{versions}\n```\n# Title of {id}\n'

    files = [("1", text("R-1", "p", 'patched = [">= 1.2.0"]')), ("2", text("R-2", "p", 'patched = []\nunaffected = ["< 2"]')), ("3", text("R-3", "p", "", 'withdrawn = "2020-01-01"')), ("4", text("R-4", "p", "", 'informational = "notice"')), ("5", "none"), ("6", text("R-6", "q", 'patched = ["nope!"]')), ("7", text("R-7", "p", "", 'informational = "notice"\ncategories = ["malicious"]'))]
    found = advisories.database(spark.createDataFrame(files, "path string, text string"))
    assert {r["path"] for r in found.where("error is not null").collect()} == {"5", "6"}
    crates = advisories.REGISTRIES[0]
    lock = f'[[package]]\nname = "p"\nversion = "1.1.0"\nsource = "{crates}"\n[[package]]\nname = "p"\nversion = "2.0.0-rc.1"\nsource = "{crates}"\n[[package]]\nname = "p"\nversion = "3.0.0"\nsource = "{crates}"\n[[package]]\nname = "p"\nversion = "1.0.0"\nsource = "git+x"\n'
    rows, digest = advisories.lockfile(lock)
    packages = spark.createDataFrame([*rows, rows[0]], "name string, version string, source string")
    assert len(digest) == 64 and {(r["version"], r["status"]) for r in advisories.checked(packages).collect()} == {("1.1.0", "checked"), ("2.0.0-rc.1", "prerelease"), ("3.0.0", "checked"), ("1.0.0", "excluded")}
    got = lambda **k: {(r["version"], r["id"]) for r in advisories.findings(packages, found, **k).collect()}
    assert got() == {("1.1.0", "R-1"), ("3.0.0", "R-2"), ("1.1.0", "R-7"), ("3.0.0", "R-7")} and got(informational=True) - got() == {("1.1.0", "R-4"), ("3.0.0", "R-4")}
    with pytest.raises(ValueError):
        advisories.lockfile("x = 1")


def test_versions_basis_points_and_ids(spark):
    versions = ["1.2.3-alpha", "1.2.3-alpha.1", "1.2.3-alpha.beta", "1.2.3-beta", "1.2.3-beta.2", "1.2.3-beta.11", "1.2.3-rc.1", "1.2.3", "1.2.10", "1.10.0"]
    rows = spark.createDataFrame([(v,) for v in reversed(versions)], "v string")
    assert [r["v"] for r in rows.orderBy(T.semver(F.col("v"))).collect()] == versions and value(spark, T.semver(F.lit("1.2"))) is None and value(spark, T.is_prerelease(F.lit("1.2.3-a"))) and not value(spark, T.is_prerelease(F.lit("1.2.3+a-b")))
    assert [value(spark, T.basis_points(F.lit(n).cast("long"), F.lit(d).cast("long"))) for n, d in ((1, 3), (2, 0), (9223372036854775807, 9223372036854775807), (9223372036854775807, 1), (9007199254740993, 9007199254740992))] == [3333, 0, 2, 10000, 2047]
    assert value(spark, T.fnv_id("ev-", F.lit("a|b"), F.lit("c"))) != value(spark, T.fnv_id("ev-", F.lit("a"), F.lit("b|c")))
    assert value(spark, T.entropy_millibits(F.lit("é"))) == 1000


def test_suppression_is_for_one_line(spark):
    comments = spark.createDataFrame([("f", 4, ["a"], 2, 5), ("f", 6, [], None, 7), ("g", 0, [], None, 2), ("h", 0, ["z"], None, 1)], "key string, line long, rules array<string>, statement_line long, next_line long")
    marks = ledgers.marks_of(comments)
    found = spark.createDataFrame([("f", 2, "a"), ("f", 2, "b"), ("f", 4, "a"), ("f", 6, "a"), ("f", 7, "q"), ("f", 8, "q"), ("g", 50, "q"), ("h", 1, "y")], "key string, line long, rule string")
    assert {tuple(r) for r in ledgers.unsuppressed(found, marks).collect()} == {("f", 2, "b"), ("f", 4, "a"), ("f", 6, "a"), ("f", 8, "q"), ("h", 1, "y")}
    assert [r["rule"] for r in ledgers.unused_marks(found, marks).collect()] == ["z"]
    assert value(spark, ledgers.mark_rules(F.lit("# skip-rule: a, b"), "skip-rule")) == ["a", "b"] and value(spark, ledgers.mark_rules(F.lit("# skip-rule"), "skip-rule")) == [] and value(spark, ledgers.mark_rules(F.lit("# x"), "skip-rule")) is None


def test_follow_ups(spark):
    rows = [(i, "issue" if i < 8 else "needs_review" if i < 11 else "other", "high" if i == 3 else "low", "shared" if i in (1, 2) else None, "application_path" if i == 5 else None, "dormant" if i == 5 else None, None) for i in range(12)]
    claims = spark.createDataFrame(rows, "review long, decision string, severity string, point string, context_kind string, applicability string, impact string")
    notes = spark.createDataFrame([(1, "control_applicability"), (2, "conflicting_evidence"), (3, "control_applicability"), (4, "missing_local_evidence"), (8, "human_required"), (7, "external_required"), (11, "conflicting_evidence")], "review long, reason string")
    got = {r["review"]: r["outcome"] for r in queues.select_follow_ups(claims, notes).collect()}
    assert got == {5: "selected", 2: "selected", 1: "shared_repair_point", 3: "selected", 4: "fast_cap", 8: "unavailable_deciding_fact", 7: "resolved_blocker_nomination", 11: "outside_verdict_scope", **{k: "no_actionable_nomination" for k in (0, 6, 9, 10)}}
    with pytest.raises(ValueError):
        queues.select_follow_ups(claims, notes, most=21)


def test_lookups(spark):
    files = spark.createDataFrame([("a.py", "x = foo(1)\nfoo.foo\nfood\n"), ("b/c.py", "foo")], "path string, text string")
    found = lookups.references(files, "foo")
    assert sorted((r["path"], r["line"], r["column"]) for r in found.collect()) == [("a.py", 1, 5), ("a.py", 2, 1), ("a.py", 2, 5), ("b/c.py", 1, 1)]
    assert {(r["path"], r["occurrences"], tuple(r["lines"]), r["truncated"]) for r in lookups.reference_summary(found, lines=1).collect()} == {("a.py", 3, (1,), True), ("b/c.py", 1, (1,), False)}
    assert lookups.source(files, "a.py", 2, 5).first()[:] == ("a.py", 2, 4, 4, "foo.foo\nfood\n")
    rows = spark.createDataFrame([("a.py", 2, 2)], "path string, line int, end_line int")
    assert lookups.units(rows, files, 1).first()["source"] == "x = foo(1)\nfoo.foo\nfood"
    entries = spark.createDataFrame([("1", "q", ["A"], "p/x", ["k1", "k2"], [("lit",)], "n", 5), ("2", "q", ["A"], "p/y", ["k1"], [], "n", 2), ("3", "r", [], "z", [], [], "n", 1)], "id string, capability string, cwes array<string>, path string, contracts array<string>, operands array<struct<kind:string>>, neighborhood string, line int")
    ids = lambda **k: [r["id"] for r in lookups.inventory(entries, **k).orderBy("id").collect()]
    assert ids() == ["1", "2", "3"] and ids(capability="q", prefix="p/", cwe="A", contract="k1", operand="lit") == ["1"] and ids(reviewed=entries.where("id = '2'")) == ["1", "3"]
    groups, members, rest = lookups.contract_queue(entries)
    assert sorted(map(tuple, members.collect())) == [("k1", "1"), ("k1", "2"), ("k2", "1")]
    assert sorted((r["key"], r["entries"], r["files"], r["first"]) for r in groups.collect()) == [("k1", 2, 2, "1"), ("k2", 1, 1, "1")] and rest.first()["ungrouped"] == 1
    assert {(r["capability"], r["reviews"], r["representative"]) for r in lookups.implementations(entries).collect()} == {("q", 2, "1"), ("r", 1, "3")}
    page, following = lookups.page(entries, ["id"], 0, 2)
    assert (page.count(), following) == (2, 2) and lookups.page(entries, ["id"], 2, 2)[1] is None
    with pytest.raises(ValueError):
        lookups.page(entries, ["id"], 0, 201)
    items = spark.createDataFrame([("a", "high", 2, 5), ("b", "low", 1, 1), ("c", "low", 3, 4)], "case string, impact string, low int, high int")
    results = spark.createDataFrame([("a", "running", 3), ("b", "completed", 1)], "case string, status string, used int")
    assert {r["case"]: (r["status"], r["low_left"], r["high_left"]) for r in lookups.ledger(items, results).collect()} == {"a": ("running", 0, 2), "b": ("completed", 0, 0), "c": ("pending", 3, 4)}
    deferred = spark.createDataFrame([("x", "p", "r", ["n"]), ("y", "p2", "r", []), ("z", "p3", "r", [])], "id string, path string, rule string, depends_on array<string>")
    verdicts = spark.createDataFrame([("n", "o", "o", "conflict"), ("m", "p2", "r", "issue"), ("l", "p3", "r", "not_issue")], "id string, path string, rule string, state string")
    assert sorted(r["id"] for r in lookups.reopened(deferred, verdicts).collect()) == ["x", "y"]
    edges = spark.createDataFrame([("b/c.py", 1, ".d", "e"), ("b/c.py", 2, "..a", "x"), ("a.py", 1, "b.c", None), ("a.py", 2, "zz", None)], "doc string, line int, module string, name string")
    more = files.select("path").union(spark.createDataFrame([("b/d/__init__.py",)], "path string"))
    assert {(r["doc"], r["line"]): r["target"] for r in lookups.targets(edges, more).collect()} == {("b/c.py", 1): "b/d/__init__.py", ("b/c.py", 2): "a.py", ("a.py", 1): "b/c.py", ("a.py", 2): None}


def test_journal_appends(spark, tmp_path):
    path = f"{tmp_path}/j.jsonl"
    assert [state.append(path, *x) for x in (("o1", "c1", "r"), ("o2", "c2", "r"), ("o1", "c1", "r"))] == [(1, False), (2, False), (1, True)]
    assert state.read_journal(spark, f"file://{path}").count() == 2
    with pytest.raises(ValueError):
        state.append(path, "o1", "other", "r")
    whole = open(path).read()
    for bad in (whole[:-1], whole.replace("c2", "c9")):
        open(path, "w").write(bad)
        with pytest.raises(ValueError):
            state.append(path, "o3", "c", "r")


def test_sinks(spark, tmp_path):
    rows = evidence(spark)
    paths = relations.security_paths(rows, relations.catalog(spark, [CONTRACT]))
    reports.write_scan(f"{tmp_path}/scan", rows, paths, spark.createDataFrame([("f.py", "scanned")], "path string, status string"))
    assert spark.read.json(f"{tmp_path}/scan/head").first()[:] == (8, 1, 1, ".", "2.1")
    assert [r["id"] for r in spark.read.json(f"{tmp_path}/scan/evidence").where("kind = 'source'").orderBy("start", "id").collect()] == ["s1", "s3", "s2"]
    requests = spark.createDataFrame([("r", n, 5) for n in range(5)], "run string, ordinal long, bytes long")
    reports.write_bundles(reports.bundles(requests, 10, 9), f"{tmp_path}/b")
    assert spark.read.json(f"{tmp_path}/b/manifest").count() == 3 and spark.read.json(f"{tmp_path}/b/requests").where("page = 0").count() == 2
    admitted = rows.withColumn("disposition", F.when(F.col("kind") == "sink", "review").otherwise("inventory_only")).withColumn("reason", F.lit("context_only"))
    reports.write_inventory(rows, admitted, f"{tmp_path}/i")
    assert [spark.read.parquet(f"{tmp_path}/i/{p}").count() for p in ("inventory", "identities", "excluded")] == [3, 8, 5]
    calls = spark.createDataFrame([("a", None, False, 0, 1)], "operation string, error string, truncated boolean, results int, elapsed_ms long")
    for _ in range(2):
        reports.append_journal(calls, f"{tmp_path}/calls")
    assert [r["status"] for r in spark.read.json(f"{tmp_path}/calls").collect()] == ["empty", "empty"]
    for _ in range(2):
        query = reports.append_journal_stream(spark.readStream.schema("operation string, error string, truncated boolean, results int, elapsed_ms long").json(f"{tmp_path}/calls"), f"{tmp_path}/out", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination(60)
    assert spark.read.json(f"{tmp_path}/out").count() == 2


def test_review_diffs(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), "id string, content string, bundle string")
    before = frame(("a", "1", "x"), ("b", "1", "x"), ("c", "1", "y"), ("d", "1", "z"))

    def diff(after, **more):
        bundles, counts = queues.review_diff(before, after, **more)
        return sorted(r["bundle"] for r in bundles.collect()), tuple(counts.first())

    assert diff(frame(("a", "2", "x"), ("b", "1", "x"), ("c", "1", "y"), ("e", "1", "w"))) == (["w", "x"], (1, 1, 1, 1 + 1, "changed_bundles"))
    assert diff(frame(("a", "1", "x"), ("b", "1", "x"), ("c", "1", "y"))) == ([], (0, 1, 0, 3, "not_required"))
    assert diff(frame(("a", "1", "x"), ("c", "1", "x"), ("b", "1", "y"), ("d", "1", "z"), ("n", "1", "q"))) == (["q", "x", "y"], (1, 0, 0, 4, "changed_bundles"))
    assert diff(before, layout_changed=True) == (["x", "y", "z"], (0, 0, 0, 4, "full_pack"))
    assert value(spark, T.byte_position(F.lit("aé\nüb"), F.lit(6)))[:] == (2, 2, 6)
