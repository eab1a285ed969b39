"""Every query of the catalog against its SQL, and operators on hand-made frames."""

import glob
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scanlattice.functions import text as T
from scanlattice.operators import flows, queues, trees
from scanlattice.plans import catalog
from scanlattice.streaming import log

SF = "/root/testdata/sf0.001"


def rows_of(frame: pd.DataFrame):
    cell = lambda x: "~" if x is None or pd.isna(x) else str(round(x, 6)) if isinstance(x, float) else str(x)
    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_agrees_with_its_sql(spark, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    if name in catalog.oracle_sql():
        base = duckdb.connect()
        for p in glob.glob(f"{SF}/*.parquet"):
            base.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
        want = base.sql(catalog.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_scalar_functions(spark):
    s = F.lit("XMLHttpRequest user_accountName")
    assert [value(spark, T.convert(s, k)) for k in ("snake", "pascal", "camel")] == ["xml_http_request_user_account_name", "XmlHttpRequestUserAccountName", "xmlHttpRequestUserAccountName"]
    assert value(spark, T.convert(F.lit("hELLO"), "capitalize")) == "HELLO"
    assert [value(spark, T.substring_range(F.lit("héllo"), *r)) for r in ((-3, -1), (1, 99), (4, 2), (-99, 2))] == ["ll", "éllo", "", "hé"]
    assert value(spark, T.entropy_millibits(F.lit("aabb"))) == 1000 and value(spark, T.basis_points(F.lit(2), F.lit(3))) == 6666 and value(spark, T.basis_points(F.lit(2), F.lit(0))) == 0
    assert value(spark, T.file_class(F.lit("src/App.vue"))) == "vue" and value(spark, T.is_test_path(F.lit("a/tests/x.py")))
    assert value(spark, F.lit("a/b/c.ts").rlike(T.glob_regex("a/**/*.ts"))) and not value(spark, F.lit("a/b/c.ts").rlike(T.glob_regex("a/*.ts")))


def test_propagation_is_killed_bounded_and_branch_aware(spark):
    edges = spark.createDataFrame([(1, "b", "a", 1, False), (1, "a", "x", 2, False), (1, "c", "a", 3, False), (1, "d", "b", 4, True), (2, "b", "a", 1, False), (2, "c", "b", 2, False), (2, "d", "c", 3, False), (2, "e", "d", 4, False), (2, "f", "e", 5, False)], "scope long, left string, right string, at int, conditional boolean")
    sources = spark.createDataFrame([(1, "a", 0), (2, "a", 0)], "scope long, name string, at int")
    got = {(r["scope"], r["name"]) for r in flows.propagate(sources, edges).collect()}
    assert got == {(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (2, "d"), (2, "e")}


def test_trees(spark):
    pages = spark.createDataFrame([(1, "<ul><li>a</li><li>b<br><b>x</b></li><li>c</li></ul><p>t</p>"), (2, None)], "page_id long, html string")
    nodes = trees.parse_html(pages).cache()
    li, ul = trees.kind(nodes, "li"), trees.kind(nodes, "ul")
    assert trees.related(li, "inside", ul).count() == 3 and trees.related(trees.kind(nodes, "p"), "inside", ul, negate=True).count() == 1
    assert trees.related(ul, "has", trees.kind(nodes, "b")).count() == 1 and trees.related(ul, "child", trees.kind(nodes, "b")).count() == 0
    assert trees.related(li, "precedes", li).count() == 2 and trees.related(trees.kind(nodes, "p"), "next_to", ul).count() == 1
    assert [r["sib"] for r in trees.nth_child(li, 2, 1).orderBy("sib").collect()] == [0, 2] and trees.nth_child(li, 0, 1, reverse=True).first()["sib"] == 2


def test_widest_and_follow_up(spark):
    spans = spark.createDataFrame([(1, 0, 9), (1, 2, 5), (1, 8, 12), (2, 2, 5)], "key long, start int, stop int")
    assert {tuple(r) for r in flows.widest(spans).collect()} == {(1, 0, 9), (1, 8, 12), (2, 2, 5)}
    claims = spark.createDataFrame([(i, "p" if i < 2 else f"q{i}") for i in range(10)], "id long, point string")
    decisions = {r["id"]: r["decision"] for r in queues.follow_up(claims, "point", ["id"]).collect()}
    assert [i for i, d in decisions.items() if d == "selected"] == [0, 2, 3] and decisions[1] == "shared_repair_point"


def test_stream_appends_each_id_once(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    for n, part in enumerate(([(1, "a"), (2, "b")], [(2, "b"), (3, "c")])):
        spark.createDataFrame(part, "id long, content string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long, content string").parquet(source).writeStream.foreachBatch(log.append_once(target, "id", "content")).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        stream.awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    with pytest.raises(ValueError):
        log.append_once(target, "id", "content")(spark.createDataFrame([(3, "other")], "id long, content string"), 9)


def test_suppression_and_states(spark):
    from scanlattice.operators import ledgers

    findings = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 5, "a"), (2, 9, "a"), (3, 1, None)], "key long, line long, rule string")
    marks = spark.createDataFrame([(1, 1, "a", False), (1, 1, "z", False), (2, 1, None, True)], "key long, line long, rule string, whole boolean")
    assert sorted((r["key"], r["line"]) for r in ledgers.unsuppressed(findings, marks).collect()) == [(1, 2), (1, 5), (3, 1)]
    assert [r["rule"] for r in ledgers.unused_marks(findings, marks).collect()] == ["z"]
    decisions = spark.createDataFrame([(1, 7, None), (2, 7, 1), (3, 8, None), (4, 8, None)], "id long, subject long, supersedes long")
    subjects = spark.createDataFrame([(7,), (8,), (9,)], "subject long")
    assert {r["subject"]: r["state"] for r in ledgers.subject_states(subjects, decisions).collect()} == {7: "recorded", 8: "conflict", 9: "unassessed"}


def test_selectors(spark):
    from scanlattice.operators import selectors

    nodes = trees.parse_html(spark.createDataFrame([(1, "<ul><li>a</li><li>b<b>x</b></li><li>c</li></ul><p>t</p><p>u</p>")], "page_id long, html string")).cache()
    count = lambda s: selectors.select(nodes, s).count()
    assert [count(s) for s in ("ul > li", "ul b", "ul > b", "ul + p", "ul ~ p", "li:has(b)", "li:not(li:has(b))", "li:nth-child(2n+1)", "li:nth-last-child(1), p", "li:is(ul > li)")] == [3, 1, 0, 1, 2, 1, 2, 2, 3, 3]
    for bad in ("", "> li", "li:nope(x)", "li:nth-child(x)"):
        with pytest.raises(ValueError):
            selectors.select(nodes, bad)


def test_more_scalar_functions(spark):
    fnv = lambda s: value(spark, T.fnv1a_hex(F.lit(s)))
    assert (fnv(""), fnv("a"), fnv("foobar")) == ("cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8")
    assert value(spark, T.split_reason(F.lit("aa bb " + "c" * 12), 5)) == ["aa bb", "ccccc", "ccccc", "cc"]
    assert value(spark, T.relative_path(F.lit(".\\a\\b"))) == "a/b" and value(spark, T.uri_path(F.lit("a b/ç"))) == "a%20b/%C3%A7"
    assert value(spark, T.line_of(F.lit("a\nbc"), F.lit(3))) == 2 and value(spark, T.column_of(F.lit("a\nbc"), F.lit(3))) == 2
