"""Queries of work records, scalar functions, selectors and outputs, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from scanlattice.functions import text as T
from scanlattice.operators import ledgers, selectors, trees
from scanlattice.plans.catalog import query
from scanlattice.sources.files import table

# --- conditions, generations ----------------------------------------------------------------------

@query("""WITH c AS (SELECT o_orderkey, (CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 3 = 1 END AND o_orderkey % 2 = 0) OR NOT (CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus = 'F' END) AS c FROM orders)
SELECT CASE WHEN c THEN 'reachable' WHEN NOT c THEN 'unreachable' ELSE 'conditional' END AS class, count(*) AS n FROM c GROUP BY 1""")
def conditional_reachability(spark, sf_dir):
    a = F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 3 == 1)
    c = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F")
    return table(spark, sf_dir, "orders").groupBy(ledgers.reachability((a & (F.col("o_orderkey") % 2 == 0)) | ~c).alias("class")).agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT l_partkey, l_suppkey % 7 AS generation, min(l_orderkey) AS low, max(l_orderkey) AS high FROM lineitem WHERE l_suppkey % 7 < 5 GROUP BY ALL)
SELECT l_partkey, generation, CASE WHEN low = high THEN low END::VARCHAR AS batch FROM g QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY generation DESC) = 1""")
def prior_batch(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_suppkey") % 7).alias("generation"), "l_orderkey")
    return ledgers.newest_before(rows, "l_partkey", "generation", F.lit(5), "l_orderkey").select("l_partkey", "generation", F.col("l_orderkey").cast("string").alias("batch"))


# --- decisions, leases, dispatch --------------------------------------------------------------------

_STATES_SQL = """WITH d AS (SELECT event_id AS id, user_id AS subject, CASE WHEN event_id % 11 <> 0 THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) END AS supersedes FROM events),
h AS (SELECT subject, count(*) AS heads FROM d WHERE NOT EXISTS (SELECT 1 FROM d o WHERE o.subject = d.subject AND o.supersedes = d.id) GROUP BY subject)
"""


@query(_STATES_SQL + """SELECT c_custkey AS subject, coalesce(heads, 0) AS heads, CASE WHEN coalesce(heads, 0) = 0 THEN 'unassessed' WHEN heads = 1 THEN 'recorded' ELSE 'conflict' END AS state FROM customer LEFT JOIN h ON subject = c_custkey""")
def subject_states(spark, sf_dir):
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    decisions = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("subject"), F.when(F.col("event_id") % 11 != 0, before).alias("supersedes"))
    return ledgers.subject_states(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject")), decisions)


@query("""SELECT o_custkey, o_orderkey, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) // 3)::BIGINT AS lease FROM orders WHERE o_orderstatus <> 'F'""")
def work_leases(spark, sf_dir):
    open_work = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select("o_custkey", "o_orderkey", "o_orderdate")
    return ledgers.leases(open_work, "o_custkey", ["o_orderdate", "o_orderkey"], 3).select("o_custkey", "o_orderkey", "lease")


@query("""WITH r AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS place FROM orders)
SELECT o_orderpriority, o_orderkey, (place - 1)::DOUBLE / substr(o_orderpriority, 1, 1)::INT AS tick FROM r ORDER BY tick, o_orderpriority, place LIMIT 120""")
def weighted_dispatch(spark, sf_dir):
    work = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey")
    return ledgers.fair_dispatch(work, "o_orderpriority", F.substring("o_orderpriority", 1, 1).cast("int"), ["o_orderkey"], 120).select("o_orderpriority", "o_orderkey", "tick")


@query("""SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders ORDER BY coalesce(list_position(['1-URGENT', '2-HIGH', '3-MEDIUM'], o_orderpriority), 4), coalesce(list_position(['P', 'O'], o_orderstatus), 3), o_totalprice DESC, o_orderkey LIMIT 100""")
def work_priority(spark, sf_dir):
    rank = (ledgers.ranked_enum(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "3-MEDIUM"]), ledgers.ranked_enum(F.col("o_orderstatus"), ["P", "O"]))
    return table(spark, sf_dir, "orders").orderBy(*rank, F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query("""WITH c AS (SELECT user_id, event_id, sha256(event_id::VARCHAR) AS own, lag(sha256(event_id::VARCHAR)) OVER (PARTITION BY user_id ORDER BY event_id) AS expected FROM events)
SELECT user_id, event_id FROM c WHERE (CASE WHEN event_id % 97 = 0 THEN 'broken' ELSE expected END) IS DISTINCT FROM expected""")
def hash_chain_breaks(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("own"))
    stored = F.when(F.col("event_id") % 97 == 0, "broken").otherwise(F.lag("own").over(Window.partitionBy("user_id").orderBy("event_id")))
    return ledgers.chain_breaks(rows.withColumn("previous", stored), "user_id", "event_id", "previous", "own").select("user_id", "event_id")


# --- rollups ------------------------------------------------------------------------------------------


@query("""SELECT coalesce('p' || (CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END), 'o' || o_orderkey) AS point, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1""")
def claim_groups(spark, sf_dir):
    point = F.coalesce(F.concat(F.lit("p"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey"))), F.concat(F.lit("o"), F.col("o_orderkey")))
    return table(spark, sf_dir, "orders").groupBy(point.alias("point")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS occurrence FROM lineitem""")
def occurrence_ordinals(spark, sf_dir):
    w = Window.partitionBy("l_partkey", "l_suppkey").orderBy("l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("occurrence"))


@query("""SELECT conv_id, turn, (max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn))::VARCHAR AS asked_at FROM conversations""")
def enclosing_turn(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.max(F.when(F.col("role") == "user", F.col("turn"))).over(w).cast("string").alias("asked_at"))


# --- scalar functions ----------------------------------------------------------------------------------


@query("""WITH h AS (SELECT p_partkey, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(regexp_extract_all(hex(encode(p_name || chr(0) || p_brand)), '..'), lambda x: ('0x' || x)::UHUGEINT)), lambda a, b: (xor(a, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS v FROM part)
SELECT p_partkey, 'ev-' || lower(printf('%08x', (v // 4294967296::UHUGEINT)::BIGINT)) || lower(printf('%08x', (v % 4294967296::UHUGEINT)::BIGINT)) AS id FROM h""")
def fnv_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.fnv_id("ev-", F.col("p_name"), F.col("p_brand")).alias("id"))


@query("""SELECT doc_id, place, (length(head) - length(replace(head, chr(10), '')) + 1)::BIGINT AS line, (length(string_split(head, chr(10))[-1]) + 1)::BIGINT AS col FROM (SELECT doc_id, (doc_id * 37 % greatest(length(text), 1))::BIGINT AS place, substr(text, 1, (doc_id * 37 % greatest(length(text), 1))::BIGINT) AS head FROM documents WHERE text IS NOT NULL)""")
def line_columns(spark, sf_dir):
    at = (F.col("doc_id") * 37 % F.greatest(F.length("text"), F.lit(1))).cast("long")
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", at.alias("place"))
    offset = F.col("place").cast("int")
    return docs.select("doc_id", "place", T.line_of(F.col("text"), offset).alias("line"), T.column_of(F.col("text"), offset).alias("col"))


@query(r"""SELECT p_partkey, p AS path, replace(url_encode(p), '%2F', '/') AS uri FROM (SELECT p_partkey, p_brand || '/' || p_name AS p FROM part)""")
def path_forms(spark, sf_dir):
    path = T.relative_path(F.concat(F.lit(".\\"), "p_brand", F.lit("\\"), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("path")).withColumn("uri", T.uri_path(F.col("path")))


@query("""WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN substr(sha256(p_name), 1, 8) || '-' || substr(sha256(p_name), 9, 4) || '-' || substr(sha256(p_name), 13, 4) || '-' || substr(sha256(p_name), 17, 4) || '-' || substr(sha256(p_name), 21, 12) WHEN p_partkey % 3 = 1 THEN p_brand || p_name ELSE p_name END AS v FROM part)
SELECT p_partkey, regexp_full_match(v, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}') AS uuid, length(v) BETWEEN 16 AND 256 AND len(list_distinct(string_split(v, ''))) >= 8 AND regexp_matches(v, '[a-z]')::INT + regexp_matches(v, '[A-Z]')::INT + regexp_matches(v, '[0-9]')::INT + regexp_matches(v, '[^a-zA-Z0-9]')::INT >= 2 AS random FROM v""")
def value_tests(spark, sf_dir):
    h = F.sha2("p_name", 256)
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    value = F.when(F.col("p_partkey") % 3 == 0, uuid).when(F.col("p_partkey") % 3 == 1, F.concat("p_brand", "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", value.alias("v")).select("p_partkey", T.is_uuid(F.col("v")).alias("uuid"), T.looks_random(F.col("v")).alias("random"))


@query(r"""SELECT conv_id, turn, len(p) AS pieces, list_sum(list_transform(p, lambda x: length(x)))::BIGINT AS letters, sha256(array_to_string(p, '|')) AS digest FROM (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '(?s)\S.{0,59}(?:\s|$)|\S{60}'), lambda x: regexp_replace(x, '\s+$', '')) AS p FROM conversations WHERE text IS NOT NULL AND text <> '')""")
def reason_pieces(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text is not null and text <> ''").select("conv_id", "turn", T.split_reason(F.col("text"), 60).alias("p"))
    return rows.select("conv_id", "turn", F.size("p").cast("long").alias("pieces"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("letters"), F.sha2(F.array_join("p", "|"), 256).alias("digest"))


@query(r"""SELECT page_id, nullif(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)), '') AS scheme, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)), '') AS host FROM pages""")
def url_shapes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.url_scheme(F.col("url")).alias("scheme"), T.url_host(F.col("url")).alias("host"))


# --- outputs and selectors --------------------------------------------------------------------------------


@query("""SELECT doc_id, json_object('ruleId', 'toxic', 'level', 'error', 'message', json_object('text', 'flagged in ' || lang), 'locations', json_array(json_object('physicalLocation', json_object('artifactLocation', json_object('uri', 'documents/' || doc_id))))) ::VARCHAR AS result FROM labels JOIN documents USING (doc_id) WHERE toxic = 1 AND lang IS NOT NULL""")
def sarif_results(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").where("toxic = 1").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").where("lang is not null")
    place = F.struct(F.struct(F.struct(F.concat(F.lit("documents/"), "doc_id").alias("uri")).alias("artifactLocation")).alias("physicalLocation"))
    result = F.struct(F.lit("toxic").alias("ruleId"), F.lit("error").alias("level"), F.struct(F.concat(F.lit("flagged in "), "lang").alias("text")).alias("message"), F.array(place).alias("locations"))
    return rows.select("doc_id", F.to_json(result).alias("result"))


@query(r"""SELECT page_id AS doc, sum(len(regexp_extract_all(nav, '<li><a ')))::BIGINT AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<nav>.*?</nav>')) AS nav FROM pages) GROUP BY page_id HAVING sum(len(regexp_extract_all(nav, '<li><a '))) > 0""")
def selector_links(spark, sf_dir):
    nodes = trees.parse_html(table(spark, sf_dir, "pages").select("page_id", "html"))
    return selectors.select(nodes, "nav > ul > li > a, nav li > a").groupBy("doc").agg(F.count("*").alias("n"))


@query()
def selector_positions(spark, sf_dir):
    nodes = trees.parse_html(table(spark, sf_dir, "pages").select("page_id", "html"))
    return selectors.select(nodes, "ul:has(a) > li:nth-child(odd):not(li:nth-last-child(1))").groupBy("doc").agg(F.count("*").alias("n"))
