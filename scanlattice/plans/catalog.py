"""Queries of the engine's own operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scanlattice.functions import text as T
from scanlattice.operators import flows, queues, trees
from scanlattice.sources.files import table
from scanlattice.streaming import log

_Q: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _all() -> None:
    from scanlattice.plans import engine, reviews  # noqa: F401  (they register their queries; they import `query` from here)


def queries() -> dict:
    _all()
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)


# --- scalar functions ----------------------------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials by language, over all documents, with their greatest entropy."""
    from scanlattice.plans import engine

    return engine.credentials_by_language(spark, sf_dir)


@query("""SELECT p_partkey, CASE WHEN length(p_name) > 3 THEN substr(p_name, greatest(length(p_name) - 3, 0) + 1, greatest(0, length(p_name) - 1 - greatest(length(p_name) - 3, 0))) ELSE substr(p_name, 1, greatest(0, length(p_name) - 1)) END AS tail, substr(p_name, 3, 4) AS middle, '' AS nothing,
regexp_replace(p_name, '([a-z]+) ([a-z]+)', '\\2-\\1', 'g') AS swapped FROM part""")
def substring_and_replace(spark, sf_dir):
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", T.substring_range(name, -3, -1).alias("tail"), T.substring_range(name, 2, 6).alias("middle"), T.substring_range(name, 6, 2).alias("nothing"), F.regexp_replace(name, "([a-z]+) ([a-z]+)", "$2-$1").alias("swapped"))


_WORDS_SQL = r"list_filter(regexp_split_to_array(regexp_replace(regexp_replace(p_type || ' XMLHttp_' || p_name, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[-./ _]+'), lambda w: w != '')"


@query(f"""WITH w AS (SELECT p_partkey, list_transform({_WORDS_SQL}, lambda x: lower(x)) AS l FROM part)
SELECT p_partkey, array_to_string(l, '_') AS snake, array_to_string(l, '-') AS kebab, array_to_string(list_transform(l, lambda x: upper(x[1]) || x[2:]), '') AS pascal, l[1] || array_to_string(list_transform(l[2:], lambda x: upper(x[1]) || x[2:]), '') AS camel FROM w""")
def case_convert(spark, sf_dir):
    c = F.concat(F.col("p_type"), F.lit(" XMLHttp_"), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", *[T.convert(c, k).alias(k) for k in ("snake", "kebab", "pascal", "camel")])


@query("""SELECT page_id, sha256(url) AS digest, 'ev-' || substr(sha256('page' || chr(1) || url), 1, 16) AS id, regexp_matches(url, '^https?://[^/]*[.]example[.]org/.*$') AS wild, strpos(url, '://') > 0 AS has_scheme FROM pages""")
def ids_and_globs(spark, sf_dir):
    url = F.col("url")
    glob = url.rlike(T.glob_regex("http://*.example.org/**")) | url.rlike(T.glob_regex("https://*.example.org/**"))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(url, 256).alias("digest"), T.row_id("ev-", F.lit("page"), url).alias("id"), glob.alias("wild"), url.contains("://").alias("has_scheme"))


@query("""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, CASE WHEN value < 0 THEN NULL ELSE ceil(value::DECIMAL(18,6) * 3)::BIGINT END AS cost FROM events""")
def json_and_cost(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.when(F.col("value") >= 0, F.ceil(F.col("value").cast("decimal(18,6)") * 3).cast("long")).alias("cost"))


# --- rules over text, suppression, containment, change scope -------------------------------------

_LINKS, _NAV, _COMMENTS = 'href="[^"]*"', "<nav>.*?</nav>", "<!--.*?-->"
_SPAN_SQL = """
WITH p AS (SELECT page_id AS key, html FROM pages),
raw AS (SELECT key, kind, unnest(regexp_extract_all(html, pat)) AS value, unnest(range(1, len(regexp_extract_all(html, pat)) + 1)) AS n, html, pat FROM p, (VALUES ('link', 'href="[^"]*"'), ('nav', '<nav>.*?</nav>'), ('comment', '<!--.*?-->')) r(kind, pat)),
gaps AS (SELECT key, kind, n, value, length(regexp_split_to_array(html, pat)[n]) AS gap FROM raw),
s AS (SELECT key, kind, n - 1 AS n, value, sum(gap + length(value)) OVER (PARTITION BY key, kind ORDER BY n) AS stop FROM gaps)
"""


def _span(spark, sf_dir, pattern, kind):
    return flows.spans(table(spark, sf_dir, "pages"), pattern, "page_id", "html", kind)


@query(_SPAN_SQL + "SELECT key, kind, count(*) AS n, sum(stop - length(value))::BIGINT AS starts, sum(stop)::BIGINT AS stops FROM s GROUP BY ALL")
def pattern_spans(spark, sf_dir):
    rows = _span(spark, sf_dir, _LINKS, "link").unionByName(_span(spark, sf_dir, _NAV, "nav")).unionByName(_span(spark, sf_dir, _COMMENTS, "comment"))
    return rows.groupBy("key", "kind").agg(F.count("*").alias("n"), F.sum("start").cast("long").alias("starts"), F.sum("stop").cast("long").alias("stops"))


@query(_SPAN_SQL + "SELECT a.key, a.n AS link, b.n AS nav, a.value FROM s a JOIN s b ON a.key = b.key AND a.kind = 'link' AND b.kind = 'nav' AND a.stop - length(a.value) >= b.stop - length(b.value) AND a.stop <= b.stop")
def direct_containment(spark, sf_dir):
    rows = flows.contained(_span(spark, sf_dir, _LINKS, "link"), _span(spark, sf_dir, _NAV, "nav"))
    return rows.select("key", F.col("n").cast("long").alias("link"), F.col("o_n").cast("long").alias("nav"), "value")


_OPENS = "<[a-z]+"


@query(_SPAN_SQL.replace("('link', 'href=\"[^\"]*\"')", f"('open', '{_OPENS}')") + "SELECT key, count(*) AS n FROM s a WHERE kind = 'open' AND NOT EXISTS (SELECT 1 FROM s b WHERE b.key = a.key AND b.kind IN ('comment', 'nav') AND a.stop - length(a.value) < b.stop AND a.stop > b.stop - length(b.value)) GROUP BY key")
def comment_and_nav_filter(spark, sf_dir):
    ranges = _span(spark, sf_dir, _NAV, "nav").unionByName(_span(spark, sf_dir, _COMMENTS, "comment"))
    return flows.outside(_span(spark, sf_dir, _OPENS, "open"), ranges).groupBy("key").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE EXISTS (SELECT 1 FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 5 END AS low, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 5 + 1 END AS high FROM orders WHERE o_orderpriority = '1-URGENT') c WHERE c.k = l_orderkey AND (c.low IS NULL OR (l_linenumber <= c.high AND l_linenumber >= c.low)))""")
def changed_scope(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("start"), F.col("l_linenumber").alias("stop"), "l_partkey")
    whole = F.col("o_orderkey") % 3 == 0
    changes = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("key"), F.when(~whole, F.col("o_orderkey") % 5).alias("low"), F.when(~whole, F.col("o_orderkey") % 5 + 1).alias("high"))
    return flows.changed(items, changes).select(F.col("key").alias("l_orderkey"), F.col("start").alias("l_linenumber"), "l_partkey")


@query("""WITH RECURSIVE e AS (SELECT conv_id AS scope, 'v' || (turn + 1) % 4 AS lft, 'v' || turn % 4 AS rgt, turn AS "at", turn % 5 = 4 AS conditional FROM conversations),
r(scope, origin, name, "at", steps) AS (SELECT DISTINCT conv_id, 'v0', 'v0', -1, 0 FROM conversations UNION
 SELECT r.scope, r.origin, e.lft, e."at", r.steps + 1 FROM r JOIN e ON e.scope = r.scope AND e.rgt = r.name AND e."at" > r."at" AND NOT e.conditional
 WHERE r.steps < 4 AND NOT EXISTS (SELECT 1 FROM e k WHERE k.scope = r.scope AND k.lft = r.name AND k."at" > r."at" AND k."at" < e."at"))
SELECT scope, name, "at", min(steps)::INT AS steps FROM r GROUP BY ALL""")
def propagation(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("scope"), F.col("turn").cast("int").alias("at"))
    edges = turns.select("scope", F.concat(F.lit("v"), (F.col("at") + 1) % 4).alias("left"), F.concat(F.lit("v"), F.col("at") % 4).alias("right"), "at", (F.col("at") % 5 == 4).alias("conditional"))
    sources = turns.select("scope").distinct().select("scope", F.lit("v0").alias("name"), F.lit(-1).alias("at"))
    return flows.propagate(sources, edges).select("scope", "name", "at", "steps")


@query("""SELECT p_partkey, p_size FROM part WHERE p_size NOT IN (SELECT p_size FROM part WHERE p_brand = (SELECT min(p_brand) FROM part))""")
def ledger_subtraction(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    done = part.join(F.broadcast(part.agg(F.min("p_brand").alias("p_brand"))), "p_brand").select("p_size").distinct()
    return part.join(done, "p_size", "left_anti").select("p_partkey", "p_size")


# --- aggregates ----------------------------------------------------------------------------------


@query("""SELECT lang, source, count(*) AS n, count(DISTINCT sha256(text)) AS n_distinct, max(n_chars) AS longest FROM documents GROUP BY GROUPING SETS ((lang), (source), ())""")
def surface_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("h", F.sha2("text", 256))
    return docs.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n"), F.countDistinct("h").alias("n_distinct"), F.max("n_chars").alias("longest"))


# --- ranking, limits, samples, sets --------------------------------------------------------------


@query("""SELECT event_type, event_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS turn FROM events) ORDER BY turn, event_type, event_id LIMIT 48""")
def fair_marker_limit(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "event_id")
    return queues.fair_limit(rows, "event_type", ["event_id"], 48).select("event_type", "event_id", F.col("turn").cast("long").alias("turn"))


@query("""SELECT o_custkey, o_orderkey, place, n > 8 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE place <= 8""")
def per_key_caps(spark, sf_dir):
    rows = queues.capped(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", [F.desc("o_totalprice"), "o_orderkey"], 8)
    return rows.select("o_custkey", "o_orderkey", F.col("place").cast("long").alias("place"), "truncated")


@query("""SELECT o_orderkey FROM orders WHERE ('0x' || substr(sha256('seed:' || o_orderkey), 1, 8))::BIGINT % 100 < 10""")
def deterministic_sample(spark, sf_dir):
    return queues.sampled(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey"), "seed", 10)


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 50""")
def inventory_page(spark, sf_dir):
    return queues.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 50, 50)


@query("""SELECT sha256(text) AS h, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1""")
def exact_copy_groups(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


# --- state ---------------------------------------------------------------------------------------

_LOG_SQL = """WITH l AS (SELECT event_id AS sequence, user_id AS key, (event_id // 3) AS operation, event_type AS content, (value * 10)::BIGINT AS generation FROM events),
f AS (SELECT *, first_value(content) OVER (PARTITION BY key, operation ORDER BY sequence) AS c1, row_number() OVER (PARTITION BY key, operation ORDER BY sequence) AS n, generation AS own FROM l),
h AS (SELECT *, max(CASE WHEN n = 1 THEN generation END) OVER (PARTITION BY key ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM f),
o AS (SELECT *, CASE WHEN n > 1 AND c1 = content THEN 'idempotent' WHEN n > 1 THEN 'conflict' WHEN generation < g THEN 'stale' ELSE 'recorded' END AS outcome FROM h)
"""


def _log(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return log.fold(events.select(F.col("event_id").alias("sequence"), F.col("user_id").alias("key"), F.floor(F.col("event_id") / 3).alias("operation"), F.col("event_type").alias("content"), F.rint(F.col("value") * 10).cast("long").alias("generation")))


@query(_LOG_SQL + "SELECT outcome, count(*) AS n FROM o GROUP BY outcome")
def log_outcomes(spark, sf_dir):
    return _log(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


@query(_LOG_SQL + "SELECT key, max(sequence) AS sequence, arg_max(content, sequence) AS content FROM o WHERE outcome = 'recorded' GROUP BY key")
def log_heads(spark, sf_dir):
    return log.heads(_log(spark, sf_dir).where("outcome = 'recorded'")).select("key", "sequence", "content")


@query("""SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def windowed_events(spark, sf_dir):
    return log.windowed_counts(table(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


# --- trees (checked by tests: the node table is not SQL's) ---------------------------------------


@query()
def tree_nodes_by_kind(spark, sf_dir):
    return trees.parse_html(table(spark, sf_dir, "pages")).groupBy("kind").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))


@query(r"""SELECT page_id AS doc, sum(len(regexp_extract_all(nav, '<a '))) ::BIGINT AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<nav>.*?</nav>')) AS nav FROM pages) GROUP BY page_id HAVING sum(len(regexp_extract_all(nav, '<a '))) > 0""")
def tree_links_inside_nav(spark, sf_dir):
    nodes = trees.parse_html(table(spark, sf_dir, "pages").select("page_id", "html"))
    return trees.related(trees.kind(nodes, "a"), "inside", trees.kind(nodes, "nav")).groupBy("doc").agg(F.count("*").alias("n"))


@query()
def tree_odd_items_before_last(spark, sf_dir):
    nodes = trees.parse_html(table(spark, sf_dir, "pages"))
    items = trees.nth_child(nodes, 2, 1, of=F.col("kind") == "li")
    return trees.related(items, "precedes", trees.kind(nodes, "li")).select("doc", "pre", "sib")
