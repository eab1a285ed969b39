"""Queries of scans, code, relations, evaluation, budgets, state and lookups over the supplied tables.

Most operators ask for inputs that the tables do not have (sources, evidence, verdicts); these are derived from the
tables' columns, the same way in the query and in its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scanlattice.functions import text as T
from scanlattice.functions.tables import written
from scanlattice.operators import advisories, budgets, code, credentials, evaluation, facts, ledgers, lookups, queues, relations, reports, rules, scanning, state
from scanlattice.plans.catalog import query
from scanlattice.sources import repository
from scanlattice.sources.files import table

# --- credentials -----------------------------------------------------------------------------------

_MARK = "scan: allow"


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: `token` is renamed to a name of the catalog; the last lines have provider-like tokens of 39 to
    41 characters and, in some, an allow mark."""
    h = F.sha2(F.concat(F.lit("t"), F.col("doc_id")), 256)
    last = F.concat(F.lit("\nx = ghp_"), F.substring(h, F.lit(1), (F.col("doc_id") % 3 + 35).cast("int")), F.when(F.col("doc_id") % 5 == 0, F.lit("  # " + _MARK)).otherwise(""), F.lit("\ngl = 'glpat-"), F.substring(h, 1, 22), F.lit("'"))
    text = F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), r"\btoken\b", "auth_token"), last)
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.concat("doc_id", F.lit(".txt"))).alias("path"), "lang", text.alias("text"))


_SENSITIVE = "password|passwd|secret|api_key|apikey|access_token|auth_token|client_secret|private_key"
_PLACE = "example|sample|dummy|placeholder|replace|redacted|changeme|not-a-real|not_real|fake|[$][{]"
_QUOTE = r"""(?:"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*''|`(?:[^`\\]|\\.)*`)"""
_PLAIN = r"""[^''"`=!<>]"""
_EQUALS = rf"""^((?:(?:{_PLAIN}|{_QUOTE})*(?:[!<>][=!<>]*|=[=>][=!<>]*)(?:{_PLAIN}|{_QUOTE}))*(?:{_PLAIN}|{_QUOTE})*)=(?:[^=>]|$)"""
_COLON = rf"""^((?:[^''"`:]|{_QUOTE})*):"""
_FOUND_SQL = rf"""
WITH f AS (SELECT source || '/' || doc_id || '.txt' AS path, lang, regexp_replace(coalesce(text, ''), '\btoken\b', 'auth_token', 'g') || chr(10) || 'x = ghp_' || substr(sha256('t' || doc_id), 1, (doc_id % 3 + 35)::BIGINT) || CASE WHEN doc_id % 5 = 0 THEN '  # {_MARK}' ELSE '' END || chr(10) || 'gl = ''glpat-' || substr(sha256('t' || doc_id), 1, 22) || '''' AS text FROM documents),
l AS (SELECT path, lang, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS value FROM f),
s AS (SELECT *, CASE WHEN regexp_matches(value, '{_EQUALS}') THEN length(regexp_extract(value, '{_EQUALS}', 1)) WHEN regexp_matches(value, '{_COLON}') THEN length(regexp_extract(value, '{_COLON}', 1)) END AS pos FROM l WHERE regexp_matches(lower(value), '{_SENSITIVE}')),
v AS (SELECT *, regexp_extract(ltrim(substr(value, pos + 2), ' ' || chr(9)), '^(?:"([^"]*)|''([^'']*)|`([^`]*)|((?:[^\s,;/''"`]|/[^\s,;/])*))', ['a', 'b', 'c', 'd']) AS m FROM s WHERE regexp_matches(lower(substr(value, 1, pos)), '{_SENSITIVE}')),
g AS (SELECT path, lang, line, 'generic_high_entropy_assignment' AS detector, m.a || m.b || m.c || m.d AS secret, value FROM v),
ok AS (SELECT *, list_transform(list_distinct(string_split(secret, '')), lambda c: (length(secret) - length(replace(secret, c, '')))::DOUBLE / length(secret)) AS shares FROM g WHERE length(secret) BETWEEN 16 AND 256 AND regexp_full_match(secret, '[!-~]*') AND NOT regexp_matches(secret, '[''"`,;<>]') AND NOT regexp_matches(lower(secret), '{_PLACE}')
 AND NOT regexp_full_match(secret, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}') AND strpos(secret, '://') = 0 AND len(list_distinct(string_split(secret, ''))) >= 8
 AND regexp_matches(secret, '[a-z]')::INT + regexp_matches(secret, '[A-Z]')::INT + regexp_matches(secret, '[0-9]')::INT + regexp_matches(secret, '[^a-zA-Z0-9]')::INT >= 2),
generic AS (SELECT path, lang, line, detector, secret, value, round(list_sum(list_transform(shares, lambda p: -p * log2(p))) * 1000)::BIGINT AS bits FROM ok WHERE list_sum(list_transform(shares, lambda p: -p * log2(p))) >= 3.5),
provider AS (SELECT path, lang, line, 'github_personal_access_token' AS detector, regexp_extract(value, '(?:^|[^A-Za-z0-9])(ghp_[A-Za-z0-9]*)', 1) AS secret, value, NULL::BIGINT AS bits FROM l UNION ALL SELECT path, lang, line, 'gitlab_personal_access_token', regexp_extract(value, '(?:^|[^A-Za-z0-9_-])(glpat-[A-Za-z0-9_-]*)', 1), value, NULL FROM l),
found AS (SELECT * FROM generic UNION ALL SELECT * FROM provider WHERE (detector LIKE 'github%' AND length(secret) = 40 OR detector LIKE 'gitlab%' AND length(secret) BETWEEN 26 AND 128) AND NOT regexp_matches(lower(secret), '{_PLACE}')),
r AS (SELECT path, lang, line, detector, length(secret) AS length, bits, strpos(lower(value), '{_MARK}') > 0 AS marked FROM found)
"""


def _finds(spark, sf_dir, **more):
    return credentials.detect(_sources(spark, sf_dir), marker=_MARK, **more)


@query(_FOUND_SQL + "SELECT path, line, detector, length, bits::VARCHAR AS entropy_millibits, marked AS suppressed FROM r")
def credential_findings(spark, sf_dir):
    return _finds(spark, sf_dir).select("path", "line", "detector", "length", F.col("entropy_millibits").cast("string").alias("entropy_millibits"), "suppressed")


@query(_FOUND_SQL + "SELECT detector, count(*) FILTER (NOT (marked OR starts_with(path, 'src7/'))) AS reported, count(*) FILTER (marked OR starts_with(path, 'src7/')) AS suppressed FROM r GROUP BY detector")
def credential_counts(spark, sf_dir):
    return credentials.counts(_finds(spark, sf_dir, allowed=credentials.allow_list("path = src7/**\n")[0]))


@query(_FOUND_SQL + "SELECT f.lang, count(DISTINCT f.path) AS n_documents, count(detector) AS n_credentials, max(bits)::VARCHAR AS most_millibits FROM f LEFT JOIN r USING (path) GROUP BY f.lang")
def credentials_by_language(spark, sf_dir):
    files = _sources(spark, sf_dir)
    found = credentials.detect(files, marker=_MARK).groupBy("path").agg(F.count("*").alias("n"), F.max("entropy_millibits").alias("bits"))
    return files.select("path", "lang").join(found, "path", "left").groupBy("lang").agg(F.count("*").alias("n_documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_credentials"), F.max("bits").cast("string").alias("most_millibits"))


@query(_FOUND_SQL + "SELECT path, sha256(regexp_replace(text, secret, '[REDACTED]')) AS masked FROM f JOIN (SELECT path, secret FROM found WHERE detector LIKE 'gitlab%') USING (path)")
def credential_masks(spark, sf_dir):
    """Texts with their last token masked."""
    files = _sources(spark, sf_dir)
    spans = credentials.detect(files, marker=_MARK).where("detector like 'gitlab%'").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    return files.join(spans, "path").select("path", F.sha2(credentials.masked(F.col("text"), F.col("spans")), 256).alias("masked"))


# --- repositories ------------------------------------------------------------------------------------

_EXTENSIONS = ["py", "test.ts", "js", "min.js", "md", "rb", "bin", "java", "cs", "designer.cs", "H", "vue"]
_FOLDERS = ["src", "src/main/java/com/example", "tests", "lib/unit_tests", "example", "node_modules/m", "app/.next/x", "a/_next/static", "src/contest"]
_PATH_SQL = f"{_FOLDERS}[(doc_id % {len(_FOLDERS)})::INT + 1] || '/' || CASE WHEN doc_id % 50 = 7 THEN '.env' WHEN doc_id % 50 = 8 THEN 'Dockerfile' ELSE 'f' || doc_id || '.' || {_EXTENSIONS}[(doc_id % {len(_EXTENSIONS)})::INT + 1] END"


def _files(spark, sf_dir):
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values)).cast("int") + 1)
    name = F.when(F.col("doc_id") % 50 == 7, ".env").when(F.col("doc_id") % 50 == 8, "Dockerfile").otherwise(F.concat(F.lit("f"), "doc_id", F.lit("."), pick(_EXTENSIONS)))
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", pick(_FOLDERS), name).alias("path"))


_CLASS_SQL = f"""WITH p AS (SELECT doc_id, {_PATH_SQL} AS path FROM documents),
k AS (SELECT doc_id, path, regexp_extract(path, '[^/]*$') AS name, lower(regexp_extract(path, '[^/][.]([^./]+)$', 1)) AS ext FROM p WHERE NOT regexp_matches(path, '(^|/)(node_modules|[.]next)/|_next/static/')),
c AS (SELECT *, CASE WHEN ext = 'py' THEN 'python' WHEN ext = 'ts' THEN 'typescript' WHEN ext = 'js' THEN 'javascript' WHEN ext = 'md' THEN 'secret_only' WHEN ext = 'rb' THEN 'unsupported_source' WHEN ext = 'java' THEN 'java' WHEN ext = 'cs' THEN 'csharp' WHEN ext = 'h' THEN 'cpp' WHEN ext = 'vue' THEN 'vue' ELSE 'ignored' END AS own,
 regexp_matches(path, '(^|/)(tests|unit_tests)/') OR regexp_matches(path, '^example/') OR regexp_matches(name, '[.](test|designer)[.]|[.]min[.]js') AS excluded FROM k),
f AS (SELECT doc_id, path, CASE WHEN name IN ('.env', 'Dockerfile') THEN 'secret_only' WHEN excluded AND own NOT IN ('secret_only', 'unsupported_source', 'ignored') THEN 'secret_only' ELSE own END AS class, ext, excluded FROM c)
"""


@query(_CLASS_SQL + "SELECT path, class FROM f")
def path_classes(spark, sf_dir):
    return repository.walk(_files(spark, sf_dir).select("path"))[0].select("path", "class")


@query(_CLASS_SQL + """SELECT CASE WHEN ext = '' THEN '(none)' ELSE ext END AS extension, count(*) FILTER (class = 'ignored') AS non_source, count(*) FILTER (class = 'secret_only') AS secret_scan_disabled, count(*) FILTER (class = 'unsupported_source') AS unsupported_source FROM f GROUP BY 1 HAVING count(*) FILTER (class IN ('ignored', 'secret_only', 'unsupported_source')) > 0""")
def omitted_extensions(spark, sf_dir):
    files = repository.walk(_files(spark, sf_dir).select("path"))[0].withColumn("skipped", F.lit(None).cast("string")).withColumn("parse_failed", F.lit(False))
    return repository.omitted_by_extension(repository.coverage(files))


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), r AS (SELECT doc_id, t, CASE WHEN doc_id % 9 = 1 THEN 'not UTF-8' WHEN doc_id % 9 = 2 THEN 'binary content' END AS bad, octet_length(encode(t)) + CASE WHEN doc_id % 9 IN (1, 2) THEN 1 ELSE 0 END AS n FROM t)
SELECT CASE WHEN n > 3000 THEN 'size limit exceeded' ELSE bad END AS reason, count(*) AS n, sum(CASE WHEN n <= 3000 AND bad IS NULL THEN length(t) ELSE 0 END)::BIGINT AS letters FROM r GROUP BY 1""")
def bounded_texts(spark, sf_dir):
    tail = F.when(F.col("doc_id") % 9 == 1, F.unhex(F.lit("FF"))).when(F.col("doc_id") % 9 == 2, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("")))
    rows = table(spark, sf_dir, "documents").select(F.concat(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), tail).alias("content"))
    read = repository.bounded_text(rows.withColumn("length", F.length("content")), 3000)
    return read.groupBy(F.regexp_replace("skipped", ":.*", "").alias("reason")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("letters"))


@query(_CLASS_SQL + """SELECT count(*) AS discovered, count(*) FILTER (class NOT IN ('secret_only', 'unsupported_source', 'ignored') AND doc_id % 6 <> 1) AS scanned, count(*) FILTER (class = 'ignored') AS ignored, count(*) FILTER (class = 'unsupported_source') AS unsupported,
count(*) FILTER (class NOT IN ('secret_only', 'unsupported_source', 'ignored') AND doc_id % 6 = 1) AS parse_failed, count(*) FILTER (class = 'secret_only' AND doc_id % 4 <> 0) AS secret_scanned, count(*) FILTER (class = 'secret_only' AND doc_id % 4 = 0) AS secret_skipped FROM f""")
def coverage_totals(spark, sf_dir):
    files = _files(spark, sf_dir).withColumn("skipped", F.when(F.col("doc_id") % 4 == 0, "binary content")).withColumn("parse_failed", F.col("doc_id") % 6 == 1).drop("text")
    return repository.totals(repository.coverage(repository.walk(files)[0], secrets_enabled=True))


_SNAPSHOT_SQL = """WITH b AS (SELECT 'd' || doc_id AS path, text FROM documents WHERE source <> 'src3'),
a AS (SELECT CASE WHEN source = 'src4' THEN 'moved/d' ELSE 'd' END || doc_id AS path, CASE WHEN lang = 'de' THEN text || chr(10) || 'one more' || chr(10) || 'line' ELSE text END AS text FROM documents WHERE source <> 'src5')
"""


def _snapshots(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    before = docs.where("source != 'src3'").select(F.concat(F.lit("d"), "doc_id").alias("path"), "text")
    text = F.when(F.col("lang") == "de", F.concat("text", F.lit("\none more\nline"))).otherwise(F.col("text"))
    after = docs.where("source != 'src5'").select(F.concat(F.when(F.col("source") == "src4", "moved/d").otherwise("d"), "doc_id").alias("path"), text.alias("text"))
    return before, after


@query(_SNAPSHOT_SQL + """, j AS (SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'deleted' WHEN a.text IS NOT DISTINCT FROM b.text THEN 'unchanged' ELSE 'modified' END AS status, b.text AS old, a.text AS new FROM b FULL JOIN a ON a.path = b.path),
g AS (SELECT min(path) AS gone, sha256(coalesce(old, '')) AS h FROM j WHERE status = 'deleted' GROUP BY h), n AS (SELECT min(path) AS path, sha256(coalesce(new, '')) AS h FROM j WHERE status = 'added' GROUP BY h), m AS (SELECT path, gone FROM n JOIN g USING (h))
SELECT j.path, CASE WHEN m.path IS NOT NULL THEN 'renamed' ELSE status END AS status, m.gone AS previous_path FROM j LEFT JOIN m ON m.path = j.path WHERE status <> 'unchanged' AND j.path NOT IN (SELECT gone FROM m)""")
def repository_changes(spark, sf_dir):
    return repository.changes(*_snapshots(spark, sf_dir)).select("path", "status", "previous_path")


@query(_SNAPSHOT_SQL + """, l AS (SELECT a.path, unnest(range(1, len(string_split(a.text, chr(10))) + 1)) AS n, unnest(string_split(a.text, chr(10))) AS v FROM a JOIN b USING (path) WHERE a.text <> b.text),
o AS (SELECT path, v, count(*) AS k FROM (SELECT b.path, unnest(string_split(b.text, chr(10))) AS v FROM b) GROUP BY ALL), r AS (SELECT l.*, row_number() OVER (PARTITION BY path, v ORDER BY n) AS i FROM l)
SELECT r.path, min(n)::INT AS low, max(n)::INT AS high, count(*) AS lines FROM r LEFT JOIN o USING (path, v) WHERE i > coalesce(k, 0) GROUP BY r.path""")
def changed_lines(spark, sf_dir):
    rows = repository.changes(*_snapshots(spark, sf_dir)).where("status = 'modified'").select("path", F.explode("changed_lines").alias("c"))
    return rows.groupBy("path").agg(F.min("c.low").alias("low"), F.max("c.high").alias("high"), F.sum(F.col("c.high") - F.col("c.low") + 1).cast("long").alias("lines"))


# --- code ----------------------------------------------------------------------------------------------

_CODE_SQL = """WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) AS n, l_partkey % 4 AS a, l_suppkey % 4 AS b, l_quantity::BIGINT AS q, l_returnflag AS f FROM lineitem)
"""


def _calls(spark, sf_dir):
    """A source for each order: an import and a statement for each item, those of returned ones inside an `if`."""
    rows = table(spark, sf_dir, "lineitem").repartition("l_orderkey")  # dealt out once, before lists are made
    items = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_returnflag"))).alias("items"))

    def line(x, at):
        n = (at + 1).cast("string")
        a, b, q = (F.coalesce(v.cast("string"), F.lit("null")) for v in (x["l_partkey"] % 4, x["l_suppkey"] % 4, x["l_quantity"].cast("long")))
        call = F.concat(F.lit("t"), n, F.lit(" = price("), a, F.lit(", "), b, F.lit(", qty="), q, F.lit(")"))
        return F.when(x["l_returnflag"] == "R", F.concat(F.lit("if flag("), n, F.lit("):\n    "), call)).otherwise(call)

    text = F.concat(F.lit("from shop.rates import price\n"), F.array_join(F.transform("items", line), "\n"), F.lit("\n"))
    return items.select(F.col("l_orderkey").cast("string").alias("path"), text.alias("text"))


@query(_CODE_SQL + "SELECT l_orderkey::VARCHAR AS doc, a::VARCHAR AS twice, count(*) AS n FROM l WHERE a = b GROUP BY ALL")
def code_same_arguments(spark, sf_dir):
    found = code.matches(_calls(spark, sf_dir), {"twice": "price($A, $A, $$$REST)"}, columns=["captures"])
    return found.groupBy("doc", F.col("captures")["A"]["text"].alias("twice")).agg(F.count("*").alias("n"))


@query(_CODE_SQL + "SELECT l_orderkey::VARCHAR AS doc, count(*) FILTER (q = 7) AS exact, count(*) AS any_of FROM l GROUP BY l_orderkey")
def code_strictness(spark, sf_dir):
    found = code.counted(_calls(spark, sf_dir), {"exact": {"pattern": "price($_, $_, qty=7)", "strictness": "cst"}, "any_of": {"pattern": "price(1, 2, qty=3)", "strictness": "signature"}})
    return found.where("exact > 0 or any_of > 0")


def _tree(spark, sf_dir):
    return written(code.nodes(_calls(spark, sf_dir)), "nodes")


@query(_CODE_SQL + "SELECT l_orderkey::VARCHAR AS doc, count(*) FILTER (f = 'R') AS inside, count(*) FILTER (f <> 'R') AS outside FROM l GROUP BY l_orderkey")
def rule_calls_inside_if(spark, sf_dir):
    utilities = {"price": {"kind": "Call", "regex": "^price"}, "within": {"arguments": ["KIND"], "rule": {"inside": {"kind": "$KIND", "stopBy": "end"}}}}
    specs = {"inside": {"all": [{"matches": "price"}, {"matches": {"name": "within", "KIND": "If"}}]}, "outside": {"matches": "price", "not": {"inside": {"kind": "If", "stopBy": "end"}}}}
    found = rules.hits(_calls(spark, sf_dir), {n: {"rule": r} for n, r in specs.items()}, utilities, columns=["rule"])
    return found.groupBy("doc").agg(*[F.count_if(F.col("rule") == n).alias(n) for n in specs])


@query(_CODE_SQL + "SELECT l_orderkey::VARCHAR AS doc, n::INT AS place, q::VARCHAR AS value FROM l WHERE n % 2 = 1 AND a > 1 AND f <> 'R'")
def rule_constraints_and_positions(spark, sf_dir):
    sources = _calls(spark, sf_dir)
    rule = {"kind": "Assign", "pattern": "$T = price($A, $B, qty=$Q)", "not": {"inside": {"kind": "If"}}}
    found = rules.hits(sources, {"odd": {"rule": rule, "constraints": {"A": {"regex": "^[23]$"}, "T": {"regex": "[13579]$"}}}}, columns=["captures"])
    return found.select("doc", F.substring(F.col("captures")["T"]["text"], 2, 9).cast("int").alias("place"), F.col("captures")["Q"]["text"].alias("value"))


@query(_CODE_SQL + """SELECT l_orderkey::VARCHAR AS doc, sha256('from shop.rates import price' || chr(10) || string_agg(CASE WHEN f = 'R' THEN 'if flag(' || n || '):' || chr(10) || '    ' ELSE '' END || 't' || n || ' = cost(' || q || ', [' || a || ', ' || b || '])  # T' || n, chr(10) ORDER BY n) || chr(10)) AS patched FROM l GROUP BY l_orderkey""")
def code_fixes(spark, sf_dir):
    sources = _calls(spark, sf_dir)
    patched = rules.fixed(sources, "$T = price($A, $B, qty=$Q)", "$T = cost($Q, [$A, $B])  # $NAME", {"NAME": {"source": "$T", "convert": "upper"}})
    return patched.select(F.col("path").alias("doc"), F.sha2("text", 256).alias("patched"))


@query(_CODE_SQL + """SELECT 'shop.rates.price' AS canonical, count(*) AS sites, sum(q)::BIGINT::VARCHAR AS quantity FROM l UNION ALL SELECT 'flag', count(*), NULL FROM l WHERE f = 'R'""")
def code_call_sites(spark, sf_dir):
    sites = code.sites(_calls(spark, sf_dir), columns=["arguments", "canonical"])
    quantity = F.expr("try_cast(regexp_extract(element_at(arguments, -1), '^qty=([0-9]+)$', 1) as bigint)")
    return sites.groupBy("canonical").agg(F.count("*").alias("sites"), F.sum(quantity).cast("string").alias("quantity"))


# --- relations -------------------------------------------------------------------------------------------

_EVIDENCE_SQL = """WITH e AS (SELECT event_id, 'ev' || event_id AS id, 'u' || user_id AS path, 'd' || ((hour(ts) // 12) + day(ts) * 2) AS scope, CASE event_type WHEN 'view' THEN 'source' WHEN 'click' THEN 'source' WHEN 'purchase' THEN 'sink' WHEN 'error' THEN 'protection' ELSE 'other' END AS kind,
 CASE event_type WHEN 'view' THEN 'request' WHEN 'click' THEN 'input' WHEN 'purchase' THEN 'query' WHEN 'error' THEN 'parameters' ELSE 'note' END AS capability, value::INT AS start, value::INT + CASE WHEN event_type = 'purchase' THEN 60 ELSE 3 END AS stop, (event_id // 10)::INT AS line, event_id % 13 = 0 AS dead, (event_id % 3)::VARCHAR AS txt FROM events),
p AS (SELECT s.id AS source, k.id AS sink, s.path, s.scope, k.txt, s.line AS sline, k.line AS kline FROM e s JOIN e k ON s.path = k.path AND s.scope = k.scope AND s.kind = 'source' AND k.kind = 'sink' AND NOT s.dead AND NOT k.dead AND s.start >= k.start AND s.stop <= k.stop - 10),
g AS (SELECT p.*, (SELECT count(*) FROM e g WHERE g.kind = 'protection' AND NOT g.dead AND g.path = p.path AND g.scope = p.scope AND g.txt = p.txt) AS n FROM p)
"""
_CONTRACT = {"id": "request-to-query", "version": 1, "source": {"capabilities": ["request", "input"]}, "sink": {"capability": "query", "input_roles": ["query"]}, "protection": {"capability": "parameters", "application": "related_capture", "relation_role": "query"}, "cwe_candidates": ["CWE-89"], "strategy": "bounded_local_value"}


def _evidence(spark, sf_dir):
    e = F.col("event_type")
    pick = lambda *of: F.coalesce(*[F.when(e == k, F.lit(v)) for k, v in of[:-1]], F.lit(of[-1]))
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("ev"), "event_id").alias("id"), F.concat(F.lit("u"), "user_id").alias("path"), F.concat(F.lit("d"), F.floor(F.hour("ts") / 12) + F.dayofmonth("ts") * 2).alias("scope"), F.lit("sql").alias("language"),
        pick(("view", "source"), ("click", "source"), ("purchase", "sink"), ("error", "protection"), "other").alias("kind"), pick(("view", "request"), ("click", "input"), ("purchase", "query"), ("error", "parameters"), "note").alias("capability"),
        F.bround("value").cast("int").alias("start"), (F.bround("value").cast("int") + F.when(e == "purchase", 60).otherwise(3)).alias("stop"), F.floor(F.col("event_id") / 10).cast("int").alias("line"),
        F.floor(F.col("event_id") / 10).cast("int").alias("end_line"), F.lit("r").alias("rule"), F.when(e == "purchase", F.array(F.lit("CWE-89"))).otherwise(F.array().cast("array<string>")).alias("cwes"), F.when(F.col("event_id") % 13 == 0, "unreachable").alias("reachability"),
        F.array(F.concat(F.lit("ev"), F.col("event_id") - 1)).alias("related"), (F.col("event_id") % 3).cast("string").alias("txt"),
    )
    capture = F.struct(F.lit("query").alias("role"), F.col("txt").alias("text"), F.col("start"), (F.col("stop") - F.when(F.col("kind") == "sink", 10).otherwise(0)).alias("stop"))
    return rows.withColumn("captures", F.array(capture)).drop("txt")


def _paths(spark, sf_dir):
    found = _evidence(spark, sf_dir)
    return found, relations.security_paths(found, relations.catalog(spark, [_CONTRACT]))


@query(_EVIDENCE_SQL + "SELECT source, sink, CASE WHEN n > 0 THEN 'protected' ELSE 'direct' END AS state, n AS protections FROM g")
def security_paths(spark, sf_dir):
    return _paths(spark, sf_dir)[1].select("source", "sink", "state", F.size("protections").cast("long").alias("protections"))


@query(_EVIDENCE_SQL + ", c AS (SELECT capability, count(*) FILTER (kind = 'source') AS sources, count(*) FILTER (kind = 'sink') AS sinks FROM e GROUP BY capability) SELECT capability, sources, sinks, CASE WHEN capability = 'query' THEN (SELECT count(*) FROM g) ELSE 0 END AS paths FROM c")
def evidence_funnel(spark, sf_dir):
    return relations.funnel(*_paths(spark, sf_dir))


@query(_EVIDENCE_SQL + "SELECT source, s.capability AS source_capability, sink, n AS protections FROM g JOIN e s ON s.id = g.source")
def candidate_report(spark, sf_dir):
    found, paths = _paths(spark, sf_dir)
    return relations.candidates(paths, found).select("source", F.col("source_evidence.capability").alias("source_capability"), "sink", F.size("protection_evidence").cast("long").alias("protections"))


_CHANGED = "(path IN ('u1', 'u2') OR path IN ('u3', 'u4', 'u5') AND line BETWEEN 20 AND 400)"


@query(_EVIDENCE_SQL + f""", w AS (SELECT g.* FROM g WHERE EXISTS (SELECT 1 FROM (SELECT g.path AS path, unnest([g.sline, g.kline]) AS line) WHERE {_CHANGED})),
own AS (SELECT * FROM e WHERE {_CHANGED}), ids AS (SELECT source AS id FROM w UNION SELECT sink FROM w UNION SELECT id FROM own UNION SELECT 'ev' || (event_id - 1) FROM own UNION SELECT x.id FROM w JOIN e x ON x.kind = 'protection' AND NOT x.dead AND x.path = w.path AND x.scope = w.scope AND x.txt = w.txt)
SELECT kind, count(*) AS n FROM e WHERE id IN (SELECT id FROM ids) GROUP BY kind UNION ALL SELECT 'path', count(*) FROM w""")
def changed_results(spark, sf_dir):
    found, paths = _paths(spark, sf_dir)
    ranges = [("u1", []), ("u2", []), *((f"u{k}", [(20, 400)]) for k in (3, 4, 5))]
    changes = spark.createDataFrame([(p, "modified", None, r) for p, r in ranges], "path string, status string, previous_path string, changed_lines array<struct<low:int,high:int>>")
    kept, own = relations.changed_results(found, paths, changes)
    return kept.groupBy("kind").agg(F.count("*").alias("n")).unionByName(own.agg(F.count("*").alias("n")).select(F.lit("path").alias("kind"), "n"))


@query("""WITH f AS (SELECT DISTINCT 'd' || (o_custkey % 40) || '/f' || o_custkey AS path FROM orders), c AS (SELECT path FROM f WHERE path LIKE 'd7/%' OR path LIKE 'd9/f9%'), n AS (SELECT split_part(path, '/', 1) AS dir, count(*) AS n FROM f GROUP BY 1),
i AS (SELECT DISTINCT 'd' || (o_custkey % 40) || '/f' || o_custkey AS importer, 'd' || ((o_custkey + 3) % 40) || '/f' || (o_custkey + 3) AS imported FROM orders),
r AS (SELECT path, 0 AS k FROM c UNION ALL SELECT f.path, 1 FROM f JOIN n ON n.dir = split_part(f.path, '/', 1) AND n.n <= 20 WHERE n.dir IN (SELECT split_part(path, '/', 1) FROM c) UNION ALL SELECT importer, 2 FROM i JOIN c ON c.path = imported)
SELECT path, ['changed', 'same_directory_context', 'direct_dependent'][min(k) + 1] AS reason FROM r GROUP BY path""")
def impact_scope(spark, sf_dir):
    path = lambda c: F.concat(F.lit("d"), c % 40, F.lit("/f"), c)
    key = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c")).distinct()
    files = key.select(path(F.col("c")).alias("path"))
    changed = files.where("path like 'd7/%' or path like 'd9/f9%'").withColumn("status", F.lit("modified"))
    return relations.impact_scope(files, changed, key.select(path(F.col("c")).alias("importer"), path(F.col("c") + 3).alias("imported")))[0]


# --- evaluation --------------------------------------------------------------------------------------------

_SCORE_SQL = """WITH t AS (SELECT 't' || o_orderkey AS trial, o_orderkey AS c, o_orderpriority AS mode, CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN 'error' ELSE 'completed' END AS status, o_custkey AS input FROM orders),
l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) AS n FROM lineitem),
x AS (SELECT DISTINCT l_orderkey AS c, 'C' || l_linenumber % 3 AS cwe, l_linenumber AS line FROM l WHERE l_returnflag = 'R'),
p AS (SELECT l_orderkey AS c, 'C' || l_linenumber % 3 AS cwe, l_linenumber AS line, n, l_linestatus = 'O' AS cited, l_linenumber = 7 AS ignored, l_linenumber = 6 AND l_linenumber % 3 = 0 AS safe FROM l WHERE l_quantity > 10),
h AS (SELECT p.c, p.cwe, p.line, min(n) AS n FROM p JOIN x ON x.c = p.c AND x.cwe = p.cwe AND x.line = p.line WHERE NOT ignored AND NOT safe GROUP BY ALL),
q AS (SELECT p.*, h.n IS NOT NULL AS hit FROM p LEFT JOIN h USING (c, cwe, line, n)),
per AS (SELECT c, count(*) FILTER (hit) AS tp, count(*) FILTER (hit AND cited) AS tpc, count(*) FILTER (ignored) AS ig, count(*) FILTER (NOT ignored AND safe) AS sf, count(*) FILTER (NOT ignored AND NOT hit) AS fp FROM q GROUP BY c),
w AS (SELECT c, count(*) AS expected FROM x GROUP BY c),
m AS (SELECT mode, count(*) AS trials, count(*) FILTER (status IS NULL) AS missing, count(*) FILTER (status = 'error') AS errors, sum(input)::BIGINT AS input_tokens, sum(coalesce(expected, 0))::BIGINT AS expected, sum(CASE WHEN status = 'completed' THEN coalesce(tp, 0) ELSE 0 END)::BIGINT AS true_positives, sum(CASE WHEN status = 'completed' THEN coalesce(fp, 0) ELSE 0 END)::BIGINT AS false_positives,
 sum(CASE WHEN status = 'completed' THEN coalesce(sf, 0) ELSE 0 END)::BIGINT AS safe_region_false_positives, sum(CASE WHEN status = 'completed' THEN coalesce(ig, 0) ELSE 0 END)::BIGINT AS ignored_predictions, sum(CASE WHEN status = 'completed' THEN coalesce(tpc, 0) ELSE 0 END)::BIGINT AS true_positives_cited FROM t LEFT JOIN per USING (c) LEFT JOIN w USING (c) GROUP BY mode)
SELECT *, expected - true_positives AS false_negatives, CASE WHEN expected = 0 THEN 0 ELSE true_positives * 10000 // expected END AS recall_bp, CASE WHEN true_positives + false_positives = 0 THEN 0 ELSE true_positives * 10000 // (true_positives + false_positives) END AS precision_bp FROM m
"""


@query(_SCORE_SQL)
def evaluation_scores(spark, sf_dir):
    from pyspark.sql import Window

    key, case = F.col("o_orderkey"), F.col("o_orderkey").cast("string").alias("case")
    status = F.when(key % 17 == 0, None).when(key % 19 == 0, "error").otherwise("completed")
    none = F.lit(0).cast("long")
    trials = table(spark, sf_dir, "orders").select(F.concat(F.lit("t"), key).alias("trial"), case, F.col("o_orderpriority").alias("mode"), status.alias("status"), F.col("o_custkey").alias("input_tokens"), none.alias("output_tokens"), none.alias("requests"), none.alias("latency_ms"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    items = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(order).cast("long"))
    cwe, line = F.concat(F.lit("C"), F.col("l_linenumber") % 3).alias("cwe"), F.col("l_linenumber").cast("long")
    own, said, file = F.col("l_orderkey").cast("string").alias("case"), F.lit("confirmed").alias("disposition"), F.lit("f").alias("file")
    expected = items.where("l_returnflag = 'R'").select(own, line.alias("expectation"), cwe, said, file, line.alias("start_line"), line.alias("end_line")).distinct()
    cited = F.col("l_linestatus") == "O"
    predictions = items.where("l_quantity > 10").select(F.concat(F.lit("t"), "l_orderkey").alias("trial"), F.col("n").alias("ordinal"), cwe, said, F.lit("./f").alias("file"), line.alias("line"), cited.alias("cited"), none.alias("citations"), none.alias("valid_citations"))
    region = lambda kind, c, at: trials.select("case", F.lit(kind).alias("kind"), F.lit(c).alias("cwe"), file, F.lit(at).cast("long").alias("start_line"), F.lit(at).cast("long").alias("end_line"))
    regions = region("ignored", None, 7).unionByName(region("safe", "C0", 6))
    out = evaluation.score(trials, predictions, expected, regions)
    return out.select("mode", "trials", "missing", "errors", "input_tokens", "expected", "true_positives", "false_positives", "safe_region_false_positives", "ignored_predictions", "true_positives_cited", "false_negatives", "recall_bp", "precision_bp")


@query("""WITH c AS (SELECT doc_id, toxic = 1 AS bad FROM labels), p AS (SELECT doc_id, lang, len(regexp_extract_all(lower(text), 'idiot|moron|trash')) AS n FROM documents)
SELECT lang, count(*) FILTER (bad AND n > 0) AS tp, count(*) FILTER (bad AND n = 0) AS fn, count(*) FILTER (NOT bad AND n > 0) AS fp, count(*) FILTER (NOT bad AND n = 0) AS tn,
CASE WHEN count(*) FILTER (bad) = 0 THEN 0 ELSE count(*) FILTER (bad AND n > 0) * 10000 // count(*) FILTER (bad) END AS recall_bp, CASE WHEN count(*) FILTER (n > 0) = 0 THEN 0 ELSE count(*) FILTER (bad AND n > 0) * 10000 // count(*) FILTER (n > 0) END AS precision_bp FROM c JOIN p USING (doc_id) GROUP BY lang""")
def truth_cases(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.regexp_extract_all(F.lower("text"), F.lit("(idiot|moron|trash)"), F.lit(1)).alias("hits"))
    null = F.lit(None).cast("long")
    cases = table(spark, sf_dir, "labels").join(docs.select("doc_id", "lang"), "doc_id").select(F.col("doc_id").cast("string").alias("case"), "lang", F.concat(F.lit("./d"), "doc_id").alias("file"), F.lit(1).cast("long").alias("line"), F.lit("CWE-1").alias("cwe"), F.lit("words").alias("capability"), null.alias("source_line"), null.alias("source_column"), F.when(F.col("toxic") == 1, "vulnerable").otherwise("safe").alias("disposition"), F.lit(0).cast("long").alias("expected_paths"))
    one = F.lit(1).cast("long")
    paths = docs.select("doc_id", F.posexplode("hits").alias("k", "w")).select(F.concat_ws(":", "doc_id", "k").alias("id"), F.lit("words").alias("capability"), F.array(F.lit("CWE-1")).alias("cwes"), one.alias("source_line"), one.alias("source_column"), F.concat(F.lit("d"), "doc_id").alias("file"), one.alias("sink_line"), one.alias("sink_end_line"))
    return evaluation.confusion(evaluation.truth(cases, paths), "lang")


# --- budgets and state -----------------------------------------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, (value * 100)::BIGINT AS amount, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, amount <= 20000 AS admitted, CASE WHEN amount <= 20000 THEN amount ELSE 0 END AS total FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.event_id, e.n, total + amount <= 20000, total + CASE WHEN total + amount <= 20000 THEN amount ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id, admitted FROM r""")
def budget_reservations(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.bround(F.col("value") * 100).cast("long").alias("amount"))
    return budgets.admitted(rows, "user_id", "event_id", "amount", 20000).select("user_id", "event_id", "admitted")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type IN ('error', 'view') AS finish, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, CASE WHEN finish THEN 'unknown_lease' ELSE 'admitted' END AS outcome, CASE WHEN finish THEN 0 ELSE 1 END AS calls, CASE WHEN finish THEN 0 ELSE 1 END AS active FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN finish AND active = 0 THEN 'unknown_lease' WHEN finish THEN 'released' WHEN calls >= 12 THEN 'call_limit' WHEN (active + 1) * 100 > 300 THEN 'input_limit' ELSE 'admitted' END,
  calls + CASE WHEN NOT finish AND calls < 12 AND (active + 1) * 100 <= 300 THEN 1 ELSE 0 END, CASE WHEN finish THEN greatest(active - 1, 0) WHEN calls < 12 AND (active + 1) * 100 <= 300 THEN active + 1 ELSE active END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT outcome, count(*) AS n FROM r GROUP BY outcome""")
def budget_outcomes(spark, sf_dir):
    finish = F.col("event_type").isin("error", "view")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("budget"), F.col("event_id").alias("sequence"), F.lit(0.0).alias("at"), F.when(finish, "abandon").otherwise("reserve").alias("op"), F.when(~finish, F.col("event_id").cast("string")).alias("lease"), *[F.lit(None).cast(t).alias(c) for c, t in (("lane", "string"), ("owner", "string"), ("calls", "long"), ("tokens", "double"), ("cost", "double"))])
    out = budgets.fold(rows, budgets.Policy(max_calls=12, input_limit=300, reservation=100))
    return out.groupBy("outcome").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE WHEN v >= 0 AND k >= 0 AND k <= v THEN ceil((v - k)::DECIMAL(18,0) * 2.5::DECIMAL(18,6) + k::DECIMAL(18,0) * 0.25::DECIMAL(18,6) + user_id::DECIMAL(18,0) * 10::DECIMAL(18,6))::BIGINT END::VARCHAR AS micros FROM (SELECT event_id, user_id, (value * 100)::BIGINT AS v, json_extract_string(props, '$.k')::BIGINT * 10 AS k FROM events)""")
def call_costs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.bround(F.col("value") * 100).cast("long").alias("v"), (F.get_json_object("props", "$.k").cast("long") * 10).alias("k"))
    return rows.select("event_id", budgets.cost({"input": "2.5", "cached": "0.25", "output": "10"}, F.col("v"), F.col("k"), F.col("user_id")).cast("string").alias("micros"))


@query()
def review_commands(spark, sf_dir):
    """Outcomes of a fold whose every step depends on the ones before: checked by tests."""
    e, k = F.col("event_type"), F.col("event_id")
    kind = F.when(e == "signup", "claim").when(e == "click", "record").when(e == "view", "allocate").when(e == "purchase", "release").otherwise("finish")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("stream"), k.alias("sequence"), F.concat(F.lit("o"), F.floor(k / 2)).alias("operation"), kind.alias("kind"), (k % 4).alias("generation"), F.lit("a").alias("attempt"), F.lit(None).cast("string").alias("owner"), F.concat(F.lit("s"), k % 5).alias("snapshot"), F.lit(False).alias("retry"), F.concat(F.lit("r"), k % 9).alias("subject"),
        F.concat(F.lit("d"), k).alias("decision"), F.lit("issue").alias("verdict"), F.array().cast("array<string>").alias("supersedes"), (k % 2 == 0).alias("settled"), F.concat(F.lit("w"), k % 3).alias("assignment"), F.array(F.concat(F.lit("r"), k % 9)).alias("reviews"), F.lit(1).cast("long").alias("calls"),
    ).withColumn("attempt", F.concat(F.lit("a"), F.col("generation")))
    return state.fold(rows).groupBy("outcome").agg(F.count("*").alias("n"))


_VIEW_SQL = """WITH d AS (SELECT 's' || (user_id % 5) AS stream, 'u' || user_id AS subject, 'd' || event_id AS decision, event_id % 3 AS generation, event_type AS verdict, 'd' || CASE WHEN event_id % 7 <> 0 THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) END AS gone FROM events),
h AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM d o WHERE o.stream = d.stream AND o.gone = d.decision)),
v AS (SELECT stream, subject, count(*) FILTER (generation > 0) AS now, count(*) FILTER (generation = 0) AS before, max(verdict) FILTER (generation > 0) AS verdict FROM h GROUP BY ALL),
s AS (SELECT stream, subject, now AS current, before AS historical, CASE WHEN now = 0 THEN 'unassessed' WHEN before > 0 THEN 'awaiting_supersession' WHEN now > 1 THEN 'conflict' ELSE 'recorded' END AS state, verdict FROM v)
"""


def _view(spark, sf_dir):
    from pyspark.sql import Window

    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    gone = F.when(F.col("event_id") % 7 != 0, before)
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("s"), F.col("user_id") % 5).alias("stream"), F.concat(F.lit("u"), "user_id").alias("subject"), F.concat(F.lit("d"), "event_id").alias("decision"), (F.col("event_id") % 3).alias("generation"), F.col("event_type").alias("verdict"), F.when(gone.isNotNull(), F.array(F.concat(F.lit("d"), gone))).otherwise(F.array().cast("array<string>")).alias("supersedes"))
    return state.subject_view(rows.select("stream", "subject").distinct(), rows, rows.where("generation > 0"))


@query(_VIEW_SQL + "SELECT stream, subject, current, historical, state, CASE WHEN state = 'recorded' THEN verdict END AS verdict FROM s")
def subject_view(spark, sf_dir):
    return _view(spark, sf_dir).select("stream", "subject", F.size("current").cast("long").alias("current"), F.size("historical").cast("long").alias("historical"), "state", "verdict")


@query(_VIEW_SQL + "SELECT stream, count(*) AS planned, count(*) FILTER (state <> 'recorded') AS missing, count(*) FILTER (state = 'recorded' AND verdict = 'error') AS pending, count(*) FILTER (state = 'recorded' AND verdict = 'click') AS issues, count(*) FILTER (state <> 'recorded' OR verdict = 'error') = 0 AS complete FROM s GROUP BY stream")
def completion_by_stream(spark, sf_dir):
    verdict = F.when(F.col("verdict") == "error", "needs_review").when(F.col("verdict") == "click", "issue").otherwise(F.col("verdict"))
    view = _view(spark, sf_dir).withColumn("verdict", verdict)
    return state.completion(view.select("stream", "subject"), view)


@query("""WITH d AS (SELECT doc_id % 50 AS b, source AS path, sha256(coalesce(text, '')) AS h, doc_id FROM documents), n AS (SELECT path, max(h) AS h FROM d GROUP BY path)
SELECT 'a' || b AS assessment, CASE WHEN count(*) FILTER (d.h <> n.h) > 0 THEN 'changed' ELSE 'unchanged' END AS state FROM d JOIN n USING (path) GROUP BY b""")
def assessments_now(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).cast("string").alias("batch"), F.col("source").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    batches = d.select("batch").distinct()
    return state.assessments_now(batches, batches.select(F.concat(F.lit("a"), "batch").alias("assessment"), "batch"), d, d.groupBy("path").agg(F.max("digest").alias("digest")))


@query("""SELECT user_id AS item, event_id AS revision, event_type AS text, count(*) OVER (PARTITION BY user_id) AS revisions FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def knowledge_heads(spark, sf_dir):
    return state.knowledge_heads(table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.col("event_id").alias("revision"), F.col("event_type").alias("text")))


@query("""WITH q AS (SELECT 'q' || user_id AS question, g AS generation FROM (SELECT DISTINCT user_id FROM events), (VALUES (0::BIGINT), (1), (2)) v(g)), f AS (SELECT 'q' || user_id AS question, event_id % 9 AS generation, event_type AS answer, event_type = 'view' AS seen FROM events WHERE event_type <> 'signup'),
p AS (SELECT question, generation, count(*) AS facts, count(*) FILTER (NOT seen) AS fresh, count(DISTINCT answer) AS answers FROM f GROUP BY ALL)
SELECT question, generation, CASE WHEN facts IS NULL THEN 'awaiting_evidence' WHEN fresh > 0 THEN 'evidence_available' ELSE 'pending_after_revalidation' END AS state, coalesce(facts, 0) AS facts, coalesce(answers, 0) > 1 AS needs_adjudication FROM q LEFT JOIN p USING (question, generation)""")
def pending_questions(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    name = F.concat(F.lit("q"), "user_id").alias("question")
    questions = events.select(name).distinct().select("question", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])).alias("generation"))
    facts = events.where("event_type != 'signup'").select(F.col("event_id").alias("fact"), name, (F.col("event_id") % 9).alias("generation"), F.col("event_type").alias("answer"))
    return state.pending(questions, facts, facts.where("answer = 'view'").select("fact"))


@query("""SELECT event_id AS sequence FROM events WHERE event_id % 97 = 6""")
def journal_breaks(spark, sf_dir):
    """Rows hashed on their own; the hash of each 97th is altered afterwards, so the row behind it does not fit."""
    k = F.col("event_id") + 1
    own = lambda n: F.sha2(n.cast("string"), 256)
    rows = table(spark, sf_dir, "events").select(k.alias("sequence"), F.when(k == 1, "").otherwise(own(k - 1)).alias("previous_hash"), F.concat(F.lit("o"), k).alias("operation"), F.col("event_type").alias("command"), own(k).alias("hash"), (F.col("event_id") % 97 == 5).alias("altered"))
    chain = rows.select("sequence", "previous_hash", "operation", F.when(F.col("altered"), F.lit("x")).otherwise(F.col("hash")).alias("hash"))
    return state.unlinked(chain).select((F.col("sequence") - 1).alias("sequence"))


# --- reports, advisories, lookups ----------------------------------------------------------------------------------


@query("""WITH f AS (SELECT l_orderkey * 100 + l_linenumber AS ordinal, l_returnflag AS title, l_linestatus AS category, CASE WHEN l_quantity > 25 THEN 'fix' END AS remediation, 'CWE-' || l_linenumber AS cwe FROM lineitem WHERE l_tax > 0.02)
SELECT *, row_number() OVER (ORDER BY first, title, category, remediation NULLS FIRST)::INT AS place FROM (SELECT title, category, remediation, count(*) AS instances, min(ordinal) AS first, array_to_string(list_sort(list_distinct(list(cwe))), ',') AS cwes FROM f GROUP BY title, category, remediation)""")
def finding_groups(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").where("l_tax > 0.02")
    rows = items.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ordinal"), F.lit("issue").alias("decision"), F.col("l_returnflag").alias("title"), F.col("l_linestatus").alias("category"), F.when(F.col("l_quantity") > 25, "fix").alias("remediation"), F.array(F.concat(F.lit("CWE-"), "l_linenumber")).alias("cwes"))
    return reports.finding_groups(rows).withColumn("cwes", F.array_join("cwes", ","))


@query()
def line_fingerprints(spark, sf_dir):
    """Rolling polynomials modulo 2^64 are not SQL's: checked by tests on published vectors."""
    return reports.fingerprints(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"))


@query(_EVIDENCE_SQL + "SELECT 'head' AS section, 1 AS n UNION ALL SELECT 'rule', 1 UNION ALL SELECT 'result', count(*) FROM g")
def candidate_log(spark, sf_dir):
    _, paths = _paths(spark, sf_dir)
    rows = paths.select("id", "capability", "cwes", "state", "path", F.col("steps")[1]["line"].alias("line"), F.col("steps")[1]["line"].alias("end_line"), F.lit("review").alias("message"), "steps", F.lit("warning").alias("level"))
    return reports.sarif(rows).groupBy("section").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, (value * 10)::BIGINT AS b FROM events),
r AS (SELECT user_id, n, 0 AS page, b AS size, 1 AS many FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, page + CASE WHEN size + b > 2500 OR many >= 5 THEN 1 ELSE 0 END, CASE WHEN size + b > 2500 OR many >= 5 THEN b ELSE size + b END, CASE WHEN size + b > 2500 OR many >= 5 THEN 1 ELSE many + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT r.user_id::VARCHAR AS run, page::BIGINT AS page, count(*) AS requests, sum(b)::BIGINT AS bytes FROM r JOIN e USING (user_id, n) GROUP BY ALL""")
def review_bundles(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("ordinal"), F.bround(F.col("value") * 10).cast("long").alias("bytes"))
    return reports.manifest(reports.bundles(rows, 2500, 5)).select("run", "page", "requests", "bytes")


@query("""SELECT event_type AS operation, count(*) AS queries, count(*) FILTER (value < 5) AS failed, count(*) FILTER (value >= 5 AND event_id % 3 = 0) AS truncated, count(*) FILTER (value >= 5 AND event_id % 3 <> 0 AND event_id % 4 = 0) AS empty, sum(user_id)::BIGINT AS elapsed_ms FROM events GROUP BY 1""")
def query_journal(spark, sf_dir):
    k = F.col("event_id")
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("operation"), F.when(F.col("value") < 5, "error").alias("error"), (k % 3 == 0).alias("truncated"), (k % 4).alias("results"), F.col("user_id").alias("elapsed_ms"))
    return reports.journal_summary(reports.journal(calls), "operation")


@query("""WITH p AS (SELECT DISTINCT 'n' || (p_size % 20) AS name, p_partkey % 4 AS a, p_partkey % 10 AS b, p_partkey % 7 AS c, p_partkey % 13 = 0 AS pre, p_partkey % 11 = 0 AS git FROM part), v AS (SELECT s_suppkey, 'n' || (s_suppkey % 20) AS name, s_suppkey % 4 AS pa, s_suppkey % 10 AS pb, s_nationkey % 3 AS ua, s_suppkey % 9 = 0 AS gone FROM supplier)
SELECT p.name, a || '.' || b || '.' || c AS version, 'A-' || s_suppkey AS id FROM p JOIN v USING (name) WHERE NOT pre AND NOT git AND NOT gone AND NOT ((a, b) >= (pa, pb)) AND NOT (a < ua)""")
def advisory_findings(spark, sf_dir):
    k = F.col("p_partkey")
    version = F.concat(F.concat_ws(".", k % 4, k % 10, k % 7), F.when(k % 13 == 0, "-rc.1").otherwise(""))
    packages = table(spark, sf_dir, "part").select(F.concat(F.lit("n"), F.col("p_size") % 20).alias("name"), version.alias("version"), F.when(k % 11 == 0, "git+https://x").otherwise(advisories.REGISTRIES[0]).alias("source"))
    s = F.col("s_suppkey")
    known = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("n"), s % 20).alias("package"), F.concat(F.lit("A-"), s).alias("id"), F.lit("t").alias("title"), F.lit("vulnerability").alias("kind"), F.lit(None).cast("string").alias("informational"), (s % 9 == 0).alias("withdrawn"),
        F.array(F.format_string(">= %d.%d.0", s % 4, s % 10)).alias("patched"), F.array(F.format_string("< %d.0.0", F.col("s_nationkey") % 3)).alias("unaffected"), F.lit(None).cast("string").alias("error"),
    )
    return advisories.findings(packages, known).select("name", "version", "id")


@query("""WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS v FROM documents WHERE text IS NOT NULL), o AS (SELECT doc_id, line, v, len(string_split(v, 'token')) - 1 AS k FROM l WHERE strpos(v, 'token') > 0)
SELECT doc_id::VARCHAR AS path, sum(k)::BIGINT AS occurrences, array_to_string(list_sort(list(line))[1:20], ',') AS lines, array_to_string(list(substr(trim(v), 1, 160) ORDER BY line)[1:2], '|') AS previews, count(*) > 20 AS truncated FROM o GROUP BY doc_id""")
def reference_lookups(spark, sf_dir):
    files = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), "text")
    found = lookups.reference_summary(lookups.references(files, "token", whole=False))
    return found.select("path", "occurrences", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"), F.array_join("previews", "|").alias("previews"), "truncated")


@query("""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, l, least(len(l), 1 + doc_id % 9)::INT AS pos FROM t)
SELECT doc_id::VARCHAR AS path, pos AS line, greatest(1, pos - 2)::INT AS first, least(len(l), pos + 2)::INT AS last, sha256(array_to_string(l[greatest(1, pos - 2):least(len(l), pos + 2)], chr(10))) AS source FROM p""")
def evidence_units(spark, sf_dir):
    files = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), "doc_id", "text")
    at = F.least(F.size(F.split("text", "\n", -1)), (F.col("doc_id") % 9 + 1)).cast("int")
    found = files.select("path", at.alias("line"), at.alias("end_line"))
    return lookups.units(found, files.select("path", "text"), 2).select("path", "line", "first", "last", F.sha2("source", 256).alias("source"))


_ENTRY_SQL = """WITH e AS (SELECT o_orderkey AS id, o_orderstatus AS capability, 'C' || o_custkey % 4 AS cwe, 'p' || o_custkey % 30 AS path, CASE WHEN o_orderkey % 5 = 0 THEN [] WHEN o_orderkey % 5 = 1 THEN [o_orderpriority] ELSE [o_orderpriority, 'k' || o_custkey % 3] END AS contracts FROM orders)
"""


def _entries(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    keys = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 5 == 1, F.array("o_orderpriority")).otherwise(F.array(F.col("o_orderpriority"), F.concat(F.lit("k"), c % 3)))
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_orderstatus").alias("capability"), F.array(F.concat(F.lit("C"), c % 4)).alias("cwes"), F.concat(F.lit("p"), c % 30).alias("path"), keys.alias("contracts"), F.array().cast("array<struct<kind:string>>").alias("operands"), (c % 20).alias("neighborhood"), c.alias("line"))


@query(_ENTRY_SQL + "SELECT key, count(*) AS entries, count(DISTINCT path) AS files, min(id) AS first, (SELECT count(*) FROM e WHERE len(contracts) = 0) AS ungrouped FROM (SELECT id, path, unnest(contracts) AS key FROM e) GROUP BY key")
def contract_groups(spark, sf_dir):
    groups, _, rest = lookups.contract_queue(_entries(spark, sf_dir))
    one = rest.withColumn("k", F.lit(1))
    return groups.withColumn("k", F.lit(1)).join(F.broadcast(one), "k").select("key", "entries", "files", "first", "ungrouped")  # one row beside the groups


@query("""WITH g AS (SELECT o_custkey % 20 AS neighborhood, o_orderstatus AS capability, 'C' || o_custkey % 4 AS cwe, count(*) AS reviews FROM orders GROUP BY ALL) SELECT capability, sum(reviews)::BIGINT AS reviews, count(*) AS implementations FROM g GROUP BY capability""")
def implementation_queue(spark, sf_dir):
    return lookups.by_capability(lookups.implementations(_entries(spark, sf_dir)))


@query(_ENTRY_SQL + "SELECT id FROM e WHERE capability = 'O' AND cwe = 'C1' AND starts_with(path, 'p1') AND list_contains(contracts, 'k1') AND id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def inventory_filter(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return lookups.inventory(_entries(spark, sf_dir), capability="O", cwe="C1", prefix="p1", contract="k1", reviewed=done).select("id")


@query("""WITH i AS (SELECT o_orderkey AS k, o_orderpriority AS impact, o_custkey % 7 AS low, o_custkey % 7 + 3 AS high FROM orders), r AS (SELECT l_orderkey AS k, CASE WHEN min(l_returnflag) = 'A' THEN 'completed' ELSE 'running' END AS status, count(*) AS used FROM lineitem GROUP BY l_orderkey),
x AS (SELECT impact, coalesce(status, 'pending') AS status, low, high, coalesce(used, 0) AS used FROM i LEFT JOIN r USING (k))
SELECT impact, count(*) AS cases, count(*) FILTER (status <> 'completed') AS open, sum(CASE WHEN status = 'completed' THEN 0 ELSE greatest(0, low - used) END)::BIGINT AS low_left, sum(CASE WHEN status = 'completed' THEN 0 ELSE greatest(0, high - used) END)::BIGINT AS high_left FROM x GROUP BY impact""")
def work_ledger(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case"), F.col("o_orderpriority").alias("impact"), (F.col("o_custkey") % 7).alias("low"), (F.col("o_custkey") % 7 + 3).alias("high"))
    results = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case")).agg(F.when(F.min("l_returnflag") == "A", "completed").otherwise("running").alias("status"), F.count("*").alias("used"))
    return lookups.ledger_rollup(lookups.ledger(items, results), "impact")


@query("""WITH f AS (SELECT o_orderkey AS id, 'p' || o_custkey % 100 AS path, o_orderpriority AS rule, o_orderkey + 7 AS need FROM orders WHERE o_orderstatus = 'O'), v AS (SELECT o_orderkey AS id, 'p' || o_custkey % 100 AS path, o_orderpriority AS rule FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 400000)
SELECT id FROM f WHERE EXISTS (SELECT 1 FROM v WHERE v.path = f.path AND v.rule = f.rule) OR EXISTS (SELECT 1 FROM v WHERE v.id = f.need)""")
def reopened_work(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("p"), F.col("o_custkey") % 100).alias("path"), F.col("o_orderpriority").alias("rule"), F.array(F.col("o_orderkey") + 7).alias("depends_on"), "o_orderstatus", "o_totalprice")
    state_ = F.when(F.col("o_totalprice") > 400000, "issue").otherwise("not_issue")
    return lookups.reopened(rows.where("o_orderstatus = 'O'"), rows.where("o_orderstatus = 'P'").withColumn("state", state_)).select("id")


@query("""WITH r AS (SELECT o_custkey, o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS a, o_totalprice FROM orders), s AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS b FROM r WHERE a <= 2)
SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderkey IN (SELECT o_orderkey FROM s WHERE b <= 48)) AS kept, true AS truncated FROM orders GROUP BY o_orderpriority""")
def capped_markers(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")
    kept = lookups.caps(rows, "o_custkey", "o_orderpriority", [F.desc("o_totalprice"), "o_orderkey"], 2, 48)
    return lookups.truncation(rows, kept, "o_orderpriority")


@query("""WITH c AS (SELECT s_suppkey AS review, CASE s_suppkey % 5 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'other' ELSE 'issue' END AS decision, ['critical', 'high', 'medium', 'unknown', 'low', 'note'][s_nationkey % 6 + 1] AS severity, CASE WHEN s_nationkey % 4 <> 0 THEN 'n' || s_nationkey % 9 END AS point, s_suppkey % 6 = 0 AS dormant FROM supplier),
n AS (SELECT s_suppkey AS review, ['conflicting_evidence', 'control_applicability', 'missing_local_evidence', 'human_required'][s_suppkey % 4 + 1] AS reason FROM supplier WHERE s_acctbal > 2000),
x AS (SELECT c.*, reason, decision = 'issue' AND dormant AS signal, CASE WHEN decision = 'other' THEN 'outside_verdict_scope' WHEN reason = 'human_required' THEN CASE WHEN decision = 'needs_review' THEN 'unavailable_deciding_fact' ELSE 'resolved_blocker_nomination' END WHEN reason IS NULL AND NOT (decision = 'issue' AND dormant) THEN 'no_actionable_nomination' END AS outcome FROM c LEFT JOIN n USING (review)),
k AS (SELECT review, coalesce('p' || point, 'r' || review) AS key, row_number() OVER (ORDER BY NOT signal, CASE WHEN signal THEN 1 ELSE list_position(['conflicting_evidence', 'control_applicability', 'missing_local_evidence'], reason) END, list_position(['critical', 'high', 'medium', 'unknown', 'low', 'note'], severity), review) AS o FROM x WHERE outcome IS NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY o) AS first FROM k), t AS (SELECT *, row_number() OVER (ORDER BY o) AS place FROM l WHERE first = 1), cap AS (SELECT least(20, ceil(count(*) FILTER (decision <> 'other') * 0.25)) AS n FROM c), y AS (SELECT review, key FROM t, cap WHERE place <= n)
SELECT x.review, coalesce(outcome, CASE WHEN x.review IN (SELECT review FROM y) THEN 'selected' WHEN l.key IN (SELECT key FROM y) THEN 'shared_repair_point' ELSE 'fast_cap' END) AS outcome FROM x LEFT JOIN l USING (review)""")
def follow_up_claims(spark, sf_dir):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at.cast("int") + 1)
    dormant = k % 6 == 0
    rows = table(spark, sf_dir, "supplier")
    claims = rows.select(k.alias("review"), F.when(k % 5 == 0, "needs_review").when(k % 5 == 1, "other").otherwise("issue").alias("decision"), pick(queues.SEVERITIES, n % 6).alias("severity"), F.when(n % 4 != 0, F.concat(F.lit("n"), n % 9)).alias("point"), F.when(dormant, "application_path").alias("context_kind"), F.when(dormant, "dormant").alias("applicability"), F.lit(None).cast("string").alias("impact"))
    notes = rows.where("s_acctbal > 2000").select(k.alias("review"), pick((*queues.REASONS, "human_required"), k % 4).alias("reason"))
    return queues.select_follow_ups(claims, notes).select("review", "outcome")


@query("""WITH m AS (SELECT user_id, event_type, (value * 10)::BIGINT AS i, CASE WHEN event_id % 211 = 0 THEN NULL ELSE event_id % 7 END AS c FROM events)
SELECT event_type, count(*) AS runs, sum(i)::BIGINT AS input_tokens, CASE WHEN count(*) FILTER (c IS NULL) = 0 THEN sum(c) END::BIGINT::VARCHAR AS cached_input_tokens, sum(user_id)::BIGINT AS output_tokens FROM m GROUP BY event_type""")
def token_usage(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.bround(F.col("value") * 10).cast("long").alias("input_tokens"), F.when(F.col("event_id") % 211 != 0, F.col("event_id") % 7).alias("cached_input_tokens"), F.col("user_id").alias("output_tokens"))
    return evaluation.consolidated(rows, "event_type").withColumn("cached_input_tokens", F.col("cached_input_tokens").cast("string"))


@query("""WITH v AS (SELECT p_partkey, p_partkey % 3 || '.' || p_size % 4 || '.' || p_partkey % 5 || CASE WHEN p_partkey % 2 = 0 THEN '-' || ['alpha', 'alpha.1', 'beta.2', 'beta.11', 'rc'][p_partkey % 5 + 1] ELSE '' END AS v, p_partkey % 3 AS a, p_size % 4 AS b, p_partkey % 5 AS c, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 5 ELSE 9 END AS pre FROM part)
SELECT v AS version, count(*) AS n, rank() OVER (ORDER BY a, b, c, pre) AS place FROM (SELECT v, a, b, c, pre FROM v) GROUP BY v, a, b, c, pre""")
def version_order(spark, sf_dir):
    from pyspark.sql import Window

    k = F.col("p_partkey")
    pre = F.element_at(F.array(*map(F.lit, ("alpha", "alpha.1", "beta.2", "beta.11", "rc"))), (k % 5).cast("int") + 1)
    version = F.concat(F.concat_ws(".", k % 3, F.col("p_size") % 4, k % 5), F.when(k % 2 == 0, F.concat(F.lit("-"), pre)).otherwise(""))
    rows = table(spark, sf_dir, "part").groupBy(version.alias("version")).agg(F.count("*").alias("n"))
    return rows.withColumn("place", F.rank().over(Window.orderBy(T.semver(F.col("version")))).cast("long"))  # some dozens of versions


_COMMENT_SQL = """WITH c AS (SELECT l_orderkey AS key, l_linenumber::BIGINT AS line, CASE WHEN l_returnflag = 'R' THEN NULL ELSE 'r' || (l_suppkey % 4) END AS rule, CASE WHEN l_linestatus = 'O' THEN greatest(l_linenumber - 1, 1) END AS st FROM lineitem WHERE l_quantity > 40),
m AS (SELECT key, coalesce(st, line + 1)::BIGINT AS line, rule FROM c), f AS (SELECT l_orderkey AS key, l_linenumber::BIGINT AS line, 'r' || (l_suppkey % 4) AS rule FROM lineitem)
"""


def _comments(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    line, name = F.col("l_linenumber").cast("long"), F.concat(F.lit("r"), F.col("l_suppkey") % 4)
    named = F.when(F.col("l_returnflag") != "R", F.array(name)).otherwise(F.array().cast("array<string>"))
    comments = rows.where("l_quantity > 40").select(F.col("l_orderkey").alias("key"), line.alias("line"), named.alias("rules"), F.when(F.col("l_linestatus") == "O", F.greatest(line - 1, F.lit(1))).alias("statement_line"), F.lit(1).cast("long").alias("next_line"))
    return rows.select(F.col("l_orderkey").alias("key"), line.alias("line"), name.alias("rule")), ledgers.marks_of(comments)


@query(_COMMENT_SQL + "SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.key = f.key AND m.line = f.line AND (m.rule IS NULL OR m.rule = f.rule))")
def suppression_comments(spark, sf_dir):
    return ledgers.unsuppressed(*_comments(spark, sf_dir))


@query(_COMMENT_SQL + "SELECT m.key, m.line, m.rule FROM m WHERE NOT EXISTS (SELECT 1 FROM f WHERE m.key = f.key AND m.line = f.line AND (m.rule IS NULL OR m.rule = f.rule))")
def unused_suppression_comments(spark, sf_dir):
    return ledgers.unused_marks(*_comments(spark, sf_dir)).select("key", "line", "rule")


@query("""WITH b AS (SELECT DISTINCT l_suppkey % 50 AS bundle, l_orderkey AS member FROM lineitem WHERE l_returnflag <> 'A'), a AS (SELECT DISTINCT l_suppkey % 50 AS bundle, l_orderkey AS member FROM lineitem WHERE l_linestatus = 'O')
SELECT bundle, count(*) FILTER (a.member IS NULL) AS removed, count(*) FILTER (b.member IS NULL) AS added FROM b FULL JOIN a USING (bundle, member) WHERE a.member IS NULL OR b.member IS NULL GROUP BY bundle""")
def changed_bundles(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("bundle"), F.col("l_orderkey").alias("member"), "l_returnflag", "l_linestatus")
    return ledgers.changed_members(rows.where("l_returnflag != 'A'"), rows.where("l_linestatus = 'O'"), "bundle", "member")


@query("""SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'needs_review' WHEN toxic = 1 THEN 'issue' ELSE 'not_issue' END AS verdict FROM labels""")
def reconciled_verdicts(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    first, second = F.when(F.col("quality") == 1, "not_issue"), F.when(F.col("toxic") == 1, "issue").otherwise("not_issue")
    return rows.select("doc_id", ledgers.reconciled(first, second).alias("verdict"))


# --- facts and whole scans -------------------------------------------------------------------------------------


@query(r"""WITH p AS (SELECT page_id, html, regexp_extract_all(html, '<script[^>]*>') AS m, string_split_regex(html, '<script[^>]*>') AS g FROM pages),
e AS (SELECT page_id, html, g, unnest(m) AS mark, generate_subscripts(m, 1) AS n FROM p), s AS (SELECT *, sum(length(g[n]) + length(mark)) OVER (PARTITION BY page_id ORDER BY n) AS start FROM e)
SELECT page_id AS key, (n - 1)::INT AS n, start::BIGINT AS start, (length(substr(html, 1, start::BIGINT)) - length(replace(substr(html, 1, start::BIGINT), chr(10), '')) + 1)::INT AS line, sha256(string_split_regex(g[n + 1], '</script\s*>')[1]) AS body FROM s""")
def script_islands(spark, sf_dir):
    found = facts.islands(table(spark, sf_dir, "pages"), "<script[^>]*>", r"</script\s*>")
    return found.select("key", "n", "start", "line", F.sha2("body", 256).alias("body"))


@query(r"""WITH c AS (SELECT page_id, len(regexp_extract_all(html, '(?i)(?:href|src|action)\s*=\s*["'']?\s*javascript:')) AS a, len(regexp_extract_all(html, '(?i)<(?:script|img|iframe|link)[^>]*\s(?:src|href)\s*=\s*["'']?http://')) AS b, len(regexp_extract_all(html, '(?i)<a\s')) AS c FROM pages)
SELECT page_id AS key, 'script_url' AS "check", a::INT AS n FROM c WHERE a > 0 UNION ALL SELECT page_id, 'plain_resource', b::INT FROM c WHERE b > 0 UNION ALL SELECT page_id, 'anchors', c::INT FROM c WHERE c > 0""")
def page_source_checks(spark, sf_dir):
    checks = {k: facts.PAGE_CHECKS[k] for k in ("script_url", "plain_resource")} | {"anchors": r"(?i)<a\s"}
    return facts.page_checks(table(spark, sf_dir, "pages"), checks=checks)


@query(r"""WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN split_part(url, '?', 1) WHEN 2 THEN regexp_extract(url, '^[a-z]+://[^/]*') ELSE regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1) END AS p, page_id % 8 < 4 AS whole FROM pages)
SELECT page_id, CASE WHEN regexp_matches(p, '^(?i:https?)://[^/?#\\@\s]+[/?#]') OR whole AND regexp_matches(p, '^(?i:https?)://[^/?#\\@\s]+$') THEN 'fixed_authority' WHEN regexp_matches(p, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'fixed_scheme' WHEN regexp_matches(p, '^/[^/\\]') OR whole AND p = '/' THEN 'fixed_path' ELSE 'open' END AS certainty FROM u""")
def url_certainty(spark, sf_dir):
    k, url = F.col("page_id") % 4, F.col("url")
    prefix = F.when(k == 0, url).when(k == 1, F.substring_index(url, "?", 1)).when(k == 2, F.regexp_extract(url, "^[a-z]+://[^/]*", 0)).otherwise(F.regexp_extract(url, "^[a-z]+://[^/]*(.*)$", 1))
    return table(spark, sf_dir, "pages").select("page_id", facts.url_certainty(prefix, F.col("page_id") % 8 < 4).alias("certainty"))


@query("""WITH r AS (SELECT o_orderkey, o_custkey % 3 = 0 AS a, o_orderstatus AS s, 2 + o_orderkey % 6 AS line FROM orders),
b AS (SELECT *, CASE WHEN line = 2 THEN CASE WHEN a THEN 'included' ELSE 'excluded' END WHEN line = 4 THEN CASE WHEN a THEN 'excluded' WHEN s = 'O' THEN 'included' WHEN s = 'F' THEN 'excluded' ELSE 'conditional' END WHEN line = 6 THEN CASE WHEN a OR s = 'O' THEN 'excluded' WHEN s = 'F' THEN 'included' ELSE 'conditional' END ELSE 'included' END AS state FROM r)
SELECT o_orderkey::VARCHAR AS id, state AS availability FROM b""")
def line_availability(spark, sf_dir):
    """A source for each order: `#if A / x / #elif S / y / #else / z / #endif`; S is unknown for some."""
    text = F.lit("#if A\nx\n#elif defined(S)\ny\n#else\nz\n#endif\nend")
    a = F.map_from_arrays(F.array(F.lit("A")), F.array(F.col("o_custkey") % 3 == 0))
    s = F.when(F.col("o_orderstatus").isin("O", "F"), F.map_from_arrays(F.array(F.lit("S")), F.array(F.col("o_orderstatus") == "O"))).otherwise(F.create_map().cast("map<string,boolean>"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").cast("string").alias("path"), (F.col("o_orderkey") % 6 + 2).alias("line"), text.alias("text"), F.map_concat(a, s).alias("symbols"))
    return facts.availability(rows.select("id", "path", "line"), facts.conditional(rows.select("path", "text", "symbols"))).select("id", "availability")


@query(_CODE_SQL + "SELECT l_orderkey::VARCHAR AS path, count(*) AS known, sum(a + b)::BIGINT AS total FROM l GROUP BY l_orderkey")
def literal_arguments(spark, sf_dir):
    rows = facts.literals(_calls(spark, sf_dir)).where("callee = 'price' and state = 'known'")
    return rows.groupBy("path").agg(F.count_if(F.col("argument") == 0).alias("known"), F.sum(F.col("value").cast("long")).alias("total"))


_SCAN_RULES = [
    {"id": "request", "kind": "source", "capability": "request", "match": {"any": [{"pattern": "request.get($N)"}]}},
    {"id": "query", "kind": "sink", "capability": "query", "cwe": ["CWE-89"], "match": {"any": [{"pattern": "db.execute($Q)", "captures": {"query": "Q"}}]}},
    {"id": "quote", "kind": "protection", "capability": "quoting", "symbols": [{"canonical": "dblib.quote", "captures": {"value": 0}}]},
]
_SCAN_RELATION = {"id": "sql", "version": 1, "source": {"capability": "request"}, "sink": {"capability": "query", "input_roles": ["query"]}, "protection": {"capability": "quoting", "application": "value_transform", "relation_role": "value"}, "cwe_candidates": ["CWE-89"], "strategy": "bounded_local_value"}


@query("""SELECT o_orderkey::VARCHAR AS path, CASE o_orderkey % 6 WHEN 0 THEN 'direct' WHEN 1 THEN 'protected' WHEN 2 THEN 'propagated' WHEN 3 THEN 'propagated' END AS state FROM orders WHERE o_orderkey % 6 < 4""")
def source_scans(spark, sf_dir):
    """A function for each order, of six kinds: direct, quoted, through one and through three names, overwritten, and beyond
    the depth of propagation."""
    bodies = [
        "db.execute('a' + request.get(1))", "db.execute(q(request.get(1)))", "x = request.get(1)\n    db.execute(x)", "x = request.get(1)\n    y = x\n    z = y + '!'\n    db.execute(z)", "x = request.get(1)\n    x = 'fixed'\n    db.execute(x)",
        "x = request.get(1)\n    a = x\n    b = a\n    c = b\n    d = c\n    e = d\n    db.execute(e)",
    ]
    body = F.element_at(F.array(*map(F.lit, bodies)), (F.col("o_orderkey") % 6).cast("int") + 1)
    sources = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.concat(F.lit("from dblib import quote as q\n\ndef f(db):\n    "), body, F.lit("\n")).alias("text"))
    return scanning.paths(sources, _SCAN_RULES, [_SCAN_RELATION]).select("path", "state")


_SIBLING_SQL = _CODE_SQL.rstrip()[:-1] + """), s AS (SELECT *, lead(f) OVER w AS nf, lag(f) OVER w AS pf, max(CASE WHEN f = 'R' THEN n END) OVER (PARTITION BY l_orderkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_if, count(*) OVER (PARTITION BY l_orderkey) AS total FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY n))
"""


@query(_SIBLING_SQL + """SELECT l_orderkey::VARCHAR AS doc, count(*) FILTER (f <> 'R' AND nf = 'R') AS precedes, count(*) FILTER (f <> 'R' AND pf = 'R') AS follows, count(*) FILTER (f <> 'R' AND last_if IS NOT NULL) AS follows_any, count(*) FILTER (f = 'R' AND a = 1) AS has, count(*) FILTER (n = total) AS last FROM s GROUP BY l_orderkey""")
def rule_siblings(spark, sf_dir):
    sources = _calls(spark, sf_dir)
    specs = {
        "precedes": {"kind": "Assign", "precedes": {"kind": "If"}}, "follows": {"kind": "Assign", "follows": {"kind": "If"}}, "follows_any": {"kind": "Assign", "follows": {"kind": "If", "stopBy": "end"}}, "has": {"kind": "If", "has": {"pattern": "price(1, $$$)", "stopBy": "end"}},
        "last": {"any": [{"kind": "Assign"}, {"kind": "If"}], "inside": {"kind": "Module"}, "nthChild": {"position": 1, "reverse": True}},
    }
    # Sources without a hit are counted too.
    found = rules.hits(sources, {n: {"rule": r} for n, r in specs.items()}, columns=["rule"]).unionByName(sources.select(F.col("path").alias("doc"), F.lit("").alias("rule")))
    return found.groupBy("doc").agg(*[F.count_if(F.col("rule") == n).alias(n) for n in specs])


@query(_CODE_SQL + "SELECT l_orderkey::VARCHAR AS doc, 'twice' AS rule, 'warning' AS severity, 'price of ' || a || ' twice, at ' || q AS message, count(*) AS n FROM l WHERE a = b AND l_orderkey % 10 IN (1, 2) GROUP BY ALL UNION ALL SELECT l_orderkey::VARCHAR, 'branch', 'hint', 'a branch', count(*) FROM l WHERE f = 'R' AND NOT starts_with(l_orderkey::VARCHAR, '1') GROUP BY ALL")
def rule_findings(spark, sf_dir):
    sources = _calls(spark, sf_dir)
    configs = [
        {"id": "twice", "rule": {"pattern": "price($A, $A, qty=$Q)"}, "severity": "warning", "message": "price of $A twice, at $Q", "files": ["*1", "*2"]}, {"id": "branch", "rule": {"kind": "If"}, "message": "a branch", "ignores": ["1*"]}, {"id": "off", "rule": {"kind": "Call"}, "severity": "off"},
    ]
    return rules.findings(sources, configs).groupBy("doc", "rule", "severity", "message").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), p AS (SELECT *, k FROM o, (SELECT unnest(range(0, 6)) AS k))
SELECT o_custkey::VARCHAR AS doc, k::INT AS line, CASE WHEN k = 0 THEN 'Box' WHEN k IN (1, 2) THEN 'Box.first' WHEN k = 3 THEN CASE WHEN n % 2 = 0 THEN 'Box.second' ELSE 'second' END WHEN k = 4 THEN CASE WHEN n % 2 = 0 THEN 'Box.second' ELSE 'second' END END AS symbol FROM p""")
def enclosing_symbols(spark, sf_dir):
    """A class for each customer; its second function is inside or behind it."""
    even = F.col("n") % 2 == 0
    second = F.when(even, "    def second(self):\n        pass\n").otherwise("def second(self):\n    pass\n")
    sources = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).select(F.col("o_custkey").cast("string").alias("path"), F.concat(F.lit("class Box:\n    def first(self):\n        return 1\n"), second, F.lit("x = 1\n")).alias("text"))
    places = sources.select(F.col("path").alias("doc"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("line"))
    found = code.enclosing(code.outline(written(code.nodes(sources), "nodes")), places)
    return found.select("doc", "line", F.concat_ws(".", F.nullif(F.col("symbol.container"), F.lit("")), "symbol.name").alias("symbol")).withColumn("symbol", F.nullif("symbol", F.lit("")))


@query("""WITH e AS (SELECT event_id AS id, event_type AS kind, user_id, value::INT AS start FROM events WHERE event_type = 'click') SELECT id, user_id, start FROM e ORDER BY user_id, start, id LIMIT 50 OFFSET 50""")
def evidence_page(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "user_id", F.bround("value").cast("int").alias("start"))
    return lookups.page(lookups.where_equal(rows, kind="click", path=None), ["user_id", "start", "id"], 50, 50)[0].select("id", "user_id", "start")


@query("""WITH t AS (SELECT doc_id, text, (doc_id * 37 % greatest(length(text), 1))::BIGINT AS k FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, substr(text, 1, k) AS head FROM t)
SELECT doc_id, octet_length(encode(head)) AS "offset", (length(head) - length(replace(head, chr(10), '')) + 1)::BIGINT AS line, (length(string_split(head, chr(10))[-1]) + 1)::BIGINT AS col FROM h""")
def byte_positions(spark, sf_dir):
    k = (F.col("doc_id") * 37 % F.greatest(F.length("text"), F.lit(1))).cast("int")
    docs = table(spark, sf_dir, "documents").where("text is not null").withColumn("at", F.octet_length(F.substring(F.col("text"), F.lit(1), k)))
    return docs.select("doc_id", T.byte_position(F.col("text"), F.col("at")).alias("p")).select("doc_id", F.col("p.offset").cast("int").alias("offset"), "p.line", F.col("p.column").alias("col"))


@query("""WITH b AS (SELECT doc_id AS id, sha256(coalesce(text, '')) AS c FROM documents WHERE source <> 'src3'), a AS (SELECT doc_id AS id, CASE WHEN lang = 'es' THEN 'x' ELSE sha256(coalesce(text, '')) END AS c, source AS bundle FROM documents WHERE source <> 'src5'),
s AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' WHEN a.c = b.c THEN 'unchanged' ELSE 'changed' END AS status, bundle FROM b FULL JOIN a ON a.id = b.id)
SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'unchanged') AS unchanged, 'changed_bundles' AS validation, count(DISTINCT bundle) FILTER (status IN ('added', 'changed')) AS bundles FROM s""")
def review_set_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content"), F.col("source").alias("bundle"), "lang")
    after = docs.where("bundle != 'src5'").withColumn("content", F.when(F.col("lang") == "es", "x").otherwise(F.col("content")))
    bundles, counts = queues.review_diff(docs.where("bundle != 'src3'").drop("lang"), after.drop("lang"))
    one = counts.withColumn("k", F.lit(1)).join(bundles.agg(F.count("*").alias("bundles")).withColumn("k", F.lit(1)), "k")  # single rows
    return one.select("added", "removed", "changed", "unchanged", "validation", "bundles")
