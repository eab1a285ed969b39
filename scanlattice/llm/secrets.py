"""Secret scans over an incremental blob ledger; DataFrame functions only.

Every version of every document is addressed by the SHA-256 of its content. Only (blob, rule
version) pairs that the ledger lacks are scanned, each blob once, and findings are joined back to
all rows that hold the blob. Match positions come from splitting a text at its matches: a match
starts where the pieces and matches before it end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import fresh, work_path


@dataclass(frozen=True)
class Rule:
    """kind; Java pattern; group and length that a match needs; literals of which a text must have one
    (none: every text is searched); base: a rule of the contract."""

    kind: str
    pattern: str
    group: int
    least: int
    literals: tuple[str, ...] = ()
    base: bool = False


# Detection patterns, in the order in which equal starts are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, (), True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, ("AKIA",), True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, (), True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}", 0, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, ("xox",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 35, ("eyJ",)),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20, ("PRIVATE KEY-----",)),
)
RULES_VERSION = "1"
#: Session setting that names the ledger kept between runs.
LEDGER_SETTING = "spark.scanlattice.secrets.ledger"
LEDGER_SCHEMA = "blob string, rules_version string, spans array<struct<start:long,rank:int,stop:long,kind:string>>"


def blob_of(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def findings(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blobs(blob, text), each blob once -> blob, spans (empty where nothing was found)."""

    def matches(k: int, r: Rule) -> Column:
        found = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))
        if r.literals:
            some = F.lit(False)
            for literal in r.literals:
                some = some | F.col("text").contains(literal)
            found = F.when(some, found).otherwise(F.array().cast("array<string>"))
        return F.struct(F.lit(k).alias("rank"), found.alias("found"))

    candidates = F.array(*[matches(k, r) for k, r in enumerate(rules)])
    hit = blobs.select("blob", "text", F.explode_outer(F.filter(candidates, lambda x: F.size(x["found"]) > 0)).alias("m"))
    # One row for each match: the gap before it, its own length and that of its decisive group.
    pieces, groups = F.lit(None), F.lit(None)
    for k, r in enumerate(rules):
        pieces = F.when(F.col("m.rank") == k, F.split("text", r.pattern, -1)).otherwise(pieces)
        groups = F.when(F.col("m.rank") == k, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)) if r.group else F.col("m.found")).otherwise(groups)
    sizes = lambda c: F.transform(c, lambda x: F.length(x))
    lengths = hit.select("blob", F.col("m.rank").alias("rank"), F.arrays_zip(sizes(F.slice(pieces, 1, F.size("m.found"))).alias("gap"), sizes(F.col("m.found")).alias("long"), sizes(groups).alias("need")).alias("z"))
    each = lengths.select("blob", "rank", F.posexplode_outer("z").alias("n", "z")).select("blob", "rank", "n", "z.gap", "z.long", "z.need")
    so_far = Window.partitionBy("blob", "rank").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("stop", F.sum(F.col("gap") + F.col("long")).over(so_far))
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("rank") + 1)
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rank") + 1)
    span = F.struct((F.col("stop") - F.col("long")).alias("start"), "rank", "stop", kind.alias("kind"))
    return placed.groupBy("blob").agg(F.sort_array(F.collect_list(F.when(F.col("need") >= least, span))).alias("spans"))


def scan(versions: DataFrame, text: str = "text", ledger: str | None = None, rules: tuple[Rule, ...] = RULES, rules_version: str = RULES_VERSION, blob: str = "__blob", spans: str = "__spans") -> DataFrame:
    """versions with two more columns, by the names in blob and spans (sorted; empty if nothing was found);
    ValueError if versions has a column of such a name.

    ledger: a Parquet folder (created if absent) that keeps each scanned blob with the rules' version, those
    without findings too. None: the folder in the session's setting LEDGER_SETTING, else a new one, which
    is empty. Only (blob, version) pairs that it lacks are scanned. Null text is the empty blob. Repeated
    rows and equal texts share one scan. All rows and columns stay.
    A lost executor repeats its tasks; the ledger is appended to only after a scan has ended, and a
    pair that was appended twice by a repeated run is read once."""
    spark = versions.sparkSession
    if {blob, spans} & set(versions.columns):
        raise ValueError(f"a column is already named {blob} or {spans}")
    ledger = ledger or spark.conf.get(LEDGER_SETTING, None) or work_path(spark, "ledger")
    open_ledger(spark, ledger)
    own = spark.read.schema(LEDGER_SCHEMA).parquet(ledger).where(F.col("rules_version") == rules_version)
    texts = versions.select(blob_of(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    unseen = texts.dropDuplicates(["blob"]).join(own.select("blob"), "blob", "left_anti")
    findings(unseen, rules).select("blob", F.lit(rules_version).alias("rules_version"), "spans").write.mode("append").parquet(ledger)
    own = spark.read.schema(LEDGER_SCHEMA).parquet(ledger).where(F.col("rules_version") == rules_version)
    done = own.where(F.size("spans") > 0).dropDuplicates(["blob"]).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    joined = versions.withColumn(blob, blob_of(text)).join(done, blob, "left")
    empty = F.array().cast("array<struct<start:long,rank:int,stop:long,kind:string>>")
    return joined.select(*[F.col(f"`{c}`") for c in versions.columns], blob, F.coalesce(spans, empty).alias(spans))


def open_ledger(spark, ledger: str) -> None:
    """Makes an empty ledger where there is none."""
    none = F.array().cast("array<struct<start:long,rank:int,stop:long,kind:string>>")
    spark.range(0).select(F.lit("").alias("blob"), F.lit("").alias("rules_version"), none.alias("spans")).write.mode("ignore").parquet(ledger)


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ledger: str | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans; one row for each row of docs, whose other
    columns are not read. Null and empty texts have no spans (and the digest of nothing)."""
    rows = scan(docs.select(doc_id, text), text, ledger, blob=fresh("__blob", [doc_id, text]), spans=(found := fresh("__spans", [doc_id, text])))
    base = F.filter(found, lambda s: s["rank"] < sum(r.base for r in RULES))
    count = lambda kind: F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
    return rows.select(doc_id, *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col(found)).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[REDACTED]", ledger: str | None = None) -> DataFrame:
    """docs with every finding replaced by a mark; overlapping findings become one. All rows and
    columns stay, null texts too; n_chars, where there is such a column, follows the text."""
    blob, found, masked = (fresh(x, docs.columns) for x in ("__blob", "__spans", "__text"))
    rows = scan(docs, text, ledger, blob=blob, spans=found)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        gap = F.substring(F.col(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(mark))).alias("out"), F.greatest(acc["at"], s["stop"]).alias("at"))

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), F.lit(2147483647)))
    hit = F.size(found) > 0
    out = rows.withColumn(masked, F.when(hit, F.aggregate(found, start, step, rest)).otherwise(F.col(text)))
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.col(masked).alias(text))
        elif c == "n_chars":
            columns.append(F.when(hit, F.length(masked).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return out.select(*columns)


def _oracle() -> str:
    """The same spans in SQL: a match starts where the pieces and matches before it end."""
    any_case = lambda words: "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words)
    parts = []
    for k, r in enumerate(RULES):
        # RE2's own case folding takes non-ASCII letters too, so both cases are spelled out.
        pattern = r.pattern.replace("(?i:password|passwd|secret|token|api_?key)", any_case(["password", "passwd", "secret", "token", "api_?key"])).replace("'", "''")
        parts.append(f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {r.group}) AS g, string_split_regex(t, '{pattern}') AS p FROM d")
    n_base = sum(r.base for r in RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
e AS (SELECT doc_id, k, kind, least, generate_subscripts(m, 1) AS n, unnest(m) AS m, unnest(g) AS g, unnest(p[:len(m)]) AS p FROM f WHERE len(m) > 0),
w AS (SELECT *, sum(length(p) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY n) AS stop FROM e),
s AS (SELECT doc_id, k, kind, (stop - length(m))::BIGINT AS start, kind || ':' || (stop - length(m))::BIGINT || ':' || stop::BIGINT AS span FROM w WHERE length(g) >= least),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(span, ',' ORDER BY start, k) FILTER (k < {n_base}) AS base, string_agg(span, ',' ORDER BY start, k) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


ORACLE = _oracle()
