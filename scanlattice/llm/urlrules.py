"""URL filters by hashed expressions.

A URL is expanded into host suffixes times path prefixes. Expressions and rules meet in an equi-join
on the first bytes of their SHA-256; the full digests then confirm a candidate, and the longest
rule decides. Prefix lengths and label counts that no rule has are not expanded, so a URL gives at
most as many expressions as there are distinct (labels, path length) shapes among the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import fresh

PREFIX_HEX = 8
# Fixed values: (verdict, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
DEFAULT = "allow"


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def host_of(url: Column) -> Column:
    """From after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; else empty."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end; empty without '://'."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """One row per row of pages: key, host, path, rule (host + path, null if none fits), verdict.

    A rule fits its host and all subdomains if the path starts with the rule's. The longest rule
    (host and path together) wins; of equally long ones that with the longer host, then block. Null
    urls and urls without '://' have empty host and path and the default verdict. Repeated rows
    and null keys are each returned; other columns are not read."""
    rules = rules.select(F.col("verdict").alias("r_verdict"), F.col("host").alias("r_host"), F.col("path").alias("r_path")).where("r_host is not null and r_path is not null").distinct()
    rules = rules.withColumn("digest", F.sha2(F.concat_ws("\n", "r_host", "r_path"), 256))
    # Rules of equal shape (labels, path length) share one expression. However many rules there are, there
    # are at most as many shapes as label counts (a host name has 127 at most) times path lengths in use.
    shapes = [(r[0], r[1]) for r in rules.select(F.size(F.split("r_host", r"\.")), F.length("r_path")).distinct().collect()]
    given = fresh("__key", ["host", "path", "rule", "verdict"])
    base = pages.select(F.col(key).alias(given), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    # A URL is looked up once, however many rows repeat its host and path.
    parts = base.select("host", "path").where("host != ''").distinct()
    if not shapes:
        return base.select(F.col(given).alias(key), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.split("host", r"\.")
    wanted = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("size")) for a, b in sorted(shapes)])
    fits = F.filter(wanted, lambda s: (s["labels"] <= F.size(labels)) & (s["size"] <= F.length("path")))
    made = F.transform(fits, lambda s: F.sha2(F.concat_ws("\n", F.array_join(F.slice(labels, F.size(labels) - s["labels"] + 1, s["labels"]), "."), F.substring(F.col("path"), F.lit(1), s["size"])), 256))
    expressions = parts.select("host", "path", F.explode(made).alias("full")).withColumn("short", F.substring("full", 1, PREFIX_HEX))
    candidates = expressions.join(rules.withColumn("short", F.substring("digest", 1, PREFIX_HEX)), "short")
    confirmed = candidates.where("full = digest")
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("a"), F.length("r_host").alias("b"), (F.col("r_verdict") == "block").cast("int").alias("c"))
    best = confirmed.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), rank).alias("best"))
    found = base.where("host != ''").join(best, ["host", "path"], "left")
    # URLs without a host, however many, are one key: they never go through the join.
    hostless = base.where("host = ''").withColumn("best", F.lit(None).cast("struct<rule:string,verdict:string>"))
    out = found.select(given, "host", "path", "best").unionByName(hostless.select(given, "host", "path", "best"))
    return out.select(F.col(given).alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


ORACLE = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(v, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT u.*, r.*, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h) + length(p) DESC NULLS LAST, length(h) DESC, v DESC) AS n
      FROM u LEFT JOIN r ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p))
SELECT page_id, host, path, h || p AS rule, coalesce(v, 'allow') AS verdict FROM m WHERE n = 1
"""
