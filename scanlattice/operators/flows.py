"""Evidence, source-to-sink joins, protections and bounded propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scanlattice.functions.tables import written

DEPTH = 4


def spans(docs: DataFrame, pattern: str, key: str, text: str, kind: str) -> DataFrame:
    """(key, n, start, stop, value, kind) of all matches of a pattern without groups; positions count
    characters. Starts come from the pieces between matches, so long texts take one pass."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    zipped = F.arrays_zip(F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda x: F.length(x)).alias("gap"), found.alias("value"))
    rows = docs.select(F.col(key).alias("key"), F.posexplode(zipped).alias("n", "z"))
    so_far = Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stop", F.sum(F.col("z.gap") + F.length("z.value")).over(so_far))
    return rows.select("key", "n", (F.col("stop") - F.length("z.value")).alias("start"), "stop", F.col("z.value").alias("value"), F.lit(kind).alias("kind"))


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs of one key whose inner span lies in the outer one."""
    o = outer.select("key", *[F.col(c).alias(f"o_{c}") for c in ("n", "start", "stop", "value")])
    return inner.join(o, "key").where((F.col("start") >= F.col("o_start")) & (F.col("stop") <= F.col("o_stop")))


def outside(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows whose span touches no range of the same key."""
    r = ranges.select(F.col("key").alias("r_key"), F.col("start").alias("r_start"), F.col("stop").alias("r_stop"))
    return rows.join(r, (rows.key == r.r_key) & (F.col("start") < F.col("r_stop")) & (F.col("stop") > F.col("r_start")), "left_anti")


def changed(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows that touch a changed range; a change without a range is the whole key."""
    c = changes.select(F.col("key").alias("c_key"), F.col("low"), F.col("high"))
    return rows.join(c, (rows.key == c.c_key) & (F.col("low").isNull() | ((F.col("start") <= F.col("high")) & (F.col("stop") >= F.col("low")))), "left_semi")


def propagate(sources: DataFrame, edges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(scope, origin, name, at, steps): names that a source reaches within `depth` assignments.

    sources(scope, name, at); edges(scope, left, right, at, conditional): assignments in order. A step
    takes a later assignment of a tracked name, unless the name was assigned again before; assignments
    in branches end a chain but do not extend it. When a name's value ends is one window over the
    assignments; each level is written once, so a level is one join."""
    both = sources.select("scope", F.col("name").alias("left"), "at").unionByName(edges.select("scope", "left", "at")).distinct()
    until = F.lead("at").over(Window.partitionBy("scope", "left").orderBy("at"))
    lives = written(both.select("scope", F.col("left").alias("name"), "at", until.alias("until")), "lives")
    e = edges.where(~F.col("conditional")).select(F.col("scope").alias("e_scope"), "left", "right", F.col("at").alias("e_at"))
    # The next assignment of the name reads it still, so its own place belongs to the life of the value before.
    uses = written(lives.join(e, (F.col("scope") == F.col("e_scope")) & (F.col("name") == F.col("right")) & (F.col("e_at") > F.col("at")) & (F.col("until").isNull() | (F.col("e_at") <= F.col("until")))).select("scope", "name", "at", "left", "e_at").distinct(), "uses")
    level = written(sources.select("scope", F.col("name").alias("origin"), "name", "at", F.lit(0).alias("steps")), "level")
    out = level
    for step in range(1, depth + 1):
        level = written(level.join(uses, ["scope", "name", "at"]).select("scope", "origin", F.col("left").alias("name"), F.col("e_at").alias("at"), F.lit(step).alias("steps")).distinct(), "level")
        out = out.unionByName(level)
    return out.groupBy("scope", "origin", "name", "at").agg(F.min("steps").alias("steps"))


def widest(rows: DataFrame) -> DataFrame:
    """Spans that lie in no other span of their key."""
    o = rows.select(F.col("key").alias("w_key"), F.col("start").alias("w_start"), F.col("stop").alias("w_stop"))
    inside = (F.col("w_start") <= F.col("start")) & (F.col("w_stop") >= F.col("stop")) & ((F.col("w_start") < F.col("start")) | (F.col("w_stop") > F.col("stop")))
    return rows.join(o, (rows.key == o.w_key) & inside, "left_anti")


def state(protected: Column, direct: Column) -> Column:
    return F.when(protected, "protected").when(direct, "direct").otherwise("propagated")
