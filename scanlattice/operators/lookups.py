"""Lookups over evidence, symbols, sources and inventories: filters, slices, searches and pages.

Every capped list says whether it was cut."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

PAGE, MOST_PAGE = 50, 200


def where_equal(rows: DataFrame, **wanted) -> DataFrame:
    """Rows with the wanted values; terms that are None do not count."""
    for name, value in wanted.items():
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows


def evidence(rows: DataFrame, kind=None, capability=None, language=None, path=None, limit: int | None = None) -> DataFrame:
    """Evidence that meets all given terms, in canonical order."""
    out = where_equal(rows, kind=kind, capability=capability, language=language, path=path)
    return out.orderBy("path", "start", "rule").limit(limit) if limit else out


def page(rows: DataFrame, order: list, offset: int = 0, limit: int = PAGE) -> tuple[DataFrame, int | None]:
    """A page in order and the offset of the next one, None at the end. ValueError beyond MOST_PAGE."""
    if not 0 < limit <= MOST_PAGE or offset < 0:
        raise ValueError(f"a page has 1 to {MOST_PAGE} rows")
    ahead = rows.orderBy(*order).offset(offset).limit(limit + 1)
    more = ahead.count() > limit
    return rows.orderBy(*order).offset(offset).limit(limit), offset + limit if more else None


def source(files: DataFrame, path: str, first: int, count: int) -> DataFrame:
    """(path, first, last, lines, text) of a range of lines, from 1; beyond the end it is shorter."""
    lines = F.split("text", "\n", -1)
    cut = F.slice(lines, first, count)
    return files.where(F.col("path") == path).select("path", F.lit(first).alias("first"), (F.lit(first) + F.size(cut) - 1).alias("last"), F.size(lines).alias("lines"), F.array_join(cut, "\n").alias("text"))


def units(found: DataFrame, files: DataFrame, around: int = 3) -> DataFrame:
    """Evidence with its lines and `around` lines on either side."""
    joined = found.join(files.select("path", F.split("text", "\n", -1).alias("lines")), "path")
    low = F.greatest(F.lit(1), F.col("line") - around)
    high = F.least(F.size("lines"), F.col("end_line") + around)
    return joined.select(*found.columns, low.alias("first"), high.alias("last"), F.array_join(F.slice("lines", low.cast("int"), (high - low + 1).cast("int")), "\n").alias("source"))


def symbol(symbols: DataFrame, name: str, path: str | None = None, prefix: str | None = None) -> DataFrame:
    """Definitions of a name, `Outer.inner` too, in one file or below a directory."""
    out = symbols.where((F.col("name") == name) | (F.concat_ws(".", F.nullif("container", F.lit("")), "name") == name))
    out = where_equal(out, doc=path)
    return out.where(F.col("doc").startswith(prefix.rstrip("/") + "/")) if prefix else out


def importers(edges: DataFrame, module: str) -> DataFrame:
    """Files that import a module or something below it."""
    return edges.where((F.col("module") == module) | F.col("module").startswith(module + ".")).select("doc", "line", "module", "name", "alias")


def targets(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Imports with the file that they mean: relative to the importer's directory for leading dots, else from the
    root; a module is a file or a package. Null where no file fits."""
    dots = F.length(F.regexp_extract("module", r"^\.*", 0))
    folder = F.regexp_replace("doc", "[^/]*$", "")
    up = F.array_join(F.slice(F.split(folder, "/"), 1, F.greatest(F.size(F.split(folder, "/")) - dots, F.lit(0))), "/")
    base = F.when(dots > 0, F.when(up == "", "").otherwise(F.concat(up, F.lit("/")))).otherwise("")
    stem = F.concat(base, F.translate(F.regexp_replace("module", r"^\.*", ""), ".", "/"))
    tries = F.array(F.concat(stem, F.lit(".py")), F.concat(stem, F.lit("/__init__.py")), F.concat_ws("/", stem, F.concat("name", F.lit(".py"))))
    each = edges.select("doc", "line", "module", "name", F.posexplode(F.array_compact(tries)).alias("rank", "path")).join(files.select("path", F.lit(True).alias("there")), "path")
    best = each.groupBy("doc", "line", "module", "name").agg(F.min_by("path", "rank").alias("target"))
    own = ("doc", "line", "module", "name")
    best = best.select(*[F.col(c).alias(f"b_{c}") for c in own], "target")
    met = edges.join(best, [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in own], "left")
    return met.drop(*[f"b_{c}" for c in own])


def exported(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Imports of names with the definition in the target file: its kind and line."""
    s = symbols.where("container = ''").select(F.col("doc").alias("target"), "name", F.col("kind").alias("target_kind"), F.col("line").alias("target_line"))
    return edges.join(s, ["target", "name"], "left")


def references(files: DataFrame, name: str, whole: bool = True) -> DataFrame:
    """(path, line, column, text) of each occurrence of a text, as a whole word unless told otherwise."""
    pattern = rf"\b{re.escape(name)}\b" if whole else re.escape(name)
    rows = files.where(F.col("text").contains(name)).select("path", F.posexplode(F.split("text", "\n", -1)).alias("n", "value")).where(F.col("value").rlike(pattern))
    pieces = F.split("value", pattern, -1)
    starts = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda k: F.length(F.array_join(F.slice(pieces, 1, k), " " * len(name))))
    return rows.select("path", (F.col("n") + 1).alias("line"), F.explode(starts).alias("c"), "value").select("path", "line", (F.col("c") + 1).alias("column"), F.col("value").alias("text"))


def reference_summary(found: DataFrame, lines: int = 20, previews: int = 2, width: int = 160) -> DataFrame:
    """Per file: occurrences, the first lines, previews and whether there were more lines. Ranks cut before lists
    are made, so a file with very many lines is no long list."""
    per = found.groupBy("path", "line").agg(F.count("*").alias("k"), F.min("text").alias("text"))
    totals = per.groupBy("path").agg(F.sum("k").alias("occurrences"), F.count("*").alias("n"))
    first = per.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy("line"))).where(F.col("r") <= lines)
    lists = first.groupBy("path").agg(F.array_sort(F.collect_list("line")).alias("lines"), F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= previews, F.struct("line", F.substring(F.trim("text"), 1, width).alias("t"))))), lambda x: x["t"]).alias("previews"))
    return totals.join(lists, "path").select("path", "occurrences", "lines", "previews", (F.col("n") > lines).alias("truncated"))


def paths(files: DataFrame, part: str) -> DataFrame:
    return files.where(F.col("path").contains(part)).select("path").distinct()


def inventory(entries: DataFrame, capability=None, cwe: str | None = None, prefix: str | None = None, contract: str | None = None, operand: str | None = None, reviewed: DataFrame | None = None) -> DataFrame:
    """entries(id, capability, cwes, path, contracts, operands) that meet all given terms and were not reviewed yet."""
    out = where_equal(entries, capability=capability)
    if cwe:
        out = out.where(F.array_contains("cwes", cwe))
    if prefix:
        out = out.where(F.col("path").startswith(prefix))
    if contract:
        out = out.where(F.array_contains("contracts", contract))
    if operand:
        out = out.where(F.exists("operands", lambda o: o["kind"] == operand))
    return out.join(reviewed.select("id"), "id", "left_anti") if reviewed is not None else out


def contract_queue(entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups by contract key, their members, one row with the number of entries without any key). An entry of several
    keys is in several groups; groups never share a verdict. Members are rows (key, id) and no lists: a key may hold a
    large part of all entries. For a page: many first, then by key."""
    keyed = entries.select("id", "path", F.explode(F.array_distinct("contracts")).alias("key"))
    groups = keyed.groupBy("key").agg(F.count("*").alias("entries"), F.countDistinct("path").alias("files"), F.min("id").alias("first"), F.lit(False).alias("verified"))
    return groups, keyed.select("key", "id"), entries.agg(F.count_if(F.size("contracts") <= 0).alias("ungrouped"))


def implementations(entries: DataFrame) -> DataFrame:
    """Groups by (neighborhood, capability, cwes), the first by line standing for them."""
    return entries.groupBy("neighborhood", "capability", F.array_sort("cwes").alias("cwes")).agg(F.count("*").alias("reviews"), F.min_by("id", F.struct("path", "line", "id")).alias("representative"))


def by_capability(groups: DataFrame) -> DataFrame:
    return groups.groupBy("capability").agg(F.sum("reviews").alias("reviews"), F.count("*").alias("implementations"))


def reopened(entries: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Deferred entries(id, path, rule, depends_on) that open again: a verdict of issue, needs_review or conflict on an entry
    they depend on, or on one of the same path and rule. verdicts(id, path, rule, state)."""
    live = verdicts.where("state in ('issue', 'needs_review', 'conflict')")
    by_surface = entries.join(live.select("path", "rule"), ["path", "rule"], "left_semi").select("id")
    by_need = entries.select("id", F.explode("depends_on").alias("need")).join(live.select(F.col("id").alias("need")), "need", "left_semi").select("id")
    return entries.join(by_surface.union(by_need).distinct(), "id", "left_semi")


def caps(rows: DataFrame, file: str, family: str, order: list, per_file: int = 8, per_family: int = 48) -> DataFrame:
    """Rows within both caps: the file's first, and of those the family's; with how many each left out."""
    one = rows.withColumn("in_file", F.row_number().over(Window.partitionBy(file, family).orderBy(*order))).where(F.col("in_file") <= per_file)
    two = one.withColumn("in_family", F.row_number().over(Window.partitionBy(family).orderBy(*order))).where(F.col("in_family") <= per_family)
    return two


def truncation(rows: DataFrame, kept: DataFrame, *keys: str) -> DataFrame:
    """Per key: rows, rows kept, and whether any was left out."""
    a, b = rows.groupBy(*keys).agg(F.count("*").alias("total")), kept.groupBy(*keys).agg(F.count("*").alias("kept"))
    return a.join(b, list(keys), "left").select(*keys, "total", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("total") > F.coalesce("kept", F.lit(0))).alias("truncated"))


def work_priority(impact: Column, exposure: Column, evidence_: Column, calls: Column, ordinal: Column) -> list[Column]:
    """Order of work: impact, exposure, evidence from high to unknown, then more calls, then first come."""
    rank = lambda c: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ("high", "medium", "low"))), c), F.lit(0)), F.lit(4))
    return [rank(impact), rank(exposure), rank(evidence_), calls.desc(), ordinal]


def ledger(items: DataFrame, results: DataFrame) -> DataFrame:
    """items(case, impact, low, high) with results(case, status, used): status pending by default, and what is left
    of the estimate, never below zero."""
    rows = items.join(results, "case", "left").withColumn("status", F.coalesce("status", F.lit("pending"))).withColumn("used", F.coalesce("used", F.lit(0)))
    done = F.col("status").isin("completed", "dropped")
    left = lambda c: F.when(done, 0).otherwise(F.greatest(F.lit(0), F.col(c) - F.col("used")))
    return rows.withColumn("low_left", left("low")).withColumn("high_left", left("high"))


def ledger_rollup(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("cases"), F.count_if(~F.col("status").isin("completed", "dropped")).alias("open"), F.sum("low_left").alias("low_left"), F.sum("high_left").alias("high_left"))
