"""Evidence, relations between sources and sinks, protections, candidates and what they add up to.

evidence(id, path, scope, language, kind, capability, start, stop, line, end_line, rule, cwes, captures,
reachability, related): captures is an array of (role, text, start, stop). paths(id, relation, path, capability, cwes, state, source,
sink, protections, steps): steps an array of (path, line, end_line, evidence)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scanlattice.functions import text as T

RELATION_SCHEMA = "relation string, version int, source_capabilities array<string>, sink_capability string, input_roles array<string>, protection_capability string, application string, relation_role string, value_roles array<string>, cwes array<string>, strategy string"
# How a protection belongs to a path, and the ways paths are built.
APPLICATIONS = ("related_capture", "value_transform")
STRATEGIES = ("bounded_local_value", "stored_subtitle_file")


def catalog(spark: SparkSession, contracts: list[dict], roles: dict[str, set[str]] | None = None) -> DataFrame:
    """Relation contracts as a table. ValueError for what is no contract: both or neither of capability and
    capabilities, repeated ones, unknown strategies, repeated ids, roles that no rule of the capability captures."""
    rows, seen = [], set()
    for c in contracts:
        source = c["source"]
        if ("capability" in source) == ("capabilities" in source):
            raise ValueError(f"{c['id']}: a source has capability or capabilities")
        accepted = [source["capability"]] if "capability" in source else list(source["capabilities"])
        guard = c.get("protection") or {}
        if not accepted or len(set(accepted)) < len(accepted) or c["id"] in seen or c["strategy"] not in STRATEGIES:
            raise ValueError(f"{c['id']}: repeated or empty capabilities, a repeated id or an unknown strategy")
        if guard and guard["application"] not in APPLICATIONS:
            raise ValueError(f"{c['id']}: unknown application {guard['application']}")
        wanted = {*c["sink"]["input_roles"], *([guard["relation_role"]] if guard.get("application") == "related_capture" else [])}
        if roles is not None and not wanted <= roles.get(c["sink"]["capability"], set()):
            raise ValueError(f"{c['id']}: roles {sorted(wanted - roles.get(c['sink']['capability'], set()))} are captured by no rule")
        seen.add(c["id"])
        rows.append((c["id"], c["version"], accepted, c["sink"]["capability"], list(c["sink"]["input_roles"]), guard.get("capability"), guard.get("application"), guard.get("relation_role"), list(guard.get("value_roles", [])), list(c["cwe_candidates"]), c["strategy"]))
    return spark.createDataFrame(rows, RELATION_SCHEMA)


def pairs(evidence: DataFrame, relations: DataFrame) -> DataFrame:
    """Sources and sinks of one path and scope that a relation allows, with the sink's input captures. The
    relations are a catalog of some dozens of rows; evidence meets evidence by path, scope and relation."""
    r = F.broadcast(relations)
    sources = evidence.where("kind = 'source'").join(r.select("relation", F.explode("source_capabilities").alias("capability")), "capability")
    sources = sources.select("relation", "path", "scope", F.col("id").alias("source"), F.col("start").alias("s_start"), F.col("stop").alias("s_stop"), F.col("line").alias("s_line"), F.col("end_line").alias("s_end_line"))
    sinks = evidence.where("kind = 'sink'").join(r.select("relation", F.col("sink_capability").alias("capability"), "input_roles", F.col("cwes").alias("r_cwes")), "capability")
    sinks = sinks.select("relation", "path", "scope", "capability", F.col("r_cwes").alias("cwes"), F.col("id").alias("sink"), F.col("captures").alias("k_captures"), "input_roles", F.col("start").alias("k_start"), F.col("stop").alias("k_stop"), F.col("line").alias("k_line"), F.col("end_line").alias("k_end_line"))
    return sources.join(sinks, ["relation", "path", "scope"])


def _inputs() -> Column:
    return F.filter("k_captures", lambda c: F.array_contains("input_roles", c["role"]))


def direct(found: DataFrame) -> DataFrame:
    """Pairs whose source lies in an input capture of the sink."""
    return found.where(F.exists(_inputs(), lambda c: (F.col("s_start") >= c["start"]) & (F.col("s_stop") <= c["stop"])))


def propagated(found: DataFrame, reached: DataFrame) -> DataFrame:
    """Pairs that are not direct, whose input capture is a name that the source reaches before the sink.
    reached(path, scope, source, name, at, steps) and, where there is such a column, until (the name is assigned again
    there): from bounded propagation. The fewest steps count."""
    until = F.col("until") if "until" in reached.columns else F.lit(None).cast("int")
    r = reached.select("path", "scope", "source", F.col("name"), F.col("at"), F.col("steps").alias("hops"), until.alias("until"))
    near = found.join(r, ["path", "scope", "source"]).where((F.col("at") <= F.col("k_start")) & (F.col("until").isNull() | (F.col("k_start") < F.col("until"))) & F.exists(_inputs(), lambda c: c["text"] == F.col("name")))
    return near.groupBy("relation", "source", "sink").agg(F.min("hops").alias("hops"))


def without_barriers(found: DataFrame, barriers: DataFrame) -> DataFrame:
    """Pairs without a value of fixed form (path, start, stop) between: around the source and inside the sink."""
    b = barriers.select(F.col("path").alias("b_path"), F.col("start").alias("b_start"), F.col("stop").alias("b_stop"))
    held = (F.col("b_start") <= F.col("s_start")) & (F.col("b_stop") >= F.col("s_stop")) & (F.col("b_start") >= F.col("k_start")) & (F.col("b_stop") <= F.col("k_stop"))
    return found.join(b, (found.path == b.b_path) & held, "left_anti")


def protections(found: DataFrame, evidence: DataFrame, relations: DataFrame) -> DataFrame:
    """(relation, source, sink, protection): protecting evidence of a pair's path and scope. related_capture: it
    captures the same text in the relation's role as the sink does; value_transform: it lies around the source
    and inside an input of the sink."""
    r = F.broadcast(relations.where("protection_capability is not null").select("relation", "protection_capability", "application", "relation_role"))
    guards = evidence.where("kind = 'protection'").select("path", "scope", F.col("capability").alias("protection_capability"), F.col("id").alias("protection"), F.col("captures").alias("p_captures"), F.col("start").alias("p_start"), F.col("stop").alias("p_stop"))
    near = found.join(r, "relation").join(guards, ["path", "scope", "protection_capability"])
    role = lambda name: F.filter(name, lambda c: c["role"] == F.col("relation_role"))
    related = F.arrays_overlap(F.transform(role("p_captures"), lambda c: c["text"]), F.transform(role("k_captures"), lambda c: c["text"]))
    around = (F.col("p_start") <= F.col("s_start")) & (F.col("p_stop") >= F.col("s_stop"))
    inside = F.exists(_inputs(), lambda c: (F.col("p_start") >= c["start"]) & (F.col("p_stop") <= c["stop"]))
    good = F.when(F.col("application") == "related_capture", related).otherwise(around & inside)
    return near.where(good).select("relation", "source", "sink", "protection").distinct()


def security_paths(evidence: DataFrame, relations: DataFrame, reached: DataFrame | None = None, barriers: DataFrame | None = None) -> DataFrame:
    """Paths by relation: direct before propagated for the same pair; either is protected if a protection attaches,
    and stays. Evidence that certainly is not reached takes no part."""
    live = evidence.where("coalesce(reachability, 'reachable') != 'unreachable'")
    found = pairs(live, relations)
    found = without_barriers(found, barriers) if barriers is not None else found
    near = direct(found).withColumn("state", F.lit("direct")).withColumn("hops", F.lit(0))
    if reached is not None:
        key = ["relation", "source", "sink"]
        far = found.join(near.select(*key), key, "left_anti").join(propagated(found, reached), key).withColumn("state", F.lit("propagated"))
        near = near.unionByName(far.select(*near.columns))
    guards = protections(near, live, relations).groupBy("relation", "source", "sink").agg(F.array_sort(F.collect_set("protection")).alias("protections"))
    out = near.join(guards, ["relation", "source", "sink"], "left").withColumn("protections", F.coalesce("protections", F.array().cast("array<string>")))
    step = lambda p, i: F.struct(F.col("path").alias("path"), F.col(f"{p}_line").alias("line"), F.col(f"{p}_end_line").alias("end_line"), F.col(i).alias("evidence"))
    state = F.when(F.size("protections") > 0, "protected").otherwise(F.col("state"))
    return out.select(T.fnv_id("path-", F.col("relation"), F.col("source"), F.col("sink")).alias("id"), "relation", "path", "capability", "cwes", state.alias("state"), "hops", "source", "sink", "protections", F.array(step("s", "source"), step("k", "sink")).alias("steps"))


def candidates(paths: DataFrame, evidence: DataFrame) -> DataFrame:
    """Paths with their source, sink and protections as evidence structs. A path that refers to evidence that is
    not there fails the job: raise_error names it."""
    e = evidence.select("id", F.struct(*[F.col(c) for c in ("id", "path", "line", "kind", "capability", "rule")]).alias("e"))
    out = paths
    for side in ("source", "sink"):
        out = out.join(e.select(F.col("id").alias(side), F.col("e").alias(f"{side}_evidence")), side, "left")
    guards = paths.select("id", F.explode("protections").alias("p")).join(e.select(F.col("id").alias("p"), "e"), "p", "left")
    lists = guards.groupBy("id").agg(F.sort_array(F.collect_list("e")).alias("protection_evidence"), F.count_if(F.col("e").isNull()).alias("missing"))
    out = out.join(lists, "id", "left")
    broken = F.col("source_evidence").isNull() | F.col("sink_evidence").isNull() | (F.coalesce("missing", F.lit(0)) > 0)
    checked = F.when(broken, F.raise_error(F.concat(F.lit("a path refers to missing evidence: "), F.col("id")))).otherwise(F.col("id"))
    return out.withColumn("id", checked).withColumn("protection_evidence", F.coalesce("protection_evidence", F.array())).drop("missing")


def dangling(paths: DataFrame, evidence: DataFrame) -> DataFrame:
    """(path id, evidence id) of references to evidence that is not there."""
    ids = F.array_union(F.array("source", "sink"), F.col("protections"))
    return paths.select("id", F.explode(ids).alias("evidence")).join(evidence.select(F.col("id").alias("evidence")), "evidence", "left_anti")


def surfaces(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("capability").agg(F.count("*").alias("evidence"))


def funnel(evidence: DataFrame, paths: DataFrame) -> DataFrame:
    """(capability, sources, sinks, paths): where relations lose what was found."""
    e = evidence.groupBy("capability").agg(F.count_if(F.col("kind") == "source").alias("sources"), F.count_if(F.col("kind") == "sink").alias("sinks"))
    p = paths.groupBy("capability").agg(F.count("*").alias("paths"))
    return e.join(p, "capability", "full").select("capability", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("sources", "sinks", "paths")])


def cwe_coverage(rules: DataFrame, evidence: DataFrame, level: str = "partial") -> DataFrame:
    """(cwe, level, declarative, observed, languages): languages of loaded rules, languages where a procedure
    found something without a rule for it, and both."""
    declared = rules.select(F.explode("cwes").alias("cwe"), "language").distinct().withColumn("declared", F.lit(True))
    seen = evidence.select(F.explode("cwes").alias("cwe"), "language").distinct()
    both = declared.join(seen.withColumn("seen", F.lit(True)), ["cwe", "language"], "full")
    list_ = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("language"))))
    return both.groupBy("cwe").agg(F.lit(level).alias("level"), list_(F.coalesce("declared", F.lit(False))).alias("declarative"), list_(F.col("declared").isNull() & F.col("seen")).alias("observed"), F.array_sort(F.collect_set("language")).alias("languages"))


def measurement(evidence: DataFrame, paths: DataFrame) -> DataFrame:
    """(histogram, key, n): evidence by capability and paths by CWE."""
    e = evidence.groupBy(F.col("capability").alias("key")).agg(F.count("*").alias("n")).select(F.lit("capability").alias("histogram"), "key", "n")
    p = paths.select(F.explode("cwes").alias("key")).groupBy("key").agg(F.count("*").alias("n")).select(F.lit("cwe").alias("histogram"), "key", "n")
    return e.unionByName(p)


def union(*parts: DataFrame) -> DataFrame:
    """All evidence in its canonical order, an id once: by path, start and rule."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.dropDuplicates(["id"]).orderBy("path", "start", "rule", "id")


# --- change scope --------------------------------------------------------------------------------

# Limits beyond which everything is analysed.
MOST_CHANGED, MOST_INCLUDED, SIBLINGS, SMALL = 100, 250, 20, 20


def is_changed(path: str, low: str, high: str, changes: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose lines touch a changed range of their path; a change without ranges is the whole file."""
    c = changes.select(F.col("path").alias("c_path"), F.explode_outer("changed_lines").alias("c"))
    touch = F.col("c").isNull() | ((F.col(low) <= F.col("c.high")) & (F.col(high) >= F.col("c.low")))
    return rows.join(c, (rows[path] == F.col("c_path")) & touch, "left_semi")


def changed_results(evidence: DataFrame, paths: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence, paths) of a change: paths with a step in it, the evidence that those need, evidence in it
    and what that is related to."""
    steps = paths.select("id", F.explode("steps").alias("s")).select("id", "s.*")
    kept = paths.join(is_changed("path", "line", "end_line", changes, steps).select("id").distinct(), "id", "left_semi")
    own = is_changed("path", "line", "end_line", changes, evidence)
    needed = kept.select(F.explode(F.array_union(F.array("source", "sink"), F.col("protections"))).alias("id"))
    needed = needed.union(kept.select(F.explode(F.transform("steps", lambda s: s["evidence"])))).union(own.select("id")).union(own.select(F.explode("related")))
    return evidence.join(needed.where("id is not null").distinct(), "id", "left_semi"), kept


def impact_scope(files: DataFrame, changes: DataFrame, edges: DataFrame, project_wide: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(included files with the reason, one row that says whether all must be analysed and why).

    files(path) that can be analysed; edges(importer, imported). Beside the changed files: those of the same
    directory where they are few, and direct importers. Deletions, renames, project-wide files and too many
    files ask for everything."""
    directory = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    wide = F.coalesce(project_wide, F.lit(False)) if project_wide is not None else F.lit(False)
    own = files.join(changes.select("path"), "path", "left_semi").select("path", F.lit(0).alias("rank"))
    folders = files.groupBy(directory(F.col("path")).alias("folder")).agg(F.count("*").alias("n")).where(F.col("n") <= SIBLINGS)
    folders = folders.join(changes.select(directory(F.col("path")).alias("folder")).distinct(), "folder", "left_semi")
    near = files.join(folders, directory(F.col("path")) == F.col("folder"), "left_semi").select("path", F.lit(1).alias("rank"))
    importers = edges.join(changes.select(F.col("path").alias("imported")), "imported", "left_semi").select(F.col("importer").alias("path")).join(files, "path", "left_semi").select("path", F.lit(2).alias("rank"))
    included = own.union(near).union(importers).groupBy("path").agg(F.element_at(F.array(*map(F.lit, ("changed", "same_directory_context", "direct_dependent"))), F.min("rank") + 1).alias("reason"))
    facts = changes.agg(F.count("*").alias("changed"), F.max(F.col("status").isin("deleted", "renamed")).alias("removed"), F.max(wide).alias("wide")).withColumn("k", F.lit(1))
    sizes = files.agg(F.count("*").alias("analyzable")).withColumn("k", F.lit(1)).join(included.agg(F.count("*").alias("included")).withColumn("k", F.lit(1)), "k")
    row = facts.join(sizes, "k").drop("k")  # single rows
    much = (F.col("included") > MOST_INCLUDED) | ((F.col("analyzable") >= SMALL) & (F.col("included") * 2 > F.col("analyzable")))
    why = F.array_compact(F.array(F.when(F.col("changed") > MOST_CHANGED, "too many changed files"), F.when(F.col("removed"), "a deletion or rename"), F.when(F.col("wide"), "a project-wide file"), F.when(much, "too many included files")))
    return included, row.select("changed", "included", "analyzable", (F.size(why) > 0).alias("full_scan"), why.alias("reasons"))
