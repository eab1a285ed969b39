"""Work queues: fair limits, caps, samples, paging, follow-up selection, set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def fair_limit(rows: DataFrame, family: str, order: list[str], n: int) -> DataFrame:
    """One row of each family in turn until n are taken. A family gives at most n, so ranks stop there and
    each task keeps no more than that of a family before the exchange."""
    turn = rows.withColumn("turn", F.row_number().over(Window.partitionBy(family).orderBy(*order))).where(F.col("turn") <= n)
    return turn.orderBy("turn", family, *order).limit(n)


def capped(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first n rows of each key, and whether the key had more. The count is an aggregate of its own, so that
    ranks can stop at n in every task before the exchange."""
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= n)
    many = rows.groupBy(key).agg(F.count("*").alias("n_of_key")).where(F.col("n_of_key") > n).select(key, F.lit(True).alias("truncated"))
    return first.join(many, key, "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))


def sampled(rows: DataFrame, key: Column, seed: str, percent: int) -> DataFrame:
    """Rows whose hash with the seed falls under percent: the same ones on every run."""
    return rows.where(F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("long") % 100 < percent)


def page(rows: DataFrame, order: list, offset: int = 0, limit: int = 50) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(min(limit, 200))


def difference(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """(key, status): added, removed, changed or unchanged."""
    b, a = before.select(F.col(key), F.col(content).alias("b_content"), F.lit(1).alias("b")), after.select(F.col(key), F.col(content).alias("a_content"), F.lit(1).alias("a"))
    status = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a_content").eqNullSafe(F.col("b_content")), "unchanged").otherwise("changed")
    return b.join(a, key, "full_outer").select(key, status.alias("status"))


def follow_up(claims: DataFrame, repair_point: str, order: list, most: int = 20) -> DataFrame:
    """One claim per repair point, the first min(most, a quarter of all, rounded up); others deferred."""
    size = claims.agg(F.least(F.lit(most), F.ceil(F.count("*") * 0.25)).cast("int").alias("cap"))
    first = claims.withColumn("r", F.row_number().over(Window.partitionBy(repair_point).orderBy(*order)))
    lead = first.where("r = 1").select(repair_point, *order).orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    taken = lead.crossJoin(F.broadcast(size)).where("place <= cap").select(repair_point, *order, F.lit(True).alias("taken"))  # at most `most` rows beside one
    return first.join(F.broadcast(taken), [repair_point, *order], "left").withColumn("decision", F.when(F.col("taken"), "selected").when(F.col("r") > 1, "shared_repair_point").otherwise("over_cap")).drop("taken", "r")


# Reasons to look again that a further reading can settle, in order; severities in order.
REASONS = ("conflicting_evidence", "control_applicability", "missing_local_evidence")
SEVERITIES = ("critical", "high", "medium", "unknown", "low", "note")


def audit_signals(claims: DataFrame) -> DataFrame:
    """(review, reason) that an issue's own context raises. claims(review, decision, severity, context_kind, applicability, impact)."""
    path = (F.col("context_kind") == "application_path") & F.col("applicability").isin("dormant", "unresolved", "local_contract")
    severe = F.col("severity").isin("high", "critical") & ((F.col("context_kind") == "local_unsafe_construction") | ((F.col("impact") == "conditional") & F.col("applicability").isin("supported_optional", "local_contract")))
    signals = F.array(F.when(path, F.when(F.col("applicability") == "dormant", REASONS[0]).otherwise(REASONS[1])), F.when(F.col("impact") == "unresolved", REASONS[0]), F.when(severe, REASONS[1]))
    return claims.where("decision = 'issue' and context_kind is not null").select("review", F.explode(F.array_distinct(F.array_compact(signals))).alias("reason"))


def select_follow_ups(claims: DataFrame, notes: DataFrame, scope: tuple[str, ...] = ("issue", "not_issue", "needs_review"), most: int = 20) -> DataFrame:
    """claims(review, decision, severity, point, and the context's columns) with an outcome: selected, shared_repair_point,
    fast_cap, outside_verdict_scope, unavailable_deciding_fact, resolved_blocker_nomination or no_actionable_nomination.

    notes(review, reason). A claim is ranked by whether its own context speaks against it, the best reason, its
    severity and its id; one claim is taken of each repair point (null: its own), min(most, a quarter of all claims
    in scope, rounded up) in all. ValueError unless 1 <= most <= 20."""
    if not 1 <= most <= 20:
        raise ValueError("a fast follow-up takes 1 to 20 claims")
    known = F.array(*map(F.lit, REASONS))
    own = notes.groupBy("review").agg(F.array_distinct(F.collect_list("reason")).alias("noted"))
    audit = audit_signals(claims).groupBy("review").agg(F.collect_set("reason").alias("signals"))
    none = F.array().cast("array<string>")
    rows = claims.join(own, "review", "left").join(audit, "review", "left").withColumn("noted", F.coalesce("noted", none)).withColumn("signals", F.coalesce("signals", none))
    useful = F.array_union(F.array_intersect("noted", known), F.col("signals"))
    blocked = F.size(F.array_except("noted", known)) > 0
    out = F.when(~F.col("decision").isin(*scope), "outside_verdict_scope").when(blocked, F.when(F.col("decision") == "needs_review", "unavailable_deciding_fact").otherwise("resolved_blocker_nomination")).when(F.size(useful) == 0, "no_actionable_nomination")
    rows = rows.withColumn("outcome", out)
    best = F.array_min(F.transform(useful, lambda r: F.array_position(known, r)))
    severity = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), F.lit(0)), F.lit(4))
    order = F.struct(F.when(F.size("signals") > 0, 0).otherwise(1).alias("a"), best.alias("b"), severity.alias("c"), F.col("review").alias("d"))
    ranked = rows.where("outcome is null").withColumn("order", order).withColumn("key", F.coalesce(F.concat(F.lit("p"), "point"), F.concat(F.lit("r"), F.col("review").cast("string"))))
    lead = ranked.groupBy("key").agg(F.min("order").alias("order"))  # one claim of each repair point
    top = lead.orderBy("order").limit(most).withColumn("place", F.row_number().over(Window.orderBy("order")))  # at most `most` rows
    size = claims.agg(F.least(F.lit(most), F.ceil(F.count_if(F.col("decision").isin(*scope)) * 0.25)).alias("cap")).withColumn("k", F.lit(1))
    taken = top.withColumn("k", F.lit(1)).join(F.broadcast(size), "k").where("place <= cap").select("key", "order", F.lit("selected").alias("taken"))
    keys = taken.select("key", F.lit("shared_repair_point").alias("shared"))
    chosen = ranked.join(F.broadcast(taken), ["key", "order"], "left").join(F.broadcast(keys), "key", "left").select("review", F.coalesce("taken", "shared", F.lit("fast_cap")).alias("decided"))
    return rows.join(chosen, "review", "left").select(*claims.columns, F.coalesce("outcome", "decided").alias("outcome"))


def review_diff(before: DataFrame, after: DataFrame, contract_changed: bool = False, layout_changed: bool = False) -> tuple[DataFrame, DataFrame]:
    """before and after are (id, content, bundle). (bundles of after to validate, one row of counts with what to validate).

    A changed contract or bundle layout asks for the full pack; else bundles with an added or changed review, and with
    one at least also those whose set of members no bundle of before has; removals alone ask for nothing."""
    status = difference(before, after, "id", "content")
    touched = status.where("status in ('added', 'changed')")
    counts = status.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "changed", "unchanged")])
    if contract_changed or layout_changed:
        bundles = after.select("bundle").distinct()
    else:
        # Equal sets have the same number of members and the same sum of their hashes; members are never gathered.
        member = F.xxhash64(F.col("id").cast("string"))
        sets = lambda rows: rows.select("bundle", "id").distinct().groupBy("bundle").agg(F.count("*").alias("n"), F.sum(member.cast("decimal(38,0)")).alias("s"), F.bit_xor(member).alias("x"))
        moved = sets(after).join(sets(before).select("n", "s", "x").distinct(), ["n", "s", "x"], "left_anti").select("bundle")
        own = after.join(touched.select("id"), "id", "left_semi").select("bundle")
        any_ = touched.limit(1).select(F.lit(1).alias("k"))  # one row, if there is a reason at all
        moved = moved.withColumn("k", F.lit(1)).join(F.broadcast(any_), "k", "left_semi").select("bundle")
        bundles = own.union(moved).distinct()
    full = contract_changed or layout_changed
    verdict = F.lit("full_pack") if full else F.when(F.col("added") + F.col("changed") == 0, "not_required").otherwise("changed_bundles")
    return bundles, counts.withColumn("validation", verdict)
