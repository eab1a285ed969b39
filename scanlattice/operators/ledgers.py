"""Work records: suppression, generations, decisions, leases, grouping and ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _covers() -> Column:
    """A mark holds for its whole key, or for the line that it is for; without a rule, for all rules."""
    return (F.col("m_whole") | (F.col("line") == F.col("m_line"))) & (F.col("m_rule").isNull() | (F.col("rule") == F.col("m_rule")))


def marks_of(comments: DataFrame) -> DataFrame:
    """comments(key, line, rules, statement_line, next_line) -> marks(key, line, rule, whole), a row for each rule (null: all).

    Lines count from 0. A comment behind code (statement_line is the line where that statement begins) is for that line;
    one alone on its line is for the next line; one alone on the first line, with nothing on the second, is
    for the whole key. next_line: where the next node begins, null for none."""
    alone = F.col("statement_line").isNull()
    whole = alone & (F.col("line") == 0) & F.coalesce(F.col("next_line") >= 2, F.lit(True))
    line = F.when(alone, F.col("line") + 1).otherwise(F.col("statement_line"))
    rules = F.when(F.size("rules") > 0, F.col("rules")).otherwise(F.array(F.lit(None).cast("string")))
    return comments.select("key", line.alias("line"), F.explode(rules).alias("rule"), whole.alias("whole"))


def mark_rules(text: Column, word: str) -> Column:
    """The rules that a comment with the mark's word names behind a colon; empty for all; null without the word."""
    named = F.regexp_extract(text, word + r"\s*:\s*([^\n]*)", 1)
    return F.when(text.contains(word), F.filter(F.transform(F.split(named, ","), lambda x: F.trim(x)), lambda x: x != ""))


def _marks(marks: DataFrame) -> DataFrame:
    return marks.select(*[F.col(c).alias(f"m_{c}") for c in ("key", "line", "rule", "whole")])


def unsuppressed(findings: DataFrame, marks: DataFrame) -> DataFrame:
    """findings(key, line, rule) that none of marks(key, line, rule, whole) covers."""
    m = _marks(marks)
    return findings.join(m, (F.col("key") == F.col("m_key")) & _covers(), "left_anti")


def unused_marks(findings: DataFrame, marks: DataFrame) -> DataFrame:
    """Marks that cover no finding."""
    m = _marks(marks)
    left = m.join(findings.select("key", "line", "rule"), (F.col("key") == F.col("m_key")) & _covers(), "left_anti")
    return left.select(*[F.col(f"m_{c}").alias(c) for c in ("key", "line", "rule", "whole")])


def reachability(condition: Column) -> Column:
    """Three-valued condition (null: unknown) as a class."""
    return F.when(condition, "reachable").when(~condition, "unreachable").otherwise("conditional")


def newest_before(rows: DataFrame, key: str, generation: str, bound: Column, value: str) -> DataFrame:
    """The value of each key's newest generation under the bound; null where that generation has several."""
    per = rows.where(F.col(generation) < bound).groupBy(key, generation).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    last = per.groupBy(key).agg(F.max(F.struct(generation, "low", "high")).alias("last"))
    return last.select(key, F.col(f"last.{generation}").alias(generation), F.when(F.col("last.low") == F.col("last.high"), F.col("last.low")).alias(value))


def subject_states(subjects: DataFrame, decisions: DataFrame) -> DataFrame:
    """subjects(subject), decisions(id, subject, supersedes) -> subject, heads, state.

    A head is a decision that no decision of its subject supersedes; several heads are a conflict."""
    gone = decisions.where("supersedes is not null").select("subject", F.col("supersedes").alias("id")).distinct()
    heads = decisions.join(gone, ["subject", "id"], "left_anti").groupBy("subject").agg(F.count("*").alias("heads"))
    n = F.coalesce("heads", F.lit(0).cast("long"))
    return subjects.join(heads, "subject", "left").select("subject", n.alias("heads"), F.when(n == 0, "unassessed").when(n == 1, "recorded").otherwise("conflict").alias("state"))


def reconciled(first: Column, second: Column) -> Column:
    """Two verdicts on one subject: an agreed one stands, one alone stands, contrary ones need review."""
    return F.when(first.isNull() | second.isNull() | (first == second), F.coalesce(first, second)).otherwise("needs_review")


def leases(open_work: DataFrame, lane: str, order: list[str], size: int) -> DataFrame:
    """Disjoint leases of `size` pieces of work within each lane, counted from 0."""
    n = F.row_number().over(Window.partitionBy(lane).orderBy(*order))
    return open_work.withColumn("lease", F.floor((n - 1) / size).cast("long"))


def fair_dispatch(work: DataFrame, lane: str, weight: Column, order: list[str], n: int) -> DataFrame:
    """The first n pieces when the lane with the least (taken / weight) comes next.

    Ties go to the lane's name. A lane gives at most n rows, so ranks stop there."""
    ranked = work.withColumn("place", F.row_number().over(Window.partitionBy(lane).orderBy(*order))).where(F.col("place") <= n)
    return ranked.withColumn("tick", (F.col("place") - 1) / weight).orderBy("tick", lane, "place").limit(n)


def ranked_enum(c: Column, values: list[str]) -> Column:
    """The position of a value in a ranking, unknown ones last."""
    out = F.lit(len(values))
    for place, v in enumerate(values):
        out = F.when(c == v, place).otherwise(out)
    return out


def chain_breaks(rows: DataFrame, key: str, order: str, previous: str, own: str) -> DataFrame:
    """Rows whose stored previous hash is not that of the row before (null for the first)."""
    before = F.lag(own).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("expected", before).where(~F.col(previous).eqNullSafe(F.col("expected")))


def changed_members(before: DataFrame, after: DataFrame, bundle: str, member: str) -> DataFrame:
    """Bundles whose set of members differs; sets are compared member by member, not gathered."""
    b, a = (x.select(bundle, member).distinct() for x in (before, after))
    only = lambda x, y, name: x.join(y, [bundle, member], "left_anti").select(bundle, F.lit(name).alias("side"))
    side = lambda name: F.count(F.when(F.col("side") == name, 1)).alias(name)
    return only(b, a, "removed").unionByName(only(a, b, "added")).groupBy(bundle).agg(side("removed"), side("added"))
