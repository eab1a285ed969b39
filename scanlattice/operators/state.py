"""Review state: a hash-chained journal, its replay, and what the records in it say now.

Commands of a stream are a sequence, so their fold runs by stream; everything read from its outcome (heads,
views, settled and reused decisions, open questions) is joins."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

JOURNAL_LIMIT = 512 * 1024 * 1024
TRANSACTION = "sequence long, previous_hash string, operation string, command string, result string, hash string"


def digest(domain: str, *parts: Column) -> Column:
    """SHA-256 of parts under a domain, so that equal parts of two domains differ."""
    return F.sha2(F.array_join(F.array(F.lit(domain), *parts), "\u0000", ""), 256)


def transaction_hash(sequence, previous: str, operation: str, command: str, result: str) -> str:
    return hashlib.sha256("\0".join(["transaction/v1", str(sequence), previous, operation, command, result]).encode()).hexdigest()


# --- journal -------------------------------------------------------------------------------------


def transactions(records: list[tuple[str, str, str]], after: tuple[int, str] = (0, "")) -> list[tuple]:
    """(operation, command, result) as rows of a journal that follow the row with that sequence and hash."""
    sequence, previous = after
    out = []
    for operation, command, result in records:
        sequence += 1
        own = transaction_hash(sequence, previous, operation, command, result)
        out.append((sequence, previous, operation, command, result, own))
        previous = own
    return out


def read_journal(spark: SparkSession, path: str, through: int | None = None) -> DataFrame:
    """The rows of a journal file of JSON lines, up to a sequence. ValueError for a torn tail (no line end behind the
    last row), empty rows, a file over the limit, a broken chain, or a sequence that is not there."""
    file = spark.read.format("binaryFile").load(path).select("length", F.expr("substring(content, -1, 1) = X'0A'").alias("whole")).first()
    if file["length"] > JOURNAL_LIMIT:
        raise ValueError("the journal exceeds its size limit")
    if file["length"] and not file["whole"]:
        raise ValueError("the journal has a torn tail")
    lines = spark.read.text(path)
    if lines.where("value = ''").limit(1).count():
        raise ValueError("the journal has an empty row")
    rows = lines.select(F.from_json("value", TRANSACTION).alias("t")).select("t.*")
    bad = breaks(rows).limit(1).count()
    if bad:
        raise ValueError("the journal's order or integrity is broken")
    if through is not None:
        if not rows.where(F.col("sequence") == through).limit(1).count():
            raise ValueError(f"sequence {through} is not in the journal")
        rows = rows.where(F.col("sequence") <= through)
    return rows


def append(path: str, operation: str, command: str, result: str) -> tuple[int, bool]:
    """Adds a transaction to a local journal file, under a lock; gives its sequence and whether it is a replay.

    The same operation and command again give the receipt of before and write nothing; another command under the
    operation is a ValueError, as are a torn tail, a broken chain and a full journal."""
    import fcntl

    with open(path, "a+b") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        f.seek(0)
        data = f.read(JOURNAL_LIMIT + 1)
        if data and not data.endswith(b"\n"):
            raise ValueError("the journal has a torn tail")
        at, previous = 0, ""
        for line in data.splitlines():
            t = json.loads(line)
            if (t["sequence"], t["previous_hash"]) != (at + 1, previous) or t["hash"] != transaction_hash(*(t[c] for c in ("sequence", "previous_hash", "operation", "command", "result"))):
                raise ValueError("the journal's order or integrity is broken")
            if t["operation"] == operation:
                if t["command"] != command:
                    raise ValueError("the operation belongs to another command")
                return t["sequence"], True
            at, previous = t["sequence"], t["hash"]
        row = transactions([(operation, command, result)], (at, previous))[0]
        added = json.dumps(dict(zip((c.split()[0] for c in TRANSACTION.split(", ")), row))).encode() + b"\n"
        if len(data) + len(added) > JOURNAL_LIMIT:
            raise ValueError("the journal exceeds its size limit")
        f.write(added)
        f.flush()
        os.fsync(f.fileno())
        return row[0], False


def unlinked(rows: DataFrame) -> DataFrame:
    """Sequences of rows that do not follow the one before, by number or by hash, or that share a number. The
    neighbour comes by an equi-join on the sequence, not in one sorted task."""
    before = rows.select((F.col("sequence") + 1).alias("sequence"), F.col("hash").alias("expected")).groupBy("sequence").agg(F.max("expected").alias("expected"), F.count("*").alias("many"))
    joined = rows.join(before, "sequence", "left")
    differs = F.when(F.col("sequence") == 1, F.col("previous_hash") != "").otherwise(F.coalesce(F.col("previous_hash") != F.col("expected"), F.lit(True)))
    return joined.where(differs | (F.coalesce("many", F.lit(1)) > 1)).select("sequence")


def breaks(rows: DataFrame) -> DataFrame:
    """Sequences of unlinked rows, of those whose hash is of other contents, and of those whose operation came before."""
    own = digest("transaction/v1", F.col("sequence").cast("string"), F.col("previous_hash"), F.col("operation"), F.col("command"), F.col("result"))
    altered = rows.where(~F.col("hash").eqNullSafe(own)).select("sequence")
    again = rows.groupBy("operation").agg(F.count("*").alias("uses")).where("uses > 1").select("operation")
    return unlinked(rows).union(altered).union(rows.join(again, "operation", "left_semi").select("sequence")).distinct()


def receipts(commands: DataFrame) -> DataFrame:
    """commands(sequence, operation, command) with an outcome: applied, replayed (the same operation and command
    before: the receipt is its sequence) or conflict (the operation had another command)."""
    first = commands.groupBy("operation").agg(F.min_by(F.struct("sequence", F.sha2("command", 256).alias("h")), "sequence").alias("first"))
    joined = commands.join(first, "operation")
    outcome = F.when(F.col("first.sequence") == F.col("sequence"), "applied").when(F.col("first.h") == F.sha2("command", 256), "replayed").otherwise("conflict")
    return joined.select(*commands.columns, outcome.alias("outcome"), F.col("first.sequence").alias("receipt"))


# --- streams of commands -------------------------------------------------------------------------

OUT = "stream string, sequence long, outcome string, generation long, owner string"


@dataclass
class Stream:
    """attempts: generation, attempt, snapshot, status, owner; leases: assignment -> review ids of it."""

    generation: int = 0
    owner: str = ""
    snapshot: str = ""
    status: str = ""
    attempts: list = field(default_factory=list)
    receipts: dict = field(default_factory=dict)
    leases: dict = field(default_factory=dict)
    settled: list = field(default_factory=list)
    decisions: list = field(default_factory=list)
    calls: int = 0

    def apply(self, c: dict) -> str:
        """The outcome of a command. The same operation again gives its receipt; one that was refused left none."""
        content = json.dumps({k: v for k, v in sorted(c.items()) if k not in ("sequence", "operation", "stream")}, default=str)
        if c["operation"] in self.receipts:
            return "replayed" if self.receipts[c["operation"]] == content else "operation_conflict"
        outcome = getattr(self, f"_{c['kind']}", lambda c: "unknown_command")(c)
        if outcome in ("claimed", "coalesced", "recorded", "allocated", "released", "finished"):
            self.receipts[c["operation"]] = content
        return outcome

    def _claim(self, c: dict) -> str:
        if (c["generation"] or 0) != self.generation:
            return "generation_changed"
        if c["snapshot"] == self.snapshot and not c.get("retry") and self.status in ("running", "finished"):
            return "coalesced"
        if c["attempt"] in self.attempts:
            return "attempt_reused"
        self.generation += 1
        self.attempts.append(c["attempt"])
        self.snapshot, self.status = c["snapshot"], "running"
        self.owner = hashlib.sha256(f"{self.generation}\0{c['attempt']}\0{c['snapshot']}".encode()).hexdigest()[:16]
        self.leases = {}
        return "claimed"

    def _owned(self, c: dict) -> bool:
        token = c.get("owner") == self.owner or (c.get("owner") is None and bool(self.attempts) and c.get("attempt") == self.attempts[-1])
        return c["generation"] == self.generation and self.status == "running" and token

    def _record(self, c: dict) -> str:
        if not self._owned(c):
            return "stale"
        if c["decision"] in self.decisions:
            return "decision_reused"
        if any(x not in self.decisions for x in c.get("supersedes") or []):
            return "unknown_supersession"
        self.decisions.append(c["decision"])
        if c.get("settled"):
            self.settled.append(c["subject"])
        return "recorded"

    def _allocate(self, c: dict) -> str:
        if not self._owned(c):
            return "stale"
        ids = list(c.get("reviews") or [])
        if c["assignment"] in self.leases or len(set(ids)) < len(ids) or any(set(ids) & set(x) for x in self.leases.values()):
            return "overlapping_lease"
        if set(ids) & set(self.settled):
            return "already_settled"
        self.leases[c["assignment"]] = ids
        self.calls += int(c.get("calls") or 0)
        return "allocated"

    def _release(self, c: dict) -> str:
        if not self._owned(c):
            return "stale"
        return "released" if self.leases.pop(c["assignment"], None) is not None else "unknown_assignment"

    def _finish(self, c: dict) -> str:
        if not self._owned(c):
            return "stale"
        self.status = "finished"
        return "finished"


def _commands(rows: pd.DataFrame) -> list[dict]:
    plain = lambda v: list(v) if hasattr(v, "__len__") and not isinstance(v, str) else None if v is None or v != v or v is pd.NaT else v
    out = []
    for e in rows.sort_values("sequence", kind="stable").to_dict("records"):
        e = {k: plain(v) for k, v in e.items()}
        for k in ("generation", "calls"):
            e[k] = None if e.get(k) is None else int(e[k])
        out.append(e)
    return out


_COLUMNS = [c.split()[0] for c in OUT.split(", ")]
COMMAND = "stream string, sequence long, operation string, kind string, generation long, attempt string, owner string, snapshot string, retry boolean, subject string, decision string, verdict string, supersedes array<string>, settled boolean, assignment string, reviews array<string>, calls long"


def _step(one: Stream, key: str, rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for c in _commands(rows):
        outcome = one.apply(c)
        out.append((key, c["sequence"], outcome, one.generation, one.owner))
    return pd.DataFrame(out, columns=_COLUMNS)


def fold(commands: DataFrame) -> DataFrame:
    """commands (COMMAND) -> stream, sequence, outcome, generation and owner after it. A claim compares the
    generation that it expects; records, leases and releases need the running generation and its owner (the
    owner's token or the attempt's name). What is refused changes nothing, so it makes nothing later stale."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _step(Stream(), key[0], rows)

    return commands.groupBy("stream").applyInPandas(run, OUT)


def stream(commands: DataFrame) -> DataFrame:
    """The same on a stream, with the state of each review stream in the checkpoint."""

    def run(key, batches, state):
        one = Stream(**json.loads(state.get[0])) if state.exists else Stream()
        out = _step(one, key[0], pd.concat(list(batches)))
        state.update((json.dumps(asdict(one)),))
        yield out

    return commands.groupBy("stream").applyInPandasWithState(run, OUT, "state string", "append", "NoTimeout")


# --- views ---------------------------------------------------------------------------------------


def heads(decisions: DataFrame) -> DataFrame:
    """decisions(stream, subject, decision, generation, verdict, supersedes) that no other of the stream supersedes."""
    gone = decisions.select("stream", F.explode("supersedes").alias("decision")).distinct()
    return decisions.join(gone, ["stream", "decision"], "left_anti")


def subject_view(subjects: DataFrame, decisions: DataFrame, admitted: DataFrame) -> DataFrame:
    """subjects(stream, subject) -> state, verdict, current and historical decisions. admitted(stream, decision): those
    of the current generation, recorded or reused. No current head: unassessed; a historical one beside it:
    awaiting_supersession; several: conflict; else recorded."""
    own = heads(decisions).join(admitted.select("stream", "decision", F.lit(True).alias("now")), ["stream", "decision"], "left")
    lists = own.groupBy("stream", "subject").agg(
        F.array_sort(F.collect_list(F.when(F.col("now"), F.col("decision")))).alias("current"), F.array_sort(F.collect_list(F.when(F.col("now").isNull(), F.col("decision")))).alias("historical"),
        F.max(F.when(F.col("now"), F.col("verdict"))).alias("v"),
    )
    empty = F.array().cast("array<string>")
    rows = subjects.join(lists, ["stream", "subject"], "left").withColumn("current", F.coalesce("current", empty)).withColumn("historical", F.coalesce("historical", empty))
    state = F.when(F.size("current") == 0, "unassessed").when(F.size("historical") > 0, "awaiting_supersession").when(F.size("current") > 1, "conflict").otherwise("recorded")
    return rows.withColumn("state", state).withColumn("verdict", F.when(F.col("state") == "recorded", F.col("v"))).drop("v")


def is_settled(verdict: Column, checks: Column, blockers: Column) -> Column:
    """A decision that asks for nothing more: no review needed, no checks, no blockers."""
    return (verdict != "needs_review") & (F.size(F.coalesce(checks, F.array().cast("array<string>"))) == 0) & (F.size(F.coalesce(blockers, F.array().cast("array<string>"))) == 0)


def reused(decisions: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """Settled decisions of earlier generations whose subject has the same inputs still: before and now are
    (stream, subject, fingerprint); only one decision of a subject may be a head."""
    same = before.join(now, ["stream", "subject", "fingerprint"], "left_semi").select("stream", "subject").distinct()
    own = heads(decisions)
    one = own.groupBy("stream", "subject").agg(F.count("*").alias("n")).where("n = 1").select("stream", "subject")
    return own.where("settled").join(same, ["stream", "subject"], "left_semi").join(one, ["stream", "subject"], "left_semi")


def pending(questions: DataFrame, facts: DataFrame, reviewed: DataFrame) -> DataFrame:
    """questions(question, generation) -> state, number of facts, needs_adjudication. facts(fact, question, generation,
    answer) of the same generation count; reviewed(fact) were looked at since."""
    f = facts.join(reviewed.select("fact", F.lit(True).alias("seen")), "fact", "left")
    per = f.groupBy("question", "generation").agg(F.count("*").alias("facts"), F.count_if(F.col("seen").isNull()).alias("fresh"), F.countDistinct("answer").alias("answers"))
    rows = questions.join(per, ["question", "generation"], "left").na.fill(0, ["facts", "fresh", "answers"])
    state = F.when(F.col("facts") == 0, "awaiting_evidence").when(F.col("fresh") > 0, "evidence_available").otherwise("pending_after_revalidation")
    return rows.select("question", "generation", state.alias("state"), "facts", (F.col("answers") > 1).alias("needs_adjudication"))


def completion(plan: DataFrame, view: DataFrame) -> DataFrame:
    """plan(stream, subject) against a subject view: counts and whether the review work is complete."""
    rows = plan.join(view.select("stream", "subject", "state", "verdict"), ["stream", "subject"], "left")
    recorded = F.coalesce(F.col("state") == "recorded", F.lit(False))
    out = rows.groupBy("stream").agg(F.count("*").alias("planned"), F.count_if(~recorded).alias("missing"), F.count_if(recorded & (F.col("verdict") == "needs_review")).alias("pending"), F.count_if(recorded & (F.col("verdict") == "issue")).alias("issues"))
    return out.withColumn("complete", (F.col("missing") == 0) & (F.col("pending") == 0))


def knowledge_heads(revisions: DataFrame) -> DataFrame:
    """revisions(item, revision, ...): the newest of each item, and how many there are."""
    return revisions.groupBy("item").agg(F.max_by(F.struct(*revisions.columns), "revision").alias("head"), F.count("*").alias("revisions")).select("head.*", "revisions")


def assessments_now(batches: DataFrame, assessments: DataFrame, dependencies: DataFrame, inputs: DataFrame) -> DataFrame:
    """(assessment, state): unchanged, changed or unknown, by comparing the file dependencies that an assessment's batch
    recorded (batch, path, digest) with a snapshot's inputs (path, digest). No recorded dependency: unknown."""
    own = assessments.join(batches, "batch").join(dependencies, "batch", "left")
    met = own.join(inputs.select("path", F.col("digest").alias("now")), "path", "left")
    per = met.groupBy("assessment").agg(F.count("path").alias("n"), F.count_if(F.col("path").isNotNull() & ~F.col("digest").eqNullSafe(F.col("now"))).alias("differ"))
    return per.select("assessment", F.when(F.col("n") == 0, "unknown").when(F.col("differ") > 0, "changed").otherwise("unchanged").alias("state"))


def after(events: DataFrame, seq: int, through: int | None = None, limit: int = 100) -> DataFrame:
    """A page of events behind a sequence, up to another if given, in order."""
    rows = events.where(F.col("seq") > seq)
    return (rows.where(F.col("seq") <= through) if through is not None else rows).orderBy("seq").limit(limit)


def latest(events: DataFrame, payload: str, wanted: dict[str, str], *keys: str) -> DataFrame:
    """The newest event for each key whose JSON payload has the wanted values at the given paths."""
    for path, value in wanted.items():
        events = events.where(F.get_json_object(payload, path) == value)
    return events.groupBy(*keys).agg(F.max_by(F.struct(*events.columns), "seq").alias("e")).select("e.*")
