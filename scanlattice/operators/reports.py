"""Reports: SARIF logs, line fingerprints, Markdown, finding groups, review bundles, query journals.

Documents come as rows in order, so a writer streams them; no report is gathered in one row."""

from __future__ import annotations

import json
import re
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from scanlattice.functions import text as T
from scanlattice.functions.shipping import ship

# The log format's schema and version.
SARIF_SCHEMA, SARIF_VERSION = "https://json.schemastore.org/sarif-2.1.0.json", "2.1.0"
# Units in a line's hash and its multiplier; the unit that closes a text.
WINDOW, FACTOR, END = 100, 37, 65535
_POWERS = np.array([pow(FACTOR, WINDOW - 1 - k, 1 << 64) for k in range(WINDOW)], np.uint64)


# --- line fingerprints -----------------------------------------------------------------------------


def line_hashes(text: str) -> list[tuple[int, str]]:
    """(line from 1, hash:ordinal) for each line: a polynomial over the next 100 UTF-16 units without blanks and
    tabs, from the line's first one; equal hashes of a text are counted. All line ends are one."""
    flat = text.replace("\r\n", "\n").replace("\r", "\n").replace(" ", "").replace("\t", "")
    units = np.append(np.frombuffer(flat.encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64), np.uint64(END))
    starts = np.concatenate(([0], np.flatnonzero(units[:-1] == 10) + 1))
    padded = np.concatenate((units, np.zeros(WINDOW, np.uint64)))
    seen: dict[int, int] = {}
    out = []
    for lo in range(0, len(starts), 4096):  # bounds the block of windows
        block = padded[starts[lo : lo + 4096, None] + np.arange(WINDOW)[None, :]]
        for n, value in enumerate((block * _POWERS).sum(axis=1, dtype=np.uint64).tolist(), lo):
            seen[value] = seen.get(value, 0) + 1
            out.append((n + 1, f"{value:x}:{seen[value]}"))
    return out


class _Lines:
    def __call__(self, batches):
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = line_hashes(text or "")
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["path", "line", "hash"])


def fingerprints(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(path, line, hash) of every line of every file."""
    ship(files.sparkSession)
    return files.select(F.col(key).cast("string"), text).mapInArrow(_Lines(), "path string, line long, hash string")


# --- SARIF -----------------------------------------------------------------------------------------


def partition_id(category: str, run: str) -> str:
    """category/run; ValueError unless every segment is of letters, digits, dots, dashes and underscores."""
    for part in (*category.split("/"), run):
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", part):
            raise ValueError(f"not a segment: {part!r}")
    return f"{category}/{run}"


def rule_key(capability: Column, cwes: Column) -> Column:
    return F.concat(F.when(F.size(cwes) == 0, "REVIEW").otherwise(F.array_join(F.array_sort(cwes), "_")), F.lit("."), F.upper(capability))


def sarif(candidates: DataFrame, properties: dict | None = None, tool: str = "scanlattice", hashes: DataFrame | None = None, automation: str | None = None) -> DataFrame:
    """candidates(id, capability, cwes, state, path, line, end_line, message, steps, level) -> rows (section, ordinal, json):
    one head, the rules by key, the results by id. Rules are one for each capability and set of CWEs, so a few."""
    keyed = candidates.withColumn("rule", rule_key(F.col("capability"), F.col("cwes")))
    rules = keyed.groupBy("rule").agg(F.first("capability").alias("capability"), F.first(F.array_sort("cwes")).alias("cwes"))
    rules = rules.withColumn("index", F.row_number().over(Window.orderBy("rule")) - 1)
    region = lambda line, end: F.struct(line.alias("startLine"), end.alias("endLine"))
    place = lambda path, line, end: F.struct(F.struct(F.struct(T.uri_path(path).alias("uri")).alias("artifactLocation"), region(line, end).alias("region")).alias("physicalLocation"))
    rows = keyed.join(F.broadcast(rules.select("rule", "index")), "rule")
    if hashes is not None:
        rows = rows.join(hashes.select("path", "line", F.col("hash")), ["path", "line"], "left")
        prints = F.when(F.col("hash").isNotNull(), F.create_map(F.lit("primaryLocationLineHash"), F.col("hash")))
    else:
        prints = F.lit(None).cast("map<string,string>")
    flow = F.array(F.struct(F.array(F.struct(F.transform("steps", lambda s: F.struct(place(s["path"], s["line"], s["end_line"]).alias("location"))).alias("locations"))).alias("threadFlows")))
    result = F.struct(
        F.col("rule").alias("ruleId"), F.col("index").alias("ruleIndex"), F.col("level").alias("level"), F.struct(F.col("message").alias("text")).alias("message"),
        F.array(place(F.col("path"), F.col("line"), F.col("end_line"))).alias("locations"), flow.alias("codeFlows"), prints.alias("partialFingerprints"), F.struct(F.col("id").alias("candidateId"), F.col("state")).alias("properties"),
    )
    results = rows.select(F.lit("result").alias("section"), F.col("id").alias("ordinal"), F.to_json(result).alias("json"))
    rule = F.struct(F.col("rule").alias("id"), F.struct(F.concat(F.col("capability"), F.lit(" review")).alias("text")).alias("shortDescription"), F.struct(F.col("cwes").alias("tags")).alias("properties"))
    listed = rules.select(F.lit("rule").alias("section"), F.lpad(F.col("index").cast("string"), 9, "0").alias("ordinal"), F.to_json(rule).alias("json"))
    head = {"tool": tool, "columnKind": "unicodeCodePoints", "properties": properties or {}} | ({"automationDetails": {"id": automation}} if automation else {})
    first = candidates.sparkSession.range(1).select(F.lit("head").alias("section"), F.lit("").alias("ordinal"), F.lit(json.dumps(head)).alias("json"))
    return first.unionByName(listed).unionByName(results)


def write_sarif(rows: DataFrame, path: str) -> None:
    """The rows of sarif() as one log; results stream through the driver, a partition at a time."""
    head = json.loads(rows.where("section = 'head'").first()["json"])
    rules = [json.loads(r["json"]) for r in rows.where("section = 'rule'").orderBy("ordinal").collect()]
    run = {"tool": {"driver": {"name": head.pop("tool"), "rules": rules}}, **head}
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps({"$schema": SARIF_SCHEMA, "version": SARIF_VERSION})[:-1] + ', "runs": [' + json.dumps(run)[:-1] + ', "results": [')
        for n, r in enumerate(rows.where("section = 'result'").orderBy("ordinal").toLocalIterator()):
            f.write((", " if n else "") + r["json"])
        f.write("]}]}")


def confirmed(findings: DataFrame) -> DataFrame:
    """Findings that a log of findings has: confirmed ones only."""
    return findings.where("decision = 'issue'").withColumn("level", F.lit("error"))


# --- Markdown ----------------------------------------------------------------------------------------


def finding_groups(findings: DataFrame) -> DataFrame:
    """Confirmed findings(ordinal, title, category, remediation) by these three, in the order first seen."""
    key = [F.col(c) for c in ("title", "category", "remediation")]
    own = findings.where("decision = 'issue'").groupBy(*key).agg(F.count("*").alias("instances"), F.min("ordinal").alias("first"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("cwes")))).alias("cwes"))
    return own.withColumn("place", F.row_number().over(Window.orderBy("first", "title", "category", "remediation")))  # one row for each kind of finding


def markdown(findings: DataFrame, title: str) -> DataFrame:
    """findings(ordinal, decision, title, category, remediation, cwes, path, line, summary) -> rows (section, place, line): counts,
    then what needs review, then confirmed findings by group; those dismissed are only counted."""
    of = lambda d: F.count_if(F.col("decision") == d)
    n = findings.agg(of("issue").alias("issue"), of("needs_review").alias("needs_review"), of("not_issue").alias("not_issue"))
    cells = F.array(*[F.concat(F.lit(f"| {label} | "), F.col(c).cast("string"), F.lit(" |")) for label, c in (("Confirmed findings", "issue"), ("Review required", "needs_review"), ("Not issues", "not_issue"))])
    top = n.select(F.posexplode(F.concat(F.array(*map(F.lit, (f"# {title}", "", "| Outcome | Count |", "| --- | ---: |"))), cells, F.array(F.lit("")))).alias("place", "line")).select(F.lit(0).alias("section"), F.col("place").cast("long").alias("place"), "line")
    where = F.concat(F.lit("`"), "path", F.lit(":"), F.col("line").cast("string"), F.lit("`"))
    entry = F.concat(F.lit("- "), where, F.lit(" "), T.markdown_escape(F.col("title")), F.lit(": "), T.markdown_escape(F.col("summary")))
    next_ = findings.where("decision = 'needs_review'").select(F.lit(1).alias("section"), (F.col("ordinal") + 1).alias("place"), entry.alias("line"))
    groups = finding_groups(findings).select("title", "category", "remediation", F.col("first"), "instances", "cwes")
    heads = groups.select(F.lit(2).alias("section"), (F.col("first") * 1000000).alias("place"), F.concat(F.lit("### "), T.markdown_escape(F.col("title")), F.lit(" ("), F.col("instances").cast("string"), F.lit("; "), F.array_join("cwes", ", "), F.lit(")")).alias("line"))
    members = findings.where("decision = 'issue'").join(groups.select("title", "category", "remediation", "first"), (findings.title.eqNullSafe(groups.title)) & (findings.category.eqNullSafe(groups.category)) & (findings.remediation.eqNullSafe(groups.remediation)))
    each = members.select(F.lit(2).alias("section"), (groups["first"] * 1000000 + 1 + findings["ordinal"]).alias("place"), F.concat(F.lit("- `"), findings["path"], F.lit(":"), findings["line"].cast("string"), F.lit("` "), T.markdown_escape(findings["summary"])).alias("line"))
    titles = findings.sparkSession.createDataFrame([(1, -1, "## Review next"), (2, -1, "## Confirmed")], "section int, place long, line string")
    return top.unionByName(titles).unionByName(next_).unionByName(heads).unionByName(each)


def write_lines(rows: DataFrame, path: str) -> None:
    with Path(path).open("w", encoding="utf-8") as f:
        for r in rows.orderBy("section", "place").toLocalIterator():
            f.write(r["line"] + "\n")


# --- bundles and journals ----------------------------------------------------------------------------


def bundles(requests: DataFrame, most_bytes: int, most_requests: int) -> DataFrame:
    """requests(run, ordinal, bytes) with page: requests in order, a page being full at either limit; a request over
    the limit is alone on its page. Only numbers go to the task that cuts a run."""

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ordinal")
        pages, page, size, many = [], 0, 0, 0
        for b in rows["bytes"]:
            if many and (size + b > most_bytes or many >= most_requests):
                page, size, many = page + 1, 0, 0
            size, many = size + b, many + 1
            pages.append(page)
        return pd.DataFrame({"run": rows["run"], "ordinal": rows["ordinal"], "page": pages})

    placed = requests.select("run", "ordinal", "bytes").groupBy("run").applyInPandas(cut, "run string, ordinal long, page long")
    return requests.join(placed, ["run", "ordinal"])


def manifest(paged: DataFrame) -> DataFrame:
    return paged.groupBy("run", "page").agg(F.count("*").alias("requests"), F.sum("bytes").alias("bytes"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))


def journal(calls: DataFrame) -> DataFrame:
    """calls(operation, args, output, error, elapsed_ms, truncated, results) with a status: failed before truncated before empty."""
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("truncated"), "truncated").when(F.col("results") == 0, "empty").otherwise("ok")
    return calls.withColumn("status", status)


def journal_summary(rows: DataFrame, *keys: str) -> DataFrame:
    of = lambda s: F.count_if(F.col("status") == s)
    return rows.groupBy(*keys).agg(F.count("*").alias("queries"), of("failed").alias("failed"), of("truncated").alias("truncated"), of("empty").alias("empty"), F.sum("elapsed_ms").alias("elapsed_ms"))


def portable(c: Column, root: str) -> Column:
    """JSON text with the root's paths made relative, wherever they stand in string values."""
    own = re.escape(json.dumps(root.rstrip("/"))[1:-1])
    return F.regexp_replace(F.regexp_replace(c, f'"{own}"', '"."'), f'"{own}/', '"')


# --- sinks -------------------------------------------------------------------------------------------


def write_scan(path: str, evidence: DataFrame, paths: DataFrame, covered: DataFrame, root: str = ".") -> None:
    """A scan result below a folder: evidence, paths and coverage as JSON lines in canonical order, and a head with
    counts. The root is written as given, so that results of two machines compare."""
    evidence.orderBy("path", "start", "rule").write.mode("errorifexists").json(f"{path}/evidence")
    paths.orderBy("id").write.mode("errorifexists").json(f"{path}/paths")
    covered.orderBy("path").write.mode("errorifexists").json(f"{path}/coverage")
    spark = evidence.sparkSession
    counts = [spark.read.json(f"{path}/{part}").count() for part in ("evidence", "paths", "coverage")]
    spark.createDataFrame([("2.1", root, *counts)], "schema_version string, root string, evidence long, paths long, files long").coalesce(1).write.mode("errorifexists").json(f"{path}/head")


def write_bundles(paged: DataFrame, path: str) -> None:
    """Request pages as JSON lines, a folder for each run and page, and their manifest beside them."""
    paged.write.mode("errorifexists").partitionBy("run", "page").json(f"{path}/requests")
    manifest(paged).orderBy("run", "page").write.mode("errorifexists").json(f"{path}/manifest")


def write_inventory(entries: DataFrame, admitted: DataFrame, path: str) -> None:
    """The whole inventory, the identities of its entries and those that were not admitted, with the reason."""
    entries.join(admitted.where("disposition = 'review'").select("id"), "id", "left_semi").write.mode("errorifexists").parquet(f"{path}/inventory")
    admitted.select("id", F.sha2(F.concat_ws("\u0000", *[F.col(c).cast("string") for c in admitted.columns if c in ("path", "rule", "start", "capability", "kind")]), 256).alias("identity")).write.mode("errorifexists").parquet(f"{path}/identities")
    admitted.where("disposition != 'review'").select("id", "reason").write.mode("errorifexists").parquet(f"{path}/excluded")


def append_journal(calls: DataFrame, path: str) -> None:
    """Calls with their status, added to a folder of JSON lines."""
    journal(calls).write.mode("append").json(path)


def append_journal_stream(calls: DataFrame, path: str, checkpoint: str):
    """The same for a stream of calls: a query that writes each call once, also after a restart."""
    return journal(calls).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
