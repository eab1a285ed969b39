"""Scores of predictions against labelled expectations, regions and truth cases."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scanlattice.functions import text as T
from scanlattice.functions.shipping import ship



def classify(predictions: DataFrame, regions: DataFrame) -> DataFrame:
    """predictions(case, ordinal, cwe, file, line) with a class: ignored or safe_region where a region(case, kind,
    cwe, file, start_line, end_line) holds the line, ignored first; else open."""
    r = regions.select(F.col("case").alias("r_case"), F.col("kind").alias("r_kind"), F.col("cwe").alias("r_cwe"), F.col("file").alias("r_file"), "start_line", "end_line")
    held = (F.col("case") == F.col("r_case")) & (F.col("file") == F.col("r_file")) & F.col("line").between(F.col("start_line"), F.col("end_line")) & ((F.col("r_kind") == "ignored") | (F.col("cwe") == F.col("r_cwe")))
    hit = predictions.join(r, held).groupBy("case", "trial", "ordinal").agg(F.min(F.when(F.col("r_kind") == "ignored", 0).otherwise(1)).alias("rank"))
    out = predictions.join(hit, ["case", "trial", "ordinal"], "left")
    return out.withColumn("class", F.when(F.col("rank") == 0, "ignored").when(F.col("rank") == 1, "safe_region").otherwise("open")).drop("rank")


class _Greedy:
    """mapInArrow function over pairs in order of trial, prediction and expectation: each prediction takes the first
    expectation of its own that no earlier one of the trial took. Only a trial's own choices are held."""

    def __call__(self, batches):
        trial, taken, last = None, set(), None
        for batch in batches:
            out = []
            for t, ordinal, expectation, cited in zip(*(batch.column(n).to_pylist() for n in ("trial", "ordinal", "expectation", "cited"))):
                if t != trial:
                    trial, taken, last = t, set(), None
                if ordinal != last and expectation not in taken:
                    taken.add(expectation)
                    last = ordinal
                    out.append((t, ordinal, expectation, cited))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["trial", "ordinal", "expectation", "cited"])


def matched(open_: DataFrame, expectations: DataFrame) -> DataFrame:
    """(trial, ordinal, expectation, cited): one-to-one matches of predictions and expectations(case, expectation, cwe,
    disposition, file, start_line, end_line), greedy in the order of predictions. Tasks stream over sorted trials."""
    ship(open_.sparkSession)
    p = open_.select("trial", "case", "ordinal", "cwe", "disposition", "file", "line", "cited")
    pairs = p.join(expectations, ["case", "cwe", "disposition", "file"]).where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    ordered = pairs.select("trial", "ordinal", "expectation", "cited").repartition("trial").sortWithinPartitions("trial", "ordinal", "expectation")
    return ordered.mapInArrow(_Greedy(), "trial string, ordinal long, expectation long, cited boolean")


def score(trials: DataFrame, predictions: DataFrame, expectations: DataFrame, regions: DataFrame) -> DataFrame:
    """Per mode of trials(trial, case, mode, status, input_tokens, output_tokens, requests, latency_ms): counts and
    ratios. status is completed, error or null (no response); the latter two miss all expectations of their case."""
    done = trials.where("status = 'completed'").select("trial", "case")
    p = classify(predictions.select("trial", "ordinal", "cwe", "disposition", T.relative_path(F.col("file")).alias("file"), "line", "cited", "citations", "valid_citations").join(done, "trial"), regions)
    hits = matched(p.where("class = 'open'"), expectations)
    p = p.join(hits.select("trial", "ordinal", F.lit(True).alias("hit")), ["trial", "ordinal"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    per = p.groupBy("trial").agg(
        F.count_if("hit").alias("true_positives"), F.count_if(F.col("hit") & F.col("cited")).alias("true_positives_cited"), F.count_if(F.col("class") == "ignored").alias("ignored_predictions"),
        F.count_if(F.col("class") == "safe_region").alias("safe_region_false_positives"), F.count_if((F.col("class") != "ignored") & ~F.col("hit")).alias("false_positives"),
        F.sum("citations").alias("cited_ids"), F.sum("valid_citations").alias("valid_cited_ids"),
    )
    wanted = expectations.groupBy("case").agg(F.count("*").alias("expected"))
    safe = regions.where("kind = 'safe'").groupBy("case").agg(F.count("*").alias("safe_regions"))
    rows = trials.join(wanted, "case", "left").join(safe, "case", "left").join(per, "trial", "left").na.fill(0)
    n = lambda c: F.sum(c).cast("long")
    out = rows.groupBy("mode").agg(
        F.count("*").alias("trials"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status").isNull()).alias("missing"),
        n("expected").alias("expected"), n("safe_regions").alias("safe_regions"), *[n(c).alias(c) for c in ("true_positives", "false_positives", "safe_region_false_positives", "ignored_predictions", "true_positives_cited", "cited_ids", "valid_cited_ids")],
        n(F.col("expected") - F.col("true_positives")).alias("false_negatives"), *[n(c).alias(c) for c in ("input_tokens", "output_tokens", "requests", "latency_ms")],
    )
    ratio = lambda a, b: T.basis_points(F.col(a), b)
    return out.withColumn("recall_bp", ratio("true_positives", F.col("true_positives") + F.col("false_negatives"))).withColumn("precision_bp", ratio("true_positives", F.col("true_positives") + F.col("false_positives"))).withColumn("citation_accuracy_bp", ratio("valid_cited_ids", F.col("cited_ids"))).withColumn("citation_coverage_bp", ratio("true_positives_cited", F.col("true_positives")))


def truth(cases: DataFrame, paths: DataFrame) -> DataFrame:
    """cases(case, file, line, cwe, capability, source_line, source_column, disposition, expected_paths) with the paths that
    show them and a classification. paths(id, capability, cwes, source_line, source_column, file, sink_line, sink_end_line)."""
    c = cases.withColumn("file", T.relative_path(F.col("file")))
    p = paths.select("id", F.col("capability"), F.explode(F.array_distinct("cwes")).alias("cwe"), F.col("source_line").alias("p_line"), F.col("source_column").alias("p_column"), T.relative_path(F.col("file")).alias("file"), "sink_line", "sink_end_line")
    fits = (F.col("source_line").isNull() | (F.col("source_line") == F.col("p_line"))) & (F.col("source_column").isNull() | (F.col("source_column") == F.col("p_column"))) & F.col("line").between(F.col("sink_line"), F.col("sink_end_line"))
    seen = c.join(p, ["capability", "cwe", "file"]).where(fits).groupBy("case").agg(F.countDistinct("id").alias("observed_paths"))
    out = c.join(seen, "case", "left").withColumn("observed_paths", F.coalesce("observed_paths", F.lit(0)))
    bad, hit = F.col("disposition") == "vulnerable", F.col("observed_paths") > 0
    kind = F.when(bad & hit, "true_positive").when(bad, "false_negative").when(hit, "false_positive").otherwise("true_negative")
    return out.withColumn("classification", kind).withColumn("baseline_matched", F.col("observed_paths") == F.col("expected_paths"))


def confusion(classified: DataFrame, *keys: str) -> DataFrame:
    """Counts of the four classes with recall and precision; by the given columns."""
    of = lambda k: F.count_if(F.col("classification") == k)
    out = classified.groupBy(*keys).agg(of("true_positive").alias("tp"), of("false_negative").alias("fn"), of("false_positive").alias("fp"), of("true_negative").alias("tn"))
    return out.withColumn("recall_bp", T.basis_points(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("precision_bp", T.basis_points(F.col("tp"), F.col("tp") + F.col("fp")))


def consolidated(metrics: DataFrame, *keys: str) -> DataFrame:
    """Token usage summed over runs; a counter that any run does not know is null."""
    names = ("input_tokens", "cached_input_tokens", "output_tokens")
    return metrics.groupBy(*keys).agg(F.count("*").alias("runs"), *[F.when(F.count_if(F.col(n).isNull()) == 0, F.sum(n)).alias(n) for n in names])
