"""The corpus pipeline: language ID, near-dedup, decontamination, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Rows of documents
that are empty tables, have null texts or repeat pass each stage as that stage's operator defines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from scanlattice.llm import decontam, langid, neardup, packing, secrets
from scanlattice.llm.common import fresh, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language (null, or no letter) and those whose nearest codeword has a share of
    less than langid.AMBIGUOUS among all. Learns as op5 does. Repeated rows are each judged; without any
    row to learn from all go. Columns of any name stay."""
    columns = docs.columns
    added = tuple(fresh(x, columns) for x in ("__lang", "__score", "__ambiguous"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = langid.fit(docs.where(~held))
    rows = langid.predict(docs, model, columns, added=added)
    return rows.where((F.col(added[0]) != "und") & ~F.col(added[2])).select(*[F.col(f"`{c}`") for c in columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id; of rows that repeat its id, one: that of
    the longest text, then the least in the columns' order. Rows without id are compared with each other
    only, by equal shingle sets; those without words all stay."""
    kept, many, own, digest = (fresh(x, docs.columns) for x in ("__kept", "__n", "__id", "__digest"))
    ids = neardup.near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.min("kept").alias(kept), F.count("*").alias(many))
    ids = written(ids.where(~F.col(kept) | (F.col(many) > 1)).select(F.col("doc_id").alias(own), kept), "ids")
    once = docs.where("doc_id is not null").join(ids, docs.doc_id == F.col(own), "left_anti")
    again = docs.join(ids.where(kept), docs.doc_id == F.col(own), "left_semi")
    nameless = neardup.with_digest(docs.where("doc_id is null"), digest)
    wordless = nameless.where(F.col(digest).isNull()).drop(digest)
    return once.union(_one_each(again, "doc_id")).union(_one_each(nameless.where(F.col(digest).isNotNull()), digest).select(*docs.columns)).union(wordless)


def _one_each(rows: DataFrame, key: str) -> DataFrame:
    """A row for each key. An aggregate, so that many rows of a key never meet in one task."""
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    first = F.min(F.struct(-F.coalesce(F.length("text"), F.lit(-1)), row.alias("row")))
    return rows.groupBy(F.col(key).alias(fresh("__key", rows.columns))).agg(first.alias("first")).select("first.row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of the texts; a text that had nothing else stays, empty. Null and empty
    texts stay as they are, repeated rows are each cut, columns of any name stay."""
    return decontam.remove_overlaps(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret in the texts. Null and empty texts stay as they are, equal texts are scanned once
    and masked in every row, columns of any name stay."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in windows, one row each. Null and empty texts are one closing id, repeated rows are
    each packed, other columns are not read."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secret_scan", secret_scan), ("pack", pack),
]
ORACLE_SQL = None  # no stage but the secret scan can be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
