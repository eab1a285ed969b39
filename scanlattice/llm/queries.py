"""The operators' queries with production parameters over whole tables, and their oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import decontam, langid, licenses, media, neardup, packing, secrets, toxicity, urlrules, warc
from .common import table

PREDICT_AT = 0.7


def held_out(n: int, remainder: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n)) == remainder


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out(3, 1))
    drawn = F.broadcast(toxicity.draw(labels))  # at most about toxicity.SAMPLE ids, whatever the input
    model = toxicity.fit(docs.join(drawn, "doc_id"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(3, 1), F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~held_out(5, 0)))
    rows = langid.predict(docs, model, ["doc_id"])
    return rows.select("doc_id", F.coalesce(held_out(5, 0), F.lit(False)).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__ambiguous").alias("ambiguous"))


def op6_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), urlrules.rule_table(spark))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(table(spark, sf_dir, "pages"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(table(spark, sf_dir, "documents"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontam.item_digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_packing, op3_secrets, op4_licenses, op5_langid, op6_urlrules, op7_warc, op8_neardup, op9_media, op10_decontam)}


def oracle_sql() -> dict[str, str]:
    return {"op3_secrets": secrets.ORACLE, "op6_urlrules": urlrules.ORACLE, "op8_neardup": neardup.ORACLE, "op10_decontam": decontam.ORACLE}
