"""Files, lines and change sets as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import repository as repositories


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repository(spark: SparkSession, root: str, selected: str | None = None) -> DataFrame:
    """path, class, reason, length, skipped and text of every file of a repository that is not pruned or ignored; one that
    cannot be read as text says why. selected: one file or directory."""
    listed = repositories.listing(spark, root)
    marks = repositories.read_texts(listed.where(F.col("path").rlike(r"(^|/)\.(git)?ignore$")))
    files, _ = repositories.walk(listed, selected, rules=repositories.ignore_rules(marks.select("path", "text")))
    return repositories.read_texts(files).select("path", "class", "reason", "length", "skipped", "text")


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line from 1, value)."""
    return docs.select(F.col(key).alias("key"), F.posexplode(F.split(text, "\n", -1)).alias("n", "value")).select("key", (F.col("n") + 1).alias("line"), "value")


def context(docs: DataFrame, key: str, text: str, first: int, count: int) -> DataFrame:
    """A slice of lines of each document."""
    return docs.select(F.col(key).alias("key"), F.array_join(F.slice(F.split(text, "\n", -1), first, count), "\n").alias("source"))
