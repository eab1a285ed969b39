"""The append-only decision log: batch fold and Structured Streaming.

Both give each key its head (the newest accepted command). A command is idempotent if its operation key
came before with the same content, a conflict if with other content, stale if its generation is older
than the newest of those that came first under their keys: what is refused makes nothing stale."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def fold(log: DataFrame, key: str = "key", operation: str = "operation", content: str = "content", generation: str = "generation", sequence: str = "sequence") -> DataFrame:
    """log with a column `outcome`: recorded, idempotent, conflict or stale."""
    same = Window.partitionBy(key, operation).orderBy(sequence)
    before = Window.partitionBy(key).orderBy(sequence).rowsBetween(Window.unboundedPreceding, -1)
    rows = log.withColumn("__first", F.first(content).over(same)).withColumn("__n", F.row_number().over(same)).withColumn("__newest", F.max(F.when(F.col("__n") == 1, F.col(generation))).over(before))
    outcome = F.when((F.col("__n") > 1) & F.col("__first").eqNullSafe(F.col(content)), "idempotent").when(F.col("__n") > 1, "conflict").when(F.col(generation) < F.col("__newest"), "stale").otherwise("recorded")
    return rows.withColumn("outcome", outcome).drop("__first", "__n", "__newest")


def heads(log: DataFrame, key: str = "key", sequence: str = "sequence") -> DataFrame:
    """The newest row of each key."""
    return log.groupBy(key).agg(F.max_by(F.struct(*log.columns), sequence).alias("head")).select("head.*")


def append_once(target: str, id_column: str, content: str):
    """A foreachBatch function: appends rows whose id is not there yet; another content under a known id fails."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([id_column, content])
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            known = spark.read.schema(batch.schema).parquet(target).select(id_column, F.col(content).alias("__known"))
            met = rows.join(known, id_column)
            if met.where(~F.col(content).eqNullSafe(F.col("__known"))).limit(1).count():
                raise ValueError("an id is known with another content")
            rows = rows.join(known, id_column, "left_anti")
        rows.write.mode("append").parquet(target)

    return write


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts per event type and window, on a stream or a table; events later than the watermark drop out of a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
