"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_CLEARED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where the setting is absent, a folder of this process is made for a local master (tests); on a
    cluster that is an error, as its machines would not see each other's folders."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="scanlattice-")
        atexit.register(shutil.rmtree, _OWN["dir"], True)
    return "file://" + _OWN["dir"]


def work_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table of this application, below the shared folder."""
    path = f"{shared_dir(spark)}/work/{spark.sparkContext.applicationId}"
    if path not in _CLEARED:
        _CLEARED.add(path)
        atexit.register(_remove, spark, path)
    return f"{path}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Removes this application's intermediate tables. Results that were not yet read or written need
    them, so it is called after those; what is left goes when the driver's Python ends."""
    _remove(spark, f"{shared_dir(spark)}/work/{spark.sparkContext.applicationId}")


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # stopped: the folder stays for whoever clears the shared one
        return
    with contextlib.suppress(Py4JError, OSError):  # the JVM may have gone before Python
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
