"""Intermediate tables in the cluster's shared folder: they cut the lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import cache

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


@cache
def _local_dir() -> str:
    own = tempfile.TemporaryDirectory(prefix="quillon-")
    atexit.register(own.cleanup)
    return own.name


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a local one, for a session in one process only."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _local_dir()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, removed by `discard` or when the process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_at_exit, spark, path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that `written` gave, once all that was made from them is itself stored or collected."""
    for t in tables:
        _remove(t.sparkSession, t.stored_at)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    """A session that has ended leaves its folder to whoever gave it."""
    try:
        _remove(spark, path)
    except (PySparkException, OSError, AttributeError, TypeError):
        return
