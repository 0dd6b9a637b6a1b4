"""Written intermediate tables, so that iterations survive lost executors and plans stay small."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_private: str | None = None


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir or of the context; a private one only in local mode, where neither is set."""
    global _private
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not named and _private is None:
        _private = tempfile.mkdtemp(prefix="gridloom-")
    return (named or _private).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows, written and read again."""
    spark = df.sparkSession
    path = f"{folder(spark)}/gridloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete tables that `cut` returned and nothing reads any more."""
    for t in tables:
        if t is not None and getattr(t, "_written", None):
            spark = t.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(t._written)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            t._written = None
