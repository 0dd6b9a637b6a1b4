"""Counts and moments of tables that grow: the same plans on streams, with state by window or key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import folder


def opened(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files that a path or pattern names, with the schema of those that are there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def window_counts(events: DataFrame, keys: list[str], width: str = "1 hour", late: str = "1 day", time: str = "ts") -> DataFrame:
    """(start, keys, n): rows in each window of time. Windows that end more than `late` before the latest row are closed and forgotten."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).where(F.col(time).isNotNull()).withWatermark(time, late)
    return timed.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def running_moments(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, variance) so far; the variance is zero for one row."""
    v = F.col(value).cast("double")
    return rows.groupBy(key).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias("variance"))


def drained(stream: DataFrame) -> DataFrame:
    """All that a stream has now, run to its end; an aggregate's last state. State and rows lie in the shared folder."""
    spark = stream.sparkSession
    place = f"{folder(spark)}/gridloom-stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(place + "/rows")

    run = stream.writeStream.outputMode("complete").option("checkpointLocation", place + "/state").trigger(availableNow=True).foreachBatch(put).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(place + "/rows")
