"""Sample lists: long tables (sample, index..., v), written as Parquet partitioned by sample, with their statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Samples:
    """Fields numbered by the column `s`."""

    df: DataFrame
    index: tuple[str, ...]
    value: str = "v"

    def map(self, op: Callable[[Column], Column]) -> Samples:
        return Samples(self.df.withColumn(self.value, op(F.col(self.value))), self.index, self.value)

    def average(self) -> DataFrame:
        return self.df.groupBy(*self.index).agg(F.avg(self.value).alias("mean"))

    def stat(self) -> DataFrame:
        """Mean and sample variance at each index; the variance of one sample is 0."""
        return self.df.groupBy(*self.index).agg(F.avg(self.value).alias("mean"), F.coalesce(F.var_samp(self.value), F.lit(0.0)).alias("variance"))

    def iterator(self) -> Iterator[Row]:
        """Rows in order of the samples, one partition at a time on the driver."""
        return self.df.orderBy("s", *self.index).toLocalIterator()

    def equals(self, other: Samples) -> bool:
        """Exactly equal rows, repeated ones counted."""
        columns = ["s", *self.index, self.value]
        a, b = (x.df.select(*columns).groupBy(*columns).count() for x in (self, other))
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    def save(self, path: str, *, overwrite: bool = False, stat: bool = False) -> None:
        """Folders `samples` and, if asked for, `stat` under the path; existing ones are kept unless `overwrite`."""
        mode = "overwrite" if overwrite else "errorifexists"
        self.df.select("s", *self.index, self.value).repartition("s").write.mode(mode).partitionBy("s").parquet(f"{path}/samples")
        if stat:
            self.stat().write.mode(mode).parquet(f"{path}/stat")


def load(spark: SparkSession, path: str, value: str = "v") -> Samples:
    """The list written by `Samples.save`."""
    df = spark.read.parquet(f"{path}/samples").withColumn("s", F.col("s").cast("long"))
    return Samples(df, tuple(c for c in df.columns if c not in ("s", value)), value)


def residual(mean: DataFrame, residuals: Samples, sign: Column | int = 1) -> Samples:
    """Samples mean + sign x residual; another mean moves the same residuals. `mean` has the index columns and the value."""
    v = residuals.value
    moved = residuals.df.withColumn("_r", F.col(v) * sign).drop(v).join(mean.select(*residuals.index, F.col(v).alias("_m")), list(residuals.index))
    return Samples(moved.select("s", *residuals.index, (F.col("_m") + F.col("_r")).alias(v)), residuals.index, v)


def mirrored(residuals: Samples) -> Samples:
    """Each residual and its negative, as samples 2 s and 2 s + 1."""
    pair = F.explode(F.array(F.struct((2 * F.col("s")).alias("s"), F.col(residuals.value).alias("x")), F.struct((2 * F.col("s") + 1).alias("s"), (-F.col(residuals.value)).alias("x"))))
    df = residuals.df.select(*residuals.index, pair.alias("_p"))
    return Samples(df.select("_p.s", *residuals.index, F.col("_p.x").alias(residuals.value)), residuals.index, residuals.value)
