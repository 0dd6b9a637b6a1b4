"""Fields: tables whose index columns are grid or category dimensions, and the fields that the star-schema tables hold."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axis:
    """One dimension: its column, number of cells, cell width, and whether it counts modes."""

    name: str
    size: int
    distance: float = 1.0
    harmonic: bool = False

    @property
    def volume(self) -> float:
        return self.size * self.distance


@dataclass(frozen=True)
class Field:
    """A DataFrame with one row for each index, its axes and the column of its values."""

    df: DataFrame
    axes: tuple[Axis, ...]
    value: str = "v"

    def with_df(self, df: DataFrame, axes: tuple[Axis, ...] | None = None) -> Field:
        return replace(self, df=df, axes=self.axes if axes is None else axes)

    def axis(self, name: str) -> Axis:
        return next(a for a in self.axes if a.name == name)

    @property
    def names(self) -> list[str]:
        return [a.name for a in self.axes]


def full(spark: SparkSession, axes: tuple[Axis, ...], c: float) -> Field:
    """A constant field on all indices."""
    df = spark.range(axes[0].size).withColumnRenamed("id", axes[0].name)
    for a in axes[1:]:
        df = df.withColumn(a.name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(a.size - 1).cast("long"))))
    return Field(df.withColumn("v", F.lit(float(c))), axes)


def dense(field: Field, fill: float = 0.0) -> Field:
    """The field with every index of its axes; absent ones get `fill`."""
    grid = full(field.df.sparkSession, field.axes, fill).df.drop("v")
    return field.with_df(grid.join(field.df, field.names, "left").fillna(fill, [field.value]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HOURS = 720


def hour_of(ts: Column) -> Column:
    """Hours since 2024-01-01 of a histogram of 720 bins: the last bin holds its right edge too, what lies outside is null."""
    seconds = F.unix_micros(ts.cast("timestamp")) / 1e6 - 1704067200
    return F.when(seconds == HOURS * 3600, HOURS - 1).when((seconds >= 0) & (seconds < HOURS * 3600), F.floor(seconds / 3600)).cast("long")


def counts_hour(spark: SparkSession, sf_dir: str) -> Field:
    """Events an hour, zero where there are none."""
    n = table(spark, sf_dir, "events").select(hour_of(F.col("ts")).alias("i")).where("i is not null").groupBy("i").agg(F.count("*").alias("v"))
    return dense(Field(n, (Axis("i", HOURS),)), 0)


def type_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, i, v): events of a type in an hour."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), hour_of(F.col("ts")).alias("i")).where("i is not null").groupBy("key", "i").agg(F.count("*").cast("double").alias("v"))


def emb(spark: SparkSession, sf_dir: str) -> Field:
    """Embeddings as samples s along a periodic axis j of 64."""
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("s"), F.posexplode("embedding").alias("j", "x")).select("s", "j", F.col("x").cast("double").alias("v"))
    return Field(df, (Axis("s", 0), Axis("j", 64)))


def grid2d(spark: SparkSession, sf_dir: str) -> Field:
    """Price of lineitems on 16 x 16 cells of part and supplier, in cents to add exactly."""
    li = table(spark, sf_dir, "lineitem").select(F.pmod("l_partkey", F.lit(16)).cast("long").alias("i"), F.pmod("l_suppkey", F.lit(16)).cast("long").alias("j"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("c"))
    cells = li.groupBy("i", "j").agg((F.sum("c") / 1e6).alias("v"))
    return dense(Field(cells, (Axis("i", 16, 0.5), Axis("j", 16, 0.25))))


def resid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, s, r): standardised discounts of lineitems, by return flag and line number."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("key"), F.col("l_linenumber").alias("s"), ((F.col("l_discount") - 0.05) / 0.03).alias("r"))


def user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, t, id, dt, xi): events of a user in order, hours since the one before, and standardised values."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("id"), F.col("value"))
    w = Window.partitionBy("k").orderBy("t", "id")
    return e.select("k", "t", "id", (F.coalesce(F.col("t") - F.lag("t").over(w), F.lit(3600)) / 3600.0).alias("dt"), ((F.col("value") - 50) / 25).alias("xi"))
