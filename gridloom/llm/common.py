"""Helpers shared by the operators: table access, checkpoints, connected components, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir or the context names. Where neither is set: a private one in local mode, else an error."""
    global _private
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not named and _private is None:
        _private = tempfile.mkdtemp(prefix="gridloom-")
    return (named or _private).rstrip("/")


_private: str | None = None


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage: write the rows to the shared folder and read them again; `forget` deletes them.

    Unlike DataFrame.checkpoint this also drops the estimates of the plan before, which are products over all joins and, over
    rounds of an iteration, grow into numbers that take minutes to multiply; files have a real size instead.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gridloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete tables that `checkpoint` returned and nothing reads any more."""
    for t in tables:
        if t is not None and getattr(t, "_written", None):
            spark = t.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(t._written)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            t._written = None


def text_of(col: str | Column) -> Column:
    """The column as a string, null as empty."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))


def number_table(values: list[float]) -> Column:
    """A constant array column. Catalyst folds it to one literal, so the plan stays small."""
    return F.expr("cast(split('" + ",".join(f"{v:.4g}" for v in values) + "', ',') as array<double>)")


def runs_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal keys of a sorted partition, as tables of whole runs."""
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        k = held.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1], "left")) if np.all(k[:-1] <= k[1:]) else len(k)
        if cut:
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id with an edge to another; component is the smallest id reachable.

    Rounds of contraction: each node moves to its neighbour of least hash, edges are renamed and made distinct,
    until none is left; then names are followed back. Every grouping pre-aggregates and the renaming joins are plain
    shuffled joins, which adaptive execution splits, so a hub with a third of all edges costs no single task.
    Nulls and self loops are ignored; an empty input gives an empty result.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    kind = e.schema["u"].dataType
    e = checkpoint(e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*").distinct())
    steps: list[DataFrame] = []
    while not e.isEmpty():
        low = F.least(F.struct(F.xxhash64("u").alias("h"), F.col("u").alias("n")), F.col("m")).getField("n")
        p = e.groupBy("u").agg(F.min(F.struct(F.xxhash64("v").alias("h"), F.col("v").alias("n"))).alias("m")).select("u", low.alias("p"))
        p = checkpoint(p)
        steps.append(p)
        left = e.join(p, "u").select("v", F.col("p").alias("pu")).join(p.withColumnRenamed("u", "v"), "v").select(F.col("pu").alias("u"), F.col("p").alias("v")).where("u <> v").distinct()
        left = checkpoint(left)
        forget(e)
        e = left
    if not steps:
        return e.select(F.col("u").alias("id"), F.col("v").cast(kind).alias("component"))
    label = steps[0].select(F.col("u").alias("id"), F.col("p").alias("r"))
    for p in steps[1:]:
        label = label.join(p.withColumnRenamed("u", "r"), "r", "left").select("id", F.coalesce("p", "r").alias("r"))
    label = checkpoint(label)
    forget(*steps)
    return label.join(label.groupBy("r").agg(F.min("id").alias("component")), "r").select("id", "component")
