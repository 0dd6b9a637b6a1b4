"""Cumulative processes along an ordered column: window sums where the recurrence is additive, else a scan with a carried state.

A series of N steps has N + 1 values, n = 0 to N, the first the start. Windows spill; the scan reads a sorted partition batch by
batch and keeps only the last state, so series of any length go through both. A series is one sequence and lies in one task.
Null keys are series like others; steps with a null input give nulls from there on; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _run(key: str, order: list[str]):
    return Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _started(steps: DataFrame, key: str, order: list[str], **first: Column) -> DataFrame:
    """(key, n, values): the steps numbered from 1 and the start of each series as n = 0."""
    at = Window.partitionBy(key).orderBy(*order)
    rest = steps.select(key, F.row_number().over(at).cast("long").alias("n"), *first)
    return rest.unionByName(steps.select(key).distinct().select(key, F.lit(0).cast("long").alias("n"), *(v.alias(c) for c, v in first.items())))


def wiener(df: DataFrame, key: str, order: list[str], x0: float, sigma: float) -> DataFrame:
    """(key, n, x): x0 plus the running sum of sqrt(dt) sigma xi."""
    steps = df.withColumn("x", x0 + F.sum(F.sqrt("dt") * sigma * F.col("xi")).over(_run(key, order)))
    return _started(steps, key, order, x=F.lit(float(x0)))


def integrated_wiener(df: DataFrame, key: str, order: list[str], sigma: float, asperity: float = 0.0, x0: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(key, n, x, slope): columns xi0 (value) and xi1 (slope) drive two nested running sums from x0 = (value, slope)."""
    w, at = _run(key, order), Window.partitionBy(key).orderBy(*order)
    step = sigma * F.sqrt("dt")
    d = df.withColumn("_ds", step * F.col("xi1")).withColumn("slope", x0[1] + F.sum("_ds").over(w))
    before = F.coalesce(F.lag("slope").over(at), F.lit(float(x0[1])))
    d = d.withColumn("_dx", step * F.col("xi0") * F.sqrt(F.col("dt") * F.col("dt") / 12 + asperity) + F.col("dt") * before + 0.5 * F.col("dt") * F.col("_ds"))
    return _started(d.withColumn("x", x0[0] + F.sum("_dx").over(w)), key, order, x=F.lit(float(x0[0])), slope=F.lit(float(x0[1])))


def _scan(df: DataFrame, key: str, order: list[str], x0: list[float], drift: Column, amplitude: Column, noise: Column) -> DataFrame:
    """(key, n, x): x is an array; drift and amplitude are row-major matrices, noise a vector."""
    d = len(x0)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, n = object(), None, 0
        for b in batches:
            keys, ns, xs = [], [], []
            for k, a, m, z in zip(b.column(0).to_pylist(), *(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if k != last:
                    last, state, n = k, np.array(x0, float), 0
                    keys.append(k), ns.append(0), xs.append(state.tolist())
                vals = [np.array([np.nan if y is None else y for y in v], float) if v is not None else np.full(size, np.nan) for v, size in ((a, d * d), (m, d * d), (z, d))]
                state = vals[0].reshape(d, d) @ state + vals[1].reshape(d, d) @ vals[2]
                n += 1
                keys.append(k), ns.append(n), xs.append([None if np.isnan(y) else y for y in state.tolist()])
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(ns, pa.int64()), pa.array(xs, pa.list_(pa.float64()))], [key, "n", "x"])

    src = df.repartition(key).sortWithinPartitions(key, *order).select(key, drift.alias("_d"), amplitude.alias("_a"), noise.alias("_z"))
    return src.mapInArrow(run, f"`{key}` {kind}, n long, x array<double>")


def discrete_gauss_markov(df: DataFrame, key: str, order: list[str], x0: list[float], drift: str, amplitude: str, noise: str = "xi") -> DataFrame:
    """(key, n, x): x <- drift x + amplitude noise for vectors; the columns hold row-major matrices and vectors as arrays."""
    return _scan(df, key, order, list(x0), F.col(drift), F.col(amplitude), F.col(noise))


def gauss_markov(df: DataFrame, key: str, order: list[str], x0: float, drift: str, amplitude: str, noise: str = "xi") -> DataFrame:
    """(key, n, x): the same for scalars."""
    return _scan(df, key, order, [float(x0)], F.array(drift), F.array(amplitude), F.array(noise)).select(key, "n", F.col("x")[0].alias("x"))


def ornstein_uhlenbeck(df: DataFrame, key: str, order: list[str], x0: float, sigma: float, gamma: float) -> DataFrame:
    """(key, n, x): drift exp(-gamma dt), amplitude sigma sqrt(1 - drift^2)."""
    d = df.withColumn("_drift", F.exp(-gamma * F.col("dt")))
    return gauss_markov(d.withColumn("_amp", sigma * F.sqrt(1 - F.col("_drift") * F.col("_drift"))), key, order, x0, "_drift", "_amp")
