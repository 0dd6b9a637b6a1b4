"""Amplitudes of power spectra that are learned bin by bin, and correlated fields over several spaces, each with its own amplitude.

An amplitude is a table (bin, v), with a key column before it where there are several. Bins are the distinct mode lengths of a space; one
amplitude's bins meet in one window, so they must fit into a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.domains import Power, Regular
from . import harmonic
from .processes import integrated_wiener


def bins(spark: SparkSession, space: Regular) -> DataFrame:
    """(bin, rho, k, rel, dt): multiplicity and length of the modes, the logarithm of the length over that of bin 1, and its increase."""
    lengths = harmonic.reduce_lengths(space.codomain)
    if len(lengths) < 2:
        raise ValueError("a space of one cell has no spectrum")
    rel = [0.0] + [math.log(k / lengths[1][0]) for k, _ in lengths[1:]]
    rows = [(b, n, k, rel[b], rel[b] - rel[b - 1] if b > 1 else 0.0) for b, (k, n) in enumerate(lengths)]
    return spark.createDataFrame(rows, "bin long, rho long, k double, rel double, dt double")


def tabulated(spark: SparkSession, space: Regular, amplitude: Callable[[Column], Column]) -> DataFrame:
    """(bin, v) of an amplitude that is a function of the mode length."""
    return bins(spark, space).select("bin", amplitude(F.col("k")).cast("double").alias("v"))


def nonparametric_amplitude(
    spark: SparkSession, space: Regular, slope: float, fluctuations: float = 1.0, xi: DataFrame | None = None, flexibility: float = 0.0, asperity: float = 0.0, key: str = "s", kind: str = "amplitude"
) -> DataFrame:
    """(bin, v), or (key, bin, v) of excitations xi (key, bin, xi0, xi1) for the bins from 2.

    The logarithm is a slope in the logarithmic length plus an integrated Wiener path without its own slope; the field has deviation
    `fluctuations`, and the zero mode the volume. kind: whether the slope is that of the amplitude or of the power.
    """
    if kind not in ("amplitude", "power"):
        raise ValueError("kind is amplitude or power")
    table = bins(spark, space)
    volume, last = space.total_volume, math.log(space.codomain.unique_lengths()[-1] / space.codomain.unique_lengths()[1])
    if xi is None:
        path = table.where("bin > 0").select(F.lit(0).alias(key), "bin", "rho", "rel", F.lit(0.0).alias("x"))
    else:
        steps = xi.select(key, "bin", "xi0", "xi1").join(table.select("bin", "dt"), "bin").where("bin > 1")
        path = integrated_wiener(steps, key, ["bin"], flexibility, asperity).select(key, (F.col("n") + 1).alias("bin"), "x").join(table.select("bin", "rho", "rel"), "bin")
    one = Window.partitionBy(key)
    deviation = F.col("x") - (F.max_by("x", "bin").over(one) * F.col("rel") / last if last > 0 else F.lit(0.0))
    power = 2.0 if kind == "amplitude" else 1.0
    path = path.withColumn("_y", F.exp(slope * F.col("rel") + deviation)).withColumn("_n", F.sum(F.col("rho") * F.pow("_y", F.lit(power))).over(one))
    out = path.select(key, "bin", (fluctuations * volume / F.sqrt("_n") * F.pow("_y", F.lit(power / 2))).alias("v"))
    zero = out.select(key).distinct().select(key, F.lit(0).cast("long").alias("bin"), F.lit(float(volume)).alias("v"))
    out = out.unionByName(zero)
    return out if xi is not None else out.drop(key)


def field(xi: DataFrame, parts: list[tuple[Regular, DataFrame]], offset: float = 0.0, offset_deviation: float = 1.0, index: tuple[str, ...] | None = None) -> DataFrame:
    """The modes xi (index, v) under the outer product of the amplitudes (bin, v) of several spaces, on their positions.

    Amplitudes beyond the zero mode are relative to `offset_deviation`, which scales all. Further columns that an amplitude shares with
    the index, such as the number of a sample, select it.
    """
    index = index or tuple(a.name for space, _ in parts for a in space.axes)
    x = xi.select(*index, (F.col("v") * float(offset_deviation)).alias("v"))
    for space, amplitude in parts:
        keys = [c for c in amplitude.columns if c in index]
        a = amplitude.select(*keys, F.col("bin").alias("_bin"), F.when(F.col("bin") > 0, F.col("v") / float(offset_deviation)).otherwise(F.col("v")).alias("_a"))
        x = x.withColumn("_bin", Power(space.codomain).bin_of(space.codomain.mode_length())).join(a, [*keys, "_bin"]).select(*index, (F.col("v") * F.col("_a")).alias("v"))
    for space, _ in parts:
        x = harmonic.harmonic_transform(x, space.codomain, index)
    return x.select(*index, (offset + F.col("v")).alias("v"))
