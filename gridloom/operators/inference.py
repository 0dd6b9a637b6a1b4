"""Posteriors of periodic fields with a prior on differences: Newton's mode, and samples that solve the posterior's own precision.

Vectors are tables (i, v). A sample is the solution of A r = b with b drawn from covariance A, the sum of the metric of the data and the
prior's precision, so r has covariance 1 / A. All samples are solved as one system of block form; draws come from hashes of
(seed, sample, index) and don't depend on the partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .solvers import conjugate_gradient


def normal(*key: Column) -> Column:
    """A standard normal number for each key, by Box and Muller."""
    u, w = (((F.shiftrightunsigned(F.xxhash64(*key, F.lit(k)), 11)).cast("double") + 0.5) * 2.0**-53 for k in (1, 2))
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * w)


def difference_precision(x: DataFrame, size: int, smoothness: float) -> DataFrame:
    """Smoothness times the sum of squared differences, as an operator; the index is s * size + i, and each s has a circle of its own."""
    start, at = F.col("i") - F.pmod("i", F.lit(size)), F.pmod("i", F.lit(size))
    put = [(0, 2.0), (1, -1.0), (-1, -1.0)]
    spread = x.select(F.explode(F.array(*(F.struct((start + F.pmod(at + d, F.lit(size))).alias("i"), (w * smoothness * F.col("v")).alias("v")) for d, w in put))).alias("e"))
    return spread.groupBy("e.i").agg(F.sum("e.v").alias("v"))


def solve(metric: DataFrame, b: DataFrame, size: int, smoothness: float, iterations: int = 60, tolerance: float = 1e-8) -> DataFrame:
    """x (i, v) with (metric + precision) x = b; metric is (i, m) on one circle."""

    def apply(x: DataFrame) -> DataFrame:
        own = x.withColumn("_c", F.pmod("i", F.lit(size))).join(metric.select(F.col("i").alias("_c"), "m"), "_c").select("i", (F.col("m") * F.col("v")).alias("v"))
        return own.unionByName(difference_precision(x, size, smoothness)).groupBy("i").agg(F.sum("v").alias("v"))

    return conjugate_gradient(apply, b, "i", iterations, tolerance)


def residual_samples(metric: DataFrame, size: int, smoothness: float, n: int, seed: int = 0, iterations: int = 60) -> DataFrame:
    """(s, i, v): n draws of the normal law whose inverse covariance is metric + precision."""
    base = metric.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("s"), "i", "m")
    edge = math.sqrt(smoothness) * normal(F.lit(seed), F.col("s"), F.col("i"), F.lit("edge"))
    here = F.struct((F.col("s") * size + F.col("i")).alias("i"), (F.sqrt("m") * normal(F.lit(seed), F.col("s"), F.col("i"), F.lit("data")) + edge).alias("v"))
    after = F.struct((F.col("s") * size + F.pmod(F.col("i") + 1, F.lit(size))).alias("i"), (-edge).alias("v"))
    b = base.select(F.explode(F.array(here, after)).alias("e")).groupBy("e.i").agg(F.sum("e.v").alias("v"))
    return solve(metric, b, size, smoothness, iterations).select(F.floor(F.col("i") / size).alias("s"), F.pmod("i", F.lit(size)).alias("i"), "v")


def poisson_mode(data: DataFrame, size: int, smoothness: float, steps: int = 6) -> DataFrame:
    """(i, v): the log-rate of greatest posterior density for counts (i, v), by Newton's method from the log of the mean.

    A step is shortened to 2 in the largest component. Counts without any event have no mode and raise ValueError.
    """
    mean = data.agg(F.avg("v")).first()[0]
    if not mean:
        raise ValueError("no events")
    x = data.select("i", F.lit(math.log(mean)).alias("v"))
    for _ in range(steps):
        both = data.select("i", F.col("v").alias("d")).join(x.select("i", F.col("v").alias("x")), "i")
        slope = both.select("i", (F.col("d") - F.exp("x")).alias("v")).unionByName(difference_precision(x, size, smoothness).select("i", (-F.col("v")).alias("v")))
        step = solve(x.select("i", F.exp("v").alias("m")), slope.groupBy("i").agg(F.sum("v").alias("v")), size, smoothness, iterations=30, tolerance=1e-6)
        longest = step.agg(F.max(F.abs("v"))).first()[0]
        shorten = min(1.0, 2.0 / longest) if longest else 1.0
        x = x.join(step.select("i", F.col("v").alias("y")), "i").select("i", (F.col("v") + shorten * F.col("y")).alias("v"))
        x = cut(x)
        if longest < 1e-6:
            break
    return x
