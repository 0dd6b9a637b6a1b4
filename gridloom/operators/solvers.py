"""Conjugate gradients on distributed vectors: each step is one application and one pass of dot products."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lineage


def conjugate_gradient(apply: Callable[[DataFrame], DataFrame], b: DataFrame, index: str = "i", iterations: int = 50, tolerance: float = 1e-10, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """x (index, v) with apply(x) = b, for a symmetric positive operator. Only scalars come to the driver; `cut` ends lineage."""
    cut = cut or lineage.cut
    last = state = cut(b.select(index, F.lit(0.0).alias("x"), F.col("v").alias("r"), F.col("v").alias("d")))
    norm = first = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    for _ in range(iterations):
        if norm <= tolerance * tolerance * max(first, 1e-300):
            break
        moved = cut(state.join(apply(state.select(index, F.col("d").alias("v"))).withColumnRenamed("v", "q"), index))
        curvature = moved.agg(F.sum(F.col("d") * F.col("q"))).first()[0]
        if not curvature or curvature <= 0:
            raise ValueError("the operator is not positive")
        lineage.forget(last)
        last = moved
        alpha = norm / curvature
        state = moved.select(index, (F.col("x") + alpha * F.col("d")).alias("x"), (F.col("r") - alpha * F.col("q")).alias("r"), "d")
        new = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
        state = state.withColumn("d", F.col("r") + (new / norm) * F.col("d"))
        norm = new
    return state.select(index, F.col("x").alias("v"))


def wiener_filter(data: DataFrame, smoothness: float, noise: float, size: int, index: str = "i", iterations: int = 40) -> DataFrame:
    """Posterior mean of a periodic field whose prior penalises squared differences, from data with white noise."""

    def precision(x: DataFrame) -> DataFrame:
        spread = x.select(F.explode(F.array(F.struct(F.col(index).alias("i"), ((2 * smoothness + 1 / noise) * F.col("v")).alias("v")), F.struct(F.pmod(F.col(index) + 1, F.lit(size)).alias("i"), (-smoothness * F.col("v")).alias("v")), F.struct(F.pmod(F.col(index) - 1, F.lit(size)).alias("i"), (-smoothness * F.col("v")).alias("v")))).alias("e"))
        return spread.select(F.col("e.i").alias(index), "e.v").groupBy(index).agg(F.sum("v").alias("v"))

    return conjugate_gradient(precision, data.select(index, (F.col("v") / noise).alias("v")), index, iterations)
