"""Likelihoods that compose with models and with each other, and the Hamiltonian and averages built on them.

A likelihood has a value, a gradient, a Fisher metric and draws from it. The point-wise ones are tables of column expressions in the
datum d and the model's value m; `transform` is the coordinate in which the metric is the identity.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .algebra import Linear, Smooth, add, combine, diagonal, dot, scaling, smooth
from .inference import normal

#: kind -> energy, gradient, metric and transform of (d, m, parameter)
KINDS: dict[str, tuple[Callable, Callable, Callable, Callable]] = {
    "gaussian": (lambda d, m, w: 0.5 * w * (m - d) * (m - d), lambda d, m, w: w * (m - d), lambda d, m, w: F.lit(float(w)), lambda d, m, w: math.sqrt(w) * m),
    "poisson": (lambda d, m, _: m - d * F.ln(m), lambda d, m, _: 1 - d / m, lambda d, m, _: 1 / m, lambda d, m, _: 2 * F.sqrt(m)),
    "student_t": (
        lambda d, m, t: 0.5 * (t + 1) * F.log1p((m - d) * (m - d) / t), lambda d, m, t: (t + 1) * (m - d) / (t + (m - d) * (m - d)),
        lambda d, m, t: F.lit((t + 1) / (t + 3)), lambda d, m, t: math.sqrt((t + 1) / (t + 3)) * m,
    ),
    "bernoulli": (lambda d, m, _: -d * F.ln(m) - (1 - d) * F.ln(1 - m), lambda d, m, _: (m - d) / (m * (1 - m)), lambda d, m, _: 1 / (m * (1 - m)), lambda d, m, _: 2 * F.asin(F.sqrt(m))),
    "inverse_gamma": (lambda d, m, a: (a + 1) * F.ln(m) + d / m, lambda d, m, a: (a + 1) / m - d / (m * m), lambda d, m, a: (a + 1) / (m * m), lambda d, m, a: math.sqrt(a + 1) * F.ln(m)),
}


@dataclass(frozen=True)
class Energy:
    """A scalar function of a vector: value, gradient, metric, and draws whose covariance is the metric."""

    index: tuple[str, ...]
    value: Callable[[DataFrame], float]
    gradient: Callable[[DataFrame], DataFrame]
    metric: Callable[[DataFrame], Linear]
    draw: Callable[[DataFrame, tuple], DataFrame]
    transform: Callable[[DataFrame], list[tuple[DataFrame, tuple[str, ...]]]]
    root: Callable[[DataFrame], list[Linear]]

    def __matmul__(self, model: Smooth | Linear) -> Energy:
        """The energy of a model's output; the model's domain is the new one."""
        f = smooth(model)
        back = lambda x: f.jacobian(x).adjoint
        return Energy(
            f.domain, lambda x: self.value(f(x)), lambda x: back(x)(self.gradient(f(x))), lambda x: back(x) @ self.metric(f(x)) @ f.jacobian(x),
            lambda x, key: back(x)(self.draw(f(x), key)), lambda x: self.transform(f(x)), lambda x: [r @ f.jacobian(x) for r in self.root(f(x))],
        )

    def __add__(self, other: Energy) -> Energy:
        """Independent data about the same unknowns."""
        if self.index != other.index:
            raise ValueError("indices differ")
        return Energy(
            self.index, lambda x: self.value(x) + other.value(x), lambda x: add(self.gradient(x), other.gradient(x), self.index), lambda x: self.metric(x) + other.metric(x),
            lambda x, key: add(self.draw(x, (*key, 1)), other.draw(x, (*key, 2)), self.index), lambda x: self.transform(x) + other.transform(x), lambda x: self.root(x) + other.root(x),
        )


def white(x: DataFrame, index: tuple[str, ...], key: tuple) -> DataFrame:
    """Standard normal numbers at the indices of x; they depend on the key and the index alone."""
    return x.select(*index, normal(*(F.lit(k) for k in key), *(F.col(c) for c in index)).alias("v"))


def likelihood(kind: str, data: DataFrame, index: tuple[str, ...], parameter: float = 1.0) -> Energy:
    """One of `KINDS` for data (index, v). The parameter is the inverse variance, the degrees of freedom, or the shape."""
    energy, gradient, metric, transform = KINDS[kind]
    d = data.select(*index, F.col("v").alias("_d"))

    def at(x: DataFrame, f: Callable) -> DataFrame:
        return x.join(d, list(index)).select(*index, f(F.col("_d"), F.col("v"), parameter).cast("double").alias("v"))

    def root(x: DataFrame) -> Linear:
        return diagonal(at(x, lambda d, m, p: F.sqrt(metric(d, m, p))), index)

    return Energy(
        index, lambda x: at(x, energy).agg(F.coalesce(F.sum("v"), F.lit(0.0))).first()[0], lambda x: at(x, gradient), lambda x: diagonal(at(x, metric), index),
        lambda x, key: root(x)(white(x, index, key)), lambda x: [(at(x, transform), index)], lambda x: [root(x)],
    )


def prior(index: tuple[str, ...]) -> Energy:
    """Half the squared norm."""
    one = scaling(1.0, index)
    return Energy(index, lambda x: 0.5 * dot(x, x, index), lambda x: x, lambda x: one, lambda x, key: white(x, index, key), lambda x: [(x, index)], lambda x: [one])


def hamiltonian(lh: Energy) -> Energy:
    """Likelihood and standard normal prior."""
    return lh + prior(lh.index)


def quadratic(op: Linear, b: DataFrame | None = None) -> Energy:
    """x A x / 2 - b x for a symmetric operator. Draws need a root and are those of the prior."""
    index = op.domain
    grad = lambda x: op(x) if b is None else add(op(x), b, index, 1.0, -1.0)
    value = lambda x: 0.5 * dot(x, op(x), index) - (0.0 if b is None else dot(b, x, index))
    return Energy(index, value, grad, lambda x: op, lambda x, key: white(x, index, key), lambda x: [(x, index)], lambda x: [scaling(1.0, index)])


def averaged(energy: Energy, residuals: list[DataFrame]) -> Energy:
    """The mean of an energy over samples x + r; r in mirrored pairs if the list holds them."""
    n, index = len(residuals), energy.index
    moved = lambda x: [add(x, r, index) for r in residuals]
    return Energy(
        index, lambda x: sum(energy.value(y) for y in moved(x)) / n, lambda x: combine([energy.gradient(y) for y in moved(x)], [1 / n] * n, index),
        lambda x: reduce(lambda a, b: a + b, [energy.metric(y) for y in moved(x)]) * (1 / n), energy.draw, energy.transform, energy.root,
    )


def variable_student_t(d: Column, m: Column, inverse_std: Column, dof: float) -> Column:
    """Energy of a Student-t residual whose inverse scale is a model too; an aggregate expression."""
    return F.sum(0.5 * (dof + 1) * F.log1p(F.pow((m - d) * inverse_std, 2) / dof) - F.ln(inverse_std))


def vector_gaussian(residual: list[Column], root: list[list[Column]]) -> Column:
    """Energy of a vector residual with inverse covariance L L', L lower triangular with positive diagonal; an aggregate expression."""
    n = len(residual)
    white = [reduce(lambda a, b: a + b, [root[j][i] * residual[j] for j in range(i, n)]) for i in range(n)]
    return F.sum(0.5 * reduce(lambda a, b: a + b, [w * w for w in white]) - reduce(lambda a, b: a + b, [F.ln(root[i][i]) for i in range(n)]))
