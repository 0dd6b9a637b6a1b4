"""Fourier sums between a regular grid and points anywhere, through a grid of twice the size and a short kernel.

A point touches `WIDTH` cells along each axis; sums over cells are combined before the shuffle. Cell k of an axis of size N stands for the
frequency k - N // 2, and a point's coordinates x_<axis> are in periods. Errors are about 1e-11 of the sum of moduli.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.fields import Axis
from .harmonic import _along

#: Cells that a point touches along an axis, and the kernel's steepness.
WIDTH = 14
STEEP = 2.3 * WIDTH


def _kernel(t: Column) -> Column:
    """The kernel at a distance of t cells."""
    s = 1 - F.pow(2 * t / WIDTH, 2)
    return F.when(s >= 0, F.exp(STEEP * (F.sqrt(F.greatest(s, F.lit(0.0))) - 1))).otherwise(0.0)


def _transform(k: Column, size: int) -> Column:
    """The kernel's Fourier integral at frequency k for an axis of `size` cells, by Gauss and Legendre."""
    x, w = np.polynomial.legendre.leggauss(2 * WIDTH + 16)
    half = [(float(a) * WIDTH / 2, float(b) * WIDTH * math.exp(STEEP * (math.sqrt(1 - a * a) - 1))) for a, b in zip(x, w, strict=True) if a > 0]
    terms = [b * F.cos(k * (2 * math.pi * t / size)) for t, b in half]
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2], strict=False)] + ([terms[-1]] if len(terms) % 2 else [])
    return terms[0]


def _touched(points: DataFrame, axes: tuple[Axis, ...]) -> DataFrame:
    """The points once for each cell that they touch, with columns of the cell and the kernel's weight _w."""
    out = points.withColumn("_w", F.lit(1.0))
    for a in axes:
        size = 2 * a.size
        u = F.pmod(F.col("x_" + a.name), F.lit(1.0)) * size
        first = F.ceil(u - WIDTH / 2).cast("long")
        out = out.withColumn("_u", u).withColumn("_c", F.explode(F.sequence(first, first + WIDTH - 1)))
        out = out.withColumn("_w", F.col("_w") * _kernel(F.col("_c") - F.col("_u"))).withColumn(a.name, F.pmod("_c", F.lit(size).cast("long"))).drop("_u", "_c")
    return out


def _summed(z: DataFrame, axes: tuple[Axis, ...], sign: int) -> DataFrame:
    names = tuple(a.name for a in axes)
    for a in axes:
        z = _along(z, names, Axis(a.name, a.size * 2), sign > 0)
        if sign > 0:
            z = z.withColumns({c: F.col(c) * (2 * a.size) for c in ("re", "im")})
    return z


def _corrected(z: DataFrame, axes: tuple[Axis, ...], frequency) -> DataFrame:
    for a in axes:
        z = z.withColumn("_f", _transform(frequency(a), 2 * a.size)).withColumns({c: F.col(c) / F.col("_f") for c in ("re", "im")}).drop("_f")
    return z


def at_points(grid: DataFrame, points: DataFrame, axes: tuple[Axis, ...], sign: int = -1) -> DataFrame:
    """(p, re, im): the sum over the grid (axes, re, im) of value * exp(sign 2 pi i f x) at points (p, x_<axis>)."""
    names = [a.name for a in axes]
    z = _corrected(grid.select(*names, "re", "im"), axes, lambda a: F.col(a.name) - a.size // 2)
    z = z.withColumns({a.name: F.pmod(F.col(a.name) - a.size // 2, F.lit(2 * a.size)).cast("long") for a in axes})
    touched = _touched(points.select("p", *("x_" + n for n in names)), axes)
    return touched.join(_summed(z, axes, sign), names, "left").groupBy("p").agg(*(F.coalesce(F.sum(F.col("_w") * F.col(c)), F.lit(0.0)).alias(c) for c in ("re", "im")))


def from_points(points: DataFrame, axes: tuple[Axis, ...], sign: int = 1) -> DataFrame:
    """(axes, re, im): the sum over points (x_<axis>, re, im) of value * exp(sign 2 pi i f x) on the grid; the adjoint of `at_points`."""
    names = [a.name for a in axes]
    cells = _touched(points.select(*("x_" + n for n in names), "re", "im"), axes).groupBy(*names).agg(*(F.sum(F.col("_w") * F.col(c)).alias(c) for c in ("re", "im")))
    z = _summed(cells, axes, sign)
    for a in axes:
        k = F.when(F.col(a.name) < a.size, F.col(a.name)).otherwise(F.col(a.name) - 2 * a.size) + a.size // 2
        z = z.withColumn(a.name, k.cast("long")).where((F.col(a.name) >= 0) & (F.col(a.name) < a.size))
    return _corrected(z, axes, lambda a: F.col(a.name) - a.size // 2).select(*names, "re", "im")
