"""Transforms along several axes, convolutions, spectra and correlated fields on regular grids.

A complex field has columns re and im. A transform along one axis holds that axis in one row, for each index of the others; the axes
are done one after the other, so no row ever holds more than one axis.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.domains import Power, Regular
from ..sources.fields import Axis


def _along(df: DataFrame, index: tuple[str, ...], axis: Axis, inverse: bool) -> DataFrame:
    """The discrete Fourier transform along an axis; absent rows are zeros."""
    others = [c for c in index if c != axis.name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            re, im = [], []
            for at, x, y in zip(*(b.column(len(others) + k) for k in range(3)), strict=True):
                z = np.zeros(axis.size, complex)
                z[at.values.to_numpy()] = x.values.to_numpy() + 1j * y.values.to_numpy()
                z = np.fft.ifft(z) if inverse else np.fft.fft(z)
                re.append(z.real), im.append(z.imag)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(others))), pa.array(re, pa.list_(pa.float64())), pa.array(im, pa.list_(pa.float64()))], [*others, "re", "im"])

    rows = df.groupBy(*others).agg(F.collect_list(F.struct(F.col(axis.name).cast("long").alias("a"), "re", "im")).alias("z")).select(*others, "z.a", "z.re", "z.im")
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others)
    out = rows.mapInArrow(run, (kinds + ", " if kinds else "") + "re array<double>, im array<double>")
    return out.select(*others, F.posexplode(F.arrays_zip("re", "im")).alias(axis.name, "_z")).select(*(F.col(c).cast("long").alias(c) if c == axis.name else c for c in index), F.col("_z.re").alias("re"), F.col("_z.im").alias("im"))


def complex_of(x: DataFrame, index: tuple[str, ...]) -> DataFrame:
    return x.select(*index, F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im"))


def real_part(z: DataFrame, index: tuple[str, ...]) -> DataFrame:
    return z.select(*index, F.col("re").alias("v"))


def imaginary_part(z: DataFrame, index: tuple[str, ...]) -> DataFrame:
    return z.select(*index, F.col("im").alias("v"))


def conjugate(z: DataFrame, where: Column | None = None) -> DataFrame:
    """The conjugate, of the rows `where` if given (as for some keys of a multi-field)."""
    return z.withColumn("im", -F.col("im") if where is None else F.when(where, -F.col("im")).otherwise(F.col("im")))


def fft(z: DataFrame, axes: tuple[Axis, ...], index: tuple[str, ...] | None = None, inverse: bool = False) -> DataFrame:
    """The transform over `axes`, weighted by their cells' volume; the inverse weights by the modes'. Other index columns stay."""
    index = index or tuple(a.name for a in axes)
    for a in axes:
        z = _along(z, index, a, inverse)
    w = math.prod(a.distance for a in axes)
    return z.withColumns({c: F.col(c) * (1 / w if inverse else w) for c in ("re", "im")})


def hartley(x: DataFrame, axes: tuple[Axis, ...], index: tuple[str, ...] | None = None) -> DataFrame:
    """Real plus imaginary part of the transform, without weights."""
    index = index or tuple(a.name for a in axes)
    z = complex_of(x, index)
    for a in axes:
        z = _along(z, index, a, False)
    return z.select(*index, (F.col("re") + F.col("im")).alias("v"))


def harmonic_transform(x: DataFrame, space: Regular, index: tuple[str, ...] | None = None) -> DataFrame:
    """A field of modes on its position space."""
    index = index or tuple(a.name for a in space.axes)
    return hartley(x, space.axes, index).withColumn("v", F.col("v") * space.cell_volume)


def convolve(x: DataFrame, position: Regular, kernel: Callable[[Column], Column], index: tuple[str, ...] | None = None) -> DataFrame:
    """Multiplication of the modes by a function of their length."""
    index = index or tuple(a.name for a in position.axes)
    modes = hartley(x, position.axes, index).withColumn("v", F.col("v") * kernel(position.codomain.mode_length()))
    return hartley(modes, position.axes, index).withColumn("v", F.col("v") / position.size)


def smooth(x: DataFrame, position: Regular, sigma: float, index: tuple[str, ...] | None = None) -> DataFrame:
    """Convolution with a Gaussian of deviation sigma."""
    return convolve(x, position, lambda k: F.exp(-2 * math.pi**2 * sigma**2 * k * k), index)


def power_analyze(x: DataFrame, position: Regular, bounds: tuple[float, ...] | None = None) -> DataFrame:
    """(bin, power): mean squared modulus of the weighted modes in each bin."""
    power = Power(position.codomain, bounds)
    z = fft(complex_of(x, tuple(a.name for a in position.axes)), position.axes)
    return z.groupBy(power.bin_of(position.codomain.mode_length()).alias("bin")).agg(F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def spread_power(values: DataFrame, space: Regular, spark, bounds: tuple[float, ...] | None = None) -> DataFrame:
    """A value for each mode from one for each bin (bin, v)."""
    bins = space.indices(spark).withColumn("bin", Power(space, bounds).bin_of(space.mode_length()))
    return bins.join(values, "bin").select(*(a.name for a in space.axes), "v")


def matern_amplitude(position: Regular, scale: float, cutoff: float, slope: float, renormalise: bool = False) -> Callable[[Column], Column]:
    """Amplitude of a mode by its length: scale (1 + (k / cutoff)^2)^(slope / 4) times the root of the volume; the zero mode has the volume."""
    v, size = position.total_volume, 1.0
    if renormalise:
        lengths = reduce_lengths(position.codomain)
        size = math.sqrt(sum(n * (1 + (k / cutoff) ** 2) ** (slope / 2) for k, n in lengths if k > 0)) / math.sqrt(v)
    return lambda k: F.when(k == 0, F.lit(float(v))).otherwise(scale * math.sqrt(v) / size * F.exp(0.25 * slope * F.log1p(F.pow(k / cutoff, 2))))


def reduce_lengths(space: Regular) -> list[tuple[float, int]]:
    """Mode lengths with their multiplicity, axis by axis, so that memory grows with the number of distinct lengths."""
    found: dict[float, int] = {0.0: 1}
    for a in space.axes:
        n = np.minimum(np.arange(a.size), a.size - np.arange(a.size))
        one = dict(zip(*(x.tolist() for x in np.unique((n * a.distance) ** 2, return_counts=True)), strict=True))
        new: dict[float, int] = {}
        for k, c in found.items():
            for q, m in one.items():
                new[round(k + q, 12)] = new.get(round(k + q, 12), 0) + c * m
        found = new
    return [(math.sqrt(k), c) for k, c in sorted(found.items())]


def correlated_field(xi: DataFrame, position: Regular, amplitude: Callable[[Column], Column], offset: float = 0.0, offset_deviation: float = 1.0, index: tuple[str, ...] | None = None) -> DataFrame:
    """Offset plus the modes xi with their amplitude, on the position space; `offset_deviation` scales the zero mode."""
    index = index or tuple(a.name for a in position.axes)
    k = position.codomain.mode_length()
    a = amplitude(k) * F.when(k == 0, offset_deviation).otherwise(1.0)
    return harmonic_transform(xi.withColumn("v", F.col("v") * a), position.codomain, index).withColumn("v", offset + F.col("v"))


def signal_variance(spectrum: Callable[[float], float], position: Regular) -> float:
    """The variance at a point of a field with this power spectrum, without its zero mode."""
    return sum(n * spectrum(k) for k, n in reduce_lengths(position.codomain) if k > 0) / position.total_volume
