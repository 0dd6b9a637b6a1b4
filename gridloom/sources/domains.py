"""Domains as descriptors: they know sizes, volumes and mode lengths, and give their indices as tables."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fields import Axis, full


@dataclass(frozen=True)
class Unstructured:
    """A shape without geometry."""

    shape: tuple[int, ...]

    @property
    def size(self) -> int:
        return math.prod(self.shape)


@dataclass(frozen=True)
class Regular:
    """A regular periodic grid; harmonic ones count modes. Without distances the whole length is 1, or a mode's width 1."""

    shape: tuple[int, ...]
    distances: tuple[float, ...] | None = None
    harmonic: bool = False
    names: tuple[str, ...] | None = None

    @property
    def axes(self) -> tuple[Axis, ...]:
        d = self.distances or tuple(1.0 if self.harmonic else 1 / n for n in self.shape)
        return tuple(Axis(name, n, x, self.harmonic) for name, n, x in zip(self.names or "ijklmn"[: len(self.shape)], self.shape, d, strict=True))

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def cell_volume(self) -> float:
        return math.prod(a.distance for a in self.axes)

    @property
    def total_volume(self) -> float:
        return self.cell_volume * self.size

    @property
    def codomain(self) -> Regular:
        return Regular(self.shape, tuple(1 / (a.size * a.distance) for a in self.axes), not self.harmonic, self.names)

    def indices(self, spark: SparkSession) -> DataFrame:
        return full(spark, self.axes, 0.0).df.drop("v")

    def mode_length(self) -> Column:
        """Distance of a mode from the zero mode, by the index columns."""
        if not self.harmonic:
            raise ValueError("a position space has no modes")
        return F.sqrt(reduce(lambda u, w: u + w, [F.pow(F.least(F.col(a.name), a.size - F.col(a.name)) * a.distance, 2) for a in self.axes]))

    def unique_lengths(self) -> list[float]:
        parts = [np.minimum(np.arange(a.size), a.size - np.arange(a.size))[: a.size // 2 + 1] * a.distance for a in self.axes]
        square = reduce(lambda u, p: np.unique(np.round(np.add.outer(u, p**2).ravel(), 12)), parts, np.zeros(1))
        return np.sqrt(square).tolist()


@dataclass(frozen=True)
class Modes:
    """Spherical harmonic modes: all l of m = 0, then for each m from 1 pairs (real, imaginary) of l >= m."""

    lmax: int
    mmax: int | None = None

    @property
    def top(self) -> int:
        return self.lmax if self.mmax is None else self.mmax

    @property
    def size(self) -> int:
        return (self.lmax + 1) * (2 * self.top + 1) - self.top * (self.top + 1)

    def table(self, spark: SparkSession) -> DataFrame:
        """(i, l, m, imaginary)."""
        m0 = spark.range(self.lmax + 1).select(F.col("id").alias("i"), F.col("id").alias("l"), F.lit(0).cast("long").alias("m"), F.lit(False).alias("imaginary"))
        start = (self.lmax + 1) + 2 * (F.col("m") - 1) * (self.lmax + 1) - F.col("m") * (F.col("m") - 1)
        rest = spark.range(1, self.top + 1).withColumnRenamed("id", "m").withColumn("l", F.explode(F.sequence(F.col("m"), F.lit(self.lmax).cast("long")))).withColumn("imaginary", F.explode(F.array(F.lit(False), F.lit(True))))
        return m0.unionByName(rest.select((start + 2 * (F.col("l") - F.col("m")) + F.col("imaginary").cast("long")).cast("long").alias("i"), "l", "m", "imaginary"))

    def unique_lengths(self) -> list[float]:
        return list(map(float, range(self.lmax + 1)))


@dataclass(frozen=True)
class Rings:
    """A Gauss-Legendre grid on the sphere."""

    nlat: int
    nlon: int | None = None

    @property
    def width(self) -> int:
        return 2 * self.nlat - 1 if self.nlon is None else self.nlon

    @property
    def size(self) -> int:
        return self.nlat * self.width

    def volumes(self, spark: SparkSession) -> DataFrame:
        """(i, v): the solid angle of each pixel."""
        _, w = np.polynomial.legendre.leggauss(self.nlat)
        table = F.array(*(F.lit(float(x) * 2 * math.pi / self.width) for x in w))
        return spark.range(self.size).select(F.col("id").alias("i"), F.element_at(table, (F.floor(F.col("id") / self.width) + 1).cast("int")).alias("v"))

    @property
    def codomain(self) -> Modes:
        return Modes(self.nlat - 1, self.width // 2)


@dataclass(frozen=True)
class Pixels:
    """A HEALPix grid in ring order."""

    nside: int

    @property
    def size(self) -> int:
        return 12 * self.nside**2

    @property
    def cell_volume(self) -> float:
        return 4 * math.pi / self.size

    @property
    def codomain(self) -> Modes:
        return Modes(2 * self.nside)


@dataclass(frozen=True)
class Degrees:
    """Degrees of freedom with weights."""

    weights: tuple[float, ...]

    @property
    def size(self) -> int:
        return len(self.weights)


@dataclass(frozen=True)
class Product:
    """Several domains as the axes of one field."""

    parts: tuple = ()

    @property
    def size(self) -> int:
        return math.prod(p.size for p in self.parts)


@dataclass(frozen=True)
class Multi:
    """A domain for each key."""

    parts: dict = field(default_factory=dict)

    @property
    def size(self) -> int:
        return sum(p.size for p in self.parts.values())

    @staticmethod
    def union(domains: list[Multi]) -> Multi:
        out: dict = {}
        for d in domains:
            for k, p in d.parts.items():
                if out.setdefault(k, p) != p:
                    raise ValueError(f"two domains for {k}")
        return Multi(out)


def bounds_of(lengths: list[float], logarithmic: bool, nbin: int | None = None) -> list[float]:
    """Bin bounds between the first two and the last two lengths, as many as leave no bin empty or as asked for."""
    if len(lengths) < 3:
        raise ValueError("three lengths at least")
    k = [(lengths[0] + lengths[1]) / 2, *lengths[1:-1], (lengths[-2] + lengths[-1]) / 2]
    f, back = (math.log, math.exp) if logarithmic else (float, float)
    z = [f(x) for x in k]
    most = int((z[-1] - z[0]) / max(b - a for a, b in zip(z, z[1:], strict=False))) + 2
    n = most if nbin is None else nbin
    if not 3 <= n <= most:
        raise ValueError(f"between 3 and {most} bins")
    return [back(z[0] + (z[-1] - z[0]) * i / (n - 2)) for i in range(n - 1)]


@dataclass(frozen=True)
class Power:
    """Bins of the mode lengths of a harmonic grid; without bounds one bin for each length."""

    partner: Regular
    bounds: tuple[float, ...] | None = None

    def limits(self) -> list[float]:
        k = self.partner.unique_lengths()
        return list(self.bounds) if self.bounds is not None else [(a + b) / 2 for a, b in zip(k, k[1:], strict=False)]

    def bin_of(self, k: Column) -> Column:
        """The bin of a length: how many bounds lie below it, by one search in a constant array."""
        table = F.expr("cast(split('" + ",".join(map(repr, self.limits())) + "', ',') as array<double>)")
        return F.size(F.filter(table, lambda b: b < k)).cast("long")

    def table(self, spark: SparkSession) -> DataFrame:
        """(bin, rho, k): modes in each bin and their mean length."""
        out = self.partner.indices(spark).withColumn("_k", self.partner.mode_length())
        return out.groupBy(self.bin_of(F.col("_k")).alias("bin")).agg(F.count("*").alias("rho"), F.avg("_k").alias("k"))


@dataclass(frozen=True)
class LogAxis:
    """Cells of equal width in the logarithm between r_min and r_max."""

    size: int
    r_min: float
    r_max: float

    def __post_init__(self):
        if not 0 < self.r_min < self.r_max:
            raise ValueError("0 < r_min < r_max")

    def coordinate(self, index: Column) -> Column:
        """The radius at a (fractional) index; cells reach half an index to either side."""
        return F.exp(math.log(self.r_min) + (index + 0.5) / self.size * math.log(self.r_max / self.r_min))

    def index(self, r: Column) -> Column:
        return F.ln(r / self.r_min) / math.log(self.r_max / self.r_min) * self.size - 0.5

    def cell(self, r: Column) -> Column:
        """The cell that holds a radius, null outside."""
        k = F.floor(self.index(r) + 0.5).cast("long")
        return F.when((k >= 0) & (k < self.size), k)

    def volume(self, index: Column) -> Column:
        return self.coordinate(index + 0.5) - self.coordinate(index - 0.5)


@dataclass(frozen=True)
class OpenAxis:
    """An axis whose refined version lacks `padding` cells at either side, so that every child has a whole neighbourhood."""

    size: int
    splits: int = 2
    padding: int = 1

    def refined(self) -> int:
        return (self.size - 2 * self.padding) * self.splits

    def children(self, index: Column) -> Column:
        """The refined cells inside a cell; an empty array in the padding."""
        first = (index - self.padding) * self.splits
        inside = (index >= self.padding) & (index < self.size - self.padding)
        return F.when(inside, F.sequence(first, first + self.splits - 1)).otherwise(F.array().cast("array<bigint>"))

    def parent(self, child: Column) -> Column:
        return F.floor(child / self.splits).cast("long") + self.padding

    def neighbourhood(self, index: Column, width: int) -> Column:
        """The window around a cell, shifted at the ends to lie inside."""
        start = F.greatest(F.lit(0).cast("long"), F.least(index - width // 2, F.lit(self.size - width).cast("long")))
        return F.sequence(start, start + width - 1)
