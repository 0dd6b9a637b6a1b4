"""Spherical harmonic transforms between modes and rings of pixels, in two passes: over the degrees of one order, then along one ring.

A task holds one order's coefficients or one ring at a time. Modes are ordered as in `domains.Modes`: pairs of real and imaginary parts,
scaled so that real ones are orthonormal. Both directions carry a factor 1 / sqrt(4 pi). Legendre functions start from logarithms and
lose the parts of rings near the poles that lie below 1e-300.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.domains import Modes, Pixels, Rings

SCALE = 1 / math.sqrt(4 * math.pi)


def rings_of(grid: Rings | Pixels) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cosine of the colatitude, longitude of the first pixel, pixels, first index) of each ring, from the north."""
    if isinstance(grid, Rings):
        z = np.polynomial.legendre.leggauss(grid.nlat)[0][::-1]
        n = np.full(grid.nlat, grid.width)
        return z, np.zeros(grid.nlat), n, np.arange(grid.nlat) * grid.width
    s = grid.nside
    r = np.arange(1, 4 * s)
    quarter = np.minimum(np.minimum(r, 4 * s - r), s)
    cap = 1 - quarter**2 / (3 * s * s)
    belt = (r >= s) & (r <= 3 * s)
    z = np.where(belt, (2 * s - r) * 2 / (3 * s), np.where(r < s, cap, -cap))
    start = np.where(belt, (r - s + 1) % 2, 1) * math.pi / (4 * quarter)
    n = 4 * quarter
    return z, start, n, np.cumsum(n) - n


def legendre(m: int, lmax: int, z: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(l, normalised associated Legendre function of order m at z) for l from m to lmax."""
    with np.errstate(divide="ignore"):
        log = 0.5 * (math.log((2 * m + 1) / (4 * math.pi)) + math.lgamma(2 * m + 1) - 2 * math.lgamma(m + 1) - 2 * m * math.log(2)) + m * 0.5 * (np.log1p(-z * z) if m else 0.0)
    now, before = (-1.0) ** m * np.exp(log) * np.ones_like(z), np.zeros_like(z)
    for l in range(m, lmax + 1):  # noqa: E741
        yield l, now
        a = math.sqrt((4 * (l + 1) ** 2 - 1) / ((l + 1) ** 2 - m * m))
        b = math.sqrt((l * l - m * m) / (4 * l * l - 1)) if l else 0.0
        now, before = a * (z * now - b * before), now


def _batch(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t in kinds.items()], list(kinds))


def synthesis(modes: DataFrame, domain: Modes, grid: Rings | Pixels) -> DataFrame:
    """(i, v) on the grid of modes (i, v); absent modes are zeros."""
    z, start, n, first = rings_of(grid)
    lmax = domain.lmax

    def over_degrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, m in enumerate(b.column(0).to_pylist()):
                l, imaginary, v = (b.column(1 + c)[k].values.to_numpy(zero_copy_only=False) for c in range(3))  # noqa: E741
                a = np.zeros(lmax + 1, complex)
                np.add.at(a, l, v * np.where(imaginary, 1j, 1.0) * (math.sqrt(0.5) if m else 1.0))
                g = sum(a[d] * p for d, p in legendre(m, lmax, z))
                yield _batch({"m": [m] * len(z), "ring": list(range(len(z))), "re": g.real, "im": g.imag}, {"m": pa.int64(), "ring": pa.int64(), "re": pa.float64(), "im": pa.float64()})

    def along_rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rings, values = b.column(0).to_pylist(), []
            for k, r in enumerate(rings):
                m, re, im = (b.column(1 + c)[k].values.to_numpy() for c in range(3))
                h = np.zeros(n[r], complex)
                np.add.at(h, m % n[r], (re + 1j * im) * np.exp(1j * m * start[r]) * np.where(m == 0, 1, 2))
                values.append(np.fft.ifft(h).real * n[r] * SCALE)
            yield _batch({"first": [int(first[r]) for r in rings], "values": values}, {"first": pa.int64(), "values": pa.list_(pa.float64())})

    named = modes.select("i", "v").join(domain.table(modes.sparkSession), "i").groupBy("m").agg(F.collect_list(F.struct("l", "imaginary", F.col("v").cast("double").alias("v"))).alias("c"))
    parts = named.select("m", "c.l", "c.imaginary", "c.v").mapInArrow(over_degrees, "m long, ring long, re double, im double")
    rows = parts.groupBy("ring").agg(F.collect_list(F.struct("m", "re", "im")).alias("c")).select("ring", "c.m", "c.re", "c.im")
    out = rows.mapInArrow(along_rings, "first long, values array<double>")
    return out.select("first", F.posexplode("values").alias("j", "v")).select((F.col("first") + F.col("j")).alias("i"), "v")


def adjoint_synthesis(field: DataFrame, domain: Modes, grid: Rings | Pixels) -> DataFrame:
    """(i, v) of modes: the adjoint of `synthesis` on (i, v) of the grid; absent pixels are zeros."""
    z, start, n, first = rings_of(grid)
    lmax, top = domain.lmax, domain.top

    def along_rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = np.arange(top + 1)
        for b in batches:
            for k, r in enumerate(b.column(0).to_pylist()):
                j, v = (b.column(1 + c)[k].values.to_numpy() for c in range(2))
                g = np.fft.fft(np.bincount(j, v, n[r]))[orders % n[r]] * np.exp(-1j * orders * start[r])
                yield _batch({"ring": [r] * len(g), "m": orders, "re": g.real, "im": g.imag}, {"ring": pa.int64(), "m": pa.int64(), "re": pa.float64(), "im": pa.float64()})

    def over_degrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, m in enumerate(b.column(0).to_pylist()):
                r, re, im = (b.column(1 + c)[k].values.to_numpy() for c in range(3))
                c = [(d, complex((p[r] * (re + 1j * im)).sum()) * SCALE * (math.sqrt(2) if m else 1.0)) for d, p in legendre(m, lmax, z)]
                yield _batch({"m": [m] * len(c), "l": [d for d, _ in c], "re": [x.real for _, x in c], "im": [x.imag for _, x in c]}, {"m": pa.int64(), "l": pa.int64(), "re": pa.float64(), "im": pa.float64()})

    firsts = F.expr("cast(split('" + ",".join(map(str, first.tolist())) + "', ',') as array<bigint>)")
    ring = F.size(F.filter(firsts, lambda f: f <= F.col("i"))).cast("long") - 1
    placed = field.select(F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v")).withColumn("ring", ring)
    rows = placed.select("ring", (F.col("i") - F.element_at(firsts, (F.col("ring") + 1).cast("int"))).alias("j"), "v").groupBy("ring").agg(F.collect_list(F.struct("j", "v")).alias("c"))
    parts = rows.select("ring", "c.j", "c.v").mapInArrow(along_rings, "ring long, m long, re double, im double")
    orders = parts.groupBy("m").agg(F.collect_list(F.struct("ring", "re", "im")).alias("c")).select("m", "c.ring", "c.re", "c.im")
    found = orders.mapInArrow(over_degrees, "m long, l long, re double, im double")
    return found.join(domain.table(field.sparkSession), ["l", "m"]).select("i", F.when(F.col("imaginary"), F.col("im")).otherwise(F.col("re")).alias("v"))
