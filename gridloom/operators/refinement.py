"""Gaussian processes on grids of several levels: each level is drawn from windows of the one before and new excitations.

A refinement takes one shuffle: every cell goes to the parents whose windows hold it, every excitation to its parent. Windows and
children of a parent are few, and matrices are computed where they are needed, once where all axes are linear.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Covariance = Callable[[np.ndarray], np.ndarray]

#: Cells of a base grid, at most, which is drawn by one dense matrix.
BASE = 4096
#: Matrices that a task remembers.
REMEMBERED = 10_000


@dataclass(frozen=True)
class Level:
    """One axis at one level. A padding makes it open: its outer cells aren't refined; without one it is periodic.

    Cell k lies at origin + (k + 1/2) width, or at the exponential of that.
    """

    name: str
    size: int
    width: float = 1.0
    origin: float = 0.0
    padding: int = 0
    splits: int = 2
    log: bool = False

    def refined(self) -> Level:
        if self.size <= 2 * self.padding:
            raise ValueError("nothing is left inside the padding")
        return replace(self, size=(self.size - 2 * self.padding) * self.splits, width=self.width / self.splits, origin=self.origin + self.padding * self.width)

    @property
    def half(self) -> int:
        return self.padding or 1

    def position(self, k: np.ndarray) -> np.ndarray:
        x = self.origin + (np.asarray(k) + 0.5) * self.width
        return np.exp(x) if self.log else x

    def windows(self, k: Column) -> Column:
        """structs (at, slot) of the parents whose windows hold cell k."""
        n = 2 * self.half + 1
        all_of = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda slot: F.struct((k + self.half - slot).alias("at"), slot.alias("slot")))
        if self.padding:
            return F.filter(all_of, lambda w: (w["at"] >= self.padding) & (w["at"] < self.size - self.padding))
        return F.transform(all_of, lambda w: F.struct(F.pmod(w["at"], F.lit(self.size).cast("long")).alias("at"), w["slot"].alias("slot")))

    def parent(self, child: Column) -> Column:
        return F.floor(child / self.splits).cast("long") + self.padding


def matern(deviation: float, length: float, smoothness: float = 1.5) -> Covariance:
    """The Matern covariance of smoothness 1/2, 3/2 or 5/2 by distance."""
    if smoothness not in (0.5, 1.5, 2.5):
        raise ValueError("smoothness is 0.5, 1.5 or 2.5")

    def at(r: np.ndarray) -> np.ndarray:
        x = math.sqrt(2 * smoothness) * np.asarray(r, float) / length
        return deviation**2 * {0.5: 1.0, 1.5: 1 + x, 2.5: 1 + x + x * x / 3}[smoothness] * np.exp(-x)

    return at


def root(a: np.ndarray) -> np.ndarray:
    """The symmetric root of a matrix; directions below zero by rounding count as zero."""
    w, v = np.linalg.eigh((a + a.T) / 2)
    return (v * np.sqrt(np.maximum(w, 0))) @ v.T


def matrices(covariance: Covariance, coarse: np.ndarray, fine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights of the coarse cells, root of what is left) of fine points given coarse ones; points are rows."""
    x = np.concatenate([coarse, fine])
    c = covariance(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)))
    n = len(coarse)
    w = np.linalg.solve(c[:n, :n], c[:n, n:]).T
    return w, root(c[n:, n:] - w @ c[:n, n:])


def _points(levels: tuple[Level, ...], ranges: list[np.ndarray]) -> np.ndarray:
    return np.stack([g.ravel() for g in np.meshgrid(*(lv.position(k) for lv, k in zip(levels, ranges, strict=True)), indexing="ij")], -1)


def parent_matrices(levels: tuple[Level, ...], covariance: Covariance, parent: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    windows = [np.arange(p - lv.half, p + lv.half + 1) for lv, p in zip(levels, parent, strict=True)]
    inside = [(p - lv.padding) * lv.splits + np.arange(lv.splits) for lv, p in zip(levels, parent, strict=True)]
    return matrices(covariance, _points(levels, windows), _points(tuple(lv.refined() for lv in levels), inside))


def refine(x: DataFrame, xi: DataFrame, levels: tuple[Level, ...], covariance: Covariance) -> DataFrame:
    """The next level from x (names, v) and its excitations xi (names, v). Absent rows are zeros."""
    names = [lv.name for lv in levels]
    sent = x.select(*names, F.col("v").cast("double").alias("v"), F.lit(0).cast("long").alias("_slot"))
    for lv in levels:
        sent = sent.withColumn("_w", F.explode(lv.windows(F.col(lv.name).cast("long")))).withColumn("_slot", F.col("_slot") * (2 * lv.half + 1) + F.col("_w.slot")).withColumn(lv.name, F.col("_w.at")).drop("_w")
    slot = reduce(lambda s, lv: s * lv.splits + F.pmod(F.col(lv.name), F.lit(lv.splits)), levels, F.lit(0).cast("long"))
    new = xi.select(*names, F.col("v").cast("double").alias("v"), slot.cast("long").alias("_slot")).withColumns({lv.name: lv.parent(F.col(lv.name)) for lv in levels})
    both = sent.select(*names, F.lit(0).alias("part"), "_slot", "v").unionByName(new.select(*names, F.lit(1).alias("part"), "_slot", "v"))
    rows = both.groupBy(*names).agg(F.collect_list(F.struct("part", "_slot", "v")).alias("z")).select(*names, "z.part", "z._slot", "z.v")
    sizes = math.prod(2 * lv.half + 1 for lv in levels), math.prod(lv.splits for lv in levels)
    fixed = [not lv.log for lv in levels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        for b in batches:
            out = []
            for k in range(b.num_rows):
                at = tuple(b.column(i)[k].as_py() for i in range(len(names)))
                # linear axes are alike everywhere
                where = tuple(lv.padding if f else p for lv, p, f in zip(levels, at, fixed, strict=True))
                if where not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[where] = parent_matrices(levels, covariance, where)
                part, slots, v = (b.column(len(names) + i)[k].values.to_numpy() for i in range(3))
                w, left = known[where]
                coarse, fine = (np.bincount(slots[part == j], v[part == j], sizes[j]) for j in (0, 1))
                out.append(w @ coarse + left @ fine)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(out, pa.list_(pa.float64()))], [*names, "_y"])

    done = rows.mapInArrow(run, ", ".join(f"`{n}` long" for n in names) + ", _y array<double>").select(*names, F.posexplode("_y").alias("_p", "v"))
    place, columns = F.col("_p"), {}
    for lv in reversed(levels):
        columns[lv.name] = (F.col(lv.name) - lv.padding) * lv.splits + F.pmod(place, F.lit(lv.splits))
        place = F.floor(place / lv.splits)
    return done.withColumns(columns).select(*names, "v")


def base(xi: DataFrame, levels: tuple[Level, ...], covariance: Covariance) -> DataFrame:
    """The coarsest level, by the root of its whole covariance; it has `BASE` cells at most."""
    shape = tuple(lv.size for lv in levels)
    if math.prod(shape) > BASE:
        raise ValueError(f"a base grid has {BASE} cells at most")
    names, z = [lv.name for lv in levels], np.zeros(shape)
    for r in xi.select(*names, "v").limit(BASE).collect():
        z[tuple(r[n] for n in names)] = r["v"]
    p = _points(levels, [np.arange(n) for n in shape])
    y = root(covariance(np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)))) @ z.ravel()
    rows = [(*map(int, np.unravel_index(i, shape)), float(v)) for i, v in enumerate(y)]
    return xi.sparkSession.createDataFrame(rows, ", ".join(f"`{n}` long" for n in names) + ", v double")


def refined_field(xi: list[DataFrame], levels: tuple[Level, ...], covariance: Covariance, offset: float = 0.0) -> DataFrame:
    """A draw on the finest of len(xi) levels, from the excitations of each."""
    x = base(xi[0], levels, covariance)
    for z in xi[1:]:
        x = refine(x, z, levels, covariance)
        levels = tuple(lv.refined() for lv in levels)
    return x.withColumn("v", offset + F.col("v"))
