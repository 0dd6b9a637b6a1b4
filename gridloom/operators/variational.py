"""Variational inference by samples of the metric's inverse (linear, and moved along the likelihood's coordinates), its loop,
an evidence bound, and Hamiltonian Monte Carlo. All vectors are tables; draws come from hashes and survive recomputation."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .algebra import Linear, add, combine, dot, norm
from .likelihoods import Energy, averaged, hamiltonian, white
from .lineage import cut, forget
from .minimisers import Controller, Result, conjugate_gradient, minimise


def draw_linear_residual(lh: Energy, x: DataFrame, key: tuple, iterations: int = 50, tolerance: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """(r, b): b has the posterior metric as covariance, and r, the solution of metric r = b, its inverse."""
    h = hamiltonian(lh)
    b = cut(h.draw(x, key).select(*lh.index, "v"))
    return cut(conjugate_gradient(h.metric(x), b, iterations=iterations, tolerance=tolerance).x), b


def nonlinear_residual(lh: Energy, x: DataFrame, r: DataFrame, b: DataFrame, controller: Controller | None = None) -> DataFrame:
    """The linear residual moved so that y - x + J(x)' (t(y) - t(x)) = b, with t the coordinate in which the likelihood's metric is one."""
    index = lh.index
    here, roots = lh.transform(x), lh.root(x)

    def miss(y: DataFrame) -> DataFrame:
        parts = [root.adjoint(add(t, s, at, 1.0, -1.0)) for root, (t, at), (s, _) in zip(roots, lh.transform(y), here, strict=True)]
        return combine([y, x, b, *parts], [1.0, -1.0, -1.0, *[1.0] * len(parts)], index)

    def gradient(y: DataFrame) -> DataFrame:
        m = cut(miss(y))
        parts = [now.adjoint(root(m)) for root, now in zip(roots, lh.root(y), strict=True)]
        return combine([m, *parts], [1.0] * (1 + len(parts)), index)

    def metric(y: DataFrame) -> Linear:
        now = lh.root(y)

        def apply(v: DataFrame) -> DataFrame:
            u = combine([v, *(root.adjoint(n(v)) for root, n in zip(roots, now, strict=True))], [1.0] * (1 + len(now)), index)
            return combine([u, *(n.adjoint(root(u)) for root, n in zip(roots, now, strict=True))], [1.0] * (1 + len(now)), index)

        return Linear(index, index, apply, apply)

    def value(y: DataFrame) -> float:
        return 0.5 * norm(miss(y)) ** 2

    energy = Energy(index, value, gradient, metric, lambda y, key: white(y, index, key), lambda y: [(y, index)], lambda y: [])
    found = minimise(energy, add(x, r, index), "newton_cg", controller or Controller(limit=10, gradient=1e-6))
    return cut(add(found.x, x, index, 1.0, -1.0))


@dataclass
class State:
    x: DataFrame
    residuals: list[DataFrame]
    value: float
    rounds: int

    def samples(self, index: tuple[str, ...]) -> list[DataFrame]:
        return [add(self.x, r, index) for r in self.residuals]


def draw_residuals(lh: Energy, x: DataFrame, n: int, seed: int, mirror: bool = True, nonlinear: bool = False) -> list[DataFrame]:
    out = []
    for k in range(n):
        r, b = draw_linear_residual(lh, x, (seed, k))
        for sign in (1.0, -1.0) if mirror else (1.0,):
            own, aim = (t if sign > 0 else t.withColumn("v", -F.col("v")) for t in (r, b))
            out.append(nonlinear_residual(lh, x, own, aim) if nonlinear else own)
    return out


def optimise_kl(lh: Energy, x: DataFrame, rounds: int, samples: int | Callable[[int], int], method: str = "newton_cg", controller: Callable[[int], Controller] | None = None, seed: int = 0, nonlinear: bool | Callable[[int], bool] = False, inspect: Callable[[State], None] | None = None, folder: str | None = None) -> State:
    """Rounds of drawing residuals at the mean and of minimising the mean Hamiltonian over them.

    With `folder`, each round's mean is written there as round-<k>, and a later call goes on after the last one.
    """
    h, spark, first = hamiltonian(lh), x.sparkSession, 0
    if folder:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        while fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/round-{first}/_SUCCESS")):
            first += 1
        if first:
            x = spark.read.parquet(f"{folder}/round-{first - 1}")
    state = State(cut(x.select(*lh.index, "v")), [], math.nan, first)
    for k in range(first, rounds):
        n = samples(k) if callable(samples) else samples
        old = state.residuals
        state.residuals = draw_residuals(lh, state.x, n, seed + k, nonlinear=nonlinear(k) if callable(nonlinear) else nonlinear)
        forget(*old)
        kl = averaged(h, state.residuals) if state.residuals else h
        got: Result = minimise(kl, state.x, method, controller(k) if controller else Controller(limit=10, gradient=1e-4))
        state.x, state.value, state.rounds = got.x, got.value, k + 1
        if folder:
            state.x.write.mode("overwrite").parquet(f"{folder}/round-{k}")
        if inspect:
            inspect(state)
    return state


# evidence


def lanczos(op: Linear, v: DataFrame, order: int) -> np.ndarray:
    """The tridiagonal matrix of `order` Lanczos steps from v, orthogonalised again against all vectors before."""
    index = op.domain
    basis = [cut(v.withColumn("v", F.col("v") / norm(v)))]
    a, b = [], []
    for k in range(order):
        w = cut(op(basis[-1]))
        a.append(dot(basis[-1], w, index))
        products = [dot(u, w, index) for u in basis]
        rest = cut(combine([w, *basis], [1.0, *(-p for p in products)], index))
        again = [dot(u, rest, index) for u in basis]
        rest = cut(combine([rest, *basis], [1.0, *(-p for p in again)], index))
        size = norm(rest)
        if k == order - 1 or size < 1e-10 * max(map(abs, a)):
            break
        b.append(size)
        basis.append(cut(rest.withColumn("v", F.col("v") / size)))
    forget(*basis)
    return np.diag(a) + np.diag(b, 1) + np.diag(b, -1)


def operator_spectrum(op: Linear, v: DataFrame, order: int) -> np.ndarray:
    """Approximate eigenvalues, the outer ones first to settle; all of them once `order` is the number of dimensions."""
    return np.linalg.eigvalsh(lanczos(op, v, order))[::-1]


def logdet(op: Linear, like: DataFrame, order: int, probes: int, seed: int = 0) -> float:
    """Logarithm of the determinant of a positive operator by stochastic Lanczos quadrature with random signs."""
    n, total = like.count(), 0.0
    for k in range(probes):
        signs = cut(like.select(*op.domain, F.when(F.xxhash64(F.lit(seed), F.lit(k), *op.domain) % 2 == 0, 1.0).otherwise(-1.0).alias("v")))
        t = lanczos(op, signs, order)
        w, u = np.linalg.eigh(t)
        total += n * float((u[0] ** 2 * np.log(np.maximum(w, 1e-300))).sum()) / probes
    return total


def probe_diagonal(op: Linear, like: DataFrame, probes: int, seed: int = 0) -> DataFrame:
    """The diagonal of an operator by random signs."""
    index, parts = op.domain, []
    for k in range(probes):
        signs = like.select(*index, F.when(F.xxhash64(F.lit(seed), F.lit(k), *index) % 2 == 0, 1.0).otherwise(-1.0).alias("v"))
        parts.append(op(signs).join(signs.select(*index, F.col("v").alias("_s")), list(index)).select(*index, (F.col("v") * F.col("_s")).alias("v")))
    return combine(parts, [1 / probes] * probes, index)


def evidence_lower_bound(lh: Energy, state: State, order: int, probes: int = 4) -> float:
    """-<H> + (n - logdet of the metric at the mean) / 2, up to the likelihood's constants."""
    h = hamiltonian(lh)
    values = [h.value(y) for y in state.samples(lh.index)] or [h.value(state.x)]
    return -sum(values) / len(values) + 0.5 * (state.x.count() - logdet(h.metric(state.x), state.x, order, probes))


# Monte Carlo


def leapfrog(energy: Energy, x: DataFrame, p: DataFrame, step: float, steps: int) -> tuple[DataFrame, DataFrame]:
    index = energy.index
    p = add(p, energy.gradient(x), index, 1.0, -step / 2)
    for k in range(steps):
        x = cut(add(x, p, index, 1.0, step))
        p = cut(add(p, energy.gradient(x), index, 1.0, -step if k < steps - 1 else -step / 2))
    return x, p


def hmc(energy: Energy, x: DataFrame, samples: int, step: float, steps: int, seed: int = 0) -> tuple[list[DataFrame], float]:
    """A chain of samples of exp(-energy), and the share of proposals that were accepted."""
    index, out, accepted = energy.index, [], 0
    x = cut(x.select(*index, "v"))
    value = energy.value(x)
    chance = np.random.default_rng(seed)
    for k in range(samples):
        p = cut(white(x, index, (seed, k)))
        y, q = leapfrog(energy, x, p, step, steps)
        new = energy.value(y)
        if math.log(chance.random()) < value + 0.5 * norm(p) ** 2 - new - 0.5 * norm(q) ** 2:
            x, value, accepted = y, new, accepted + 1
        out.append(x)
    return out, accepted / max(samples, 1)


def nuts(energy: Energy, x: DataFrame, samples: int, step: float, depth: int = 8, seed: int = 0) -> list[DataFrame]:
    """A chain of samples of exp(-energy) by trajectories that double until they turn back, 2^depth steps at most."""
    index, out = energy.index, []
    chance = np.random.default_rng(seed)

    def back(a: tuple, b: tuple) -> bool:
        d = add(b[0], a[0], index, 1.0, -1.0)
        return dot(d, a[1], index) < 0 or dot(d, b[1], index) < 0

    def tree(end: tuple, level: float, sign: int, height: int) -> tuple:
        """(first end, last end, a state drawn from those above the level, how many are, whether to go on)."""
        if not height:
            y, q = leapfrog(energy, *end, sign * step, 1)
            reached = -energy.value(y) - 0.5 * norm(q) ** 2
            return (y, q), (y, q), y, int(level <= reached), level < reached + 1000
        a, b, y, n, go = tree(end, level, sign, height - 1)
        if go:
            c, d, z, more, go = tree(a if sign < 0 else b, level, sign, height - 1)
            a, b = (c, b) if sign < 0 else (a, d)
            if more and chance.random() < more / (n + more):
                y = z
            n, go = n + more, go and not back(a, b)
        return a, b, y, n, go

    x = cut(x.select(*index, "v"))
    for k in range(samples):
        p = cut(white(x, index, (seed, k)))
        level = -energy.value(x) - 0.5 * norm(p) ** 2 - chance.exponential()
        a = b = (x, p)
        n = 1
        for height in range(depth):
            sign = 1 if chance.random() < 0.5 else -1
            c, d, y, more, go = tree(a if sign < 0 else b, level, sign, height)
            a, b = (c, b) if sign < 0 else (a, d)
            if go and more and chance.random() < more / n:
                x = y
            n += more
            if not go or back(a, b):
                break
        out.append(x)
    return out


def mean_field(energy: Energy, x: DataFrame, rounds: int, samples: int = 2, rate: float = 0.1, seed: int = 0) -> DataFrame:
    """(index, v, std): independent normal numbers that come closest to exp(-energy), by adaptive steps along the evidence bound.

    Draws come in mirrored pairs and are new in each round. The rate falls with the root of the rounds.
    """
    index = energy.index
    state = cut(x.select(*index, F.col("v").cast("double").alias("v"), *(F.lit(0.0).alias(c) for c in ("ls", "m1", "m2", "s1", "s2"))))
    for k in range(rounds):
        parts = []
        for s in range(samples):
            z = white(state, index, (seed, k, s))
            for sign in (1.0, -1.0):
                noise = z.select(*index, (F.col("v") * sign).alias("_z"))
                at = state.select(*index, "v", "ls").join(noise, list(index)).select(*index, (F.col("v") + F.exp("ls") * F.col("_z")).alias("v"))
                parts.append(energy.gradient(cut(at)).select(*index, F.col("v").alias("g")).join(noise, list(index)))
        total = parts[0]
        for p in parts[1:]:
            total = total.unionByName(p)
        n = 2 * samples
        slopes = total.groupBy(*index).agg((F.sum("g") / n).alias("g1"), (F.sum(F.col("g") * F.col("_z")) / n).alias("g2"))
        new = state.join(slopes, list(index), "left").withColumn("g1", F.coalesce("g1", F.lit(0.0))).withColumn("g2", F.coalesce("g2", F.lit(0.0)) * F.exp("ls") - 1)
        for a in ("1", "2"):
            new = new.withColumns({"m" + a: 0.9 * F.col("m" + a) + 0.1 * F.col("g" + a), "s" + a: 0.99 * F.col("s" + a) + 0.01 * F.pow("g" + a, F.lit(2.0))})
        c1, c2, size = 1 - 0.9 ** (k + 1), 1 - 0.99 ** (k + 1), rate / math.sqrt(1 + k / 10)
        move = {c: F.col(c) - size * (F.col("m" + a) / c1) / (F.sqrt(F.col("s" + a) / c2) + 1e-8) for c, a in (("v", "1"), ("ls", "2"))}
        before, state = state, cut(new.withColumns(move).select(*index, "v", "ls", "m1", "m2", "s1", "s2"))
        forget(before)
    return state.select(*index, "v", F.exp("ls").alias("std"))
