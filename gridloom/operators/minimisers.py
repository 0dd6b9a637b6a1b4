"""Minimisation over distributed vectors: only scalars come to the driver, each position is a written table.

`Energy` objects give value, gradient and metric. Controllers decide when to stop from values and gradient norms.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .algebra import Linear, add, norm
from .lineage import cut, forget
from .likelihoods import Energy


@dataclass
class Controller:
    """Stops after `limit` iterations, or once a criterion held `level` times in a row.

    gradient, gradient_max: norms of the gradient; change: difference of values relative to their size; absolute: difference itself;
    deviation: spread of the last `memory` values.
    """

    limit: int = 100
    gradient: float | None = None
    gradient_max: float | None = None
    change: float | None = None
    absolute: float | None = None
    deviation: float | None = None
    memory: int = 10
    level: int = 1
    history: list[float] = field(default_factory=list)
    held: int = 0

    def done(self, value: float, two: float, most: float) -> bool:
        self.history.append(value)
        last = self.history[-2:]
        close = [
            self.gradient is not None and two <= self.gradient, self.gradient_max is not None and most <= self.gradient_max,
            self.change is not None and len(last) == 2 and abs(last[1] - last[0]) <= self.change * max(abs(last[0]), abs(last[1])),
            self.absolute is not None and len(last) == 2 and abs(last[1] - last[0]) <= self.absolute,
            self.deviation is not None and len(self.history) >= self.memory and _spread(self.history[-self.memory :]) <= self.deviation,
        ]
        self.held = self.held + 1 if any(close) else 0
        return self.held >= self.level or len(self.history) > self.limit


def _spread(values: list[float]) -> float:
    m = sum(values) / len(values)
    return math.sqrt(sum((v - m) ** 2 for v in values) / len(values))


@dataclass
class Result:
    x: DataFrame
    value: float
    iterations: int
    converged: bool


def conjugate_gradient(op: Linear, b: DataFrame, x0: DataFrame | None = None, iterations: int = 50, tolerance: float = 1e-8, absolute: float = 0.0, reset: int = 20, stop_on_negative: bool = False) -> Result:
    """x with A x = b for a symmetric positive operator. One co-partitioned table holds x, r, d and A d; both products are one aggregate.

    stop_on_negative: on a direction of no curvature, end with the present x instead of an error.
    """
    index = op.domain
    r = b if x0 is None else add(b, op(x0), index, 1.0, -1.0)
    start = r.select(*index, F.col("v").alias("r")) if x0 is None else r.select(*index, F.col("v").alias("r")).join(x0.select(*index, F.col("v").alias("x")), list(index), "full")
    state = cut(start.select(*index, F.coalesce("x" if x0 is not None else F.lit(0.0), F.lit(0.0)).alias("x"), F.coalesce("r", F.lit(0.0)).alias("r")).withColumn("d", F.col("r")))
    rr = first = state.agg(F.coalesce(F.sum(F.col("r") * F.col("r")), F.lit(0.0))).first()[0]
    k, good = 0, rr <= absolute * absolute
    while not good and k < iterations:
        k += 1
        q = op(state.select(*index, F.col("d").alias("v"))).select(*index, F.col("v").alias("q"))
        moved = cut(state.join(q, list(index), "left").fillna(0.0, ["q"]))
        dq, dr = moved.agg(F.sum(F.col("d") * F.col("q")), F.sum(F.col("d") * F.col("r"))).first()
        forget(state)
        if not dq or dq <= 0:
            if stop_on_negative:
                state = moved
                break
            raise ValueError("the operator is not positive")
        alpha = dr / dq
        x, r = F.col("x") + alpha * F.col("d"), F.col("r") - alpha * F.col("q")
        new = moved.agg(F.sum(r * r)).first()[0]
        state = cut(moved.select(*index, x.alias("x"), r.alias("r"), (r + (0.0 if reset and k % reset == 0 else new / rr) * F.col("d")).alias("d")))
        forget(moved)
        rr = new
        good = rr <= max(tolerance * tolerance * first, absolute * absolute)
    return Result(state.select(*index, F.col("x").alias("v")), rr, k, good)


def inversion(op: Linear, iterations: int = 50, tolerance: float = 1e-8) -> Linear:
    """The operator with an inverse by conjugate gradients; it must be symmetric and positive."""
    solve = lambda y: conjugate_gradient(op, y, iterations=iterations, tolerance=tolerance).x
    return Linear(op.domain, op.target, op.times, op.back, solve, solve)


def line_search(energy: Energy, x: DataFrame, p: DataFrame, value: float, slope: float, first: float = 1.0, c1: float = 1e-4, c2: float = 0.9, most: int = 20) -> tuple[float, float]:
    """(step, value) that fulfils the strong Wolfe conditions, or the best step seen that lowers the value."""
    lo, hi, step, best = 0.0, math.inf, first, (0.0, value)
    for _ in range(most):
        y = add(x, p, energy.index, 1.0, step)
        now = energy.value(y)
        if now < best[1]:
            best = step, now
        if not math.isfinite(now) or now > value + c1 * step * slope:
            hi = step
        else:
            here = energy.gradient(y).select(*energy.index, "v").join(p.select(*energy.index, F.col("v").alias("_p")), list(energy.index)).agg(F.coalesce(F.sum(F.col("v") * F.col("_p")), F.lit(0.0))).first()[0]
            if abs(here) <= -c2 * slope:
                return step, now
            if here > 0:
                hi = step
            else:
                lo = step
        step = (lo + hi) / 2 if math.isfinite(hi) else 2 * step
    return best


def _dot(x: DataFrame, a: str, b: str) -> float:
    return x.agg(F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0.0))).first()[0]


def descend(energy: Energy, x: DataFrame, direction: Callable, controller: Controller) -> Result:
    """Positions along directions, each with a line search. `direction(x, gradient, state)` returns (p, state)."""
    index, state, k = energy.index, None, 0
    x = cut(x.select(*index, "v"))
    value = energy.value(x)
    while True:
        g = cut(energy.gradient(x).select(*index, "v"))
        if controller.done(value, norm(g), norm(g, math.inf)):
            return Result(x, value, k, controller.held >= controller.level)
        p, state = direction(x, g, state)
        p = cut(p.select(*index, "v"))
        slope = _dot(g.join(p.select(*index, F.col("v").alias("p")), list(index)), "v", "p")
        if slope >= 0:
            p, slope, state = cut(g.withColumn("v", -F.col("v"))), -norm(g) ** 2, None
        step, new = line_search(energy, x, p, value, slope)
        if step == 0:
            return Result(x, value, k, False)
        y = cut(add(x, p, index, 1.0, step))
        forget(p)
        x, value, k = y, new, k + 1


def steepest_descent(energy: Energy, x: DataFrame, controller: Controller) -> Result:
    return descend(energy, x, lambda x, g, s: (g.withColumn("v", -F.col("v")), s), controller)


def relaxed_newton(energy: Energy, x: DataFrame, controller: Controller, iterations: int = 50) -> Result:
    """Directions that solve the whole metric."""
    return newton_cg(energy, x, controller, iterations, 1e-8)


def newton_cg(energy: Energy, x: DataFrame, controller: Controller, iterations: int = 50, accuracy: float | None = None) -> Result:
    """Directions by conjugate gradients on the metric, as accurate as the gradient is small."""

    def direction(x: DataFrame, g: DataFrame, state):
        size = norm(g)
        within = accuracy if accuracy is not None else min(0.5, math.sqrt(size))
        return conjugate_gradient(energy.metric(x), g.withColumn("v", -F.col("v")), iterations=iterations, tolerance=within, stop_on_negative=True).x, state

    return descend(energy, x, direction, controller)


def nonlinear_cg(energy: Energy, x: DataFrame, controller: Controller, rule: str = "polak-ribiere") -> Result:
    index = energy.index

    def direction(x: DataFrame, g: DataFrame, state):
        if state is None:
            p = cut(g.withColumn("v", -F.col("v")))
            return p, (g, p)
        old, last = state
        j = g.select(*index, F.col("v").alias("g")).join(old.select(*index, F.col("v").alias("o")), list(index)).join(last.select(*index, F.col("v").alias("p")), list(index))
        gg, oo, go, gp, op = j.agg(*(F.sum(F.col(a) * F.col(b)) for a, b in (("g", "g"), ("o", "o"), ("g", "o"), ("g", "p"), ("o", "p")))).first()
        beta = {"polak-ribiere": max(0.0, (gg - go) / oo), "fletcher-reeves": gg / oo, "hestenes-stiefel": max(0.0, (gg - go) / ((gp - op) or math.inf)), "5.49": 0.0}[rule]
        p = cut(j.select(*index, (beta * F.col("p") - F.col("g")).alias("v")))
        return p, (g, p)

    return descend(energy, x, direction, controller)


def vl_bfgs(energy: Energy, x: DataFrame, controller: Controller, history: int = 5) -> Result:
    """Limited-memory BFGS in its vector-free form: all products of an iteration are one aggregate over one wide table."""
    index = energy.index

    def direction(x: DataFrame, g: DataFrame, state):
        now = g.select(*index, F.col("v").alias("g")).join(x.select(*index, F.col("v").alias("x")), list(index))
        if state is None:
            wide, names = cut(now), []
        else:
            old, names = state
            n = 1 + max((int(c[1:]) for c in names if c[0] == "s"), default=-1)
            names = [*names, f"s{n}", f"y{n}"][-2 * history :]
            j = now.join(old.withColumnsRenamed({"g": "_g", "x": "_x"}), list(index))
            j = j.withColumn(f"s{n}", F.col("x") - F.col("_x")).withColumn(f"y{n}", F.col("g") - F.col("_g"))
            wide = cut(j.select(*index, "g", "x", *names))
            forget(old)
        basis = [*names, "g"]
        pairs = list(combinations_with_replacement(basis, 2))
        got = wide.agg(*(F.sum(F.col(a) * F.col(b)) for a, b in pairs)).first()
        product = {k: v or 0.0 for (a, b), v in zip(pairs, got, strict=True) for k in ((a, b), (b, a))}
        c = dict.fromkeys(basis, 0.0)
        c["g"] = -1.0
        inner = lambda name: sum(w * product[b, name] for b, w in c.items())
        ids = [n[1:] for n in names if n[0] == "s"]
        ids = [n for n in ids if product["s" + n, "y" + n] > 0]
        alpha = {}
        for n in reversed(ids):
            alpha[n] = inner("s" + n) / product["s" + n, "y" + n]
            c["y" + n] -= alpha[n]
        if ids:
            last = ids[-1]
            scale = product["s" + last, "y" + last] / product["y" + last, "y" + last]
            c = {b: w * scale for b, w in c.items()}
        for n in ids:
            c["s" + n] += alpha[n] - inner("y" + n) / product["s" + n, "y" + n]
        return wide.select(*index, reduce(lambda u, w: u + w, [F.col(b) * w for b, w in c.items()]).alias("v")), (wide, names)

    return descend(energy, x, direction, controller)


#: The two-loop recursion gives the same directions.
l_bfgs = vl_bfgs


def boundary(zz: float, zd: float, dd: float, radius: float) -> tuple[float, float]:
    """The two t with |z + t d| = radius, from the products of z and d."""
    root = math.sqrt(max(0.0, zd * zd - dd * (zz - radius * radius)))
    aux = -zd - math.copysign(root, zd)
    a, b = aux / dd, (zz - radius * radius) / aux if aux else 0.0
    return min(a, b), max(a, b)


def trust_ncg(energy: Energy, x: DataFrame, controller: Controller, radius: float = 1.0, largest: float = 1000.0, eta: float = 0.15, iterations: int = 50) -> Result:
    """Newton steps inside a trust region, by truncated conjugate gradients on the metric."""
    index, k = energy.index, 0
    x = cut(x.select(*index, "v"))
    value = energy.value(x)
    while True:
        g = cut(energy.gradient(x).select(*index, "v"))
        size = norm(g)
        if controller.done(value, size, norm(g, math.inf)):
            return Result(x, value, k, controller.held >= controller.level)
        op, tolerance = energy.metric(x), min(0.5, math.sqrt(size)) * size
        state = cut(g.select(*index, F.lit(0.0).alias("z"), F.col("v").alias("r"), (-F.col("v")).alias("d"), F.lit(0.0).alias("w")))
        rr, hit = size * size, False
        for _ in range(iterations):
            q = op(state.select(*index, F.col("d").alias("v"))).select(*index, F.col("v").alias("q"))
            j = cut(state.join(q, list(index), "left").fillna(0.0, ["q"]))
            dq, zz, zd, dd = j.agg(*(F.sum(F.col(a) * F.col(b)) for a, b in (("d", "q"), ("z", "z"), ("z", "d"), ("d", "d")))).first()
            alpha = rr / dq if dq > 0 else math.inf
            if dq <= 0 or zz + 2 * alpha * zd + alpha * alpha * dd >= radius * radius:
                alpha, hit = boundary(zz, zd, dd, radius)[1], True
            r = F.col("r") + alpha * F.col("q")
            new = j.agg(F.sum(r * r)).first()[0]
            forget(state)
            state = cut(j.select(*index, (F.col("z") + alpha * F.col("d")).alias("z"), r.alias("r"), (new / rr * F.col("d") - r).alias("d"), (F.col("w") + alpha * F.col("q")).alias("w")))
            forget(j)
            rr = new
            if hit or math.sqrt(rr) < tolerance:
                break
        gz, zw = state.join(g, list(index)).agg(F.sum(F.col("v") * F.col("z")), F.sum(F.col("z") * F.col("w"))).first()
        y = cut(add(x, state.select(*index, F.col("z").alias("v")), index))
        now = energy.value(y)
        ratio = (value - now) / -(gz + 0.5 * zw) if gz + 0.5 * zw < 0 and math.isfinite(now) else -1.0
        radius = radius / 4 if ratio < 0.25 else min(2 * radius, largest) if ratio > 0.75 and hit else radius
        if ratio > eta:
            x, value = y, now
        k += 1
        if radius < 1e-12:
            return Result(x, value, k, False)


METHODS = {"steepest_descent": steepest_descent, "relaxed_newton": relaxed_newton, "newton_cg": newton_cg, "nonlinear_cg": nonlinear_cg, "l_bfgs": l_bfgs, "vl_bfgs": vl_bfgs, "trust_ncg": trust_ncg}


def minimise(energy: Energy, x: DataFrame, method: str = "newton_cg", controller: Controller | None = None, **options) -> Result:
    return METHODS[method](energy, x, controller or Controller(gradient=1e-6), **options)
