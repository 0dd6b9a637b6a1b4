"""Operators on fields that compose: linear ones with their adjoints, and differentiable ones with their Jacobians.

A vector is a DataFrame of index columns and a value `v`; a multi-field has a `key` among its index columns. Absent rows are zeros, so
masks and selections drop rows and their adjoints are plain embeddings. Everything is a lazy plan; a chain is one plan that Catalyst
sees whole. Null values count as missing rows in sums; an empty vector is the zero vector.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pointwise as pw
from ..sources.fields import Axis, full

Map = Callable[[DataFrame], DataFrame]


# vectors


def add(x: DataFrame, y: DataFrame, index: tuple[str, ...], a: float = 1.0, b: float = 1.0) -> DataFrame:
    """a x + b y on the union of their indices."""
    terms = [t.select(*index, (F.col("v") * c).alias("v")) for t, c in ((x, a), (y, b))]
    return terms[0].unionByName(terms[1]).groupBy(*index).agg(F.sum("v").alias("v"))


def combine(terms: list[DataFrame], factors: list[float], index: tuple[str, ...]) -> DataFrame:
    """The linear combination of several vectors, in one shuffle."""
    if len(terms) != len(factors) or not terms:
        raise ValueError("as many factors as terms, one at least")
    parts = [t.select(*index, (F.col("v") * float(c)).alias("v")) for t, c in zip(terms, factors, strict=True)]
    return reduce(DataFrame.unionByName, parts).groupBy(*index).agg(F.sum("v").alias("v"))


def multiply(x: DataFrame, y: DataFrame, index: tuple[str, ...]) -> DataFrame:
    return x.select(*index, "v").join(y.select(*index, F.col("v").alias("_w")), list(index)).select(*index, (F.col("v") * F.col("_w")).alias("v"))


def dot(x: DataFrame, y: DataFrame, index: tuple[str, ...]) -> float:
    return multiply(x, y, index).agg(F.coalesce(F.sum("v"), F.lit(0.0))).first()[0]


def norm(x: DataFrame, order: float = 2) -> float:
    v = F.abs(F.col("v"))
    if order == float("inf"):
        return x.agg(F.coalesce(F.max(v), F.lit(0.0))).first()[0]
    return x.agg(F.coalesce(F.sum(F.pow(v, F.lit(float(order)))), F.lit(0.0))).first()[0] ** (1 / order)


# linear operators


@dataclass(frozen=True)
class Linear:
    """A linear operator by its application, its adjoint's and, where known, its inverse's and that one's adjoint."""

    domain: tuple[str, ...]
    target: tuple[str, ...]
    times: Map
    back: Map
    solve: Map | None = None
    solve_back: Map | None = None

    def __call__(self, x: DataFrame) -> DataFrame:
        return self.times(x).select(*self.target, "v")

    @property
    def adjoint(self) -> Linear:
        return Linear(self.target, self.domain, self.back, self.times, self.solve_back, self.solve)

    @property
    def inverse(self) -> Linear:
        if self.solve is None or self.solve_back is None:
            raise ValueError("no inverse is known; `inversion` gives one by conjugate gradients")
        return Linear(self.target, self.domain, self.solve, self.solve_back, self.times, self.back)

    def __matmul__(self, other):
        if isinstance(other, Smooth):
            return smooth(self) @ other
        if other.target != self.domain:
            raise ValueError(f"{other.target} doesn't meet {self.domain}")
        known = None not in (self.solve, other.solve, self.solve_back, other.solve_back)
        return Linear(
            other.domain, self.target, lambda x: self(other(x)), lambda y: other.adjoint(self.adjoint(y)),
            (lambda y: other.inverse(self.inverse(y))) if known else None, (lambda x: self.inverse.adjoint(other.inverse.adjoint(x))) if known else None,
        )

    def __add__(self, other: Linear) -> Linear:
        return _sum(self, other, 1.0)

    def __sub__(self, other: Linear) -> Linear:
        return _sum(self, other, -1.0)

    def __mul__(self, c: float) -> Linear:
        return scaling(c, self.target) @ self

    __rmul__ = __mul__

    def __neg__(self) -> Linear:
        return self * -1.0


def _sum(a: Linear, b: Linear, sign: float) -> Linear:
    if (a.domain, a.target) != (b.domain, b.target):
        raise ValueError("domains differ")
    return Linear(a.domain, a.target, lambda x: add(a(x), b(x), a.target, 1.0, sign), lambda y: add(a.adjoint(y), b.adjoint(y), a.domain, 1.0, sign))


def scaling(c: float, index: tuple[str, ...]) -> Linear:
    def by(f: float) -> Map:
        return lambda x: x.select(*index, (F.col("v") * f).alias("v"))

    return Linear(index, index, by(c), by(c), by(1 / c) if c else None, by(1 / c) if c else None)


def null(domain: tuple[str, ...], target: tuple[str, ...]) -> Linear:
    """Everything becomes the zero vector."""

    def zero(index: tuple[str, ...]) -> Map:
        return lambda x: x.limit(0).select(*(F.lit(None).cast(x.schema[c].dataType if c in x.columns else "long").alias(c) for c in index), F.lit(0.0).alias("v"))

    return Linear(domain, target, zero(target), zero(domain))


def diagonal(values: DataFrame, index: tuple[str, ...]) -> Linear:
    """Multiplication by the values at equal indices."""

    def over(x: DataFrame) -> DataFrame:
        return multiply(x, values.withColumn("v", 1 / F.col("v")), index)

    return Linear(index, index, lambda x: multiply(x, values, index), lambda x: multiply(x, values, index), over, over)


def sandwich(bun: Linear, cheese: Linear | None = None) -> Linear:
    """bun adjoint, cheese, bun."""
    return bun.adjoint @ cheese @ bun if cheese is not None else bun.adjoint @ bun


def local(index: tuple[str, ...], times: Callable[[Column], Column], back: Callable[[Column], Column] | None = None) -> Linear:
    """A linear expression of the value and its index columns; its own adjoint unless one is given."""
    return Linear(index, index, lambda x: x.withColumn("v", times(F.col("v"))), lambda x: x.withColumn("v", (back or times)(F.col("v"))))


def masking(index: tuple[str, ...], flagged: Column) -> Linear:
    """Drops flagged indices; the adjoint leaves zeros there."""
    return Linear(index, index, lambda x: x.where(~flagged), lambda y: y.where(~flagged))


def rename(domain: tuple[str, ...], target: tuple[str, ...], to: dict[str, Column], back: dict[str, Column], inside: Column | None = None) -> Linear:
    """An injective change of index: `to` gives the target's columns, `back` the domain's; only rows `inside` take part."""

    def moved(x: DataFrame, columns: dict[str, Column], index: tuple[str, ...]) -> DataFrame:
        return x.select(*(columns[c].alias(c) for c in index), "v")

    def times(x: DataFrame) -> DataFrame:
        return moved(x if inside is None else x.where(inside), to, target)

    def undo(y: DataFrame) -> DataFrame:
        out = moved(y, back, domain)
        return out if inside is None else out.where(inside)

    return Linear(domain, target, times, undo, undo if inside is None else None, times if inside is None else None)


def window(index: tuple[str, ...], ranges: dict[str, tuple[int, int]]) -> Linear:
    """Cells start to stop of several axes, renumbered from 0; the adjoint pads with zeros."""
    inside = reduce(lambda u, w: u & w, [(F.col(a) >= lo) & (F.col(a) < hi) for a, (lo, hi) in ranges.items()])
    to = {c: F.col(c) - ranges[c][0] if c in ranges else F.col(c) for c in index}
    back = {c: F.col(c) + ranges[c][0] if c in ranges else F.col(c) for c in index}
    return rename(index, index, to, back, inside)


def padding(index: tuple[str, ...], axes: dict[str, tuple[int, int]], central: bool = False) -> Linear:
    """Axes from an old to a new size, zeros at the end or in the middle. Zeros are absent rows."""

    def to(c: str) -> Column:
        old, new = axes[c]
        return F.when(F.col(c) >= (old + 1) // 2, F.col(c) + (new - old)).otherwise(F.col(c)) if central else F.col(c)

    def back(c: str) -> Column:
        old, new = axes[c]
        return F.when(F.col(c) >= (old + 1) // 2, F.col(c) - (new - old)).otherwise(F.col(c)) if central else F.col(c)

    op = rename(index, index, {c: to(c).cast("long") if c in axes else F.col(c) for c in index}, {c: back(c).cast("long") if c in axes else F.col(c) for c in index})
    held = reduce(lambda u, w: u & w, [(F.col(c) < (old + 1) // 2) | (F.col(c) >= (old + 1) // 2 + new - old) if central else F.col(c) < old for c, (old, new) in axes.items()])
    return Linear(index, index, op.times, lambda y: op.back(y.where(held)))


def shift(index: tuple[str, ...], axes: tuple[Axis, ...]) -> Linear:
    """The zero mode of each axis moves to its middle."""
    to = {a.name: F.pmod(F.col(a.name) + a.size // 2, F.lit(a.size)) for a in axes}
    back = {a.name: F.pmod(F.col(a.name) - a.size // 2, F.lit(a.size)) for a in axes}
    return rename(index, index, {c: to.get(c, F.col(c)) for c in index}, {c: back.get(c, F.col(c)) for c in index})


def reshape(old: tuple[Axis, ...], new: tuple[Axis, ...]) -> Linear:
    """Row-major change of shape."""

    def flat(axes: tuple[Axis, ...]) -> Column:
        return reduce(lambda acc, a: acc * a.size + F.col(a.name), axes[1:], F.col(axes[0].name))

    def unflat(at: Column, axes: tuple[Axis, ...]) -> dict[str, Column]:
        out, rest = {}, 1
        for a in reversed(axes):
            out[a.name] = F.pmod(F.floor(at / rest), F.lit(a.size)).cast("long")
            rest *= a.size
        return out

    sizes = [reduce(lambda n, a: n * a.size, axes, 1) for axes in (old, new)]
    if sizes[0] != sizes[1]:
        raise ValueError("sizes differ")
    names = tuple(a.name for a in old), tuple(a.name for a in new)
    return rename(*names, unflat(flat(old), new), unflat(flat(new), old))


def squeeze(axes: tuple[Axis, ...]) -> Linear:
    """Without the axes of one cell."""
    kept = tuple(a.name for a in axes if a.size != 1)
    return rename(tuple(a.name for a in axes), kept, {c: F.col(c) for c in kept}, {a.name: F.col(a.name) if a.name in kept else F.lit(0).cast("long") for a in axes})


def pick(index: tuple[str, ...], axis: str, places: DataFrame) -> Linear:
    """Rows at the places (axis, p), p their number in the result; a place that occurs twice is read twice and added in the adjoint."""
    target = tuple("p" if c == axis else c for c in index)
    return Linear(
        index, target, lambda x: x.join(places, axis).select(*target, "v"),
        lambda y: y.join(places, "p").groupBy(*index).agg(F.sum("v").alias("v")),
    )


def insert_at(index: tuple[str, ...], at: dict[str, int]) -> Linear:
    """A field without some axes, put at a fixed place of them; with all axes given, a single value."""
    domain = tuple(c for c in index if c not in at)
    inside = reduce(lambda u, w: u & w, [F.col(c) == k for c, k in at.items()])
    to = {c: F.lit(at[c]).cast("long") if c in at else F.col(c) for c in index}
    return Linear(domain, index, lambda x: x.select(*(to[c].alias(c) for c in index), "v"), lambda y: y.where(inside).select(*domain, "v"))


def keyed(name: str, index: tuple[str, ...]) -> Linear:
    """A field as the part `name` of a multi-field; the adjoint takes it out."""
    return Linear(index, ("key", *index), lambda x: x.select(F.lit(name).alias("key"), *index, "v"), lambda y: y.where(F.col("key") == name).select(*index, "v"))


def unkeyed(name: str, index: tuple[str, ...]) -> Linear:
    return keyed(name, index).adjoint


def prepend(prefix: str, index: tuple[str, ...]) -> Linear:
    """Keys with a prefix."""
    n = len(prefix)
    rest = {c: F.col(c) for c in index}
    return rename(index, index, rest | {"key": F.concat(F.lit(prefix), F.col("key"))}, rest | {"key": F.substring("key", n + 1, 1 << 30)})


def extract_keys(keys: list[str], index: tuple[str, ...]) -> Linear:
    """The parts of a multi-field with these keys."""
    return masking(index, ~F.col("key").isin(keys))


def split(index: tuple[str, ...], parts: dict[str, Column]) -> Linear:
    """One part of a multi-field for each condition; rows may be in several parts, which add in the adjoint."""

    def times(x: DataFrame) -> DataFrame:
        keys = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in parts.items())))
        return x.select(F.explode(keys).alias("key"), *index, "v")

    def back(y: DataFrame) -> DataFrame:
        held = reduce(lambda u, w: u | w, [(F.col("key") == k) & c for k, c in parts.items()])
        return y.where(held).groupBy(*index).agg(F.sum("v").alias("v"))

    return Linear(index, ("key", *index), times, back)


def block_diagonal(blocks: dict[str, Linear]) -> Linear:
    """An operator for each key; keys without one go."""
    ops = list(blocks.items())
    domain, target = ops[0][1].domain, ops[0][1].target

    def run(x: DataFrame, take: Callable[[Linear], Linear]) -> DataFrame:
        return reduce(DataFrame.unionByName, [keyed(k, take(op).target)(take(op)(unkeyed(k, take(op).domain)(x))) for k, op in ops])

    return Linear(("key", *domain), ("key", *target), lambda x: run(x, lambda op: op), lambda y: run(y, lambda op: op.adjoint))


def contraction(axes: tuple[Axis, ...], names: list[str], power: int = 0) -> Linear:
    """Sum over some axes with a power of their cell volume; the adjoint spreads a value over them."""
    index, kept = tuple(a.name for a in axes), tuple(a.name for a in axes if a.name not in names)
    weight = reduce(lambda w, a: w * a.distance if a.name in names else w, axes, 1.0) ** power
    gone = tuple(a for a in axes if a.name in names)

    def spread(y: DataFrame) -> DataFrame:
        out = y
        for a in gone:
            out = out.withColumn(a.name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(a.size - 1).cast("long"))))
        return out.select(*index, (F.col("v") * weight).alias("v"))

    return Linear(index, kept, lambda x: x.groupBy(*kept).agg((F.sum("v") * weight).alias("v")), spread)


def weighting(axes: tuple[Axis, ...], power: int = 1, names: list[str] | None = None) -> Linear:
    """Multiplication by a power of the cell volume."""
    w = reduce(lambda acc, a: acc * a.distance if names is None or a.name in names else acc, axes, 1.0) ** power
    return scaling(w, tuple(a.name for a in axes))


def outer(values: DataFrame, own: tuple[str, ...], index: tuple[str, ...]) -> Linear:
    """x becomes values times x on the product of both domains. `values` is joined by a constant key, so neither side is collected."""
    one = values.select(*own, F.col("v").alias("_w"))

    def times(x: DataFrame) -> DataFrame:
        return one.join(x, F.lit(True)).select(*own, *index, (F.col("v") * F.col("_w")).alias("v"))

    return Linear(index, (*own, *index), times, lambda y: y.join(one, list(own)).groupBy(*index).agg(F.sum(F.col("v") * F.col("_w")).alias("v")))


def matrix(values: DataFrame, row: str, column: str, domain: tuple[str, ...]) -> Linear:
    """The matrix product along one axis, from rows (row, column, v); `column` is the axis of the domain, `row` that of the target."""
    target = tuple(row if c == column else c for c in domain)
    m = values.select(row, column, F.col("v").alias("_w"))
    return Linear(
        domain, target, lambda x: x.join(m, column).groupBy(*target).agg(F.sum(F.col("v") * F.col("_w")).alias("v")),
        lambda y: y.join(m, row).groupBy(*domain).agg(F.sum(F.col("v") * F.col("_w")).alias("v")),
    )


def distributor(dofs: DataFrame, dof: str, index: tuple[str, ...]) -> Linear:
    """A value for each index by its degree of freedom, from rows (index, dof); the adjoint sums over a degree's indices."""
    return Linear((dof,), index, lambda x: dofs.join(x, dof).select(*index, "v"), lambda y: y.join(dofs, list(index)).groupBy(dof).agg(F.sum("v").alias("v")))


def toeplitz(c: DataFrame, axis: Axis, index: tuple[str, ...]) -> Linear:
    """The symmetric Toeplitz matrix with first column c (lag, v) along an axis. Lags that are zero are absent rows and cost nothing."""
    one = c.select(F.col("lag"), F.col("v").alias("_w")).where("_w <> 0")

    def times(x: DataFrame) -> DataFrame:
        both = F.when(F.col("lag") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.array(F.col("lag"), -F.col("lag")))
        moved = x.join(one, F.lit(True)).withColumn("_l", F.explode(both)).withColumn(axis.name, F.col(axis.name) + F.col("_l"))
        return moved.where((F.col(axis.name) >= 0) & (F.col(axis.name) < axis.size)).groupBy(*index).agg(F.sum(F.col("v") * F.col("_w")).alias("v"))

    return Linear(index, index, times, times)


def lower_triangle(size: int) -> Linear:
    """A packed lower triangle (i) as a matrix (r, c), row by row."""
    r = F.floor((F.sqrt(8.0 * F.col("i") + 1) - 1) / 2).cast("long")
    inside = F.col("c") <= F.col("r")
    return Linear(
        ("i",), ("r", "c"), lambda x: x.select(r.alias("r"), (F.col("i") - r * (r + 1) / 2).cast("long").alias("c"), "v"),
        lambda y: y.where(inside).select((F.col("r") * (F.col("r") + 1) / 2 + F.col("c")).cast("long").alias("i"), "v"),
    )


def diagonal_part() -> Linear:
    """The diagonal of a matrix (r, c) as a vector (i)."""
    return Linear(("r", "c"), ("i",), lambda x: x.where("r = c").select(F.col("r").alias("i"), "v"), lambda y: y.select(F.col("i").alias("r"), F.col("i").alias("c"), "v"))


class Counting:
    """How often an operator and its adjoint were put into a plan."""

    def __init__(self, op: Linear):
        self.times = self.back = 0

        def count(name: str, f: Map) -> Map:
            def run(x: DataFrame) -> DataFrame:
                setattr(self, name, getattr(self, name) + 1)
                return f(x)

            return run

        self.op = Linear(op.domain, op.target, count("times", op.times), count("back", op.back))


# differentiable operators


@dataclass(frozen=True)
class Smooth:
    """A differentiable operator by its value and its Jacobian at a point."""

    domain: tuple[str, ...]
    target: tuple[str, ...]
    value: Map
    jacobian: Callable[[DataFrame], Linear]

    def __call__(self, x: DataFrame) -> DataFrame:
        return self.value(x).select(*self.target, "v")

    def __matmul__(self, other: Smooth | Linear) -> Smooth:
        g = smooth(other)
        return Smooth(g.domain, self.target, lambda x: self(g(x)), lambda x: self.jacobian(g(x)) @ g.jacobian(x))

    def __add__(self, other: Smooth | Linear) -> Smooth:
        g = smooth(other)
        return Smooth(self.domain, self.target, lambda x: add(self(x), g(x), self.target), lambda x: self.jacobian(x) + g.jacobian(x))

    def __mul__(self, other: Smooth | Linear) -> Smooth:
        g = smooth(other)
        return Smooth(
            self.domain, self.target, lambda x: multiply(self(x), g(x), self.target),
            lambda x: diagonal(g(x), self.target) @ self.jacobian(x) + diagonal(self(x), self.target) @ g.jacobian(x),
        )


def smooth(op: Smooth | Linear) -> Smooth:
    return op if isinstance(op, Smooth) else Smooth(op.domain, op.target, op.times, lambda x: op)


def pointwise(name: str, index: tuple[str, ...], *args: float) -> Smooth:
    """A function of the table of point-wise functions with its derivative."""
    return Smooth(
        index, index, lambda x: x.withColumn("v", pw.ptw(name, F.col("v"), *args)),
        lambda x: diagonal(x.withColumn("v", pw.ptw_derivative(name, F.col("v"), *args)), index),
    )


def expression(index: tuple[str, ...], f: Callable[[Column], Column], derivative: Callable[[Column], Column]) -> Smooth:
    """Any column expression of the value with its derivative."""
    return Smooth(index, index, lambda x: x.withColumn("v", f(F.col("v"))), lambda x: diagonal(x.withColumn("v", derivative(F.col("v"))), index))


def adder(offset: DataFrame, index: tuple[str, ...], negative: bool = False) -> Smooth:
    """x plus or minus a constant."""
    return Smooth(index, index, lambda x: add(x, offset, index, 1.0, -1.0 if negative else 1.0), lambda x: scaling(1.0, index))


def constant(output: DataFrame, domain: tuple[str, ...], target: tuple[str, ...]) -> Smooth:
    return Smooth(domain, target, lambda x: output, lambda x: null(domain, target))


@dataclass(frozen=True)
class Linearization:
    """A value with the Jacobian that led to it and, for energies, a metric."""

    value: DataFrame
    jacobian: Linear
    metric: Linear | None = None

    @staticmethod
    def variable(x: DataFrame, index: tuple[str, ...]) -> Linearization:
        return Linearization(x, scaling(1.0, index))

    def then(self, op: Smooth | Linear) -> Linearization:
        f = smooth(op)
        return Linearization(f(self.value), f.jacobian(self.value) @ self.jacobian)


# checks


def check_linear(op: Linear, x: DataFrame, y: DataFrame, rtol: float = 1e-9) -> None:
    """Raises unless y (A x) equals (A' y) x and, where an inverse is known, A' s inverse undoes it."""
    one, two = dot(y, op(x), op.target), dot(op.adjoint(y), x, op.domain)
    if abs(one - two) > rtol * max(abs(one), abs(two), 1e-30):
        raise AssertionError(f"adjoint differs: {one} and {two}")
    if op.solve is not None:
        again = op.inverse(op(x))
        if norm(add(again, x, op.domain, 1.0, -1.0)) > rtol * max(norm(x), 1e-30):
            raise AssertionError("the inverse doesn't undo the operator")


def check_smooth(op: Smooth, x: DataFrame, direction: DataFrame, step: float = 1e-5, rtol: float = 1e-4) -> None:
    """Raises unless the Jacobian agrees with central differences."""
    up, down = (op(add(x, direction, op.domain, 1.0, s * step)) for s in (1, -1))
    want, got = add(up, down, op.target, 0.5 / step, -0.5 / step), op.jacobian(x)(direction)
    if norm(add(want, got, op.target, 1.0, -1.0)) > rtol * max(norm(want), 1e-12):
        raise AssertionError("the Jacobian differs from differences")


def assert_close(x: DataFrame, y: DataFrame, index: tuple[str, ...], atol: float = 0.0, rtol: float = 1e-7) -> None:
    """Raises unless all values agree; absent rows are zeros."""
    both = x.select(*index, F.col("v").alias("a")).join(y.select(*index, F.col("v").alias("b")), list(index), "full").fillna(0.0, ["a", "b"])
    wrong = both.where(~(F.abs(F.col("a") - F.col("b")) <= atol + rtol * F.abs(F.col("b")))).limit(3).collect()
    if wrong:
        raise AssertionError(f"values differ: {wrong}")


def zeros(spark, axes: tuple[Axis, ...]) -> DataFrame:
    return full(spark, axes, 0.0).df
