"""Selection, reshaping, union, reduction, contraction, interpolation and regridding of fields. All DataFrame plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pointwise as pw
from ..sources.fields import Axis, Field, full

# selection and shape


def mask(field: Field, flagged: Column) -> DataFrame:
    """The rows that are not flagged."""
    return field.df.where(~flagged)


def mask_adjoint(masked: DataFrame, field: Field) -> Field:
    """Values back at their indices, zero elsewhere."""
    grid = full(masked.sparkSession, field.axes, 0.0).df.drop("v")
    return field.with_df(grid.join(masked.select(*field.names, field.value), field.names, "left").fillna(0, [field.value]))


def window(field: Field, name: str, start: int, stop: int) -> Field:
    """Cells start to stop of one axis, renumbered from 0."""
    axes = tuple(Axis(a.name, stop - start, a.distance, a.harmonic) if a.name == name else a for a in field.axes)
    return field.with_df(field.df.where((F.col(name) >= start) & (F.col(name) < stop)).withColumn(name, F.col(name) - start), axes)


def centre(field: Field, name: str, size: int) -> Field:
    """The middle `size` cells of an axis."""
    first = (field.axis(name).size - size) // 2
    return window(field, name, first, first + size)


def zero_pad(field: Field, name: str, size: int, central: bool = False) -> Field:
    """The axis extended with zeros at its end, or in its middle, where the highest modes are."""
    old = field.axis(name)
    axes = tuple(Axis(a.name, size, a.distance, a.harmonic) if a.name == name else a for a in field.axes)
    moved = F.when(F.col(name) >= (old.size + 1) // 2, F.col(name) + (size - old.size)).otherwise(F.col(name)) if central else F.col(name)
    return mask_adjoint(field.df.withColumn(name, moved.cast("long")), field.with_df(field.df, axes))


def transpose(field: Field, names: list[str]) -> Field:
    return field.with_df(field.df.select(*names, field.value), tuple(field.axis(n) for n in names))


def flatten(field: Field, name: str = "i") -> Field:
    """All axes as one, row-major."""
    index = reduce(lambda acc, a: acc * a.size + F.col(a.name), field.axes[1:], F.col(field.axes[0].name))
    total = reduce(lambda acc, a: acc * a.size, field.axes, 1)
    return field.with_df(field.df.select(index.cast("long").alias("_flat"), field.value).withColumnRenamed("_flat", name), (Axis(name, total),))


def unite(a: DataFrame, b: DataFrame, index: list[str], value: str = "v") -> DataFrame:
    """Keyed fields joined; where keys overlap values add."""
    return a.unionByName(b).groupBy(*index).agg(F.sum(value).alias(value))


def union(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """Keyed fields joined; of a key in both the last wins."""
    return a.join(b.select(key).distinct(), key, "left_anti").select(*a.columns).unionByName(b)


# reductions


def cell_volume(field: Field, names: list[str]) -> float:
    return reduce(lambda acc, n: acc * field.axis(n).distance, names, 1.0)


def contract(field: Field, names: list[str], power: int = 0) -> Field:
    """Sum over some axes, weighted by a power of their cell volume."""
    kept = [n for n in field.names if n not in names]
    out = field.df.groupBy(*kept).agg((F.sum(field.value) * cell_volume(field, names) ** power).alias(field.value))
    return field.with_df(out, tuple(field.axis(n) for n in kept))


def integrate(field: Field, names: list[str]) -> Field:
    return contract(field, names, 1)


def statistics(field: Field, kept: list[str]) -> DataFrame:
    """Sum, mean, population variance and deviation, norms and logical reductions over the other axes, in one pass."""
    v = F.col(field.value)
    return field.df.groupBy(*kept).agg(
        F.sum(v).alias("total"), F.avg(v).alias("mean"), F.var_pop(v).alias("var"), F.stddev_pop(v).alias("std"), F.sum(F.abs(v)).alias("norm1"),
        F.sqrt(F.sum(v * v)).alias("norm2"), F.max(F.abs(v)).alias("norm_inf"), F.min(v != 0).alias("all_nonzero"), F.max(v != 0).alias("any_nonzero"),
    )


def product(df: DataFrame, kept: list[str], value: str = "v") -> DataFrame:
    """The product over all other indices."""
    return df.groupBy(*kept).agg(F.product(value).alias(value))


def multi_statistics(df: DataFrame, value: str = "v", other: str | None = None) -> DataFrame:
    """Norms, sum and logical reductions over all keys and indices, and the product with another column, in one pass."""
    v = F.col(value)
    return df.agg(
        F.sum(F.abs(v)).alias("norm1"), F.sqrt(F.sum(v * v)).alias("norm2"), F.max(F.abs(v)).alias("norm_inf"), F.sum(v).alias("total"),
        F.min(v != 0).alias("all_nonzero"), F.max(v != 0).alias("any_nonzero"), F.sum(v * F.col(other or value)).alias("vdot"),
    )


def vdot(a: DataFrame, b: DataFrame, index: list[str], kept: tuple[str, ...] = ()) -> DataFrame:
    """Sum of products of equal indices, for each of the kept ones."""
    return a.withColumnRenamed("v", "va").join(b.withColumnRenamed("v", "vb"), index).groupBy(*kept).agg(F.sum(F.col("va") * F.col("vb")).alias("v"))


def sample_stat(df: DataFrame, group: list[str], value: str = "v") -> DataFrame:
    """Mean and sample variance; the variance of one sample is 0."""
    return df.groupBy(*group).agg(F.avg(value).alias("mean"), F.coalesce(F.when(F.count(value) > 1, F.var_samp(value)), F.lit(0.0)).alias("variance"))


def minisanity(resid: DataFrame, key: str = "key", sample: str = "s", value: str = "r") -> DataFrame:
    """Reduced chi square, mean and degrees of freedom by key, averaged over samples; empty and zero residuals don't count.

    The spread is the sample deviation over samples.
    """
    r = F.when(~F.isnan(value) & (F.col(value) != 0), F.col(value))
    one = resid.groupBy(key, sample).agg(F.avg(r * r).alias("chi"), F.avg(r).alias("m"), F.count(r).alias("n"), F.count_if(r.isNull()).alias("ignored"))
    return one.groupBy(key).agg(F.avg("chi").alias("redchi2"), F.stddev_samp("chi").alias("redchi2_std"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("mean_std"), F.sum("n").alias("ndof"), F.sum("ignored").alias("n_ignored"))


def minisanity_all(resid: DataFrame, key: str = "key", sample: str = "s", value: str = "r") -> DataFrame:
    """The same of all residuals, with the population deviation over samples."""
    one = resid.groupBy(key, sample).agg(F.avg(F.col(value) * F.col(value)).alias("chi"), F.avg(value).alias("m"), F.count("*").alias("n"))
    return one.groupBy(key).agg(F.avg("chi").alias("redchi2"), F.stddev_pop("chi").alias("redchi2_std"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("mean_std"), F.sum("n").alias("ndof"))


# products, gathers and stencils


def einsum(a: DataFrame, b: DataFrame, on: list[str], out: list[str]) -> DataFrame:
    """Product over shared indices, summed to the output ones. Values are in v."""
    return a.withColumnRenamed("v", "va").join(b.withColumnRenamed("v", "vb"), on).groupBy(*out).agg(F.sum(F.col("va") * F.col("vb")).alias("v"))


def distribute(values: DataFrame, index: DataFrame, dof: str = "d") -> DataFrame:
    """A value for each row of `index` by its degree of freedom."""
    return index.join(values, dof)


def gather(field: DataFrame, dof: str = "d", value: str = "v") -> DataFrame:
    """The adjoint: sums over the rows of a degree of freedom."""
    return field.groupBy(dof).agg(F.sum(value).alias(value))


def bin_of(k: Column, bounds: list[float]) -> Column:
    """How many bounds lie strictly below k."""
    return reduce(lambda acc, b: acc + F.when(k > b, 1).otherwise(0), bounds, F.lit(0))


def linear_bounds(nbin: int, first: float, last: float) -> list[float]:
    return [first + (last - first) * i / (nbin - 2) for i in range(nbin - 1)]


def log_bounds(nbin: int, first: float, last: float) -> list[float]:
    import math

    return [math.exp(x) for x in linear_bounds(nbin, math.log(first), math.log(last))]


def interpolate(field: Field, points: DataFrame, periodic: bool = True) -> DataFrame:
    """Multilinear interpolation at points (p, x_<axis>...): each point meets the corners of its cell."""
    corners = points
    for a in field.axes:
        x = F.col("x_" + a.name) / a.distance
        low = F.floor(x)
        low = low if periodic else F.greatest(F.lit(0), F.least(low, F.lit(a.size - 2)))
        corner = F.array(F.struct(low.cast("long").alias("c"), (1 - (x - low)).alias("w")), F.struct((low + 1).cast("long").alias("c"), (x - low).alias("w")))
        corners = corners.withColumn("c_" + a.name, F.explode(corner))
    weight = reduce(lambda u, v: u * v, [F.col(f"c_{a.name}.w") for a in field.axes])
    at = corners.select("p", weight.alias("w"), *((F.pmod(F.col(f"c_{a.name}.c"), F.lit(a.size)) if periodic else F.col(f"c_{a.name}.c")).alias(a.name) for a in field.axes))
    return at.join(field.df, field.names).groupBy("p").agg(F.sum(F.col("w") * F.col(field.value)).alias("v"))


def regrid(field: Field, size: int) -> Field:
    """A one-dimensional field on fewer cells over the same length, linear between its cells."""
    a = field.axes[0]
    new = Axis(a.name, size, a.volume / size)
    points = field.df.sparkSession.range(size).select(F.col("id").alias("p"), (F.col("id") * new.distance).alias("x_" + a.name))
    return Field(interpolate(field, points, periodic=False).withColumnRenamed("p", a.name), (new,))


def line_of_sight(field: Field, lines: DataFrame, steps: int, order: int = 1) -> DataFrame:
    """(p, v): integrals along segments (p, a_<axis>, b_<axis>) by the midpoint rule.

    A position x lies at x / distance (size - 1) / size cells. Order 1 is linear between the corners of a cell, order 0 the nearest
    cell; a line with a midpoint outside the grid has NaN.
    """
    t = lines.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    length = F.sqrt(reduce(lambda u, v: u + v, [F.pow(F.col("b_" + a.name) - F.col("a_" + a.name), 2) for a in field.axes]))
    at = {a.name: (F.col("a_" + a.name) + (F.col("m") + 0.5) / steps * (F.col("b_" + a.name) - F.col("a_" + a.name))) * ((a.size - 1) / a.size / a.distance) for a in field.axes}
    inside = reduce(lambda u, v: u & v, [(at[a.name] >= 0) & (at[a.name] <= a.size - 1) for a in field.axes])
    points = t.select("p", "m", (length / steps).alias("w"), inside.alias("inside"), *((at[a.name] * a.distance if order else F.round(at[a.name]) * a.distance).alias("x_" + a.name) for a in field.axes))
    one = points.where("inside").select(F.struct("p", "m", "w").alias("p"), *("x_" + a.name for a in field.axes))
    sums = interpolate(field, one, periodic=False).groupBy("p.p").agg(F.sum(F.col("p.w") * F.col("v")).alias("v"))
    whole = points.groupBy("p").agg(F.min("inside").alias("whole"))
    return whole.join(sums, "p", "left").select("p", F.when(F.col("whole"), F.col("v")).otherwise(float("nan")).alias("v"))


def path_lengths(axes: tuple[Axis, ...], lines: DataFrame, truncation: float = 3.0) -> DataFrame:
    """(p, axes, w): the length of each segment (p, a_<axis>, b_<axis>) in each cell it crosses, exactly.

    Cell k reaches half a distance to either side of k * distance; parts outside the grid have no rows. With a column sigma, the error of
    the inverse of the length, a segment goes on to `truncation` errors beyond its end, and parts count by the chance that it gets there.
    """
    length = F.sqrt(reduce(lambda u, v: u + v, [F.pow(F.col("b_" + a.name) - F.col("a_" + a.name), 2) for a in axes]))
    rows, uncertain = lines.withColumn("_mid", length), "sigma" in lines.columns
    rows = rows.withColumn("_far", 1 / (1 / F.col("_mid") - truncation * F.col("sigma")) if uncertain else F.col("_mid"))
    at = {a.name: F.col("a_" + a.name) / a.distance + 0.5 for a in axes}
    step = {a.name: (F.col("b_" + a.name) - F.col("a_" + a.name)) / a.distance * (F.col("_far") / F.col("_mid")) for a in axes}

    def crossings(a: Axis) -> Column:
        s, d = at[a.name], step[a.name]
        low, high = F.greatest(F.ceil(F.least(s, s + d)), F.lit(0)), F.least(F.floor(F.greatest(s, s + d)), F.lit(a.size))
        some = (d != 0) & (low <= high)
        t = F.transform(F.sequence(F.when(some, low), F.when(some, high)), lambda c: (c - s) / d)
        return F.coalesce(F.filter(t, lambda x: (x > 0) & (x < 1)), F.array().cast("array<double>"))

    cuts = rows.where("_mid > 0").withColumn("_t", F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), *(crossings(a) for a in axes)))))
    parts = cuts.withColumn("_s", F.explode(F.arrays_zip(F.expr("slice(_t, 1, size(_t) - 1)").alias("t0"), F.expr("slice(_t, 2, size(_t) - 1)").alias("t1"))))
    middle = (F.col("_s.t0") + F.col("_s.t1")) / 2
    weight = (F.col("_s.t1") - F.col("_s.t0")) * F.col("_far")
    if uncertain:
        near = 1 / (1 / F.col("_mid") + truncation * F.col("sigma"))
        r = middle * F.col("_far")
        weight = weight * F.when((r > near) & (F.col("sigma") > 0), pw.normal_cdf((1 / r - 1 / F.col("_mid")) / F.col("sigma"))).otherwise(1.0)
    cells = parts.select("p", *(F.floor(at[a.name] + middle * step[a.name]).cast("long").alias(a.name) for a in axes), weight.alias("w"))
    return cells.where(reduce(lambda u, v: u & v, [F.col(a.name).between(0, a.size - 1) for a in axes]))


def exact_line_of_sight(field: Field, lines: DataFrame, truncation: float = 3.0) -> DataFrame:
    """(p, v): integrals along segments by `path_lengths`; zero for what lies outside."""
    sums = path_lengths(field.axes, lines, truncation).join(field.df, field.names).groupBy("p").agg(F.sum(F.col("w") * F.col(field.value)).alias("v"))
    return lines.select("p").join(sums, "p", "left").select("p", F.coalesce("v", F.lit(0.0)).alias("v"))


# grids


def children(axis: Axis, factor: int, index: Column) -> Column:
    """The cells of a finer grid inside a cell."""
    return F.sequence(index * factor, index * factor + (factor - 1))


def neighbourhood(axis: Axis, width: int, index: Column) -> Column:
    """The window of cells around a cell of a periodic axis."""
    half = width // 2
    return F.transform(F.sequence(index - half, index - half + (width - 1)), lambda x: F.pmod(x, F.lit(axis.size).cast("long")))


def flat_index(axes: tuple[Axis, ...], index: list[Column]) -> Column:
    return reduce(lambda acc, ai: acc * ai[0].size + ai[1], list(zip(axes, index, strict=True))[1:], index[0])
