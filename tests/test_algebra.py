"""Operators against numpy, and each against its adjoint."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import algebra as al
from gridloom.sources.fields import Axis

I, IJ, KI = ("i",), ("i", "j"), ("key", "i")


def vector(spark, values, index=I):
    a = np.asarray(values, float)
    rows = [(*map(int, at), float(v)) for at, v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, ", ".join(f"{c} long" for c in index) + ", v double")


def multi(spark, parts):
    return spark.createDataFrame([(k, i, float(v)) for k, vs in parts.items() for i, v in enumerate(vs)], "key string, i long, v double")


def array(df, *shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[tuple(r)[:-1]] = r["v"]
    return out


def operators(spark):
    rng = np.random.default_rng(1)
    x, y, m = vector(spark, rng.standard_normal(6)), vector(spark, rng.standard_normal(6)), vector(spark, rng.standard_normal((4, 6)), IJ)
    d = vector(spark, rng.uniform(1, 2, 6))
    ax = (Axis("i", 4, 0.5), Axis("j", 6, 0.25))
    mk, yk = multi(spark, {"a": rng.standard_normal(3), "b": rng.standard_normal(4)}), multi(spark, {"a": rng.standard_normal(3), "b": rng.standard_normal(4)})
    kept, flat = vector(spark, rng.standard_normal(4)), vector(spark, rng.standard_normal(24))
    places = spark.createDataFrame([(0, 5), (1, 2), (2, 5)], "p long, i long")
    p = vector(spark, rng.standard_normal(3), ("p",))
    dofs = spark.createDataFrame([(k, min(k, 6 - k)) for k in range(6)], "i long, d long")
    lags = spark.createDataFrame([(0, 2.0), (1, -1.0), (3, 0.5)], "lag long, v double")
    mat = vector(spark, rng.standard_normal((3, 6)), ("r", "i"))
    return [
        (al.scaling(3.0, I), x, y), (al.diagonal(d, I), x, y), (al.masking(I, F.col("i") % 2 == 0), x, y), (al.window(IJ, {"i": (1, 3), "j": (2, 5)}), m, vector(spark, rng.standard_normal((2, 3)), IJ)),
        (al.padding(I, {"i": (6, 9)}), x, vector(spark, rng.standard_normal(9))), (al.padding(IJ, {"i": (4, 7), "j": (6, 8)}, True), m, vector(spark, rng.standard_normal((7, 8)), IJ)),
        (al.shift(IJ, ax), m, m), (al.reshape(ax, (Axis("i", 24),)), m, flat), (al.squeeze((Axis("i", 6), Axis("j", 1))), vector(spark, rng.standard_normal((6, 1)), IJ), x),
        (al.pick(I, "i", places), x, p), (al.insert_at(IJ, {"j": 2}), kept, m), (al.keyed("a", I), x, mk), (al.prepend("pre-", KI), mk, yk.withColumn("key", F.concat(F.lit("pre-"), "key"))),
        (al.extract_keys(["a"], KI), mk, yk), (al.split(I, {"a": F.col("i") < 4, "b": F.col("i") > 2}), x, mk), (al.block_diagonal({"a": al.scaling(2.0, I), "b": al.masking(I, F.col("i") == 1)}), mk, yk),
        (al.contraction(ax, ["j"], 1), m, kept), (al.weighting(ax, -1), m, m), (al.outer(kept.withColumnRenamed("i", "k"), ("k",), I), x, vector(spark, rng.standard_normal((4, 6)), ("k", "i"))),
        (al.matrix(mat, "r", "i", I), x, vector(spark, rng.standard_normal(3), ("r",))), (al.distributor(dofs, "d", I), vector(spark, rng.standard_normal(4), ("d",)), x), (al.toeplitz(lags, Axis("i", 6), I), x, y),
        (al.lower_triangle(3), x, vector(spark, rng.standard_normal((3, 3)), ("r", "c"))), (al.diagonal_part(), vector(spark, rng.standard_normal((3, 3)), ("r", "c")), vector(spark, rng.standard_normal(3))),
        (al.scaling(2.0, I) @ al.diagonal(d, I), x, y), (al.masking(I, F.col("i") < 2) + al.diagonal(d, I) * 0.5, x, y), (al.sandwich(al.masking(I, F.col("i") < 2), al.diagonal(d, I)), x, y),
        (-(al.diagonal(d, I) - al.scaling(1.0, I)), x, y), (al.diagonal(d, I).inverse, x, y), (al.diagonal(d, I).adjoint, x, y), (al.local(I, lambda v: v * F.col("i")), x, y),
    ]


@pytest.fixture(scope="module")
def cases(spark):
    return operators(spark)


@pytest.mark.parametrize("k", range(31))
def test_adjoints(cases, k):
    assert len(cases) == 31
    al.check_linear(*cases[k])


def test_values(spark):
    rng = np.random.default_rng(2)
    a = rng.standard_normal((4, 6))
    m = vector(spark, a, IJ)
    ax = (Axis("i", 4, 0.5), Axis("j", 6, 0.25))
    assert np.allclose(array(al.shift(IJ, ax)(m), 4, 6), np.fft.fftshift(a))
    assert np.allclose(array(al.reshape(ax, (Axis("i", 24),))(m), 24), a.ravel())
    assert np.allclose(array(al.contraction(ax, ["j"], 1)(m), 4), a.sum(1) * 0.25)
    x = rng.standard_normal(6)
    c = np.array([2.0, -1.0, 0.0, 0.5, 0.0, 0.0])
    lags = spark.createDataFrame([(k, float(v)) for k, v in enumerate(c)], "lag long, v double")
    assert np.allclose(array(al.toeplitz(lags, Axis("i", 6), I)(vector(spark, x)), 6), c[np.abs(np.subtract.outer(range(6), range(6)))] @ x)
    tri = array(al.lower_triangle(3)(vector(spark, x)), 3, 3)
    want = np.zeros((3, 3))
    want[np.tril_indices(3)] = x
    assert np.allclose(tri, want)
    assert array(al.null(I, IJ)(vector(spark, x)), 6, 6).sum() == 0
    assert np.allclose(array(al.combine([vector(spark, x), vector(spark, x + 1)], [2, -1], I), 6), x - 1)
    counted = al.Counting(al.scaling(2.0, I))
    al.sandwich(counted.op)(vector(spark, x))
    assert (counted.times, counted.back) == (1, 1)
    assert al.norm(vector(spark, x), 1) == pytest.approx(np.abs(x).sum()) and al.norm(vector(spark, x), float("inf")) == pytest.approx(np.abs(x).max())
    with pytest.raises(ValueError):
        al.null(I, I).inverse
    with pytest.raises(ValueError):
        al.scaling(1.0, I) @ al.scaling(1.0, IJ)
    with pytest.raises(AssertionError):
        al.check_linear(al.Linear(I, I, lambda x: x, lambda y: y.withColumn("v", 2 * F.col("v"))), vector(spark, x), vector(spark, x))


def test_jacobians(spark):
    rng = np.random.default_rng(3)
    x, dx = vector(spark, rng.uniform(0.5, 1.5, 5)), vector(spark, rng.standard_normal(5))
    f, g = al.pointwise("exp", I), al.pointwise("sqrt", I)
    for op in (f, g @ f, f + g, f * g, al.scaling(2.0, I) @ f, f @ al.masking(I, F.col("i") == 1), al.adder(dx, I) @ g, al.expression(I, lambda v: v * v, lambda v: 2 * v)):
        al.check_smooth(op, x, dx)
    lin = al.Linearization.variable(x, I).then(f).then(al.scaling(3.0, I))
    al.assert_close(lin.jacobian(dx), al.multiply(lin.value, dx, I), I, rtol=1e-9)
    assert array(al.constant(x, I, I).jacobian(x)(dx), 5).sum() == 0
    with pytest.raises(AssertionError):
        al.assert_close(x, dx, I)
