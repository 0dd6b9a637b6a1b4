"""Domains, transforms and matrix functions against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import numeric as nu
from gridloom.operators import harmonic as ha
from gridloom.sources import domains as do


def test_modes_and_rings(spark):
    for lmax, mmax in ((3, None), (4, 2), (2, 0)):
        m = do.Modes(lmax, mmax)
        rows = sorted(m.table(spark).collect())
        assert [r["i"] for r in rows] == list(range(m.size)) and all(r["m"] <= r["l"] for r in rows)
    assert do.Modes(3).size == 16
    v = [r["v"] for r in do.Rings(4).volumes(spark).collect()]
    assert len(v) == do.Rings(4).size == 28 and sum(v) == pytest.approx(4 * math.pi)
    assert do.Rings(4).codomain == do.Modes(3, 3)
    assert do.Pixels(4).size * do.Pixels(4).cell_volume == pytest.approx(4 * math.pi)


def test_regular_and_power(spark):
    p = do.Regular((6, 4), (0.5, 0.25))
    assert p.total_volume == pytest.approx(3.0) and p.codomain.codomain == p
    lengths = p.codomain.unique_lengths()
    k = np.hypot.outer(np.abs(np.fft.fftfreq(6, 0.5)), np.abs(np.fft.fftfreq(4, 0.25)))
    assert np.allclose(lengths, np.unique(np.round(k, 9)))
    assert [n for _, n in ha.reduce_lengths(p.codomain)] == np.unique(np.round(k, 9), return_counts=True)[1].tolist()
    for log in (False, True):
        bounds = do.bounds_of(lengths, log)
        rho = {r["bin"]: r["rho"] for r in do.Power(p.codomain, tuple(bounds)).table(spark).collect()}
        assert set(rho) == set(range(len(bounds) + 1)) and sum(rho.values()) == 24
        with pytest.raises(ValueError):
            do.bounds_of(lengths, log, 500)
    with pytest.raises(ValueError):
        p.mode_length()


def test_multi_domains():
    a, b = do.Multi({"x": do.Unstructured((3,)), "y": do.Pixels(1)}), do.Multi({"y": do.Pixels(1), "z": do.Degrees((1.0, 2.0))})
    assert do.Multi.union([a, b]).size == 3 + 12 + 2 and do.Product((do.Unstructured((2, 2)), do.Pixels(1))).size == 48
    with pytest.raises(ValueError):
        do.Multi.union([a, do.Multi({"y": do.Pixels(2)})])


def test_grids(spark):
    axis = do.LogAxis(5, 1.0, 32.0)
    got = spark.range(5).select(axis.index(axis.coordinate(F.col("id"))).alias("b"), axis.cell(axis.coordinate(F.col("id"))).alias("c"), axis.volume(F.col("id")).alias("v")).collect()
    assert np.allclose([r["b"] for r in got], range(5)) and [r["c"] for r in got] == list(range(5)) and sum(r["v"] for r in got) == pytest.approx(31.0)
    o = do.OpenAxis(6, 2, 1)
    rows = spark.range(6).select(o.children(F.col("id")).alias("c"), o.neighbourhood(F.col("id"), 3).alias("n")).collect()
    assert [x for r in rows for x in r["c"]] == list(range(o.refined())) and rows[0]["n"] == [0, 1, 2] and rows[5]["n"] == [3, 4, 5]
    with pytest.raises(ValueError):
        do.LogAxis(5, 0.0, 1.0)


def test_transforms(spark):
    rng = np.random.default_rng(1)
    p = do.Regular((6, 4), (0.5, 0.25))
    a = rng.standard_normal((6, 4))
    x = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(6) for j in range(4)], "i long, j long, v double")
    get = lambda df, c="v": np.array([[r[c] for r in sorted(df.collect(), key=lambda r: (r["i"], r["j"]))]]).reshape(6, 4)
    z = ha.fft(ha.complex_of(x, ("i", "j")), p.axes)
    want = np.fft.fft2(a) * 0.125
    assert np.allclose(get(z, "re"), want.real) and np.allclose(get(z, "im"), want.imag)
    assert np.allclose(get(ha.conjugate(z), "im"), -want.imag) and np.allclose(get(ha.imaginary_part(z, ("i", "j"))), want.imag)
    assert np.allclose(get(ha.real_part(ha.fft(z, p.axes, inverse=True), ("i", "j"))), a)
    k = np.hypot.outer(np.abs(np.fft.fftfreq(6, 0.5)), np.abs(np.fft.fftfreq(4, 0.25)))
    assert np.allclose(get(ha.smooth(x, p, 0.2)), np.fft.ifft2(np.fft.fft2(a) * np.exp(-2 * np.pi**2 * 0.04 * k**2)).real)
    amp = ha.matern_amplitude(p, 0.5, 1.5, -4.0, True)
    f = get(ha.correlated_field(x, p, amp, 2.0, 0.7))
    assert f.mean() == pytest.approx(2.0 + 0.7 * a[0, 0])
    s = (1 + (k / 1.5) ** 2) ** -1.0
    s[0, 0] = 0
    m = a * 0.5 * s * p.total_volume / np.sqrt((s**2).sum())
    g = np.fft.fft2(m) / p.total_volume
    assert np.allclose(f - f.mean(), g.real + g.imag)
    values = spark.createDataFrame([(b, float(b)) for b in range(len(p.codomain.unique_lengths()))], "bin long, v double")
    assert np.allclose(get(ha.spread_power(values, p.codomain, spark)), np.unique(np.round(k, 9), return_inverse=True)[1].reshape(6, 4))
    assert ha.fft(ha.complex_of(x.limit(0), ("i", "j")), p.axes).count() == 0
    one = spark.createDataFrame([(k, float(k * k)) for k in range(5)], "i long, v double")
    axis = do.Regular((5,), (1.0,))
    assert np.allclose([r["v"] for r in sorted(ha.hartley(one, axis.axes).collect())], (lambda z: z.real + z.imag)(np.fft.fft(np.arange(5.0) ** 2)))


def test_unique_and_matrices(spark):
    values = [3.0, 1.0, 1.04, 0.97, 3.05, 1.09, None, 8.0]
    got = {r["value"]: (r["u"], r["n"]) for r in nu.unique(spark.createDataFrame(list(enumerate(values)), "k int, v double"), "v", "k", 0.06, 0.0).collect()}
    found, want = [], {}
    for v in values:
        if v is not None:
            found, n = nu.amend(found, v, 0.06, 0.0)
            want[v] = (found[n], n)
    assert got == want
    rng = np.random.default_rng(2)
    m = rng.standard_normal((3, 3))
    m = m @ m.T + np.eye(3)
    df = spark.createDataFrame([(m.ravel().tolist(), [1.0, 2.0, 3.0]), (None, None)], "m array<double>, b array<double>")
    root = np.reshape(nu.matrix_function(df, "m", "sqrt").first()["m"], (3, 3))
    assert np.allclose(root @ root, m)
    log = nu.matrix_function(df, "m", "log")
    assert np.allclose(np.reshape(nu.matrix_function(log, "m", "exp").first()["m"], (3, 3)), m)
    assert np.allclose(m @ nu.solve(df, "m", "b").first()["x"], [1, 2, 3]) and nu.solve(df, "m", "b").collect()[1]["x"] is None
