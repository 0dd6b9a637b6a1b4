"""Likelihoods, minimisers and samplers against dense numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import algebra as al
from gridloom.operators import likelihoods as li
from gridloom.operators import minimisers as mi
from gridloom.operators import variational as va

I = ("i",)


def vector(spark, a):
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(a)], "i long, v double").coalesce(1)


def array(df):
    return np.array([r["v"] for r in sorted(df.collect(), key=lambda r: r["i"])])


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("kind,data,at,parameter", [("gaussian", [1, 2, 3], [0.5, 0.1, 2], 4.0), ("poisson", [1, 0, 3], [0.5, 0.7, 2], 1.0), ("student_t", [1, 2, 3], [0.5, 0.1, 2], 3.0), ("bernoulli", [1, 0, 1], [0.5, 0.1, 0.7], 1.0), ("inverse_gamma", [1, 2, 3], [0.5, 1.1, 2], 0.5)])
def test_gradients_and_coordinates(spark, kind, data, at, parameter):
    lh, x, d = li.likelihood(kind, vector(spark, data), I, parameter), np.array(at, float), 1e-5
    diff = [(lh.value(vector(spark, x + d * e)) - lh.value(vector(spark, x - d * e))) / (2 * d) for e in np.eye(3)]
    assert np.allclose(array(lh.gradient(vector(spark, x))), diff, rtol=1e-5, atol=1e-6)
    t = lambda y: array(lh.transform(vector(spark, y))[0][0])
    metric = array(lh.metric(vector(spark, x))(vector(spark, [1, 1, 1])))
    assert np.allclose(((t(x + d) - t(x - d)) / (2 * d)) ** 2, metric, rtol=1e-5)


@pytest.mark.parametrize("method", ["newton_cg", "vl_bfgs", "trust_ncg"])
def test_minimisers_find_the_mode(spark, method):
    d = np.array([3.0, 1.0])
    h = li.hamiltonian(li.likelihood("poisson", vector(spark, d), I) @ al.pointwise("exp", I))
    got = mi.minimise(h, vector(spark, [0.5, 0.2]), method, mi.Controller(limit=12, gradient=1e-2))
    x = array(got.x)
    assert got.converged and np.abs(np.exp(x) - d + x).max() < 2e-2


@pytest.mark.parametrize("method", ["steepest_descent", "nonlinear_cg"])
def test_descents_lower_the_value(spark, method):
    q = li.quadratic(al.diagonal(vector(spark, [1.0, 4.0]), I), vector(spark, [1.0, 1.0]))
    control = mi.Controller(limit=3, gradient=1e-6)
    got = mi.minimise(q, vector(spark, [3.0, -2.0]), method, control)
    assert control.history == sorted(control.history, reverse=True) and got.value < control.history[0] / 4


def test_controllers():
    for c, values, at in ((mi.Controller(absolute=0.1), [5, 4, 3.95], 3), (mi.Controller(change=0.1, level=2), [5, 4.9, 4.85, 4.8], 3), (mi.Controller(limit=2), [3, 2, 1], 3), (mi.Controller(deviation=0.1, memory=3), [3, 1, 1, 1], 4), (mi.Controller(gradient_max=1), [1], 1)):
        ends = [c.done(v, 2.0, 1.0) for v in values]
        assert ends.index(True) == at - 1
    assert mi.boundary(0.0, 0.0, 4.0, 2.0) == (-1.0, 1.0)


def test_conjugate_gradient_and_inversion(spark):
    rng = np.random.default_rng(1)
    a = rng.standard_normal((4, 4))
    a = a @ a.T + np.eye(4)
    m = al.matrix(spark.createDataFrame([(i, j, float(a[i, j])) for i in range(4) for j in range(4)], "r long, i long, v double"), "r", "i", I)
    op = al.rename(("r",), I, {"i": F.col("r")}, {"r": F.col("i")}) @ m
    b = rng.standard_normal(4)
    assert np.allclose(array(mi.inversion(op).inverse(vector(spark, b))), np.linalg.solve(a, b), atol=1e-6)
    assert np.allclose(array(mi.conjugate_gradient(op, vector(spark, b), vector(spark, np.ones(4))).x), np.linalg.solve(a, b), atol=1e-6)
    assert np.allclose(va.operator_spectrum(op, vector(spark, b), 4), np.linalg.eigvalsh(a)[::-1], rtol=1e-6)
    assert np.isfinite(va.logdet(op, vector(spark, b), 2, 1))
    q = li.quadratic(op, vector(spark, b))
    assert np.allclose(array(mi.minimise(q, vector(spark, np.zeros(4)), "newton_cg", mi.Controller(limit=5, gradient=1e-6)).x), np.linalg.solve(a, b), atol=1e-5)


def test_linear_posterior(spark):
    d = np.array([1.0, -2.0, 0.5])
    lh = li.likelihood("gaussian", vector(spark, d), I, 4.0) + li.likelihood("gaussian", vector(spark, d * 2), I, 1.0) @ al.scaling(2.0, I)
    x = vector(spark, np.zeros(3))
    state = va.optimise_kl(lh, x, 1, 1, controller=lambda k: mi.Controller(limit=3, gradient=1e-6))
    want = (4 * d + 2 * 2 * d) / (4 + 4 + 1)
    assert np.allclose(array(state.x), want, atol=1e-5) and len(state.residuals) == 2
    assert np.allclose(array(state.residuals[0]), -array(state.residuals[1]))
    draws = np.array([array(va.draw_linear_residual(lh, x, (5, k))[0]) for k in range(3)])
    assert 0.02 / 9 < draws.var() < 6 / 9
    # for a linear model the nonlinear residual is the linear one
    r, b = va.draw_linear_residual(lh, x, (1, 2))
    assert np.allclose(array(va.nonlinear_residual(lh, x, r, b)), array(r), atol=1e-5)
    bound = va.evidence_lower_bound(lh, state, 2, 1)
    assert np.isfinite(bound)


def test_nonlinear_residual_solves_its_equation(spark):
    lh = li.likelihood("poisson", vector(spark, [3.0, 1.0]), I) @ al.pointwise("exp", I)
    x = np.array([0.8, 0.2])
    r, b = va.draw_linear_residual(lh, vector(spark, x), (3, 1))
    y = x + array(va.nonlinear_residual(lh, vector(spark, x), r, b, mi.Controller(limit=8, gradient=1e-6)))
    t = lambda z: 2 * np.exp(z / 2)
    assert np.allclose(y - x + np.exp(x / 2) * (t(y) - t(x)), array(b), atol=1e-4)


def test_rounds_go_on_where_they_ended(spark, tmp_path):
    lh = li.likelihood("gaussian", vector(spark, [1.0, 2.0]), I, 1.0)
    seen = []
    run = lambda n: va.optimise_kl(lh, vector(spark, [0.0, 0.0]), n, 0, controller=lambda k: mi.Controller(limit=2, gradient=1e-8), inspect=lambda s: seen.append(s.rounds), folder=str(tmp_path / "kl"))
    run(1)
    state = run(2)
    assert seen == [1, 2] and np.allclose(array(state.x), [0.5, 1.0], atol=1e-6)


def test_hmc(spark):
    h = li.prior(I)
    samples, rate = va.hmc(h, vector(spark, [0.0, 0.0]), 3, 0.3, 3)
    assert len(samples) == 3 and 0 <= rate <= 1
    x, p = va.leapfrog(h, vector(spark, [1.0, 0.0]), vector(spark, [0.0, 1.0]), 0.1, 4)
    back, _ = va.leapfrog(h, x, p.withColumn("v", -F.col("v")), 0.1, 4)
    assert np.allclose(array(back), [1.0, 0.0])


def test_vector_gaussian(spark):
    rng = np.random.default_rng(4)
    root = np.array([[1.5, 0.0], [0.3, 0.7]])
    r = rng.standard_normal((6, 2))
    df = spark.createDataFrame(r.tolist(), "a double, b double")
    got = df.agg(li.vector_gaussian([F.col("a"), F.col("b")], [[F.lit(1.5), F.lit(0.0)], [F.lit(0.3), F.lit(0.7)]])).first()[0]
    inverse = root @ root.T
    assert got == pytest.approx(sum(0.5 * v @ inverse @ v for v in r) - 6 * 0.5 * np.linalg.slogdet(inverse)[1])
