"""Transforms of a standard normal number against closed forms; NaN and null in point-wise functions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import pointwise as pw
from gridloom.operators import processes as pr


def column(spark, values, *exprs):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    return [list(r)[1:] for r in df.select("k", *(e(F.col("v")).alias(f"c{j}") for j, e in enumerate(exprs))).orderBy("k").collect()]


def test_normal_law_and_tails(spark):
    x = [-37.0, -9.0, -4.0, -3.999, -1.0, -0.5, 0.0, 1e-3, 1.0, 3.9, 4.1, 9.0]
    got = column(spark, x, lambda v: pw.uniform(v, 0.0, 1.0), lambda v: pw.laplace(v, 2.0))
    for v, (u, la) in zip(x, got, strict=True):
        assert u == pytest.approx(math.erfc(-v / math.sqrt(2)) / 2, rel=1e-12, abs=0)
        want = -math.copysign(1, v) * 2 * (math.log(math.erfc(abs(v) / math.sqrt(2)))) if v else 0.0
        assert la == pytest.approx(want, rel=1e-12, abs=1e-15)


def test_nan_and_null(spark):
    nan = float("nan")
    got = column(spark, [nan, None, 2.0, -1.0], lambda v: pw.ptw("clip", v, 0.0, 1.0), lambda v: pw.ptw("unitstep", v))
    assert math.isnan(got[0][0]) and got[0][1] == 0.0 and got[1] == [None, None] and got[2] == [1.0, 1.0] and got[3] == [0.0, 0.0]


def test_gamma_family(spark):
    x = [-3.0, -1.0, 0.0, 0.5, 2.5]
    exprs = (lambda v: pw.gamma(v, 1.0, 2.0), lambda v: pw.inverse_gamma(v, 1.0, 3.0), lambda v: pw.beta(v, 1.0, 3.0), lambda v: pw.log_inverse_gamma(v, 1.0, 3.0), lambda v: pw.inverse_gamma_inverse(pw.inverse_gamma(v, 2.5, 3.0), 2.5, 3.0), lambda v: pw.lognormal_inverse(pw.lognormal(v, 2.0, 0.5), 2.0, 0.5), lambda v: pw.gamma(v, 0.5, 1.0))
    for v, (g, ig, b, lig, back, ln, half) in zip(x, column(spark, x, *exprs), strict=True):
        p, q = math.erfc(-v / math.sqrt(2)) / 2, math.erfc(v / math.sqrt(2)) / 2
        assert g == pytest.approx(-2 * math.log(q), rel=1e-4)  # exponential law
        assert ig == pytest.approx(3 / -math.log(p), rel=1e-4) and lig == pytest.approx(math.log(ig), rel=1e-9)
        assert b == pytest.approx(1 - q ** (1 / 3), rel=1e-4)
        assert back == pytest.approx(v, abs=1e-6) and ln == pytest.approx(v, abs=1e-9)
        assert math.erf(math.sqrt(half)) == pytest.approx(p, rel=1e-3)  # chi square of one degree, halved
    a, s = pw.inverse_gamma_from_mode(1.0, 2.0)
    assert s / (a + 1) == pytest.approx(1.0) and s / (a - 1) == pytest.approx(2.0)


def test_vector_gauss_markov(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for k in range(3):
        x = np.array([1.0, -1.0])
        want[k] = [x]
        for n in range(5):
            a, m, z = rng.standard_normal((2, 2)), rng.standard_normal((2, 2)), rng.standard_normal(2)
            rows.append((k, n, a.ravel().tolist(), m.ravel().tolist(), z.tolist()))
            x = a @ x + m @ z
            want[k].append(x)
    df = spark.createDataFrame(rows[::-1], "k int, t int, a array<double>, m array<double>, xi array<double>")
    got = pr.discrete_gauss_markov(df, "k", ["t"], [1.0, -1.0], "a", "m").collect()
    assert len(got) == 18 and all(np.allclose(r["x"], want[r["k"]][r["n"]]) for r in got)
    assert pr.discrete_gauss_markov(df.limit(0), "k", ["t"], [1.0, -1.0], "a", "m").count() == 0
