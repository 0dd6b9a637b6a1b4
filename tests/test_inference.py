"""Posterior samples and modes against dense matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import inference as inf

N, SMOOTH = 8, 1.5


def dense(metric):
    eye = np.eye(N)
    return np.diag(metric) + SMOOTH * (2 * eye - np.roll(eye, 1, 0) - np.roll(eye, -1, 0))


def test_samples_have_the_inverse_precision(spark):
    metric = np.linspace(0.5, 3, N)
    m = spark.createDataFrame([(i, float(x)) for i, x in enumerate(metric)], "i long, m double")
    got = inf.residual_samples(m, N, SMOOTH, 2000, seed=3, iterations=20).toPandas().pivot(index="s", columns="i", values="v").to_numpy()
    assert got.shape == (2000, N)
    want = np.linalg.inv(dense(metric))
    assert np.abs(got.T @ got / 2000 - want).max() < 0.1 * want.max()
    assert np.abs(got.mean(axis=0)).max() < 0.06


def test_mode_has_no_slope(spark):
    d = np.array([3, 4, 0, 9, 12, 7, 2, 1])
    data = spark.createDataFrame([(i, int(x)) for i, x in enumerate(d)], "i long, v long")
    x = inf.poisson_mode(data, N, SMOOTH, steps=6).toPandas().sort_values("i")["v"].to_numpy()
    assert np.abs(d - np.exp(x) - dense(np.zeros(N)) @ x).max() < 1e-4
    with pytest.raises(ValueError):
        inf.poisson_mode(data.withColumn("v", F.lit(0).cast("long")), N, SMOOTH)
