"""Amplitudes, refinement, the sphere, points off the grid, neighbours, lines and streams against dense numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import healpix as hp
from gridloom.operators import algebra as al
from gridloom.operators import correlated as co
from gridloom.operators import fields as fo
from gridloom.operators import likelihoods as li
from gridloom.operators import nonuniform as no
from gridloom.operators import refinement as re
from gridloom.operators import sphere
from gridloom.operators import variational as va
from gridloom.sources.domains import Modes, Pixels, Regular, Rings
from gridloom.sources.fields import Axis, Field
from gridloom.streaming import statistics as st


def table(spark, a, names="ij"):
    a = np.asarray(a, float)
    names = names[: a.ndim]
    rows = [(*map(int, i), float(v)) for i, v in np.ndenumerate(a) for i in [i]]
    return spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names) + ", v double").coalesce(1)


def dense(df, shape, names="ij", value="v"):
    out = np.zeros(shape)
    for r in df.collect():
        out[tuple(r[n] for n in names[: len(shape)])] = r[value]
    return out


def test_spectra_have_the_asked_fluctuations(spark):
    space = Regular((8, 6), (0.5, 0.3))
    bins = {r["bin"]: r for r in co.bins(spark, space).collect()}
    assert sum(r["rho"] for r in bins.values()) == 48
    for kind in ("amplitude", "power"):
        a = {r["bin"]: r["v"] for r in co.nonparametric_amplitude(spark, space, -2.0, 0.7, kind=kind).collect()}
        assert sorted(a) == sorted(bins) and a[0] == pytest.approx(space.total_volume)
        assert sum(bins[b]["rho"] * (v / space.total_volume) ** 2 for b, v in a.items() if b) == pytest.approx(0.49)
    with pytest.raises(ValueError):
        co.nonparametric_amplitude(spark, space, -2.0, kind="other")


@pytest.mark.parametrize("levels,shape", [((re.Level("i", 6, padding=1, width=0.7),), (6,)), ((re.Level("i", 4), re.Level("j", 5, padding=1, log=True, width=0.3, splits=3)), (4, 5))])
def test_refinement_against_dense_matrices(spark, levels, shape):
    rng, cov = np.random.default_rng(1), re.matern(1.3, 2.0, 1.5)
    fine = tuple(lv.refined().size for lv in levels)
    x, xi = rng.normal(size=shape), rng.normal(size=fine)
    got = dense(re.refine(table(spark, x), table(spark, xi), levels, cov), fine)
    want = np.zeros(fine)
    for at in np.ndindex(*shape):
        if any(lv.padding and not lv.padding <= p < lv.size - lv.padding for lv, p in zip(levels, at, strict=True)):
            continue
        w, left = re.parent_matrices(levels, cov, at)
        window = x[np.ix_(*(np.arange(p - lv.half, p + lv.half + 1) % lv.size for lv, p in zip(levels, at, strict=True)))].ravel()
        inside = np.ix_(*((p - lv.padding) * lv.splits + np.arange(lv.splits) for lv, p in zip(levels, at, strict=True)))
        want[inside] = (w @ window + left @ xi[inside].ravel()).reshape(want[inside].shape)
    assert np.allclose(got, want)


def test_refined_fields_have_the_covariance(spark):
    level, cov = re.Level("i", 6, padding=1, width=1.0), re.matern(1.0, 30.0, 0.5)
    xi = [np.random.default_rng(k).normal(size=n) for k, n in enumerate((6, 8))]
    got = dense(re.refined_field([table(spark, z) for z in xi], (level,), cov, 2.0), (8,)) - 2
    k, p = cov(np.abs(np.subtract.outer(level.position(range(6)), level.position(range(6))))), level.refined().position(range(8))
    root = re.root(k)
    assert np.allclose(root @ root, k)
    weights = cov(np.abs(np.subtract.outer(p, level.position(range(6))))) @ np.linalg.inv(k)
    left = np.sqrt(np.diag(cov(np.abs(np.subtract.outer(p, p))) - weights @ k @ weights.T))
    assert np.allclose(got, weights @ root @ xi[0] + left * xi[1])
    with pytest.raises(ValueError):
        re.base(table(spark, xi[0]), (re.Level("i", 5000),), cov)


@pytest.mark.parametrize("grid,modes", [(Rings(5, 11), Modes(4)), (Pixels(2), Modes(4)), (Rings(4, 6), Modes(3, 2))])
def test_spherical_transforms_are_adjoint(spark, grid, modes):
    rng = np.random.default_rng(2)
    a, f = rng.normal(size=modes.size), rng.normal(size=grid.size)
    y = dense(sphere.synthesis(table(spark, a), modes, grid), (grid.size,))
    b = dense(sphere.adjoint_synthesis(table(spark, f), modes, grid), (modes.size,))
    assert y @ f == pytest.approx(a @ b)
    if grid == Rings(5, 11):
        w = dense(grid.volumes(spark), (grid.size,))
        back = dense(sphere.adjoint_synthesis(table(spark, y * w), modes, grid), (modes.size,))
        assert np.allclose(back * 4 * math.pi, a)


def test_fourier_sums_at_points(spark):
    rng, axes = np.random.default_rng(3), (Axis("i", 6), Axis("j", 5))
    x, z, c = rng.uniform(-2, 2, (7, 2)), rng.normal(size=(6, 5)) + 1j * rng.normal(size=(6, 5)), rng.normal(size=7) + 1j * rng.normal(size=7)
    phase = np.exp(2j * np.pi * (x[:, 0, None, None] * (np.arange(6) - 3)[:, None] + x[:, 1, None, None] * (np.arange(5) - 2)))
    points = spark.createDataFrame([(p, *map(float, x[p]), float(c[p].real), float(c[p].imag)) for p in range(7)], "p long, x_i double, x_j double, re double, im double")
    grid = spark.createDataFrame([(int(i), int(j), float(v.real), float(v.imag)) for (i, j), v in np.ndenumerate(z)], "i long, j long, re double, im double")
    for sign in (1, -1):
        there = phase if sign > 0 else phase.conj()
        got = no.at_points(grid, points, axes, sign)
        assert np.allclose(dense(got, (7,), "p", "re") + 1j * dense(got, (7,), "p", "im"), (there * z).sum((1, 2)), atol=1e-9)
        got = no.from_points(points, axes, sign)
        assert np.allclose(dense(got, (6, 5), value="re") + 1j * dense(got, (6, 5), value="im"), np.tensordot(c, there, 1), atol=1e-9)


@pytest.mark.parametrize("nside", [1, 2, 4])
def test_neighbours_are_mutual_and_near(spark, nside):
    cell = hp.nest_to_cell(F.col("id"), nside)
    rows = spark.range(12 * nside**2).select("id", F.transform(hp.neighbours(cell, nside), lambda c: hp.cell_to_nest(c, nside)).alias("n"), hp.place_to_angle(hp.cell_place(cell, nside), nside).alias("a")).collect()
    at = {r["id"]: (math.sqrt(1 - r["a"]["z"] ** 2) * math.cos(r["a"]["phi"]), math.sqrt(1 - r["a"]["z"] ** 2) * math.sin(r["a"]["phi"]), r["a"]["z"]) for r in rows}
    near = {r["id"]: r["n"] for r in rows}
    for p, ns in near.items():
        assert p not in ns and (nside == 1 or len(set(ns)) == len(ns))
        for q in ns:
            assert p in near[q]
            if nside > 1:
                assert math.dist(at[p], at[q]) < 2.6 / nside
    if nside > 1:
        assert sum(len(n) == 7 for n in near.values()) == 24 and all(len(n) in (7, 8) for n in near.values())
    if nside == 4:
        # the nearest four always touch
        for p, ns in near.items():
            order = sorted((q for q in at if q != p), key=lambda q: math.dist(at[p], at[q]))
            assert set(order[:3]) <= set(ns)


def test_exact_lines(spark):
    axes = (Axis("i", 4, 0.5), Axis("j", 3, 1.0))
    f = np.random.default_rng(4).normal(size=(4, 3))
    ends = [((0.1, 0.2), (1.3, 1.9)), ((-1.0, 1.0), (3.0, 1.0)), ((0.6, 2.2), (0.6, -3.0)), ((5.0, 5.0), (6.0, 6.0)), ((1.0, 1.0), (1.0, 1.0)), ((1.4, 0.1), (-0.2, 2.4))]
    lines = spark.createDataFrame([(p, *a, *b) for p, (a, b) in enumerate(ends)], "p long, a_i double, a_j double, b_i double, b_j double")
    got = dense(fo.exact_line_of_sight(Field(table(spark, f), axes), lines), (len(ends),), "p")
    n = 200_000
    t = (np.arange(n) + 0.5) / n
    for p, (a, b) in enumerate(ends):
        i, j = (np.floor((a[k] + t * (b[k] - a[k])) / axes[k].distance + 0.5).astype(int) for k in (0, 1))
        ok = (i >= 0) & (i < 4) & (j >= 0) & (j < 3)
        assert got[p] == pytest.approx(f[i[ok], j[ok]].sum() / n * math.dist(a, b), abs=1e-3)
    unsure = lines.where("p = 1").withColumn("sigma", F.lit(0.02))
    w = fo.path_lengths(axes, unsure).agg(F.sum("w")).first()[0]
    assert 0 < w < fo.path_lengths(axes, lines.where("p = 1")).agg(F.sum("w")).first()[0] + 1e-9


def test_streams_reach_the_same_as_tables(spark, tiny):
    path = f"{tiny}/events.parque[t]"
    for f in (lambda d: st.window_counts(d, ["event_type"]), lambda d: st.running_moments(d, "event_type", "value")):
        got, want = (sorted(map(str, (tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in d.collect()))) for d in (st.drained(f(st.opened(spark, path))), f(spark.read.parquet(path))))
        assert got == want and got


def test_turning_trajectories_and_mean_fields(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    q = li.quadratic(al.diagonal(table(spark, [4.0, 1.0]), ("i",)), table(spark, [4.0, -1.0]))  # mean 1, -1; deviation 1/2, 1
    chain = [dense(x, (2,)) for x in va.nuts(q, table(spark, [1.0, -1.0]), 2, 0.4, depth=2, seed=3)]
    assert len(chain) == 2 and all(np.abs(x - [1, -1]).max() < 4 for x in chain) and not np.allclose(chain[0], chain[1])
    got = va.mean_field(q, table(spark, [0.7, -0.7]), 5, 1, 0.15)
    assert np.abs(dense(got, (2,)) - [1, -1]).max() < 0.3 and dense(got, (2,), value="std")[0] < 0.8
    spark.conf.set("spark.sql.shuffle.partitions", "4")
