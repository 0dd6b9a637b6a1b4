"""Queries over the star-schema tables, each with the same query in SQL. Doubles are rounded in both."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import healpix as hp
from ..functions import numeric as nu
from ..functions import pointwise as pw
from ..operators import algebra as al
from ..operators import correlated as co
from ..operators import energies as en
from ..operators import fields as fo
from ..operators import harmonic as ha
from ..operators import inference
from ..operators import likelihoods as li
from ..operators import nonuniform as no
from ..operators import processes as pr
from ..operators import refinement as re
from ..operators import solvers, spectra, sphere
from ..sources import fields as src
from ..sources import samples
from ..sources.domains import LogAxis, Modes, OpenAxis, Pixels, Power, Regular, bounds_of
from ..sources.fields import Axis, Field
from ..streaming import statistics as st

QUERIES: dict = {}
SQL: dict[str, str] = {}

_HOUR = "(CASE WHEN epoch(ts) - 1704067200 = 2592000 THEN 719 WHEN epoch(ts) >= 1704067200 AND epoch(ts) - 1704067200 < 2592000 THEN floor((epoch(ts) - 1704067200) / 3600) END)::BIGINT"
COUNTS = f"c AS (SELECT {_HOUR} AS i, count(*) AS n FROM events WHERE {_HOUR} IS NOT NULL GROUP BY 1), f AS (SELECT r.i, coalesce(c.n, 0) AS v FROM range(720) r(i) LEFT JOIN c ON c.i = r.i)"
TYPES = f"t AS (SELECT event_type AS key, {_HOUR} AS i, count(*)::DOUBLE AS v FROM events WHERE {_HOUR} IS NOT NULL GROUP BY 1, 2)"
EMB = "f AS (SELECT vec_id AS s, unnest(range(64))::INT AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)"
GRID = """g AS (SELECT (l_partkey % 16)::BIGINT AS i, (l_suppkey % 16)::BIGINT AS j, sum(round(l_extendedprice * 100)::BIGINT) / 1e6 AS v FROM lineitem GROUP BY 1, 2),
f AS (SELECT a.i, b.j, coalesce(g.v, 0) AS v FROM range(16) a(i) CROSS JOIN range(16) b(j) LEFT JOIN g ON g.i = a.i AND g.j = b.j)"""
RESID = "f AS (SELECT l_returnflag AS key, l_linenumber AS s, (l_discount - 0.05) / 0.03 AS r FROM lineitem)"
SERIES = "e AS (SELECT user_id AS k, floor(epoch(ts))::BIGINT AS t, event_id AS id, value FROM events), f AS (SELECT k, t, id, coalesce(t - lag(t) OVER (PARTITION BY k ORDER BY t, id), 3600) / 3600.0 AS dt, (value - 50) / 25 AS xi FROM e)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


@query(f"WITH {COUNTS}, m AS (SELECT avg(v) AS l FROM f) SELECT round(sum(l) - sum(v * ln(l)), 6) AS energy FROM f, m")
def poisson_energy_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = src.counts_hour(spark, sf_dir).df
    rate = f.agg(F.avg("v").alias("rate"))  # one row
    return f.crossJoin(F.broadcast(rate)).agg(r6(en.poissonian(F.col("v"), F.col("rate"))).alias("energy"))


@query(f"WITH {COUNTS} SELECT i, CASE WHEN i % 24 < 6 THEN 0 ELSE v END AS v FROM f")
def mask_scatter(spark, sf_dir):
    f = src.counts_hour(spark, sf_dir)
    return fo.mask_adjoint(fo.mask(f, F.col("i") % 24 < 6), f).df


@query(f"WITH {COUNTS} SELECT i - 240 AS i, v FROM f WHERE i >= 240 AND i < 480")
def slice_center(spark, sf_dir):
    return fo.centre(src.counts_hour(spark, sf_dir), "i", 240).df


@query(f"WITH {COUNTS}, h AS (SELECT CASE WHEN i >= 360 THEN i + 280 ELSE i END AS i, v FROM f) SELECT r.i, coalesce(v, 0) AS v FROM range(1000) r(i) LEFT JOIN h ON h.i = r.i")
def zero_pad(spark, sf_dir):
    return fo.zero_pad(src.counts_hour(spark, sf_dir), "i", 1000, central=True).df


@query(f"WITH {GRID} SELECT j * 16 + i AS i, round(v, 6) AS v FROM f")
def transpose_reshape(spark, sf_dir):
    f = fo.flatten(fo.transpose(src.grid2d(spark, sf_dir), ["j", "i"]))
    return f.df.select("i", r6("v").alias("v"))


@query(f"WITH {TYPES}, a AS (SELECT * FROM t WHERE i < 400), b AS (SELECT key, i, 2 * v AS v FROM t WHERE i >= 300) SELECT key, i, sum(v) AS v FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2")
def field_unite(spark, sf_dir):
    t = src.type_hour(spark, sf_dir)
    return fo.unite(t.where("i < 400"), t.where("i >= 300").withColumn("v", 2 * F.col("v")), ["key", "i"])


@query(f"WITH {TYPES}, b AS (SELECT key, i, 2 * v AS v FROM t WHERE key < 'd') SELECT * FROM b UNION ALL SELECT * FROM t WHERE key NOT IN (SELECT key FROM b)")
def field_union_last_wins(spark, sf_dir):
    t = src.type_hour(spark, sf_dir)
    return fo.union(t, t.where("key < 'd'").withColumn("v", 2 * F.col("v")))


@query(f"WITH {GRID} SELECT i, round(sum(v), 6) AS total, round(sum(v) * 0.25, 8) AS integral FROM f GROUP BY i")
def contract_one_axis(spark, sf_dir):
    g = src.grid2d(spark, sf_dir)
    return fo.contract(g, ["j"]).df.select("i", F.col("v").alias("total")).join(fo.integrate(g, ["j"]).df.withColumnRenamed("v", "integral"), "i").select("i", r6("total").alias("total"), F.round("integral", 8).alias("integral"))


@query(f"WITH {GRID} SELECT round(sum(v) * 0.125, 9) AS integral FROM f")
def integrate_volume(spark, sf_dir):
    return fo.integrate(src.grid2d(spark, sf_dir), ["i", "j"]).df.select(F.round("v", 9).alias("integral"))


@query(f"WITH {EMB} SELECT s, round(sum(v), 6) AS total, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS var, round(stddev_pop(v), 6) AS std, round(sum(abs(v)), 6) AS norm1, round(sqrt(sum(v * v)), 6) AS norm2, round(max(abs(v)), 6) AS norm_inf, bool_and(v <> 0) AS all_nonzero, bool_or(v <> 0) AS any_nonzero FROM f GROUP BY s")
def field_statistics(spark, sf_dir):
    s = fo.statistics(src.emb(spark, sf_dir), ["s"])
    return s.select("s", *(r6(c).alias(c) for c in ("total", "mean", "var", "std", "norm1", "norm2", "norm_inf")), "all_nonzero", "any_nonzero")


@query(f"WITH {EMB} SELECT j, round(avg(v), 6) AS mean, round(coalesce(var_samp(v), 0), 6) AS variance FROM f GROUP BY j")
def sample_stat_welford(spark, sf_dir):
    return fo.sample_stat(src.emb(spark, sf_dir).df, ["j"]).select("j", r6("mean").alias("mean"), r6("variance").alias("variance"))


_SANITY = "SELECT key, round(avg(chi), 6) AS redchi2, round({0}(chi), 6) AS redchi2_std, round(avg(m), 6) AS mean, round({0}(m), 6) AS mean_std, sum(n)::BIGINT AS ndof{1} FROM o GROUP BY key"


@query(f"WITH {RESID}, o AS (SELECT key, s, avg(r * r) FILTER (WHERE r <> 0) AS chi, avg(r) FILTER (WHERE r <> 0) AS m, count(*) FILTER (WHERE r <> 0) AS n, count(*) FILTER (WHERE r = 0) AS g FROM f GROUP BY 1, 2) " + _SANITY.format("stddev_samp", ", sum(g)::BIGINT AS n_ignored"))
def minisanity(spark, sf_dir):
    m = fo.minisanity(src.resid(spark, sf_dir))
    return m.select("key", *(r6(c).alias(c) for c in ("redchi2", "redchi2_std", "mean", "mean_std")), "ndof", "n_ignored")


@query(f"WITH {RESID}, o AS (SELECT key, s, avg(r * r) AS chi, avg(r) AS m, count(*) AS n FROM f GROUP BY 1, 2) " + _SANITY.format("stddev_pop", ""))
def minisanity_all(spark, sf_dir):
    m = fo.minisanity_all(src.resid(spark, sf_dir))
    return m.select("key", *(r6(c).alias(c) for c in ("redchi2", "redchi2_std", "mean", "mean_std")), "ndof")


@query(f"WITH {EMB} SELECT a.s, round(sum(a.v * b.v), 6) AS v FROM f a JOIN f b ON b.s = a.s + 1 AND a.j = b.j GROUP BY a.s")
def vdot_pairs(spark, sf_dir):
    f = src.emb(spark, sf_dir).df
    return fo.vdot(f, f.withColumn("s", F.col("s") - 1), ["s", "j"], ("s",)).select("s", r6("v").alias("v"))


@query(f"WITH {EMB} SELECT a.j, b.j AS k, round(sum(a.v * b.v), 6) AS v FROM f a JOIN f b ON a.s = b.s GROUP BY a.j, b.j")
def gram_matrix(spark, sf_dir):
    f = src.emb(spark, sf_dir).df
    return fo.einsum(f, f.withColumnRenamed("j", "k"), ["s"], ["j", "k"]).select("j", "k", r6("v").alias("v"))


@query(f"WITH {EMB}, w AS (SELECT j::INT AS j, 1.0 / (1 + j) AS v FROM range(64) t(j)) SELECT f.s, round(sum(f.v * w.v), 6) AS v FROM f JOIN w USING (j) GROUP BY f.s")
def einsum_ij_j(spark, sf_dir):
    w = spark.range(64).select(F.col("id").cast("int").alias("j"), (1.0 / (1 + F.col("id"))).alias("v"))
    return fo.einsum(src.emb(spark, sf_dir).df, w, ["j"], ["s"]).select("s", r6("v").alias("v"))


@query(f"WITH {EMB}, d AS (SELECT s, j, least(j, 64 - j) AS d, v FROM f), g AS (SELECT s, d, sum(v) AS v FROM d GROUP BY 1, 2) SELECT d.s, d.j, round(g.v, 6) AS v FROM d JOIN g USING (s, d)")
def dof_gather_distribute(spark, sf_dir):
    f = src.emb(spark, sf_dir).df.withColumn("d", F.least("j", 64 - F.col("j")))
    f = f.withColumn("d", F.struct("s", "d"))
    return fo.distribute(fo.gather(f), f.drop("v")).select("s", "j", r6("v").alias("v"))


@query("WITH k AS (SELECT j, least(j, 64 - j) AS k FROM range(64) t(j)), b AS (SELECT j, (k > 1)::INT + (k > 8.75)::INT + (k > 16.5)::INT + (k > 24.25)::INT + (k > 32)::INT AS bin FROM k) SELECT bin, count(*) AS rho, min(j) AS first FROM b GROUP BY bin")
def binbounds_linear(spark, sf_dir):
    k = spark.range(64).select(F.col("id").alias("j"), F.least("id", 64 - F.col("id")).alias("k"))
    return k.groupBy(fo.bin_of(F.col("k"), fo.linear_bounds(6, 1, 32)).alias("bin")).agg(F.count("*").alias("rho"), F.min("j").alias("first"))


@query(f"WITH {COUNTS}, p AS (SELECT i AS p, i * 1.37 + 0.25 AS x FROM range(700) t(i)) SELECT p.p, round((1 - (x - floor(x))) * a.v + (x - floor(x)) * b.v, 6) AS v FROM p JOIN f a ON a.i = floor(x)::BIGINT % 720 JOIN f b ON b.i = (floor(x)::BIGINT + 1) % 720")
def interp_periodic_1d(spark, sf_dir):
    points = spark.range(700).select(F.col("id").alias("p"), (F.col("id") * 1.37 + 0.25).alias("x_i"))
    return fo.interpolate(src.counts_hour(spark, sf_dir), points).select("p", r6("v").alias("v"))


@query(f"""WITH {GRID}, p AS (SELECT k AS p, (k * 0.13 + 0.05) / 0.5 AS x, (k * 0.07 + 0.01) / 0.25 AS y FROM range(200) t(k)), q AS (SELECT *, floor(x)::BIGINT AS a, floor(y)::BIGINT AS b FROM p)
SELECT q.p, round(sum((CASE f.i WHEN a % 16 THEN 1 - (x - a) ELSE x - a END) * (CASE f.j WHEN b % 16 THEN 1 - (y - b) ELSE y - b END) * f.v), 5) AS v FROM q JOIN f ON f.i IN (a % 16, (a + 1) % 16) AND f.j IN (b % 16, (b + 1) % 16) GROUP BY q.p""")
def interp_periodic_2d(spark, sf_dir):
    points = spark.range(200).select(F.col("id").alias("p"), (F.col("id") * 0.13 + 0.05).alias("x_i"), (F.col("id") * 0.07 + 0.01).alias("x_j"))
    return fo.interpolate(src.grid2d(spark, sf_dir), points).select("p", F.round("v", 5).alias("v"))


@query(f"WITH {COUNTS}, p AS (SELECT i, i * 7.2 AS x, least(floor(i * 7.2), 718)::BIGINT AS c FROM range(100) t(i)) SELECT p.i, round((1 - (x - c)) * a.v + (x - c) * b.v, 6) AS v FROM p JOIN f a ON a.i = c JOIN f b ON b.i = c + 1")
def regrid_down(spark, sf_dir):
    return fo.regrid(src.counts_hour(spark, sf_dir), 100).df.select("i", r6("v").alias("v"))


@query(f"""WITH {GRID}, l AS (SELECT k AS p, 0.1 AS ai, 0.2 * k + 0.05 AS aj, 7.3 AS bi, CASE WHEN k = 15 THEN 9 ELSE 3.9 - 0.2 * k END AS bj FROM range(16) t(k)),
m AS (SELECT p, sqrt((bi - ai) * (bi - ai) + (bj - aj) * (bj - aj)) / 50 AS w, (ai + (m + 0.5) / 50 * (bi - ai)) * 15 / 16 / 0.5 AS x, (aj + (m + 0.5) / 50 * (bj - aj)) * 15 / 16 / 0.25 AS y FROM l, range(50) t(m)),
o AS (SELECT *, least(floor(x), 14)::BIGINT AS i0, least(floor(y), 14)::BIGINT AS j0 FROM m),
c AS (SELECT p, w, i0 + a AS i, j0 + b AS j, (CASE a WHEN 0 THEN 1 - (x - i0) ELSE x - i0 END) * (CASE b WHEN 0 THEN 1 - (y - j0) ELSE y - j0 END) AS u FROM o, range(2) ta(a), range(2) tb(b) WHERE x BETWEEN 0 AND 15 AND y BETWEEN 0 AND 15),
z AS (SELECT c.p, sum(c.w * c.u * f.v) AS v FROM c JOIN f USING (i, j) GROUP BY c.p), h AS (SELECT p, bool_and(x BETWEEN 0 AND 15 AND y BETWEEN 0 AND 15) AS whole FROM m GROUP BY p)
SELECT h.p, CASE WHEN h.whole THEN round(z.v, 5) ELSE 'NaN'::DOUBLE END AS v FROM h LEFT JOIN z USING (p)""")
def los_sampling(spark, sf_dir):
    end = F.when(F.col("id") == 15, 9.0).otherwise(3.9 - 0.2 * F.col("id"))
    lines = spark.range(16).select(F.col("id").alias("p"), F.lit(0.1).alias("a_i"), (0.2 * F.col("id") + 0.05).alias("a_j"), F.lit(7.3).alias("b_i"), end.alias("b_j"))
    return fo.line_of_sight(src.grid2d(spark, sf_dir), lines, 50).select("p", F.round("v", 5).alias("v"))


_PTW = {
    "ptw_smooth": {"sin": "sin(v)", "cos": "cos(v)", "tan": "tan(v)", "exp": "exp(v)", "expm1": "exp(v) - 1", "sinh": "(exp(v) - exp(-v)) / 2", "cosh": "(exp(v) + exp(-v)) / 2", "tanh": "tanh(v)", "arctan": "atan(v)", "sinc": "CASE WHEN v = 0 THEN 1 ELSE sin(pi() * v) / (pi() * v) END"},
    "ptw_steps": {"abs": "abs(v)", "sign": "sign(v)", "unitstep": "CASE WHEN v >= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", "sigmoid": "0.5 + 0.5 * tanh(v)", "softplus": "ln(1 + exp(v))"},
}


@query(f"""WITH {GRID}, l AS (SELECT p, 0.7::DOUBLE AS ai, (0.2 * p + 0.05)::DOUBLE / 0.25 + 0.5 AS aj, 14.4::DOUBLE AS si, (CASE WHEN p = 15 THEN 9.0 ELSE 3.9 - 0.2 * p END - 0.2 * p - 0.05)::DOUBLE / 0.25 AS sj FROM range(16) r(p)),
t AS (SELECT p, 0.0::DOUBLE AS t FROM l UNION SELECT p, 1.0::DOUBLE FROM l UNION SELECT p, (c - ai) / si FROM l, range(64) r(c) WHERE (c - ai) / si BETWEEN 0 AND 1 UNION SELECT p, (c - aj) / sj FROM l, range(64) r(c) WHERE (c - aj) / sj BETWEEN 0 AND 1),
s AS (SELECT p, t AS t0, lead(t) OVER (PARTITION BY p ORDER BY t) AS t1 FROM t),
m AS (SELECT p, floor(ai + (t0 + t1) / 2 * si)::BIGINT AS i, floor(aj + (t0 + t1) / 2 * sj)::BIGINT AS j, (t1 - t0) * sqrt(pow(si * 0.5, 2) + pow(sj * 0.25, 2)) AS w FROM s JOIN l USING (p) WHERE t1 IS NOT NULL),
z AS (SELECT p, sum(w * v) AS v FROM m JOIN f USING (i, j) GROUP BY p) SELECT l.p, round(coalesce(z.v, 0), 5) AS v FROM l LEFT JOIN z USING (p)""")
def los_exact(spark, sf_dir):
    end = F.when(F.col("id") == 15, 9.0).otherwise(3.9 - 0.2 * F.col("id"))
    lines = spark.range(16).select(F.col("id").alias("p"), F.lit(0.1).alias("a_i"), (0.2 * F.col("id") + 0.05).alias("a_j"), F.lit(7.3).alias("b_i"), end.alias("b_j"))
    return fo.exact_line_of_sight(src.grid2d(spark, sf_dir), lines).select("p", F.round("v", 5).alias("v"))


def _ptw(name: str):
    sql = ", ".join(f"round({x}, 6)::DOUBLE AS {k}" for k, x in _PTW[name].items())

    def run(spark, sf_dir):
        f = src.emb(spark, sf_dir).df
        return f.select("s", "j", *(F.round(pw.ptw(k, F.col("v")), 6).alias(k) for k in _PTW[name]))

    run.__name__ = name
    query(f"WITH {EMB} SELECT s, j, {sql} FROM f")(run)


_ptw("ptw_smooth")
_ptw("ptw_steps")


@query(f"WITH {EMB}, x AS (SELECT s, j, abs(v) + 0.5 AS v FROM f) SELECT s, j, round(sqrt(v), 6) AS sqrt, round(ln(v), 6) AS log, round(log10(v), 6) AS log10, round(ln(1 + v), 6) AS log1p, round(1 / v, 6) AS reciprocal, round(pow(v, 1.5), 6) AS power, round(pow(2.0, v), 6) AS exponentiate, round(greatest(least(v, 0.7), 0.55), 6) AS clip FROM x")
def ptw_log_family(spark, sf_dir):
    v = F.col("v")
    f = src.emb(spark, sf_dir).df.withColumn("v", F.abs("v") + 0.5)
    plain = [r6(pw.ptw(k, v)).alias(k) for k in ("sqrt", "log", "log10", "log1p", "reciprocal")]
    return f.select("s", "j", *plain, r6(pw.ptw("power", v, 1.5)).alias("power"), r6(pw.ptw("exponentiate", v, 2.0)).alias("exponentiate"), r6(pw.ptw("clip", v, 0.55, 0.7)).alias("clip"))


@query(f"WITH {EMB}, x AS (SELECT s, j, abs(v) + 0.5 AS v FROM f) SELECT s, j, round(0.5 / sqrt(v), 6) AS sqrt, round(1 / v, 6) AS log, round(1 / (1 + v), 6) AS log1p, round(1 - pow(tanh(v), 2), 6) AS tanh, round(0.5 - 0.5 * pow(tanh(v), 2), 6) AS sigmoid, round(-1 / (v * v), 6) AS reciprocal, round(1 / (1 + exp(-v)), 6) AS softplus, round(1 / (1 + v * v), 6) AS arctan, round(1 / pow(cos(v), 2), 6) AS tan FROM x")
def ptw_derivatives(spark, sf_dir):
    f = src.emb(spark, sf_dir).df.withColumn("v", F.abs("v") + 0.5)
    return f.select("s", "j", *(r6(pw.ptw_derivative(k, F.col("v"))).alias(k) for k in ("sqrt", "log", "log1p", "tanh", "sigmoid", "reciprocal", "softplus", "arctan", "tan")))


@query(f"WITH {RESID} SELECT key, s, count(*) AS n, round(avg(exp(ln(2.0) - 0.5 * ln(1.25) + sqrt(ln(1.25)) * r)), 6) AS lognormal, round(avg(3 + 0.5 * r), 6) AS normal FROM f GROUP BY 1, 2")
def normal_transform(spark, sf_dir):
    r = F.col("r")
    return src.resid(spark, sf_dir).groupBy("key", "s").agg(F.count("*").alias("n"), r6(F.avg(pw.lognormal(r, 2.0, 1.0))).alias("lognormal"), r6(F.avg(pw.normal(r, 3.0, 0.5))).alias("normal"))


@query(f"WITH {RESID} SELECT key, round(0.5 * sum(r * r * 2), 4) AS gaussian, round(0.5 * sum(r * r * (1 + s) - ln(1 + s)), 4) AS varcov, round(sum(0.5 * pow(r * (1 + s), 2) - ln(1 + s)), 3) AS varcov_std, round(sum(0.5 * 4 * ln(1 + r * r / 3)), 4) AS student, round(sum(0.5 * ln(r * r + 0.5) + 2 / (r * r + 0.5)), 4) AS inverse_gamma, round(0.5 * sum(r * r), 4) AS prior, round(-0.5 * sum(ln(2 * pi() * exp(1) * (r * r + 0.5) * (r * r + 0.5))), 3) AS entropy FROM f GROUP BY key")
def real_energies(spark, sf_dir):
    r, w = F.col("r"), (1 + F.col("s")).cast("double")
    x = r * r + 0.5
    agg = [(en.gaussian(r, 2.0), "gaussian", 4), (en.variable_gaussian(r, w), "varcov", 4), (en.variable_gaussian_std(r, w), "varcov_std", 3), (en.student_t(r, 3.0), "student", 4), (en.inverse_gamma(x, 2.0), "inverse_gamma", 4), (en.prior(r), "prior", 4), (en.entropy(x), "entropy", 3)]
    return src.resid(spark, sf_dir).groupBy("key").agg(*(F.round(e, d).alias(n) for e, n, d in agg))


@query("WITH f AS (SELECT quality AS d, 0.2 + 0.6 * ((doc_id % 7) / 7.0) AS p FROM labels) SELECT round(sum(-(d * ln(p)) + (d - 1) * ln(1 - p)), 6) AS energy, count(*) AS n FROM f")
def bernoulli_energy(spark, sf_dir):
    f = src.table(spark, sf_dir, "labels").select(F.col("quality").alias("d"), (0.2 + 0.6 * ((F.col("doc_id") % 7) / 7.0)).alias("p"))
    return f.agg(r6(en.bernoulli(F.col("d"), F.col("p"))).alias("energy"), F.count("*").alias("n"))


@query(f"WITH {EMB}, l AS (SELECT f.s, f.j, f.v, e.label FROM f JOIN embeddings e ON e.vec_id = f.s WHERE f.j < 10), m AS (SELECT s, ln(sum(exp(v))) AS z, max(CASE WHEN j = label THEN v END) AS own FROM l GROUP BY s) SELECT round(sum(z - own), 6) AS energy FROM m")
def categorical_energy_logits(spark, sf_dir):
    label = src.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("s"), "label")
    return en.categorical_logits(src.emb(spark, sf_dir).df.where("j < 10").join(label, "s"), "s", "j", "v", "label").select(r6("energy").alias("energy"))


@query(f"WITH {RESID}, e AS (SELECT s, 0.5 * sum(r * r) AS e FROM f GROUP BY s) SELECT round(avg(e), 4) AS energy, count(*) AS n_samples FROM e")
def averaged_energy(spark, sf_dir):
    e = src.resid(spark, sf_dir).groupBy("s").agg(en.gaussian(F.col("r")).alias("e"))
    return e.agg(F.round(F.avg("e"), 4).alias("energy"), F.count("*").alias("n_samples"))


@query(f"WITH {SERIES} SELECT k, row_number() OVER (PARTITION BY k ORDER BY t, id) AS n, round(1 + sum(sqrt(dt) * 0.5 * xi) OVER (PARTITION BY k ORDER BY t, id ROWS UNBOUNDED PRECEDING), 5) AS x FROM f UNION ALL SELECT DISTINCT k, 0, 1 FROM f")
def wiener_process(spark, sf_dir):
    return pr.wiener(src.user_series(spark, sf_dir), "k", ["t", "id"], 1.0, 0.5).select("k", "n", F.round("x", 5).alias("x"))


@query(f"""WITH {SERIES}, a AS (SELECT k, t, id, dt, xi, 0.5 * sqrt(dt) * (xi / 2) AS ds FROM f), b AS (SELECT *, 0.2 + sum(ds) OVER (PARTITION BY k ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS slope FROM a),
c AS (SELECT *, 0.5 * sqrt(dt) * xi * sqrt(dt * dt / 12 + 0.1) + dt * coalesce(lag(slope) OVER (PARTITION BY k ORDER BY t, id), 0.2) + 0.5 * dt * ds AS dx FROM b)
SELECT k, row_number() OVER (PARTITION BY k ORDER BY t, id) AS n, round(slope, 4) AS slope, round(1 + sum(dx) OVER (PARTITION BY k ORDER BY t, id ROWS UNBOUNDED PRECEDING), 4) AS x FROM c UNION ALL SELECT DISTINCT k, 0, 0.2, 1 FROM c""")
def integrated_wiener(spark, sf_dir):
    f = src.user_series(spark, sf_dir).withColumns({"xi0": F.col("xi"), "xi1": F.col("xi") / 2})
    return pr.integrated_wiener(f, "k", ["t", "id"], 0.5, 0.1, (1.0, 0.2)).select("k", "n", F.round("slope", 4).alias("slope"), F.round("x", 4).alias("x"))


@query(f"""WITH RECURSIVE {SERIES}, g AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY t, id) AS n, exp(-0.1 * dt) AS a, xi FROM f),
o(k, n, x) AS (SELECT DISTINCT k, 0::BIGINT, 0.3::DOUBLE FROM g UNION ALL SELECT g.k, g.n, g.a * o.x + 0.5 * sqrt(1 - g.a * g.a) * g.xi FROM o JOIN g ON g.k = o.k AND g.n = o.n + 1)
SELECT k, n, round(x, 5) AS x FROM o""")
def ornstein_uhlenbeck(spark, sf_dir):
    return pr.ornstein_uhlenbeck(src.user_series(spark, sf_dir), "k", ["t", "id"], 0.3, 0.5, 0.1).select("k", "n", F.round("x", 5).alias("x"))


_MODES = "SELECT s, k, sum(v * cos(2 * pi() * j * k / 64)) AS a, -sum(v * sin(2 * pi() * j * k / 64)) AS b FROM f, range(64) t(k) GROUP BY s, k"


@query(f"WITH {EMB} SELECT s, k::INT AS k, round(a + b, 6) AS v FROM ({_MODES})")
def hartley_arrow(spark, sf_dir):
    rows = spectra.rows_of(src.emb(spark, sf_dir).df, "s", "j")
    return spectra.hartley(rows, "s").select("s", F.posexplode("values").alias("k", "v")).select("s", "k", r6("v").alias("v"))


@query(f"WITH {EMB} SELECT s, least(k, 64 - k)::INT AS k, round(avg(a * a + b * b), 6) AS power FROM ({_MODES}) GROUP BY s, least(k, 64 - k)")
def power_spectrum(spark, sf_dir):
    rows = spectra.rows_of(src.emb(spark, sf_dir).df, "s", "j")
    return spectra.power_spectrum(rows, "s").select("s", "k", r6("power").alias("power"))


@query(f"WITH {EMB}, g AS (SELECT d, sum(exp(-8 * pi() * pi() * pow(least(k, 64 - k) / 64.0, 2)) * cos(2 * pi() * k * d / 64)) / 64 AS w FROM range(64) t(k), range(64) u(d) GROUP BY d) SELECT f.s, ((f.j + g.d) % 64)::INT AS j, round(sum(g.w * f.v), 6) + 0.0 AS v FROM f, g GROUP BY 1, 2")
def smooth_gaussian(spark, sf_dir):
    rows = spectra.rows_of(src.emb(spark, sf_dir).df, "s", "j")
    return spectra.smooth(rows, "s", 2.0).select("s", F.posexplode("values").alias("j", "v")).select("s", "j", (r6("v") + 0.0).alias("v"))


@query(f"WITH {COUNTS}, g AS (SELECT d, sum(cos(2 * pi() * k * d / 720) / (0.35 - 0.1 * cos(2 * pi() * k / 720))) / 720 AS w FROM range(720) t(k), range(720) u(d) GROUP BY d) SELECT (f.i + g.d) % 720 AS i, round(sum(g.w * f.v / 4), 5) AS v FROM f, g GROUP BY 1")
def wiener_filter(spark, sf_dir):
    got = solvers.wiener_filter(src.counts_hour(spark, sf_dir).df.select("i", F.col("v").cast("double")), 0.05, 4.0, src.HOURS, iterations=25)
    return got.select("i", F.round("v", 5).alias("v"))


@query(f"WITH {COUNTS} SELECT i, unnest(range(2 * i, 2 * i + 2)) AS child FROM f")
def grid_children(spark, sf_dir):
    f = src.counts_hour(spark, sf_dir)
    return f.df.select("i", F.explode(fo.children(f.axes[0], 2, F.col("i"))).alias("child"))


@query(f"WITH {COUNTS}, n AS (SELECT i, (unnest(range(i - 1, i + 2)) + 720) % 720 AS j FROM f) SELECT n.i, sum(f.v)::BIGINT AS v FROM n JOIN f ON f.i = n.j GROUP BY n.i")
def grid_neighborhood(spark, sf_dir):
    f = src.counts_hour(spark, sf_dir)
    near = f.df.select("i", F.explode(fo.neighbourhood(f.axes[0], 3, F.col("i"))).alias("j"))
    return near.join(f.df.select(F.col("i").alias("j"), "v"), "j").groupBy("i").agg(F.sum("v").alias("v"))


@query(f"WITH {GRID} SELECT i * 16 + j AS flat, round(v, 6) AS v FROM f")
def grid_flat_index(spark, sf_dir):
    g: Field = src.grid2d(spark, sf_dir)
    axes: tuple[Axis, ...] = g.axes
    return g.df.select(fo.flat_index(axes, [F.col("i"), F.col("j")]).alias("flat"), r6("v").alias("v"))


#: Events are spread over a sphere by their user and hour; the centre of each event's pixel is found from its ring index.
_PIX = "e AS (SELECT event_id, ((user_id * 7919 + event_id) % 12288)::BIGINT AS pix FROM events)"


def _pixels(spark, sf_dir):
    return src.table(spark, sf_dir, "events").select("event_id", F.pmod(F.col("user_id") * 7919 + F.col("event_id"), F.lit(12288)).cast("long").alias("pix"))


_EVEN = " + ".join(f"(((nest >> {2 * k}) & 1) << {k})" for k in range(5))
_ODD = " + ".join(f"(((nest >> {2 * k + 1}) & 1) << {k})" for k in range(5))


@query(f"""WITH {_PIX}, a AS (SELECT event_id, pix AS nest, pix // 1024 AS face, {_EVEN.replace("nest", "pix")} AS x, {_ODD.replace("nest", "pix")} AS y FROM e),
b AS (SELECT *, (CASE WHEN face < 4 THEN 2 WHEN face < 8 THEN 3 ELSE 4 END) * 32 - x - y - 1 AS jr, CASE WHEN face < 4 THEN 2 * face + 1 WHEN face < 8 THEN 2 * (face - 4) ELSE 2 * (face - 8) + 1 END AS jp FROM a),
c AS (SELECT *, CASE WHEN jr < 32 THEN jr WHEN jr > 96 THEN 128 - jr ELSE 32 END AS nr, CASE WHEN jr < 32 THEN 2 * jr * (jr - 1) WHEN jr > 96 THEN 12288 - 2 * (128 - jr + 1) * (128 - jr) ELSE 1984 + (jr - 32) * 128 END AS before, CASE WHEN jr < 32 OR jr > 96 THEN 0 ELSE (jr - 32) & 1 END AS shift FROM b),
d AS (SELECT *, (jp * nr + x - y + 1 + shift) // 2 AS p FROM c) SELECT event_id, nest, before + (CASE WHEN p > 4 * nr THEN p - 4 * nr WHEN p < 1 THEN p + 4 * nr ELSE p END) - 1 AS ring, nest AS back FROM d""")
def healpix_nest_ring_roundtrip(spark, sf_dir):
    e = _pixels(spark, sf_dir).select("event_id", F.col("pix").alias("nest"), hp.nest_to_ring(F.col("pix"), 32).alias("ring"))
    return e.select("event_id", "nest", "ring", hp.ring_to_nest(F.col("ring"), 32).alias("back"))


@query(f"""WITH {_PIX}, b AS (SELECT *, CASE WHEN pix < 1984 THEN floor((1 + sqrt(1 + 2 * pix)) / 2) WHEN pix >= 10304 THEN 128 - floor((1 + sqrt(24575 - 2 * pix)) / 2) ELSE 32 + (pix - 1984) // 128 END::BIGINT AS ring FROM e),
c AS (SELECT *, least(ring, 128 - ring, 32) AS nr, CASE WHEN ring < 32 THEN pix - 2 * ring * (ring - 1) WHEN ring > 96 THEN pix - 12288 + 2 * (128 - ring) * (129 - ring) ELSE (pix - 1984) % 128 END AS j FROM b)
SELECT event_id, round(CASE WHEN ring < 32 THEN 1 - nr * nr / 3072.0::DOUBLE WHEN ring > 96 THEN nr * nr / 3072.0::DOUBLE - 1 ELSE (64 - ring) / 48.0::DOUBLE END, 6) AS z,
round((j + CASE WHEN ring < 32 OR ring > 96 OR ring % 2 = 0 THEN 0.5 ELSE 0 END)::DOUBLE * pi() / (2 * nr), 6) AS phi, pix FROM c""")
def healpix_angles(spark, sf_dir):
    e = _pixels(spark, sf_dir).select("event_id", hp.place_to_angle(hp.ring_place(F.col("pix"), 32), 32).alias("a"))
    e = e.select("event_id", "a", hp.cell_place(hp.angle_to_cell(F.col("a.z"), F.col("a.phi"), 32), 32).alias("p"))
    return e.select("event_id", r6("a.z").alias("z"), r6("a.phi").alias("phi"), hp.place_to_ring(F.col("p"), 32).alias("pix"))


@query(f"WITH {EMB}, m AS (SELECT j, avg(v) AS m FROM f GROUP BY j), r AS (SELECT s, j, m + (v - m) / 2 AS p, m - (v - m) / 2 AS q FROM f JOIN m USING (j)), u AS (SELECT j, p AS v FROM r UNION ALL SELECT j, q FROM r) SELECT j, round(avg(v), 6) + 0.0 AS mean, round(var_samp(v), 6) AS variance FROM u GROUP BY j")
def residual_samples(spark, sf_dir):
    f = samples.Samples(src.emb(spark, sf_dir).df, ("j",))
    mean = f.average().withColumnRenamed("mean", "v")
    half = samples.Samples(f.df.join(mean.withColumnRenamed("v", "m"), "j").select("s", "j", ((F.col("v") - F.col("m")) / 2).alias("v")), ("j",))
    return samples.residual(mean, samples.mirrored(half)).stat().select("j", (r6("mean") + 0.0).alias("mean"), r6("variance").alias("variance"))


@query()
def wiener_posterior_samples(spark, sf_dir):
    """Residuals of 16 samples around `wiener_filter`'s mean."""
    f = src.counts_hour(spark, sf_dir)
    return inference.residual_samples(f.df.select("i", F.lit(0.25).alias("m")), src.HOURS, 0.05, 16, seed=1, iterations=25)


# composed operators

_I = ("i",)


@query(f"WITH {COUNTS} SELECT i, 2.0 * (i % 7 + 1) * v - 0.5 * v AS v FROM f WHERE i % 24 >= 6 UNION ALL SELECT i, -0.5 * v FROM f WHERE i % 24 < 6")
def operator_chain(spark, sf_dir):
    x = src.counts_hour(spark, sf_dir).df.withColumn("v", F.col("v").cast("double"))
    values = x.select("i", (F.col("i") % 7 + 1).cast("double").alias("v"))
    op = al.scaling(2.0, _I) @ al.diagonal(values, _I) @ al.masking(_I, F.col("i") % 24 < 6) - al.scaling(0.5, _I)
    return op(x)


@query("SELECT r_regionkey AS r, n_nationkey AS n, (r_regionkey + 1.0::DOUBLE) * n_regionkey AS v FROM region, nation")
def outer_product(spark, sf_dir):
    r = src.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"), (F.col("r_regionkey") + 1.0).alias("v"))
    n = src.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").cast("double").alias("v"))
    return al.outer(r, ("r",), ("n",))(n)


@query(f"WITH {GRID} SELECT i, j, round(v * 0.125 * 0.125, 6) AS v FROM f")
def weight_applier(spark, sf_dir):
    f = src.grid2d(spark, sf_dir)
    return al.weighting(f.axes, 2)(f.df).select("i", "j", r6("v").alias("v"))


@query(f"WITH {EMB} SELECT s, round(product(1 + v / 10), 6) AS v FROM f GROUP BY s")
def field_product(spark, sf_dir):
    return fo.product(src.emb(spark, sf_dir).df.withColumn("v", 1 + F.col("v") / 10), ["s"]).select("s", r6("v").alias("v"))


@query(f"WITH {COUNTS} SELECT 'early' AS key, i, v::DOUBLE AS v FROM f WHERE i < 400 UNION ALL SELECT 'late', i, v::DOUBLE FROM f WHERE i >= 300")
def split_parts(spark, sf_dir):
    x = src.counts_hour(spark, sf_dir).df.withColumn("v", F.col("v").cast("double"))
    return al.split(_I, {"early": F.col("i") < 400, "late": F.col("i") >= 300})(x)


@query(f"WITH {COUNTS} SELECT p, f.v::DOUBLE AS v FROM (SELECT o_orderkey AS p, o_orderkey % 720 AS i FROM orders) o JOIN f USING (i)")
def extract_at_indices(spark, sf_dir):
    x = src.counts_hour(spark, sf_dir).df.withColumn("v", F.col("v").cast("double"))
    places = src.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("p"), F.pmod("o_orderkey", F.lit(720)).cast("long").alias("i"))
    return al.pick(_I, "i", places)(x)


@query(f"WITH {GRID}, h AS (SELECT CASE WHEN i >= 8 THEN i + 4 ELSE i END AS i, CASE WHEN j >= 8 THEN j + 8 ELSE j END AS j, v FROM f) SELECT a.i, b.j, round(coalesce(h.v, 0), 6) AS v FROM range(20) a(i) CROSS JOIN range(24) b(j) LEFT JOIN h ON h.i = a.i AND h.j = b.j")
def pad_two_axes(spark, sf_dir):
    f = src.grid2d(spark, sf_dir)
    padded = al.padding(("i", "j"), {"i": (16, 20), "j": (16, 24)}, central=True)(f.df)
    return src.dense(Field(padded, (Axis("i", 20), Axis("j", 24)))).df.select("i", "j", r6("v").alias("v"))


@query(f"WITH {TYPES} SELECT round(sum(abs(v)), 6) AS norm1, round(sqrt(sum(v * v)), 6) AS norm2, max(abs(v)) AS norm_inf, sum(v) AS total, bool_and(v <> 0) AS all_nonzero, bool_or(v <> 0) AS any_nonzero, sum(v * v * 2) AS vdot FROM t")
def multifield_reductions(spark, sf_dir):
    return fo.multi_statistics(src.type_hour(spark, sf_dir).withColumn("w", 2 * F.col("v")), "v", "w").select(r6("norm1").alias("norm1"), r6("norm2").alias("norm2"), "norm_inf", "total", "all_nonzero", "any_nonzero", "vdot")


@query(f"WITH {TYPES} SELECT key, i, least(greatest(v, 2.0), 5.0)::DOUBLE AS v FROM t")
def multifield_clip(spark, sf_dir):
    t = src.type_hour(spark, sf_dir)
    return t.select("key", "i", pw.ptw("clip", F.col("v"), 2.0, 5.0).alias("v"))


@query(f"WITH {TYPES}, a AS (SELECT * FROM t WHERE i < 400), b AS (SELECT * FROM t WHERE key < 'd') SELECT coalesce(a.key, b.key) AS key, coalesce(a.i, b.i) AS i, coalesce(a.v, 0) - coalesce(b.v, 0) AS v FROM a FULL JOIN b ON a.key = b.key AND a.i = b.i")
def flexible_subtract(spark, sf_dir):
    t = src.type_hour(spark, sf_dir)
    return al.add(t.where("i < 400"), t.where("key < 'd'"), ("key", "i"), 1.0, -1.0)


@query(f"WITH {TYPES} SELECT 'pre_' || key AS key, i, CASE WHEN key < 'd' THEN 3 * v ELSE v END AS v FROM t WHERE key IN (SELECT DISTINCT key FROM t WHERE key < 'q')")
def block_diagonal_keys(spark, sf_dir):
    t = src.type_hour(spark, sf_dir)
    kept = [r["key"] for r in t.where("key < 'q'").select("key").distinct().collect()]
    op = al.prepend("pre_", ("key", "i")) @ al.block_diagonal({k: al.scaling(3.0 if k < "d" else 1.0, _I) for k in kept})
    return op(t)


@query(f"WITH {COUNTS} SELECT a.i, 2.0 * a.v - coalesce(b.v, 0) - coalesce(c.v, 0) AS v FROM f a LEFT JOIN f b ON b.i = a.i - 1 LEFT JOIN f c ON c.i = a.i + 1")
def toeplitz_product(spark, sf_dir):
    x = src.counts_hour(spark, sf_dir).df.withColumn("v", F.col("v").cast("double"))
    lags = spark.range(2).select(F.col("id").alias("lag"), (2.0 - 3.0 * F.col("id")).alias("v"))
    return al.toeplitz(lags, Axis("i", 720), _I)(x)


@query("WITH RECURSIVE d AS (SELECT DISTINCT round(p_retailprice, 2)::DOUBLE AS v FROM part), u(v) AS (SELECT min(v) FROM d UNION ALL SELECT (SELECT min(d.v) FROM d WHERE d.v > u.v AND abs(u.v - d.v) > 5 + 0.01 * abs(d.v)) FROM u WHERE u.v IS NOT NULL) SELECT v AS u, row_number() OVER (ORDER BY v) - 1 AS n FROM u WHERE v IS NOT NULL")
def tolerance_unique(spark, sf_dir):
    p = src.table(spark, sf_dir, "part").select(F.round("p_retailprice", 2).cast("double").alias("v"))
    return nu.unique(p, "v", "v", 5.0, 0.01).select("u", "n").distinct()


_GRID_MODES = "m AS (SELECT k.k, q.q, sum(v * cos(2 * pi() * (i * k.k + j * q.q) / 16)) AS a, -sum(v * sin(2 * pi() * (i * k.k + j * q.q) / 16)) AS b FROM f, range(16) k(k), range(16) q(q) GROUP BY 1, 2)"
_GRID_SPACE = Regular((16, 16), (0.5, 0.25))


@query(f"WITH {GRID}, {_GRID_MODES} SELECT k AS i, q AS j, round(a / 8, 5) AS re, round(b / 8, 5) AS im FROM m")
def fft_two_axes(spark, sf_dir):
    f = src.grid2d(spark, sf_dir)
    return ha.fft(ha.complex_of(f.df, ("i", "j")), f.axes).select("i", "j", (F.round("re", 5) + 0.0).alias("re"), (F.round("im", 5) + 0.0).alias("im"))


@query(f"WITH {GRID}, {_GRID_MODES} SELECT k AS i, q AS j, round(a + b, 5) AS v FROM m")
def hartley_two_axes(spark, sf_dir):
    f = src.grid2d(spark, sf_dir)
    return ha.hartley(f.df, f.axes).select("i", "j", (F.round("v", 5) + 0.0).alias("v"))


@query(f"WITH {GRID} SELECT (i + 8) % 16 AS i, (j + 8) % 16 AS j, round(v, 6) AS v FROM f")
def fft_shift(spark, sf_dir):
    f = src.grid2d(spark, sf_dir)
    return al.shift(("i", "j"), f.axes)(f.df).select("i", "j", r6("v").alias("v"))


_LENGTH = "round(sqrt(pow(least(k, 16 - k) / 8.0, 2) + pow(least(q, 16 - q) / 4.0, 2)), 9)"


@query(f"WITH {GRID}, {_GRID_MODES}, p AS (SELECT {_LENGTH} AS l, (a * a + b * b) / 64 AS p FROM m), r AS (SELECT dense_rank() OVER (ORDER BY l) - 1 AS bin, p, l FROM p) SELECT bin, count(*) AS rho, round(avg(l), 6) AS k, round(avg(p), 4) AS power FROM r GROUP BY bin")
def power_analyze_two_axes(spark, sf_dir):
    bins = Power(_GRID_SPACE.codomain).table(spark)
    return ha.power_analyze(src.grid2d(spark, sf_dir).df, _GRID_SPACE).join(bins, "bin").select("bin", "rho", r6("k").alias("k"), F.round("power", 4).alias("power"))


_BOUNDS = tuple(bounds_of(_GRID_SPACE.codomain.unique_lengths(), False, 5))


@query(f"WITH {GRID}, {_GRID_MODES}, p AS (SELECT sqrt(pow(least(k, 16 - k) / 8.0, 2) + pow(least(q, 16 - q) / 4.0, 2)) AS l, (a * a + b * b) / 64 AS p FROM m) SELECT {' + '.join(f'(l > {b!r})::BIGINT' for b in _BOUNDS)} AS bin, count(*) AS rho, round(avg(p), 4) AS power FROM p GROUP BY 1")
def power_analyze_bins(spark, sf_dir):
    bins = Power(_GRID_SPACE.codomain, _BOUNDS).table(spark)
    return ha.power_analyze(src.grid2d(spark, sf_dir).df, _GRID_SPACE, _BOUNDS).join(bins, "bin").select("bin", "rho", F.round("power", 4).alias("power"))


@query(f"WITH {EMB}, a AS (SELECT s, j, v * CASE WHEN j = 0 THEN 64 * 0.3 ELSE 0.7 * 8 * exp(-0.75 * ln(1 + pow(least(j, 64 - j) / 64.0 / 0.1, 2))) END AS v FROM f), m AS (SELECT s, k, sum(v * cos(2 * pi() * j * k / 64)) - sum(v * sin(2 * pi() * j * k / 64)) AS h FROM a, range(64) t(k) GROUP BY s, k) SELECT s, k AS j, round(1.5 + h / 64, 6) AS v FROM m")
def correlated_field_rows(spark, sf_dir):
    line = Regular((64,), (1.0,), names=("j",))
    xi = src.emb(spark, sf_dir).df
    return ha.correlated_field(xi, line, ha.matern_amplitude(line, 0.7, 0.1, -3.0), 1.5, 0.3, ("s", "j")).select("s", "j", r6("v").alias("v"))


@query("SELECT round(sum(2.5 * ln(1 + pow((l_discount - 0.05) * (20 + l_linenumber), 2) / 4) - ln(20 + l_linenumber)), 3) AS energy FROM lineitem")
def variable_student_t(spark, sf_dir):
    d = src.table(spark, sf_dir, "lineitem")
    return d.agg(F.round(li.variable_student_t(F.col("l_discount").cast("double"), F.lit(0.05), 20.0 + F.col("l_linenumber"), 4.0), 3).alias("energy"))


@query("SELECT round(sum(0.5 * (pow(30 * (l_discount - 0.05) + 10 * (l_tax - 0.04), 2) + pow(40 * (l_tax - 0.04), 2)) - ln(30) - ln(40)), 3) AS energy FROM lineitem")
def vector_gaussian(spark, sf_dir):
    r = [F.col("l_discount").cast("double") - 0.05, F.col("l_tax").cast("double") - 0.04]
    root = [[F.lit(30.0), F.lit(0.0)], [F.lit(10.0), F.lit(40.0)]]
    return src.table(spark, sf_dir, "lineitem").agg(F.round(li.vector_gaussian(r, root), 3).alias("energy"))


@query("WITH x AS (SELECT floor(ln(p_retailprice / 500) / ln(5.0) * 40)::BIGINT AS cell FROM part WHERE p_retailprice >= 500), c AS (SELECT cell, count(*) AS n FROM x WHERE cell < 40 GROUP BY cell) SELECT cell, n, round(500 * exp((cell + 0.5) / 40 * ln(5.0)), 6) AS r, round(500 * exp((cell + 1) / 40.0 * ln(5.0)) - 500 * exp(cell / 40.0 * ln(5.0)), 6) AS width FROM c")
def log_grid(spark, sf_dir):
    axis = LogAxis(40, 500.0, 2500.0)
    n = src.table(spark, sf_dir, "part").select(axis.cell(F.col("p_retailprice").cast("double")).alias("cell")).where("cell is not null").groupBy("cell").agg(F.count("*").alias("n"))
    return n.select("cell", "n", r6(axis.coordinate(F.col("cell"))).alias("r"), r6(axis.volume(F.col("cell"))).alias("width"))


@query(f"WITH {COUNTS} SELECT (i - 1) * 2 + c AS child, v FROM f, range(2) t(c) WHERE i BETWEEN 1 AND 718")
def open_grid_children(spark, sf_dir):
    f = src.counts_hour(spark, sf_dir).df
    return f.select(F.explode(OpenAxis(720).children(F.col("i"))).alias("child"), "v")


# spectra bin by bin, refinement, the sphere, points off the grid, streams

_LINE = Regular((64,), (1.0,), names=("j",))
_WIENER_PATH = """x AS (SELECT s, (2 + j // 2)::BIGINT AS bin, max(v) FILTER (WHERE j % 2 = 0) AS x0, max(v) FILTER (WHERE j % 2 = 1) AS x1 FROM f WHERE j < 62 GROUP BY 1, 2),
e AS (SELECT *, ln(bin) - ln(bin - 1) AS dt, 0.4 * sqrt(ln(bin) - ln(bin - 1)) * x1 AS ds FROM x),
g AS (SELECT *, sum(ds) OVER (PARTITION BY s ORDER BY bin ROWS UNBOUNDED PRECEDING) AS sl FROM e),
h AS (SELECT *, 0.4 * sqrt(dt) * x0 * sqrt(dt * dt / 12 + 0.2) + dt * coalesce(lag(sl) OVER (PARTITION BY s ORDER BY bin), 0) + 0.5 * dt * ds AS dx FROM g),
p AS (SELECT s, bin, sum(dx) OVER (PARTITION BY s ORDER BY bin ROWS UNBOUNDED PRECEDING) AS x FROM h UNION ALL SELECT DISTINCT s, 1, 0.0 FROM x),
l AS (SELECT s, max(x) FILTER (WHERE bin = 32) AS last FROM p GROUP BY s),
q AS (SELECT p.s, p.bin, CASE WHEN p.bin = 32 THEN 1 ELSE 2 END AS rho, exp(-1.5 * ln(p.bin) + p.x - l.last * ln(p.bin) / ln(32)) AS y FROM p JOIN l USING (s)),
n AS (SELECT s, sum(rho * y * y) AS n FROM q GROUP BY s)"""


@query(f"WITH {EMB}, {_WIENER_PATH} SELECT s, bin, round(0.7 * 64 / sqrt(n) * y, 6) AS v FROM q JOIN n USING (s) UNION ALL SELECT DISTINCT s, 0, 64 FROM f")
def nonparametric_amplitude(spark, sf_dir):
    f = src.emb(spark, sf_dir).df.where("j < 62")
    xi = f.groupBy("s", (2 + F.floor(F.col("j") / 2)).alias("bin")).agg(F.max(F.when(F.col("j") % 2 == 0, F.col("v"))).alias("xi0"), F.max(F.when(F.col("j") % 2 == 1, F.col("v"))).alias("xi1"))
    return co.nonparametric_amplitude(spark, _LINE, -1.5, 0.7, xi, 0.4, 0.2).select("s", "bin", r6("v").alias("v"))


_SPACE_I, _SPACE_J = Regular((16,), (0.5,), names=("i",)), Regular((16,), (0.25,), names=("j",))


@query(f"""WITH {GRID}, n AS (SELECT sum(CASE WHEN q = 8 THEN 1 ELSE 2 END * pow(q, -3)) AS n FROM range(1, 9) t(q)),
a AS (SELECT i AS k, j AS q, 0.5 * v * CASE WHEN i = 0 THEN 8 ELSE 2 * 0.7 * sqrt(8) * exp(-0.75 * ln(1 + pow(least(i, 16 - i) / 8.0 / 0.1, 2))) END * CASE WHEN j = 0 THEN 4 ELSE 2 * 0.6 * 4 / sqrt(n) * pow(least(j, 16 - j), -1.5) END AS v FROM f, n),
b AS (SELECT r.i, a.q, sum(a.v * (cos(2 * pi() * a.k * r.i / 16) - sin(2 * pi() * a.k * r.i / 16))) AS v FROM a, range(16) r(i) GROUP BY 1, 2)
SELECT b.i, r.j, round(2 + sum(b.v * (cos(2 * pi() * b.q * r.j / 16) - sin(2 * pi() * b.q * r.j / 16))) / 32, 4) AS v FROM b, range(16) r(j) GROUP BY 1, 2""")
def correlated_field_product(spark, sf_dir):
    parts = [(_SPACE_I, co.tabulated(spark, _SPACE_I, ha.matern_amplitude(_SPACE_I, 0.7, 0.1, -3.0))), (_SPACE_J, co.nonparametric_amplitude(spark, _SPACE_J, -1.5, 0.6))]
    return co.field(src.grid2d(spark, sf_dir).df, parts, 2.0, 0.5).select("i", "j", F.round("v", 4).alias("v"))


_NEAR, _FAR, _WHOLE = (math.sinh(x / 1.5) for x in (0.25, 0.75, 1.0))


@query(f"WITH {COUNTS} SELECT 2 * (f.i - 1) + c AS i, round({_FAR / _WHOLE!r} * f.v + {_NEAR / _WHOLE!r} * g.v + {1.5 * math.sqrt(2 * _NEAR * _FAR / _WHOLE)!r} * ((2 * (f.i - 1) + c) % 7 - 3) / 4.0, 6) AS v FROM f, range(2) t(c), f g WHERE g.i = f.i + 2 * c - 1 AND f.i BETWEEN 1 AND 718")
def refine_exponential(spark, sf_dir):
    """Given its neighbours, a process of exponential covariance is a bridge between the nearest two."""
    level = re.Level("i", 720, padding=1)
    xi = spark.range(level.refined().size).select(F.col("id").alias("i"), ((F.col("id") % 7 - 3) / 4.0).alias("v"))
    return re.refine(src.counts_hour(spark, sf_dir).df, xi, (level,), re.matern(1.5, 1.5, 0.5)).select("i", r6("v").alias("v"))


@query(f"""WITH {GRID}, c AS (SELECT {', '.join(f'max(v) FILTER (WHERE j = {k}) AS c{k}' for k in range(9))} FROM f WHERE i = 0),
r AS (SELECT r, CASE WHEN r IN (1, 7) THEN 4 ELSE 8 END AS n, CASE r WHEN 1 THEN 11 / 12.0 WHEN 7 THEN -11 / 12.0 ELSE (4 - r) / 3.0 END AS z, CASE WHEN r IN (1, 7) OR r % 2 = 0 THEN 0.5 ELSE 0 END AS o, CASE WHEN r = 1 THEN 0 WHEN r = 7 THEN 44 ELSE 8 * r - 12 END AS b FROM range(1, 8) t(r)),
p AS (SELECT b + j AS i, z::DOUBLE AS z, sqrt(1 - z * z)::DOUBLE AS s, 2 * pi() * (j + o) / n AS h FROM r, range(8) u(j) WHERE j < n)
SELECT i, round((c0 * sqrt(1 / (4 * pi())) + c1 * sqrt(3 / (4 * pi())) * z + c2 * sqrt(5 / (16 * pi())) * (3 * z * z - 1) - sqrt(2) * (c3 * cos(h) - c4 * sin(h)) * sqrt(3 / (8 * pi())) * s
- sqrt(2) * (c5 * cos(h) - c6 * sin(h)) * sqrt(15 / (8 * pi())) * s * z + sqrt(2) * (c7 * cos(2 * h) - c8 * sin(2 * h)) * sqrt(15 / (32 * pi())) * s * s) / sqrt(4 * pi()), 6) AS v FROM p, c""")
def spherical_synthesis(spark, sf_dir):
    """The first row of the grid as modes up to degree 2, on 48 pixels."""
    modes = src.grid2d(spark, sf_dir).df.where("i = 0 and j < 9").select(F.col("j").alias("i"), "v")
    return sphere.synthesis(modes, Modes(2), Pixels(2)).select("i", r6("v").alias("v"))


@query(f"WITH {GRID}, x AS (SELECT p, p / 37.0::DOUBLE AS x, (p * p % 11) / 11.0::DOUBLE - 0.3 AS y FROM range(50) t(p)) SELECT p, round(sum(v * cos(2 * pi() * ((i - 8) * x + (j - 8) * y))), 4) AS re, round(-sum(v * sin(2 * pi() * ((i - 8) * x + (j - 8) * y))), 4) AS im FROM f, x GROUP BY p")
def fourier_at_points(spark, sf_dir):
    f = src.grid2d(spark, sf_dir)
    points = spark.range(50).select(F.col("id").alias("p"), (F.col("id") / 37.0).alias("x_i"), ((F.col("id") * F.col("id") % 11) / 11.0 - 0.3).alias("x_j"))
    return no.at_points(ha.complex_of(f.df, ("i", "j")), points, f.axes).select("p", F.round("re", 4).alias("re"), F.round("im", 4).alias("im"))


@query("SELECT neighbours, pixels FROM (VALUES (7, 24::BIGINT), (8, 744::BIGINT)) t(neighbours, pixels)")
def healpix_neighbour_counts(spark, sf_dir):
    n = F.size(hp.neighbours(hp.nest_to_cell(F.col("id"), 8), 8))
    return spark.range(768).select(n.alias("neighbours")).groupBy("neighbours").agg(F.count("*").alias("pixels"))


@query("SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def stream_hourly_counts(spark, sf_dir):
    """The table read as a stream, to its end."""
    got = st.drained(st.window_counts(st.opened(spark, f"{sf_dir}/events.parque[t]"), ["event_type"]))
    return got.select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(var_samp(value), 0), 6) AS variance FROM events GROUP BY 1")
def stream_moments(spark, sf_dir):
    got = st.drained(st.running_moments(st.opened(spark, f"{sf_dir}/events.parque[t]"), "event_type", "value"))
    return got.select("event_type", "n", r6("mean").alias("mean"), r6("variance").alias("variance"))
