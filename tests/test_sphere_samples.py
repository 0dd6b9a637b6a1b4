"""Index arithmetic on the sphere for whole pixelisations, and sample lists written and read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import healpix as hp
from gridloom.sources import samples


@pytest.mark.parametrize("nside", [1, 2, 8])
def test_orders_and_centres(spark, nside):
    n = hp.npix_of(nside)
    df = spark.range(n).select(F.col("id").alias("p"), hp.nest_to_ring(F.col("id"), nside).alias("r"), hp.ring_place(F.col("id"), nside).alias("at"))
    df = df.select("p", "r", hp.ring_to_nest(F.col("r"), nside).alias("back"), hp.place_to_angle(F.col("at"), nside).alias("a"))
    df = df.select("*", hp.place_to_ring(hp.cell_place(hp.angle_to_cell(F.col("a.z"), F.col("a.phi"), nside), nside), nside).alias("found"), hp.angle_to_vector(F.col("a.z"), F.col("a.phi")).alias("v"))
    got = df.select("p", "r", "back", "found", "a.z", "v.x", "v.y", F.col("v.z").alias("vz")).orderBy("p").toPandas()
    assert sorted(got.r) == list(range(n)) and (got.back == got.p).all() and (got.found == got.p).all()
    # centres spread evenly: first moments vanish, second ones are a third up to the size of a pixel
    v = got[["x", "y", "vz"]].to_numpy()
    assert np.abs(v.mean(axis=0)).max() < 1e-12 and np.abs((v**2).mean(axis=0) - 1 / 3).max() < 0.2 / nside**2
    assert (np.diff(got.z) <= 1e-12).all()


def test_four_children_share_a_parent_in_space(spark):
    df = spark.range(12 * 64).select(hp.nest_to_cell(F.col("id"), 8).alias("c"), hp.nest_to_cell(F.shiftright("id", 2), 4).alias("d"))
    assert df.where("c.face <> d.face or c.x div 2 <> d.x or c.y div 2 <> d.y").isEmpty()


def test_numbers_of_pixels_and_vectors(spark):
    assert hp.nside_of(768) == 8 and hp.order_of(8) == 3
    for bad in (lambda: hp.nside_of(700), lambda: hp.order_of(6)):
        with pytest.raises(ValueError):
            bad()
    row = spark.range(1).select(hp.vector_to_angle(F.lit(0.0), F.lit(-2.0), F.lit(0.0)).alias("a"), hp.isqrt(F.lit(2**60 - 1).cast("long")).alias("r")).first()
    assert row.a.z == 0 and abs(row.a.phi - 1.5 * np.pi) < 1e-12 and row.r == 2**30 - 1


def test_samples_round_trip(spark, tmp_path):
    df = spark.range(12).select((F.col("id") % 3).alias("s"), F.floor(F.col("id") / 3).alias("i"), (F.col("id") * 0.5).alias("v"))
    x = samples.Samples(df, ("i",))
    x.save(str(tmp_path / "a"), stat=True)
    y = samples.load(spark, str(tmp_path / "a"))
    assert x.equals(y) and y.index == ("i",) and not x.equals(x.map(lambda c: c + 1))
    assert spark.read.parquet(str(tmp_path / "a" / "stat")).count() == 4
    assert [r.s for r in y.iterator()] == sorted(r.s for r in df.collect())
    assert [r.variance for r in samples.Samples(df.where("s = 0"), ("i",)).stat().collect()] == [0.0] * 4
    with pytest.raises(Exception, match="exist"):
        x.save(str(tmp_path / "a"))
