"""Functions against fixed vectors."""

from __future__ import annotations

import pytest
from geoloom.functions import hashing as h
from geoloom.functions import project as p
from geoloom.functions import scalar as s
from pyspark.sql import functions as F


def value(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


@pytest.mark.parametrize("x, y, z, want", [(0, 0, 0, 0), (1, 5, 2, -100077127696415), (-7, 0, 13, 125444078969910), (123456, 2, -654321, 84656453419489)])
def test_seed_from_coords(spark, x, y, z, want):
    assert value(spark, h.seed_from_coords(F.lit(x), y, F.lit(z))) == want


def test_hashes(spark):
    assert value(spark, h.mix64(F.lit(1).cast("bigint"))) == -5451962507482445012
    assert value(spark, h.hash_unit(F.lit(3), F.lit(-4), h.WARP_SEED_X)) == pytest.approx(0.7835063440890188, abs=1e-15)
    assert value(spark, h.value_noise(F.lit(1.25), F.lit(-2.5), h.WARP_SEED_X)) == pytest.approx(-0.1488815419449876, abs=1e-12)
    for x, z, salt, want in ((0, 0, 0x6D2B79F5, -1127711062), (10, -3, 0x6D2B79F5, -454421144), (10, -3, 0x7F4A7C15, -2124364483)):
        assert value(spark, h.mix_hash32(F.lit(x), F.lit(z), salt)) == want
    for seed, want in ((42, (30, 130, 2)), (-7, (62, 62, 1)), (123456789, (65, 165, 1))):
        assert value(spark, *[h.lcg_next_int(F.lit(seed), n) for n in (100, 200, 3)]) == want


@pytest.mark.parametrize("z, x, y, want", [(0, 0, 0, 0), (1, 0, 0, 1), (1, 0, 1, 2), (1, 1, 1, 3), (1, 1, 0, 4), (2, 0, 0, 5), (2, 3, 0, 20), (3, 5, 2, 76), (12, 2048, 1361, 19853054), (1, 2, 0, None), (40, 0, 0, None)])
def test_hilbert_id(spark, z, x, y, want):
    assert value(spark, p.hilbert_id(F.lit(z), F.lit(x), F.lit(y))) == want


def test_scales_and_tiles(spark):
    assert value(spark, *[p.zoom_for_scale(F.lit(float(v)), 0, 30) for v in (1, 10, 35, 500, 40000)]) == (17, 14, 12, 8, 2)
    assert [p.downsample_step(v, 30.0) for v in (35.0, 500.0, 40000.0)] == [1, 4, 256]
    assert [p.downsample_step(v, 10.0) for v in (35.0, 500.0, 40000.0)] == [1, 12, 256]
    assert value(spark, *p.lonlat_to_block(F.lit(86.925), F.lit(27.9881), 35.0)) == (276469, -89018)
    assert value(spark, *p.mercator_tile(F.lit(86.925), F.lit(27.9881), 12)) == (3037, 1716)
    assert value(spark, *[s.terrarium_decode(*map(F.lit, v)) for v in ((128, 0, 0), (162, 144, 128), (127, 255, 0))]) == (0, 8849, -1)
    none = F.lit(None).cast("int")
    assert tuple(value(spark, s.height_limits(F.lit(35.0), F.lit(1.0), F.lit(1.0), F.lit(64), F.lit(-64), none))) == (-64, 432)


def test_mercator_round_trip(spark):
    df = spark.range(2000).select((F.col("id") % 360 - 179.5).alias("lon"), (F.col("id") / 2000 * 168 - 84).alias("lat"))
    x, y = p.mercator_xy(F.col("lon"), F.col("lat"), 9)
    back = df.select("lon", "lat", *[c.alias(n) for c, n in zip(p.pixel_to_lonlat(x * 256, y * 256, 9), ("lon2", "lat2"), strict=True)])
    assert back.filter("abs(lon - lon2) > 1e-8 or abs(lat - lat2) > 1e-8 or lon2 is null").count() == 0


def test_warp_leaves_fine_scales_alone(spark):
    x, z = h.domain_warp(F.lit(5), F.lit(6), 5000.0)
    assert value(spark, x, z) == (5.0, 6.0)
    x, z = h.domain_warp(F.lit(5), F.lit(6), 35.0)
    assert value(spark, F.abs(x - 5) <= 800 / 35, F.abs(z - 6) <= 800 / 35) == (True, True)
