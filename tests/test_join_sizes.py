"""Tables that grow with the input aren't broadcast, however small Spark takes them for."""

from __future__ import annotations

import re

import pytest
from geoloom.operators import focal, graph, ranges, sampling, water
from geoloom.operators.storage import stored
from pyspark.sql import functions as F


@pytest.fixture
def cells(spark, tmp_path):
    """A table on disk that Spark takes for a few kilobytes: its files are compressed."""
    frame = spark.range(4096).select((F.col("id") % 64).alias("x"), F.floor(F.col("id") / 64).alias("y"), F.lit(3).cast("bigint").alias("elev_m"), F.lit(80).alias("cover"), F.lit(1).alias("land"))
    frame.write.parquet(f"{tmp_path}/cells")
    return spark.read.parquet(f"{tmp_path}/cells")


def broadcasts(df) -> int:
    return len(re.findall("BroadcastExchange", df._jdf.queryExecution().executedPlan().toString()))


def test_nearest_sites_are_joined_by_shuffle(cells):
    sites = cells.filter("x % 8 = 0 and y % 8 = 0").select(F.floor(F.col("x") / 8).alias("bx"), F.floor(F.col("y") / 8).alias("bz"), (F.col("x") * 100 + F.col("y")).alias("site_id"), F.col("x").alias("sx"), F.col("y").alias("sz"), F.lit(20).cast("bigint").alias("radius"))
    points = cells.select((F.col("y") * 64 + F.col("x")).alias("point_id"), "x", "y")
    found = ranges.nearest_site(points, sites, 8)
    assert broadcasts(found) == 0
    got = {r.point_id: (r.site_id, r.dist) for r in found.collect()}
    spots = [(x, y) for x in range(0, 64, 8) for y in range(0, 64, 8)]
    for p in (0, 4 * 64 + 4, 63 * 64 + 63, 30 * 64 + 11):
        x, y = p % 64, p // 64
        near = [(abs(x - sx) + abs(y - sy), sy // 8, sx // 8, sx * 100 + sy) for sx, sy in spots if abs(sx // 8 - x // 8) <= 1 and abs(sy // 8 - y // 8) <= 1]
        assert got[p] == (min(near)[3], min(near)[0])
    assert len(got) == 4096


def test_water_steps_are_joined_by_shuffle(cells):
    wet = stored(cells.filter("x < 40").withColumn("comp", F.lit(0).cast("bigint")).withColumn("level", F.lit(4).cast("bigint")))
    land = cells.filter("x >= 40")
    sources = water.blended(wet.select("x", "y", "level"), land.select("x", "y", "elev_m"), 3, 64)
    judged = graph.component_stats(wet, 64).withColumns({"is_ocean": F.lit(False), "surface": F.lit(4).cast("bigint")})
    for df in (graph.shore_cells(wet.select("x", "y")), graph.cliff_edges(wet, land.withColumnRenamed("elev_m", "h"), 1), graph.border_percentile(wet, cells), sources, water.water_cells(wet, judged, water.WaterRules())):
        assert broadcasts(df) <= (1 if df.columns == ["comp", "spill"] else 0)  # one row for each component may be


def test_samples_of_cells_are_joined_by_shuffle(cells):
    points = cells.select((F.col("y") * 64 + F.col("x")).alias("point_id"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    assert broadcasts(sampling.sample_bilinear(points, cells, 16, 64, 64, value="elev_m")) == 0
    assert broadcasts(focal.resample_stride(cells, 4, "elev_m")) == 0
    assert broadcasts(ranges.neighbors(cells, 8)) == 0
