"""Coarse levels against plain counting, and what a preview does at its edges."""

from __future__ import annotations

import random
from collections import defaultdict

from geoloom.functions import scalar as s
from geoloom.operators import levels
from pyspark.sql import functions as F

CELLS = "x long, y long, cover int, koppen int, elev_m int, cells string"


def raster(seed=3):
    rng = random.Random(seed)
    return {(x, y): (rng.choice([10, 30, 80, 0]), rng.choice([0, 4, 9]), rng.randrange(-40, 60)) for x in range(-9, 22) for y in range(-5, 17) if rng.random() < 0.7}


def rows_of(spark, cells):
    return spark.createDataFrame([(x, y, *v, "z") for (x, y), v in cells.items()], CELLS).repartition(3)


def test_levels_are_those_of_all_cells(spark):
    cells = raster()
    spots = [(x, y, k) for k, (x, y) in enumerate(sorted(cells)) if k % 7 == 0] + [(10**6, 0, -5)]  # the last has no cell
    got = levels.pyramid(rows_of(spark, cells), 4, F.col("cover") == 80, ["cover", "koppen"], sites=spark.createDataFrame(spots, "sx long, sz long, site_id long"))
    want = {}
    for level in range(1, 5):
        groups = defaultdict(list)
        for (x, y), v in cells.items():
            groups[x >> level, y >> level].append((v[0] != 80, y, x, v))
        for (x, y), members in groups.items():
            heights = [m[3][2] for m in members]
            here = [k for sx, sy, k in spots if (sx >> level, sy >> level) == (x, y)]
            want[level, x, y] = (len(members), sum(heights) // len(heights), *min(members)[3][:2], len(here), min(here, default=None))
    assert {(r.level, r.x, r.y): tuple(r)[3:] for r in got.collect()} == want


def test_a_plan_with_all_levels_makes_each_once(spark):
    rows = rows_of(spark, raster())
    count = lambda n: levels.pyramid(rows, n, F.col("cover") == 80, ["cover"])
    deep = count(4)
    deep.collect()
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") + plan.count("ReusedQueryStage") >= 1, plan


def test_levels_without_sites_cells_or_heights(spark):
    assert levels.pyramid(rows_of(spark, {}), 3, F.col("cover") == 80, ["cover"]).collect() == []
    lone = spark.createDataFrame([(5, -1, None, None, None, "z")], CELLS)
    out = levels.pyramid(lone, 2, F.col("cover") == 80, ["cover"]).collect()
    assert [(r.level, r.x, r.y, r.cells, r.elev_m, r.cover, r.n_sites) for r in sorted(out)] == [(1, 2, -1, 1, None, None, 0), (2, 1, -1, 1, None, None, 0)]


def test_colors_by_water_ice_and_slope(spark):
    at = lambda x, cover, elev: (x * 16, 0, cover, 0, elev, "z")
    alone = spark.createDataFrame([at(0, 0, -80), at(1, 80, 300), at(2, 70, 300), at(3, 30, 5), (49, 0, 30, 0, 5000, "z")], CELLS)
    got = {r.x: (r.color, r.shade) for r in levels.preview(alone, 50.0).collect()}
    deep = dict(s.DEPTH_RAMP)
    assert got[0] == (deep[80.0], 0.875) and got[16][0] == deep[2.0] and got[32][0] == s.COVER_COLORS[70]
    assert got[48][0] == s.ROCK and got[49][0] == s.COVER_COLORS[30]  # a cliff to the right; nothing to the right
