"""The whole water region against a plain search over a small raster with a wide lake, a river, cliffs and the sea."""

from __future__ import annotations

import math

import pytest
from geoloom.functions import scalar
from geoloom.operators import graph, water
from pyspark.sql import functions as F

W, H = 60, 56
SIDES = [(1, 0), (-1, 0), (0, 1), (0, -1)]
EIGHT = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]


def world():
    """(height, wet) by cell: a lake of 30 by 34, a river of 2 by 40, the sea at the right, cliffs at some shores."""
    out = {}
    for x in range(W):
        for y in range(H):
            lake, river, sea = 4 <= x < 34 and 6 <= y < 40, 40 <= x < 42 and 5 <= y < 45, x >= 52
            h = -6 + (x * 7 + y) % 3 if sea else 8 - (x + y) % 4 if lake else 14 + y % 5 if river else 12 + (x * 5 + y * 3) % 9 + (12 if y < 5 or x > 47 else 0)
            out[x, y] = (h, lake or river or sea)
    return out


def plain(cells, comp, judged, depth, rules):
    level = {c: judged[k]["level"] for c, k in comp.items()}
    ocean = {c: judged[k]["is_ocean"] for c, k in comp.items()}
    dry = [c for c in cells if c not in comp]
    cliff = {(w, n) for w in comp for dx, dy in SIDES for n in [(w[0] + dx, w[1] + dy)] if n in cells and n not in comp and cells[n][0] - level[w] >= rules.cliff}
    steep, wall = {w for w, _ in cliff}, {n for _, n in cliff}

    def spread(allowed, sources, limit):
        best = {c: (10, s) for c, s in sources.items() if c in allowed}
        for _ in range(200):
            after = dict(best)
            for (x, y), (cost, s) in best.items():
                for dx, dy in EIGHT:
                    n, more = (x + dx, y + dy), cost + (14 if dx and dy else 10)
                    if n in allowed and more <= limit * 10 and (more, s) < after.get(n, (math.inf, 0)):
                        after[n] = (more, s)
            if after == best:
                return best
            best = after
        raise AssertionError

    inland = {c for c in comp if not ocean[c]}
    shore = {c: 0 for c in inland if any((c[0] + dx, c[1] + dy) not in inland for dx, dy in SIDES)}
    cost = {c: v[0] for c, v in spread(inland, shore, rules.shore_limit).items()}
    floor, most = {}, {}
    for c in comp:
        h = cells[c][0]
        if ocean[c] or c in steep:
            floor[c] = min(h, level[c] - 1)
        else:
            floor[c] = level[c] - max(1, depth[c])
            most[comp[c]] = max(most.get(comp[c], 0), cost.get(c, rules.shore_limit * 10))
    out = {c: (2 if ocean[c] else 1, level[c], floor[c]) for c in comp}
    smoothed = 0
    for c in inland:
        if c not in steep and cost.get(c, 0) > 100 and most[comp[c]] > 110:
            near = [floor[n] for dx, dy in [(0, 0), *EIGHT] for n in [(c[0] + dx, c[1] + dy)] if comp.get(n) == comp[c]]
            out[c] = (1, level[c], min(math.floor(sum(near) / len(near) + 0.5), level[c] - 1))
            smoothed += out[c][2] != floor[c]
    ground = {c: cells[c][0] for c in dry}
    soft = {c for c in dry if c not in wall}
    for kind, distance in ((False, rules.inland_blend), (True, rules.ocean_blend)):
        sources = {}
        for (x, y), k in sorted(comp.items(), key=lambda i: (i[0][1], i[0][0])):
            for dx, dy in SIDES:
                if ocean[x, y] == kind and (x + dx, y + dy) in soft:
                    sources.setdefault((x + dx, y + dy), (y * W + x, level[x, y]))
        for c, (v, (_, lev)) in spread(soft, sources, distance).items():
            mixed = math.floor(lev + v / 10 / distance * (cells[c][0] - lev) + 0.5)
            if mixed < cells[c][0]:
                ground[c] = mixed
    return out | {c: (0, h, h) for c, h in ground.items()}, smoothed, len(steep)


@pytest.mark.parametrize("rules", [water.WaterRules(cliff=9), water.WaterRules(cliff=60, inland_blend=4, ocean_blend=3, shore_limit=17)])
def test_water_region_against_a_plain_search(spark, rules):
    cells = world()
    frame = spark.createDataFrame([(x, y, h, wet, 1, 80) for (x, y), (h, wet) in cells.items()], "x long, y long, elev_m long, wet boolean, land long, cover long")
    lab = graph.components(frame.filter("wet").drop("wet"), W, 16).cache()
    stats = graph.component_stats(lab, W)
    judged = stats.withColumns({"is_ocean": F.col("max_x") == W - 1, "surface": F.when(F.col("max_x") == W - 1, 0).otherwise(F.col("average") + 3)}).cache()
    got = {(r.x, r.y): (r.kind, r.water, r.terrain) for r in water.water_region(frame, lab, judged, W, rules).collect()}
    comp = {(r.x, r.y): r.comp for r in lab.collect()}
    kinds = {r.comp: {"is_ocean": r.is_ocean, "level": r.level} for r in judged.withColumn("level", F.when(F.col("is_ocean"), 0).when(F.col("max_x") < 42, F.when(F.col("min_x") >= 40, F.least("surface", "high")).otherwise(F.col("surface")))).collect()}
    assert len(kinds) == 3
    inland = water.water_cells(lab, judged, rules).filter("not ocean")
    sides = graph.shore_cells(inland.select("x", "y")).select("x", "y", F.lit(0).cast("bigint").alias("source"))
    cost = graph.allocate(inland.select("x", "y"), sides, rules.shore_limit)
    deep = inland.join(cost.select("x", "y", "cost"), ["x", "y"], "left").select("x", "y", scalar.inland_depth(F.coalesce("cost", F.lit(rules.shore_limit * 10)) / 10.0, F.col("x"), F.col("y")).alias("d"))
    want, smoothed, steep = plain(cells, comp, kinds, {(r.x, r.y): r.d for r in deep.collect()}, rules)
    assert smoothed > 10 and (steep > 10) == (rules.cliff == 9)
    assert got == want
