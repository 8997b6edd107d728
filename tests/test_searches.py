"""Nearest pixels, boxes, prefixes and rules against plain Python, with wide radii, wide boxes and hot keys."""

from __future__ import annotations

import random

from geoloom.operators import ranges, sampling, windows
from pyspark.sql import functions as F


def nearest(points, cells, r):
    out = {}
    for key, x, y in points:
        best = min(((cx - x) ** 2 + (cy - y) ** 2, cy - y, cx - x, v) for cx, cy, v in cells) if x is not None else (r * r + 1,)
        out[key] = best[3] if best[0] <= r * r else None
    return out


def test_nearest_pixels_of_a_wide_radius(spark):
    rng = random.Random(4)
    spots = {(rng.randrange(-300, 900), rng.randrange(-300, 900)) for _ in range(300)}
    cells = [(x, y, k + 1) for k, (x, y) in enumerate(sorted(spots))]
    points = [(k, rng.randrange(-500, 1100), rng.randrange(-500, 1100)) for k in range(200)] + [(200, None, 3), (201, *cells[5][:2])]
    frame = spark.createDataFrame(points, "point_id long, x long, y long")
    pixels = spark.createDataFrame([*cells, (0, 0, 0)], "x long, y long, v long")
    for r in (1, 7, 150):
        assert {p.point_id: p.value for p in sampling.nearest_valid(frame, pixels, r).collect()} == nearest(points, cells, r)


def test_ties_of_nearest_pixels_and_no_pixels(spark):
    ring = [(x, y, 10 * (x + 2) + y + 2) for x in (-2, 0, 2) for y in (-2, 0, 2) if (x, y) != (0, 0)]
    points = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 9, 9)], "point_id long, x long, y long")
    found = sampling.nearest_valid(points, spark.createDataFrame(ring, "x long, y long, v long"), 3)
    assert {p.point_id: p.value for p in found.collect()} == {1: 42, 2: None}  # 1 away from (1, 0)
    assert {p.value for p in sampling.nearest_valid(points, spark.createDataFrame([], "x long, y long, v long"), 3).collect()} == {None}


def test_a_box_of_any_size_is_a_few_rows(spark):
    rng = random.Random(6)
    boxes = [(-40_000, 60_000, -50_000, 49_999, 3), (5, 5, 5, 5, -4), (0, 99_999, 7, 7, 1), (3, 90, -20, 100, -2), (9, 2, 0, 50, -30), (-17, -16, -33, 15, 0)]
    cells = [(x, y, rng.randrange(-5, 10)) for x in range(-20, 40) for y in range(-35, 20, 3)] + [(60_000, -50_000, 9), (60_001, 0, 9), (99_999, 7, 9), (5, 5, 9)]
    got = ranges.apply_box_caps(spark.createDataFrame(cells, "x long, y long, elev_m long"), spark.createDataFrame(boxes, "min_x long, max_x long, min_y long, max_y long, base long"), -100)
    cap = lambda x, y, h: min([h, *[b - 1 for x0, x1, y0, y1, b in boxes if x0 <= x <= x1 and y0 <= y <= y1]])
    assert sorted((r.x, r.y, r.elev_m, r.lowered) for r in got.collect()) == sorted((x, y, cap(x, y, h), cap(x, y, h) < h) for x, y, h in cells)
    none = ranges.apply_box_caps(spark.createDataFrame(cells, "x long, y long, elev_m long"), spark.createDataFrame([], "min_x long, max_x long, min_y long, max_y long, base long"), -100)
    assert none.filter("lowered").count() == 0 and none.count() == len(cells)


def test_places_of_a_prefix_that_half_of_all_names_have(spark):
    rng = random.Random(9)
    names = [("The " if k % 2 else "") + "".join(rng.choice("abÉ") for _ in range(rng.randrange(6))) for k in range(2000)]
    asked = ["the", "THE ", "t", "a", "É", "ab", "", None, "the a", "zz"]
    places = spark.createDataFrame(list(enumerate(names)), "place_id long, name string").repartition(5)
    queries = spark.createDataFrame(list(enumerate(asked * 2)), "q_id long, text string")
    found = windows.top_places(places, queries)
    want = set()
    for q, text in enumerate(asked * 2):
        hits = sorted((len(n), n, k) for k, n in enumerate(names) if text and n.lower().startswith(text.lower()))
        want |= {(q, rank + 1, k, n) for rank, (_, n, k) in enumerate(hits[:5])}
    assert {tuple(r) for r in found.collect()} == want
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


def test_one_named_member_takes_its_set(spark):
    members = [(1, "a:oak"), (1, "b:elm"), (2, "b:elm"), (2, None), (3, "x:oaken"), (None, "b:elm"), (None, "c:"), (4, ""), (5, "c:fir"), (5, "c:fir")]
    frame = spark.createDataFrame(members, "k long, id string")
    rules = lambda *r: spark.createDataFrame(r, "kind string, pattern string")
    keys = lambda df: sorted({r.k for r in df.collect()}, key=repr)
    sets = lambda *r: keys(ranges.filter_sets_by_rules(frame, rules(*r), "k"))
    assert sets(("contains", "oak")) == [2, 4, 5, None]
    assert sets(("equals", "c:"), ("prefix", "a:o")) == [2, 3, 4, 5]
    assert sets(("equals", "")) == [1, 2, 3, 5, None]
    assert sets(("prefix", "")) == [] and sets(("equals", "none")) == [1, 2, 3, 4, 5, None]
    left = ranges.filter_by_rules(frame, rules(("contains", ""))).collect()
    assert [r.id for r in left] == [None]
    assert ranges.named_by_rules(frame.filter(F.lit(False)), rules(("contains", ""))).count() == 0
