"""Counts in haloed blocks against counting every neighbourhood."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from geoloom.operators import focal


def around(cells, x, y, r, inside):
    return Counter(v for dx in range(-r, r + 1) for dy in range(-r, r + 1) if inside(dx, dy) for v in cells.get((x + dx, y + dy), ()))


def raster(seed, side=34):
    rng = random.Random(seed)
    cells = {(x, y): [rng.choice([0, 0, 3, 5, 9, None])] for x in range(-7, side) for y in range(-3, side) if rng.random() < 0.8}
    cells[2, 2] = [9, 9, 3]  # a repeated cell
    return cells


def rows_of(spark, cells):
    return spark.createDataFrame([(x, y, v, "z") for (x, y), vs in cells.items() for v in vs], "x int, y long, koppen int, n string").repartition(5)


@pytest.mark.parametrize(("r", "block"), [(1, 4), (2, 16), (4, 8), (25, 7)])
def test_mode_and_histogram_for_any_radius_and_block(spark, r, block):
    cells = raster(r)
    rows = rows_of(spark, cells)
    want = {}
    for (x, y), own in cells.items():
        votes = Counter({v: n for v, n in around(cells, x, y, r, lambda dx, dy: dx * dx + dy * dy <= r * r).items() if v})
        want[x, y] = max(votes, key=lambda v: (votes[v], v in own, -v)) if votes else None
    got = focal.focal_mode(rows, r, block=block)
    assert {(q.x, q.y): q.koppen for q in got.collect()} == want and got.count() == len(want) and got.schema["koppen"].dataType.simpleString() == "int"
    assert {(q.x, q.y): q.koppen for q in focal.focal_mode(rows, r, legacy=True, block=block).collect()} == {c: 1 if v is None else v for c, v in want.items()}
    counts = {(q.x, q.y, q.v): q.n for q in focal.focal_histogram(rows, "koppen", r, block).collect()}
    assert counts == {(x, y, v): n for x, y in cells for v, n in around(cells, x, y, r, lambda dx, dy: True).items()}


def test_far_cells_of_a_wide_block_and_nothing(spark):
    assert focal.focal_mode(rows_of(spark, {}), 3).collect() == [] and focal.focal_histogram(rows_of(spark, {}), "koppen").collect() == []
    lone = rows_of(spark, {(0, 0): [4], (10**9, -(10**9)): [None], (255, 255): [0]})
    assert {(q.x, q.koppen) for q in focal.focal_mode(lone, 2).collect()} == {(0, 4), (10**9, None), (255, None)}
    words = lone.select("x", "y", "n")
    assert {(q.x, q.v, q.n) for q in focal.focal_histogram(words, "n").collect()} == {(0, "z", 1), (10**9, "z", 1), (255, "z", 1)}
