"""Block algorithms against plain searches over small rasters."""

from __future__ import annotations

import heapq
import random

import pytest
from geoloom.operators import graph


def flooded(cells, width):
    left, out = set(cells), {}
    for start in sorted(cells, key=lambda c: (c[1], c[0])):
        if start not in left:
            continue
        left.discard(start)
        stack = [start]
        while stack:
            x, y = stack.pop()
            out[x, y] = start[0] + start[1] * width
            for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if n in left:
                    left.discard(n)
                    stack.append(n)
    return out


@pytest.mark.parametrize(("block", "share"), [(4, 0.6), (2, 0.62), (16, 0.55), (1024, 0.6)])
def test_components_do_not_depend_on_blocks(spark, block, share):
    rng = random.Random(block)
    cells = [(x, y) for x in range(90) for y in range(-20, 70) if rng.random() < share]  # over 16 blocks a side for the small ones
    rows = spark.createDataFrame([(x, y, f"c{x}") for x, y in cells], "x long, y long, tag string").repartition(5)
    got = graph.components(rows, 90, block)
    assert got.columns == ["x", "y", "tag", "comp"]
    assert {(r.x, r.y): r.comp for r in got.collect()} == flooded(cells, 90)


def test_components_of_nothing_and_of_one_snake(spark):
    empty = spark.createDataFrame([], "x long, y long")
    assert graph.components(empty, 10).collect() == []
    snake = [(x, y) for y in range(0, 41, 2) for x in range(40)] + [(39 if y % 4 == 1 else 0, y) for y in range(1, 40, 2)]
    assert {r.comp for r in graph.components(spark.createDataFrame(snake, "x long, y long"), 40, 2).collect()} == {0}


def cheapest(cells, sources, limit):
    best, heap = {}, [(10, s, x, y) for x, y, s in sources]
    heapq.heapify(heap)
    while heap:
        cost, source, x, y = heapq.heappop(heap)
        if (x, y) in best:
            continue
        best[x, y] = (cost, source)
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                step = 14 if dx and dy else 10
                if (dx or dy) and (x + dx, y + dy) in cells and cost + step <= limit * 10:
                    heapq.heappush(heap, (cost + step, source, x + dx, y + dy))
    return {c: v for c, v in best.items() if c in cells}


@pytest.mark.parametrize(("limit", "block"), [(1, 8), (5, 7), (12, 8), (12, 512)])
def test_allocation_settles_the_cheapest_source(spark, limit, block):
    rng = random.Random(limit)
    cells = {(x, y) for x in range(-15, 40) for y in range(30) if rng.random() < 0.7}
    sources = [(rng.randrange(-16, 41), rng.randrange(-1, 31), s) for s in [7, 7, 3, -(10**12), 10**15, 5, 2]]
    got = graph.allocate(spark.createDataFrame(sorted(cells), "x long, y long"), spark.createDataFrame(sources, "x long, y long, source long"), limit, block)
    assert {(r.x, r.y): (r.cost, r.source) for r in got.collect()} == cheapest(cells, sources, limit)


def test_allocation_over_few_cells_of_a_wide_block(spark):
    cells = spark.createDataFrame([(k * 1000, 5) for k in range(50)] + [(1, 5)], "x long, y long")
    got = graph.allocate(cells, spark.createDataFrame([(0, 5, 9)], "x long, y long, source long"), 400, 1 << 20)  # no array over the block
    assert {(r.x, r.cost, r.source) for r in got.collect()} == {(0, 10, 9), (1, 20, 9)}
