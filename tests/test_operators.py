"""Cases beyond the driver tables: gaps, repeats, large tiles, large keys, short texts."""

from __future__ import annotations

import random
import time

import pytest
from geoloom.functions import scalar
from geoloom.operators import graph, ranges, sampling, windows
from geoloom.sources import tables, tiles
from pyspark.sql import functions as F


def test_large_tiles_are_packed_in_one_pass(spark):
    cells = spark.range(512 * 256).select((F.col("id") % 512 - 256).alias("x"), F.floor(F.col("id") / 512).alias("y"), F.col("id").alias("v")).filter("v % 7 <> 0")
    tiles.pack_tiles(cells.filter("y < 16"), 16).count()  # warm
    begin = time.monotonic()
    packed = tiles.pack_tiles(cells, 256)
    assert {(r.tx, r.ty, len(r["values"])) for r in packed.collect()} == {(-1, 0, 65536), (0, 0, 65536)}
    assert time.monotonic() - begin < 5
    back = tiles.explode_tiles(packed, 256)
    assert back.select("x", "y", "v").exceptAll(cells).count() == 0 == cells.exceptAll(back.select("x", "y", "v")).count()


def test_packed_tiles_hold_nulls_repeats_and_structs(spark):
    cells = spark.createDataFrame([(0, 0, 5), (0, 0, 9), (3, 3, None), (1, 2, 7), (-1, -1, 4)], "x long, y long, v int")
    got = {(r.tx, r.ty): r["values"] for r in tiles.pack_tiles(cells, 4).collect()}
    assert got == {(0, 0): [9] + [None] * 8 + [7] + [None] * 6, (-1, -1): [None] * 15 + [4]}
    both = tiles.pack_tiles(cells.filter("v is not null"), 4, F.struct("v", (F.col("v") * 2).alias("w")))
    assert {(r.tx, r["values"][-1] and r["values"][-1].w) for r in both.collect()} == {(0, None), (-1, 8)}
    assert tiles.pack_tiles(cells.limit(0), 4).count() == 0


def test_lookups_over_wide_gaps(spark):
    rng = random.Random(2)
    entries = sorted({0, 10**13, -(10**12), *(rng.randrange(-(10**15), 10**15) for _ in range(60))})
    runs = [rng.choice([0, 1, 5, 10**6]) for _ in entries]
    asked = [None, 0, 10**13 - 1, -(10**16), 2 * 10**15, *entries, *(e + rng.choice([-1, 1, 3, 10**6]) for e in entries)] * 2
    ids = spark.createDataFrame(list(enumerate(asked)), "q long, tile_id long")
    directory = spark.createDataFrame(list(zip(entries, runs)), "tile_id long, run_length long")
    for r in ranges.asof_lookup(ids, directory).collect():
        at = max((e for e in entries if r.tile_id is not None and e <= r.tile_id), default=None)
        run = runs[entries.index(at)] if at is not None else None
        assert (r.entry_id, r.hit) == (at, at is not None and (at == r.tile_id or run == 0 or r.tile_id - at < run)), r
    assert {(r.entry_id, r.hit) for r in ranges.asof_lookup(ids, directory.limit(0)).collect()} == {(None, False)}


def test_directories_within_directories(spark):
    entries = spark.createDataFrame([(0, 0, 2, 0), (0, 100, 0, 7), (7, 100, 1, 0), (7, 120, 0, 8), (8, 120, 3, 0), (8, 130, 0, 9), (9, 130, 0, 10)], "directory long, tile_id long, run_length long, leaf long")
    ids = spark.createDataFrame([(i,) for i in (1, 2, 100, 101, 121, 123, 130, None)], "tile_id long")
    got = {r.tile_id: (r.depth, r.entry_id) for r in ranges.archive_lookup(ids, entries).collect()}
    none = (None, None)
    assert got == {1: (0, 0), 2: none, 100: (1, 100), 101: none, 121: (2, 120), 123: none, 130: none, None: none}


def test_sums_are_carried_over_levels(spark):
    rng = random.Random(5)
    numbers = sorted({rng.randrange(-(10**10), 10**10) for _ in range(500)} | set(range(9000, 9300)))
    got = {r.comp: r.number for r in graph.number_components(spark.createDataFrame([(n,) for n in [*numbers, *numbers[:9], None]], "comp long")).collect()}
    assert got == {n: k + 1 for k, n in enumerate(numbers)}


def test_sources_of_any_size(spark):
    cells = spark.createDataFrame([(x, 0) for x in range(1, 8)], "x long, y long")
    sources = spark.createDataFrame([(0, 0, 2**40 + 5), (8, 0, 2**62 + 1)], "x long, y long, source long")
    got = {r.x: (r.cost, r.source) for r in graph.allocate(cells, sources, 6).collect()}
    assert got == {x: (10 + 10 * min(x, 8 - x), 2**40 + 5 if x <= 4 else 2**62 + 1) for x in range(1, 8)}


def test_bilinear_with_repeated_points(spark):
    cells = spark.createDataFrame([(x, y, x + 10 * y) for x in range(4) for y in range(4)], "x long, y long, v long")
    points = spark.createDataFrame([(1, 0.5, 0.5), (1, 0.5, 0.5), (1, 1.0, 2.0), (2, 9.0, 9.0)], "point_id long, px double, py double")
    got = sorted((r.point_id, r.value) for r in sampling.sample_bilinear(points, cells, 4, 4, 4).filter("point_id = 1").collect())
    assert got == [(1, 5.5), (1, 5.5), (1, 21.0)]


def test_places_by_one_letter(spark):
    places = spark.createDataFrame([(1, "Abc"), (2, "ab"), (3, "b"), (4, "ABd"), (5, "")], "place_id long, name string")
    queries = spark.createDataFrame([(1, "a"), (2, "AB"), (3, "abc"), (4, ""), (5, "abcd")], "q_id long, text string")
    got = {}
    for r in sorted(windows.top_places(places, queries, 2).collect()):
        got.setdefault(r.q_id, []).append(r.place_id)
    assert got == {1: [2, 4], 2: [2, 4], 3: [1]}


def test_rules_by_any_pattern(spark):
    ids = spark.createDataFrame([("abc",), ("xabx",), ("q",), ("",), (None,), ("exact",), ("exactly",)], "id string")
    off = lambda *rules: {r.id for r in ranges.filter_by_rules(ids, spark.createDataFrame(list(rules), "kind string, pattern string")).collect()}
    assert off(("equals", "exact"), ("prefix", "ab"), ("contains", "q")) == {"xabx", "", None, "exactly"}
    assert off(("contains", "abx")) == {"abc", "q", "", None, "exact", "exactly"}
    assert off(("contains", "")) == {None} and off(("equals", "")) == {"abc", "xabx", "q", None, "exact", "exactly"}


@pytest.mark.parametrize("kind", ["average", "paeth"])
def test_chunk_filters_against_plain_loops(spark, kind):
    rng = random.Random(kind)
    rows = [[rng.randrange(-32768, 32768) for _ in range(7)] for _ in range(5)]
    stored = [[0] * 7 for _ in rows]
    for y, row in enumerate(rows):
        for x, v in enumerate(row):
            left, up, corner = (row[x - 1] if x else 0), (rows[y - 1][x] if y else 0), (rows[y - 1][x - 1] if x and y else 0)
            base = int((left + up) / 2) if kind == "average" else min((left, up, corner), key=lambda c: abs(left + up - corner - c))
            stored[y][x] = (v - base + 32768) % 65536 - 32768
    df = spark.createDataFrame([(c, y * 7 + x, stored[y][x]) for c in (1, 2) for y in range(5) for x in range(7)], "chunk long, i long, v long")
    got = {(r.chunk, r.i): r.v for r in windows.undo_chunk_filter(df, kind, "chunk", 7).collect()}
    assert got == {(c, y * 7 + x): rows[y][x] for c in (1, 2) for y in range(5) for x in range(7)}


def test_later_rules_of_a_file_win_across_splits(spark, tmp_path):
    path = tmp_path / "rules.csv"
    lines = ["code,name,climate,climate_name,class"] + [f'{k % 50},n,"AF","c, d",own:c{k}' for k in range(4000)]
    path.write_text("\n".join(lines) + "\n")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        got = {r.cover: r["class"] for r in tables.read_rules(spark, str(path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert got == {k: f"own:c{3950 + k}" for k in range(50)}


def test_tints(spark):
    row = spark.range(1).select(
        scalar.climate_tint(F.lit(0x102030), F.lit(0), F.lit(10)).alias("unknown"), scalar.climate_tint(F.lit(0x102030), F.lit(1), F.lit(80)).alias("water"),
        scalar.climate_tint(F.lit(0), F.lit(5), F.lit(10)).alias("polar"),
    ).first()
    tint = scalar.CLIMATE_TINTS[5]
    assert row.unknown == row.water == 0x102030 and row.polar == sum(int(((tint >> s) & 255) * 0.55 + 0.5) << s for s in (16, 8, 0))
