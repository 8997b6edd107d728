"""Every registered raster query against DuckDB on the smallest tables, and properties that hold at any size."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest
from geoloom.operators import focal, graph
from geoloom.plans import ORACLES, QUERIES
from geoloom.plans.fixtures import fixture
from geoloom.streaming import requests
from pyspark.sql import functions as F

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    clean = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v
    return [columns[i] for i in order], sorted(([clean(r[i]) for i in order] for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == want
    assert got[1]


def test_no_partition_count_shows(spark):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        seen = set()
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.add(tuple(sorted(map(tuple, QUERIES["connected_components"](spark, SF).collect()))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert len(seen) == 1


def test_blocks_of_any_size_give_one_distance(spark):
    water = fixture(spark, SF, "cells").filter("cover = 80").select("x", "y")
    shore = graph.shore_cells(water).select("x", "y", (F.col("y") * 128 + F.col("x")).alias("source"))
    by_size = [sorted(map(tuple, graph.allocate(water, shore, 6, size).collect())) for size in (16, 512)]
    assert by_size[0] == by_size[1]
    cost = {(x, y): c for x, y, c, _ in by_size[0]}
    assert all(c <= 60 for c in cost.values())
    for (x, y), c in cost.items():
        for dx, dy, w in ((1, 0, 10), (0, 1, 10), (1, 1, 14), (1, -1, 14)):
            if (x + dx, y + dy) in cost:
                assert abs(cost[x + dx, y + dy] - c) <= w


def test_blocks_of_components_do_not_show(spark):
    cells = fixture(spark, SF, "cells").filter("cover = 80")
    whole, cut = (sorted((r.x, r.y, r.comp) for r in graph.components(cells, 128, block).select("x", "y", "comp").collect()) for block in (1024, 7))
    assert whole == cut


def test_majority_keeps_uniform_cells(spark):
    flat = spark.range(100).select((F.col("id") % 10).alias("x"), F.floor(F.col("id") / 10).alias("y"), F.lit(30).alias("cover"))
    assert focal.focal_majority(flat).filter("cover <> 30").count() == 0


def test_streams_give_what_tables_give(spark, tmp_path):
    reqs = fixture(spark, SF, "reqs").withColumn("ts", F.col("ts").cast("timestamp"))
    reqs.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(reqs.schema).parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return {tuple(r) for r in spark.table(name).collect()}

    bursts = run(requests.debounce(stream, "6 hours", "1 hour"), "append", "bursts")
    batch = {tuple(r) for r in requests.debounce(reqs, "6 hours").collect()}
    last = max(r[1] for r in batch)
    assert bursts <= batch and all((last - r[1]).total_seconds() < 8 * 3600 for r in batch - bursts)
    newest = run(requests.latest_wins(stream.select("user_id", "event_id", "text")), "complete", "newest")
    assert newest == {tuple(r) for r in requests.latest_wins(reqs.select("user_id", "event_id", "text")).collect()}
    asked = lambda df: df.select("ts", F.lit(6).cast("bigint").alias("z"), (F.col("event_id") % 64).alias("x"), (F.col("event_id") * 7 % 64).alias("y"))
    tiles = run(requests.tile_demand(asked(stream), 1, "365 days").select("z", "x", "y"), "append", "tiles")
    assert tiles == {tuple(r) for r in requests.tile_demand(asked(reqs), 1).collect()}
