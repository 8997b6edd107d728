"""Streams that keep state or a store: bounded state, and each tile once over restarts."""

from __future__ import annotations

import datetime as dt

import pytest
from geoloom.streaming import requests
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)
RESULTS = "user_id long, event_id long, ts timestamp, text string"


def put(spark, folder, rows, schema, k):
    """One file, and so one batch."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/k={k}")


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/k=*")


def test_newest_results_are_those_of_the_table_and_idle_keys_are_forgotten(spark, tmp_path):
    rows = []
    for k in range(6):  # ten users an hour, each with three results, the newest not last; users never come back but user 0
        hour = T0 + dt.timedelta(hours=k)
        part = [(u, k * 100 + n, hour + dt.timedelta(minutes=n), f"{u}-{n}") for u in [0, *range(k * 10 + 1, k * 10 + 10)] for n in (1, 3, 2)]
        part.append((k * 10 + 1, None, hour, "no number"))
        put(spark, tmp_path / "in", part, RESULTS, k)
        rows += part
    got = []
    stream = requests.latest_wins(source(spark, tmp_path / "in", RESULTS), ts="ts", watermark="5 minutes", idle_ms=30 * 60_000)
    q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, _: got.extend(tuple(r) for r in df.collect())).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    last = {}
    for r in got:
        assert r[0] not in last or last[r[0]][1] < r[1]
        last[r[0]] = r
    table = requests.latest_wins(spark.createDataFrame(rows, RESULTS)).collect()
    assert set(last.values()) == {tuple(r) for r in table} and len(last) == 55
    assert max(held) <= 21  # two hours of users, not all 55


def make(keys):
    return keys.withColumn("values", F.array(F.col("tx") * 10 + F.col("ty")))


def tiles(spark, path):
    return sorted((r.z, r.tx, r.ty, r["values"][0], r.batch) for r in requests.read_store(spark, path).collect())


def test_a_batch_cut_off_before_its_commit_gives_each_tile_once(spark, tmp_path):
    schema, store, folder = "z int, tx long, ty long", str(tmp_path / "store"), tmp_path / "in"
    put(spark, folder, [(3, 1, 1), (3, 1, 2), (3, 1, 1), (None, 1, 1)], schema, 0)
    put(spark, folder, [(3, 1, 2), (3, 2, 2)], schema, 1)
    failing = [True]

    def fill(keys, batch):
        requests.fill_batch(keys, batch, store, make, "demand")
        if batch == 1 and failing.pop():
            raise RuntimeError("cut off between write and commit")

    start = lambda: source(spark, folder, schema).writeStream.foreachBatch(fill).option("checkpointLocation", str(tmp_path / "point")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="cut off"):
        start().awaitTermination(120)
    before = tiles(spark, store)
    failing[:] = [False]
    assert start().awaitTermination(120)
    assert tiles(spark, store) == before == [(3, 1, 1, 11, 0), (3, 1, 2, 12, 0), (3, 2, 2, 22, 1)]


def test_a_second_stream_writes_what_the_store_lacks(spark, tmp_path):
    schema, store = "z int, tx long, ty long", str(tmp_path / "store")
    assert requests.read_store(spark, store) is None
    for name, keys in (("a", [(1, 0, 0), (1, 1, 0)]), ("b", [(1, 1, 0), (1, 1, 1)]), ("c", [])):
        put(spark, tmp_path / name, keys, schema, 0)
        q = requests.fill_store(source(spark, tmp_path / name, schema), store, make, name).option("checkpointLocation", str(tmp_path / f"point-{name}")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert sorted((r.filler, r.tx, r.ty) for r in requests.read_store(spark, store).collect()) == [("a", 0, 0), ("a", 1, 0), ("b", 1, 1)]
