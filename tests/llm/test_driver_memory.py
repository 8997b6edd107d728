from __future__ import annotations

import re
from pathlib import Path

from pyspark import Broadcast

from geoloom.llm import line_dedup, shared


def test_stored_tables_give_native_memory_of_the_driver_back(spark):
    jvm = spark.sparkContext._jvm
    field = jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    unsafe, size = field.get(None), 48 << 10
    smaps = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup")
    held = lambda: int(re.search(r"Anonymous:\s+(\d+)", smaps.read_text())[1]) >> 10
    df = spark.range(10)
    assert shared.stage(df, "first").count() == 10
    blocks = [unsafe.allocateMemory(size) for _ in range(4000)]  # 188 MB
    for block in blocks:
        unsafe.setMemory(block, size, 1)
    kept = blocks[::64]  # else the allocator itself gives the end of its memory back
    for k, block in enumerate(blocks):
        if k % 64:
            unsafe.freeMemory(block)
    before = held()
    assert shared.stage(df, "second").count() == 10
    after = held()
    for block in kept:
        unsafe.freeMemory(block)
    assert after < before - 100


def test_a_heap_that_has_grown_is_collected_while_most_of_it_is_free(spark, monkeypatch):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    explicit = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    monkeypatch.setattr(shared, "HELD_HEAP", 0.0)
    monkeypatch.setattr(shared, "_live", {})
    before = explicit()
    shared.stage(spark.range(10), "grown")
    assert explicit() == before + 1
    shared._live[spark.sparkContext.applicationId] = 1 << 50  # in use: a collection would give nothing back
    shared.stage(spark.range(10), "in-use")
    assert explicit() == before + 1


def test_the_table_of_rarities_leaves_the_driver(spark, monkeypatch):
    gone, destroy = [], Broadcast.destroy
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a, **b: (gone.append(self), destroy(self, *a, **b)))
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e\nf g")], "doc_id long, text string")
    left = {r.doc_id: r.text for r in line_dedup.remove_lines(docs, counts=None).collect()}
    assert left == {1: "a b c d e", 2: "f g"} and len(gone) == 1
