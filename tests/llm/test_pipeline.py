from __future__ import annotations

import random

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoloom.llm import decontaminate
from geoloom.llm.shared import BATCH_BYTES, BATCH_KEY

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(n))


@pytest.fixture()
def folder(spark, tmp_path):
    rng = random.Random(8)
    bench = [words(rng, 30) for _ in range(3)]
    docs, labels = [], []
    for i in range(300):
        junk = i % 5 == 1
        docs.append("spam *** $$$ spam *** " * 30 if junk else "\n".join(words(rng, rng.randrange(12, 30)) for _ in range(5)))
        labels.append((i, 0 if junk else 1, 0))
    shared = words(rng, 60)
    docs[10] += "\n" + shared
    docs[20] += "\n" + shared
    docs += [docs[0], docs[0].replace("\n", " "), bench[0], f"{words(rng, 40)}\n{bench[1]}", None, ""]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(docs)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), docs, shared


def test_stages_take_effect(spark, folder):
    path, docs, shared = folder
    now = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stage(step(spark, now, path), "test")
        assert after.columns == now.columns
        seen.append({r.doc_id: r.text for r in after.collect()})
        now = after
    first, second, third, fourth = seen
    assert not any(i % 5 == 1 for i in first if i < 300) and sum(i < 300 for i in first) == 240
    assert second[10] == docs[10] and shared not in second[20] and second[20] == docs[20].removesuffix("\n" + shared)
    assert second[300] == "" and set(second) == set(first)
    assert set(second) - set(third) <= {300, 301, 304, 305} and {0, 10, 20} <= set(third)
    assert set(third) - set(fourth) == {302, 303}
    out = corpus_pipeline.run(spark, path)
    assert {r.doc_id for r in out.collect()} == set(fourth)
    digests = {r.doc_id: r.decoded_sha256 for r in out.collect()}
    assert digests == {r.doc_id: r.h for r in now.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).collect()}


def test_stages_on_nothing_and_on_repeated_rows(spark, folder):
    path, docs, _ = folder
    now = spark.read.parquet(f"{path}/documents.parquet")
    extra = now.withColumns({"_key": F.lit("k"), "_gone": F.lit("g"), "_n_lines": F.lit(5)})
    for name, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, now.limit(0), path).count() == 0, name
        out = step(spark, extra, path)
        assert out.columns == extra.columns and {(r._key, r._gone, r._n_lines) for r in out.collect()} == {("k", "g", 5)}
    rng = random.Random(9)
    a, b = words(rng, 80), words(rng, 80)
    rows = [(1, a), (5, a), (5, b), (9, b + " x"), (7, a), (7, a), (None, b)]
    repeated = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, repeated, path).collect()]
    assert sorted(left) == [(1, a), (5, b)]


def test_stages_run_alone_take_texts_by_small_batches(spark, folder):
    path, _, _ = folder
    docs = spark.range(8).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 400_000).alias("text")).coalesce(1)  # 2 MB a text

    def largest(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    for name, step in corpus_pipeline.STAGES:
        spark.conf.unset(BATCH_KEY)
        step(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
        seen = docs.mapInArrow(largest, "n long").agg(F.max("n")).first()[0]
        assert seen < 2 * BATCH_BYTES, name  # it may exceed the limit by its last row


def test_contamination_takes_no_rows_from_python(spark, folder, monkeypatch):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    benchmark = spark.read.parquet(f"{path}/benchmark.parquet")
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *_, **__: pytest.fail("a second Python daemon would run in each executor"))
    assert decontaminate.remove_contaminated(docs, benchmark).count() == docs.count() - 2
