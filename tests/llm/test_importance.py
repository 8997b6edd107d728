"""op11 against plain Python over every feature."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from geoloom.llm import importance
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(rows, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(bucket(f) for _, text in rows for f in features(text)[1]), Counter(bucket(f) for text in target for f in features(text)[1])
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    out = []
    for doc_id, text in rows:
        words, found = features(text)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["the", "THE", "été", "É", "42", "a-b", "x_y", "ß", "日本", "don't", "\0", "{|}", "naïve", "of", "ing"]
    made = [rng.choice(["", " ", "."]) + rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 19, 20, 21, 300]))) for _ in range(400)]
    return [(k, t) for k, t in enumerate([None, "", " ", "one", "one two", "K k", *made])]


def test_every_row_equals_plain_python(spark, rows):
    target = [None, "", "the été the 42 of ing", "naïve of the 日本 x y x y"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "n": F.lit(1), "_t": F.lit(0)}).repartition(5)
    goal = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    want = brute(rows, target)
    assert result(importance.resample(docs, goal)) == want
    assert sum(r[4] is not None for r in want) > 5


def test_slices_of_longer_columns(rows):
    column = pa.array([t for _, t in rows])
    for begin, n in ((0, 50), (37, 200), (300, 106)):
        part = column.slice(begin, n)
        got, want = importance.run_buckets(part), importance.run_buckets(pa.array(part.to_pylist()))
        assert all((x == y).all() for a, b in zip([(got[0], got[0]), *got[1]], [(want[0], want[0]), *want[1]], strict=True) for x, y in zip(a, b, strict=True))


def test_ties_nulls_and_repeats(spark):
    text = " ".join(["same words"] * 15)
    rows = [("b", text), ("b", text), (None, text), ("a", None), *[(f"id-{k}", text) for k in range(60)]]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert result(importance.resample(docs, spark.createDataFrame([(1, "words")], "item_id long, text string"))) == brute(rows, ["words"])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert result(importance.resample(none, none)) == [] and result(importance.resample(some, none)) == brute([(1, "a b c")], [])


def test_one_very_long_text(spark):
    rows = [(1, "ab cd ef " * 60_000), (2, "x" * 300_000)]
    assert result(importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "cd ef")], "item_id long, text string"))) == brute(rows, ["cd ef"])


def test_texts_are_read_twice_only(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    docs = spark.range(300).selectExpr("id as doc_id", "concat('some words of text ', id) as text").mapInArrow(counted, "doc_id long, text string")
    target = spark.createDataFrame([("some words",)], "text string")
    assert len(importance.resample(docs, target).collect()) == 300
    assert read.value == 600
