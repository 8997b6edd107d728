from __future__ import annotations

import datetime
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from geoloom.llm import line_dedup

DOCS = "doc_id long, text string, line long, word string"


def brute(rows, t, min_words):
    cut = lambda s: set(re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), s)))
    lines = [(i, k, cut(x)) for i, text in rows for k, x in enumerate((text or "").split("\n"))]
    lines = [x for x in lines if len(x[2]) >= min_words]
    gone = set()
    for a, (i, k, x) in enumerate(lines):
        if any(len(x & y) >= t * len(x | y) - 1e-9 for _, _, y in lines[:a]):
            gone.add((i, k))
    return {i: None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in gone) for i, text in rows}


def corpus(seed, n=60):
    rng = random.Random(seed)
    pool = [[f"w{rng.randrange(300)}" for _ in range(rng.randrange(3, 30))] for _ in range(40)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randrange(6)):
            words = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                words[rng.randrange(len(words))] = f"É{rng.randrange(50)}"
            rng.random() < 0.3 and rng.shuffle(words)
            lines.append(rng.choice([" ", "  ", "\t"]).join(words).upper() if rng.random() < 0.2 else " ".join(words))
        rows.append((i, "\n".join(lines)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "\n\n")]


@pytest.mark.parametrize("seed, t, hot, group, small, oldest", [(1, 0.8, 2048, 1 << 16, 1024, 2), (2, 0.8, 1, 1 << 16, 2, 1), (3, 0.8, 1, 8, 1024, 1), (4, 0.6, 3, 1 << 16, 4, 1)])
def test_lines_against_all_pairs(spark, monkeypatch, seed, t, hot, group, small, oldest):
    for name, value in {"HOT_SETS": hot, "GROUP_SETS": group, "SMALL_GROUP": small, "OLDEST": oldest}.items():
        monkeypatch.setattr(line_dedup, name, value)
    rows = corpus(seed, 120)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS)
    out = {r.doc_id: r.text for r in line_dedup.remove_lines(docs, t=t).collect()}
    assert out == brute(rows, t, 1)


def test_short_lines_go_too(spark):
    line = "subscribe to our newsletter for the best weekly deals"
    docs = spark.createDataFrame([(i, f"own{i} words{i} of{i}\n{line}", i, "x") for i in range(50)], DOCS)
    out = line_dedup.remove_lines(docs).collect()
    assert sum(r._n_removed for r in out) == 49 and sum(line in r.text for r in out) == 1


@pytest.mark.parametrize("kind", ["string", "date", "int"])
def test_ids_of_any_type_and_clashing_names(spark, kind):
    value = {"string": lambda i: f"doc{i:03d}", "date": lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(i), "int": lambda i: i}[kind]
    rows = corpus(7, 40)
    names = ["_gone", "_dk", "_th", "_gone_lines", "_n_lines", "lo", "text2"]
    docs = spark.createDataFrame([(value(i), t, *[f"{c}{i}" for c in names]) for i, t in rows], f"id {kind}, text string, " + ", ".join(f"{c} string" for c in names))
    out = line_dedup.remove_lines(docs, id_col="id", counts=None)
    assert out.columns == docs.columns
    got, want = {r.id: r for r in out.collect()}, brute(rows, 0.8, 1)
    assert {k: r.text for k, r in got.items()} == {value(i): t for i, t in want.items()}
    assert all(got[value(i)][c] == f"{c}{i}" for i, _ in rows for c in names)


def test_repeated_rows_null_ids_and_nothing(spark):
    line = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(None, line, 1, "x"), (3, line, 1, "x"), (3, line, 1, "x"), (4, f"{line}\nshort\n{line}", 2, "y")], DOCS)
    out = sorted((r.doc_id is not None, r.doc_id or 0, r.text, r._n_removed) for r in line_dedup.remove_lines(docs).collect())
    assert out == [(False, 0, line, 0), (True, 3, "", 1), (True, 3, "", 1), (True, 4, "short", 2)]
    assert line_dedup.remove_lines(docs.limit(0)).count() == 0


def test_hot_word_and_long_line(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["the"] * 5 + [f"u{i}x{k}" for k in range(10)])) for i in range(300)]
    long = [f"z{k}" for k in range(5000)]
    rows += [(400, " ".join(long)), (401, " ".join(long[:4600])), (402, " ".join(long[:3900]))]
    same = [f"s{k}" for k in range(20)]
    rows += [(500 + i, " ".join(same[:-1] + [f"e{rng.randrange(1000)}"])) for i in range(200)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS)
    out = {r.doc_id: r.text for r in line_dedup.remove_lines(docs).collect()}
    assert out == brute(rows, 0.8, 1)


def test_many_alike_lines_with_ids_of_one_beginning(spark):
    """Ages of such ids tell them apart, so the oldest lines decide at once."""
    words = [f"s{k}" for k in range(20)]
    rows = [(f"document-{i:08}", " ".join([*words, f"own{i}"])) for i in range(1500)]
    docs = spark.createDataFrame([*rows[::-1]], "doc_id string, text string").repartition(6)
    out = {r.doc_id: r.text for r in line_dedup.remove_lines(docs).collect()}
    assert {i for i, t in out.items() if t} == {"document-00000000"}


def test_asked_rows_of_a_large_group_meet_all_older_ones(monkeypatch):
    rng = np.random.default_rng(2)
    n = 400
    parity = np.zeros(n, np.uint64)
    table = pa.table({"key": np.zeros(n, np.int64), "age": rng.permutation(n), "lo": np.arange(n), "size": rng.integers(8, 14, n) << 32 | 14, "parity": parity, "parity2": parity, "asked": rng.random(n) < 0.1})
    met = line_dedup.Met(table, True)
    monkeypatch.setattr(line_dedup, "BLOCK_PAIRS", 1000)
    got = {(int(i), int(j)) for a, b in met.asked_pairs(np.array([0]), 0.8) for i, j in zip(a, b, strict=True)}
    want = {(i, j) for i in range(n) for j in range(n) if met.asked[i] and met.age[j] < met.age[i] and met.possible(np.array([i]), np.array([j]), 0.8)[0]}
    assert got == want and want
