from __future__ import annotations

import re
from collections import Counter

from geoloom.llm import license_scan, quality_rules, shared
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, source string, label string"
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_base(text):
    words, places = WORDS.findall(lower(text)), []
    for phrase, label in license_scan.BASE_PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def brute_labels(text):
    words = WORDS.findall(lower(text))
    spaced, found = " " + " ".join(words) + " ", []
    for rule, gate, regex, priority, label in license_scan.rule_rows():
        if gate in words:
            found += [(m.start(), m.end(), priority, rule, label) for m in re.finditer(regex, spaced)]
    kept = [d for d in found if not any(e != d and e[0] <= d[0] and e[1] >= d[1] and (e[2] < d[2] or e[2] == d[2] and ((e[0], e[1]) != (d[0], d[1]) or e[3] < d[3])) for e in found)]
    return {d[4] for d in kept}, min((d[2] for d in kept), default=None)


TEXTS = [
    None, "", "cc by", "CC-BY cc by!CC BY", "no licence here", "MIT License. mit\nlicense MIT  LICENSE",
    "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "the GNU General Public License, version 3.",
    "GNU Lesser General Public License v2.1 and Mozilla Public License 2.0", "SPDX-License-Identifier: BSD-3-Clause", "éCC by", "K license K",
    "gnu general public license " * 50 + "x", "creative commons attribution", "cc by sa 4.0 cc by nc nd 4.0", "eclipse public license epl license",
]


def test_license_scan_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "s", "x") for i, t in enumerate(TEXTS + TEXTS[:3])], DOCS)
    rows = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert len(rows) == len(TEXTS) + 3
    for i, text in enumerate(TEXTS + TEXTS[:3]):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(text), text
        more, best = brute_labels(text)
        assert set(filter(None, r.labels.split(","))) == more | set(filter(None, r.base_labels.split(","))), text
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_many_rules():
    rows = license_scan.rule_rows()
    assert len(rows) >= 200 and all(re.search(r[2], "") is None for r in rows)


def brute_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    hit = {j for i, w in enumerate(windows) if n[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_against_brute_force(spark):
    texts = [None, "", " \n\t ", "a b c a b c", "x\nx \n x\nx", "a a a a a", "é# <b>\x0b\x85z", "one two three four " * 40, "w " * 5000, "a b c d a b c e f a b"]
    docs = spark.createDataFrame([(i, t, None, "l") for i, t in enumerate(texts)], DOCS)
    rows = {r.doc_id: r for r in quality_rules.apply_rules(docs).collect()}
    for i, text in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(text), text
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_shared_lines_deplete_but_copies_do_not(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, "menu " * 40 + "\nfooter line\n" + "b" * i, "host", "l") for i in range(6)]
    rows += [(100 + i, own(i), "host", "l") for i in range(3)] + [(200 + i, own(99), "host", "l") for i in range(9)]
    out = {r.doc_id: r for r in quality_rules.apply_rules(spark.createDataFrame(rows, DOCS), max_documents=4).collect()}
    assert all(out[i].n_removed_words == 42 for i in range(6))
    assert all(out[i].kept and not out[i].n_removed_words for i in [*range(100, 103), *range(200, 209)])


def test_clean_texts_lose_shared_lines(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, f"Footer  line\n{own(i)}\n\nfooter LINE\nend{i}", None if i % 2 else "host", "l") for i in range(12)]
    rows += [(50, own(3), "host", "l"), (None, f"{own(4)}\nfooter line", "other", "l"), (51, None, "host", "l")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"_doc": F.lit(1), "_lines": F.lit(2), "_host": F.lit(3), "n": F.lit(4)})
    out = quality_rules.clean(docs, max_documents=4)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {i: f"{own(i)}\n\nend{i}" for i in range(12)} | {50: own(3), None: f"{own(4)}\nfooter line"}
    judged = {r.doc_id: r for r in quality_rules.apply_rules(docs, max_documents=4).collect()}
    assert {k for k, r in judged.items() if r.kept} == set(got) and all(judged[i].n_removed_words == 2 for i in range(12))


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert license_scan.scan(docs).count() == 0 and quality_rules.apply_rules(docs).count() == 0


def test_hot_lines_are_dealt_by_document(spark, monkeypatch):
    """With few rows to a heavy key, the salted join gives what the broadcast one does."""
    rows = [(i, f"shared line of the host\nown line {i} " + "x y z " * 20, f"h{i % 2}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(tuple, quality_rules.apply_rules(docs).collect()))
    monkeypatch.setattr(quality_rules, "HEAVY", 0)
    monkeypatch.setattr(shared, "LEAST_HEAVY", 8)
    assert sorted(map(tuple, quality_rules.apply_rules(docs).collect())) == want and any(r[6] for r in want)
    pairs = spark.range(1000).select(F.lit(1).alias("hl"), F.struct(F.col("id").alias("a"), F.col("id").alias("b")).alias("_doc"))
    salts = pairs.select(F.pmod(F.xxhash64("_doc"), F.lit(125)).alias("s")).groupBy("s").count().agg(F.max("count")).first()[0]
    assert salts < 40  # of 1,000 rows of one key, dealt over 125 salts
