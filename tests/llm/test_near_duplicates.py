from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pytest
from geoloom.llm import shingle_sets, simhash
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return 1.0 if not a | b else len(a & b) / len(a | b)


def expected(rows):
    """Indexes of the rows that stay, by all pairs."""
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1] or "", rows[j][1] or "") >= 0.8:
                root[top(i)] = top(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(i)
    return sorted(min((rows[i][0] is None, rows[i][0] or 0) for i in g) for g in groups.values())


def copies(seed, n):
    """Texts of 100 to 1000 words, each with a copy of changed words whose similarity is around 0.8, and unrelated ones."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((100, 300, 1000)))]
        other = list(w)
        for at in rng.sample(range(len(w)), max(1, round(len(w) * rng.choice((0.005, 0.015, 0.022, 0.03, 0.05))))):
            other[at] = f"x{rng.randrange(5000)}"
        rows += [" ".join(w), " ".join(other)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("block", [1024, 3])
def test_stage_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(shingle_sets, "BLOCK", block)
    monkeypatch.setattr(simhash, "SMALL_GROUP", 16 if block > 3 else 2)
    texts = copies(3, 60)
    chain = texts[0].split()
    for _ in range(8):  # each copy is like the one before it
        chain = [*chain[4:], *(f"y{random.Random(len(texts)).random()}{k}" for k in range(4))]
        texts.append(" ".join(chain))
    texts += ["a b c", "A  b\nc", "one", "", None, " \n"]
    rows = list(enumerate(texts))
    near = sum(0.8 <= jaccard(texts[2 * k], texts[2 * k + 1]) < 0.9 for k in range(60))
    assert near >= 10
    got = corpus_pipeline.near_duplicates(spark, table(spark, rows), "")
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == expected(rows)


def test_stage_judges_rows_not_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, b), (2, c), (None, a), (3, c), (3, c), (1, a)]
    got = corpus_pipeline.near_duplicates(spark, table(spark, rows), "")
    assert sorted((r.doc_id, r.text[0]) for r in got.collect()) == [(1, "a"), (1, "b"), (2, "c")]


def test_stage_empty_table(spark):
    assert corpus_pipeline.near_duplicates(spark, table(spark, []), "").count() == 0


def test_recall_of_segments():
    """Pairs at a similarity of 0.8 to 0.9 that meet within 2 bits in a segment and within the limit in the whole fingerprint."""
    rng = np.random.default_rng(4)
    bits = simhash.SEGMENT_BITS
    segments = simhash.n_segments(bits, 0.8, 0.999)
    share = simhash.bit_share(0.8)
    limit = int(64 * share + simhash.SPARE * (64 * share * (1 - share)) ** 0.5)
    for t, least in ((0.8, 0.99), (0.85, 0.995), (0.9, 0.999)):
        found = []
        for _ in range(300):
            n = int(rng.integers(60, 400))
            both, own = round(n * t), n - round(n * t)
            x = rng.integers(0, 1 << 63, both + own, dtype=np.uint64)
            a, b = x[: both + own // 2], np.concatenate([x[:both], x[both + own // 2 :]])
            made = simhash.majority_words(np.concatenate([a, b]), np.array([len(a), len(b)]), -(-segments * bits // 64) + 1)
            apart = np.unpackbits((made[0] ^ made[1]).view(np.uint8), bitorder="little")
            found.append(apart[:64].sum() <= limit and apart[64 : 64 + segments * bits].reshape(segments, bits).sum(axis=1).min() <= 2)
        assert np.mean(found) >= least, (t, np.mean(found))


def test_unrelated_sets_that_meet_form_no_families(spark):
    """With short segments most sets have a false link within 20 of 64 bits, as they would in a very large corpus; none is left after all bits are compared."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(8, 80))) for _ in range(1500)]
    words = texts[7].split()
    texts += [" ".join(words[:-1]), "p q r s t u v w", "p q r s t u v w x"]  # 4 of 5 shingles: a small set
    rows = spark.createDataFrame(list(enumerate(texts)), "set_id long, _t string").repartition(4)
    indexed = simhash.segment_values(rows, 5, 8, 60, 0.8).cache()
    met = simhash.segment_links(indexed, 8, 60, 20)
    assert met.select("u").union(met.select("v")).distinct().count() > 1000
    left = {tuple(sorted((r.u, r.v))) for r in simhash.near_links(met, indexed, 8, 60, 0.8).collect()}
    assert (7, 1500) in left and left <= {(7, 1500), (1501, 1502)}
    pairs = spark.createDataFrame([(1501, 1502)], "u long, v long")
    assert simhash.near_links(pairs, indexed, 8, 60, 0.8).count() == 1


def test_majority_words_against_plain_sums():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 2, 255, 256, 900, 3])
    x = rng.integers(0, 1 << 63, int(sizes.sum()), dtype=np.uint64)
    made, begin = simhash.majority_words(x, sizes, 2), 0
    for k, n in enumerate(sizes):
        for w in range(2):
            h = simhash.mix(x[begin : begin + n] ^ simhash.mix(np.full(1, 2 * w + 1, np.uint64)))
            want = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > n)
            assert int(made[k, w]) == want
        begin += n


def test_clashing_names_and_string_ids(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [("y", a, "1"), ("x", a + " end", "2"), ("z", b, "3"), (None, b, "4")]
    docs = spark.createDataFrame(rows, "name string, body string, _rk string").withColumns({"_gone": F.lit(1), "set_id": F.lit(2), "doc_id": F.lit(3)})
    out = simhash.remove_near_duplicates(docs, id_col="name", text_col="body")
    assert out.columns == docs.columns and sorted((r.name, r._rk) for r in out.collect()) == [("x", "2"), ("z", "3")]
