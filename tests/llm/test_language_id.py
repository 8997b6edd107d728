"""op12: grams and filters against plain Python, and held-out accuracy."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import regex
from geoloom.llm import language_id as li
from pyspark.sql import functions as F

WORD = regex.compile(r"[\p{L}\p{M}]+")
TEXTS = [None, "", "12 3!", "Ab", "É été", "a\0b", "naïve naïve", "日本語 テキスト", "ǅ x", "क्षि", "́a", "x" * 50, "one-two_three"]


def grams(word):
    padded = f" {word} "
    return [padded[i : i + n] for n in range(1, 6) for i in range(len(padded) - n + 1) if padded[i : i + n] != " "]


def test_grams_of_texts_are_those_of_plain_python():
    found = li.words_of(pa.array(TEXTS))
    hashes, of = li.grams_of(found.words)
    name = {}
    for k, text in enumerate(TEXTS):
        words = WORD.findall((text or "").lower())
        assert [found.words[c] for c in found.codes[found.at[k] : found.at[k + 1]]] == words
        assert bool(found.has_letter[k]) == bool(regex.search(r"\p{L}", text or ""))
    for k, word in enumerate(found.words):
        own = hashes[of == k].tolist()
        assert len(own) == len(grams(word))
        for gram, h in zip(grams(word), own, strict=True):  # one hash for a gram, wherever it stands
            assert name.setdefault(gram, h) == h
    assert len(set(name.values())) == len(name)


@pytest.mark.parametrize("n_langs", [3, 11])
def test_filters_have_every_gram_of_their_language(spark, n_langs):
    rng = random.Random(n_langs)
    rows = []
    for k in range(n_langs):
        letters = [chr(0x61 + (5 * k + i) % 26) for i in range(9)]
        vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))) for _ in range(60)]
        rows += [(f"l{k:02}", " ".join(rng.choice(vocabulary) for _ in range(50))) for _ in range(6)]
    frame = spark.createDataFrame(rows, "lang string, _t string").repartition(4)
    filters = li.learn(frame, least_rate=1e-4, least_share=0.2)
    counts = {}
    for lang, text in rows:
        counts.setdefault(lang, Counter()).update(g for w in text.split() for g in grams(w))
    rate = {lang: {g: n / c.total() for g, n in c.items()} for lang, c in counts.items()}
    top = Counter()
    for own in rate.values():
        for g, r in own.items():
            top[g] = max(top[g], r)
    assert filters.langs == sorted(rate)
    words = sorted({w for _, t in rows for w in t.split()})
    hashes, of = li.grams_of(words)
    found = filters.languages_of(hashes)
    hit, wrong = 0, 0
    by_hash = {int(h): row for h, row in zip(hashes, found, strict=True)}
    order = {}
    for k, word in enumerate(words):
        order.update(zip(grams(word), hashes[of == k].tolist(), strict=True))
    for gram, h in order.items():
        for k, lang in enumerate(filters.langs):
            r = rate[lang].get(gram, 0)
            if r >= 1e-4 and r >= 0.2 * top[gram]:
                assert by_hash[h][k] == 1
                hit += 1
            else:
                wrong += int(by_hash[h][k])
    assert hit > 1000 and wrong < 0.02 * len(order) * n_langs and (filters.chance < 0.02).all()


def test_undetermined_nulls_repeats_and_clashing_names(spark):
    rows = [("a", "das ist der Hund und die Katze", "de"), ("b", "the dog and the cat are here", "en"), ("b", "the dog and the cat are here", "en"), (None, "und die Katze", None), ("c", None, "en"), ("d", "12 !", "en"), ("e", "日本", None), ("f", "", None)]
    docs = spark.createDataFrame(rows * 3, "doc_id string, text string, lang string").withColumns({"score": F.lit(1), "k": F.lit(2), "gram": F.lit("x")})
    got = Counter((r.doc_id, r.lang_pred) for r in li.identify(docs).collect())
    assert got["a", "de"] == 3 and got["b", "en"] == 6 and got[None, "de"] == 3 and got["c", "und"] == got["d", "und"] == got["f", "und"] == 3
    assert got["e", "de"] == 3  # without a hit: the first by name
    none = li.identify(docs.limit(0))
    assert none.collect() == [] and none.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert {r.lang_pred for r in li.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_held_out_accuracy(spark):
    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("no test data")
    docs = spark.read.parquet(str(path))
    rows = li.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 for r in rows)
    assert len(rows) > 200 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
