from __future__ import annotations

import random
from collections import Counter

import pytest
from geoloom.llm import suffix_dedup

DOCS = "doc_id long, text string, dk long"


def brute(texts):
    data = [(t or "").encode() for t in texts]
    n = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if n[d[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefghij klmnoé") for _ in range(n))
    passages = [text(n) for n in (150, 185, 190, 195, 199, 205, 230, 300, 500, 900)]
    docs = [text(rng.randrange(0, 900)) + rng.choice(passages) + text(rng.randrange(0, 300)) + rng.choice(passages) + text(rng.randrange(50)) for _ in range(60)]
    base = text(1500)
    for _ in range(25):
        copy = list(base)
        for _ in range(rng.randrange(1, 6)):
            copy[rng.randrange(len(copy))] = rng.choice("XYZé")
        docs.append("".join(copy))
    docs += [docs[0], docs[0], "The " * 300, "a" * 1000, "a" * 199, "a" * 200, "ab" * 150, None, "", text(199), base[:700] + base[300:1200]]
    return docs


@pytest.mark.parametrize("limit, chunk", [(4096, 2 << 20), (3, 400)])
def test_removed_bytes_against_brute_force(spark, monkeypatch, limit, chunk):
    monkeypatch.setattr(suffix_dedup, "GROUP_LIMIT", limit)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk)
    texts = corpus(limit)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], DOCS)
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()}
    want = brute(texts)
    for i in range(len(texts)):
        assert rows[i] == want[i], i


def test_nothing(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_clashing_hashes_string_ids_and_extra_columns(spark, monkeypatch):
    """Texts whose 64-bit hashes are equal stay apart."""
    real, rng = suffix_dedup.F.xxhash64, random.Random(2)
    monkeypatch.setattr(suffix_dedup.F, "xxhash64", lambda *c: suffix_dedup.F.lit(7).cast("long") if len(c) == 1 and isinstance(c[0], str) and c[0] == "_t" else real(*c))
    text = lambda n: "".join(rng.choice("abcdefghij klmno") for _ in range(n))
    passage = text(300)
    texts = [text(400), text(100) + passage, passage + text(250), text(300)]
    texts += [texts[3], None, "short"]
    docs = spark.createDataFrame([(None if i == 6 else f"d{i}", t, i, i) for i, t in enumerate(texts)], "name string, body string, dk long, ranges long")
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, "name", "body").collect()}
    for i, want in enumerate(brute(texts)):
        assert rows[None if i == 6 else f"d{i}"] == want, i
