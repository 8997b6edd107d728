from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from geoloom.llm import chat_format, rule_ensemble, token_shards
from geoloom.llm.shared import new_path
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TURNS = "conv_id long, turn long, role string, text string, ids string"


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("<s>/[INST]\\ aé"), max_size=40))
def test_escapes_are_reversible(text):
    t = chat_format.Template()
    assert t.show(t.hide(text)) == text and not any(c in t.hide(text) for c in t.controls)


def test_chat_digests_against_plain_python(spark):
    turns = [(1, 1, "assistant", "b"), (1, 0, "user", "a\n"), (2, 0, "system", None), (2, 1, None, "x"), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (None, None, "assistant", "\\<s>é"), (3, 5, "assistant", "z"), (3, 5, "assistant", "z"), (3, 5, "assistant", "a"), (4, 0, "user", ""), (5, 0, "assistant", "y" * 5000)]
    formatted = chat_format.format_turns(spark.createDataFrame([(*t, "i") for t in turns], TURNS), PATH, PATTERN)
    rows = {r.conv_id: r for r in chat_format.read_back(formatted, PATH, PATTERN).collect()}
    order = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
    t = chat_format.Template()
    for conv in {x[0] for x in turns}:
        mine = sorted((x for x in turns if x[0] == conv), key=order)
        whole = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in mine)
        loss = "".join(x or "" for _, _, r, x in mine if r == "assistant")
        shown = t.begin + "".join(t.turn + t.hide(r or "") + t.header_end + t.hide(x or "") + t.end for _, _, r, x in mine)
        want = (len(mine), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(shown))
        assert tuple(rows[conv])[1:] == want, conv
    first = chat_format.load(PATH, PATTERN).max_token_value + 1
    for r in chat_format.sequences(formatted, first).collect():
        assert len(r.input_ids) == len(r.loss_mask) and r.input_ids[0] == first
    starts = {(r.conv_id, r.place): (r.token_start, len(r.ids)) for r in formatted.collect()}
    assert all(p == 1 and s == 1 or starts[c, p - 1][0] + starts[c, p - 1][1] == s for (c, p), (s, _) in starts.items())
    assert chat_format.read_back(chat_format.format_turns(spark.createDataFrame([], TURNS), PATH, PATTERN), PATH, PATTERN).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**63))
def test_feistel_is_a_permutation_with_inverse(size, key):
    slots = token_shards.feistel(np.arange(size), size, key)
    assert sorted(slots.tolist()) == list(range(size))
    assert token_shards.feistel(slots, size, key, inverse=True).tolist() == list(range(size))


@pytest.mark.parametrize("per_shard", [3, 1000])
def test_shards_hold_every_sequence_at_its_slot(spark, tmp_path, per_shard):
    rng = random.Random(4)
    texts = [None, "", "é" * 300, " " * 30_000] + ["".join(rng.choice("abcé ") for _ in range(rng.randrange(90))) for _ in range(60)]
    texts += texts[-5:]
    rows = [(f"d{i % 66}" if i else None, t, "x") for i, t in enumerate(texts)]  # null and repeated ids, repeated rows
    spark.createDataFrame(rows, "doc_id string, text string, ids string").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    stride, key, tokens = 64, 9, token_shards.Tokens(PATH)
    shards, index = token_shards.write_shards(docs, new_path(spark, "test-shards"), tokens, stride, per_shard, key)
    got = {r.slot: np.frombuffer(bytes(r.ids), np.uint16).tolist() for r in token_shards.read_shards(shards, stride).collect()}
    enc = chat_format.load(PATH, PATTERN)
    parts = docs.select("doc_id", "text").rdd.glom().collect()  # the numbering follows the partitions
    sequences, owners = [], []
    for part in parts:
        pairs = [(x, r.doc_id, k) for k, r in enumerate(part) for x in [*enc.encode_ordinary(r.text or ""), enc.max_token_value + 1]]
        for i in range(0, len(pairs), stride):
            mine = pairs[i : i + stride]
            sequences.append([x for x, _, _ in mine] + [enc.max_token_value + 2] * (stride - len(mine)))
            first = [j for j in range(len(mine)) if j == 0 or mine[j][2] != mine[j - 1][2]]
            owners.append(([mine[j][1] for j in first], first))
    slots = token_shards.feistel(np.arange(len(sequences)), len(sequences), key).tolist()
    assert got == dict(zip(slots, sequences, strict=True))
    assert {r.slot: (r.doc_ids, r.starts) for r in index.collect()} == dict(zip(slots, owners, strict=True))
    later = {r.slot for r in token_shards.read_shards(shards, stride, start=5).collect()}
    assert later == {s for s in got if s >= 5}
    for r in token_shards.read_shards(shards, stride).collect():
        assert r.byte_offset == (r.slot - r.shard * per_shard) * stride * 2
    empty = spark.createDataFrame([], "doc_id long, text string")
    shards, index = token_shards.write_shards(empty, new_path(spark, "none"), tokens, stride)
    assert token_shards.read_shards(shards, stride).count() == 0 == index.count()


def test_changed_input_is_noticed(spark, tmp_path):
    folder = str(tmp_path / "docs")
    spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string").repartition(2).write.parquet(folder)
    docs = spark.read.parquet(folder).withColumn("text", F.concat("text", F.rand().cast("string")))  # another text at each reading
    tokens = token_shards.Tokens(PATH)
    fixed = token_shards.sequence_rows(docs.select("doc_id", "text"), tokens, 16, True).collect()
    assert sum(r.n for r in fixed) > 0
    unstable = F.udf(lambda t: t + str(random.random()), "string").asNondeterministic()
    with pytest.raises(Exception, match="changed between two readings"):
        token_shards.write_shards(docs.withColumn("text", unstable("text")), new_path(spark, "changed"), tokens, 16)


def test_long_runs_of_blanks(spark):
    text = "a" + " " * 2_000_000 + "b"
    turns = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", "\n" * 300_000)], "conv_id long, turn long, role string, text string")
    row = chat_format.read_back(chat_format.format_turns(turns, PATH, PATTERN), PATH, PATTERN).first()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{chr(10) * 300_000}\n".encode()).hexdigest() and row.loss_chars == 300_000


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(6)
    good = lambda: " ".join("w" + rng.choice("abcdefgh") * rng.randrange(1, 6) + str(rng.randrange(5)) for _ in range(rng.randrange(20, 80))) + "."
    docs, labels = [(None, "x", "s", 1), (-1, None, "s", 1), (-2, "", "s", 1)], []
    for i in range(400):
        bad = i % 4 == 0
        docs.append((i, "buy *** now$$ " * rng.randrange(5, 40) if bad else good(), "s", 0))
        labels.append((i, 0 if bad else 1, "en"))
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, n_words int")
    labels = spark.createDataFrame([*labels, (None, 1, "en"), (3, None, "en"), (5, 7, "en")], "doc_id long, quality int, text string")
    rows = rule_ensemble.classify(docs, labels).collect()
    assert len(rows) == 403 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    test = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id >= 0]
    assert len(test) > 50 and sum(r.predicted == (r.doc_id % 4 != 0) for r in test) / len(test) > 0.97
    none = rule_ensemble.classify(docs, labels.limit(0)).collect()
    assert len(none) == 403 and len({r.score for r in none}) == 1
    assert rule_ensemble.classify(docs.limit(0), labels).count() == 0


def plain_statistics(text):
    """``rule_ensemble.STATISTICS`` of a text."""
    t = text or ""
    words = re.split("[\x20\x09-\x0d]+", t.strip(" \t\n\x0b\f\r"))
    lines, chars = t.split("\n"), max(len(t), 1)
    share = lambda pattern: len(re.findall(pattern, t)) / chars
    return {
        "n_words": 0 if words == [""] else len(words), "word_length": len(t) / len(words), "symbols": share(r"[#*$%&|<>]"), "uppercase": share("[A-Z]"), "digits": share("[0-9]"), "punctuation": share("[.,;:!?]"),
        "repeated_words": 1 - len(set(words)) / len(words), "repeated_lines": 1 - len(set(lines)) / len(lines), "words_per_line": len(words) / len(lines), "accents": (len(t.encode()) - len(t)) / chars, "exclamations": share("!"),
    }


def test_compiled_rules_against_plain_evaluation(spark):
    rng = random.Random(3)
    texts = [None, "", " \n ", "é!", "A" * 4000] + [" ".join(rng.choice(["buy", "***", "Now!!", "été", "x1", "w\nw"]) if i % 3 == 0 else "w" + rng.choice("abcdefgh") * rng.randrange(1, 6) for _ in range(rng.randrange(1, 60))) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*texts, *texts[-3:]])], "doc_id long, text string, _once string")
    known = {r.doc_id: r for r in rule_ensemble.statistics(docs, {"doc_id": F.col("doc_id")}).collect()}
    for i, t in enumerate(texts):
        for name, value in plain_statistics(t).items():
            assert known[i][name] == pytest.approx(value, abs=1e-12), (name, t)
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(5, 305)], "doc_id long, quality int")
    model = rule_ensemble.train(rule_ensemble.statistics(docs, {"doc_id": F.col("doc_id")}), labels)
    assert model.rules
    scores = {r.doc_id: r for r in rule_ensemble.classify(docs, labels).collect()}
    for i, t in enumerate(texts):
        x = plain_statistics(t)
        total = model.intercept + sum(w for w, rule in model.rules if all(x[n] > b if above else x[n] <= b for n, above, b in rule))
        assert scores[i].score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)
    taken = rule_ensemble.accepted(docs, labels)
    assert taken.columns == docs.columns and sorted(r.doc_id for r in taken.collect()) == sorted(i for i, r in scores.items() if r.predicted)
    plan = taken._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") <= 2  # each statistic once, not in every rule


def test_conversations_with_ids_of_text(spark):
    turns = spark.createDataFrame([("c-17", 0, "user", "hi"), ("c-17", 1, "assistant", "yes"), (None, 0, "assistant", "no")], "conv_id string, turn long, role string, text string")
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat_format.read_back(chat_format.format_turns(turns, path, pattern), path, pattern).collect()}
    assert out == {"c-17": (2, 3), None: (1, 2)}
