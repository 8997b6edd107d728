"""op13 against whole-text encodings by both libraries, with all links counted one by one."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from geoloom.llm import token_alignment as ta
from pyspark.sql import functions as F
from tokenizers import Tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a ", "a  b   ", " lead", "x\ty\n z", "don't we'll  go", "▁x y", "a\0b", "</s><|endoftext|> <0x0A>", "日本語 テキスト。 次の文", "été déjà vu", "“quoted” text — dash", "éa  b  c　 d", "\U0001f600 \U0001f600‍ x", "-" * 700, "x" * 3000, "ab9Z" * 300, "\r\n x", "﻿x y", "\x1c \x1f y", "ß ẞ ǅ"]


def brute(rows):
    """(doc_id, text) rows -> the contract's columns."""
    a_of, b_of = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_of.encode_special_tokens = True
    letter, vocab = ta.byte_letters(), {i: t for t, i in a_of.get_vocab().items()}
    groups = []
    for _, text in rows:
        found = []
        if text:
            a, b = a_of.encode(" " + text, add_special_tokens=False).ids, b_of.encode(text)
            a_bytes = [bytes(letter[c] for c in vocab[i]) for i in a]
            b_bytes = [bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                ends = [[sum(map(len, x[: k + 1])) if len(x) < 50 else None for k in range(len(x))] for x in (a_bytes, b_bytes)]
                for k, x in enumerate((a_bytes, b_bytes)):
                    at, ends[k] = 0, []
                    for piece in x:
                        at += len(piece)
                        ends[k].append(at)
                common = sorted(set(ends[0]) & set(ends[1]))
                start = 0
                for end in common:
                    found.append(([i for i, e in zip(a, ends[0], strict=True) if start < e <= end], [i for i, e in zip(b, ends[1], strict=True) if start < e <= end]))
                    start = end
        groups.append(found)
    held = Counter()
    for found in groups:
        held.update({(i, j) for a, b in found for i in a for j in b})
    highest = defaultdict(int)
    for (i, _), n in held.items():
        highest[i] = max(highest[i], n)
    out = []
    for (doc_id, _), found in zip(rows, groups, strict=True):
        linked = [(i, j) for a, b in found for i in a for j in b]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in found)
        out.append((doc_id, sum(len(a) for a, _ in found), sum(len(b) for _, b in found), len(found), len(linked), sum(held[x] == highest[x[0]] for x in linked), sum(held[x] for x in linked), hashlib.sha256(text.encode()).hexdigest() if found else ""))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["the", "Haus", "ciónuemi", "été", "x=1;", "don't", "naïve,", "42", "\n", "", "“so”", "日本", "mixed▁", "https://a.b/c?d=e"]
    made = [" ".join(rng.choice(words[:-2] if k % 9 else words) for _ in range(rng.choice([3, 40, 400]))) for k in range(60)]
    texts = [*ODD, *made, made[0], made[0]]
    return [(k // 2 if k > 4 else None, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize(("range_bytes", "hot"), [(1 << 17, 1 << 20), (37, 1 << 20), (300, 40), (1 << 17, 0)])
def test_links_and_digests_equal_whole_encodings(spark, rows, range_bytes, hot):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"pair": F.lit("x"), "occ": F.lit(1), "_t": F.lit(2)}).repartition(3)
    assert result(ta.links(docs, A, B, range_bytes=range_bytes, hot_pairs=hot)) == brute(rows)


def test_fragments_compose_in_any_order(rows):
    both = ta.aligner(A, B)
    data = (" " + " ".join(t for _, t in rows if t and "▁" not in t)).encode()
    want = ta.whole(ta.fragment(data, True, both), both)
    rng = random.Random(5)
    for size in (11, 64, 1000):
        parts = [ta.fragment(data[k : k + size], k == 0, both) for k in range(0, len(data), size)]
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [ta.compose(*parts[k : k + 2], both)]
        got = ta.whole(parts[0], both)
        assert (got.groups, got.n_links, got.pairs.tolist(), got.occ.tolist()) == (want.groups, want.n_links, want.pairs.tolist(), want.occ.tolist())


def test_empty_table_and_ids_of_text(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert result(ta.links(empty, A, B)) == []
    rows = [("a", "one two"), ("a", "one"), (None, "two")]
    assert result(ta.links(spark.createDataFrame(rows, "doc_id string, text string"), A, B)) == brute(rows)
