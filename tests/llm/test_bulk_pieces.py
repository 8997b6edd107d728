"""Many different pieces by one call of the library, against each piece alone."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import pytest
from geoloom.llm import byte_bpe, token_shards

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", "a\0b \0\0 \0", "\0", "x" * 3000, "été " * 3 + "-" * 1500, "don't we'll go", "日本語 テキスト", "\U0001f600‍ x\r\n\n  y ", "word " * 50, *[f"w{k} {k * 7919}" for k in range(3000)]]


class Counted:
    """A library's encoder and the number of calls of it."""

    def __init__(self, library):
        self.library, self.calls = library, 0

    def __getattr__(self, name):
        self.calls += name.startswith(("encode_ordinary", "_encode"))
        return getattr(self.library, name)


@pytest.mark.parametrize("texts", [TEXTS, TEXTS[:4], ["\0 \0"], ["y" * 2000], [], [None]])
def test_bulk_ids_are_those_of_pieces_alone(texts):
    column, alone = pa.array(texts, pa.string()), byte_bpe.one_by_one(byte_bpe.load(RANKS).encode, {})
    ids, at = byte_bpe.encode_texts(column, alone)
    got, got_at = byte_bpe.encode_texts(column, token_shards.Tokens(RANKS).encoder())
    assert got.tolist() == ids.tolist() and got_at.tolist() == at.tolist()
    assert byte_bpe.count_ids(column, token_shards.Tokens(RANKS).encoder()) == len(ids)


def test_thousands_of_pieces_take_one_call(monkeypatch):
    counted = Counted(token_shards.library(RANKS))
    monkeypatch.setattr(token_shards, "library", lambda path: counted)
    tokens = token_shards.Tokens(RANKS)
    encoder = tokens.encoder()
    tokens.count(pa.array(TEXTS[-3000:]), encoder)
    assert counted.calls <= 2  # one for each of 6,000 pieces before
