"""Pairs of units sorted as single numbers, against the general way."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from geoloom.llm import token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_pairs_by_one_number_are_those_by_two_keys(monkeypatch):
    both = token_alignment.aligner(A, B)
    units = pa.array([" one", " naïve,", " x=1;x=1;x=1;", " 日本語", " don't", " ab9Z" * 1, " \0\0", "  "], pa.large_string())
    found = both.align(units)
    monkeypatch.setattr(token_alignment, "LARGE_GROUP", 0)  # every group goes the general way
    other = both.align(units, spoken=False)
    for name in ("ok", "n_a", "n_b", "n_groups", "n_links", "pair_at", "pairs", "occ"):
        assert np.array_equal(getattr(found, name), getattr(other, name)), name
    assert other.text.to_pylist() == [b""] * len(units)
