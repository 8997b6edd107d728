from __future__ import annotations

import tracemalloc

import numpy as np
import regex
from geoloom.llm import byte_bpe


def test_code_points_are_classed_in_little_memory():
    byte_bpe.classes.cache_clear()
    tracemalloc.start()
    found = byte_bpe.classes()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20  # the table has 1.1 MB; all code points as one string with its list took over 40 MB
    at = np.r_[0:0x3200, 0xD7F0:0xD800, 0xE000:0xE010, 0xFB00:0x11100, 0x10FFF0:0x110000]
    at = at[(at < 0xD800) | (at >= 0xE000)]
    kind = lambda c: byte_bpe.LETTER if regex.match(r"\p{L}", c) else byte_bpe.NUMBER if regex.match(r"\p{N}", c) else byte_bpe.BLANK if regex.match(r"\s", c) else byte_bpe.OTHER
    assert found[at].tolist() == [kind(chr(c)) for c in at]
    assert set(found[0xD800:0xE000].tolist()) == {byte_bpe.OTHER}
