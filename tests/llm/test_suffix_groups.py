from __future__ import annotations

import random

import numpy as np
import pytest
from geoloom.llm.suffix_groups import suffix_arrays


@pytest.mark.parametrize("alphabet", [1, 2, 3, 30])
def test_suffix_arrays_of_many_texts(alphabet):
    rng = random.Random(alphabet)
    texts = [[rng.randrange(1, alphabet + 1) for _ in range(rng.choice([0, 1, 2, 5, 40, 150]))] + [0] for _ in range(80)]
    texts += [[1, 2] * 30 + [0], [2, 1] * 30 + [0], [3, 3, 3, 0], list(range(1, 20)) + [0], list(range(20, 0, -1)) + [0]]
    ends = np.cumsum([len(t) for t in texts])
    got = suffix_arrays(np.concatenate([np.array(t) for t in texts]), ends)
    for t, e in zip(texts, ends, strict=True):
        want = sorted(range(len(t)), key=lambda i, t=t: t[i:])
        assert (got[e - len(t) : e] - (e - len(t))).tolist() == want
