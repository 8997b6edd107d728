"""Suffix arrays by grouping, for many short strings at once.

The construction has two phases. Suffixes start in groups by first symbol. The first phase takes the
groups in descending order: each member points to the nearest earlier suffix of a lower group, and
the suffixes pointed at leave their group for new groups just above it, in order of how many
pointers they got. In the end a group holds the suffixes that share their longest Lyndon prefix. The
second phase goes up the suffix array: from each placed suffix it follows the pointers of the suffix
before it and puts every one it meets into the next free place of its group. No renaming, no
recursion; work is linear in the symbols.

Texts are independent, so one step takes the next group (or place) of every text together, in numpy.
"""

from __future__ import annotations

import numpy as np


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    total = np.cumsum(length)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - length, length) + np.repeat(start, length)


def suffix_arrays(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array of each text, end to end, as positions in ``symbols``.

    Text k is symbols[ends[k-1]:ends[k]] and its last symbol is smaller than all its others.
    """
    n = len(symbols)
    begins = np.concatenate([[0], ends[:-1]])
    text = np.repeat(np.arange(len(ends)), ends - begins)
    order = np.lexsort((symbols, text))
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    key = symbols[order]
    new = np.ones(n, dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    group = np.empty(n, dtype=np.int64)  # first place of the suffix's group
    group[order] = head[np.cumsum(new) - 1]
    size = np.zeros(n, dtype=np.int64)
    size[head] = np.diff(np.append(head, n))
    pointer = np.full(n, -1, dtype=np.int64)
    marked = np.zeros(n, dtype=bool)
    first_of = begins[text]

    top = ends.copy()
    live = np.flatnonzero(top > begins)
    while len(live):
        g = group[order[top[live] - 1]]
        count = top[live] - g
        members = order[_ranges(g, count)]
        own = np.repeat(g, count)
        back = members - 1
        pointer[members] = back
        while True:
            ok = back >= first_of[members]
            skip = ok.copy()
            skip[ok] = group[back[ok]] >= own[ok]
            if not skip.any():
                break
            back = np.where(skip, pointer[np.maximum(back, 0)], back)
            pointer[members] = back
        back = np.where(back >= first_of[members], back, -1)
        pointer[members] = back
        targets, hits = np.unique(back[back >= 0], return_counts=True)
        if len(targets):
            by = np.lexsort((hits, group[targets]))
            targets, hits = targets[by], hits[by]
            old = group[targets]
            edge = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
            moved = np.diff(np.append(edge, len(old)))
            slots = _ranges(old[edge] + size[old[edge]] - moved, moved)
            marked[targets] = True
            sitting = order[slots]
            out = sitting[~marked[sitting]]
            marked[targets] = False
            inside = np.zeros(len(targets), dtype=bool)
            spots = place[targets]
            inside = spots >= np.repeat(old[edge] + size[old[edge]] - moved, moved)
            free = np.sort(spots[~inside])
            order[free] = out
            place[out] = free
            order[slots] = targets
            place[targets] = slots
            size[old[edge]] -= moved
            run = np.append(True, (old[1:] != old[:-1]) | (hits[1:] != hits[:-1]))
            start = slots[run]
            group[targets] = start[np.cumsum(run) - 1]
            size[start] = np.diff(np.append(np.flatnonzero(run), len(run)))
        top[live] = g
        live = live[g > begins[live]]

    result = np.full(n, -1, dtype=np.int64)
    filled = np.zeros(n, dtype=np.int64)  # of the group that starts at a place
    done = np.zeros(n, dtype=bool)
    result[begins] = ends - 1
    done[ends - 1] = True
    at = begins.copy()
    live = np.arange(len(ends))
    while len(live):
        walk = result[at[live]] - 1
        walk = walk[walk >= begins[live]]
        while len(walk):
            walk = walk[~done[walk]]
            if not len(walk):
                break
            g = group[walk]
            result[g + filled[g]] = walk
            filled[g] += 1
            done[walk] = True
            walk = pointer[walk]
            walk = walk[walk >= 0]
        at[live] += 1
        live = live[at[live] < ends[live]]
    return result
