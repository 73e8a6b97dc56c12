"""Suffix arrays of byte strings in numpy: refinement by doubling and common prefixes."""

from __future__ import annotations

import numpy as np

from percussa.llm.common import words64


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions of `data` in the order of their first `depth` bytes (at least), by Larsson-Sadakane refinement.

    The first pass orders by 8 bytes. Each further pass orders only the groups that are still tied, by the rank of
    the suffix h bytes on, and doubles h. A group's rank is the place of its last member, as there. Suffixes that run
    into the end are padded with zero bytes; equal ones stay tied and in any order.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    key = words64(data).byteswap()
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    starts = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    del key, ordered
    rank = np.empty(n, np.int64)

    def renumber(at: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Rank the suffixes at the places `at` of the array; returns the sizes of their groups, one for each."""
        first = np.flatnonzero(begins)
        size = np.diff(np.concatenate([first, [len(at)]]))
        rank[sa[at]] = np.repeat(at[first + size - 1], size)
        return np.repeat(size, size)

    tied = np.arange(n)
    tied = tied[renumber(tied, starts) > 1]
    h = 8
    while h < depth and len(tied):
        here = sa[tied]
        ahead = np.where(here + h < n, rank[np.minimum(here + h, n - 1)] + 1, 0)
        group = rank[here]
        combined = group * np.int64(n + 1) + ahead
        order = np.argsort(combined, kind="stable")
        sa[tied] = here[order]
        combined = combined[order]
        begins = np.concatenate([[True], combined[1:] != combined[:-1]])
        tied = tied[renumber(tied, begins) > 1]
        h *= 2
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray, cap: int, lane: int = 64) -> np.ndarray:
    """Kasai's common prefixes, up to `cap`: how many bytes each suffix shares with the one before it in the array.

    Kasai walks the text in order and keeps all but one byte of the last match. Here the text is cut into lanes of
    `lane` positions which walk in step, each from its own start. `sa` must be ordered to a depth of `cap` or more.
    """
    n = len(data)
    lcp = np.zeros(n, np.int32)
    if n < 2:
        return lcp
    rank = np.empty(n, np.int64)
    rank[sa] = np.arange(n)
    held = np.concatenate([data, np.zeros(cap + 8, np.uint8)])
    at8 = words64(held)
    begin = np.arange(0, n, lane)
    kept = np.zeros(len(begin), np.int64)
    for step in range(lane):
        i = begin + step
        if i[-1] >= n:
            i, begin, kept = i[:-1], begin[:-1], kept[:-1]
            if not len(i):
                break
        r = rank[i]
        j = sa[np.maximum(r - 1, 0)]
        got = np.where(r > 0, kept, 0)
        open_ = np.flatnonzero((r > 0) & (got < cap))
        while len(open_):
            a, b = i[open_] + got[open_], j[open_] + got[open_]
            differ = at8[a] ^ at8[b]
            # Equal bytes before the first one that differs.
            low = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) >> 3)
            room = np.minimum(cap, n - np.maximum(i[open_], j[open_])) - got[open_]
            got[open_] += np.minimum(same, room)
            open_ = open_[(same == 8) & (room > 8)]
        lcp[r] = got
        # A match up to the cap may be a tie that the array leaves open, and then says nothing about the next suffix.
        kept = np.where(got < cap, np.maximum(got - 1, 0), 0)
    return lcp
