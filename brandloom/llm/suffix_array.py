"""Suffix arrays by induced sorting, and permuted common prefixes, in whole-array steps.

Suffixes are classified as smaller or larger than the next. The leftmost smaller (LMS) substrings
are sorted by one induction and named; while names repeat, pairs of names are named again, which
sorts the LMS suffixes; a second induction gives the array. An induction goes through the 256
buckets and, inside a bucket, through runs of its byte, so its steps are array operations.
"""

from __future__ import annotations

import numpy as np


def _smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last one is not."""
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])
    at = np.searchsorted(change, np.arange(n, dtype=np.int32))  # the first change from here on decides
    known = at < len(change)
    at = change[np.minimum(at, max(0, len(change) - 1))] if len(change) else np.zeros(n, np.int64)
    return known & (t[at] < t[np.minimum(at + 1, n - 1)])


def _deal(buckets: list[list[np.ndarray]], at: np.ndarray, byte: np.ndarray) -> None:
    order = np.argsort(byte, kind="stable")
    at, byte = at[order], byte[order]
    cuts = np.flatnonzero(byte[1:] != byte[:-1]) + 1
    for part, b in zip(np.split(at, cuts), byte[np.concatenate([[0], cuts])] if len(byte) else ()):
        buckets[b].append(part)


def _side(t: np.ndarray, kind: np.ndarray, buckets: list[list[np.ndarray]], other: list[np.ndarray], up: bool) -> list[np.ndarray]:
    """Go through the buckets and hand on each suffix's left neighbour of this kind."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * 256
    for c in range(256) if up else range(255, -1, -1):
        own = []
        wave = np.concatenate(buckets[c]) if buckets[c] else np.empty(0, np.int64)
        while len(wave):
            own.append(wave)
            left = wave[wave > 0] - 1
            left = left[kind[left]]
            byte = t[left]
            same = byte == c
            if not same.all():
                _deal(buckets, left[~same], byte[~same])
            wave = left[same]
        out[c] = np.concatenate(own) if own else out[c]
        if len(other[c]):
            left = other[c][other[c] > 0] - 1
            left = left[kind[left]]
            if len(left):
                _deal(buckets, left, t[left])
    return out


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the LMS suffixes in (some) order."""
    order = np.argsort(t[lms], kind="stable")
    cuts = np.searchsorted(t[lms][order], np.arange(257))
    seeds = [lms[order[cuts[c] : cuts[c + 1]]] for c in range(256)]
    first: list[list[np.ndarray]] = [[] for _ in range(256)]
    first[t[-1]].append(np.array([len(t) - 1]))
    large = _side(t, ~small, first, seeds, True)
    falling = _side(t, small, [[] for _ in range(256)], [x[::-1] for x in large], False)
    return np.concatenate([x for c in range(256) for x in (large[c], falling[c][::-1])])


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Positions of all suffixes of a byte array in ascending order."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    small = _smaller(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) < 2:
        return _induce(t, small, lms)
    place = np.full(n, -1, np.int64)
    place[lms] = np.arange(len(lms))
    sa = _induce(t, small, lms)
    ordered = sa[place[sa] >= 0]
    # Equal neighbours among the sorted LMS substrings (up to the next LMS place) share a name.
    end = np.append(lms[1:], n)
    length = (end - lms)[place[ordered]] + 1
    differ = np.ones(len(ordered), bool)
    live = np.flatnonzero((length[1:] == length[:-1]) & (ordered[1:] + length[1:] <= n) & (ordered[:-1] + length[:-1] <= n)) + 1
    differ[live] = False
    k = 0
    while len(live):
        other = t[ordered[live] + k] != t[ordered[live - 1] + k]
        differ[live[other]] = True
        live = live[~other]
        k += 1
        live = live[length[live] > k]
    name = np.empty(len(lms), np.int64)
    name[place[ordered]] = np.cumsum(differ) - 1
    step, m = 1, len(lms)
    while name.max() + 1 < m:
        after = np.zeros(m, np.int64)
        after[: m - step] = name[step:] + 1
        name = np.unique(name * (m + 1) + after, return_inverse=True)[1]
        step *= 2
    lms_sorted = np.empty(m, np.int64)
    lms_sorted[name] = lms
    return _induce(t, small, lms_sorted)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position the length of the prefix it shares with the suffix before it in the array.

    It is one less than at the position to the left, unless the bytes before the two differ; only
    there are bytes compared, eight at a time.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    pad = np.concatenate([t, np.zeros(16, np.uint8)]).astype(np.uint64)
    word = np.zeros(n + 8, np.uint64)
    for k in range(8):
        word |= pad[k : k + n + 8] << np.uint64(8 * k)
    at = np.arange(n)
    fresh = (before <= 0) | (at == 0)
    fresh |= t[at - 1] != t[np.maximum(before - 1, 0)]
    own = np.flatnonzero(fresh & (before >= 0))
    shared = np.zeros(len(own), np.int64)
    live = np.arange(len(own))
    while len(live):
        a, b = own[live] + shared[live], before[own[live]] + shared[live]
        x = word[np.minimum(a, n)] ^ word[np.minimum(b, n)]
        same = np.where(x == 0, 8, np.log2((x & (~x + np.uint64(1))).astype(np.float64) + (x == 0)).astype(np.int64) >> 3)
        same = np.minimum(same, np.minimum(n - a, n - b))
        shared[live] += same
        live = live[same == 8]
    reach = np.zeros(n, np.int64)
    reach[own] = own + shared
    return np.where(before >= 0, np.maximum.accumulate(reach) - at, 0)
