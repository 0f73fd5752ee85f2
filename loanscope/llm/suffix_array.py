"""Suffix array by induced sorting, and permuted common prefixes.

Suffixes are larger (L) or smaller (S) than their successor; an S after an L is
leftmost-smaller (LMS).  Placing the LMS suffixes at the ends of their letters'
buckets and scanning forwards for L and backwards for S sorts the substrings
between them; numbering those gives a string of at most half the length, sorted
first; a second pair of scans, from the LMS suffixes in final order, sorts all
suffixes.  The scans handle all waiting suffixes of a bucket at once, which
suits a small alphabet; strings over a large one, as the numbers mostly are,
are sorted by prefix doubling.
"""

from __future__ import annotations

import numpy as np

# Alphabets up to this size are scanned bucket by bucket.
SMALL = 1024


def _types(s: np.ndarray) -> np.ndarray:
    """True for S-type positions; the last letter must be smaller than all others."""
    n = len(s)
    step = np.sign(np.diff(s.astype(np.int64)))
    later = np.where(step != 0, np.arange(n - 1), n)
    later = np.minimum.accumulate(later[::-1])[::-1]
    return np.append(step[later] > 0, True)


def _induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, letters: int) -> np.ndarray:
    """All suffixes sorted as far as the order of the given LMS positions (within a bucket) tells."""
    sa = np.full(len(s), -1, np.int64)
    ends = np.cumsum(np.bincount(s, minlength=letters))
    heads = np.append(0, ends[:-1])

    def grouped(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(s[q], kind="stable")
        q = q[order]
        of = s[q]
        counts = np.bincount(of, minlength=letters)
        return q, of, counts, np.arange(len(q)) - (np.cumsum(counts) - counts)[of]

    q, of, kept, rank = grouped(lms)
    sa[(ends - kept)[of] + rank] = q
    used = np.flatnonzero(ends > heads).tolist()

    head = heads.copy()

    def push_larger(batch: np.ndarray) -> None:
        q = batch - 1
        q = q[q >= 0]
        q = q[~smaller[q]]
        if len(q):
            q, of, counts, rank = grouped(q)
            sa[head[of] + rank] = q
            head[:] += counts

    for c in used:
        done = heads[c]
        while done < head[c]:
            upto = head[c]
            push_larger(sa[done:upto])
            done = upto
        if kept[c]:
            push_larger(sa[ends[c] - kept[c]:ends[c]])

    tail = ends.copy()
    tail[s[-1]] -= 1
    sa[tail[s[-1]]] = len(s) - 1

    def push_smaller(batch: np.ndarray) -> None:
        q = batch - 1
        q = q[q >= 0]
        q = q[smaller[q]]
        if len(q):
            q, of, counts, rank = grouped(q)
            sa[tail[of] - 1 - rank] = q
            tail[:] -= counts

    for c in reversed(used):
        done = ends[c]
        while tail[c] < done:
            down = tail[c]
            push_smaller(sa[down:done][::-1])
            done = down
        push_smaller(sa[heads[c]:head[c]][::-1])
    return sa


def _doubled(s: np.ndarray) -> np.ndarray:
    """Suffixes of a string over a large alphabet, sorted by prefix doubling: each round sorts only those still tied."""
    sa = np.argsort(s, kind="stable")
    rank = np.empty(len(s), np.int64)
    left, at, key, k = sa, np.arange(len(s)), s[sa].astype(np.int64), 1
    while True:
        turn = np.concatenate([[True], key[1:] != key[:-1], [True]])
        rank[left] = at[np.maximum.accumulate(np.where(turn[:-1], np.arange(len(at)), 0))]   # the place of the first tied one
        tied = ~(turn[:-1] & turn[1:])
        left, at = left[tied], at[tied]
        if not len(left):
            return sa
        key = rank[left] << 32 | rank[left + k]         # within the string: tied suffixes do not reach its last letter
        order = np.argsort(key)
        left, key, k = left[order], key[order], 2 * k
        sa[at] = left


def _names(s: np.ndarray, order: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Numbers of sorted LMS substrings; equal ones share a number."""
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    left, k = np.flatnonzero(same), 0
    while len(left):
        left = left[length[a[left]] >= k]
        differ = s[a[left] + k] != s[b[left] + k]
        same[left[differ]] = False
        left, k = left[~differ], k + 1
        left = left[length[a[left]] >= k]
    return np.append(0, np.cumsum(~same))


def suffix_array(s: np.ndarray, letters: int) -> np.ndarray:
    """Start positions of the suffixes of ``s`` in order; its last letter must be smaller than all others."""
    if len(s) == 1:
        return np.zeros(1, np.int64)
    if letters > SMALL:
        return _doubled(s)
    smaller = _types(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    found = _induce(s, smaller, lms, letters)
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    order = found[is_lms[found]]
    length = np.zeros(len(s), np.int64)
    length[lms[:-1]] = np.diff(lms)
    names = _names(s, order, length)
    if names[-1] + 1 < len(lms):
        named = np.empty(len(s), np.int64)
        named[order] = names
        order = lms[suffix_array(named[lms], int(names[-1]) + 1)]
    return _induce(s, smaller, order, letters)


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix in ``sa`` with the one before it (0 for the first).

    Computed in text order: where the letters before a suffix and before its
    predecessor agree, the length is one less than the position before's, so
    only the other positions are compared, eight letters at a time.
    """
    n = len(s)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    at = np.arange(n)
    previous = s[np.maximum(at - 1, 0)]
    compared = (at == 0) | (before <= 0) | (previous != s[np.maximum(before - 1, 0)])
    i = np.flatnonzero(compared & (before >= 0))
    j = before[i]
    length = np.zeros(n, np.int64)
    padded = np.concatenate([s, np.zeros(8, s.dtype)])
    left = np.arange(len(i))
    lengths = np.zeros(len(i), np.int64)
    steps = np.arange(8)
    while len(left):
        x, y = i[left] + lengths[left], j[left] + lengths[left]
        equal = (padded[x[:, None] + steps] == padded[y[:, None] + steps]) & (np.maximum(x, y)[:, None] + steps < n)
        run = np.where(equal.all(axis=1), 8, equal.argmin(axis=1))
        lengths[left] += run
        left = left[run == 8]
    length[i] = lengths
    last = np.maximum.accumulate(np.where(compared, at, 0))
    permuted = length[last] - (at - last)
    return np.where(before[sa] >= 0, permuted[sa], 0)
