"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

Symbols are classified as smaller (S) or larger (L) than the suffix to their right. The
leftmost S of each run (LMS) starts a substring; these are sorted by inducing, named, and
where names repeat the string of names is sorted recursively. One more induction gives the
whole array. Each induction walks the buckets of the alphabet once; what a bucket induces is
placed in whole waves, so the work is linear and the Python steps follow the alphabet, not
the text.
"""

from __future__ import annotations

import numpy as np

from labelforge.llm.common import ragged

#: Recurse while a bucket of the reduced string holds at least so many symbols on average;
#: sparser strings are nearly sorted by their names and are finished by doubling.
_DENSE = 64


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``t``: symbols 0 … K-1, all of them used; the last symbol is 0 and no other is."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int32)
    t = t.astype(np.uint16 if int(t.max()) < 1 << 16 else np.int32)
    small = _smaller(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    if len(lms) == 1:
        return _induce(t, small, lms)
    rough = _induce(t, small, lms[np.argsort(t[lms], kind="stable")])
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    name_at = np.zeros(n, np.int32)
    name_at[ordered] = _names(t, lms, ordered)
    reduced = name_at[lms]
    names = int(reduced.max()) + 1
    if names == len(lms):
        rank = np.empty(names, np.int32)
        rank[reduced] = np.arange(names, dtype=np.int32)
        order = rank
    elif len(lms) >= _DENSE * names:
        order = suffix_array(reduced)
    else:
        order = _double(reduced)
    return _induce(t, small, lms[order])


def _smaller(t: np.ndarray) -> np.ndarray:
    """S types: the next different symbol to the right is larger; the sentinel is S."""
    step = np.sign(np.diff(t.astype(np.int32))).astype(np.int8)
    at = np.where(step != 0, np.arange(len(step)), len(step))
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    return np.concatenate((np.concatenate((step, [-1]))[nearest] > 0, [True]))


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Suffix array from LMS suffixes in order (by bucket, and as given inside each)."""
    n, symbols = len(t), int(t.max()) + 1
    sizes = np.bincount(t, minlength=symbols)
    tail = np.cumsum(sizes)
    head = tail - sizes
    sa = np.full(n, -1, np.int32)
    lms_edge = np.searchsorted(t[lms], np.arange(symbols + 1))

    fill = head.copy()
    for c in range(symbols):
        at = int(head[c])
        while at < fill[c]:
            wave, at = sa[at:fill[c]], int(fill[c])
            _place(t, ~small, wave, sa, fill, 1)
        _place(t, ~small, lms[lms_edge[c]:lms_edge[c + 1]], sa, fill, 1)
    larger_end = fill
    fill = tail.copy()
    sa[0] = n - 1
    fill[0] -= 1
    for c in range(symbols - 1, -1, -1):
        at = int(tail[c])
        while at > fill[c]:
            wave, at = sa[fill[c]:at][::-1], int(fill[c])
            _place(t, small, wave, sa, fill, -1)
        _place(t, small, sa[head[c]:larger_end[c]][::-1], sa, fill, -1)
    return sa


def _place(t: np.ndarray, wanted: np.ndarray, wave: np.ndarray, sa: np.ndarray, fill: np.ndarray, step: int) -> None:
    """Put the predecessors of ``wave`` that have the wanted type into their buckets, in order."""
    before = wave[wave > 0] - 1
    before = before[wanted[before]]
    if not len(before):
        return
    symbol = t[before]
    order = np.argsort(symbol, kind="stable")
    symbol, before = symbol[order], before[order]
    heads = np.flatnonzero(np.concatenate(([True], symbol[1:] != symbol[:-1])))
    counts = np.diff(np.concatenate((heads, [len(symbol)])))
    kinds = symbol[heads]
    rank = np.arange(len(symbol)) - np.repeat(heads, counts)
    start = np.repeat(fill[kinds], counts)
    sa[start + rank if step > 0 else start - 1 - rank] = before
    fill[kinds] += step * counts


def _names(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Rank of each LMS substring among the sorted ones, equal for equal substrings."""
    length_at = np.zeros(len(t), np.int32)
    length_at[lms] = np.concatenate((np.diff(lms), [0])) + 1
    length = length_at[ordered]
    same = np.flatnonzero(length[1:] == length[:-1])
    differs = np.ones(len(ordered), bool)
    for part in np.array_split(same, max(1, int(length[same].sum()) >> 20)):
        if len(part):
            size = length[part]
            a, b = ragged(ordered[part], size), ragged(ordered[part + 1], size)
            differs[part + 1] = np.add.reduceat((t[a] != t[b]).astype(np.int32), np.cumsum(size) - size) > 0
    return (np.cumsum(differs) - 1).astype(np.int32)


def _double(t: np.ndarray) -> np.ndarray:
    """Suffix order of a string whose symbols are mostly rare, by doubling the compared length."""
    n, rank, step = len(t), t.astype(np.int64), 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[:n - step] = rank[step:] + 1
        pair = rank * (n + 1) + ahead
        order = np.argsort(pair, kind="stable")
        sorted_pair = pair[order]
        new = np.cumsum(np.concatenate(([0], (sorted_pair[1:] != sorted_pair[:-1]).astype(np.int64))))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order.astype(np.int32)
        step *= 2


def permuted_lcp(t: np.ndarray, sa: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """For each position, the common prefix with the suffix before it in the array, at most ``rest``.

    A position whose left neighbour equals the left neighbour of its predecessor has one less
    than the position before it; only the others are compared symbol by symbol.
    """
    n = len(t)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    own = np.ones(n, bool)
    inner = np.flatnonzero((before[1:] > 0) & (rest[1:] == rest[:-1] - 1)) + 1
    own[inner] = t[inner - 1] != t[before[inner] - 1]
    at = np.flatnonzero(own & (before >= 0))
    length = np.zeros(len(at), np.int32)
    live = np.flatnonzero(rest[at] > 0)
    while len(live):
        i, j = at[live] + length[live], before[at[live]] + length[live]
        live = live[(t[i] == t[np.minimum(j, n - 1)]) & (j < n)]
        length[live] += 1
        live = live[length[live] < rest[at[live]]]
    plcp = np.zeros(n, np.int32)
    plcp[at] = length
    lead = np.maximum.accumulate(np.where(own, np.arange(n, dtype=np.int32), 0))
    return np.maximum(plcp[lead] - (np.arange(n, dtype=np.int32) - lead), 0)
