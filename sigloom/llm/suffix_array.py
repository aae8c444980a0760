"""Suffix arrays by induced sorting, and permuted common prefixes."""

from __future__ import annotations

import numpy as np

from sigloom.llm.hashing import prefixes, between

SMALL_ALPHABET = 512


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last (the sentinel) is."""
    n = len(s)
    small = np.ones(n, bool)
    if n > 1:
        at = np.where(s[:-1] != s[1:], np.arange(n - 1), n)
        at = np.minimum.accumulate(at[::-1])[::-1]  # where the run of equal symbols ends
        small[:-1] = s[at] < s[at + 1]
    return small


def _by_bucket(s, small, first, heads, tails):
    """Sorts all suffixes, given leftmost-smaller ones in order, a bucket at a time.

    Within a bucket, all suffixes found so far put their left neighbours into place in one step;
    only a run of one symbol takes further steps.
    """
    n, k = len(s), len(heads)
    sa = np.full(n, -1, np.int64)

    def grouped(j):
        c = s[j]
        order = np.argsort(c, kind="stable")
        counts = np.bincount(c, minlength=k)
        c = c[order]
        return j[order], c, counts, np.arange(len(c)) - (np.cumsum(counts) - counts)[c]

    j, c, lms, within = grouped(first)
    sa[tails[c] - lms[c] + within] = j
    used = np.flatnonzero(tails > heads)

    head = heads.copy()

    def forward(block):
        j = block[block > 0] - 1
        j = j[~small[j]]
        if len(j):
            j, c, counts, within = grouped(j)
            sa[head[c] + within] = j
            np.add(head, counts, out=head)

    for b in used:
        done = heads[b]
        while done < head[b]:
            block, done = sa[done : head[b]], head[b]
            forward(block)
        if lms[b]:
            forward(sa[tails[b] - lms[b] : tails[b]])

    tail = tails.copy()

    def backward(block):
        j = block[block > 0] - 1
        j = j[small[j]]
        if len(j):
            j, c, counts, within = grouped(j)
            sa[tail[c] - 1 - within] = j
            np.subtract(tail, counts, out=tail)

    for b in used[::-1]:
        done = tails[b]
        while tail[b] < done:
            block, done = sa[tail[b] : done][::-1].copy(), tail[b]
            backward(block)
        backward(sa[heads[b] : head[b]][::-1])
    sa[0] = n - 1
    return sa


def _by_suffix(s, small, first, heads, tails):
    """As _by_bucket, a suffix at a time: for large alphabets, whose buckets are tiny."""
    n = len(s)
    text, kind = s.tolist(), small.tolist()
    sa = [-1] * n
    tail = tails.tolist()
    for p in first[::-1].tolist():
        c = text[p]
        tail[c] -= 1
        sa[tail[c]] = p
    head = heads.tolist()
    for p in sa:  # grows ahead of the loop
        if p > 0:
            p -= 1
            if not kind[p]:
                c = text[p]
                sa[head[c]] = p
                head[c] += 1
    tail = tails.tolist()
    for i in range(n - 1, -1, -1):
        p = sa[i] - 1
        if p >= 0 and kind[p]:
            c = text[p]
            tail[c] -= 1
            sa[tail[c]] = p
    sa[0] = n - 1
    return np.array(sa)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The order of the suffixes of s: whole numbers from 0, which only the last one is.

    Suffixes are classed by whether they are smaller than their right neighbour. The substrings
    between leftmost smaller ones are sorted by induction and named; if names repeat, the string
    of names is sorted in the same way; from the order of the leftmost smaller suffixes that of
    all is induced, in linear time.
    """
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sizes = np.bincount(s)
    tails = np.cumsum(sizes)
    heads = tails - sizes
    induce = _by_bucket if len(sizes) <= SMALL_ALPHABET else _by_suffix

    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = induce(s, small, lms, heads, tails)
    order = order[is_lms[order]]

    ends = np.append(lms[1:] + 1, n)
    code = between(prefixes(s), lms, ends)
    at = np.searchsorted(lms, order)
    length = (ends - lms)[at]
    code = code[at]
    new = np.ones(len(order), bool)
    new[1:] = (code[1:] != code[:-1]) | (length[1:] != length[:-1])
    names = np.cumsum(new) - 1
    if names[-1] + 1 < len(order):
        reduced = np.empty(len(order), np.int64)
        reduced[at] = names
        order = lms[suffix_array(reduced)]
    return induce(s, small, order, heads, tails)


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, the length that its suffix shares with the one before it in order.

    Where the symbols to the left of both agree, the value is that of the position to the left
    less one; only the others are found by comparison, eight bytes at a time. s: bytes.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    p = np.arange(n)
    known = (p > 0) & (before > 0)
    known[known] = s[p[known] - 1] == s[before[known] - 1]
    at = np.flatnonzero(~known & (before >= 0))
    padded = np.concatenate([s, np.zeros(16, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(np.uint64)[:, 0]
    a, b = at, before[at]
    shared = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    while len(live):
        x, y = a[live] + shared[live], b[live] + shared[live]
        same = (np.maximum(x, y) + 8 <= n) & (eight[np.minimum(x, n)] == eight[np.minimum(y, n)])
        shared[live[same]] += 8
        live = live[same]
    live = np.arange(len(at))
    for _ in range(8):
        x, y = a[live] + shared[live], b[live] + shared[live]
        same = (np.maximum(x, y) < n) & (padded[x] == padded[y])
        shared[live[same]] += 1
        live = live[same]
    found = np.zeros(n, np.int64)
    found[at] = shared
    last = np.maximum.accumulate(np.where(known, 0, p))
    return np.maximum(found[last] - (p - last), 0)
