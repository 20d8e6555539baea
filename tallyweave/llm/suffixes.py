"""Suffix arrays by induced sorting, permuted common prefixes, and which suffixes share a long prefix.

Induced sorting: suffixes are classified as larger (L) or smaller (S) than their successor; the leftmost S ones (LMS) of each run
are sorted first, by naming the substrings between them and sorting the string of names recursively; then one pass over the buckets from
the left places all L suffixes behind LMS ones, and one from the right all S suffixes. Where buckets are large, a pass handles one at a time: what
its suffixes induce is placed by a stable counting sort on the preceding characters, which NumPy does. Strings of names, whose
buckets are short, take the same two passes suffix by suffix. Both are linear, at every level of the recursion.

Common prefixes: a suffix's prefix shared with its predecessor in the array is at least that of the suffix one place to its left less one,
and exactly that if the characters before both are equal. So only the others (the irreducible ones) are compared, all at once.
"""

from __future__ import annotations

import numpy as np

from . import textvec as tv

#: Suffixes a bucket from which on passes go bucket by bucket
BUCKET = 256


def _types(t: np.ndarray) -> np.ndarray:
    """True for S suffixes; the end of the string is smaller than any character."""
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])
    smaller = np.zeros(n, bool)
    if len(change):
        runs = np.diff(np.concatenate([[-1], change]))
        smaller[: change[-1] + 1] = np.repeat(t[change] < t[change + 1], runs)
    return smaller


def _spread(to: dict[int, list], t: np.ndarray, j: np.ndarray) -> None:
    if len(j):
        c = t[j]
        order = np.argsort(c, kind="stable")
        j, c = j[order], c[order]
        cuts = np.flatnonzero(c[1:] != c[:-1]) + 1
        for part, first in zip(np.split(j, cuts), c[np.concatenate([[0], cuts])].tolist(), strict=True):
            to.setdefault(first, []).append(part)


def _by_bucket(t: np.ndarray, small: np.ndarray, lms: np.ndarray, letters: list[int]) -> np.ndarray:
    n, empty = len(t), np.zeros(0, np.int64)
    seeds: dict[int, list] = {}
    _spread(seeds, t, lms)
    wait: dict[int, list] = {int(t[n - 1]): [np.array([n - 1])]}
    large: dict[int, np.ndarray] = {}
    for c in letters:
        got, cur = [], np.concatenate(wait.pop(c)) if c in wait else empty
        while len(cur):
            got.append(cur)
            j = cur[cur > 0] - 1
            j = j[~small[j]]
            same = t[j] == c
            _spread(wait, t, j[~same])
            cur = j[same]
        large[c] = np.concatenate(got) if got else empty
        for s in seeds.get(c, ()):
            _spread(wait, t, s[s > 0] - 1)
    wait, out = {}, []
    for c in reversed(letters):
        got, cur = [], np.concatenate(wait.pop(c)) if c in wait else empty
        while len(cur):
            got.append(cur)
            j = cur[cur > 0] - 1
            j = j[small[j]]
            same = t[j] == c
            _spread(wait, t, j[~same])
            cur = j[same]
        back = large[c][::-1]
        j = back[back > 0] - 1
        _spread(wait, t, j[small[j]])
        out += [*([np.concatenate(got)] if got else []), back]
    return np.concatenate(out)[::-1]


def _by_suffix(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    n = len(t)
    ends = np.cumsum(np.bincount(t))
    heads, tails = np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()
    out = np.full(n, -1, np.int64)
    by_char = np.argsort(t[lms], kind="stable")  # the seeds stand at their buckets' ends, in their order
    c = t[lms][by_char]
    out[ends[c] - np.searchsorted(c, c, side="right") + np.arange(len(c))] = lms[by_char]
    # of each suffix, the character before it, if the suffix that begins there is of the kind that a pass places; else -1 (as for -1, no suffix)
    none = np.full(n + 1, -1, np.int64)
    large, little = none.copy(), none.copy()
    large[1:n], little[1:n] = np.where(small[:-1], -1, t[:-1].astype(np.int64)), np.where(small[:-1], t[:-1].astype(np.int64), -1)
    sa, large, little = out.tolist(), large.tolist(), little.tolist()
    c = int(t[n - 1])
    sa[heads[c]] = n - 1
    heads[c] += 1
    for i in sa:  # places behind this one are filled on the way
        c = large[i]
        if c >= 0:
            at = heads[c]
            sa[at] = i - 1
            heads[c] = at + 1
    for i in reversed(sa):
        c = little[i]
        if c >= 0:
            at = tails[c] - 1
            sa[at] = i - 1
            tails[c] = at
    return np.array(sa, np.int64)


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes, given the LMS ones in an order that is right within their buckets."""
    letters = np.unique(t)
    if len(t) >= BUCKET * len(letters):
        return _by_bucket(t, small, lms, letters.tolist())
    return _by_suffix(t, small, lms)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffixes of t (non-negative numbers) in their order."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(lms):
        return _induce(t, small, lms)
    first = _induce(t, small, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by_piece = first[is_lms[first]]
    # equal substrings from one LMS place to the next one (inclusive) get equal names
    up, down = tv.powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((t.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        after = np.minimum(np.concatenate([lms[1:], [n - 1]]) + 1, n)
        piece = np.zeros(n, np.uint64)
        piece[lms] = tv.mix((sums[after] - sums[lms]) * down[lms] + (after - lms).astype(np.uint64))
        piece[lms[-1]] = np.uint64(1)  # the last one ends with the string
    name = np.zeros(n, np.int64)
    name[by_piece] = np.concatenate([[0], np.cumsum(piece[by_piece[1:]] != piece[by_piece[:-1]])])
    names = name[lms]
    lms = lms[suffix_array(names)] if names.max() + 1 < len(lms) else by_piece
    return _induce(t, small, lms)


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each suffix of the array, the length of the prefix that it shares with the one before it (0 for the first)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    irreducible = np.ones(n, bool)
    irreducible[1:] = (before[1:] < 1) | (data[:-1] != data[before[1:] - 1])
    found = np.zeros(n, np.int64)
    a = np.flatnonzero(irreducible & (before >= 0))
    b, at = before[a], a
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data.astype(np.uint8), np.zeros(8, np.uint8)]), 8)[: n + 1].copy().view(np.uint64).ravel()
    while len(a):
        differs = eight[a] ^ eight[b]
        room = n - np.maximum(a, b)  # bytes left; behind them are zeros
        same = np.full(len(a), 8, np.int64)
        some = np.flatnonzero(differs)
        low = differs[some] & (~differs[some] + np.uint64(1))
        same[some] = np.log2(low.astype(np.float64)).astype(np.int64) // 8  # bytes before the first that differs (the lowest)
        same = np.minimum(same, room)
        found[at] += same
        on = (same == 8) & (room > 8)
        a, b, at = a[on] + 8, b[on] + 8, at[on]
    last = np.maximum.accumulate(np.where(irreducible, np.arange(n), 0))
    permuted = found[last] - (np.arange(n) - last)
    return permuted[order]


def repeated(order: np.ndarray, prefixes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of the starts (a flag for each place) have an equal string of ``length`` at another start."""
    group = np.cumsum(prefixes < length)  # neighbours in the array that share the string
    there = starts[order]
    flag = np.zeros(len(order), bool)
    if len(order):
        flag[order] = there & (np.bincount(group, there)[group] > 1)
    return flag
