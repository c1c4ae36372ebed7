"""Suffix arrays by induced sorting, and permuted common prefixes.

``suffix_array`` sorts a byte text linearly: suffixes are classed as smaller (S)
or larger (L) than their right neighbour, the leftmost-S substrings are sorted
and named, the string of names is sorted by doubling, and its order induces that
of all suffixes. Of the text itself, buckets are worked off as wholes in numpy.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one. The last symbol is the least."""
    n = len(t)
    step = np.sign(t[1:].astype(np.int32) - t[:-1].astype(np.int32))
    at = np.where(step != 0, np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    small = np.ones(n, bool)
    small[:-1] = np.r_[step, -1][np.minimum(at, n - 1)] > 0
    return small


def _deal(found: np.ndarray, symbols: np.ndarray, to: list[list[np.ndarray]]) -> None:
    """Append positions to the buckets of their symbols, in order."""
    if not len(found):
        return
    order = np.argsort(symbols, kind="stable")
    found, symbols = found[order], symbols[order]
    cut = np.flatnonzero(np.diff(symbols)) + 1
    starts = [0, *cut.tolist()]
    for a, b in zip(starts, [*starts[1:], len(found)]):
        to[symbols[a]].append(found[a:b])


def _before(part: np.ndarray, kind: np.ndarray, want: bool) -> np.ndarray:
    """Positions to the left of some, where they are of the wanted type."""
    before = part[part > 0] - 1
    return before[kind[before] == want]


def _induce(t: np.ndarray, small: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """All suffixes in order, from leftmost-S suffixes in order within their buckets.

    A bucket is worked off in waves: all that other buckets have put there, then
    what each wave induces into the bucket itself.
    """
    size = 256
    marks: list[list[np.ndarray]] = [[] for _ in range(size)]
    _deal(leftmost, t[leftmost], marks)
    large: list[list[np.ndarray]] = [[] for _ in range(size)]
    for c in range(size):
        done = 0
        while done < len(large[c]):
            wave = np.concatenate(large[c][done:])
            large[c][done:] = [wave]
            done += 1
            before = _before(wave, small, False)
            _deal(before, t[before], large)
        for part in marks[c]:
            before = _before(part, small, False)
            _deal(before, t[before], large)
    less: list[list[np.ndarray]] = [[] for _ in range(size)]  # each bucket from its end
    less[t[-1]].append(np.array([len(t) - 1], np.int64))
    for c in range(size - 1, -1, -1):
        done = 0
        while done < len(less[c]):
            wave = np.concatenate(less[c][done:])
            less[c][done:] = [wave]
            done += 1
            before = _before(wave, small, True)
            _deal(before, t[before], less)
        if large[c]:
            before = _before(np.concatenate(large[c])[::-1], small, True)
            _deal(before, t[before], less)
    out = []
    for c in range(size):
        out += large[c]
        out += [part[::-1] for part in reversed(less[c])]
    return np.concatenate(out)


def _names(t: np.ndarray, small: np.ndarray, order: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rank of each leftmost-S substring (in ``order``); equal substrings share one."""
    length = ends[order] - order
    same = length[1:] == length[:-1]
    left, right, upto = order[:-1], order[1:], length[:-1]
    active = np.flatnonzero(same)
    k = 0
    while len(active):
        a, b = left[active] + k, right[active] + k
        differ = (t[a] != t[b]) | (small[a] != small[b])
        same[active[differ]] = False
        active = active[~differ & (upto[active] > k)]
        k += 1
    return np.r_[0, np.cumsum(~same)]


def _sorted_names(s: np.ndarray) -> np.ndarray:
    """Suffix array of a string of names, of which the last is the only 0.

    Names are too many for whole buckets to pay. Suffixes are ranked by twice as
    many names each time, and only those that still share their rank.
    """
    sa = np.argsort(s, kind="stable")
    rank = np.empty(len(s), np.int64)
    active, key, k = np.arange(len(s)), s[sa], 1
    while len(active):
        fresh = np.r_[True, key[1:] != key[:-1]]
        rank[sa[active]] = np.maximum.accumulate(np.where(fresh, active, 0))
        active = active[~(fresh & np.r_[fresh[1:], True])]
        # suffixes of one rank share k names, none of them the last, so k names further there is another
        at = sa[active]
        key = rank[at] * len(s) + rank[at + k]
        order = np.argsort(key, kind="stable")
        sa[active], key, k = at[order], key[order], 2 * k
    return sa


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of the suffixes of uint8 symbols that end in their only 0."""
    if len(t) == 1:
        return np.zeros(1, np.int64)
    small = _types(t)
    marks = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    ends = np.zeros(len(t), np.int64)
    ends[marks] = np.r_[marks[1:], len(t) - 1]
    is_mark = np.zeros(len(t), bool)
    is_mark[marks] = True
    sa = _induce(t, small, marks)
    order = sa[is_mark[sa]]
    names = _names(t, small, order, ends)
    if names[-1] + 1 < len(order):
        of = np.zeros(len(t), np.int64)
        of[order] = names
        order = marks[_sorted_names(of[marks])]
    return _induce(t, small, order)


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """By text position: the common prefix with the suffix before it in ``sa``.

    Where the symbols to the left of both suffixes agree, the value is one less
    than the position's before; only the others are compared, eight bytes at a time.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    own = np.arange(n)
    alone = before < 0
    fresh = alone | (before == 0) | (own == 0)
    rest = np.flatnonzero(~fresh)
    fresh[rest] = t[rest - 1] != t[before[rest] - 1]
    padded = np.r_[t, np.zeros(16, np.uint8)]
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (n + 8, 8), (1, 1))
    out = np.zeros(n, np.int64)
    active = np.flatnonzero(fresh & ~alone)
    k = 0
    while len(active):
        a, b = active + k, before[active] + k
        inside = (a < n) & (b < n)
        active, a, b = active[inside], a[inside], b[inside]
        differ = words[a] != words[b]
        any_differ = differ.any(axis=1)
        out[active] = k + np.where(any_differ, differ.argmax(axis=1), 8)
        active = active[~any_differ]
        k += 8
    at = np.maximum.accumulate(np.where(fresh, own, 0))
    return np.maximum(out[at] - (own - at), 0)
