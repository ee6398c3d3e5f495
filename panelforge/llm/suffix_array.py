"""Suffix arrays by induced sorting, in numpy, and permuted longest common prefixes.

Induction goes through the buckets of first symbols in chunks.  A chunk is a run of symbols none of which is induced
from another symbol of the chunk, so all of its suffixes of the type in question are in place but for those induced
within a run of one symbol; these are laid out at once from the lengths of the runs.  A chunk is then a few array
operations, for small alphabets and for the large ones of reduced texts alike.
"""

from __future__ import annotations

import numpy as np

from .flat import U64, order_of


def classify(t: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than their successor (S); the end of the text is smaller than all."""
    n = len(t)
    sign = np.zeros(n, np.int8)
    sign[:-1] = np.sign(t[1:].astype(np.int32) - t[:-1])
    sign[-1] = -1
    at = np.where(sign != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where neighbours differ
    return sign[at] > 0


def _place(sa: np.ndarray, edge: np.ndarray, symbols: np.ndarray, items: np.ndarray, down: bool) -> None:
    """Append items to their buckets, at heads upwards or at tails downwards."""
    n = len(items)
    if not n:
        return
    order = np.argsort(symbols, kind="stable") if n < 4096 or symbols.dtype == np.uint16 else order_of(symbols.astype(U64))
    s = symbols[order]
    start = np.flatnonzero(s[1:] != s[:-1]) + 1
    if not len(start):  # one bucket
        at = int(edge[s[0]])
        if down:
            sa[at - n : at] = items[::-1]
        else:
            sa[at : at + n] = items
        edge[s[0]] += -n if down else n
        return
    start = np.concatenate(([0], start))
    count = np.empty(len(start), np.int64)
    count[:-1] = start[1:] - start[:-1]
    count[-1] = n - start[-1]
    own = s[start]
    if down:
        place = np.repeat(edge[own] - 1 + start, count) - np.arange(n)
        edge[own] -= count
    else:
        place = np.repeat(edge[own] - start, count) + np.arange(n)
        edge[own] += count
    sa[place] = items[order]


def _chunks(present: np.ndarray, bound: np.ndarray, down: bool) -> list[tuple[int, int]]:
    """Runs of the symbols present (first and last index, in the order of the pass) without dependence inside."""
    symbols, limit = present.tolist(), bound[present].tolist()
    turn = range(len(symbols) - 1, -1, -1) if down else range(len(symbols))
    out, first = [], None
    for i in turn:
        if first is None:
            first = last = i
        elif (limit[i] <= symbols[first]) if down else (limit[i] >= symbols[first]):
            out.append((first, last))
            first = i
        last = i
    if first is not None:
        out.append((first, last))
    return out


def _runs(items: np.ndarray, left: np.ndarray) -> np.ndarray:
    """What items induce inside their runs of one symbol: all items a place back, then all two places back, and so on."""
    r = left[items]
    items, r = items[r > 0], r[r > 0]
    if not len(items):
        return items
    k = np.arange(r.sum()) - np.repeat(np.cumsum(r) - r, r) + 1
    return (np.repeat(items, r) - k)[np.argsort(k, kind="stable")]


class _Layout:
    """What both inductions of a text need: buckets of first symbols, chunks of each pass, runs of equal symbols, and which places each pass induces."""

    def __init__(self, t: np.ndarray, sigma: int):
        n = len(t)
        self.t, self.is_s = t, classify(t)
        self.size = np.bincount(t, minlength=sigma)
        self.begin = np.cumsum(self.size) - self.size
        self.present = np.flatnonzero(self.size)
        at = np.arange(n, dtype=np.int32)
        new = np.ones(n, bool)
        new[1:] = t[1:] != t[:-1]
        self.left = at - np.maximum.accumulate(np.where(new, at, np.int32(0)))  # equal symbols to the left
        #: 1 for larger and 2 for smaller places whose successor begins with another symbol; two zeros for places before the text.
        self.turn = np.zeros(n + 2, np.uint8)
        self.turn[: n - 1] = np.where(new[1:], 1 + self.is_s[:-1], 0)
        self.runs = np.concatenate(([0], np.cumsum(np.bincount(t[self.left > 0], minlength=sigma)[self.present] > 0))).tolist()  # symbols with runs, up to each
        larger, smaller = np.full(sigma, -1, np.int64), np.full(sigma, sigma, np.int64)
        x = np.flatnonzero(self.turn[:n] == 1)
        np.maximum.at(larger, t[x], t[x + 1].astype(np.int64))
        x = np.flatnonzero(self.turn[:n] == 2)
        np.minimum.at(smaller, t[x], t[x + 1].astype(np.int64))
        self.up, self.down = _chunks(self.present, larger, False), _chunks(self.present, smaller, True)
        end = self.begin + self.size
        self.low, self.high = self.begin[self.present].tolist(), end[self.present].tolist()

    def leftmost(self) -> np.ndarray:
        """Smaller places after larger ones."""
        return (np.flatnonzero(self.is_s[1:] & ~self.is_s[:-1]) + 1).astype(np.int32)


def induce(own: _Layout, lms: np.ndarray) -> np.ndarray:
    """All suffixes, from leftmost-smaller ones in order (by their first symbol at least)."""
    t, is_s, turn = own.t, own.is_s, own.turn
    n = len(t)
    sa = np.full(n, -1, np.int32)
    _place(sa, own.begin + own.size, t[lms[::-1]], lms[::-1], True)
    head = own.begin.copy()
    sa[head[t[n - 1]]] = n - 1
    head[t[n - 1]] += 1
    for a, z in own.up:
        part = sa[own.low[a] : own.high[z]]
        if own.runs[z + 1] > own.runs[a]:
            have = part[part >= 0]
            extra = _runs(have[~is_s[have]], own.left)
            _place(sa, head, t[extra], extra, False)
        before = part - 1
        before = before[turn[before] == 1]
        _place(sa, head, t[before], before, False)
    sa[is_s[sa] & (sa >= 0)] = -1
    tail = own.begin + own.size
    for z, a in own.down:
        part = sa[own.low[a] : own.high[z]][::-1]
        if own.runs[z + 1] > own.runs[a]:
            have = part[part >= 0]
            extra = _runs(have[is_s[have]], own.left)
            _place(sa, tail, t[extra], extra, True)
        before = part - 1
        before = before[turn[before] == 2]
        _place(sa, tail, t[before], before, True)
    return sa


def _alike(t: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the stretches of ``length`` symbols from a and from b are equal, by comparison."""
    out = np.ones(len(a), bool)
    live, k = np.arange(len(a)), 0
    while len(live):
        live = live[length[live] > k]
        differ = t[a[live] + k] != t[b[live] + k]
        out[live[differ]] = False
        live = live[~differ]
        k += 1
    return out


def suffix_array(t: np.ndarray, sigma: int | None = None) -> np.ndarray:
    """The suffix array of a text of small non-negative symbols."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    sigma = sigma or int(t.max()) + 1
    own = _Layout(t, sigma)
    lms = own.leftmost()
    if len(lms) > 1:
        # sort leftmost-smaller substrings: an induction from them in the order of their first symbol alone
        by_symbol = lms[np.argsort(t[lms], kind="stable")]
        sa = induce(own, by_symbol)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        srt = sa[is_lms[sa]]
        # name them: equal ones get one name; the last one touches the end of the text and equals no other
        length = np.zeros(n, np.int32)
        length[lms[:-1]] = np.diff(lms) + 1
        mine, prev = length[srt[1:]], length[srt[:-1]]
        maybe = np.flatnonzero((mine == prev) & (mine > 0))
        differ = np.ones(len(srt), bool)
        differ[1 + maybe] = ~_alike(t, srt[maybe], srt[maybe + 1], mine[maybe])
        if differ.all():
            lms = srt
        else:
            name = np.empty(n, np.int32)
            name[srt] = np.cumsum(differ) - 1
            lms = lms[suffix_array(name[lms])]
    return induce(own, lms)


def permuted_lcp(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place of the text, the common prefix with its predecessor in the suffix array.

    Only irreducible values (the preceding symbols differ) are found by comparison, eight bytes at a time; every
    other one is its left neighbour's less one.
    """
    n = len(sa)
    phi = np.full(n, -1, np.int32)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n, dtype=np.int32)
    same = (at > 0) & (phi > 0)
    same[same] = data[at[same] - 1] == data[phi[same] - 1]
    open_ = np.flatnonzero(~same & (phi >= 0))
    value = np.zeros(n, np.int32)
    wide = np.concatenate((data, np.zeros(16, np.uint8)))
    words = np.lib.stride_tricks.as_strided(wide.view(np.uint8), (n + 8, 8), (1, 1))
    a, b, k = open_, phi[open_], 0
    while len(a):
        room = n - np.maximum(a, b) - k
        x = words[np.minimum(a + k, n + 7)].copy().view(U64).ravel() ^ words[np.minimum(b + k, n + 7)].copy().view(U64).ravel()
        low = x & (~x + U64(1))  # lowest set bit: the first differing byte on a little-endian machine
        got = np.where(x == 0, 8, np.bitwise_count(low - U64(1)).astype(np.int64) >> 3)
        got = np.minimum(got, np.maximum(room, 0))
        value[a] += got.astype(np.int32)
        go = got == 8
        a, b = a[go], b[go]
        k += 8
    anchor = np.maximum.accumulate(np.where(same, 0, at))
    return np.where(same, np.maximum(value[anchor] - (at - anchor), 0), value)
