"""Suffix arrays by induced sorting, in numpy: whole buckets are induced at a time instead of single suffixes."""

from __future__ import annotations

import numpy as np


def _is_small(x: np.ndarray) -> np.ndarray:
    """S-type flags: the suffix is smaller than the next one. The last symbol must be the single smallest."""
    n = len(x)
    change = np.flatnonzero(x[1:] != x[:-1])
    upto = np.searchsorted(change, np.arange(n - 1))
    at = change[np.minimum(upto, len(change) - 1)]
    small = np.empty(n, dtype=bool)
    small[-1] = True
    small[:-1] = x[at] < x[at + 1]
    return small


def _spread(entries: np.ndarray, keys: np.ndarray, slots: np.ndarray, sa: np.ndarray, down: bool) -> None:
    """Put entries, in order, into the next free places of the buckets of their keys."""
    if not len(entries):
        return
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    sizes = np.diff(np.append(first, len(ranked)))
    within = np.arange(len(ranked)) - np.repeat(first, sizes)
    if down:
        sa[slots[ranked] - within] = entries[order]
        slots[ranked[first]] -= sizes
    else:
        sa[slots[ranked] + within] = entries[order]
        slots[ranked[first]] += sizes


def _induce(x: np.ndarray, small: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The array that ordered leftmost-smaller suffixes ``lms`` induce: larger ones left to right, smaller ones back."""
    n, starts = len(x), np.concatenate(([0], ends[:-1]))
    sa = np.full(n, -1, dtype=np.int32)
    keys = x[lms]
    tails = ends - 1
    _spread(lms[::-1], keys[::-1], tails.copy(), sa, True)
    lms_count = np.bincount(keys, minlength=len(ends))
    heads = starts.copy()
    used = np.flatnonzero(ends > starts)
    for c in used:
        at = starts[c]
        while at < heads[c]:  # entries that the bucket gives to itself come in rounds
            stop = heads[c]
            before = sa[at:stop] - 1
            before = before[before >= 0]
            before = before[~small[before]]
            at = stop
            _spread(before, x[before], heads, sa, False)
        if lms_count[c]:
            before = sa[ends[c] - lms_count[c] : ends[c]] - 1
            before = before[before >= 0]
            _spread(before, x[before], heads, sa, False)
    larger_ends = heads
    slots = tails.copy()
    for c in used[::-1]:
        at = ends[c] - 1
        while at > slots[c]:
            stop = slots[c]
            before = sa[stop + 1 : at + 1][::-1] - 1
            before = before[before >= 0]
            before = before[small[before]]
            at = stop
            _spread(before, x[before], slots, sa, True)
        before = sa[starts[c] : larger_ends[c]][::-1] - 1
        before = before[before >= 0]
        before = before[small[before]]
        _spread(before, x[before], slots, sa, True)
        if c == used[0]:
            sa[0] = n - 1
    return sa


def _names(x: np.ndarray, small: np.ndarray, places: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Rank of each leftmost-smaller substring among the distinct ones, by exact comparison of neighbours in order."""
    length = np.diff(np.append(places, len(x) - 1)) + 1
    size_at = np.zeros(len(x), dtype=np.int32)
    size_at[places] = length
    a, b = ordered[:-1].astype(np.int64), ordered[1:].astype(np.int64)
    differs = size_at[a] != size_at[b]
    active = np.flatnonzero(~differs)
    step = 0
    while len(active):
        p, q = a[active] + step, b[active] + step
        unequal = x[p] != x[q]
        differs[active[unequal]] = True
        active = active[~unequal & (step + 1 < size_at[a[active]])]
        step += 1
    rank = np.empty(len(x), dtype=np.int32)
    rank[ordered] = np.concatenate(([0], np.cumsum(differs)))
    return rank[places]


def _double(x: np.ndarray) -> np.ndarray:
    """Suffix array of a string over a large alphabet: ranks of twice the length from ranks of two halves."""
    rank, n, half = x.astype(np.int64), len(x), 1
    while True:
        ahead = np.zeros(n, dtype=np.int64)
        ahead[:-half] = rank[half:] + 1
        key = rank * (int(ahead.max()) + 1) + ahead
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        if rank[order[-1]] == n - 1:
            return order.astype(np.int32)
        half *= 2
        if half >= n:
            return order.astype(np.int32)


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Suffix array of ``x``, whose last symbol is its single smallest.

    Strings over few symbols are sorted by induction, their leftmost-smaller substrings by recursion. A reduced string
    over many symbols has buckets too small to work on whole, and is sorted by doubling instead.
    """
    n = len(x)
    if n < 3:
        return np.argsort(x, kind="stable").astype(np.int32)
    symbols = int(x.max()) + 1
    if symbols > 256 and symbols * 256 > n:
        return _double(x)
    small = _is_small(x)
    places = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    ends = np.cumsum(np.bincount(x, minlength=symbols))
    rough = _induce(x, small, ends, places)
    is_place = np.zeros(n, dtype=bool)
    is_place[places] = True
    ordered = rough[is_place[rough]]
    names = _names(x, small, places, ordered)
    if len(places) and names.max() + 1 < len(places):
        ordered = places[suffix_array(names)]
        return _induce(x, small, ends, ordered)
    return rough if len(places) < 2 else _induce(x, small, ends, ordered)


def permuted_prefixes(x: np.ndarray, sa: np.ndarray, left: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every place the length it shares with the suffix before it in order, and that suffix.

    Only places whose left symbol differs from its neighbour's, or that open a piece, are compared, 8 bytes at a time;
    from there on the length falls by one per place. Lengths end with the piece: ``left`` symbols from each place on.
    """
    n = len(x)
    prior = np.full(n, -1, dtype=np.int64)
    prior[sa[1:]] = sa[:-1]
    real = prior >= 0
    fresh = opens.copy()
    fresh |= ~real
    same = np.flatnonzero(real & (prior > 0))
    same = same[same > 0]
    fresh[same] |= x[same - 1] != x[prior[same] - 1]
    fresh[real & (prior == 0)] = True
    at = np.flatnonzero(fresh & real)
    padded = np.concatenate((x.astype(np.uint8), np.zeros(8, dtype=np.uint8)))
    shared = np.zeros(n, dtype=np.int64)
    step, active = 0, at
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    while len(active):
        p, q = active + step, prior[active] + step
        fits = (p < n) & (q < n)
        active, p, q = active[fits], p[fits], q[fits]
        equal = eight[p] == eight[q]
        run = np.where(equal.all(axis=1), 8, equal.argmin(axis=1))
        shared[active] += run
        active = active[(run == 8) & (left[active] > step + 8)]
        step += 8
    shared[at] = np.minimum(shared[at], left[at])
    base = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return np.maximum(0, np.minimum(shared[base] - (np.arange(n) - base), left)), prior


def repeated_starts(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """Per piece, which of its windows of ``length`` bytes also start anywhere else in these pieces.

    Pieces are UTF-8 or parts of it, so byte 255 never occurs in them and parts them.
    """
    joined = np.frombuffer(b"\xff".join(pieces) + b"\xff\x00", dtype=np.uint8)
    x = (np.cumsum(np.bincount(joined, minlength=256) > 0, dtype=np.int16) - 1)[joined] + 1  # used bytes only, in order
    x[-1] = 0
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    left = np.zeros(len(x), dtype=np.int64)
    for_piece = np.repeat(np.arange(len(pieces)), sizes + 1)
    left[: len(for_piece)] = (first + sizes)[for_piece] - np.arange(len(for_piece))
    opens = np.zeros(len(x), dtype=bool)
    opens[first] = True
    opens[-1] = True
    shared, prior = permuted_prefixes(x, suffix_array(x), left, opens)
    again = np.zeros(len(x), dtype=bool)
    hit = np.flatnonzero(shared >= length)
    again[hit] = True
    again[prior[hit]] = True
    return [again[a : a + max(0, n - length + 1)] for a, n in zip(first.tolist(), sizes.tolist())]
