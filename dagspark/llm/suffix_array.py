"""Suffix arrays by induced sorting, and permuted longest common prefixes, in whole-array steps."""

from __future__ import annotations

import numpy as np

#: reduced strings of a larger alphabet are sorted by doubling, as a bucket would hold a name or two
INDUCED_ALPHABET = 1 << 10


def suffix_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S-type). The last is larger than the end, so L-type."""
    n = len(t)
    differs = np.append(t[1:] != t[:-1], True)
    smaller = np.append(t[1:] > t[:-1], False)
    # a run of one symbol has the type of its last position
    last = np.where(differs, np.arange(n), n)
    last = np.minimum.accumulate(last[::-1])[::-1]
    return smaller[last]


def leftmost(types: np.ndarray) -> np.ndarray:
    """Positions of the leftmost S-type suffixes: S-type after L-type."""
    return np.flatnonzero(types[1:] & ~types[:-1]) + 1


def _deal(t: np.ndarray, before: np.ndarray, queues: list[list[np.ndarray]]) -> None:
    """Append positions to their symbols' queues, in their order."""
    if not len(before):
        return
    symbols = t[before]
    order = np.argsort(symbols, kind="stable")
    symbols = symbols[order]
    cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    before = before[order]
    for part, symbol in zip(np.split(before, cuts), symbols[np.concatenate([[0], cuts])], strict=True):
        queues[symbol].append(part)


def _sweep(t: np.ndarray, own: np.ndarray, others: list[np.ndarray], first: np.ndarray, sizes: range) -> list[np.ndarray]:
    """One pass over the buckets: own[i] tells whether position i is of the type that is placed.

    others has for each bucket the placed suffixes of the other type, in the
    order of the pass. A bucket's own suffixes come in batches: those that
    earlier buckets have dealt to it, then, again and again, the predecessors
    within the bucket itself.
    """
    queues: list[list[np.ndarray]] = [[] for _ in sizes]
    _deal(t, first, queues)
    out: list[np.ndarray] = [first[:0]] * len(sizes)
    for c in sizes:
        placed = []
        batch = np.concatenate(queues[c]) if queues[c] else first[:0]
        while len(batch):
            placed.append(batch)
            before = batch[batch > 0] - 1
            before = before[own[before]]
            same = t[before] == c
            _deal(t, before[~same], queues)
            batch = before[same]
        queues[c] = []
        out[c] = np.concatenate(placed) if placed else first[:0]
        if len(others[c]):
            before = others[c][others[c] > 0] - 1
            _deal(t, before[own[before]], queues)
    return out


def induce(t: np.ndarray, types: np.ndarray, lms: np.ndarray, alphabet: int) -> np.ndarray:
    """All suffixes sorted, given the leftmost S-type ones in their order."""
    by_symbol: list[list[np.ndarray]] = [[] for _ in range(alphabet)]
    _deal(t, lms, by_symbol)
    placed = [np.concatenate(x) if x else lms[:0] for x in by_symbol]
    end = np.array([len(t) - 1], lms.dtype)  # the suffix before the end, which is the smallest of all
    large = _sweep(t, ~types, placed, end, range(alphabet))
    small = _sweep(t, types, [x[::-1] for x in large], lms[:0], range(alphabet - 1, -1, -1))
    return np.concatenate([x for c in range(alphabet) for x in (large[c], small[c][::-1])])


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def _names(t: np.ndarray, lms: np.ndarray, in_order: np.ndarray) -> tuple[np.ndarray, int]:
    """The rank of each leftmost-smaller substring, equal ones alike, in text order; and how many there are."""
    base = 0x9E3779B97F4A7C15
    power, back = _powers(len(t) + 1, base), _powers(len(t) + 1, pow(base, -1, 1 << 64))
    sums = np.zeros(len(t) + 1, np.uint64)
    np.cumsum((t.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    stop = np.minimum(np.append(lms[1:], len(t) - 1) + 1, len(t))
    digest = (sums[stop] - sums[lms]) * back[lms]
    length = stop - lms
    at = np.empty(len(t), np.int64)
    at[lms] = np.arange(len(lms))
    k = at[in_order]
    new = np.concatenate([[True], (digest[k[1:]] != digest[k[:-1]]) | (length[k[1:]] != length[k[:-1]])])
    # the last substring runs into the end and equals no other
    new |= k == len(lms) - 1
    new[1:] |= k[:-1] == len(lms) - 1
    names = np.empty(len(lms), np.int64)
    names[k] = np.cumsum(new) - 1
    return names, int(new.sum())


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffix array of a string of names by prefix doubling."""
    n = len(names)
    rank, width = names.astype(np.int64), 1
    while True:
        beyond = np.zeros(n, np.int64)
        beyond[: max(n - width, 0)] = rank[width:] + 1
        key = rank * (n + 2) + beyond
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        width *= 2
        if width >= n or new.sum() == n - 1:
            return order


def suffix_array(t: np.ndarray, alphabet: int) -> np.ndarray:
    """The positions of t's suffixes in their order; t's symbols are 0 to alphabet - 1."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int64)
    types = suffix_types(t)
    lms = leftmost(types)
    if not len(lms):
        return induce(t, types, lms, alphabet)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    once = induce(t, types, lms, alphabet)
    names, n_names = _names(t, lms, once[is_lms[once]])
    if n_names == len(lms):
        order = np.argsort(names, kind="stable")
    elif n_names <= INDUCED_ALPHABET:
        order = suffix_array(names, n_names)
    else:
        order = _doubled(names)
    return induce(t, types, lms[order], alphabet)


def permuted_lcp(t: np.ndarray, sa: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(plcp, phi): phi[i] is the suffix before suffix i in the order (-1: none), plcp[i] their common prefix.

    Values of `most` or more are lower bounds. Only irreducible values, where
    the symbols before the two suffixes differ, are found by comparing; any
    other is one less than the value before it.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    words = np.zeros(n + most + 16, np.uint8)
    words[:n] = t
    eight = np.ndarray((len(words) - 7,), "<u8", words.data, strides=(1,))
    i = np.arange(n)
    reducible = (phi > 0) & (i > 0)
    reducible[reducible] = t[i[reducible] - 1] == t[phi[reducible] - 1]
    left = np.flatnonzero(~reducible & (phi >= 0))
    plcp = np.zeros(n, np.int64)
    # one beyond `most` for each reducible position after it would be needed to count them all; so those are compared again below
    length = _common(eight, left, phi[left], most, n)
    plcp[left] = length
    anchor = np.where(reducible, 0, i)
    anchor = np.maximum.accumulate(anchor)
    plcp = np.maximum(plcp[anchor] - (i - anchor), 0)
    short = np.flatnonzero(reducible & (plcp < most) & (plcp + (i - anchor) >= most))
    plcp[short] = _common(eight, short, phi[short], most, n)
    plcp[phi < 0] = 0
    return plcp, phi


def _common(eight: np.ndarray, a: np.ndarray, b: np.ndarray, most: int, n: int) -> np.ndarray:
    out = np.zeros(len(a), np.int64)
    active = np.arange(len(a))
    for at in range(0, most, 8):
        x = eight[a[active] + at] ^ eight[b[active] + at]
        same = x == 0
        done = active[~same]
        low = x[~same]
        low &= ~low + np.uint64(1)
        out[done] = at + np.bitwise_count(low - np.uint64(1)) // 8
        active = active[same]
        out[active] = at + 8
        if not len(active):
            break
    return np.minimum(out, n - np.maximum(a, b))
