"""Recompression of word sequences, vectorised over many rows.

Each round first names maximal runs of one symbol, then names pairs: every
symbol falls to a left or right side by a bit of its name, and a left symbol
followed by a right one becomes one symbol. Names are hashes of what they
stand for, so one naming holds over the whole corpus without a lookup. A round
only touches symbols of at most its span limit, so whether a word boundary
survives depends on the :func:`context` words around it and no others: equal
passages get equal symbols in their interior.
"""

from __future__ import annotations

import numpy as np

from .common import mix

_U = np.uint64

#: Longest symbol, in words, that each round may merge, for each climb; a climb's symbols are up to twice its last limit.
CLIMBS = ((1, 2), (1, 2, 4))


def context(spans) -> int:
    """Words on either side that decide if a boundary survives all rounds: a run and a pair step for each round."""
    return 2 * sum(spans)


def _merge(names, spans, join):
    """Merge each symbol where ``join`` is true into the one before it; returns the index of each group's first symbol."""
    first = np.flatnonzero(~join)
    return first, np.add.reduceat(spans, first) if len(first) else spans[:0]


def symbols(hashes: np.ndarray, row_start: np.ndarray, spans_limit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, starts, spans) of the last round's symbols over concatenated rows.

    ``row_start`` is true for the first word of each row; no symbol crosses rows.
    """
    names = hashes.copy()
    spans = np.ones(len(names), np.int64)
    fresh = row_start.copy()
    for k, limit in enumerate(spans_limit, 1):
        if not len(names):
            break
        small = spans <= limit
        join = np.zeros(len(names), bool)
        join[1:] = (names[1:] == names[:-1]) & small[1:] & small[:-1] & ~fresh[1:]
        if join.any():
            first, total = _merge(names, spans, join)
            runs = np.diff(np.append(first, len(names)))
            kept = names[first]
            long = runs > 1
            kept[long] = mix(kept[long] * _U(0x9E3779B97F4A7C15) + runs[long].astype(np.uint64) * _U(2 * k + 1))
            names, spans, fresh = kept, total, fresh[first]
            small = spans <= limit
        side = ((mix(names + _U(k)) >> _U(17)) & _U(1)).astype(bool)
        join = np.zeros(len(names), bool)
        join[1:] = ~side[:-1] & side[1:] & small[1:] & small[:-1] & ~fresh[1:]
        if join.any():
            first, total = _merge(names, spans, join)
            second = np.flatnonzero(join)
            paired = np.zeros(len(names), bool)
            paired[second - 1] = True
            kept = names[first]
            where = paired[first]
            kept[where] = mix(kept[where] * _U(0xC2B2AE3D27D4EB4F) + mix(names[second]) + _U(k))
            names, spans, fresh = kept, total, fresh[first]
    starts = np.cumsum(spans) - spans
    return names, starts, spans


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each i the index of the leftmost least of values[i : i + width] (len - width + 1 entries), by doubling."""
    n = len(values) - width + 1
    best = np.arange(len(values))
    step = 1
    while step * 2 <= width:
        a, b = best[: len(best) - step], best[step:]
        best = np.where(values[b] < values[a], b, a)
        step *= 2
    if step < width:
        shift = width - step
        a, b = best[:n], best[shift : shift + n]
        best = np.where(values[b] < values[a], b, a)
    return best[:n]


def anchors(hashes: np.ndarray, bounds: np.ndarray, window: int, limits) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The symbol that stands for each window of ``window`` words.

    Returns (windows' first words, anchor's first word or -1, anchor's end,
    window's row). A window's anchor is its least-named symbol that lies at
    least ``context(limits)`` words inside; it depends on the window's words alone. -1: none
    does (long runs), the window stands for itself.
    """
    n = len(hashes)
    counts = np.diff(bounds)
    row = np.repeat(np.arange(len(counts)), counts)
    inside = np.repeat(bounds[1:], counts)
    first_words = np.flatnonzero(np.arange(n) + window <= inside)
    if not len(first_words):
        e = np.zeros(0, np.int64)
        return e, e, e, e
    row_start = np.zeros(n, bool)
    row_start[bounds[:-1][counts > 0]] = True
    names, starts, spans = symbols(hashes, row_start, limits)
    margin = context(limits)
    # Only symbols that end within the interior of every window that may choose them: place each at its start.
    big = np.uint64(0xFFFFFFFFFFFFFFFF)
    room = window - 2 * margin
    value = np.full(n + window, big)
    end = np.zeros(n + window, np.int64)
    fits = spans <= room
    value[starts[fits]] = np.minimum(names[fits], big - np.uint64(1))
    end[starts[fits]] = starts[fits] + spans[fits]
    low = first_words + margin
    best = sliding_argmin(value, room)[low]
    # The least start may belong to a symbol that ends outside: such windows look for the least that ends inside.
    chosen = np.where((value[best] != big) & (end[best] <= first_words + window - margin), best, -1)
    again = np.flatnonzero((chosen < 0) & (value[best] != big))
    for at in range(0, len(again), 65536):
        part = again[at : at + 65536]
        grid = low[part][:, None] + np.arange(room)[None, :]
        v = np.where(end[grid] <= (first_words[part] + window - margin)[:, None], value[grid], big)
        k = v.argmin(axis=1)
        hit = v[np.arange(len(part)), k] != big
        chosen[part] = np.where(hit, grid[np.arange(len(part)), k], -1)
    return first_words, chosen, np.where(chosen >= 0, end[chosen], -1), row[first_words]
