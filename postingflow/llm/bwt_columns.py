"""Burrows-Wheeler transform and LCP array of a collection, column by column.

The collection grows by one symbol of every document in each round: round j
adds the suffix of length j of every document that has one, and updates the
transform and the longest-common-prefix array of all suffixes so far.  Both
are read and rewritten front to back in each round, so they could as well be
sequential files; a collection here is one bounded block, so they are arrays.

Every document ends in a terminator of its own, ordered before all bytes, so
no common prefix runs past the end of a document.
"""

from __future__ import annotations

import numpy as np


def _column(data: np.ndarray, at: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Symbols (byte + 1) at the given places, 0 (terminator) where there is none."""
    out = np.zeros(len(at), np.uint8)
    out[have] = data[at[have]] + np.uint8(1)
    return out


def _ranges_min(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of values[a:b] for non-empty ranges (values has a spare last item)."""
    return np.minimum.reduceat(values, np.column_stack((a, b)).reshape(-1))[::2]


def _grown(values: np.ndarray, is_old: np.ndarray, places: np.ndarray, new: np.ndarray) -> np.ndarray:
    """``values`` with ``new`` put in at ``places`` of the longer array."""
    out = np.empty(len(is_old), values.dtype)
    out[is_old] = values
    out[places] = new
    return out


def build(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(transform, LCP with its row before) of the documents of a UTF-8 block.

    UTF-8 has no bytes over 0xF4, so byte + 1 fits a byte and 0 is free for
    the terminators.  Common prefixes take two bytes while the documents are
    short enough, and a symbol with its row is one word of four.
    """
    m = len(offsets) - 1
    starts, ends = offsets[:-1], offsets[1:]
    length = ends - starts
    longest = int(length.max(initial=0))
    rows = np.arange(m)                    # row of each document's newest suffix
    active = np.arange(m)
    bwt = _column(data, ends - 1, length > 0)
    lcp = np.zeros(m + 1, np.uint16 if longest < 1 << 16 else np.uint32)  # one spare item at the end
    count = np.bincount(bwt, minlength=257)
    word, bits = (np.uint32, 24) if len(data) + m < 1 << 24 else (np.uint64, 48)
    place = np.arange(len(data) + m, dtype=word)
    for j in range(1, longest + 1):
        live = length[active] >= j
        active, rows = active[live], rows[live]
        order = np.argsort(rows)
        active, rows = active[order], rows[order]
        n = len(bwt)
        symbol = bwt[rows].astype(np.int64)
        # Old rows in the order of their extended suffixes: by symbol, then row.
        by_symbol = bwt.astype(word)
        by_symbol <<= word(bits)
        by_symbol |= place[:n]
        own_place = by_symbol[rows]
        by_symbol.sort()
        first = np.concatenate(([0], np.cumsum(count)))
        at = np.searchsorted(by_symbol, own_place)
        places = at - count[0] + m
        # Common prefix with the neighbours that start with the same symbol.
        row = lambda k: (by_symbol[k] & word((1 << bits) - 1)).astype(np.int64)  # noqa: E731, B023
        before, after = at > first[symbol], at + 1 < first[symbol + 1]
        own = np.zeros(len(rows), lcp.dtype)
        own[before] = _ranges_min(lcp, row(at[before] - 1) + 1, rows[before] + 1) + 1
        follow = _ranges_min(lcp, rows[after] + 1, row(at[after] + 1) + 1) + 1
        new = _column(data, ends[active] - j - 1, length[active] > j)
        is_old = np.ones(n + len(rows) + 1, bool)
        is_old[places] = False
        bwt, lcp = _grown(bwt, is_old[:-1], places, new), _grown(lcp, is_old, places, own)
        lcp[places[after] + 1] = follow
        rows = places
        count = count + np.bincount(new, minlength=257)
    return bwt, lcp[:-1].astype(np.int32)


def rows_of(bwt: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row of the suffix that starts at each byte of the block."""
    m = len(offsets) - 1
    length = np.diff(offsets)
    step = np.empty(len(bwt), np.int64)
    step[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
    step += m - np.count_nonzero(bwt == 0)
    out = np.empty(offsets[-1], np.int64)
    docs, rows = np.arange(m), np.arange(m)
    for j in range(1, int(length.max(initial=0)) + 1):
        live = length[docs] >= j
        docs, rows = docs[live], step[rows[live]]
        out[offsets[1:][docs] - j] = rows
    return out


def repeated_starts(data: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """Mask over the bytes: a ``size``-byte string that starts here also starts elsewhere."""
    bwt, lcp = build(data, offsets)
    near = np.maximum(lcp, np.append(lcp[1:], np.int32(0)))
    return near[rows_of(bwt, offsets)] >= size
