"""Byte-level text blocks for Arrow batches.

The operators that walk whole texts take them as the UTF-8 bytes of an Arrow
string column, so that words, word hashes and window hashes are array
operations over many documents at once.  A batch is cut into blocks of a
bounded number of bytes (one longer document makes a block of its own), which
bounds the memory of a task whatever the batch or split size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A block's arrays of words and hashes take about fifty times these bytes.
BLOCK_BYTES = 1 << 20

U64 = np.uint64
_MUL = U64(0x9E3779B97F4A7C15)
_MIX1 = U64(0xBF58476D1CE4E5B9)
_MIX2 = U64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), elementwise."""
    x = x ^ (x >> U64(30))
    x = x * _MIX1
    x = x ^ (x >> U64(27))
    x = x * _MIX2
    return x ^ (x >> U64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix64(np.arange(1, n + 1, dtype=U64) * _MUL + U64(seed))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + n + 1]
    if data is None:
        return offsets - offsets[0], np.zeros(0, np.uint8)
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    return offsets - offsets[0], raw


def blocks(batch: pa.RecordBatch, text: str = "text",
           limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows holding at most ``limit`` bytes of text.

    Yields (first row, end row, offsets from 0, bytes); a document longer
    than ``limit`` is a run of its own.
    """
    offsets, raw = text_buffer(batch.column(text))
    n, row = len(offsets) - 1, 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end, offsets[row:end + 1] - offsets[row], raw[offsets[row]:offsets[end]]
        row = end


def byte_class(chars: bytes = b"", ranges: tuple[tuple[int, int], ...] = ()) -> np.ndarray:
    """Boolean table over the 256 byte values."""
    table = np.zeros(256, bool)
    table[list(chars)] = True
    for a, b in ranges:
        table[a:b + 1] = True
    return table


#: Word bytes of ``[^\x20\x09-\x0D]+`` (all separators are ASCII, so the class
#: is the same on UTF-8 bytes as on code points).
NOT_SPACE = ~byte_class(ranges=((0x20, 0x20), (0x09, 0x0D)))

#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
LOWER_ALNUM = ~byte_class(ranges=((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)))

#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def word_spans(raw: np.ndarray, offsets: np.ndarray,
               word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document + total) of all words.

    Positions are bytes of the block; a word never crosses a document.
    """
    n_docs = len(offsets) - 1
    if len(raw) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n_docs + 1, np.int64)
    inside = word[raw]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(raw)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = before  # reuse
    after[:-1] = inside[1:]
    after[-1] = False
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_BASE = U64(0x2545F4914F6CDD1D)
_LETTERS = seeded(256, 101)
_LONG = 1 << 16


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, _LONG)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                piece: int = BLOCK_BYTES) -> np.ndarray:
    """A 64-bit hash of each word's bytes (position-weighted sum, mixed).

    Works through the block in pieces of about ``piece`` bytes cut between
    words, so a very long document needs 8 bytes per word, not per byte.
    """
    out = np.empty(len(starts), U64)
    a = 0
    while a < len(starts):
        b = int(np.searchsorted(starts, starts[a] + piece, side="left"))
        b = max(a + 1, b)
        lo, hi = int(starts[a]), int(ends[b - 1])
        length = ends[a:b] - starts[a:b]
        at = np.arange(lo, hi, dtype=np.int64)
        at -= np.repeat(starts[a:b], np.diff(np.append(starts[a:b], hi)))
        weight = _POW[at & (_LONG - 1)]
        if length.max() > _LONG:  # beyond the table: shift by the 64 Ki block number
            weight = weight * mix64((at >> 16).astype(U64) + U64(1))
        value = _LETTERS[raw[lo:hi]] * weight
        total = np.zeros(hi - lo + 1, U64)
        np.cumsum(value, out=total[1:])
        out[a:b] = total[ends[a:b] - lo] - total[starts[a:b] - lo]
        out[a:b] += length.astype(U64) * _MUL
        a = b
    return mix64(out)


def rolling(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Rabin-Karp hash (mod 2^64) of every run of ``size`` word hashes.

    Built from runs of a power of two: H(2n)[i] = H(n)[i] * b^n + H(n)[i + n].
    """
    n = len(words)
    if n < size:
        return np.zeros(0, U64)
    out, have = None, 0
    part, width, b = words, 1, U64(base | 1)
    left = size
    power = b
    while left:
        if left & 1:
            if out is None:
                out, have = part, width
            else:  # out covers `have` words, append `width` more
                m = min(len(out), len(part) - have)
                out = out[:m] * power + part[have:have + m]
                have += width
        left >>= 1
        if left:
            part = part[:len(part) - width] * power + part[width:]
            width *= 2
            power = U64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF)
    return mix64(out[:n - size + 1])


def document_of(first: np.ndarray) -> np.ndarray:
    """Document number of every word, from the per-document first words."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(words: np.ndarray, first: np.ndarray, size: int, base: int
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, document) of every ``size``-word window inside one document."""
    hashed = rolling(words, size, base)
    doc = document_of(first)[:len(hashed)]
    at = np.arange(len(hashed), dtype=np.int64)
    keep = at + size <= first[1:][doc] if len(hashed) else np.zeros(0, bool)
    return hashed[keep], at[keep], doc[keep]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by runs of a power of two."""
    best, have = values, 1
    while 2 * have <= width:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    n = len(values) - width + 1
    return np.minimum(best[:n], best[width - have:][:n])


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Boolean mask over ``n`` items covered by runs of ``size`` from each start."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + size, n), -1)
    return np.cumsum(delta[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
