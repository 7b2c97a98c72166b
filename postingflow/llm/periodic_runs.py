"""Periodic runs of words, found on an enhanced suffix array.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are
identical), at least ``times`` periods and ``least`` words long, that no
neighbouring word extends.  Per block of documents, all as array operations:

1. The suffixes of all documents of the block are sorted by prefix doubling;
   only groups that still hold several suffixes are sorted again.  The word
   numbers differ between documents, so suffixes of different documents have
   nothing in common and one array serves the whole block.
2. The common prefix of neighbours is known when a round of ``k`` words
   separates them: ``k`` plus the least common prefix between the ranks of
   the two suffixes ``k`` words on, a range minimum over what is known so far.
3. The bounds of every LCP interval are the nearest smaller values of its
   entries, found by climbing a tree of minima; intervals are rows of
   (depth, first, last) and never become nodes.
4. Branching-tandem test: for every interval of depth ``l`` and every child
   but its largest, each suffix ``i`` of the child asks the inverse array
   whether ``i + l`` or ``i - l`` lies in the interval but in another child.
   Then a square of period ``l`` ends where its repetition ends.  As the largest
   child is left out, at most n log n suffixes ask.
5. Such squares rotate to the left, word by word, while the words ``l`` apart
   are equal; all rotations together are one run.  Of the squares that end at
   one word the shortest rotates first and takes its multiples with it.

Plan: a map over the documents, no shuffle.  Blocks hold about ``BLOCK_BYTES``
of text (one longer document is a block of its own); memory is some 150 bytes
a word of a block.  Words are compared as 64-bit hashes inside one document.

Edge cases: a null text or one without words has no runs and an empty kept
text; rows with one id are documents of their own; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .window_dedup import joined

#: Shortest run: words, and periods.
LEAST, TIMES = 6, 4
BLOCK_BYTES = 2 << 20
#: Suffixes that ask, or words that are compared, at a time.
PIECE = 1 << 20

FOUND = "runs array<struct<start:int,length:int,period:int>>, n_words long, kept string"


class Minima:
    """Tree of minima over an array: ``levels[j][k]`` is the least of 2^j entries from k * 2^j."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(values) > 1:
            if len(values) & 1:
                values = np.append(values, np.iinfo(values.dtype).max)
            values = np.minimum(values[::2], values[1::2])
            self.levels.append(values)

    def least(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Least entry of every range [first, end), none of them empty."""
        a, b = first.astype(np.int64), end.astype(np.int64)
        best = np.full(len(a), np.iinfo(self.levels[0].dtype).max, self.levels[0].dtype)
        for level in self.levels:
            if not (a < b).any():
                break
            odd = np.flatnonzero((a & 1 == 1) & (a < b))
            best[odd] = np.minimum(best[odd], level[a[odd]])
            a[odd] += 1
            odd = np.flatnonzero((b & 1 == 1) & (a < b))
            b[odd] -= 1
            best[odd] = np.minimum(best[odd], level[b[odd]])
            a >>= 1
            b >>= 1
        return best

    def smaller(self, at: np.ndarray, value: np.ndarray, step: int) -> np.ndarray:
        """Nearest place before (step -1) or after (step 1) ``at`` with an entry below ``value``.

        There must be one.  Climbs until a neighbouring subtree holds one, then descends.
        """
        spot = at.astype(np.int64)
        height = np.zeros(len(spot), np.int64)
        out = np.empty(len(spot), np.int64)
        open_ = np.arange(len(spot))
        inner = 0 if step < 0 else 1  # a node that is this child has no sibling on that side
        for j, level in enumerate(self.levels):
            if len(open_) == 0:
                break
            here = spot[open_]
            side = here + step
            fits = (side >= 0) & (side < len(level))
            hit = np.zeros(len(here), bool)
            ok = (here & 1 != inner) & fits
            hit[ok] = level[side[ok]] < value[open_[ok]]
            done = open_[hit]
            spot[done], height[done] = side[hit], j
            open_ = open_[~hit]
            spot[open_] >>= 1
        for j in range(len(self.levels) - 1, 0, -1):
            down = np.flatnonzero(height == j)
            if len(down) == 0:
                continue
            near = 2 * spot[down] + (1 if step < 0 else 0)
            level = self.levels[j - 1]
            inside = near < len(level)
            hit = np.zeros(len(down), bool)
            hit[inside] = level[near[inside]] < value[down[inside]]
            spot[down] = np.where(hit, near, 4 * spot[down] + 1 - near)
            height[down] = j - 1
        out[:] = spot
        return out


def suffix_array(words: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order, place of each suffix, common prefix with the one before).

    ``words`` are numbers, those of different documents distinct; ``end`` is
    the end of each word's document.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    sorted_ = words[order]
    new = np.ones(n, bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    none = np.iinfo(np.int32).max
    lcp = np.where(new, 0, none).astype(np.int32)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, size)
    grouped = np.flatnonzero(np.repeat(size, size) > 1)  # places whose order is still open
    k = 1
    while len(grouped):
        suffix = order[grouped]
        beyond = suffix + k
        inside = beyond < end[suffix]
        follow = end[suffix].astype(np.int64)  # past the end: the document's own end, at most n
        follow[inside] = rank[beyond[inside]] + n + 1
        group = rank[suffix]
        by = np.argsort(group << 32 | follow, kind="stable")
        suffix, follow, group = suffix[by], follow[by], group[by]
        order[grouped] = suffix
        old = np.ones(len(group), bool)
        old[1:] = group[1:] != group[:-1]
        new = old.copy()
        new[1:] |= follow[1:] != follow[:-1]
        split = np.flatnonzero(new & ~old)
        if len(split):
            a, b = follow[split - 1], follow[split]
            common = np.zeros(len(split), np.int32)
            both = np.flatnonzero(a > n) if k > 1 else []  # after one equal word, different ones follow
            if len(both):
                common[both] = Minima(lcp).least(a[both] - n, b[both] - n)
            lcp[grouped[split]] = k + common
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(group)))
        rank[suffix] = np.repeat(grouped[start], size)
        grouped = grouped[np.repeat(size, size) > 1]
        k *= 2
    return order, rank, lcp


def children(lcp: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """All children but the largest of every LCP interval of depth 1 or more, in pieces of
    about ``PIECE`` suffixes: (depth, interval first, interval end, child first, child end)."""
    at = np.flatnonzero(lcp > 0)
    if len(at) == 0:
        return
    depth = lcp[at].astype(np.int64)
    tree = Minima(np.append(lcp, np.int32(-1)))  # entry 0 is 0, the one past the end -1
    first, end = tree.smaller(at, depth, -1), tree.smaller(at, depth, 1)
    # Entries of one interval share (first, depth); between them lie its children.
    by = np.argsort(first << 32 | depth, kind="stable")
    at, depth, first, end = at[by], depth[by], first[by], end[by]
    new = np.ones(len(at), bool)
    new[1:] = (first[1:] != first[:-1]) | (depth[1:] != depth[:-1])
    last = np.append(new[1:], True)
    begin = np.where(new, first, np.concatenate(([0], at[:-1])))  # the child before each entry
    tail = np.flatnonzero(last)                                  # and the one after the last
    entry = np.concatenate((np.arange(len(at)), tail))
    a = np.concatenate((begin, at[tail]))
    b = np.concatenate((at, end[tail]))
    interval = (np.cumsum(new) - 1)[entry]
    by = np.lexsort((b - a, interval))
    largest = np.ones(len(by), bool)
    largest[:-1] = interval[by][1:] != interval[by][:-1]
    small = by[~largest]
    entry, a, b = entry[small], a[small], b[small]
    total = np.cumsum(b - a)
    cut = 0
    while cut < len(a):
        done = total[cut - 1] if cut else 0
        stop = max(cut + 1, int(np.searchsorted(total, done + PIECE, side="right")))
        e = entry[cut:stop]
        yield depth[e], first[e], end[e], a[cut:stop], b[cut:stop]
        cut = stop


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for ``size[0]`` numbers, then first[1], ..."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def branching_squares(words: np.ndarray, end: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every square that its next word does not continue."""
    order, place, lcp = suffix_array(words, end)
    starts, periods = [], []
    for depth, first, stop, a, b in children(lcp):
        size = b - a
        i = order[ranges(a, size)]
        depth, first, stop, a, b = (np.repeat(x, size) for x in (depth, first, stop, a, b))
        for step, square in ((1, lambda i, d: i), (-1, lambda i, d: i - d)):
            other = i + step * depth
            ask = np.flatnonzero((other < end[i]) if step > 0 else (other >= begin[i]))
            spot = place[other[ask]]
            hit = ask[(spot >= first[ask]) & (spot < stop[ask]) & ((spot < a[ask]) | (spot >= b[ask]))]
            starts.append(square(i[hit], depth[hit]))
            periods.append(depth[hit])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, period = np.concatenate(starts), np.concatenate(periods)
    by = np.lexsort((period, start))
    start, period = start[by], period[by]
    new = np.ones(len(by), bool)
    new[1:] = (start[1:] != start[:-1]) | (period[1:] != period[:-1])
    return start[new], period[new]


def rotated(words: np.ndarray, begin: np.ndarray, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """The first word to which each square rotates: words ``period`` apart stay equal.

    Steps double while all words of a step are equal, so the work is
    proportional to the words rotated over.
    """
    at, step = start.copy(), np.ones(len(start), np.int64)
    open_ = np.arange(len(start))
    while len(open_):
        size = np.minimum(step[open_], at[open_] - begin[start[open_]])
        size = np.maximum(size, 0)
        keep = np.ones(len(open_), bool)
        total = np.cumsum(size)
        cut = 0
        while cut < len(open_):
            done = total[cut - 1] if cut else 0
            stop = max(cut + 1, int(np.searchsorted(total, done + PIECE, side="right")))
            who, many = open_[cut:stop], size[cut:stop]
            some = many > 0
            keep[cut:stop] = some
            who, many = who[some], many[some]
            if len(who):
                spot = ranges(at[who] - many, many)
                equal = words[spot] == words[spot + np.repeat(period[who], many)]
                last = np.maximum.reduceat(np.where(equal, -1, spot), np.cumsum(many) - many)
                whole = last < 0
                at[who] = np.where(whole, at[who] - many, last + 1)
                keep[cut:stop][some] = whole
            cut = stop
        open_ = open_[keep]
        step[open_] *= 2
    return at


def runs_of(words: np.ndarray, end: np.ndarray, begin: np.ndarray, least: int = LEAST,
            times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run, by start and period; see the module."""
    start, period = branching_squares(words, end, begin)
    stop = start + 2 * period
    by = np.lexsort((period, stop))
    start, period, stop = start[by], period[by], stop[by]
    found = []
    while len(start):
        shortest = np.ones(len(stop), bool)
        shortest[1:] = stop[1:] != stop[:-1]
        low = rotated(words, begin, start[shortest], period[shortest])
        q, e = period[shortest], stop[shortest]
        ok = (e - low >= least) & (e - low >= times * q)
        found.append((low[ok], e[ok] - low[ok], q[ok]))
        owner = np.cumsum(shortest) - 1
        rest = ~shortest & ~((start >= low[owner]) & (period % q[owner] == 0))
        start, period, stop = start[rest], period[rest], stop[rest]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    low, length, q = (np.concatenate(x) for x in zip(*found))
    by = np.lexsort((q, low))
    return low[by], length[by], q[by]


def _find(least: int, times: int, kind: pa.DataType):
    item = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("period", pa.int32())])
    schema = pa.schema([("id", kind), ("runs", pa.list_(item)), ("n_words", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, off, raw in tb.blocks(batch, limit=BLOCK_BYTES):
                starts, ends, first = tb.word_spans(raw, off)
                doc = tb.document_of(first)
                words = tb.word_hashes(raw, starts, ends) ^ tb.mix64(doc.astype(np.uint64) + np.uint64(1))
                begin, end = first[doc], first[doc + 1]
                low, length, q = runs_of(words, end, begin, least, times)
                gone = np.zeros(len(starts) + 1, np.int64)
                np.add.at(gone, low + q, 1)
                np.add.at(gone, low + length, -1)
                kept_off, kept = joined(raw, off, starts, ends, first, np.cumsum(gone[:-1]) == 0)
                spans = pa.StructArray.from_arrays(
                    [pa.array(x, pa.int32()) for x in (low - begin[low], length, q)], fields=list(item))
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(a, b - a).cast(kind),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(low, first), pa.int32()), spans),
                    pa.array(np.diff(first), pa.int64()),
                    pa.StringArray.from_buffers(b - a, pa.py_buffer(kept_off.astype(np.int32).tobytes()),
                                                pa.py_buffer(kept.tobytes()))], schema=schema)
    return run


def periodic_runs(docs: DataFrame, id: str = "doc_id", text: str = "text",
                  least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Rows (id, runs, n_words, kept), one per document row.

    ``runs`` are by start, then period (word numbers from 0); ``kept`` holds
    the words that no run has after its first period, joined by one space.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    texts = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = texts.schema["id"].dataType
    return texts.mapInArrow(_find(least, times, to_arrow_type(kind)), f"id {kind.simpleString()}, {FOUND}")


def looped(text, key, a: int = 10):
    """Columns: the words of ``text`` joined by one space, every tenth document (by the
    CRC-32 of ``key``) made periodic from one of its words on."""
    h = F.coalesce(F.crc32(key.cast("string").cast("binary")), F.lit(1))
    g = F.floor(h / F.lit(a)).cast("long")
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def turned(w):
        n = F.size(w).cast("long")
        at = g % n
        p = F.lit(1) + F.floor((n - at) / (F.lit(3) + g % 8)).cast("long")
        tail = F.transform(F.sequence(F.lit(0).cast("long"), n - at - 1),
                           lambda i: F.element_at(w, (at + i % p + 1).cast("int")))
        return F.concat(F.slice(w, F.lit(1), at.cast("int")), tail)

    # A one-element transform names the word list once; the plan would repeat its split otherwise.
    listed = F.transform(F.array(words), lambda w: F.array_join(F.when(F.size(w) > 0, turned(w)).otherwise(w), " "))
    return F.when(h % a == 0, F.element_at(listed, 1)).otherwise(text)


def strongest(runs):
    """Column: the run with the greatest length / period, exactly; of equals the first; null if none."""
    longer = lambda a, b: a["length"].cast("long") * b["period"] > b["length"].cast("long") * a["period"]
    return F.aggregate(runs, F.try_element_at(runs, F.lit(1)), lambda best, r: F.when(longer(r, best), r).otherwise(best))
