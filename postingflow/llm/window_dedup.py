"""Substring dedup over fixed-length word windows.

Every document is cut into words; a Rabin-Karp hash is computed for every run
of ``size`` words; hashes meet in Spark buckets, where each keeps the smallest
document id it starts in; a window of a document with a larger id is repeated.
Repeated windows of a document merge into maximal removal intervals.

Plan: one pass over the texts posts the window hashes, packed by bucket (a
block of texts first keeps one posting per hash, so a passage in a third of
all documents reaches its bucket once per block); one grouped pass compares;
one join by document id brings the repeated hashes back to the texts.  The
bucket is drawn from the smallest hash of the window's three-word runs, so
that neighbouring windows mostly share a bucket and a copied passage comes back
in a few rows; two different sequences are taken for one only if 64 bits and
the bucket agree.  A very common run of three words would draw the windows of a
large share of all texts into one bucket: a pass before counts the windows of
every bucket, and one with over ``HOT`` times the mean is split by the
windows' own hashes into buckets of about the mean (equal windows stay
together).  At most one bucket in ``HOT`` can be split; their numbers go through
the driver.

Edge cases: a null text has no words; a text of fewer than ``size`` words has
no window and is kept whole; a null id counts as larger than every id; rows
with one id are one document for the comparison (they do not remove each
other), each is returned; an empty table gives an empty result; other columns
of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sizing
from . import textblocks as tb

WINDOW = 13
BUCKET_BYTES = 8 << 20
_BASE, _RUN_BASE = 0x9E3779B1, 0x85EBCA77
#: Words of the runs that choose a window's bucket.
RUN = 3
#: A bucket with over so many times the mean number of windows is split.
HOT = 4
_LAST = np.iinfo(np.int64).max

POSTINGS = "bucket long, final boolean, ids binary, counts binary, hashes binary"
REPEATED = "id long, hashes binary"
STRIPPED = ("id long, n_words long, n_removed long, "
            "removed array<struct<start:int,end:int>>, kept string")


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False)


def _smallest(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sort by hash; (order, group starts, smallest id of each group, is repeated)."""
    order = np.argsort(h)
    hs = h[order]
    new = np.flatnonzero(np.concatenate(([True], hs[1:] != hs[:-1])))
    owner = ids[order]
    least = np.minimum.reduceat(owner, new)
    again = owner > np.repeat(least, np.diff(np.append(new, len(hs))))
    return order, new, least, again


def _packed(bucket: np.ndarray, ids: np.ndarray, h: np.ndarray, final: bool) -> Iterator[tuple]:
    """Rows of POSTINGS: per bucket its hashes, with run lengths of the ids."""
    if len(h) == 0:
        return
    known, local = np.unique(ids, return_inverse=True)
    order = np.lexsort((local, bucket))
    bucket, local, h = bucket[order], local[order], h[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    for a, b in zip(cuts, np.append(cuts[1:], len(h))):
        run = np.flatnonzero(np.concatenate(([True], local[a + 1:b] != local[a:b - 1])))
        yield (int(bucket[a]), final, known[local[a:b][run]].tobytes(),
               np.diff(np.append(run, b - a)).astype(np.int32).tobytes(), h[a:b].tobytes())


def _placed(raw: np.ndarray, off: np.ndarray, size: int, buckets: int) -> tuple[np.ndarray, ...]:
    """(hash, bucket, document) of every window of a block of texts."""
    starts, ends, first = tb.word_spans(raw, off)
    words = tb.word_hashes(raw, starts, ends)
    h, at, doc = tb.windows(words, first, size, _BASE)
    if len(h) == 0:
        return h, h.astype(np.int64), doc
    run = min(RUN, size)
    least_run = tb.sliding_min(tb.rolling(words, run, _RUN_BASE), size - run + 1)
    return h, (tb.mix64(least_run[at]) % np.uint64(buckets)).astype(np.int64), doc


def _count(size: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, off, raw in tb.blocks(batch):
                n += np.bincount(_placed(raw, off, size, buckets)[1], minlength=buckets)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held])], names=["bucket", "n"])
    return run


class Split:
    """The buckets that are split: their numbers, parts, and the first number of their parts."""

    def __init__(self, buckets: int, hot: np.ndarray, parts: np.ndarray):
        order = np.argsort(hot)
        self.hot, self.parts = hot[order], parts[order]
        self.base = buckets + np.cumsum(self.parts) - self.parts

    def place(self, bucket: np.ndarray, h: np.ndarray) -> np.ndarray:
        if len(self.hot) == 0 or len(bucket) == 0:
            return bucket
        at = np.minimum(np.searchsorted(self.hot, bucket), len(self.hot) - 1)
        part = (tb.mix64(h) % self.parts[at].astype(np.uint64)).astype(np.int64)
        return np.where(self.hot[at] == bucket, self.base[at] + part, bucket)


def split_buckets(texts: DataFrame, size: int, buckets: int) -> Split:
    """Count the windows of every bucket and decide which are split into how many."""
    counted = sizing.written(texts.select("text").mapInArrow(_count(size, buckets), "bucket long, n long")
                             .groupBy("bucket").agg(F.sum("n").alias("n")), "window-buckets")
    mean = max(1.0, (counted.agg(F.sum("n")).first()[0] or 0) / buckets)
    hot = counted.where(F.col("n") > HOT * mean).toArrow()  # at most buckets / HOT rows
    n = hot["n"].to_numpy()
    return Split(buckets, hot["bucket"].to_numpy(), np.ceil(n / mean).astype(np.int64))


def _post(size: int, buckets: int, split: Split):
    schema = pa.schema([("bucket", pa.int64()), ("final", pa.bool_()), ("ids", pa.binary()),
                        ("counts", pa.binary()), ("hashes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _ids(batch.column("id"))
            for a, b, off, raw in tb.blocks(batch):
                h, bucket, doc = _placed(raw, off, size, buckets)
                if len(h) == 0:
                    continue
                place = split.place(bucket, h)
                owner = ids[a:b][doc]
                order, new, least, again = _smallest(h, owner)
                rows = list(_packed(place[order][new], least, h[order][new], False))
                if again.any():  # repeats inside the block are settled here
                    who, what = owner[order][again], h[order][again]
                    home = tb.mix64(who.astype(np.uint64)) % np.uint64(buckets)
                    rows += _packed(home.astype(np.int64), who, what, True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
    return run


def _per_id(ids: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(ids, kind="stable")
    ids, h = ids[order], h[order]
    cuts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    for a, b in zip(cuts, np.append(cuts[1:], len(h))):
        yield int(ids[a]), np.unique(h[a:b]).tobytes()


def _compare(table: pa.Table) -> pa.Table:
    """Repeated hashes of one bucket, by document."""
    def unpack(final: bool) -> tuple[np.ndarray, np.ndarray]:
        part = table.filter(pc.equal(table["final"], final))
        read = lambda name, kind: np.frombuffer(
            b"".join(x.as_py() for x in part[name]), kind)
        return np.repeat(read("ids", np.int64), read("counts", np.int32)), read("hashes", np.uint64)

    ids, h = unpack(True)
    found_ids, found = [ids], [h]
    ids, h = unpack(False)
    if len(h):
        order, _, _, again = _smallest(h, ids)
        found_ids.append(ids[order][again])
        found.append(h[order][again])
    ids, h = np.concatenate(found_ids), np.concatenate(found)
    rows = list(_per_id(ids, h)) if len(h) else []
    return pa.table({"id": pa.array([r[0] for r in rows], pa.int64()),
                     "hashes": pa.array([r[1] for r in rows], pa.binary())})


def _strip(size: int):
    schema = pa.schema([
        ("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
        ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column("repeated")
            for a, b, off, raw in tb.blocks(batch):
                starts, ends, first = tb.word_spans(raw, off)
                gone = np.zeros(len(starts), bool)
                for d in np.flatnonzero(known.slice(a, b - a).is_valid().to_numpy(zero_copy_only=False)):
                    lo, hi = first[d], first[d + 1]
                    flagged = np.frombuffer(b"".join(known[a + int(d)].as_py()), np.uint64)
                    if hi - lo < size or len(flagged) == 0:
                        continue
                    h = tb.rolling(tb.word_hashes(raw, starts[lo:hi], ends[lo:hi]), size, _BASE)
                    gone[lo:hi] = tb.covered(np.flatnonzero(np.isin(h, flagged)), size, hi - lo)
                kept_off, kept = joined(raw, off, starts, ends, first, ~gone)
                lo, hi = _doc_runs(gone, first)
                spans = pa.StructArray.from_arrays(
                    [pa.array(lo[0], pa.int32()), pa.array(lo[1], pa.int32())], ["start", "end"])
                n_gone = np.concatenate(([0], np.cumsum(gone)))
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(a, b - a).cast(pa.int64()),
                    pa.array(np.diff(first), pa.int64()),
                    pa.array(n_gone[first[1:]] - n_gone[first[:-1]], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(hi, pa.int32()), spans),
                    pa.StringArray.from_buffers(b - a, pa.py_buffer(kept_off.astype(np.int32).tobytes()),
                                                pa.py_buffer(kept.tobytes())),
                ], schema=schema)
    return run


def _doc_runs(mask: np.ndarray, first: np.ndarray):
    """Maximal runs of each document: ((starts, ends) in its words, list offsets)."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[first] = True
    start = np.flatnonzero(mask & (edge[:-1] | ~np.concatenate(([False], mask[:-1]))))
    end = np.flatnonzero(mask & (edge[1:] | ~np.concatenate((mask[1:], [False])))) + 1
    doc = np.searchsorted(first, start, side="right") - 1
    return (start - first[doc], end - first[doc]), np.searchsorted(start, first)


def joined(raw: np.ndarray, off: np.ndarray, starts: np.ndarray, ends: np.ndarray,
           first: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept words of each document joined by one space: (offsets, bytes).

    The byte after a kept word that another kept word follows is a separator
    of the text; it becomes the space.
    """
    delta = np.zeros(len(raw) + 1, np.int8)
    delta[starts[keep]] += 1
    delta[ends[keep]] -= 1
    mask = np.cumsum(delta[:-1], dtype=np.int8) > 0
    word = np.flatnonzero(keep)
    doc = np.searchsorted(first, word, side="right") - 1
    follows = np.concatenate((doc[1:] == doc[:-1], [False])) if len(word) else np.zeros(0, bool)
    out = raw.copy()
    gap = ends[word[follows]]
    out[gap] = 0x20
    mask[gap] = True
    total = np.concatenate(([0], np.cumsum(mask)))
    return total[off], out[mask]


def repeated_windows(docs: DataFrame, size: int = WINDOW, id: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """Per document id (null as the largest) the hashes of its repeated windows."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    buckets = sizing.bucket_count(spark, sizing.text_bytes(texts), BUCKET_BYTES, per_partition=8)
    posted = texts.mapInArrow(_post(size, buckets, split_buckets(texts, size, buckets)), POSTINGS)
    found = posted.groupBy("bucket").applyInArrow(_compare, REPEATED)
    return found.groupBy("id").agg(F.collect_list("hashes").alias("repeated"))


def strip_repeats(docs: DataFrame, size: int = WINDOW, id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """Rows (id, n_words, n_removed, removed, kept), one per input row.

    ``removed`` holds the maximal runs of removed words, ``kept`` the other
    words joined by one space.
    """
    texts = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    found = repeated_windows(docs, size, id, text).withColumnRenamed("id", "owner")
    known = texts.join(found, F.coalesce(F.col("id"), F.lit(int(_LAST))) == F.col("owner"), "left")
    return known.select("id", "text", "repeated").mapInArrow(_strip(size), STRIPPED)
