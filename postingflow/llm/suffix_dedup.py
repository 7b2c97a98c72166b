"""Exact substring dedup over bytes with a column-wise multi-document suffix index.

Every ``size``-byte string that starts at two or more places (of one document
or of several) is removed wherever it starts.  Documents meet in three steps:

1. Every ``size``-byte string belongs to the anchor inside it: the leftmost
   smallest hash of its ``GRAM``-byte grams (of half a string's bytes, for
   strings under twice that).  Consecutive strings of one
   anchor form a segment.  Equal strings have equal anchors, so a string can
   only repeat inside the group of its anchor's gram; anchors are posted,
   packed by bucket, and compared once.
2. Segments with equal bytes repeat whole and are settled.  Groups that hold
   different segments go on with one copy of each: their bytes are collected
   in blocks and indexed column by column (``bwt_columns``): each round
   inserts one symbol per segment and updates the transform and the common
   prefixes; neighbours with a common prefix of ``size`` bytes are repeats.
3. The removed spans meet the texts by document.

Postings first settle what repeats inside one block of texts, so a copy held
by a third of all documents reaches its bucket once per block.  A group of very
many different segments (a passage in as many contexts) is not put into one
block either: if one block of texts holds more than ``LOCAL`` of them, or a
bucket more than ``WIDE``, the strings of the group are compared one by one, by
128-bit hash; their buckets follow a second anchor inside the string, and equal
strings of one block go there once.  A block that finds a group wide
says so in the group's bucket, so that all of its segments go the same way.

Edge cases: a null text is an empty one; texts under ``size`` bytes have no
strings; repeated rows repeat each other and are emptied (if ``size`` bytes or
longer); a null id is kept as null; an empty table gives an empty result;
other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sizing
from . import textblocks as tb
from .bwt_columns import repeated_starts

SIZE = 200
GRAM = 80
WIDE = 256
LOCAL = 16
BUCKET_BYTES = 8 << 20
#: Bytes of segments indexed at a time (the index stays in a core's cache).
INDEX_BYTES = 3 << 15
_GRAM_BASE, _PLACE_BASE = 0x27D4EB2F, 0x165667B1

# A posted anchor: its gram, its segment's hash, the segment's document (in
# the row's own list), place and length, and whether the segment is known to
# repeat.  Length 0: no segment, but word that the gram's group is wide.
POSTED = np.dtype([("gram", "<u8"), ("seg", "<u8"), ("doc", "<u4"), ("at", "<u4"), ("len", "<u2"), ("again", "u1")])
# What is known of a segment: removed, or to be indexed or compared by string
# (as a copy that is settled already, or still open).
SPAN = np.dtype([("at", "<u4"), ("len", "<u4"), ("gram", "<u8"), ("how", "u1")])
REMOVED, INDEX_SETTLED, INDEX_OPEN, WIDE_SETTLED, WIDE_OPEN = range(5)
# The same with its document, for what a block has settled by itself.
DONE = np.dtype([("doc", "<u4"), *SPAN.descr])
STRING = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("doc", "<u4"), ("at", "<u4"), ("again", "u1")])

POSTINGS = "bucket long, ids binary, rids binary, posted binary, done binary"
DECIDED = "id long, rid long, undecided boolean, spans binary"
GATHERED = "bucket long, strings boolean, ids binary, rids binary, items binary, bytes binary, done binary"
STRIPPED = "id long, n_bytes long, n_removed long, removed array<struct<start:int,end:int>>, kept binary"


def _schema(ddl: dict[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(ddl.items()))


def gram_of(size: int) -> int:
    """Bytes of the grams that anchor strings of ``size`` bytes."""
    return max(1, min(GRAM, size // 2))


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest value of every run of ``width`` values."""
    bits = max(1, int(len(h)).bit_length())
    low = np.uint64((1 << bits) - 1)
    return (tb.sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), width) & low).astype(np.int64)


def anchored(raw: np.ndarray, off: np.ndarray, size: int, piece: int = tb.BLOCK_BYTES
             ) -> Iterator[tuple[np.ndarray, ...]]:
    """Segments (first string, last string, gram hash, document) of a block, by pieces."""
    gram = gram_of(size)
    span = size - gram + 1
    for lo in range(0, max(0, len(raw) - size + 1), piece):
        part = raw[lo:min(len(raw), lo + piece + size - 1)]
        grams = tb.rolling(tb._LETTERS[part], gram, _GRAM_BASE)
        place = sliding_argmin(grams, span)
        first = np.arange(lo, lo + len(place))
        doc = np.searchsorted(off, first, side="right") - 1
        keep = first + size <= off[doc + 1]
        first, place, doc = first[keep], place[keep], doc[keep]
        if len(first) == 0:
            continue
        new = np.flatnonzero(np.concatenate(
            ([True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | (np.diff(first) != 1))))
        last = first[np.append(new[1:], len(first)) - 1]
        yield first[new], last, grams[place[new]], doc[new]


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort by the keys (first key outermost): (order, first of each group)."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)


def _post(size: int, buckets: int):
    schema = _schema({"bucket": pa.int64(), **{c: pa.binary() for c in ("ids", "rids", "posted", "done")}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "rid"))
            for a, b, off, raw in tb.blocks(batch):
                data = raw.tobytes()
                rows = []
                for first, last, gram, doc in anchored(raw, off, size):
                    item = np.zeros(len(first), POSTED)
                    item["gram"], item["doc"] = gram, doc
                    item["at"], item["len"] = first - off[doc], last - first + size
                    item["seg"] = [xxhash.xxh3_64_intdigest(data[s:e])
                                   for s, e in zip(first.tolist(), (last + size).tolist())]
                    rows.append(item)
                if not rows:
                    continue
                items = np.concatenate(rows)
                order, new = _groups(items["gram"], items["seg"])
                items = items[order]
                count = np.diff(np.append(new, len(items)))
                copies = np.ones(len(items), bool)
                copies[new] = False
                one = items[new]  # one of each segment; its copies are settled
                one["again"] = count > 1
                kinds = _sizes(one["gram"])
                broad, heard = one[kinds > LOCAL], one[kinds <= LOCAL]
                news = broad[np.unique(broad["gram"], return_index=True)[1]]
                news["len"] = 0
                gone = _done(items[copies], REMOVED)
                wide = _done(broad, np.where(broad["again"], WIDE_SETTLED, WIDE_OPEN))
                sure = _done(broad[broad["again"] > 0], REMOVED)
                yield _packed(ids[a:b], rids[a:b], np.concatenate((heard, news)),
                              np.concatenate((gone, wide, sure)), buckets, schema)
    return run


def _sizes(sorted_keys: np.ndarray) -> np.ndarray:
    """Size of the run of equal keys that each item belongs to."""
    new = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    n = np.diff(np.append(new, len(sorted_keys)))
    return np.repeat(n, n) if len(sorted_keys) else np.zeros(0, np.int64)


def _done(items: np.ndarray, how) -> np.ndarray:
    out = np.zeros(len(items), DONE)
    for c in ("doc", "at", "len", "gram"):
        out[c] = items[c]
    out["how"] = how
    return out


def _packed(ids, rids, posted, done, buckets: int, schema: pa.Schema) -> pa.RecordBatch:
    """One row per bucket: its postings, and what is settled already."""
    home = (posted["gram"] % np.uint64(buckets)).astype(np.int64)
    other = (tb.mix64(rids[done["doc"]].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    columns = [[] for _ in schema]
    posted_order, done_order = np.argsort(home, kind="stable"), np.argsort(other, kind="stable")
    home, other = home[posted_order], other[done_order]
    for k in np.union1d(home, other):
        p = posted[posted_order[slice(*np.searchsorted(home, (k, k + 1)))]]
        d = done[done_order[slice(*np.searchsorted(other, (k, k + 1)))]]
        docs, local = np.unique(np.concatenate((p["doc"], d["doc"])), return_inverse=True)
        p["doc"], d["doc"] = local[:len(p)], local[len(p):]
        for c, v in zip(columns, (int(k), ids[docs].tobytes(), rids[docs].tobytes(), p.tobytes(), d.tobytes())):
            c.append(v)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _unpack(table: pa.Table, name: str, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(items, ids, rids) of all rows of a group, documents numbered across rows."""
    ids, rids, items, base = [], [], [], 0
    for i, r, x in zip(table["ids"], table["rids"], table[name]):
        part = np.frombuffer(x.as_py(), kind).copy()
        part["doc"] += base
        ids.append(np.frombuffer(i.as_py(), np.int64))
        rids.append(np.frombuffer(r.as_py(), np.int64))
        items.append(part)
        base += len(ids[-1])
    return np.concatenate(items), np.concatenate(ids), np.concatenate(rids)


def _decided(ids, rids, doc, spans: np.ndarray) -> pa.Table:
    """Rows of DECIDED, one per document."""
    order, new = _groups(ids[doc], rids[doc])
    doc, spans = doc[order], spans[order]
    ends = np.append(new[1:], len(doc))
    return pa.table({
        "id": pa.array(ids[doc[new]], pa.int64()), "rid": pa.array(rids[doc[new]], pa.int64()),
        "undecided": pa.array([bool((spans["how"][a:b] != REMOVED).any()) for a, b in zip(new, ends)], pa.bool_()),
        "spans": pa.array([spans[a:b].tobytes() for a, b in zip(new, ends)], pa.binary())})


def _as_spans(at, length, gram, how) -> np.ndarray:
    out = np.zeros(len(at), SPAN)
    out["at"], out["len"], out["gram"], out["how"] = at, length, gram, how
    return out


def _compare(table: pa.Table) -> pa.Table:
    """Settle the segments of one bucket; name those that must be looked into."""
    done, ids, rids = _unpack(table, "done", DONE)
    items, _, _ = _unpack(table, "posted", POSTED)
    broad = np.unique(items["gram"][items["len"] == 0])
    items = items[items["len"] > 0]
    docs = [done["doc"]]
    spans = [_as_spans(done["at"], done["len"], done["gram"], done["how"])]
    if len(items):
        order, new = _groups(items["gram"], items["seg"])
        items = items[order]
        count = np.diff(np.append(new, len(items)))
        again = (count > 1) | np.logical_or.reduceat(items["again"] > 0, new)
        gone = items[np.repeat(again, count)]
        docs.append(gone["doc"])
        spans.append(_as_spans(gone["at"], gone["len"], gone["gram"], REMOVED))
        one = items[new]  # a copy of every different segment
        kinds, told = _sizes(one["gram"]), np.isin(one["gram"], broad)
        how = np.where(again, INDEX_SETTLED, INDEX_OPEN) + np.where(told | (kinds > WIDE), 2, 0)
        look = told | (kinds > 1)
        docs.append(one["doc"][look])
        spans.append(_as_spans(one["at"][look], one["len"][look], one["gram"][look], how[look]))
    return _decided(ids, rids, np.concatenate(docs), np.concatenate(spans))


def _gather(size: int, buckets: int):
    """Fetch the bytes (or string hashes) of undecided segments, packed by bucket."""
    schema = _schema({"bucket": pa.int64(), "strings": pa.bool_(),
                      **{c: pa.binary() for c in ("ids", "rids", "items", "bytes", "done")}})

    def rows(ids, rids, doc, items, home, texts, strings, done=None):
        order = np.argsort(home, kind="stable")
        doc, items, home = doc[order], items[order], home[order]
        if done is not None and len(done):  # what the block has settled goes along with one bucket
            docs, local = np.unique(done["doc"], return_inverse=True)
            done["doc"] = local
            yield (int(rids[docs[0]] % buckets), True, ids[docs].tobytes(), rids[docs].tobytes(), b"", b"", done.tobytes())
        cuts = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1]))) if len(home) else []
        for a, b in zip(cuts, np.append(cuts[1:], len(home))):
            docs, local = np.unique(doc[a:b], return_inverse=True)
            if strings:
                items["doc"][a:b] = local
                what, body = items[a:b].tobytes(), b""
            else:
                part = np.zeros(b - a, POSTED)
                part["gram"], part["doc"], part["at"] = items["gram"][a:b], local, items["at"][a:b]
                part["len"], part["again"] = items["len"][a:b], items["how"][a:b] == INDEX_SETTLED
                what = part.tobytes()
                body = b"".join(texts[d][s:s + n] for d, s, n in zip(
                    doc[a:b].tolist(), items["at"][a:b].tolist(), items["len"][a:b].tolist()))
            yield int(home[a]), strings, ids[docs].tobytes(), rids[docs].tobytes(), what, body, b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "rid"))
            spans = [np.frombuffer(b"".join(x.as_py()), SPAN) for x in batch.column("spans")]
            for a, b, off, raw in tb.blocks(batch):
                doc = np.repeat(np.arange(b - a), [len(s) for s in spans[a:b]])
                todo = np.concatenate(spans[a:b])
                texts = [raw[s:e].tobytes() for s, e in zip(off[:-1], off[1:])]
                found = []
                index = (todo["how"] == INDEX_SETTLED) | (todo["how"] == INDEX_OPEN)
                if index.any():
                    part = todo[index]
                    found += rows(ids[a:b], rids[a:b], doc[index], part,
                                  (part["gram"] % np.uint64(buckets)).astype(np.int64), texts, False)
                wide = (todo["how"] == WIDE_SETTLED) | (todo["how"] == WIDE_OPEN)
                if wide.any():
                    part, of, home, done = _strings(todo[wide], doc[wide], texts, size, buckets)
                    found += rows(ids[a:b], rids[a:b], of, part, home, texts, True, done)
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)
    return run


def _strings(spans: np.ndarray, doc: np.ndarray, texts: list[bytes], size: int, buckets: int):
    """Every string of the given segments by 128-bit hash, one of each per block:
    (strings, documents, buckets, spans of the strings that repeat in the block)."""
    out, places = [], []
    for d, s, n, how in zip(doc.tolist(), spans["at"].tolist(), spans["len"].tolist(), spans["how"].tolist()):
        text = texts[d][s:s + n]
        pair = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[k:k + size]) for k in range(n - size + 1)),
                             "<u8").reshape(-1, 2)
        part = np.zeros(len(pair), STRING)
        part["h1"], part["h2"], part["doc"], part["at"] = pair[:, 0], pair[:, 1], d, np.arange(s, s + len(pair))
        part["again"] = how == WIDE_SETTLED
        # Neighbouring strings mostly share the smallest hash of their grams.
        grams = tb.rolling(tb._LETTERS[np.frombuffer(text, np.uint8)], gram_of(size), _PLACE_BASE)
        places.append(tb.sliding_min(grams, size - gram_of(size) + 1))
        out.append(part)
    items, place = np.concatenate(out), np.concatenate(places)
    order, new = _groups(items["h1"], items["h2"])
    items, place = items[order], place[order]
    count = np.diff(np.append(new, len(items)))
    settled = (count > 1) | np.logical_or.reduceat(items["again"] > 0, new)
    open_ = items["again"] == 0
    gone = items[np.repeat(settled, count) & open_]
    one, place = items[new], place[new]
    one["again"] = settled
    done = np.zeros(0, DONE)
    if len(gone):
        at, end, of = _runs_of(gone)
        done = np.zeros(len(at), DONE)
        done["doc"], done["at"], done["len"], done["how"] = of, at, end - at + size, REMOVED
    return one, one["doc"].astype(np.int64), (tb.mix64(place) % np.uint64(buckets)).astype(np.int64), done


def _runs_of(items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive places of one document: (first, last, document)."""
    items = items[np.lexsort((items["at"], items["doc"]))]
    at, of = items["at"].astype(np.int64), items["doc"]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(at) > 1) | (of[1:] != of[:-1]))))
    return at[new], at[np.append(new[1:], len(at)) - 1], of[new]


def _index(size: int):
    def strings(table: pa.Table):
        done, ids, rids = _unpack(table, "done", DONE)
        items, _, _ = _unpack(table, "items", STRING)
        docs = [done["doc"]]
        spans = [_as_spans(done["at"], done["len"], done["gram"], done["how"])]
        if len(items):
            order, new = _groups(items["h1"], items["h2"])
            items = items[order]
            count = np.diff(np.append(new, len(items)))
            again = np.repeat((count > 1) | np.logical_or.reduceat(items["again"] > 0, new), count)
            found = items[again & (items["again"] == 0)]
            if len(found):
                at, end, of = _runs_of(found)
                docs.append(of)
                spans.append(_as_spans(at, end - at + size, 0, REMOVED))
        return _decided(ids, rids, np.concatenate(docs), np.concatenate(spans))

    def segments(table: pa.Table):
        items, ids, rids = _unpack(table, "items", POSTED)
        data = np.frombuffer(b"".join(x.as_py() for x in table["bytes"]), np.uint8)
        begin = np.cumsum(items["len"], dtype=np.int64) - items["len"]
        order = np.argsort(items["gram"], kind="stable")
        gram = items["gram"][order]
        ends = np.append(np.flatnonzero(gram[1:] != gram[:-1]) + 1, len(gram))
        # Whole groups, about INDEX_BYTES of segments at a time.
        total = np.cumsum(items["len"][order], dtype=np.int64)
        docs, spans = [], []
        a = 0
        while a < len(order):
            full = np.searchsorted(total, (total[a - 1] if a else 0) + INDEX_BYTES)
            b = int(ends[np.searchsorted(ends, max(a + 1, full))])
            part = order[a:b]
            off = np.concatenate(([0], np.cumsum(items["len"][part], dtype=np.int64)))
            body = np.concatenate([data[s:s + n] for s, n in zip(begin[part], items["len"][part])])
            # Runs of repeated starts; a segment's last ones are never starts.
            place, end = tb.runs(repeated_starts(body, off, size))
            seg = np.searchsorted(off, place, side="right") - 1
            still = items["again"][part[seg]] == 0
            place, end, seg = place[still], end[still], seg[still]
            docs.append(items["doc"][part[seg]])
            spans.append(_as_spans(items["at"][part[seg]] + (place - off[seg]), end - place + size - 1, 0, REMOVED))
            a = b
        return _decided(ids, rids, np.concatenate(docs), np.concatenate(spans))

    def run(table: pa.Table) -> pa.Table:
        kind = table["strings"].to_numpy()
        out = [f(table.filter(pa.array(kind == k))) for k, f in ((False, segments), (True, strings)) if (kind == k).any()]
        return pa.concat_tables(out)
    return run


def _strip():
    schema = _schema({"id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(),
                      "removed": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
                      "kept": pa.binary()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column("spans")
            for a, b, off, raw in tb.blocks(batch):
                delta = np.zeros(len(raw) + 1, np.int32)
                for d in np.flatnonzero(known.slice(a, b - a).is_valid().to_numpy(zero_copy_only=False)):
                    spans = np.frombuffer(b"".join(known[a + int(d)].as_py()), SPAN)
                    spans = spans[spans["how"] == REMOVED]
                    at = off[d] + spans["at"].astype(np.int64)
                    np.add.at(delta, at, 1)
                    np.add.at(delta, at + spans["len"], -1)
                gone = np.cumsum(delta[:-1]) > 0
                edge = np.zeros(len(raw) + 1, bool)
                edge[off] = True
                start = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate(([False], gone[:-1]))))
                end = np.flatnonzero(gone & (edge[1:] | ~np.concatenate((gone[1:], [False])))) + 1
                doc = np.searchsorted(off, start, side="right") - 1
                lists = pa.array(np.searchsorted(start, off), pa.int32())
                runs = pa.StructArray.from_arrays(
                    [pa.array(start - off[doc], pa.int32()), pa.array(end - off[doc], pa.int32())], ["start", "end"])
                total = np.concatenate(([0], np.cumsum(gone)))
                left = (off - total[off]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(a, b - a), pa.array(np.diff(off), pa.int64()),
                    pa.array(np.diff(total[off]), pa.int64()), pa.ListArray.from_arrays(lists, runs),
                    pa.BinaryArray.from_buffers(pa.binary(), b - a, [
                        None, pa.py_buffer(left.tobytes()), pa.py_buffer(raw[~gone].tobytes())]),
                ], schema=schema)
    return run


def strip_repeated_bytes(docs: DataFrame, size: int = SIZE, id: str = "doc_id",
                         text: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_removed, removed, kept), one per document row.

    ``removed`` holds the maximal runs of removed bytes, ``kept`` the other
    bytes joined.  A document is known by its id and its text's hash.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(F.col(id).cast("long").alias("id"), body.alias("text"))
    # A null id is a number of its own inside; the hash tells such rows apart.
    texts = texts.select("id", F.coalesce("id", F.lit(-(1 << 63))).alias("key"),
                         F.xxhash64("text").alias("rid"), "text")
    total = sizing.text_bytes(texts)
    buckets = sizing.bucket_count(spark, total, BUCKET_BYTES)
    keyed = texts.select(F.col("key").alias("id"), "rid", "text")
    decided = sizing.written(
        keyed.mapInArrow(_post(size, buckets), POSTINGS).groupBy("bucket").applyInArrow(_compare, DECIDED), "decided")
    todo = (decided.where("undecided").groupBy("id", "rid").agg(F.collect_list("spans").alias("spans")))
    gathered = keyed.join(todo, ["id", "rid"]).select("id", "rid", "text", "spans") \
        .mapInArrow(_gather(size, buckets), GATHERED)
    looked = gathered.groupBy("bucket").applyInArrow(_index(size), DECIDED)
    gone = (decided.unionByName(looked).groupBy("id", "rid").agg(F.collect_list("spans").alias("spans"))
            .select(F.col("id").alias("key"), "rid", "spans"))
    return (texts.join(gone, ["key", "rid"], "left").select("id", "text", "spans")
            .mapInArrow(_strip(), STRIPPED))
