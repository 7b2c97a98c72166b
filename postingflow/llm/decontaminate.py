"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the ``size``-word windows of the benchmark items (an item of
fewer words is one pattern).  Patterns of one length share a block shift
table: the block is the last two words under the window; its shift says how
far the window can move before any pattern could end there, so most positions
are never looked at.  A block with shift 0 selects its suffix bucket, the hash
of the window the bucket's few patterns that can be it (many patterns may end
alike), and a direct comparison of the words' bytes confirms an occurrence.
All documents of a block move their windows in step, as array operations.

The benchmark is read in shards whose bytes are summed first, so that what is
sent to the tasks never exceeds ``SHARD_BYTES``; every shard is searched in
all documents, and the hits of the shards add up in the document's row.

Edge cases: a null text or item has no words; an item without words has no
pattern and never occurs; repeated items (equal texts or ids) are each
reported by id, each id once; a null item id is left out; an empty benchmark
leaves every document clean; repeated document rows are each reported; other
columns of the inputs are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb

WINDOW = 10
SHARD_BYTES = 8 << 20
TABLE_BITS = 20
_WHOLE = 0xC2B2AE35
HITS = ("n_words long, spans array<struct<start:int,end:int>>, items array<string>")


def pattern_words(text: str | None) -> list[bytes]:
    """Lower-cased words of one item."""
    raw = tb.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = tb.word_spans(raw, np.array([0, len(raw)]), tb.LOWER_ALNUM)
    return [raw[a:b].tobytes() for a, b in zip(starts, ends)]


class Patterns:
    """Shift tables and suffix buckets of one benchmark shard, by pattern length."""

    def __init__(self, items: list[tuple[str, str | None]], size: int = WINDOW):
        owners: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = pattern_words(text)
            if words and item is not None:
                m = min(size, len(words))
                for i in range(len(words) - m + 1):
                    owners[m][tuple(words[i:i + m])].add(item)
        self.groups = []
        for m, found in sorted(owners.items()):
            block = min(2, m)
            hashes = np.array([_hash_words(p) for p in found], np.uint64).reshape(len(found), m)
            ends = _block_hashes(hashes, block)  # a column per block position
            width = m - block + 1
            shift = np.full(1 << TABLE_BITS, width, np.uint8 if width < 256 else np.int32)
            for k in range(width):  # later blocks give the smaller shift
                shift[_slot(ends[:, k])] = width - 1 - k
            whole = tb.rolling(hashes.reshape(-1), m, _WHOLE)[::m]
            buckets = defaultdict(lambda: defaultdict(list))
            for key, own, words, ids in zip(ends[:, -1].tolist(), whole.tolist(), found, found.values()):
                buckets[key][own].append((words, sorted(ids)))
            self.groups.append((m, block, shift, dict(buckets), np.sort(np.unique(ends[:, -1]))))


def _hash_words(words: tuple[bytes, ...]) -> np.ndarray:
    raw = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = tb.word_spans(raw, np.array([0, len(raw)]))
    return tb.word_hashes(raw, starts, ends)


def _block_hashes(words: np.ndarray, block: int) -> np.ndarray:
    """Hash of each run of ``block`` words along the last axis."""
    if block == 1:
        return words
    return tb.mix64(words[..., :-1] * np.uint64(0x9E3779B1) + words[..., 1:])


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


#: Documents are searched in strips of so many words, all at once.
STRIP = 512


def search(patterns: Patterns, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray,
           first: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
    """Occurrences (first word, end word, item ids) in a block of documents."""
    for m, block, shift, buckets, suffixes in patterns.groups:
        if len(words) < m:
            continue
        blocks = _block_hashes(words, block)
        whole = tb.rolling(words, m, _WHOLE)
        slots = _slot(blocks)
        # Strips [position of the window's last block, last such position + 1).
        counts = np.maximum(0, np.diff(first) - m + 1)
        strips = -(-counts // STRIP)
        doc = np.repeat(np.arange(len(counts)), strips)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(strips) - strips, strips)
        at = first[:-1][doc] + m - block + nth * STRIP
        stop = np.minimum(at + STRIP, first[:-1][doc] + m - block + counts[doc])
        while len(at):
            step = shift[slots[at]].astype(np.int64)
            hit = at[step == 0]
            if len(hit):
                near = np.searchsorted(suffixes, blocks[hit])
                sure = suffixes[np.minimum(near, len(suffixes) - 1)] == blocks[hit]
                for p in hit[sure].tolist():
                    a = p - (m - block)
                    for pattern, ids in buckets[int(blocks[p])].get(int(whole[a]), ()):
                        if all(raw[starts[a + k]:ends[a + k]].tobytes() == w
                               for k, w in enumerate(pattern)):
                            yield a, a + m, ids
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]


def _scan(shard, carried: list[pa.Field]):
    schema = pa.schema([*carried, ("n_words", pa.int64()),
                        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                        ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = Patterns(shard.value)
        for batch in batches:
            for a, b, off, raw in tb.blocks(batch, "text"):
                raw = tb.LOWER[raw]
                starts, ends, first = tb.word_spans(raw, off, tb.LOWER_ALNUM)
                words = tb.word_hashes(raw, starts, ends)
                hits = [(int(np.searchsorted(first, s, side="right")) - 1, s, e, ids)
                        for s, e, ids in search(patterns, raw, starts, ends, first, words)]
                spans, items = [[] for _ in range(b - a)], [set() for _ in range(b - a)]
                for d, s, e, ids in sorted(hits, key=lambda x: x[:3]):
                    s, e = int(s - first[d]), int(e - first[d])
                    items[d].update(ids)
                    if spans[d] and s <= spans[d][-1]["end"]:
                        spans[d][-1]["end"] = max(e, spans[d][-1]["end"])
                    else:
                        spans[d].append({"start": s, "end": e})
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name).cast(f.type) for f in carried),
                     pa.array(np.diff(first), pa.int64()), pa.array(spans, schema.field("spans").type),
                     pa.array([sorted(x) for x in items], pa.list_(pa.string()))], schema=schema)
    return run


def _shards(bench: DataFrame, item: str, text: str) -> list:
    """The benchmark as broadcast lists of (item id, text), each of bounded bytes."""
    spark = bench.sparkSession
    rows = bench.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")).distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = max(1, -(-2 * total // SHARD_BYTES))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [spark.sparkContext.broadcast(
        [(r.item, r.text) for r in rows.where(part == k).toLocalIterator()]) for k in range(n)]


def contaminated_words(docs: DataFrame, bench: DataFrame, id: str = "doc_id", text: str = "text",
                       item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (id, text, n_words, spans, items), one per document row.

    ``spans`` are the maximal runs of hit words, ``items`` the ids (as
    strings, sorted) of the benchmark items with an occurring window.
    """
    texts = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    carried = [pa.field("id", _arrow(texts.schema["id"].dataType)), pa.field("text", pa.string())]
    head = f"id {texts.schema['id'].dataType.simpleString()}, text string, "
    merged = None
    for shard in _shards(bench, item, item_text):
        source = texts if merged is None else merged.select("id", "text", "spans", "items")
        held = carried if merged is None else [
            *carried, pa.field("old_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            pa.field("old_items", pa.list_(pa.string()))]
        if merged is None:
            merged = source.mapInArrow(_scan(shard, held), head + HITS)
            continue
        source = source.withColumnsRenamed({"spans": "old_spans", "items": "old_items"})
        again = source.mapInArrow(
            _scan(shard, held), head + "old_spans array<struct<start:int,end:int>>, old_items array<string>, " + HITS)
        merged = again.select(
            "id", "text", "n_words", merge_spans(F.concat("old_spans", "spans")).alias("spans"),
            F.array_sort(F.array_union("old_items", "items")).alias("items"))
    return merged


def merge_spans(spans):
    """Union of half-open spans as maximal runs, sorted."""
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def add(done, span):
        return (F.when((F.size(done) > 0) & (span["start"] <= F.try_element_at(done, F.lit(-1))["end"]),
                       F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                           F.try_element_at(done, F.lit(-1))["start"].alias("start"),
                           F.greatest(F.try_element_at(done, F.lit(-1))["end"], span["end"]).alias("end")))))
                .otherwise(F.concat(done, F.array(span))))
    return F.aggregate(F.array_sort(spans), empty, add)


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def hit_words(spans):
    """Number of words in disjoint spans."""
    return F.aggregate(spans, F.lit(0).cast("long"),
                       lambda n, s: n + (s["end"] - s["start"]).cast("long"))
