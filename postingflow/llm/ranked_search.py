"""Ranked lexical search: the best documents of every item, by norm buckets.

A document is a vector of impacts over the terms of the items (integers made of
term frequency and length), an item the set of its terms with their weights;
the score is their inner product.  With weight ``w`` and impact ``x`` both sides
are scaled by the root of ``w``, which leaves the product as it is.

1. One pass over the texts makes the sparse vectors and writes them; document
   frequencies are counted from that table.
2. The vectors are ordered by length and dealt into ranges of similar length
   (vectors of one length are spread by a hash of the document): the buckets.
3. The longest vectors are searched first; the ``top``-th score found there is a
   floor for every item.
4. Every bucket is searched in chunks of falling length.  A chunk is left out
   for an item if the item's length times the chunk's greatest is under the
   floor (Cauchy-Schwarz).  Inside, the item's terms with the least possible
   gain, as many as together cannot reach the floor, are set aside; only
   documents that hold one of the other terms are candidates.  A candidate's
   exact part over those, plus the least of the coordinate bound and the
   Cauchy-Schwarz bound over the rest of its vector, must reach the floor.
5. Survivors are scored anew in 64-bit integers; each bucket keeps its ``top``
   an item, raising the floor as it goes, and those are ranked.

Nothing is approximate: the bounds leave out only what cannot be among the best.

Sizes.  Items go in shards of at most ``PAIRS`` (item, term) pairs (or one item,
if it has more); a shard is what is broadcast, and one pass is made for each.
A bucket's rows reach the tasks in Arrow batches; the shuffles carry one vector
a document, and at most ``top`` rows an item and bucket.

Edge cases: a null text or one without terms is in no result and not counted as
a document; rows with one id are documents of their own, rows without an id are
ranked after equals with one; the rows of one item id (or of none) are one item
with the terms of all; an item without terms, or whose terms no document holds,
has no rows; empty tables give an empty result; other columns are not read.
Terms are compared as 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sizing
from . import textblocks as tb
from .periodic_runs import ranges

TOP = 50
#: (item, term) pairs of one shard: 16 bytes each in the driver and every task.
PAIRS = 1 << 21
#: Share of the vectors, the longest, that give the first floor.
LONGEST = 0.02
#: Coordinates of one bucket, and documents of the first and the largest chunk.
BUCKET_COORDINATES = 1 << 20
FIRST_CHUNK, LAST_CHUNK = 256, 1 << 13
#: Room for rounding in the bounds, which are doubles; scores are integers.
SLACK = 1 + 1e-9


def _terms(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term hashes, first term of each document)."""
    raw = tb.LOWER[raw]
    starts, ends, first = tb.word_spans(raw, off, tb.LOWER_ALNUM)
    return tb.word_hashes(raw, starts, ends), first


def _item_terms(kind: pa.DataType):
    schema = pa.schema([("item", kind), ("term", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, off, raw in tb.blocks(batch):
                term, first = _terms(raw, off)
                doc = tb.document_of(first)
                pair = np.unique(np.stack([doc.astype(np.int64), term.view(np.int64)]), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item").cast(kind).slice(a, b - a).take(pa.array(pair[0])), pa.array(pair[1])],
                    schema=schema)
    return run


def _vectors(known, kind: pa.DataType):
    schema = pa.schema([("id", kind), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = known.value
        for batch in batches:
            for a, b, off, raw in tb.blocks(batch):
                term, first = _terms(raw, off)
                doc = tb.document_of(first)
                place = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
                hit = terms[place] == term
                pair, count = np.unique(doc[hit].astype(np.int64) << 32 | place[hit], return_counts=True)
                ends = pa.array(np.searchsorted(pair >> 32, np.arange(b - a + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(a, b - a).cast(kind), pa.array(np.diff(first), pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(pair & 0xFFFFFFFF, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(count, pa.int32()))], schema=schema)
    return run


class Items:
    """The items of a shard: their ids, their terms' numbers and weights."""

    def __init__(self, ids: pa.Array, item: np.ndarray, term: np.ndarray, weight: np.ndarray,
                 n_docs: int, n_words: int):
        keep = weight[term] > 0  # a term of weight 0, or that no document holds, adds nothing
        by = np.argsort(item[keep], kind="stable")
        self.ids, self.weight, self.n_docs, self.n_words = ids, weight, n_docs, n_words
        self.terms = term[keep][by]
        self.first = np.searchsorted(item[keep][by], np.arange(len(ids) + 1))
        squares = np.concatenate(([0], np.cumsum(weight[self.terms])))
        self.length = np.sqrt(squares[self.first[1:]] - squares[self.first[:-1]])

    def impacts(self, n: np.ndarray, doc: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Impact of each coordinate: ``n`` a document's words, ``count`` of the term in it."""
        if len(n) and 50 * int(n.max()) * self.n_docs >= 1 << 63:
            m = np.array([50 + 50 * int(x) * self.n_docs // self.n_words for x in n], np.int64)
        else:
            m = 50 + 50 * n * self.n_docs // max(self.n_words, 1)
        count = count.astype(np.int64)
        return 1000000000 * count // (1000 * count + 20 * m[doc])


class Chunk:
    """Vectors of similar length: rows by document, and postings by term."""

    def __init__(self, batch: pa.RecordBatch, items: Items):
        n = batch.column("n").to_numpy()
        terms = batch.column("terms")
        first = terms.offsets.to_numpy().astype(np.int64)
        size = np.diff(first)
        term = terms.values.to_numpy()[first[0]:first[-1]].astype(np.int64)
        counts = batch.column("counts")
        count = counts.values.to_numpy()[counts.offsets[0].as_py():counts.offsets[-1].as_py()]
        doc = np.repeat(np.arange(len(n)), size)
        x = items.impacts(n, doc, count)
        some = items.weight[term] > 0
        doc, term, x = doc[some], term[some], x[some]
        self.ids, self.n = batch.column("id"), len(n)
        self.first = np.searchsorted(doc, np.arange(self.n + 1))
        self.term, self.x = term, x
        self.square = items.weight[term] * x.astype(np.float64) ** 2
        total = np.concatenate(([0.0], np.cumsum(self.square)))
        self.squares = total[self.first[1:]] - total[self.first[:-1]]
        by = np.argsort(term, kind="stable")
        self.post_doc, self.post_x, self.post_square = doc[by], x[by], self.square[by]
        self.post_terms, self.post_first = np.unique(term[by], return_index=True)
        self.post_end = np.append(self.post_first[1:], len(by))
        self.most = np.maximum.reduceat(self.post_x, self.post_first) if len(by) else np.zeros(0, np.int64)
        self.longest = math.sqrt(self.squares.max(initial=0.0))

    def survivors(self, terms: np.ndarray, weight: np.ndarray, floor: int) -> np.ndarray:
        """Documents whose score can reach ``floor`` (at least 1)."""
        place = np.searchsorted(self.post_terms, terms)
        place[place == len(self.post_terms)] = 0
        held = self.post_terms[place] == terms
        place, w = place[held], weight[terms[held]]
        gain = w * self.most[place]
        by = np.argsort(gain, kind="stable")
        place, w, gain = place[by], w[by], gain[by]
        # Terms set aside: the most that together stay under the floor by either bound.
        coordinates = np.cumsum(gain)
        lengths = np.sqrt(np.cumsum(w))
        under = np.minimum(coordinates.astype(np.float64), lengths * self.longest) * SLACK < floor
        aside = int(np.flatnonzero(under)[-1]) + 1 if under.any() else 0
        most = coordinates[aside - 1] if aside else 0
        length = lengths[aside - 1] if aside else 0.0
        place, w = place[aside:], w[aside:]
        if len(place) == 0:
            return np.zeros(0, np.int64)
        size = self.post_end[place] - self.post_first[place]
        spot = ranges(self.post_first[place], size)
        doc = self.post_doc[spot]
        part = np.bincount(doc, np.repeat(w, size) * self.post_x[spot].astype(np.float64), self.n)
        if not aside:
            return np.flatnonzero(part >= floor / SLACK)
        left = np.maximum(self.squares * SLACK - np.bincount(doc, self.post_square[spot], self.n), 0.0)
        return np.flatnonzero((part > 0) & ((part + np.minimum(float(most), length * np.sqrt(left))) * SLACK >= floor))

    def scores(self, docs: np.ndarray, inside: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Exact scores; ``inside`` marks the item's terms."""
        size = self.first[docs + 1] - self.first[docs]
        spot = ranges(self.first[docs], size)
        term = self.term[spot]
        value = np.where(inside[term], weight[term] * self.x[spot], 0)
        total = np.concatenate(([0], np.cumsum(value)))
        end = np.cumsum(size)
        return total[end] - total[end - size]


def _best_first(scores: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Order by falling score, then rising id, null last."""
    by_id = pc.array_sort_indices(ids, order="ascending").to_numpy()
    return by_id[np.argsort(-scores[by_id], kind="stable")]


def _chunks(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.RecordBatch, int]]:
    at = 0
    while at < batch.num_rows:
        yield batch.slice(at, size), size
        at += size
        size = min(2 * size, LAST_CHUNK)


def _search(items, floors, top: int, kind: pa.DataType):
    """Best rows of each partition (rows of falling vector length)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Items = items.value
        schema = pa.schema([("item", q.ids.type), ("id", kind), ("score", pa.int64()), ("scored", pa.int64())])
        floor = np.ones(len(q.ids), np.int64) if floors is None else np.maximum(floors.value, 1)
        best: dict[int, tuple[np.ndarray, pa.Array]] = {}
        inside, size, scored = np.zeros(len(q.weight), bool), FIRST_CHUNK, 0
        for batch in batches:
            for rows, size in _chunks(batch, size):
                chunk = Chunk(rows, q)
                for k in np.flatnonzero((q.length * chunk.longest * SLACK >= floor) & (q.length > 0)):
                    terms = q.terms[q.first[k]:q.first[k + 1]]
                    docs = chunk.survivors(terms, q.weight, floor[k])
                    if len(docs) == 0:
                        continue
                    inside[terms] = True
                    scores = chunk.scores(docs, inside, q.weight)
                    inside[terms] = False
                    scored += len(docs)
                    keep = scores >= floor[k]
                    if not keep.any():
                        continue
                    scores, ids = scores[keep], chunk.ids.cast(kind).take(pa.array(docs[keep]))
                    if k in best:
                        scores = np.concatenate((best[k][0], scores))
                        ids = pa.concat_arrays([best[k][1], ids])
                    by = _best_first(scores, ids)[:top]
                    best[k] = scores[by], ids.take(pa.array(by))
                    if len(by) == top:
                        floor[k] = max(floor[k], scores[by[-1]])
                size = min(2 * size, LAST_CHUNK)
        for k, (scores, ids) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([q.ids.slice(k, 1)] * len(ids)), ids, pa.array(scores),
                 pa.array(np.full(len(ids), scored))], schema=schema)
    return run


def _lengths(items, kind: pa.DataType):
    """Adds the length of each vector."""
    schema = pa.schema([("id", kind), ("n", pa.int64()), ("terms", pa.list_(pa.int32())),
                        ("counts", pa.list_(pa.int32())), ("length", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, LAST_CHUNK):
                rows = batch.slice(at, LAST_CHUNK)
                columns = [rows.column(0).cast(kind)] + [
                    rows.column(k).cast(f.type) for k, f in enumerate(schema) if 0 < k < 4]
                yield pa.RecordBatch.from_arrays(
                    columns + [pa.array(np.sqrt(Chunk(rows, items.value).squares))], schema=schema)
    return run


def _shards(pairs: DataFrame) -> list[DataFrame]:
    """The (item, term) pairs in shards of at most ``PAIRS``, whole items each."""
    sizes = pairs.groupBy("item").agg(F.count("*").alias("n"))
    total, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if total == 0:
        return []
    count = -(-total // PAIRS)
    while count > 1:  # hashing deals unevenly: more shards until the largest one fits
        fullest = sizes.groupBy(F.pmod(F.xxhash64("item"), F.lit(count)).alias("s")).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
        if fullest <= max(PAIRS, largest):
            break
        count *= 2
    return [pairs.where(F.pmod(F.xxhash64("item"), F.lit(count)) == s) for s in range(count)]


def _search_shard(docs: DataFrame, pairs: DataFrame, top: int) -> DataFrame | None:
    from pyspark.sql.pandas.types import to_arrow_type
    spark = docs.sparkSession
    kind = docs.schema["id"].dataType
    arrow, name = to_arrow_type(kind), kind.simpleString()
    table = pairs.toArrow()
    if table.num_rows == 0:
        return None
    coded = table["item"].combine_chunks().dictionary_encode("encode")
    terms, term = np.unique(table["term"].to_numpy().view(np.uint64), return_inverse=True)
    vectors = sizing.written(docs.mapInArrow(
        _vectors(spark.sparkContext.broadcast(terms), arrow),
        f"id {name}, n long, terms array<int>, counts array<int>"), "vectors")
    n_docs, n_words, coordinates = vectors.agg(
        F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0)),
        F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    held = vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    weight = np.zeros(len(terms), np.int64)
    for t, df in zip(held["term"].to_pylist(), held["count"].to_pylist()):
        weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    items = spark.sparkContext.broadcast(Items(
        coded.dictionary, coded.indices.to_numpy(), term, weight, n_docs, n_words))
    sized = vectors.where(F.size("terms") > 0).mapInArrow(
        _lengths(items, arrow), f"id {name}, n long, terms array<int>, counts array<int>, length double")
    buckets = sizing.bucket_count(spark, coordinates, BUCKET_COORDINATES, per_partition=1)
    # A stable draw for equal lengths, so that copies of one text are spread.
    ordered = sized.repartitionByRange(buckets, F.col("length").desc(), F.xxhash64("id", "n")) \
        .sortWithinPartitions(F.col("length").desc())
    out = f"item {pairs.schema['item'].dataType.simpleString()}, id {name}, score long, scored long"
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    least = sized.agg(F.percentile_approx("length", 1 - LONGEST, 1000)).first()[0]
    first = sized.where(F.col("length") >= F.lit(least)).mapInArrow(_search(items, None, top, arrow), out)
    reached = ranked(first).where(F.col("rank") == top).select("item", "score").toArrow()
    number = {i: k for k, i in enumerate(coded.dictionary.to_pylist())}
    floor = np.ones(len(number), np.int64)
    for i, s in zip(reached["item"].to_pylist(), reached["score"].to_pylist()):
        floor[number[i]] = s
    found = ordered.mapInArrow(_search(items, spark.sparkContext.broadcast(floor), top, arrow), out)
    return ranked(found).select("item", "rank", "id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id: str = "doc_id", text: str = "text",
           item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (item, rank, id, score): the ``top`` documents of every item with a score above 0."""
    from functools import reduce

    from pyspark.sql.pandas.types import to_arrow_type
    texts = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    asked = items.select(F.col(item).alias("item"), F.col(item_text).cast("string").alias("text"))
    kind = asked.schema["item"].dataType
    pairs = sizing.written(asked.mapInArrow(
        _item_terms(to_arrow_type(kind)), f"item {kind.simpleString()}, term long").distinct(), "item-terms")
    found = [f for shard in _shards(pairs) if (f := _search_shard(texts, shard, top)) is not None]
    if not found:
        return docs.sparkSession.createDataFrame(
            [], f"item {kind.simpleString()}, rank int, id {texts.schema['id'].dataType.simpleString()}, score long")
    return reduce(DataFrame.unionByName, found)
