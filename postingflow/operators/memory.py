"""Vector memory: memorise, exact top-k cosine retrieval, metadata filters
(V1, V2, V5, V6).  The approximate search (V3) is ``vector_index``.

Exact retrieval compares every query with every memory row, in blocks: both
sides are tables of packed blocks (some hundred unit vectors a row), joined
block by block, so a comparison is one matrix product.  A task carries each
query's best ``k`` from pair to pair and sends at most ``k`` rows a query and
memory block; the final ranking is a window with a partial group limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut_lineage, ship_package

#: Queries of one block, and bytes of a block of the memory.
QUERY_BLOCK, BLOCK_BYTES = 256, 1 << 20
#: Packed queries up to these bytes (measured) are broadcast to the memory's blocks;
#: larger sets meet it in stripes of these bytes, by a shuffle.
STRIPE_BYTES = 32 << 20
#: Best rows that a task holds before it sends them on.
HELD = 1 << 20


def norm(c: Column) -> Column:
    return F.sqrt(F.aggregate(c, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x))


def unit(c: Column) -> Column:
    """Vector divided by its L2 norm (zero vector stays zero)."""
    n = norm(c)
    return F.transform(c, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def centroids(memory: DataFrame, key: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean vector per ``key`` (query_id, vec): one aggregate per component."""
    comp = (memory.select(F.col(key).alias("query_id"), F.posexplode(vec).alias("pos", "v"))
                  .groupBy("query_id", "pos").agg(F.avg(F.col("v").cast("double")).alias("v")))
    return (comp.groupBy("query_id")
                .agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("_c"))
                .select("query_id", F.transform("_c", lambda x: x["v"]).alias("vec")))


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as unit rows (a zero vector stays zero)."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    length = np.linalg.norm(values, axis=1, keepdims=True)
    length[length == 0] = 1.0
    return values / length


def list_of(values: pa.Array) -> pa.Array:
    """One list that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _pack(kind: pa.DataType, rows: int | None):
    schema = pa.schema([("ids", pa.list_(kind)), ("vecs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids, vecs = batch.column(0).cast(kind), matrix(batch.column(1))
            step = rows or max(1, BLOCK_BYTES // max(8, 8 * vecs.shape[1]))
            for at in range(0, len(ids), step):
                yield pa.RecordBatch.from_arrays(
                    [list_of(ids.slice(at, step)), pa.array([vecs[at:at + step].tobytes()], pa.binary())], schema=schema)
    return run


def packed(df: DataFrame, id_col: str, vec_col: str, rows: int | None = None) -> DataFrame:
    """(ids, vecs): blocks of ``rows`` unit vectors (default: ``BLOCK_BYTES``); rows without a vector drop out."""
    ship_package(df.sparkSession)
    read = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where(F.col("vec").isNotNull())
    kind = read.schema["id"].dataType
    return read.mapInArrow(_pack(to_arrow_type(kind), rows), f"ids array<{kind.simpleString()}>, vecs binary")


def block_pairs(queries: DataFrame, memory: DataFrame) -> DataFrame:
    """Every block of ``queries`` with every block of ``memory`` (columns of both).

    A set of checked size is broadcast and the memory stays where it is; a
    larger one is cut into stripes, the memory's blocks go to each stripe, and
    either side is dealt over a salt, so no key holds more than its share.
    """
    size = queries.agg(F.coalesce(F.sum(F.octet_length("q_vecs")), F.lit(0))).first()[0]
    stripes = -(-size // STRIPE_BYTES)
    salts = 1 if stripes <= 1 else int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q = queries.withColumns({"stripe": part("q_vecs", max(1, stripes)), "salt": F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))})
    m = memory.withColumns({"stripe": F.explode(F.sequence(F.lit(0), F.lit(max(1, stripes) - 1))), "salt": part("vecs", salts)})
    return m.join(F.broadcast(q) if stripes <= 1 else q, ["stripe", "salt"]).drop("stripe", "salt")


class Best:
    """The ``k`` best (similarity, id) of each query of a block, ties by the smaller id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.row, self.sim, self.who = np.zeros(0, np.int64), np.zeros(0), None
        self.least = np.full(len(ids), -np.inf)

    def add(self, sims: np.ndarray, who: np.ndarray) -> None:
        """``sims``: queries x rows, -inf where a row is not to be taken."""
        n = sims.shape[1]
        floor = self.least if n <= self.k else np.maximum(self.least, np.partition(sims, n - self.k, axis=1)[:, n - self.k])
        row, col = np.nonzero((sims >= floor[:, None] - 1e-9) & np.isfinite(sims))
        row = np.concatenate((self.row, row))
        sim = np.concatenate((self.sim, np.round(sims[row[len(self.row):], col], 9)))
        who = who[col] if self.who is None else np.concatenate((self.who, who[col]))
        order = np.lexsort((np.unique(who, return_inverse=True)[1], -sim, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = order[place < self.k]
        self.row, self.sim, self.who = row[place < self.k], sim[keep], who[keep]
        full = place == self.k - 1
        self.least[row[full]] = sim[order[full]]


def _best_of_pairs(k: int, exclude_self: bool, query: pa.DataType, mem: pa.DataType):
    schema = pa.schema([("query_id", query), ("mem_id", mem), ("similarity", pa.float64())])

    def sent(best: dict) -> Iterator[pa.RecordBatch]:
        for b in best.values():
            if len(b.row):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.ids[b.row], query), pa.array(b.who, mem), pa.array(b.sim)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, Best] = {}
        for batch in batches:
            for j in range(batch.num_rows):
                row = {name: batch.column(k)[j] for k, name in enumerate(batch.schema.names)}
                ids = row["ids"].values.to_numpy(zero_copy_only=False)
                key = row["q_key"].as_py()
                if key not in best:
                    if sum(len(b.ids) for b in best.values()) * k > HELD:
                        yield from sent(best)
                        best.clear()
                    best[key] = Best(row["q_ids"].values.to_numpy(zero_copy_only=False), k)
                b = best[key]
                q = np.frombuffer(row["q_vecs"].as_py()).reshape(len(b.ids), -1)
                sims = q @ np.frombuffer(row["vecs"].as_py()).reshape(len(ids), -1).T
                if exclude_self:
                    sims[b.ids[:, None] == ids[None, :]] = -np.inf
                b.add(sims, ids)
        yield from sent(best)
    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query, ties by id."""
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("mem_id"))
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
                 .select("query_id", "rank", "mem_id", "similarity"))


def query_blocks(queries: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """(q_key, q_ids, q_vecs) of the queries (query_id, vec), checkpointed."""
    blocks = packed(queries, "query_id", "vec", block)
    return cut_lineage(blocks.select(F.monotonically_increasing_id().alias("q_key"),
                                     F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs")))


def top_k(queries: DataFrame, memory: DataFrame, k: int, id_col: str = "mem_id", vec_col: str = "embedding",
          exclude_self: bool = False, block: int = QUERY_BLOCK) -> DataFrame:
    """V2: for each query the ``k`` most cosine-similar memory rows, best
    first, ties broken by id.  Returns (query_id, rank, mem_id, similarity).

    Rows and queries without a vector are in no result; all vectors have one
    dimension; a zero vector is similar to nothing (0).
    """
    query, mem = queries.schema["query_id"].dataType, memory.schema[id_col].dataType
    pairs = block_pairs(query_blocks(queries, block), packed(memory, id_col, vec_col))
    found = pairs.select("q_key", "q_ids", "q_vecs", "ids", "vecs").mapInArrow(
        _best_of_pairs(k, exclude_self, to_arrow_type(query), to_arrow_type(mem)),
        f"query_id {query.simpleString()}, mem_id {mem.simpleString()}, similarity double")
    return ranked(found, k)


def similar_past(new: DataFrame, past: DataFrame, k: int = 3, **kw) -> DataFrame:
    """V5: the ``k`` most similar past rows for each new one (V2, k = 3)."""
    return top_k(new, past, k, **kw)


def memory_where(memory: DataFrame, key: str, value: str) -> DataFrame:
    """V6: keep rows whose metadata[key] equals value (before retrieval)."""
    return memory.filter(F.col("metadata")[key] == value)


def memorize(df: DataFrame, path: str | None = None) -> DataFrame:
    """V1: (content, metadata, embedding) rows, null metadata -> empty map;
    appended to ``path`` when given."""
    out = df.select(
        F.col("content").cast("string"),
        F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>")).alias("metadata"),
        F.col("embedding").cast("array<float>"))
    if path:
        out.write.mode("append").parquet(path)
    return out


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact neighbours the approximate search found, per query."""
    hit = exact.join(approx.select("query_id", "mem_id", F.lit(1).alias("_h")), ["query_id", "mem_id"], "left")
    return hit.groupBy("query_id").agg((F.count("_h") / F.count(F.lit(1))).alias("recall"))
