"""Approximate top-k cosine retrieval over an inverted file with product
quantised residuals (V3).

*Training* takes a bounded sample (``SAMPLE`` rows, by a hash of the id): list
centroids by k-means on unit vectors, and one codebook for each ``PART``
dimensions of the residuals (vector minus its centroid).

*Index*: a table of packed blocks, one list a row: ids, codes, the length of
what the codes leave out of each vector, and the greatest residual.  It holds every
row of the memory at ``dim / PART`` bytes a vector.

*Search*, in three steps, each a join of packed blocks by list:

1. The nearest lists of a query give a floor: the ``k``-th best similarity to
   the coded vectors, less each one's margin.
2. A list is probed if its centroid's similarity plus its greatest residual
   reaches the floor (Cauchy-Schwarz), so the number of probes is each query's
   own.  In it, a row is a candidate if its coded similarity plus its margin does.
3. Candidates are scored with their whole vectors and ranked.

The margin is ``Z`` standard deviations of the coding error in the query's
direction (length left out by root of the dimension); a neighbour is missed
only if the error is larger.  Nothing is searched exactly beside that; the
shares of lists probed and of rows scored come with the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut_lineage, ship_package
from .memory import QUERY_BLOCK, Best, list_of, matrix, ranked, unit

#: Rows of the training sample, rows of it for each list, and rounds of k-means.
SAMPLE, LIST_ROWS, ROUNDS = 16_384, 48, 12
MOST_LISTS = 1_024
#: Dimensions of one code byte, and its values.
PART, VALUES = 2, 256
#: Rows whose distances to all centroids or code values are held at a time.
STEP = 1_024
#: Standard deviations of the coding error that a candidate is allowed.
Z = 4.0
#: Share of the lists that give the floor.
NEAR = 0.3


def _closest(means: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The number of the mean next to each row."""
    size, out = (means ** 2).sum(1), np.empty(len(x), np.int64)
    for at in range(0, len(x), STEP):
        out[at:at + STEP] = np.argmin(size - 2 * x[at:at + STEP] @ means.T, axis=1)
    return out


@dataclass(frozen=True)
class Model:
    """Centroids (lists x dim) and codebooks (parts x values x PART)."""
    lists: np.ndarray
    books: np.ndarray

    def padded(self, x: np.ndarray) -> np.ndarray:
        """Rows cut into parts: rows x parts x PART."""
        return np.pad(x, ((0, 0), (0, -x.shape[1] % PART))).reshape(len(x), -1, PART)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return _closest(self.lists, x)

    def codes(self, residuals: np.ndarray) -> np.ndarray:
        parts = self.padded(residuals)
        out = np.empty(parts.shape[:2], np.uint8)
        for j, book in enumerate(self.books):
            out[:, j] = _closest(book, parts[:, j])
        return out

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        parts = self.books[np.arange(codes.shape[1])[None, :], codes]
        return parts.reshape(len(codes), -1)[:, :self.lists.shape[1]]


def _means(x: np.ndarray, count: int, rng: np.random.Generator) -> np.ndarray:
    """k-means; an empty cluster is seeded anew with a row."""
    means = x[rng.choice(len(x), count, replace=len(x) < count)].copy()
    for _ in range(ROUNDS):
        own = np.argmin((means ** 2).sum(1) - 2 * x @ means.T, axis=1)
        size = np.bincount(own, minlength=count)
        total = np.zeros_like(means)
        np.add.at(total, own, x)
        means = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[rng.integers(len(x), size=count)])
    return means


def train(memory: DataFrame, id_col: str = "mem_id", vec_col: str = "embedding", seed: int = 7) -> Model | None:
    """The model of a memory from its sample; None for an empty memory."""
    sample = (memory.where(F.col(vec_col).isNotNull()).select(F.col(vec_col).alias("vec"), F.xxhash64(id_col).alias("h"))
              .orderBy("h", "vec").limit(SAMPLE).select("vec").toArrow()["vec"].combine_chunks())
    if len(sample) == 0:
        return None
    rng = np.random.default_rng(seed)
    x = matrix(sample)
    shell = Model(_means(x, max(1, min(MOST_LISTS, len(x) // LIST_ROWS)), rng), np.zeros((0, 0, PART)))
    parts = shell.padded(x - shell.lists[shell.nearest(x)])
    values = max(1, min(VALUES, len(x) // 2))
    return Model(shell.lists, np.stack([_means(parts[:, j], values, rng) for j in range(parts.shape[1])]))


def _code(sent, kind: pa.DataType):
    schema = pa.schema([("list", pa.int32()), ("ids", pa.list_(kind)), ("codes", pa.binary()),
                        ("rests", pa.binary()), ("radius", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids, x = batch.column(0).cast(kind), matrix(batch.column(1))
            own = model.nearest(x)
            residual = x - model.lists[own]
            codes = model.codes(residual)
            rest = np.linalg.norm(residual - model.decoded(codes), axis=1).astype(np.float32)
            radius = np.linalg.norm(residual, axis=1)
            order = np.argsort(own, kind="stable")
            cuts = np.flatnonzero(np.concatenate(([True], np.diff(own[order]) > 0)))
            for rows in np.split(order, cuts[1:]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own[rows[0]]], pa.int32()), list_of(ids.take(pa.array(rows))),
                     pa.array([codes[rows].tobytes()], pa.binary()), pa.array([rest[rows].tobytes()], pa.binary()),
                     pa.array([radius[rows].max()])], schema=schema)
    return run


def build(memory: DataFrame, model: Model, id_col: str = "mem_id", vec_col: str = "embedding",
          path: str | None = None) -> DataFrame:
    """The index of all rows: (list, ids, codes, rests, radius) blocks, written to
    ``path`` if given, else checkpointed."""
    spark = memory.sparkSession
    ship_package(spark)
    read = memory.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where(F.col("vec").isNotNull())
    kind = read.schema["id"].dataType
    index = read.mapInArrow(_code(spark.sparkContext.broadcast(model), to_arrow_type(kind)),
                            f"list int, ids array<{kind.simpleString()}>, codes binary, rests binary, radius double")
    if path is None:
        return cut_lineage(index)
    index.write.parquet(path)
    return spark.read.schema(index.schema).parquet(path)


def _probes(sent, radius, near: int, kind: pa.DataType):
    """(list, query_id, vec, floor): the nearest lists, or with floors all that may reach them."""
    schema = pa.schema([("list", pa.int32()), ("query_id", kind), ("vec", pa.binary()), ("floor", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                rows = batch.slice(at, QUERY_BLOCK)
                q = matrix(rows.column(1))
                sims = q @ model.lists.T
                floor = rows.column(2).to_numpy(zero_copy_only=False)
                if radius is None:
                    q_at, lists = np.nonzero(sims >= np.sort(sims, axis=1)[:, -near][:, None])
                else:
                    reach = sims + np.linalg.norm(q, axis=1)[:, None] * radius.value[None, :]
                    q_at, lists = np.nonzero(reach >= floor[:, None] - 1e-9)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists, pa.int32()), rows.column(0).cast(kind).take(pa.array(q_at)),
                     pa.array([q[k].tobytes() for k in q_at], pa.binary()), pa.array(floor[q_at], pa.float64())], schema=schema)
    return run


def _scan(sent, k: int, floors: bool, query: pa.DataType, mem: pa.DataType):
    """Coded similarities of list blocks: the best lower ends, or the candidates of the floors."""
    low = pa.schema([("query_id", query), ("mem_id", mem), ("similarity", pa.float64())])
    schema = pa.schema([("query_id", query), ("mem_id", mem)]) if floors else low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        for batch in batches:
            for j in range(batch.num_rows):
                row = {name: batch.column(c)[j] for c, name in enumerate(batch.schema.names)}
                ids = row["ids"].values
                codes = np.frombuffer(row["codes"].as_py(), np.uint8).reshape(len(ids), -1)
                x = model.lists[row["list"].as_py()] + model.decoded(codes)
                asked = row["asked"].values
                q = np.frombuffer(b"".join(asked.field("vec").to_pylist())).reshape(len(asked), -1)
                sims = q @ x.T
                rest = np.frombuffer(row["rests"].as_py(), np.float32).astype(np.float64)
                margin = np.linalg.norm(q, axis=1)[:, None] * (Z / np.sqrt(x.shape[1]) * rest)[None, :]
                qids = asked.field("query_id")
                if floors:
                    floor = asked.field("floor").to_numpy(zero_copy_only=False)
                    a, b = np.nonzero(sims + margin >= floor[:, None] - 1e-9)
                    yield pa.RecordBatch.from_arrays(
                        [qids.cast(query).take(pa.array(a)), ids.cast(mem).take(pa.array(b))], schema=schema)
                else:
                    best = Best(np.arange(len(qids)), k)
                    best.add(sims - margin, ids.to_numpy(zero_copy_only=False))
                    yield pa.RecordBatch.from_arrays(
                        [qids.cast(query).take(pa.array(best.row)), pa.array(best.who, mem), pa.array(best.sim)], schema=schema)
    return run


def search(queries: DataFrame, memory: DataFrame, index: DataFrame, model: Model, k: int,
           id_col: str = "mem_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, mem_id, similarity, share_probed, share_scored): the shares of the
    index's lists that the query probed and of the memory's rows that it scored whole."""
    spark = queries.sparkSession
    query, mem = queries.schema["query_id"].dataType, memory.schema[id_col].dataType
    q_name, m_name = query.simpleString(), mem.simpleString()
    sent = spark.sparkContext.broadcast(model)
    lists = len(model.lists)
    known = index.groupBy("list").agg(F.max("radius").alias("r"), F.sum(F.size("ids")).alias("n")).collect()  # a row a list
    rows = sum(r["n"] for r in known)
    radius = np.full(lists, -np.inf)
    for r in known:
        radius[r["list"]] = r["r"]
    asked = cut_lineage(queries.select("query_id", F.col("vec")).where(F.col("vec").isNotNull()))

    def scanned(ask: DataFrame, reach, floors: bool) -> DataFrame:
        probes = ask.select("query_id", "vec", "floor").mapInArrow(
            _probes(sent, reach, max(1, int(np.ceil(NEAR * lists))), to_arrow_type(query)),
            f"list int, query_id {q_name}, vec binary, floor double")
        if floors:
            probes = cut_lineage(probes)
        # The queries of a list in packs of about QUERY_BLOCK; a pack meets the list's blocks.
        packs = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n_queries // QUERY_BLOCK))))
        packed = probes.groupBy("list", packs.alias("pack")).agg(F.collect_list(F.struct("query_id", "vec", "floor")).alias("asked"))
        out = f"query_id {q_name}, mem_id {m_name}" + ("" if floors else ", similarity double")
        found = index.join(packed, "list").select("list", "ids", "codes", "rests", "asked").mapInArrow(
            _scan(sent, k, floors, to_arrow_type(query), to_arrow_type(mem)), out)
        return (found, probes) if floors else found

    n_queries = asked.count()
    low = ranked(scanned(asked.withColumn("floor", F.lit(0.0)), None, False), k).filter(F.col("rank") == k)
    floor = asked.join(low.select("query_id", F.col("similarity").alias("floor")), "query_id", "left") \
        .withColumn("floor", F.coalesce("floor", F.lit(-np.inf)))
    candidates, probes = scanned(cut_lineage(floor), spark.sparkContext.broadcast(radius), True)
    candidates = cut_lineage(candidates)
    probed = probes.groupBy("query_id").agg((F.count(F.lit(1)) / F.lit(lists)).alias("share_probed"))
    scored = candidates.groupBy("query_id").agg((F.count(F.lit(1)) / F.lit(max(1, rows))).alias("share_scored"))
    whole = (candidates.join(memory.select(F.col(id_col).alias("mem_id"), F.col(vec_col).alias("_m")), "mem_id")
             .join(asked.withColumnRenamed("vec", "_q"), "query_id"))
    sim = F.aggregate(F.zip_with(unit(F.col("_m")), unit(F.col("_q")), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    best = ranked(whole.select("query_id", "mem_id", F.round(sim, 9).alias("similarity")), k)
    return best.join(probed, "query_id").join(scored, "query_id") \
        .select("query_id", "rank", "mem_id", "similarity", "share_probed", "share_scored")


def top_k_approx(queries: DataFrame, memory: DataFrame, k: int, id_col: str = "mem_id", vec_col: str = "embedding",
                 seed: int = 7) -> DataFrame:
    """V3 in one call: train, index and search."""
    model = train(memory, id_col, vec_col, seed)
    if model is None:
        return memory.sparkSession.createDataFrame(
            [], f"query_id {queries.schema['query_id'].dataType.simpleString()}, rank int, mem_id "
                f"{memory.schema[id_col].dataType.simpleString()}, similarity double, share_probed double, share_scored double")
    return search(queries, memory, build(memory, model, id_col, vec_col), model, k, id_col, vec_col)
