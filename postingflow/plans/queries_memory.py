"""Registered vector-memory queries (V2, V3, V5, V6).

Queries are the per-label centroids of the memory: a derived, bounded query
set (one per label) whose work grows with the memory it is scored against.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import memory as M
from ..operators import vector_index as VI
from . import bindings as B
from .catalog import register, with_ctes

TOPK_SQL = with_ctes("memory") + """,
mem AS (SELECT mem_id, CAST(label AS VARCHAR) AS label, embedding AS e FROM memory),
comp AS (SELECT label AS query_id, i, avg(e[i]) AS v
         FROM mem, range(1, 1 + (SELECT max(len(e)) FROM mem)) t(i) GROUP BY 1, 2),
cent AS (SELECT query_id, list(v ORDER BY i) AS c FROM comp GROUP BY 1),
s AS (SELECT query_id, mem_id, list_cosine_similarity(c, e) AS sim FROM cent, {src}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, mem_id) AS rank FROM s)
SELECT query_id, rank, mem_id, round(sim, 4) AS similarity FROM r WHERE rank <= {k}"""


def _run(spark, sf, k, where=None):
    mem = B.memory(spark, sf)
    q = M.centroids(mem.withColumn("label", F.col("label").cast("string")))
    if where:
        mem = M.memory_where(mem, *where)
    r = M.top_k(q, mem, k)
    return r.select("query_id", F.col("rank").cast("long").alias("rank"), "mem_id",
                    F.round("similarity", 4).alias("similarity"))


@register("top_k", TOPK_SQL.format(src="mem", k=5))
def q_top_k(spark, sf):
    return _run(spark, sf, 5)


@register("similar_past", with_ctes("memory") + """,
s AS (SELECT q.mem_id AS query_id, m.mem_id, list_cosine_similarity(q.embedding, m.embedding) AS sim
      FROM memory q JOIN memory m ON q.mem_id % 100 = 0 AND m.mem_id <> q.mem_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, mem_id) AS rank FROM s)
SELECT query_id, rank, mem_id, round(sim, 4) AS similarity FROM r WHERE rank <= 3""")
def q_similar_past(spark, sf):
    # the new rows are those whose id is divisible by 100, against all others
    mem = B.memory(spark, sf)
    new = mem.filter(F.col("mem_id") % 100 == 0).select(F.col("mem_id").alias("query_id"), F.col("embedding").alias("vec"))
    r = M.similar_past(new, mem, 3, exclude_self=True)
    return r.select("query_id", F.col("rank").cast("long").alias("rank"), "mem_id", F.round("similarity", 4).alias("similarity"))


@register("memory_where", TOPK_SQL.format(src="(SELECT * FROM mem WHERE label = '3') m3", k=5))
def q_memory_where(spark, sf):
    return _run(spark, sf, 5, where=("label", "3"))


def _centroid_queries(spark, sf):
    mem = B.memory(spark, sf)
    return M.centroids(mem.withColumn("label", F.col("label").cast("string"))), mem


def _row_queries(spark, sf):
    """The rows whose id is divisible by 100."""
    mem = B.memory(spark, sf)
    return mem.filter(F.col("mem_id") % 100 == 0).select(
        F.col("mem_id").cast("string").alias("query_id"), F.col("embedding").alias("vec")), mem


@register("top_k_approx")
def q_top_k_approx(spark, sf):
    q, mem = _centroid_queries(spark, sf)
    return VI.top_k_approx(q, mem, 5)


@register("row_top_k_approx")
def q_row_top_k_approx(spark, sf):
    q, mem = _row_queries(spark, sf)
    return VI.top_k_approx(q, mem, 5)


#: Recall that the approximate search must reach for every query, and the share of the memory it may score whole.
RECALL_FLOOR, SCORED_MOST = 0.9, 0.2


def _recall(spark, sf, kinds=("label", "row")):
    """The registered searches against the exact one: recall and shares of each query."""
    out = None
    for name in kinds:
        q, mem = {"label": _centroid_queries, "row": _row_queries}[name](spark, sf)
        found = VI.top_k_approx(q, mem, 5)
        shares = found.groupBy("query_id").agg(F.max("share_probed").alias("share_probed"), F.max("share_scored").alias("share_scored"))
        part = M.recall_at_k(found, M.top_k(q, mem, 5)).join(shares, "query_id", "left") \
            .withColumn("query_id", F.concat(F.lit(f"{name} "), "query_id"))
        out = part if out is None else out.unionByName(part)
    return out


@register("vector_recall", """
SELECT DISTINCT 'label ' || CAST(label AS VARCHAR) AS query_id, true AS recall_reached, true AS share_kept FROM embeddings
UNION ALL SELECT 'row ' || CAST(vec_id AS VARCHAR), true, true FROM embeddings WHERE vec_id % 100 = 0""")
def q_vector_recall(spark, sf):
    return _recall(spark, sf).select("query_id", (F.col("recall") >= RECALL_FLOOR).alias("recall_reached"),
                                     (F.col("share_scored") < SCORED_MOST).alias("share_kept"))


@register("vector_recall_values")
def q_vector_recall_values(spark, sf):
    # the figures behind vector_recall; the recall itself has no SQL form
    return _recall(spark, sf)


def _label_recall(spark, sf):
    return _recall(spark, sf, ("label",)).withColumn("query_id", F.substring_index("query_id", " ", -1)) \
        .withColumn("recall_reached", F.col("recall") >= RECALL_FLOOR)


@register("lsh_recall", """
SELECT DISTINCT CAST(label AS VARCHAR) AS query_id, true AS recall_reached FROM embeddings""")
def q_lsh_recall(spark, sf):
    return _label_recall(spark, sf).select("query_id", "recall_reached")


@register("lsh_recall_values")
def q_lsh_recall_values(spark, sf):
    # the figures behind lsh_recall; the recall itself has no SQL form
    return _label_recall(spark, sf)


@register("memorize", with_ctes("memory") + """
SELECT content, CASE WHEN label % 2 = 0 THEN CAST(label AS VARCHAR) END AS meta_label,
       CAST(CASE WHEN label % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_metadata, CAST(len(embedding) AS INTEGER) AS dim
FROM memory""")
def q_memorize(spark, sf):
    mem = B.memory(spark, sf).withColumn("metadata", F.when(F.col("label") % 2 == 0, F.col("metadata")))
    return M.memorize(mem).select("content", F.col("metadata")["label"].alias("meta_label"),
                                  F.size("metadata").alias("n_metadata"), F.size("embedding").alias("dim"))
