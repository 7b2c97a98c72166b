"""Keyed dedup and existence operators.

First-wins per key is a hash aggregate with ``min_by`` over the feed order:
partial aggregation runs before the shuffle, so a key holding a third of
all rows (e.g. every key-less record collapsing to "") sends one row per
map partition, never the whole group to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import ts_lit


def dedup_first(df: DataFrame, key: str = "reference_id", order=("page", "pos")) -> DataFrame:
    """Keep the earliest record per key in feed order."""
    rest = [c for c in df.columns if c != key]
    return (df.groupBy(key)
              .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
              .select(key, *[F.col(f"_r.{c}").alias(c) for c in rest]))


def only_new(incoming: DataFrame, stored: DataFrame, key: str = "reference_id") -> DataFrame:
    """Incoming rows whose key is not stored yet (left anti join).

    Stored keys are projected to the key column only so the scan reads one
    column; AQE turns the join into a broadcast when the stored key set is
    small at runtime, otherwise it is a shuffle anti join.
    """
    return incoming.join(stored.select(key).distinct(), key, "left_anti")


def scan_new(incoming: DataFrame, stored: DataFrame, limit: int, key: str = "reference_id",
             order=("page", "pos")) -> DataFrame:
    """D1, then J1, then the first ``limit`` in feed order.

    The limit is the feature (scan batch size).  orderBy+limit plans as
    TakeOrderedAndProject: per-partition top-n, so the final step moves
    ``limit`` x partitions rows.
    """
    fresh = only_new(dedup_first(incoming, key, order), stored, key)
    return fresh.orderBy(*order, key).limit(limit)


def import_postings(incoming: DataFrame, stored: DataFrame, seq: str = "seq") -> DataFrame:
    """Exact (title, company) match -> outcome "exists" with the earliest
    stored id; otherwise the first incoming record of that pair is
    "imported" under a new deterministic id and later duplicates in the same
    batch report "exists" with that new id.  A missing title or company takes
    its default before the comparison.  ``imported_postings`` gives the rows.
    """
    incoming = incoming.withColumn("title", F.coalesce("title", F.lit(S.IMPORT_DEFAULTS["title"]))) \
                       .withColumn("company", F.coalesce("company", F.lit(S.IMPORT_DEFAULTS["company"])))
    existing = (stored.groupBy("title", "company")
                      .agg(F.min_by(F.col("id").cast("string"), F.struct("created_at", "id")).alias("stored_id")))
    firsts = (incoming.groupBy("title", "company")
                      .agg(F.min(seq).alias("_first_seq")))
    new_id = F.concat(F.lit("EXT-"), F.substring(
        F.sha2(F.concat_ws("\u001f", F.col("title"), F.col("company")), 256), 1, 32))
    j = (incoming.join(existing, ["title", "company"], "left")
                 .join(firsts, ["title", "company"], "left"))
    return j.select(
        F.col(seq), "title", "company",
        F.when(F.col("stored_id").isNotNull(), F.lit("exists"))
         .when(F.col(seq) == F.col("_first_seq"), F.lit("imported"))
         .otherwise(F.lit("exists")).alias("outcome"),
        F.coalesce(F.col("stored_id"), new_id).alias("id"),
    )


def imported_postings(incoming: DataFrame, stored: DataFrame, now: str, seq: str = "seq") -> DataFrame:
    """The new posting rows of an import (status FETCHED, reference = id;
    a missing description becomes empty)."""
    new = import_postings(incoming, stored, seq).filter(F.col("outcome") == "imported")
    text = incoming.select(F.col(seq), "description") if "description" in incoming.columns \
        else incoming.select(F.col(seq), F.lit(None).cast("string").alias("description"))
    rows = new.join(text, seq)
    cols = dict(id=F.col("id"), reference_id=F.col("id"), title=F.col("title"), company=F.col("company"),
                description=F.coalesce("description", F.lit(S.IMPORT_DEFAULTS["description"])),
                status=F.lit("FETCHED"), processing_status=F.lit("IDLE"), created_at=ts_lit(now))
    return rows.select(*(cols.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.POSTING.fields))


def ref_bucket(key: Column, buckets: int) -> Column:
    """Hash bucket of a reference key, the partition column of stored tables."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
