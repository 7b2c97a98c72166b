"""Sizes that follow the data, and the shared folder for written tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts (one aggregate over the text column)."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]


def bucket_count(spark: SparkSession, total: int, each: int, per_partition: int = 2) -> int:
    """Hash buckets of at most about ``each`` bytes, several for every shuffle partition."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(per_partition * parts, -(-total // each))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage with a table every executor can reach; a lost executor
    costs no recomputation of what is already written.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
