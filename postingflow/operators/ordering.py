"""Running sums over an order within a key, without sorting a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_before(df: DataFrame, key: str, slice_: Column, order: list, value: Column | None = None,
                   name: str = "before") -> DataFrame:
    """Add ``name``: the sum of ``value`` (default 1) over the rows of the same
    key that come before a row in (slice, order).

    Two levels: sums per (key, slice), a running sum over the slices of a key,
    and a window inside one slice.  ``slice_`` must not decrease with
    ``order``; a key holding a third of all rows is cut at its slices.
    """
    v = F.lit(1) if value is None else value
    rows = df.withColumn("_slice", slice_).withColumn("_v", v.cast("long"))
    before = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy(F.col(key).alias("_key"), F.col("_slice").alias("_at")).agg(F.sum("_v").alias("_n"))
               .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    inside = Window.partitionBy(key, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return (rows.join(offsets, F.col(key).eqNullSafe(F.col("_key")) & F.col("_slice").eqNullSafe(F.col("_at")))
            .withColumn(name, F.col("_offset") + F.col("_inside"))
            .drop("_slice", "_v", "_key", "_at", "_offset", "_inside"))
