"""State of a stream as few written runs, so that a batch reads what is open and
not what past batches did.

A run is a folder ``run=<number>`` of rows; the ledger ``epoch=<id>`` of a batch
lists the runs that still matter after it, each with the place up to which it is
used up.  A batch reads the ledger of the batch before it and the
folders named there.  Rows that come with batch ``e`` make run ``2 e``; once
more than ``MAX_RUNS`` runs are open, what is left of them is written as one run
``2 e + 1``.  A batch that is replayed starts from the same ledger and overwrites
its own folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import tables as TB

MAX_RUNS = 32
#: A run with the last key used up and the last key it holds (as text; ``at`` has no row: nothing used).
LEDGER = "run long, used boolean, at array<string>, last array<string>"


def write_run(rows: DataFrame, path: str, run: int, order: tuple[str, ...] = ()) -> None:
    """Write one run, sorted by ``order`` so that a read from a place on skips files and row groups."""
    if order:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.mode("overwrite").parquet(f"{path}/run={run}")


def read_runs(spark: SparkSession, path: str, runs: list[int], schema: T.StructType) -> DataFrame:
    """The rows of some runs with their ``run``; other folders are not listed."""
    full = T.StructType(schema.fields + [T.StructField("run", T.LongType())])
    if not runs:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", path).parquet(*(f"{path}/run={r}" for r in runs))


def read_ledger(spark: SparkSession, path: str, epoch_id: int) -> list:
    """The runs open after a batch (none before the first), at most ``MAX_RUNS`` + 1 rows."""
    kept = TB.try_read(spark, f"{path}/epoch={epoch_id}")
    return [] if kept is None else kept.filter("run >= 0").select("run", "used", "at", "last").orderBy("run").collect()


def write_ledger(spark: SparkSession, path: str, epoch_id: int, rows: list[tuple]) -> None:
    """Write a batch's ledger; run -1 stands for the batch itself, so that one without open runs is seen."""
    spark.createDataFrame([*rows, (-1, False, None, None)], LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={epoch_id}")


def last_epoch(spark: SparkSession, path: str) -> int:
    """The last batch with a ledger, -1 before the first."""
    kept = TB.try_read(spark, path)
    return -1 if kept is None else int(kept.agg(F.coalesce(F.max("epoch"), F.lit(-1))).first()[0])


def last_key(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(run, last) of each run that holds rows; nulls come first, as in the order."""
    top = rows.groupBy("run").agg(F.max(F.struct(*order)).alias("top"))
    return top.select("run", F.array(*(F.col(f"top.{c}").cast("string") for c in order)).alias("last"))


def after(row, rows: DataFrame, order: tuple[str, ...]) -> Column:
    """Whether a row of a run comes after the run's place (nulls first; null where it
    does not, for a row without a key)."""
    here = F.col("run") == row["run"]
    if not row["used"]:
        return here
    later, same = F.lit(False), F.lit(True)
    for name, text in zip(order, row["at"]):
        col = F.col(name)
        if text is None:
            later, same = later | (same & col.isNotNull()), same & col.isNull()
        else:
            value = F.lit(text).cast(rows.schema[name].dataType)
            later, same = later | (same & (col > value)), same & (col == value)
    return here & later


def open_rows(rows: DataFrame, ledger: list, order: tuple[str, ...]) -> DataFrame:
    """The rows of the open runs that are not used up yet: literal conditions, so that
    they reach the scan.  ``ledger`` may hold rows or (run, used, at, last) dicts."""
    keep = F.lit(False)
    for row in ledger:
        keep = keep | after(row, rows, order)
    return rows.filter(keep)
