"""Queue claiming, paging and failure-rate windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from .ordering import running_before

QUEUE_ORDER = ("created_at", "id")


def queue_candidates(postings: DataFrame) -> DataFrame:
    return postings.filter((F.coalesce(F.col("status"), F.lit("FETCHED")) == "FETCHED")
                           & (F.col("processing_status") == "QUEUED"))


#: Claimed ids that are broadcast.
SENT_CLAIMS = 100_000


def claim(postings: DataFrame, n: int = 1) -> tuple[DataFrame, DataFrame]:
    """T1 + A7 pickup: the ``n`` oldest FETCHED+QUEUED postings become
    PROCESSING.  Returns (claimed rows, postings').

    orderBy+limit plans as TakeOrderedAndProject (per-partition top-n, then
    a merge of n x partitions rows); up to ``SENT_CLAIMS`` claimed keys
    are then broadcast, more are joined as Spark decides.
    """
    claimed = (queue_candidates(postings).orderBy(*QUEUE_ORDER).limit(n)
               .withColumn("processing_status", F.lit("PROCESSING")))
    ids = claimed.select(F.col("id").alias("_cid"), F.lit(True).alias("_claimed"))
    if n <= SENT_CLAIMS:
        ids = F.broadcast(ids)
    updated = (postings.join(ids, F.col("id") == F.col("_cid"), "left")
               .withColumn("processing_status",
                           F.when(F.col("_claimed"), F.lit("PROCESSING")).otherwise(F.col("processing_status")))
               .drop("_cid", "_claimed"))
    return claimed, updated


def release(postings: DataFrame, ids: DataFrame) -> DataFrame:
    """A7 release: after scoring, rows of ``ids`` still PROCESSING go IDLE."""
    rel = ids.select(F.col("id").alias("_rid")).distinct().withColumn("_rel", F.lit(True))
    return (postings.join(rel, F.col("id") == F.col("_rid"), "left")
            .withColumn("processing_status",
                        F.when(F.col("_rel") & (F.col("processing_status") == "PROCESSING"), F.lit("IDLE"))
                        .otherwise(F.col("processing_status")))
            .drop("_rid", "_rel"))


def assign(postings: DataFrame, n: int, workers: int) -> DataFrame:
    """The ``n`` oldest claimable postings split over ``workers`` with no
    overlap, oldest first: worker = (rank - 1) % workers.  The window runs
    over the already-limited ``n`` rows only."""
    top = queue_candidates(postings).orderBy(*QUEUE_ORDER).limit(n)
    w = Window.orderBy(*QUEUE_ORDER)
    return (top.withColumn("claim_rank", F.row_number().over(w).cast("int"))
               .withColumn("worker", F.pmod(F.col("claim_rank") - 1, F.lit(workers)).cast("int")))


def page(df: DataFrame, page_no: int, size: int, order=QUEUE_ORDER) -> DataFrame:
    """Rows of page ``page_no`` (0-based) of ``size`` in a total order.

    Offset paging keeps (page_no + 1) x size rows per partition before the
    final merge; that is fine for the first pages.  Deep pages of a large
    table should use ``page_after`` (keyset paging), whose cost does not
    grow with the page number.
    """
    return df.orderBy(*order).offset(page_no * size).limit(size)


def _key_lit(v):
    """Literal for a key value; datetimes become zone-less timestamps so the
    comparison does not depend on the session or process time zone."""
    import datetime as _dt
    if isinstance(v, _dt.datetime):
        return F.expr(f"TIMESTAMP_NTZ '{v.isoformat(sep=' ')}'")
    return F.lit(v)


def page_after(df: DataFrame, after: tuple | None, size: int, order=QUEUE_ORDER) -> DataFrame:
    """T3, keyset form: the ``size`` rows that follow the row whose order key
    is ``after`` (None for the first page).  A pushed-down filter plus a
    top-``size``; pass the last row's key of a page to get the next one."""
    if after is not None:
        cond = None
        for i in range(len(order)):
            term = F.col(order[i]) > _key_lit(after[i])
            for j in range(i):
                term = term & (F.col(order[j]) == _key_lit(after[j]))
            cond = term if cond is None else cond | term
        df = df.filter(cond)
    return df.orderBy(*order).limit(size)


# ------------------------------------------------------------------ W4

#: Calls that one window task handles in order, and the width of the time
#: slices that number a service's calls.
BLOCK_CALLS = 10_000
SLICE = "hour"


def breaker_windows(calls: DataFrame, n: int = S.BREAKER_WINDOW, rate: float = S.BREAKER_FAILURE_RATE,
                    slow_s: float = S.BREAKER_SLOW_SECONDS, slow_rate: float = S.BREAKER_SLOW_RATE,
                    block: int = BLOCK_CALLS) -> DataFrame:
    """Per call, over the last ``n`` calls of its service (count-based
    sliding window): OPEN when the window is full and the failure rate or
    the slow-call rate reaches its threshold.

    A plain ``Window.partitionBy(service)`` would sort a hot service in one
    task.  Here every call gets its number within its service in two levels
    (calls per time slice, then the number inside the slice), calls are cut
    into blocks of ``block`` numbers, and the last ``n - 1`` calls of a block
    also go to the next one as context.  The window itself is the built-in
    row frame over (service, block); context rows are dropped afterwards.
    """
    base = calls.select("service", "ts", "call_id", "failed", "duration_s")
    numbered = running_before(base, "service", F.date_trunc(SLICE, "ts"), ["ts", "call_id"], name="_i")
    size = max(block, n)
    own = F.floor(F.col("_i") / size)
    spread_over = F.when(F.col("_i") % size >= size - (n - 1), F.array(own, own + 1)).otherwise(F.array(own))
    rows = numbered.withColumn("_own", own).withColumn("_block", F.explode(spread_over))
    w = Window.partitionBy("service", "_block").orderBy("_i").rowsBetween(-(n - 1), 0)
    return _states(rows, w, n, rate, slow_s, slow_rate, keep=("_own", "_block")) \
        .filter(F.col("_own") == F.col("_block")).drop("_own", "_block")


def _states(rows: DataFrame, w, n: int, rate: float, slow_s: float, slow_rate: float, keep=()) -> DataFrame:
    s = rows.select(
        "service", "ts", "call_id", "failed", "duration_s", *keep,
        F.count(F.lit(1)).over(w).alias("window_calls"),
        F.sum(F.col("failed").cast("long")).over(w).alias("failures"),
        F.sum((F.col("duration_s") > slow_s).cast("long")).over(w).alias("slow_calls"))
    open_ = (F.col("window_calls") == n) & (
        (F.col("failures") * 100.0 >= F.lit(rate) * F.col("window_calls"))
        | (F.col("slow_calls") * 100.0 >= F.lit(slow_rate) * F.col("window_calls")))
    return s.withColumn("state", F.when(open_, F.lit("OPEN")).otherwise(F.lit("CLOSED")))


def breaker_windows_simple(calls: DataFrame, n: int = S.BREAKER_WINDOW, rate: float = S.BREAKER_FAILURE_RATE,
                           slow_s: float = S.BREAKER_SLOW_SECONDS, slow_rate: float = S.BREAKER_SLOW_RATE) -> DataFrame:
    """W4 with a built-in row frame (exact; one task per service).  Kept as
    the test oracle of ``breaker_windows``."""
    w = Window.partitionBy("service").orderBy("ts", "call_id").rowsBetween(-(n - 1), 0)
    return _states(calls, w, n, rate, slow_s, slow_rate)
