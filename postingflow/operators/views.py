"""Board, statistics and list views over the posting table (B1-B7, W1, F1-F8,
P12, P13, J3, J4).

All views are single declarative plans: one aggregate (partial + final, so
only one row per partition crosses the shuffle) or a map-side join against
a bounded dimension.  Null status counts as FETCHED everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import java_datetime, preview, ts_lit
from .normalize import portal_url_read


def status_of(df: DataFrame):
    return F.coalesce(F.col("status"), F.lit("FETCHED"))


# ---------------------------------------------------------------- filters

def inbox(df: DataFrame) -> DataFrame:
    """null or FETCHED."""
    return df.filter(status_of(df) == "FETCHED")


def pipeline(df: DataFrame) -> DataFrame:
    """non-null and not FETCHED."""
    return df.filter(F.col("status").isNotNull() & (F.col("status") != "FETCHED"))


def busy(df: DataFrame) -> DataFrame:
    """QUEUED or PROCESSING."""
    return df.filter(F.col("processing_status").isin("QUEUED", "PROCESSING"))


def idle(df: DataFrame) -> DataFrame:
    return df.filter(F.col("processing_status") == "IDLE")


def active(df: DataFrame) -> DataFrame:
    """neither REJECTED nor HIRED (null counts as FETCHED, so active)."""
    return df.filter(~status_of(df).isin("REJECTED", "HIRED"))


def scored_since(df: DataFrame, now: str) -> DataFrame:
    """scored_at strictly after now - 1 week."""
    return df.filter(F.col("scored_at") > ts_lit(now) - F.expr("INTERVAL 7 DAYS"))


def by_reference(df: DataFrame, keys: DataFrame, key: str = "reference_id") -> DataFrame:
    """lookup by a frame of keys (semi join; AQE broadcasts small key sets)."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def max_age(df: DataFrame, days: int, today: str) -> DataFrame:
    """created within ``days`` of ``today``; 0 means any age."""
    if days <= 0:
        return df
    return df.filter(F.col("created_at") >= ts_lit(today) - F.expr(f"INTERVAL {int(days)} DAYS"))


def min_score(df: DataFrame, n: int = S.DEFAULT_MIN_MATCH_SCORE) -> DataFrame:
    """match_score >= n."""
    return df.filter(F.col("match_score") >= n)


def keyword(df: DataFrame, kw: str) -> DataFrame:
    """F8: case-insensitive contains on title or description."""
    k = kw.lower()
    return df.filter(F.lower("title").contains(k) | F.lower("description").contains(k))


# ---------------------------------------------------------------- board

def board_dimension(spark) -> DataFrame:
    """The four board columns (a fixed 4-row frame, safe to broadcast)."""
    return spark.createDataFrame(
        S.BOARD_COLUMNS, "col_pos int, col_id string, col_title string, col_status string")


def board(df: DataFrame) -> DataFrame:
    """B1, flat: one row per card of the four columns; an empty column still
    yields one row with null card fields.

    Cards come from a map-side join of postings with the broadcast 4-row
    dimension (no shuffle of the posting table); empty columns come from a
    tiny status aggregate, anti-joined with the dimension.
    """
    spark = df.sparkSession
    dim = F.broadcast(board_dimension(spark))
    p = df.select(status_of(df).alias("col_status"), "id", "company", "title", "match_score", "description")
    cards = p.join(dim, "col_status").select(
        "col_pos", "col_id", "col_title",
        F.col("id").alias("card_id"),
        F.col("company").alias("card_company"),
        F.col("title").alias("card_title"),
        F.coalesce(F.col("match_score"), F.lit(0)).cast("long").alias("card_score"),
        F.lit(S.BOARD_LOCATION).alias("card_location"),
        preview("description").alias("card_preview"),
    )
    present = p.groupBy("col_status").agg(F.count(F.lit(1)).alias("n"))
    empties = dim.join(present, "col_status", "left_anti").select(
        "col_pos", "col_id", "col_title",
        F.lit(None).cast(cards.schema["card_id"].dataType).alias("card_id"),
        F.lit(None).cast("string").alias("card_company"),
        F.lit(None).cast("string").alias("card_title"),
        F.lit(None).cast("long").alias("card_score"),
        F.lit(None).cast("string").alias("card_location"),
        F.lit(None).cast("string").alias("card_preview"),
    )
    return cards.unionByName(empties)


def board_counts(df: DataFrame) -> DataFrame:
    """Column sizes of the board (all four, zero when empty)."""
    spark = df.sparkSession
    dim = F.broadcast(board_dimension(spark))
    present = df.groupBy(status_of(df).alias("col_status")).agg(F.count(F.lit(1)).alias("n"))
    return dim.join(present, "col_status", "left").select(
        "col_pos", "col_id", "col_title", F.coalesce("n", F.lit(0)).cast("long").alias("n_cards"))


#: Cards of one column of the nested board.
BOARD_CARDS = 25


def board_nested(df: DataFrame, cards: int = BOARD_CARDS) -> DataFrame:
    """B1, nested: one row per board column with its newest cards.

    Four rows whatever the table's size: (col_pos, col_id, col_title, total,
    jobs, next_at, next_id).  ``jobs`` holds at most ``cards`` cards by falling
    created_at, then rising id (null dates last); where there are more,
    (next_at, next_id) is the place of the last one shown, from which
    ``board_more`` goes on.  Every partition sends its own ``cards`` + 1 best
    rows of a column (a window with a partial group limit) and one count, so no
    column is collected.
    """
    spark = df.sparkSession
    dim = F.broadcast(board_dimension(spark))
    order = [F.col("created_at").desc_nulls_last(), F.col("id")]
    p = df.select(status_of(df).alias("col_status"), "created_at", *_card(df)).join(dim, "col_status", "left_semi")
    ranked = p.withColumn("_n", F.row_number().over(Window.partitionBy("col_status").orderBy(*order))) \
        .filter(F.col("_n") <= cards + 1)
    card = F.struct("id", "company", "title", "score", "location", "matchReason")
    listed = ranked.groupBy("col_status").agg(
        F.array_sort(F.collect_list(F.when(F.col("_n") <= cards, F.struct("_n", card.alias("card"))))).alias("_cards"),
        F.max(F.when(F.col("_n") == cards, F.struct("created_at", "id"))).alias("_last"), F.count(F.lit(1)).alias("_found"))
    return (board_counts(df).join(dim.select("col_id", "col_status"), "col_id").join(listed, "col_status", "left")
            .select("col_pos", "col_id", "col_title", F.col("n_cards").alias("total"),
                    F.coalesce(F.transform("_cards", lambda c: c["card"]), F.array().cast(listed.select(
                        F.transform("_cards", lambda c: c["card"]).alias("j")).schema["j"].dataType)).alias("jobs"),
                    F.when(F.col("_found") > cards, F.col("_last.created_at")).alias("next_at"),
                    F.when(F.col("_found") > cards, F.col("_last.id")).alias("next_id")))


def _card(df: DataFrame) -> list:
    """The fields of a card of the nested board."""
    return [F.col("id"), F.col("company"), F.col("title"), F.coalesce(F.col("match_score"), F.lit(0)).cast("long").alias("score"),
            F.lit(S.BOARD_LOCATION).alias("location"), preview("description").alias("matchReason")]


def board_more(df: DataFrame, col_id: str, next_at, next_id, cards: int = BOARD_CARDS) -> DataFrame:
    """The cards of one column after a cursor of ``board_nested``, as many as ``cards``."""
    status = {c: s for _, c, _, s in S.BOARD_COLUMNS}[col_id]
    at = F.lit(next_at).cast(df.schema["created_at"].dataType)
    later = F.col("id") > F.lit(next_id)
    after = (F.col("created_at").isNull() & later) if next_at is None else \
        ((F.col("created_at") < at) | F.col("created_at").isNull() | ((F.col("created_at") == at) & later))
    return (df.filter((status_of(df) == status) & after).select("created_at", *_card(df))
            .orderBy(F.col("created_at").desc_nulls_last(), "id").limit(cards))


# ---------------------------------------------------------------- stats

def weekly_stats(df: DataFrame, now: str) -> DataFrame:
    """B2: scored / dispatched in the last week (dispatch judged by scored_at),
    mean of all non-null scores truncated, count outside the inbox."""
    week = F.col("scored_at") > ts_lit(now) - F.expr("INTERVAL 7 DAYS")
    st = status_of(df)
    return df.agg(
        F.count(F.when(week, 1)).alias("scored_this_week"),
        F.count(F.when(week & (st == "APPLIED"), 1)).alias("dispatched_this_week"),
        F.coalesce(F.avg("match_score").cast("long"), F.lit(0).cast("long")).alias("avg_score"),
        F.count(F.when(st != "FETCHED", 1)).alias("total_in_pipeline"),
    )


def pipeline_stats(df: DataFrame) -> DataFrame:
    """Column counts, mean of scores > 0 rounded half up (0 if none),
    total rows, pending (FETCHED)."""
    st = status_of(df)
    pos = F.when(F.col("match_score") > 0, F.col("match_score"))
    return df.agg(
        F.count(F.when(st == "FETCHED", 1)).alias("inbox"),
        F.count(F.when(st == "SCORED", 1)).alias("ai_review"),
        F.count(F.when(st == "APPROVED", 1)).alias("ready_to_dispatch"),
        F.count(F.when(st == "APPLIED", 1)).alias("dispatched"),
        F.coalesce(F.floor(F.avg(pos) + F.lit(0.5)), F.lit(0)).cast("long").alias("avg_score"),
        F.count(F.lit(1)).alias("total_in_db"),
        F.count(F.when(st == "FETCHED", 1)).alias("pending_scoring"),
    )


def by_status(df: DataFrame) -> DataFrame:
    """B4."""
    return df.groupBy(status_of(df).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def score_band(score) -> F.Column:
    c = F.col(score) if isinstance(score, str) else score
    out = F.when(c.isNull(), F.lit("none"))
    for label, lo, hi in S.SCORE_BANDS:
        out = out.when((c >= lo) & (c <= hi), F.lit(label))
    return out.otherwise(F.lit("out_of_range"))


def score_bands(df: DataFrame, by: str = "status") -> DataFrame:
    """Histogram of score bands per status (or company)."""
    key = status_of(df) if by == "status" else F.col(by)
    return (df.groupBy(key.alias(by), score_band("match_score").alias("band"))
              .agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- lists

def capped_inbox(df: DataFrame, n: int = S.INBOX_CAP) -> DataFrame:
    """The first ``n`` inbox rows in (created_at, id) order, plus the total.

    The cap is the feature (a top-n display).  ``orderBy().limit()`` plans as
    TakeOrderedAndProject: each partition keeps its own n best, so only
    n x partitions rows cross the shuffle; the total is a scalar subquery
    over a partial aggregate.
    """
    ib = inbox(df)
    top = ib.orderBy("created_at", "id").limit(n).select(
        "id", "title", "company", "created_at")
    total = ib.agg(F.count(F.lit(1)).alias("total_fetched"))
    return top.withColumn("total_fetched", total.scalar())


def first_application(apps: DataFrame) -> DataFrame:
    """The first application per posting by (created_at, id).

    ``min_by`` over a struct is a hash aggregate with map-side partials, so a
    posting with millions of applications never lands in one sort buffer.
    """
    order = F.struct("created_at", "id")
    return (apps.groupBy("job_id")
                .agg(F.min_by(F.struct(*[c for c in apps.columns if c != "job_id"]), order).alias("a"))
                .select("job_id", "a.*"))


def has_application(postings: DataFrame, apps: DataFrame) -> DataFrame:
    """Existence flag per posting (one join instead of one query per card)."""
    keys = apps.select(F.col("job_id").alias("id")).distinct().withColumn("has_application", F.lit(True))
    return (postings.join(keys, "id", "left")
                    .withColumn("has_application", F.coalesce("has_application", F.lit(False))))


def to_cards(postings: DataFrame, apps: DataFrame) -> DataFrame:
    """Card projection with the existence flag; the link falls back to
    the portal page of the hash id (P7)."""
    p = postings.select(
        "id", "title", F.col("company").alias("employer"),
        status_of(postings).alias("status"),
        F.col("match_score").alias("score"),
        F.col("ai_analysis").alias("analysis"),
        portal_url_read(postings).alias("portal_url"), F.col("notes"),
        java_datetime("scored_at").alias("scored_at_text"))
    return has_application(p, apps)
