"""Inbound mail: containment join with postings, classification, status
outcome and rejection memory (J5, W3, G1, A12, V4).

A plain ``contains`` join condition plans as a BroadcastNestedLoopJoin
(messages x companies).  Here every message is read once against a filter of
the distinct company names, and what passes is joined with them (``names``).

Mail is taken in order (received_at, message_id).  A message goes to the
first posting, in (created_at, id) order, that is still active and whose
company it names; a rejecting message takes its posting out.  So the k-th
rejection of a company hits its k-th active posting: a message's posting is
found by an equi-join on (company, 1 + earlier rejections), with both counts
made in two levels (``ordering``).

Messages that name several companies choose among those companies' next
postings, and their choices depend on each other.  The state of that process is one
counter a company, so it is run in slices of the time line, all slices at once:
each slice is played from a guess of its starting counters; then it starts where
the one before it ended, and slices whose start changed are played again until
none does.  The first slice is right at once and each round makes at least one
more right, so there are at most as many rounds as slices of ``SLICE`` rejections
and the result is that of the plain loop; a wrong start also heals as messages
go by (their choice falls on the other company next time).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import contains_any
from ..session import cut_lineage
from .names import names_in
from .ordering import running_before

SEP = "\u0000"
#: Rejections of one slice of the time line, and postings of one block of a company's list.
SLICE, BLOCK = 20_000, 1_000


def active_postings(postings: DataFrame) -> DataFrame:
    """(company_l, posting_id, created_at) of the postings mail can reach."""
    st = F.coalesce(F.col("status"), F.lit("FETCHED"))
    act = postings.filter(~st.isin("REJECTED", "HIRED")).select(
        F.lower("company").alias("company_l"), F.col("id").alias("posting_id"), "created_at")
    return act.filter(F.col("company_l").isNotNull() & (F.col("company_l") != "") & ~F.col("company_l").contains(SEP))


def named_companies(messages: DataFrame, companies: DataFrame) -> DataFrame:
    """(message_id, company_l) for every company a message names in its
    sender or subject."""
    # both searched fields in one text, separated by a character no company
    # name holds: a name occurs in the joined text iff it occurs in one field
    msg = messages.select("message_id", F.concat(F.lower(F.coalesce("from_addr", F.lit(""))), F.lit(SEP),
                                                 F.lower(F.coalesce("subject", F.lit("")))).alias("txt"))
    return names_in(msg, companies, "message_id", "txt", "company_l")


def _targets(rows: DataFrame, ranked: DataFrame) -> DataFrame:
    """The posting each (company, message) row would hit: rows carry
    ``company_l``, ``received_at``, ``message_id`` and ``takes`` (a settled
    rejection of the company)."""
    counted = running_before(rows, "company_l", F.date_trunc("hour", "received_at"), ["received_at", "message_id"],
                             F.col("takes").cast("int"), "before")
    return counted.withColumn("rank", F.col("before") + 1).join(ranked, ["company_l", "rank"])


def match_messages(messages: DataFrame, postings: DataFrame) -> DataFrame:
    """J5 + W3: (message_id, posting_id) of every message that finds a posting,
    taking the messages one after the other (see the module text)."""
    active = active_postings(postings)
    ranked = running_before(active, "company_l", F.date_trunc("hour", "created_at"), ["created_at", "posting_id"],
                            name="before").withColumn("rank", F.col("before") + 1).drop("before")
    named = named_companies(messages, active)
    m = messages.select("message_id", "received_at",
                        (classify(F.col("subject"), F.col("body")) == "rejected").alias("rejects"))
    rows = cut_lineage(named.join(m, "message_id"))
    several = rows.groupBy("message_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("message_id")
    if several.isEmpty():
        return _targets(rows.withColumn("takes", F.col("rejects")), ranked).select("message_id", "posting_id")
    ranked = cut_lineage(ranked)
    taken = settle(rows, ranked)[0].withColumn("taken", F.lit(True))
    # With the takes known every message reads its companies' next postings and goes to the first.
    counted = rows.join(taken, ["message_id", "company_l"], "left").withColumn("takes", F.coalesce("taken", F.lit(False)))
    return (_targets(counted, ranked).groupBy("message_id")
            .agg(F.min(F.struct("created_at", "posting_id")).alias("first")).select("message_id", "first.posting_id"))


def settle(rows: DataFrame, ranked: DataFrame, size: int = SLICE) -> tuple[DataFrame, int]:
    """((message_id, company_l) of the company whose next posting each rejecting
    message takes, rounds).  Where no rejecting message names a company
    together with another, its messages simply take their one company's."""
    rejecting = rows.filter("rejects").select("message_id", "company_l", "received_at")
    several = rejecting.groupBy("message_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    linked = rejecting.join(several, "message_id", "left_semi").select("company_l").distinct()
    alone = rejecting.join(linked, "company_l", "left_anti").select("message_id", "company_l")
    tied = rejecting.join(linked, "company_l", "left_semi")
    # The number of each message on the time line, by hour and within the hour, gives slices of equal size.
    line = running_before(tied.select("message_id", "received_at").distinct().withColumn("_all", F.lit(0)), "_all",
                          F.date_trunc("hour", "received_at"), ["received_at", "message_id"], name="place")
    tied = cut_lineage(tied.join(line.select("message_id", "place"), "message_id")
                       .withColumn("slice", F.floor(F.col("place") / size)))
    played, rounds = _play(tied, ranked)
    return alone.unionByName(played.select("message_id", "company_l")), rounds


def _play(tied: DataFrame, ranked: DataFrame) -> tuple[DataFrame, int]:
    """Rows (slice, message_id, company_l) of the takes of all slices, and the rounds played."""
    at = Window.partitionBy("company_l").orderBy("slice")
    mine = ranked.join(tied.select("company_l").distinct(), "company_l", "left_semi")
    listed = mine.groupBy("company_l").agg(F.count(F.lit(1)).alias("listed"))
    # First guess: each message takes of one of its companies, drawn by the numbers of their
    # postings.  One company a message, so that the takes of all together are right from the start.
    drawn = -F.log((F.xxhash64("message_id", "company_l") / F.lit(2.0 ** 64)) + 0.5 + 1e-12) / F.col("listed")
    guess = tied.join(listed, "company_l").groupBy("message_id", "slice").agg(F.min_by("company_l", drawn).alias("company_l")) \
        .groupBy("slice", "company_l").agg(F.count(F.lit(1)).alias("guess"))
    # The rejections of a company in a slice bound what the slice can take of it.
    slices = tied.groupBy("slice", "company_l").agg(F.count(F.lit(1)).alias("n"))
    starts = cut_lineage(slices.join(guess, ["slice", "company_l"], "left").withColumn("start", F.coalesce(
        F.sum("guess").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("guess"))
    blocks = mine.withColumn("block", F.floor(F.col("rank") / BLOCK))
    found, again, rounds = None, starts, 0
    while not again.isEmpty():
        rounds += 1
        # The postings a slice may reach: ranks start + 1 to start + n of each of its companies.
        reach = again.withColumn("block", F.explode(F.sequence(
            F.floor((F.col("start") + 1) / BLOCK), F.floor((F.col("start") + F.col("n")) / BLOCK))))
        posts = reach.join(blocks, ["company_l", "block"]).filter(
            (F.col("rank") > F.col("start")) & (F.col("rank") <= F.col("start") + F.col("n"))) \
            .select(*(F.col(c).alias(f"p_{c}") for c in ("slice", "company_l", "rank", "created_at", "posting_id")))
        which = again.select("slice").distinct()
        played = tied.join(which, "slice", "left_semi").groupBy("slice").cogroup(posts.groupBy("p_slice")).applyInPandas(
            _play_slice, f"slice long, message_id {tied.schema['message_id'].dataType.simpleString()}, company_l string")
        kept = played if found is None else found.join(which, "slice", "left_anti").unionByName(played)
        found = cut_lineage(kept)
        # A slice starts where the slice before it that names the company ended.
        takes = found.groupBy("slice", "company_l").agg(F.count(F.lit(1)).alias("takes"))
        end = F.col("start") + F.coalesce("takes", F.lit(0))
        now = cut_lineage(starts.join(takes, ["slice", "company_l"], "left").select(
            "slice", "company_l", "n", F.coalesce(F.lag(end).over(at), F.lit(0)).alias("start"), F.col("start").alias("old")))
        starts = now.drop("old")
        again = cut_lineage(starts.join(now.filter("start <> old").select("slice").distinct(), "slice", "left_semi"))
    return (tied if found is None else found).select("slice", "message_id", "company_l"), rounds


def _play_slice(messages, posts):
    """The takes of one slice: its messages in order, each takes the first next
    posting among its companies'.  ``posts`` start at each company's counter."""
    import pandas as pd
    ahead = {c: list(zip(p["p_created_at"], p["p_posting_id"]))
             for c, p in posts.sort_values(["p_company_l", "p_rank"]).groupby("p_company_l", sort=False)}
    used = dict.fromkeys(ahead, 0)
    out = []
    ordered = messages.sort_values(["place", "company_l"])
    places, ids, companies = (ordered[c].tolist() for c in ("place", "message_id", "company_l"))
    k = 0
    while k < len(ids):
        best, at = None, k
        while k < len(ids) and places[k] == places[at]:
            posted = ahead.get(companies[k])
            if posted is not None and used[companies[k]] < len(posted):
                first = posted[used[companies[k]]]
                if best is None or first < best[0]:
                    best = first, companies[k]
            k += 1
        if best is not None:
            used[best[1]] += 1
            out.append((messages["slice"].iloc[0], ids[at], best[1]))
    return pd.DataFrame(out, columns=["slice", "message_id", "company_l"])


def classify(subject: Column, body: Column) -> Column:
    """G1 on a matched message: rejected / interviewing / unchanged."""
    s = F.lower(F.coalesce(subject, F.lit("")))
    b = F.lower(F.coalesce(body, F.lit("")))
    gate = contains_any(s, S.MAIL_GATE_WORDS)
    rej = contains_any(b, S.MAIL_REJECT_ANY) | contains_any(s, S.MAIL_REJECT_ANY) | contains_any(b, S.MAIL_REJECT_BODY)
    itv = contains_any(b, S.MAIL_INTERVIEW_ANY) | contains_any(s, S.MAIL_INTERVIEW_ANY) \
        | contains_any(b, S.MAIL_INTERVIEW_BODY)
    return (F.when(gate & rej, F.lit("rejected"))
             .when(gate & itv, F.lit("interviewing"))
             .otherwise(F.lit("unchanged")))


def classify_messages(messages: DataFrame, postings: DataFrame) -> DataFrame:
    """J5 + G1: (message_id, posting_id, outcome); unmatched mail is
    ``pending`` (it stays for the next run, new postings may match it)."""
    m = match_messages(messages, postings)
    j = messages.join(m, "message_id", "left")
    return j.select("message_id", "posting_id", "received_at",
                    F.when(F.col("posting_id").isNull(), F.lit("pending"))
                     .otherwise(classify(F.col("subject"), F.col("body"))).alias("outcome"))


def apply_mail_outcomes(postings: DataFrame, outcomes: DataFrame) -> DataFrame:
    """REJECTED / INTERVIEWING from the last status-changing message per
    posting (by received_at, message_id)."""
    ch = (outcomes.filter(F.col("outcome").isin("rejected", "interviewing"))
                  .groupBy(F.col("posting_id").alias("id"))
                  .agg(F.max_by("outcome", F.struct("received_at", "message_id")).alias("_o")))
    return (postings.join(ch, "id", "left")
                    .withColumn("status", F.when(F.col("_o") == "rejected", F.lit("REJECTED"))
                                .when(F.col("_o") == "interviewing", F.lit("INTERVIEWING"))
                                .otherwise(F.col("status")))
                    .drop("_o"))


def pending_mail(messages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Unmatched messages, carried to the next run."""
    return messages.join(outcomes.filter(F.col("outcome") == "pending").select("message_id"), "message_id",
                         "left_semi")


def rejection_memory(outcomes: DataFrame, postings: DataFrame, reasons: DataFrame) -> DataFrame:
    """V4: memory rows for mail-rejected postings: content
    "Rejection for <title> at <company>: <reason>" and metadata type /
    company / jobTitle.  ``reasons`` is (message_id, reason) from X1."""
    rej = outcomes.filter(F.col("outcome") == "rejected").select("message_id", F.col("posting_id").alias("id"))
    j = rej.join(postings.select("id", "title", "company"), "id").join(reasons, "message_id", "left")
    return j.select(
        "message_id",
        F.format_string(S.REJECTION_MEMORY_FORMAT, F.coalesce(F.col("title"), F.lit("null")), F.col("company"),
                        F.coalesce(F.col("reason"), F.lit(""))).alias("content"),
        F.create_map(F.lit("type"), F.lit(S.REJECTION_MEMORY_TYPE), F.lit("company"), F.col("company"),
                     F.lit("jobTitle"), F.col("title")).alias("metadata"))
