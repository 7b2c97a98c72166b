"""Structured Streaming forms of the pipeline timers.

The reference has timers and in-process events; here each becomes a
streaming query over landed files.  Sinks are written per micro-batch with
``foreachBatch`` and made idempotent, so a batch replayed after a failure
(same ``epoch_id``) changes nothing:

* appends go through the anti-join of ``append_new`` (S4);
* derived tables are written to an ``epoch=<id>`` partition with dynamic
  partition overwrite, so a replay rewrites the same partition.

Checkpoints live under the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..operators import actions as A
from ..operators import mailbox as MB
from ..operators import normalize as N
from ..operators import views as V
from ..session import scratch_path, ship_package
from ..sources import feeds as FD
from ..sources import tables as TB
from ..sources.schema_rules import validate_postings
from . import runs as R


def _ckpt(spark: SparkSession, name: str, given: str | None) -> str:
    return given or scratch_path(spark, f"streams/{name}")


def _start(df_writer, trigger: str | None):
    if trigger in (None, "availableNow"):
        return df_writer.trigger(availableNow=True).start()
    return df_writer.trigger(processingTime=trigger).start()


def write_epoch(df: DataFrame, path: str, epoch_id: int) -> None:
    """Idempotent per-batch write: overwrite only this batch's partition."""
    (df.withColumn("epoch", F.lit(int(epoch_id)).cast("long"))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("epoch").parquet(path))


# ------------------------------------------------------------------ R1

LIVE_PAGE = "page long, file string, records string"


def _feed_processor(first_page: int):
    """The pages of one feed run in order; made here so that workers need no import."""
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Feed(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.place = handle.getValueState("place", "next long, end long")  # end: the empty page, -1 if none yet
            self.held = handle.getMapState("held", "page long", "file string, records string")

        def _release(self, at, end, over_gaps):
            """Pages that can go out, and the place reached."""
            out, pages = [], sorted(k[0] for k in self.held.keys())
            for page in pages:
                if end >= 0 and page > end:
                    self.held.removeKey((page,))
                    continue
                if page > at and not over_gaps:
                    break
                file, records = self.held.getValue((page,))
                self.held.removeKey((page,))
                at = page + 1
                if records is None:
                    end = page
                else:
                    out.append((page, file, records))
            return out, at, end

        def _wait(self, now):
            """One timer while pages are held: a page that has not come by then is lost."""
            timers = list(self.handle.listTimers())
            if self.held.exists() and not timers:
                self.handle.registerTimer(now)
            elif not self.held.exists():
                for t in timers:
                    self.handle.deleteTimer(t)

        def handleInputRows(self, key, rows, timerValues):
            at, end = self.place.get() if self.place.exists() else (first_page, -1)
            out, now = [], 0
            for pdf in rows:
                now = int(pdf["landed"].iloc[0].timestamp() * 1000)
                for page, file, records in pdf[["page", "file", "records"]].itertuples(index=False):
                    page, records = int(page), None if pd.isna(records) else records
                    if page < at or page < end:  # landed again, or before the first page
                        if records is not None and (end < 0 or page < end):
                            out.append((page, file, records))
                    elif end < 0:
                        self.held.updateValue((page,), (file, records))
            more, at, end = self._release(at, end, False)
            self.place.update((at, end))
            self._wait(now)
            yield pd.DataFrame(out + more, columns=["page", "file", "records"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            at, end = self.place.get()
            out, at, end = self._release(at, end, True)
            self.place.update((at, end))
            yield pd.DataFrame(out, columns=["page", "file", "records"])

        def close(self):
            pass

    return Feed()


def pages_in_order(pages: DataFrame, first_page: int = 1, lost_after: int = 3600) -> DataFrame:
    """S1's end-of-feed rule in a stream: of each run (folder) the pages up to its first
    empty one, whatever the order in which they land.

    A run's state is the next page's number and the pages that came before
    their turn.  The time is that of the micro-batches: once one starts
    ``lost_after`` seconds after a page was held back, what is missing before
    it counts as lost, and the run goes on without it.  Pages without a
    number go through as they come.
    """
    empty = F.coalesce(F.size("stellenangebote"), F.lit(-1)) <= 0
    rows = pages.select(F.regexp_extract("_file", "^(.*)/[^/]*$", 1).alias("run"), F.coalesce("page", F.lit(0)).alias("page"), F.col("_file").alias("file"),
                        F.when(~empty, F.to_json("stellenangebote")).alias("records"),
                        F.current_timestamp().alias("landed")).withWatermark("landed", f"{lost_after} seconds")
    live = rows.groupBy("run").transformWithStateInPandas(
        statefulProcessor=_feed_processor(first_page), outputStructType=LIVE_PAGE,
        outputMode="Append", timeMode="EventTime")
    kind = S.SEARCH_PAGE["stellenangebote"].dataType
    return live.select("page", F.from_json("records", kind).alias("stellenangebote"), F.col("file").alias("_file"))


def ingest_stream(spark: SparkSession, in_dir: str, table_path: str, now: str,
                  detail: DataFrame | None = None, checkpoint: str | None = None,
                  trigger: str | None = "availableNow", max_files: int | None = None,
                  first_page: int = 1, lost_after: int = 3600):
    """Landed search pages -> pages in order up to the end of their feed ->
    explode -> ingest rules -> validate -> dedup -> append; invalid postings go
    to ``<table>_quarantine`` with the reason.

    Every micro-batch appends only unseen reference keys (S4), so replays
    and overlapping feeds add nothing.  ``max_files`` bounds a micro-batch and
    changes nothing in the result: which pages belong to a feed is decided by
    keyed state (``pages_in_order``), not by what came in which batch.
    """
    ship_package(spark)
    r = spark.readStream.schema(S.SEARCH_PAGE).option("multiLine", True)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    src = r.json(in_dir).select(FD.page_number(), "stellenangebote", F.col("_metadata.file_path").alias("_file"))
    live = pages_in_order(src, first_page, lost_after)

    def batch(df: DataFrame, epoch_id: int) -> None:
        # the state is run through once: the batch's pages are read back from their partition
        pages_path = f"{table_path}_pages"
        write_epoch(df, pages_path, epoch_id)
        here = f"{pages_path}/epoch={epoch_id}"
        if TB.try_read(spark, here) is None:
            return
        posts = N.normalize_ingest(FD.explode_records(spark.read.schema(df.schema).parquet(here)), detail, now)
        ok, bad = validate_postings(posts)
        write_epoch(bad, f"{table_path}_quarantine", epoch_id)
        TB.append_new(ok, table_path)

    w = live.writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", _ckpt(spark, "ingest", checkpoint))
    return _start(w, trigger)


# ------------------------------------------------------------------ R2

def claimed_prompts(claimed: DataFrame, cv: DataFrame | None, fallback_cv: str) -> DataFrame:
    """Prompts for claimed postings.  ``cv`` is the active persona's frame
    (J6: cv_text, system_prompt; per profile_id or a single row); without one
    the fallback CV and the default system prompt are used."""
    from ..operators import dispatch as DP
    from ..operators import replies as RP
    if cv is None:
        single = claimed.sparkSession.createDataFrame([(fallback_cv,)], "cv_text string")
        return RP.build_prompts(claimed, single, system=DP.DEFAULT_SYSTEM_PROMPT)
    if "profile_id" in cv.columns and "profile_id" not in claimed.columns:
        raise ValueError("claimed postings carry no profile_id to find their persona by")
    return RP.build_prompts(claimed, cv)


def apply_claimed(working: DataFrame, claimed: DataFrame, replies: DataFrame, now: str,
                  cv_path: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parse raw replies of claimed postings, apply them, release the claims:
    (postings', new applications, progress events)."""
    from ..functions.json_reply import extract_json, parse_replies
    from ..operators import queueing as Q
    from ..operators import replies as RP
    parsed = parse_replies(extract_json(
        replies.withColumnRenamed("id", "job_id").withColumnRenamed("error", "call_error"), "raw")
        .withColumn("error", F.coalesce("call_error", "error")))
    updated, apps, events = RP.apply_replies(working, parsed, now, F.lit(cv_path).cast("string"))
    released = Q.release(updated, claimed.select("id"))
    return released, apps, RP.scoring_started(claimed, now).unionByName(events)


def queue_step(postings: DataFrame, scorer, now: str, n: int = 1, cv: DataFrame | None = None,
               fallback_cv: str = "", cv_path: str | None = None):
    """One queue-worker step (T1 -> X1 -> M1..M5 -> A7 release) as a plan:
    returns (postings', new applications, progress events)."""
    from ..operators import queueing as Q
    from ..operators import replies as RP
    claimed, working = Q.claim(postings, n)
    replies = RP.score_with(claimed_prompts(claimed, cv, fallback_cv), scorer)
    return apply_claimed(working, claimed, replies, now, cv_path)


def current_postings(spark: SparkSession, base_path: str, changes_path: str, before_epoch: int) -> DataFrame:
    """Base table with the latest change per posting from the change log
    (epochs before ``before_epoch``) applied; the base is never rewritten."""
    base = TB.read_table(spark, base_path)
    changes = TB.try_read(spark, changes_path)
    if changes is None:
        return base
    cols = base.columns
    latest = (changes.filter(F.col("epoch") < before_epoch)
                     .groupBy("id").agg(F.max_by(F.struct(*[c for c in cols if c != "id"]), "epoch").alias("r"))
                     .select("id", "r.*"))
    return base.join(latest.select("id"), "id", "left_anti").unionByName(latest.select(*cols))


REPLY_FILES = T.StructType([T.StructField("id", T.StringType()), T.StructField("raw", T.StringType()),
                            T.StructField("error", T.StringType())])


def open_queue(spark: SparkSession, out_path: str, epoch_id: int, schema: T.StructType) -> DataFrame:
    """The queue entries of a ``queue_stream`` that are unclaimed after a batch."""
    from ..operators import queueing as Q
    ledger = R.read_ledger(spark, f"{out_path}/queue_ledger", epoch_id)
    return R.open_rows(R.read_runs(spark, f"{out_path}/queued", [r["run"] for r in ledger], schema), ledger, Q.QUEUE_ORDER)


def _claim_open(spark: SparkSession, arrived: DataFrame, out_path: str, epoch_id: int, n: int, max_runs: int) -> DataFrame:
    """Take in a batch's queue entries, claim the ``n`` oldest open ones and note
    the place reached in each run; returns the claimed rows, PROCESSING."""
    from ..operators import queueing as Q
    order, queued, ledger_path = Q.QUEUE_ORDER, f"{out_path}/queued", f"{out_path}/queue_ledger"
    schema, own = arrived.schema, 2 * epoch_id
    ledger = [r.asDict() for r in R.read_ledger(spark, ledger_path, epoch_id - 1)]
    R.write_run(arrived, queued, own, order)
    ledger += [{"run": own, "used": False, "at": None, "last": r["last"]}
               for r in R.last_key(R.read_runs(spark, queued, [own], schema), order).collect()]
    if len(ledger) > max_runs:
        left = R.open_rows(R.read_runs(spark, queued, [r["run"] for r in ledger], schema), ledger, order).drop("run")
        R.write_run(left, queued, own + 1, order)
        ledger = [{"run": own + 1, "used": False, "at": None, "last": r["last"]}
                  for r in R.last_key(R.read_runs(spark, queued, [own + 1], schema), order).collect()]
    entries = R.open_rows(R.read_runs(spark, queued, [r["run"] for r in ledger], schema), ledger, order)
    # The keys alone are ordered; the n claims then fetch their rows, one entry a posting.
    R.write_run(entries.select("run", *order).orderBy(*order, "run").limit(n).withColumnRenamed("run", "of"), f"{out_path}/claims", own)
    claims = spark.read.schema(T.StructType([schema[c] for c in order] + [T.StructField("of", T.LongType())])) \
        .parquet(f"{out_path}/claims/run={own}").withColumnRenamed("of", "run")
    reached = {r["run"]: r["last"] for r in R.last_key(claims, order).collect()}
    after = [{**r, "used": True, "at": reached[r["run"]]} if r["run"] in reached else r for r in ledger]
    R.write_ledger(spark, ledger_path, epoch_id, [(r["run"], r["used"], r["at"], r["last"]) for r in after
                                                  if not r["used"] or r["at"] != r["last"]])
    # Entries up to the place reached in each run are the claims: literal bounds again, before the join.
    here = [r for r in after if r["run"] in reached]
    beyond = F.lit(False)
    for r in here:
        beyond = beyond | R.after(r, entries, order)
    rows = entries.filter(F.col("run").isin([r["run"] for r in here]) & ~F.coalesce(beyond, F.lit(False)))
    return rows.drop("run").dropDuplicates(["id"]).withColumn("processing_status", F.lit("PROCESSING"))


def queue_stream(spark: SparkSession, tick_dir: str, postings_path: str, out_path: str, scorer, now: str,
                 n: int = 1, checkpoint: str | None = None, trigger: str | None = "3 seconds",
                 max_files: int | None = 1, cv: DataFrame | None = None, fallback_cv: str = "",
                 cv_path: str | None = None, max_runs: int = R.MAX_RUNS):
    """R2: every trigger claim ``n`` postings, score, apply, release.

    Two streams meet: landed tick files (a tick is a line; a batch with a tick
    claims) and the files of the posting table.  A posting that lands as
    FETCHED and QUEUED is one entry of the queue; one that lands again is queued
    again.  Postings without an id cannot be claimed.

    The entries are kept as sorted runs (``runs``) with one place a run, since
    claims leave a run from its oldest end: a batch reads the files that are
    new, the keys of entries still open, and the ``n`` rows it claims,
    whatever the number of past batches.  Changed rows go to
    ``out_path/postings/epoch=<id>``.  The claims are spread over the cluster, each
    is scored once: the batch's raw replies are written to ``out_path/replies``
    first, and everything else is derived from that table.
    """
    from ..operators import queueing as Q
    from ..operators import replies as RP
    ship_package(spark)
    r = spark.readStream.format("text")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    schema = TB.read_table(spark, postings_path).schema
    landed = spark.readStream.schema(schema).parquet(postings_path).withColumn("_tick", F.lit(False))
    both = landed.unionByName(r.load(tick_dir).select(F.lit(True).alias("_tick")), allowMissingColumns=True)

    def batch(df: DataFrame, epoch_id: int) -> None:
        claims = n if not df.filter("_tick").isEmpty() else 0
        arrived = Q.queue_candidates(df.filter(~F.col("_tick") & F.col("id").isNotNull())).select(*schema.names).dropDuplicates(["id"])
        claimed = _claim_open(spark, arrived, out_path, epoch_id, claims, max_runs)
        prompts = claimed_prompts(claimed, cv, fallback_cv).repartition(min(n, spark.sparkContext.defaultParallelism))
        RP.score_with(prompts, scorer).withColumn("id", F.col("id").cast("string")) \
            .write.mode("overwrite").parquet(f"{out_path}/replies/epoch={epoch_id}")
        replies = spark.read.schema(REPLY_FILES).parquet(f"{out_path}/replies/epoch={epoch_id}") \
            .withColumn("id", F.col("id").cast(schema["id"].dataType))
        posts, apps, events = apply_claimed(claimed, claimed, replies, now, cv_path)
        write_epoch(posts, f"{out_path}/postings", epoch_id)
        write_epoch(apps, f"{out_path}/applications", epoch_id)
        write_epoch(TB.progress_events(events, keep=("id",)), f"{out_path}/progress", epoch_id)

    w = both.writeStream.foreachBatch(batch).option("checkpointLocation", _ckpt(spark, "queue", checkpoint))
    return _start(w, trigger)


# ------------------------------------------------------------------ R3

def mail_stream(spark: SparkSession, in_dir: str, postings: DataFrame, out_path: str,
                checkpoint: str | None = None, trigger: str | None = "availableNow",
                max_files: int | None = None, max_runs: int = R.MAX_RUNS):
    """New mail plus the mail still pending from earlier batches is
    matched against the postings (J5) and classified (G1).

    A batch reads its own mail, the mail its predecessor left pending
    (``out_path/pending``) and the ids of postings that mail has rejected
    (``out_path/closed``: runs, merged to one row a posting), never the mail or
    the outcomes of past batches.  Rejection is the only outcome that takes a
    posting out of reach.  Outcomes go to ``out_path/outcomes/epoch=<id>``.
    ``postings`` is read anew in every batch.  The checkpoint replaces the SEEN
    flag; a replayed batch rewrites only its own folders.
    """
    r = spark.readStream.schema(S.MESSAGE)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    src = r.parquet(in_dir)
    closed_path, ledger_path = f"{out_path}/closed", f"{out_path}/closed_ledger"
    closed_type = T.StructType([T.StructField("id", postings.schema["id"].dataType)])

    def batch(df: DataFrame, epoch_id: int) -> None:
        own = 2 * epoch_id
        runs = [r["run"] for r in R.read_ledger(spark, ledger_path, epoch_id - 1)]
        before = _pending(spark, out_path, epoch_id - 1)
        df.select(*S.MESSAGE.names).write.mode("overwrite").parquet(f"{out_path}/mail/epoch={epoch_id}")
        waiting = spark.read.schema(S.MESSAGE).parquet(f"{out_path}/mail/epoch={epoch_id}")
        if before is not None:
            waiting = before.unionByName(waiting.join(before.select("message_id"), "message_id", "left_anti"))
        if len(runs) > max_runs:
            R.write_run(R.read_runs(spark, closed_path, runs, closed_type).select("id").distinct(), closed_path, own + 1)
            runs = [own + 1]
        closed = R.read_runs(spark, closed_path, runs, closed_type).select("id").distinct()
        out = MB.classify_messages(waiting, postings.join(closed, "id", "left_anti"))
        # written whole before the parts are taken from it: the match runs once
        out.write.mode("overwrite").parquet(f"{out_path}/matched/epoch={epoch_id}")
        out = spark.read.schema(out.schema).parquet(f"{out_path}/matched/epoch={epoch_id}")
        settled = out.filter(F.col("outcome") != "pending")
        write_epoch(settled, f"{out_path}/outcomes", epoch_id)
        R.write_run(settled.filter(F.col("outcome") == "rejected").select(F.col("posting_id").alias("id")).distinct(), closed_path, own)
        MB.pending_mail(waiting, out).write.mode("overwrite").parquet(f"{out_path}/pending/epoch={epoch_id}")
        R.write_ledger(spark, ledger_path, epoch_id, [(k, False, None, None) for k in [*runs, own]])

    w = src.writeStream.foreachBatch(batch).option("checkpointLocation", _ckpt(spark, "mail", checkpoint))
    return _start(w, trigger)


def _pending(spark: SparkSession, out_path: str, epoch_id: int) -> DataFrame | None:
    if epoch_id < 0:
        return None
    return spark.read.schema(S.MESSAGE).parquet(f"{out_path}/pending/epoch={epoch_id}")


def pending_of(spark: SparkSession, out_path: str) -> DataFrame:
    """Mail of a ``mail_stream`` that no posting has matched yet."""
    found = _pending(spark, out_path, R.last_epoch(spark, f"{out_path}/closed_ledger"))
    return spark.createDataFrame([], S.MESSAGE) if found is None else found


# ------------------------------------------------------------------ R4 / R5

# Landed action files: the action log with numeric posting keys.
ACTION_FILES = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("job_id", T.LongType()), T.StructField("action", T.StringType()),
    T.StructField("arg", T.StringType())])

def state_stream(actions: DataFrame, postings: DataFrame, apps: DataFrame) -> DataFrame:
    """Live per-posting state from the action stream (update mode).

    A streaming aggregate with map-side partials: status and notes are the
    last by seq, whatever the arrival order and batch size, and a posting with
    very many actions sends one buffer row per map task.  ``postings`` and
    ``apps`` are static tables (stream-static joins on the key projections
    only).  A deleted posting reports only that, and the number of actions.
    """
    a = _with_effects(actions, postings.select(F.col("id").alias("job_id")), apps)
    state = a.groupBy("job_id").agg(
        F.max_by("set_status", F.when(F.col("set_status").isNotNull(), F.col("seq"))).alias("new_status"),
        F.bool_or("queues").alias("queued"),
        F.max_by("set_notes", F.when(F.col("set_notes").isNotNull(), F.col("seq"))).alias("new_notes"),
        F.bool_or("deletes").alias("deleted"),
        F.count(F.lit(1)).alias("n_actions"))
    return A.changes_of(state)


def stats_from_changes(postings: DataFrame, changes: DataFrame) -> DataFrame:
    """Board counts of the postings with the latest live changes."""
    ch = changes.select(F.col("job_id").alias("id"), F.col("new_status").alias("_new"), F.col("deleted").alias("_del"))
    p = (postings.join(ch, "id", "left")
                 .filter(~F.coalesce(F.col("_del"), F.lit(False)))
                 .withColumn("status", F.coalesce("_new", "status")).drop("_new", "_del"))
    return V.by_status(p)


#: What the keyed state holds of a posting.
LIVE = ("status string, status_seq long, queued boolean, notes string, notes_seq long, deleted boolean, n_actions long")
CHANGED = ("job_id long, new_status string, queued boolean, new_notes string, deleted boolean, n_actions long, "
           "label_before string, label_now string")


def _live_processor():
    """The fold of one posting's actions into its state; made here so that workers need no import."""
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Live(StatefulProcessor):
        def init(self, handle):
            self.state = handle.getValueState("live", LIVE)

        def handleInputRows(self, key, rows, timerValues):
            status, status_seq, queued, notes, notes_seq, deleted, n = \
                self.state.get() if self.state.exists() else (None, -1, False, None, -1, False, 0)
            first, there, before = None, False, None
            for pdf in rows:  # a posting's rows come in batches, whatever their number
                if first is None:
                    first, there = pdf["start_status"].iloc[0], bool(pdf["job_exists"].iloc[0])
                    before = None if deleted or not there else status or first
                n += len(pdf)
                for seq, new in pdf.loc[pdf["set_status"].notna(), ["seq", "set_status"]].itertuples(index=False):
                    if seq > status_seq:
                        status, status_seq = new, int(seq)
                for seq, new in pdf.loc[pdf["set_notes"].notna(), ["seq", "set_notes"]].itertuples(index=False):
                    if seq > notes_seq:
                        notes, notes_seq = new, int(seq)
                queued = queued or bool(pdf["queues"].any())
                deleted = deleted or bool(pdf["deletes"].any())
            self.state.update((status, status_seq, queued, notes, notes_seq, deleted, n))
            now = None if deleted or not there else status or first
            yield pd.DataFrame({
                "job_id": [key[0]], "new_status": [None if deleted else status], "queued": [queued and not deleted],
                "new_notes": [None if deleted else notes], "deleted": [deleted], "n_actions": [n],
                "label_before": [before], "label_now": [now]})

        def close(self):
            pass

    return Live()


def live_changes(actions: DataFrame, postings: DataFrame, apps: DataFrame) -> DataFrame:
    """R4 with keyed state (update mode): the changed state of each posting that a
    micro-batch touches, as ``state_stream``, with its board status before and
    now (null where it is not on the board).  A batch reads the state of
    its own postings only."""
    a = _with_effects(actions, postings.select(F.col("id").alias("job_id"), F.coalesce("status", F.lit("FETCHED")).alias("start_status")), apps)
    return a.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=_live_processor(), outputStructType=CHANGED, outputMode="Update", timeMode="None")


def _with_effects(actions: DataFrame, postings: DataFrame, apps: DataFrame) -> DataFrame:
    """Each action with what it sets on its posting (``set_status``, ``set_notes``, ``queues``, ``deletes``)."""
    has = apps.select("job_id").distinct().withColumn("has_app", F.lit(True))
    a = (actions.join(postings.withColumn("job_exists", F.lit(True)), "job_id", "left").join(has, "job_id", "left")
         .withColumns({"job_exists": F.coalesce("job_exists", F.lit(False)), "has_app": F.coalesce("has_app", F.lit(False))}))
    act, there = F.col("action"), F.col("job_exists")
    return a.select(
        "job_id", "seq", "job_exists", *(c for c in postings.columns if c != "job_id"),
        F.when(there & ((act != "dispatched") | F.col("has_app")), A._new_status(act)).alias("set_status"),
        F.when(there & (act == "notes"), F.coalesce(F.col("arg"), F.lit(""))).alias("set_notes"),
        F.coalesce(there & (act == "analyze"), F.lit(False)).alias("queues"),
        F.coalesce(there & ~F.col("has_app") & (act == "reject"), F.lit(False)).alias("deletes"))


def board_deltas(changes: DataFrame) -> DataFrame:
    """(status, delta) of changed postings: the old status retracted, the new one added."""
    moved = changes.filter(~F.col("label_before").eqNullSafe(F.col("label_now")))
    steps = F.explode(F.array(F.struct(F.col("label_before").alias("status"), F.lit(-1).alias("delta")),
                              F.struct(F.col("label_now").alias("status"), F.lit(1).alias("delta"))))
    return moved.select(steps.alias("s")).select("s.*").filter(F.col("status").isNotNull()) \
        .groupBy("status").agg(F.sum("delta").alias("delta"))


def run_state_stream(spark: SparkSession, in_dir: str, postings: DataFrame, apps: DataFrame, out_path: str,
                     checkpoint: str | None = None, trigger: str | None = "availableNow",
                     max_files: int | None = None):
    """R4 + R5 wiring: action files -> keyed live state -> per-batch change rows
    (``out_path/changes``) and board counts (``out_path/stats``).

    The counts of a batch are those of the batch before it (a row a status) plus
    the batch's signed deltas; the posting table is counted once, before the
    first batch, into epoch -1.  A replayed batch starts from the same counts
    and rewrites its own partition.
    """
    ship_package(spark)
    r = spark.readStream.schema(ACTION_FILES)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    live = live_changes(r.parquet(in_dir), postings, apps)
    changes_path, stats_path = f"{out_path}/changes", f"{out_path}/stats"
    if TB.try_read(spark, f"{stats_path}/epoch=-1") is None:
        write_epoch(V.by_status(postings), stats_path, -1)
    changed_type = T._parse_datatype_string(CHANGED)

    def batch(df: DataFrame, epoch_id: int) -> None:
        write_epoch(df, changes_path, epoch_id)  # the state is run through once; the rest reads this partition
        changed = spark.read.schema(changed_type).parquet(f"{changes_path}/epoch={epoch_id}") \
            if TB.try_read(spark, f"{changes_path}/epoch={epoch_id}") is not None else spark.createDataFrame([], changed_type)
        past = TB.try_read(spark, f"{stats_path}/epoch={epoch_id - 1}")
        if past is None:  # no partition of that number: the last one there is
            all_past = TB.read_table(spark, stats_path).filter(F.col("epoch") < epoch_id)
            past = all_past.filter(F.col("epoch") == all_past.agg(F.max("epoch")).first()[0]).drop("epoch")
        counts = (past.select("status", "n").unionByName(board_deltas(changed).withColumnRenamed("delta", "n"))
                  .groupBy("status").agg(F.sum("n").alias("n")).filter("n <> 0"))
        write_epoch(counts, stats_path, epoch_id)

    w = live.writeStream.outputMode("update").foreachBatch(batch) \
            .option("checkpointLocation", _ckpt(spark, "state", checkpoint))
    return _start(w, trigger)


def live_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The keyed state of a ``run_state_stream`` as of its last batch, read from its
    checkpoint by Spark's state data source: (job_id, status, queued, notes, deleted, n_actions)."""
    state = spark.read.format("statestore").option("stateVarName", "live").load(checkpoint)
    return state.select("key.job_id", *(f"value.{c}" for c in ("status", "queued", "notes", "deleted", "n_actions")))


# ------------------------------------------------------------------ R6

WEEKLY_EVENT = [("dispatched", "applied"), ("approve", "approved"), ("analyze", "queued")]


def change_events(actions: DataFrame) -> DataFrame:
    """Typed change events (job_id, ts, event) from the action log; with an
    ``outcome`` column only the actions that took effect count."""
    ev = None
    for a, e in WEEKLY_EVENT:
        ev = F.when(F.col("action") == a, e) if ev is None else ev.when(F.col("action") == a, e)
    if "outcome" in actions.columns:
        actions = actions.filter(F.col("outcome") == "ok")
    return actions.select("job_id", "ts", ev.alias("event")).filter(F.col("event").isNotNull())


def scored_events(postings: DataFrame) -> DataFrame:
    """A change event per scored posting, at the time of its score."""
    return postings.filter(F.col("scored_at").isNotNull()).select(
        F.col("id").alias("job_id"), F.col("scored_at").alias("ts"), F.lit("scored").alias("event"))


def weekly_counts(events: DataFrame, lateness: str | None = "1 day") -> DataFrame:
    """Tumbling 7-day windows (epoch-aligned) of event counts.

    Batch form windows the zone-less ``ts`` directly, so the result does not
    depend on the session time zone.  A watermark needs a zoned timestamp:
    the streaming form casts ``ts`` in the session zone (UTC by default,
    see ``session.DEFAULT_CONF``)."""
    e = events
    if e.isStreaming:
        e = e.withColumn("ts", F.col("ts").cast("timestamp"))
        if lateness:
            e = e.withWatermark("ts", lateness)
    return _weeks(e)


def _weeks(events: DataFrame) -> DataFrame:
    return (events.groupBy(F.window("ts", "7 days").alias("w"), "event")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "event", "n"))


# Landed outcomes of actions, and landed scores.
OUTCOME_FILES = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("done_at", T.TimestampNTZType()), T.StructField("outcome", T.StringType())])
SCORE_FILES = T.StructType([T.StructField("id", T.LongType()), T.StructField("scored_at", T.TimestampNTZType())])


def weekly_stream(spark: SparkSession, in_dir: str, out_path: str, outcomes_dir: str, scores_dir: str,
                  lateness: str = "1 day", answered_in: str = "1 hour", checkpoint: str | None = None,
                  trigger: str | None = "availableNow"):
    """R6 streaming: the counts of ``weekly_counts`` over actions that took effect and scores.

    An action counts once its outcome has landed (a stream-stream join by
    sequence number; outcomes come within ``answered_in`` of their action, so
    either side's state is dropped after that and the lateness).  Append mode
    emits a window once the watermark passes its end; what is later than
    ``lateness`` is dropped.
    """
    def landed(schema, path, column):
        rows = spark.readStream.schema(schema).parquet(path)
        return rows.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)

    actions = landed(ACTION_FILES, in_dir, "ts")
    outcomes = landed(OUTCOME_FILES, outcomes_dir, "done_at").withColumnRenamed("seq", "o_seq")
    met = actions.join(outcomes, F.expr(
        f"seq = o_seq AND done_at >= ts AND done_at <= ts + INTERVAL {answered_in}"))
    scores = landed(SCORE_FILES, scores_dir, "scored_at")
    scored = scores.select(F.col("id").alias("job_id"), F.col("scored_at").alias("ts"), F.lit("scored").alias("event"))
    counts = _weeks(change_events(met).unionByName(scored))
    w = (counts.writeStream.outputMode("append").format("parquet").option("path", out_path)
               .option("checkpointLocation", _ckpt(spark, "weekly", checkpoint)))
    return _start(w, trigger)


# ------------------------------------------------------------------ R7

def event_rows(postings: DataFrame, outcomes: DataFrame, actions: DataFrame) -> DataFrame:
    """Typed event rows fetched -> scored -> approved.

    fetched: every posting at created_at; scored: postings with scored_at;
    approved: approve actions that took effect (outcome ok).
    """
    fetched = postings.select(F.lit("JobFetched").alias("event_type"), F.col("id").alias("job_id"),
                              F.col("created_at").alias("ts"))
    scored = postings.filter(F.col("scored_at").isNotNull()).select(
        F.lit("ApplicationScored").alias("event_type"), F.col("id").alias("job_id"), F.col("scored_at").alias("ts"))
    appr = outcomes.filter((F.col("action") == "approve") & (F.col("outcome") == "ok"))
    if "ts" not in appr.columns:
        appr = appr.join(actions.select("seq", "ts"), "seq")
    appr = appr.select(F.lit("ApplicationApproved").alias("event_type"), "job_id", "ts")
    return fetched.unionByName(scored).unionByName(appr)


# ------------------------------------------------------------------ S6 (stream)

PROGRESS_FILES = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("message", T.StringType()), T.StructField("ts", T.TimestampNTZType())])


def progress_stream(spark: SparkSession, in_dir: str, out_path: str, checkpoint: str | None = None,
                    trigger: str | None = "availableNow"):
    """S6 as a stream: landed progress rows -> one JSON line per event
    ({type, message, time HH:mm:ss}); the file sink is exactly-once through
    its own commit log."""
    src = spark.readStream.schema(PROGRESS_FILES).parquet(in_dir)
    w = (TB.progress_events(src).writeStream.format("text").option("path", out_path)
           .option("checkpointLocation", _ckpt(spark, "progress", checkpoint)))
    return _start(w, trigger)
