"""Action log -> current state.

The reference mutates rows in place, one request at a time.  Here the log
``(seq, ts, job_id, action, arg)`` is folded set-wise:

* per-posting actions touch independent fields and are last-wins, so each
  field is one ``max_by(value, seq)`` in a hash aggregate (partial
  aggregation first: a posting with a third of all actions still sends one
  buffer row per map partition);
* a successful ``reject`` deletes the row and cuts every later action of
  that posting (they report ``not_found``);
* global commands (``score_all``, ``cancel_queue``) act on all postings; their
  counts are running sums over the stretches between cancels (``apply_log``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import non_blank, resolve_recipient
from ..session import cut_lineage
from .ordering import running_before

STATUS_OF_ACTION = [("approve", "APPROVED"), ("ignore", "REJECTED"), ("dispatched", "APPLIED")]
GLOBAL_ACTIONS = ("score_all", "cancel_queue")
SEQ_SLICE = 1 << 16  # sequence numbers of one slice of the log


def _new_status(action: Column) -> Column:
    out = None
    for a, s in STATUS_OF_ACTION:
        out = F.when(action == a, s) if out is None else out.when(action == a, s)
    return out


def _last(value: Column, cond: Column) -> Column:
    """Value of the highest-seq row satisfying ``cond`` (null if none)."""
    return F.max_by(F.when(cond, value), F.when(cond, F.col("seq")))


def job_facts(postings: DataFrame, apps: DataFrame, actions: DataFrame) -> DataFrame:
    """One row per posting touched by the log: does it exist, does it have an
    application, and the seq of its first effective reject (the cut).

    Computed from one aggregate over the log and two semi joins on key
    projections, so the log itself is joined only once afterwards.
    """
    per_job = actions.groupBy("job_id").agg(
        F.min(F.when(F.col("action") == "reject", F.col("seq"))).alias("first_reject"))
    exists = postings.select(F.col("id").alias("job_id")).join(per_job, "job_id", "left_semi") \
                     .withColumn("job_exists", F.lit(True))
    has_app = (apps.select("job_id").join(per_job, "job_id", "left_semi").distinct()
                   .withColumn("has_app", F.lit(True)))
    f = (per_job.join(exists, "job_id", "left").join(has_app, "job_id", "left")
                .select("job_id", F.coalesce("job_exists", F.lit(False)).alias("job_exists"),
                        F.coalesce("has_app", F.lit(False)).alias("has_app"), "first_reject"))
    return f.withColumn("cut_seq", F.when(F.col("job_exists") & ~F.col("has_app"), F.col("first_reject"))) \
            .drop("first_reject")


def action_outcomes(postings: DataFrame, apps: DataFrame, actions: DataFrame) -> DataFrame:
    """Per action: not_found / blocked / deleted / no_application / ok."""
    a = actions.join(job_facts(postings, apps, actions), "job_id", "left")
    act = F.col("action")
    outcome = (F.when(~F.coalesce(F.col("job_exists"), F.lit(False)), "not_found")
                .when(F.col("cut_seq").isNotNull() & (F.col("seq") > F.col("cut_seq")), "not_found")
                .when((act == "reject") & F.col("has_app"), "blocked")
                .when(act == "reject", "deleted")
                .when((act == "dispatched") & ~F.col("has_app"), "no_application")
                .otherwise("ok"))
    return a.withColumn("outcome", outcome)


def _job_state(o: DataFrame) -> DataFrame:
    """Net effect per posting of the outcomes: one hash aggregate."""
    act = F.col("action")
    ok = F.col("outcome") == "ok"
    return o.groupBy("job_id").agg(
        _last(_new_status(act), ok & act.isin("approve", "ignore", "dispatched")).alias("new_status"),
        F.coalesce(F.max(F.when(ok & (act == "analyze"), F.lit(True))), F.lit(False)).alias("queued"),
        _last(F.coalesce(F.col("arg"), F.lit("")), ok & (act == "notes")).alias("new_notes"),
        # an address once used is stored, so a later dispatch without one keeps it
        _last(F.col("arg"), ok & (act == "dispatched") & non_blank("arg").isNotNull()).alias("override"),
        F.coalesce(F.max(F.when(ok & (act == "dispatched"), F.lit(True))), F.lit(False)).alias("dispatched"),
        F.coalesce(F.max(F.when(F.col("outcome") == "deleted", F.lit(True))), F.lit(False)).alias("deleted"),
        F.count(F.lit(1)).alias("n_actions"))


def apply_actions(postings: DataFrame, apps: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold per-posting actions into the posting table.

    Returns (postings', outcomes).  The posting table is joined once, with
    one state row per touched posting.  A log with global commands goes
    through ``apply_log``.
    """
    return _fold(postings, action_outcomes(postings, apps, actions))


def _fold(postings: DataFrame, o: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings', outcomes) of per-posting actions with their outcomes."""
    st = _job_state(o).withColumnRenamed("job_id", "id")
    p = postings.join(st, "id", "left").filter(~F.coalesce(F.col("deleted"), F.lit(False)))
    p = p.select(
        *[c for c in postings.columns if c not in ("status", "processing_status", "notes", "employer_email")],
        F.coalesce("new_status", "status").alias("status"),
        F.when(F.col("queued"), F.lit("QUEUED")).otherwise(F.col("processing_status")).alias("processing_status"),
        F.coalesce("new_notes", "notes").alias("notes"),
        F.when(F.col("dispatched"), resolve_recipient("override", "employer_email", "company"))
         .otherwise(F.col("employer_email")).alias("employer_email"),
    ).select(*postings.columns)
    outcomes = o.select("seq", "job_id", "action", "outcome")
    return p, outcomes


def score_all(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A5: FETCHED and IDLE -> QUEUED; returns (postings', count frame)."""
    hit = (F.coalesce(F.col("status"), F.lit("FETCHED")) == "FETCHED") & (F.col("processing_status") == "IDLE")
    out = postings.withColumn("processing_status",
                              F.when(hit, F.lit("QUEUED")).otherwise(F.col("processing_status")))
    cnt = postings.agg(F.count(F.when(hit, 1)).alias("queued"))
    return out, cnt


def cancel_queue(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """QUEUED or PROCESSING -> IDLE; returns (postings', count frame)."""
    hit = F.col("processing_status").isin("QUEUED", "PROCESSING")
    out = postings.withColumn("processing_status",
                              F.when(hit, F.lit("IDLE")).otherwise(F.col("processing_status")))
    cnt = postings.agg(F.count(F.when(hit, 1)).alias("cancelled"))
    return out, cnt


def _log_segments(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per-posting actions with ``seg``, segments): a segment is the stretch between two
    cancels, numbered by the cancels before it.  Segment rows hold ``s1``, its first
    score-all, and ``c``, the cancel that ends it."""
    is_cancel = (F.col("action") == "cancel_queue").cast("int")
    log = cut_lineage(running_before(actions.withColumn("_all", F.lit(0)), "_all", F.floor(F.col("seq") / SEQ_SLICE),
                                     ["seq"], is_cancel, name="seg").drop("_all"))
    command = F.col("action").isin(*GLOBAL_ACTIONS)
    segments = log.filter(command).groupBy("seg").agg(
        F.min(F.when(F.col("action") == "score_all", F.col("seq"))).alias("s1"),
        F.min(F.when(F.col("action") == "cancel_queue", F.col("seq"))).alias("c"))
    return log, cut_lineage(segments)


def apply_log(postings: DataFrame, apps: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold a log that may hold global commands (A5, A6), in a fixed number of jobs.

    Per-posting actions do not depend on the commands, and a command acts on the
    processing status alone.  A cancel leaves it IDLE; after that an own
    ``analyze``, or the first score-all of the segment while the posting is
    FETCHED, makes it QUEUED until the next cancel.  No action makes a posting
    FETCHED again, so those first score-alls reach it in the segments from 0
    up to one bound, set by its first status action or its deletion.  A
    command's count is a running sum of these bounds over the segments,
    corrected by what the postings did themselves inside the segment; no
    command is looked at one by one.

    Returns (postings', outcomes); the outcome of a command is ``count=<n>``.
    A posting without a processing status counts as IDLE, the model's default.
    """
    log, segments = _log_segments(actions)
    command = F.col("action").isin(*GLOBAL_ACTIONS)
    o = cut_lineage(action_outcomes(postings, apps, log.filter(~command)))
    last, last_s1 = log.agg(F.max(F.col("seg") + (F.col("action") == "cancel_queue").cast("int"))).first()[0] or 0, None
    row = segments.filter(F.col("seg") == last).select("s1").first()
    last_s1 = row[0] if row else None

    act, ok, gone = F.col("action"), F.col("outcome") == "ok", F.col("outcome") == "deleted"
    at = F.struct("seq", "seg")
    ends = o.groupBy(F.col("job_id").alias("id")).agg(
        F.min(F.when(gone | (ok & act.isin(*(a for a, _ in STATUS_OF_ACTION))), at)).alias("e"),
        F.min(F.when(gone, F.col("seg"))).alias("gone_seg"))
    # ``until``: the first segment whose score-all no longer finds the posting FETCHED (null: none)
    facts = cut_lineage(
        postings.select("id", (F.coalesce("status", F.lit("FETCHED")) == "FETCHED").alias("fetched"),
                        F.coalesce("processing_status", F.lit("IDLE")).alias("p0"))
        .join(ends, "id", "left")
        .join(segments.select("seg", "s1"), F.col("e.seg") == F.col("seg"), "left")
        .select("id", "fetched", "p0", "gone_seg", (F.col("e.seg") + F.when(F.col("s1") < F.col("e.seq"), 1).otherwise(0)).alias("until")))
    # Own business of a posting in a segment: its first analyze, or that it was busy from the start.
    own = (o.filter(ok & (act == "analyze")).select(F.col("job_id").alias("id"), "seg", "seq")
           .unionByName(facts.filter(F.col("p0").isin("QUEUED", "PROCESSING")).select("id", F.lit(0).cast("long").alias("seg"),
                                                                                     F.lit(-(1 << 63)).alias("seq")))
           .groupBy("id", "seg").agg(F.min("seq").alias("a1"), F.max("seq").alias("a2")))

    def n(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0))

    reached = F.col("fetched") & F.col("s1").isNotNull() & (F.col("until").isNull() | (F.col("seg") < F.col("until")))
    own_counts = own.join(segments, "seg").join(facts, "id").groupBy("seg").agg(
        n(reached & (F.col("a1") < F.col("s1"))).alias("busy_before"),
        n(~reached & (F.col("gone_seg").isNull() | (F.col("gone_seg") != F.col("seg")))).alias("own_only"))
    deleted = facts.filter(F.col("fetched") & (F.col("gone_seg") < F.col("until"))).groupBy(F.col("gone_seg").alias("seg")) \
        .agg(F.count(F.lit(1)).alias("deleted"))
    fetched = facts.filter("fetched").agg(F.count(F.lit(1)).alias("n_fetched"))
    drops = facts.filter("fetched AND until IS NOT NULL").groupBy(F.col("until").alias("seg")).agg(F.count(F.lit(1)).alias("n"))
    steps = (drops.withColumns({"kind": F.lit(0), "s1": F.lit(None).cast("long"), "c": F.lit(None).cast("long")})
             .unionByName(segments.withColumns({"kind": F.lit(1), "n": F.lit(0).cast("long")})).withColumn("_all", F.lit(0)))
    running = running_before(steps, "_all", F.floor(F.col("seg") / SEQ_SLICE), ["seg", "kind"], F.col("n"), name="dropped")
    counted = (running.filter("kind = 1").select("seg", "s1", "c", "dropped")
               .join(own_counts, "seg", "left").join(deleted, "seg", "left").join(F.broadcast(fetched), F.lit(True))
               .na.fill(0, ["busy_before", "own_only", "deleted"])
               .withColumn("reach", F.when(F.col("s1").isNotNull(), F.col("n_fetched") - F.col("dropped")).otherwise(0)))
    first_score, cancels = (F.col("reach") - F.col("busy_before")), (F.col("reach") - F.col("deleted") + F.col("own_only"))
    commands = log.filter(command).join(counted, "seg").select(
        "seq", "job_id", "action", F.concat(F.lit("count="), F.when(act == "cancel_queue", cancels)
                                            .when(F.col("seq") == F.col("s1"), first_score).otherwise(0).cast("string")).alias("outcome"))

    done, outcomes = _fold(postings, o)
    now = own.filter(F.col("seg") == last).select("id", F.when(F.col("a2") >= 0, F.lit("QUEUED")).alias("_own"), F.lit(True).alias("_busy"))
    held = facts.select("id", (F.col("fetched") & F.lit(last_s1 is not None) & (
        F.col("until").isNull() | (F.col("until") > last))).alias("_reached"))
    idle = F.lit("IDLE") if last else F.col("processing_status")
    processing = (F.when(F.col("_busy"), F.coalesce("_own", "processing_status"))
                  .when(F.col("_reached"), F.lit("QUEUED")).otherwise(idle))
    start = postings.select("id", F.col("processing_status").alias("_start"))
    done = (done.drop("processing_status").join(start.withColumnRenamed("_start", "processing_status"), "id")
            .join(held, "id").join(now, "id", "left").withColumn("processing_status", processing).select(*postings.columns))
    return done, outcomes.unionByName(commands)


def operation_counts(outcomes: DataFrame) -> DataFrame:
    """Counts per (operation, outcome)."""
    return outcomes.groupBy("action", "outcome").agg(F.count(F.lit(1)).alias("n"))


def command_results(outcomes: DataFrame) -> DataFrame:
    """(seq, action, affected, message) of the global commands of a folded log."""
    n = F.regexp_extract("outcome", "^count=([0-9]+)$", 1).cast("long")
    return (outcomes.filter(F.col("action").isin(*GLOBAL_ACTIONS)).select("seq", "action", n.alias("affected"))
            .withColumn("message", result_text(F.col("action"), F.col("affected"))))


def result_text(operation: Column, n: Column) -> Column:
    """The text a bulk operation answers with: ``score_all``, ``cancel_queue`` or ``scan``."""
    texts = S.RESULT_TEXTS
    return (F.when((operation == "score_all") & (n == 0), F.lit(texts["score_none"]))
             .when(operation == "score_all", F.format_string(texts["score_all"], n))
             .when(operation == "cancel_queue", F.format_string(texts["cancel_queue"], n))
             .when(operation == "scan", F.format_string(texts["scan"], n)))


def scan_result(added: DataFrame) -> DataFrame:
    """One row (message, added) for the postings that a scan added."""
    return added.agg(F.count(F.lit(1)).alias("added")).select(
        result_text(F.lit("scan"), F.col("added")).alias("message"), "added")


# ------------------------------------------------------------------ profile / persona logs

PROFILE_PATCH_KEYS = [("searchKeyword", "search_keyword", "string"),
                      ("minMatchScore", "min_match_score", "int"),
                      ("maxJobAgeDays", "max_job_age_days", "int"),
                      ("systemPrompt", "system_prompt", "string"),
                      ("aiModel", "ai_model", "string")]


def apply_profile_patches(profiles: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches (seq, profile_id, key, value): only keys present change;
    last patch per (profile, key) wins.  Integer settings take the text as
    Java's parseInt does (optional sign and digits, int range, no spaces); a
    patch that does not parse is a rejected request and changes nothing, so
    the last parsable one wins."""
    v = F.col("value")
    parses = v.rlike("^[+-]?[0-9]+$") & v.try_cast("int").isNotNull()
    aggs = []
    for k, c, t in PROFILE_PATCH_KEYS:
        ok = (F.col("key") == k) & (parses if t == "int" else F.lit(True))
        aggs.append(F.max_by(v, F.when(ok, F.col("seq"))).alias(f"_{c}"))
        aggs.append(F.max(F.when(ok, F.lit(True))).alias(f"_has_{c}"))
    agg = patches.groupBy("profile_id").agg(*aggs)
    j = profiles.join(agg.withColumnRenamed("profile_id", "id"), "id", "left")
    cols = []
    for f in profiles.columns:
        hit = [x for x in PROFILE_PATCH_KEYS if x[1] == f]
        if hit:
            _, c, t = hit[0]
            new = F.col(f"_{c}").try_cast("int") if t == "int" else F.col(f"_{c}")
            cols.append(F.when(F.coalesce(F.col(f"_has_{c}"), F.lit(False)), new).otherwise(F.col(f)).alias(f))
        else:
            cols.append(F.col(f))
    return j.select(*cols)


def apply_persona_log(personas: DataFrame, log: DataFrame) -> DataFrame:
    """Log (seq, op, persona_id, profile_id, name, role, prompt).

    ``create`` appends a persona (name default "New Persona", role ""),
    ``prompt`` sets prompt_override of a persona that exists by then, last
    wins; a prompt that comes before its persona is not found and changes
    nothing.
    """
    creates = log.filter(F.col("op") == "create")
    created = creates.select(
        F.col("persona_id").alias("id"), F.col("profile_id"),
        F.coalesce("name", F.lit(S.DEFAULT_PERSONA_NAME)).alias("persona_name"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.lit(None).cast("string").alias("prompt_override"),
        F.lit(None).cast("string").alias("cv_path"),
        F.lit(False).alias("is_default"))
    allp = personas.unionByName(created)
    # a stored persona exists from the start (no sequence number)
    since = (personas.select("id", F.lit(None).cast("long").alias("_since"))
             .unionByName(creates.groupBy(F.col("persona_id").alias("id")).agg(F.min("seq").alias("_since")))
             .groupBy("id").agg(F.min(F.coalesce("_since", F.lit(-(1 << 63)))).alias("_since")))
    upd = (log.filter(F.col("op") == "prompt").select(F.col("persona_id").alias("id"), "seq", "prompt")
              .join(since, "id").filter(F.col("seq") > F.col("_since"))
              .groupBy("id").agg(F.max_by("prompt", "seq").alias("_prompt"), F.lit(True).alias("_upd")))
    return (allp.join(upd, "id", "left")
                .withColumn("prompt_override", F.when(F.col("_upd"), F.col("_prompt")).otherwise(F.col("prompt_override")))
                .drop("_prompt", "_upd"))


def clear(postings: DataFrame, apps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Release busy rows, then remove applications, then postings (child
    before parent).  Returns the two empty tables to overwrite with."""
    none = F.lit(False)
    return postings.filter(none), apps.filter(none)


def delete_postings(postings: DataFrame, apps: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete the given posting ids except those an application
    references (FK without cascade).  Returns (postings', blocked ids)."""
    referenced = apps.select(F.col("job_id").alias("id")).distinct()
    blocked = ids.join(referenced, "id", "left_semi")
    deletable = ids.join(referenced, "id", "left_anti")
    return postings.join(deletable, "id", "left_anti"), blocked


def delete_profiles(profiles: DataFrame, personas: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deleting a profile deletes its personas (cascade)."""
    return (profiles.join(ids, "id", "left_anti"),
            personas.join(ids.withColumnRenamed("id", "profile_id"), "profile_id", "left_anti"))


def action_changes(postings: DataFrame, apps: DataFrame, actions: DataFrame) -> DataFrame:
    """Per touched posting, the net change of the per-posting actions:
    (job_id, new_status, queued, new_notes, deleted, n_actions).  The batch
    twin of the live state stream (R4): a deleted posting has no other change."""
    return changes_of(_job_state(action_outcomes(postings, apps, actions)))


def changes_of(state: DataFrame) -> DataFrame:
    live = ~F.col("deleted")
    return state.select(
        "job_id", F.when(live, F.col("new_status")).alias("new_status"), (live & F.col("queued")).alias("queued"),
        F.when(live, F.col("new_notes")).alias("new_notes"), "deleted", "n_actions")
