"""Registered queue and action-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import actions as A
from ..operators import queueing as Q
from . import bindings as B
from .catalog import register, with_ctes

OUTCOME_SQL = """,
apps AS (SELECT DISTINCT l_orderkey AS job_id FROM lineitem),
a AS (SELECT act.*, p.id IS NOT NULL AS job_exists, ap.job_id IS NOT NULL AS has_app
      FROM action act LEFT JOIN (SELECT id FROM posting) p ON p.id = act.job_id
      LEFT JOIN apps ap ON ap.job_id = act.job_id),
cuts AS (SELECT job_id, min(seq) AS cut_seq FROM a
         WHERE action = 'reject' AND job_exists AND NOT has_app GROUP BY job_id),
o AS (SELECT a.*, CASE WHEN NOT job_exists THEN 'not_found'
                       WHEN c.cut_seq IS NOT NULL AND a.seq > c.cut_seq THEN 'not_found'
                       WHEN a.action = 'reject' AND has_app THEN 'blocked'
                       WHEN a.action = 'reject' THEN 'deleted'
                       WHEN a.action = 'dispatched' AND NOT has_app THEN 'no_application'
                       ELSE 'ok' END AS outcome
      FROM a LEFT JOIN cuts c ON a.job_id = c.job_id)"""


@register("action_outcomes", with_ctes("posting", "action") + OUTCOME_SQL + """
SELECT seq, job_id, action, outcome FROM o""")
def q_action_outcomes(spark, sf):
    return A.action_outcomes(B.postings(spark, sf, with_customer=False), B.applications(spark, sf),
                             B.actions(spark, sf)).select("seq", "job_id", "action", "outcome")


@register("operation_counts", with_ctes("posting", "action") + OUTCOME_SQL + """
SELECT action, outcome, count(*) AS n FROM o GROUP BY 1, 2""")
def q_operation_counts(spark, sf):
    o = A.action_outcomes(B.postings(spark, sf, with_customer=False), B.applications(spark, sf),
                          B.actions(spark, sf))
    return A.operation_counts(o)


COMMAND_SQL = with_ctes("posting", "action") + """,
logged AS (SELECT seq, job_id, CASE WHEN seq % 200 = 0 THEN 'score_all' WHEN seq % 200 = 100 THEN 'cancel_queue' ELSE action END AS action
           FROM action),
apps AS (SELECT DISTINCT l_orderkey AS job_id FROM lineitem),
a AS (SELECT l.*, p.id IS NOT NULL AS job_exists, ap.job_id IS NOT NULL AS has_app
      FROM logged l LEFT JOIN (SELECT id FROM posting) p ON p.id = l.job_id LEFT JOIN apps ap ON ap.job_id = l.job_id
      WHERE action NOT IN ('score_all', 'cancel_queue')),
cuts AS (SELECT job_id, min(seq) AS cut_seq FROM a WHERE action = 'reject' AND job_exists AND NOT has_app GROUP BY job_id),
ok AS (SELECT a.* FROM a LEFT JOIN cuts c USING (job_id)
       WHERE job_exists AND (c.cut_seq IS NULL OR a.seq < c.cut_seq) AND action <> 'reject' AND (action <> 'dispatched' OR has_app)),
p AS (SELECT id, coalesce(status, 'FETCHED') = 'FETCHED' AS fetched, coalesce(processing_status, 'IDLE') AS p0, cut_seq,
             least((SELECT min(seq) FROM ok WHERE ok.job_id = posting.id AND action IN ('approve', 'ignore', 'dispatched')), cut_seq) AS status_end
      FROM posting LEFT JOIN cuts ON cuts.job_id = posting.id),
cmd AS (SELECT seq, action, (SELECT max(seq) FROM logged x WHERE x.action = 'cancel_queue' AND x.seq < l.seq) AS c
        FROM logged l WHERE action IN ('score_all', 'cancel_queue')),
-- what makes a posting busy between the cancel before a command and the command
an AS (SELECT DISTINCT cmd.seq, ok.job_id FROM cmd JOIN ok ON ok.action = 'analyze' AND ok.seq < cmd.seq AND ok.seq > coalesce(c, -1)),
sc AS (SELECT DISTINCT cmd.seq, p.id FROM cmd JOIN logged s ON s.action = 'score_all' AND s.seq < cmd.seq AND s.seq > coalesce(c, -1)
       JOIN p ON p.fetched AND (p.status_end IS NULL OR p.status_end > s.seq)),
state AS (SELECT cmd.seq, cmd.action, p.fetched AND (status_end IS NULL OR status_end > cmd.seq) AS fetched_now,
                 an.job_id IS NOT NULL OR sc.id IS NOT NULL OR (cmd.c IS NULL AND p0 IN ('QUEUED', 'PROCESSING')) AS busy
          FROM cmd JOIN p ON p.cut_seq IS NULL OR p.cut_seq > cmd.seq
          LEFT JOIN an ON an.seq = cmd.seq AND an.job_id = p.id LEFT JOIN sc ON sc.seq = cmd.seq AND sc.id = p.id),
counts AS (SELECT seq, action, CASE action WHEN 'score_all' THEN count(*) FILTER (WHERE fetched_now AND NOT busy)
                                           ELSE count(*) FILTER (WHERE busy) END AS n
           FROM state GROUP BY seq, action)"""


def _commanded(spark, sf):
    """The action log in which every hundredth entry is a global command."""
    a = B.actions(spark, sf)
    command = F.when(F.col("seq") % 200 == 0, "score_all").when(F.col("seq") % 200 == 100, "cancel_queue")
    return A.apply_log(B.postings(spark, sf), B.applications(spark, sf), a.withColumn("action", F.coalesce(command, "action")))


@register("command_results", COMMAND_SQL + """
SELECT seq, action, n AS affected, CASE WHEN action = 'cancel_queue' THEN 'Queue drained — ' || n || ' job(s) cancelled.'
            WHEN n > 0 THEN 'Queued ' || n || ' jobs for AI scoring. Check the Activity Log for progress.'
            ELSE 'No unscored jobs found in your inbox.' END AS message
FROM counts""")
def q_command_results(spark, sf):
    return A.command_results(_commanded(spark, sf)[1]).select("seq", "action", "affected", "message")


@register("command_states", COMMAND_SQL + """,
last AS (SELECT max(seq) FILTER (WHERE action = 'cancel_queue') AS c FROM cmd)
SELECT p.id, CASE WHEN EXISTS (SELECT 1 FROM ok WHERE ok.job_id = p.id AND action = 'analyze' AND seq > coalesce(c, -1)) THEN 'QUEUED'
                  WHEN c IS NULL AND p0 IN ('QUEUED', 'PROCESSING') THEN p0
                  WHEN EXISTS (SELECT 1 FROM logged s WHERE s.action = 'score_all' AND s.seq > coalesce(c, -1)
                                 AND p.fetched AND (p.status_end IS NULL OR p.status_end > s.seq)) THEN 'QUEUED'
                  ELSE 'IDLE' END AS processing_status
FROM p, last WHERE cut_seq IS NULL""")
def q_command_states(spark, sf):
    p = _commanded(spark, sf)[0]
    return p.select("id", F.coalesce("processing_status", F.lit("IDLE")).alias("processing_status"))


@register("apply_actions", with_ctes("posting", "action") + OUTCOME_SQL + """,
st AS (SELECT job_id,
              arg_max(CASE action WHEN 'approve' THEN 'APPROVED' WHEN 'ignore' THEN 'REJECTED'
                                  WHEN 'dispatched' THEN 'APPLIED' END, seq)
                FILTER (WHERE action IN ('approve', 'ignore', 'dispatched')) AS new_status,
              bool_or(action = 'analyze') AS queued,
              arg_max(coalesce(arg, ''), seq) FILTER (WHERE action = 'notes') AS new_notes,
              bool_or(action = 'dispatched') AS dispatched
       FROM o WHERE outcome = 'ok' GROUP BY job_id)
SELECT p.id, coalesce(st.new_status, p.status) AS status,
       CASE WHEN st.queued THEN 'QUEUED' ELSE p.processing_status END AS processing_status,
       coalesce(st.new_notes, p.notes) AS notes,
       CASE WHEN st.dispatched THEN coalesce(nullif(p.employer_email, ''),
              'hr@' || regexp_replace(lower(p.company), '[^a-z0-9]', '', 'g') || '.de')
            ELSE p.employer_email END AS employer_email
FROM posting p LEFT JOIN st ON st.job_id = p.id
WHERE p.id NOT IN (SELECT job_id FROM cuts)""")
def q_apply_actions(spark, sf):
    p, _ = A.apply_actions(B.postings(spark, sf), B.applications(spark, sf), B.actions(spark, sf))
    return p.select("id", "status", "processing_status", "notes", "employer_email")


@register("score_all", with_ctes("posting") + """
SELECT count(*) FILTER (WHERE coalesce(status, 'FETCHED') = 'FETCHED' AND processing_status = 'IDLE') AS queued
FROM posting""")
def q_score_all(spark, sf):
    return A.score_all(B.postings(spark, sf, with_customer=False))[1]


@register("cancel_queue", with_ctes("posting") + """
SELECT count(*) FILTER (WHERE processing_status IN ('QUEUED', 'PROCESSING')) AS cancelled FROM posting""")
def q_cancel_queue(spark, sf):
    return A.cancel_queue(B.postings(spark, sf, with_customer=False))[1]


@register("claim", with_ctes("posting") + """
SELECT id, created_at, 'PROCESSING' AS processing_status FROM posting
WHERE coalesce(status, 'FETCHED') = 'FETCHED' AND processing_status = 'QUEUED'
ORDER BY created_at, id LIMIT 5""")
def q_claim(spark, sf):
    claimed, _ = Q.claim(B.postings(spark, sf, with_customer=False), 5)
    return claimed.select("id", "created_at", "processing_status")


@register("claim_release_states", with_ctes("posting") + """,
c AS (SELECT id FROM posting WHERE coalesce(status, 'FETCHED') = 'FETCHED' AND processing_status = 'QUEUED'
      ORDER BY created_at, id LIMIT 5)
SELECT CASE WHEN id IN (SELECT id FROM c) THEN 'IDLE' ELSE processing_status END AS processing_status,
       count(*) AS n
FROM posting GROUP BY 1""")
def q_claim_release_states(spark, sf):
    claimed, updated = Q.claim(B.postings(spark, sf, with_customer=False), 5)
    released = Q.release(updated, claimed.select("id"))
    return released.groupBy("processing_status").agg(F.count(F.lit(1)).alias("n"))


@register("assign", with_ctes("posting") + """
SELECT id, created_at, CAST(claim_rank AS INTEGER) AS claim_rank, CAST((claim_rank - 1) % 3 AS INTEGER) AS worker FROM (
  SELECT id, created_at, row_number() OVER (ORDER BY created_at, id) AS claim_rank FROM (
    SELECT id, created_at FROM posting
    WHERE coalesce(status, 'FETCHED') = 'FETCHED' AND processing_status = 'QUEUED'
    ORDER BY created_at, id LIMIT 20))""")
def q_assign(spark, sf):
    return Q.assign(B.postings(spark, sf, with_customer=False), 20, 3).select("id", "created_at", "claim_rank", "worker")


@register("page", with_ctes("posting") + """
SELECT id, created_at FROM posting ORDER BY created_at, id LIMIT 25 OFFSET 50""")
def q_page(spark, sf):
    return Q.page(B.postings(spark, sf, with_customer=False).select("id", "created_at"), 2, 25)


BREAKER_SQL = with_ctes("call") + """,
w AS (SELECT service, ts, call_id, failed, duration_s,
             count(*) OVER win AS window_calls,
             CAST(sum(CAST(failed AS BIGINT)) OVER win AS BIGINT) AS failures,
             CAST(sum(CAST(duration_s > 180.0 AS BIGINT)) OVER win AS BIGINT) AS slow_calls
      FROM call
      WINDOW win AS (PARTITION BY service ORDER BY ts, call_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT *, CASE WHEN window_calls = 10 AND (failures * 100.0 >= 80.0 * window_calls
                                         OR slow_calls * 100.0 >= 100.0 * window_calls)
               THEN 'OPEN' ELSE 'CLOSED' END AS state
FROM w"""


@register("breaker_windows", BREAKER_SQL)
def q_breaker_windows(spark, sf):
    return Q.breaker_windows(B.calls(spark, sf))


@register("delete_postings", with_ctes("posting") + """
SELECT id, id IN (SELECT l_orderkey FROM lineitem) AS blocked FROM posting WHERE status = 'REJECTED'""")
def q_delete_postings(spark, sf):
    p = B.postings(spark, sf, with_customer=False)
    ids = p.filter(F.col("status") == "REJECTED").select("id")
    _, blocked = A.delete_postings(p, B.applications(spark, sf), ids)
    return ids.join(blocked.withColumn("blocked", F.lit(True)), "id", "left") \
              .select("id", F.coalesce("blocked", F.lit(False)).alias("blocked"))


@register("page_after", with_ctes("posting") + """
SELECT id, created_at FROM posting
WHERE created_at > TIMESTAMP '1998-01-01 00:00:00' OR (created_at = TIMESTAMP '1998-01-01 00:00:00' AND id > 7000)
ORDER BY created_at, id LIMIT 25""")
def q_page_after(spark, sf):
    import datetime as dt
    p = B.postings(spark, sf, with_customer=False).select("id", "created_at")
    return Q.page_after(p, (dt.datetime(1998, 1, 1), 7000), 25)


@register("queue_commands", with_ctes("posting") + """
SELECT id, CASE WHEN coalesce(status, 'FETCHED') = 'FETCHED' AND processing_status = 'IDLE' THEN 'QUEUED'
                ELSE processing_status END AS after_score_all,
       CASE WHEN processing_status IN ('QUEUED', 'PROCESSING') THEN 'IDLE' ELSE processing_status END AS after_cancel
FROM posting""")
def q_queue_commands(spark, sf):
    p = B.postings(spark, sf, with_customer=False)
    scored = A.score_all(p)[0].select("id", F.col("processing_status").alias("after_score_all"))
    return scored.join(A.cancel_queue(p)[0].select("id", F.col("processing_status").alias("after_cancel")), "id")


@register("remaining_postings", with_ctes("posting") + """
SELECT id, status FROM posting WHERE coalesce(status, '') <> 'REJECTED' OR id IN (SELECT l_orderkey FROM lineitem)""")
def q_remaining_postings(spark, sf):
    p = B.postings(spark, sf, with_customer=False)
    ids = p.filter(F.col("status") == "REJECTED").select("id")
    return A.delete_postings(p, B.applications(spark, sf), ids)[0].select("id", "status")


@register("clear", with_ctes("posting", "application") + """
SELECT 'posting' AS name, (SELECT count(*) FROM posting) AS stored, CAST(0 AS BIGINT) AS kept
UNION ALL SELECT 'application', (SELECT count(*) FROM application), 0""")
def q_clear(spark, sf):
    p, a = B.postings(spark, sf, with_customer=False), B.applications(spark, sf)
    p2, a2 = A.clear(p, a)

    def counted(name, before, after):
        return (before.select(F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select(F.lit(0).alias("b"), F.lit(1).alias("a")))
                .agg(F.sum("b").alias("stored"), F.sum("a").alias("kept")).select(F.lit(name).alias("name"), "stored", "kept"))
    return counted("posting", p, p2).unionByName(counted("application", a, a2))
