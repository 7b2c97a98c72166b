"""Registered batch forms of the streaming operators.

The streaming runs themselves are checked by unit tests (availableNow over
one file and over several files with a restart must equal these)."""

from __future__ import annotations


from ..operators import actions as A
from ..streaming import streams as ST
from . import bindings as B
from .catalog import register, with_ctes
from .queries_actions import OUTCOME_SQL


@register("action_changes", with_ctes("posting", "action") + OUTCOME_SQL + """
SELECT job_id, CASE WHEN NOT deleted THEN new_status END AS new_status, queued AND NOT deleted AS queued,
       CASE WHEN NOT deleted THEN new_notes END AS new_notes, deleted, n_actions
FROM (SELECT job_id,
       arg_max(CASE action WHEN 'approve' THEN 'APPROVED' WHEN 'ignore' THEN 'REJECTED'
                           WHEN 'dispatched' THEN 'APPLIED' END, seq)
         FILTER (WHERE outcome = 'ok' AND action IN ('approve', 'ignore', 'dispatched')) AS new_status,
       coalesce(bool_or(action = 'analyze') FILTER (WHERE outcome = 'ok'), false) AS queued,
       arg_max(coalesce(arg, ''), seq) FILTER (WHERE outcome = 'ok' AND action = 'notes') AS new_notes,
       coalesce(bool_or(outcome = 'deleted'), false) AS deleted,
       count(*) AS n_actions
FROM o GROUP BY job_id)""")
def q_action_changes(spark, sf):
    return A.action_changes(B.postings(spark, sf, with_customer=False), B.applications(spark, sf),
                            B.actions(spark, sf))


@register("live_stats", with_ctes("posting", "action") + OUTCOME_SQL + """,
ch AS (SELECT job_id,
              arg_max(CASE action WHEN 'approve' THEN 'APPROVED' WHEN 'ignore' THEN 'REJECTED'
                                  WHEN 'dispatched' THEN 'APPLIED' END, seq)
                FILTER (WHERE outcome = 'ok' AND action IN ('approve', 'ignore', 'dispatched')) AS new_status,
              coalesce(bool_or(outcome = 'deleted'), false) AS deleted
       FROM o GROUP BY job_id)
SELECT coalesce(ch.new_status, p.status, 'FETCHED') AS status, count(*) AS n
FROM posting p LEFT JOIN ch ON ch.job_id = p.id
WHERE NOT coalesce(ch.deleted, false)
GROUP BY 1""")
def q_live_stats(spark, sf):
    p = B.postings(spark, sf, with_customer=False)
    ch = A.action_changes(p, B.applications(spark, sf), B.actions(spark, sf))
    return ST.stats_from_changes(p, ch)


@register("weekly_counts", with_ctes("posting", "action") + OUTCOME_SQL + """,
ev AS (SELECT ts, CASE action WHEN 'dispatched' THEN 'applied' WHEN 'approve' THEN 'approved' ELSE 'queued' END AS event
       FROM o WHERE outcome = 'ok' AND action IN ('dispatched', 'approve', 'analyze')
       UNION ALL
       SELECT scored_at, 'scored' FROM posting WHERE scored_at IS NOT NULL)
SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS window_start,
       time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 7 DAY AS window_end, event, count(*) AS n
FROM ev GROUP BY 1, 2, 3""")
def q_weekly_counts(spark, sf):
    p = B.postings(spark, sf, with_customer=False)
    o = A.action_outcomes(p, B.applications(spark, sf), B.actions(spark, sf))
    return ST.weekly_counts(ST.change_events(o).unionByName(ST.scored_events(p)))


@register("event_rows", with_ctes("posting", "action") + OUTCOME_SQL + """
SELECT 'JobFetched' AS event_type, id AS job_id, created_at AS ts FROM posting
UNION ALL
SELECT 'ApplicationScored', id, scored_at FROM posting WHERE scored_at IS NOT NULL
UNION ALL
SELECT 'ApplicationApproved', job_id, ts FROM o WHERE action = 'approve' AND outcome = 'ok'""")
def q_event_rows(spark, sf):
    p = B.postings(spark, sf, with_customer=False)
    a = B.actions(spark, sf)
    o = A.action_outcomes(p, B.applications(spark, sf), a)
    return ST.event_rows(p, o, a)
