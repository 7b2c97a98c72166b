"""Registered mail queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mailbox as MB
from . import bindings as B
from .catalog import register, with_ctes

MAIL_SQL = with_ctes("posting", "message") + """,
act AS (SELECT lower(company) AS company_l, id,
               row_number() OVER (PARTITION BY lower(company) ORDER BY created_at, id) AS rk
        FROM posting
        WHERE coalesce(status, 'FETCHED') NOT IN ('REJECTED', 'HIRED') AND company IS NOT NULL AND lower(company) <> ''),
msg AS (SELECT message_id, lower(from_addr) AS from_l, lower(coalesce(subject, '')) AS subj_l,
               subject, body, received_at FROM message),
kind AS (SELECT *,
               CASE WHEN (contains(subj_l, 'update') OR contains(subj_l, 'status') OR contains(subj_l, 'unfortunate')
                          OR contains(subj_l, 'rejection'))
                         AND (contains(lower(coalesce(body, '')), 'unfortunately') OR contains(subj_l, 'unfortunately')
                              OR contains(lower(coalesce(body, '')), 'other candidates')) THEN 'rejected'
                    WHEN (contains(subj_l, 'update') OR contains(subj_l, 'status') OR contains(subj_l, 'unfortunate')
                          OR contains(subj_l, 'rejection'))
                         AND (contains(lower(coalesce(body, '')), 'interview') OR contains(subj_l, 'interview')
                              OR contains(lower(coalesce(body, '')), 'next steps')) THEN 'interviewing'
                    ELSE 'unchanged' END AS kind
         FROM msg),
-- no two company names of the driver tables contain each other, so a message names one at most
named AS (SELECT message_id, received_at, kind, company_l
          FROM kind JOIN (SELECT DISTINCT company_l FROM act) c
            ON contains(from_l, company_l) OR contains(subj_l, company_l)),
ranked AS (SELECT *, 1 + coalesce(sum(CAST(kind = 'rejected' AS INTEGER)) OVER (PARTITION BY company_l
             ORDER BY received_at, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rk FROM named),
m AS (SELECT message_id, id AS posting_id FROM ranked JOIN act USING (company_l, rk)),
cls AS (SELECT kind.message_id, m.posting_id, kind.received_at,
               CASE WHEN m.posting_id IS NULL THEN 'pending' ELSE kind END AS outcome
        FROM kind LEFT JOIN m ON m.message_id = kind.message_id)"""


def _outcomes(spark, sf):
    return MB.classify_messages(B.messages(spark, sf), B.postings(spark, sf))


@register("match_messages", MAIL_SQL + "\nSELECT message_id, posting_id FROM m")
def q_match_messages(spark, sf):
    return MB.match_messages(B.messages(spark, sf), B.postings(spark, sf))


@register("classify_messages", MAIL_SQL + "\nSELECT message_id, CAST(posting_id AS DOUBLE) AS posting_id, outcome FROM cls")
def q_classify_messages(spark, sf):
    # posting_id is null for pending mail: reported as DOUBLE (see queries_views)
    return _outcomes(spark, sf).select("message_id", F.col("posting_id").cast("double").alias("posting_id"), "outcome")


@register("mail_outcome_counts", MAIL_SQL + "\nSELECT outcome, count(*) AS n FROM cls GROUP BY outcome")
def q_mail_outcome_counts(spark, sf):
    return _outcomes(spark, sf).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@register("pending_mail", MAIL_SQL + "\nSELECT message_id FROM cls WHERE outcome = 'pending'")
def q_pending_mail(spark, sf):
    m = B.messages(spark, sf)
    return MB.pending_mail(m, MB.classify_messages(m, B.postings(spark, sf))).select("message_id")


@register("apply_mail_outcomes", MAIL_SQL + """,
ch AS (SELECT posting_id, arg_max(outcome, (received_at, message_id)) AS o FROM cls
       WHERE outcome IN ('rejected', 'interviewing') GROUP BY posting_id)
SELECT p.id, CASE ch.o WHEN 'rejected' THEN 'REJECTED' WHEN 'interviewing' THEN 'INTERVIEWING' ELSE p.status END
         AS status
FROM posting p LEFT JOIN ch ON ch.posting_id = p.id""")
def q_apply_mail_outcomes(spark, sf):
    p = B.postings(spark, sf)
    return MB.apply_mail_outcomes(p, MB.classify_messages(B.messages(spark, sf), p)).select("id", "status")


@register("rejection_memory", MAIL_SQL + """
SELECT c.message_id,
       'Rejection for ' || p.title || ' at ' || p.company || ': ' || coalesce(msg.body, '') AS content,
       'rejection_learning' AS meta_type, p.company AS meta_company, p.title AS meta_job_title
FROM cls c JOIN posting p ON p.id = c.posting_id JOIN msg ON msg.message_id = c.message_id
WHERE c.outcome = 'rejected'""")
def q_rejection_memory(spark, sf):
    m = B.messages(spark, sf)
    p = B.postings(spark, sf)
    reasons = m.select("message_id", F.col("body").alias("reason"))
    r = MB.rejection_memory(MB.classify_messages(m, p), p, reasons)
    return r.select("message_id", "content", F.col("metadata")["type"].alias("meta_type"),
                    F.col("metadata")["company"].alias("meta_company"),
                    F.col("metadata")["jobTitle"].alias("meta_job_title"))
