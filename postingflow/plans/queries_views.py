"""Registered view queries: board, statistics, filters, lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import preview
from ..operators import views as V
from . import bindings as B
from .catalog import register, with_ctes
from .oracle_sql import NOW_SQL

# Nullable integer outputs are reported as DOUBLE in both engines: pandas
# turns a Spark int column with nulls into float64 but a DuckDB one into a
# nullable Int, which would make equal values hash differently.
def list_cols():
    return ["id", "reference_id", "status", "processing_status",
            F.col("match_score").cast("double").alias("match_score"), "created_at"]
LIST_SQL = "id, reference_id, status, processing_status, CAST(match_score AS DOUBLE) AS match_score, created_at"
ST = "coalesce(status, 'FETCHED')"


@register("pipeline_stats", with_ctes("posting") + f"""
SELECT count(*) FILTER (WHERE {ST} = 'FETCHED') AS inbox,
       count(*) FILTER (WHERE {ST} = 'SCORED') AS ai_review,
       count(*) FILTER (WHERE {ST} = 'APPROVED') AS ready_to_dispatch,
       count(*) FILTER (WHERE {ST} = 'APPLIED') AS dispatched,
       CAST(coalesce(floor(avg(match_score) FILTER (WHERE match_score > 0) + 0.5), 0) AS BIGINT) AS avg_score,
       count(*) AS total_in_db,
       count(*) FILTER (WHERE {ST} = 'FETCHED') AS pending_scoring
FROM posting""")
def q_pipeline_stats(spark, sf):
    return V.pipeline_stats(B.postings(spark, sf, with_customer=False))


@register("weekly_stats", with_ctes("posting") + f"""
SELECT count(*) FILTER (WHERE scored_at > {NOW_SQL} - INTERVAL 7 DAY) AS scored_this_week,
       count(*) FILTER (WHERE scored_at > {NOW_SQL} - INTERVAL 7 DAY AND {ST} = 'APPLIED') AS dispatched_this_week,
       CAST(coalesce(trunc(avg(match_score)), 0) AS BIGINT) AS avg_score,
       count(*) FILTER (WHERE {ST} <> 'FETCHED') AS total_in_pipeline
FROM posting""")
def q_weekly_stats(spark, sf):
    return V.weekly_stats(B.postings(spark, sf, with_customer=False), B.NOW)


BOARD_DIM_SQL = """board_dim AS (SELECT * FROM (VALUES (1, 'discovery', 'New Matches', 'FETCHED'),
  (2, 'scored', 'Scored', 'SCORED'), (3, 'applied', 'Applied', 'APPROVED'),
  (4, 'interviewing', 'Interviewing', 'APPLIED')) t(col_pos, col_id, col_title, col_status))"""


@register("board", with_ctes("posting") + "," + BOARD_DIM_SQL + f"""
SELECT d.col_pos, d.col_id, d.col_title, p.id AS card_id, p.company AS card_company,
       p.title AS card_title,
       CASE WHEN p.id IS NULL THEN NULL ELSE CAST(coalesce(p.match_score, 0) AS BIGINT) END AS card_score,
       CASE WHEN p.id IS NULL THEN NULL ELSE 'Location Unspecified' END AS card_location,
       CASE WHEN length(p.description) > 100 THEN substr(p.description, 1, 100) || '...'
            ELSE p.description END AS card_preview
FROM board_dim d LEFT JOIN posting p ON {ST.replace('status', 'p.status')} = d.col_status""")
def q_board(spark, sf):
    return V.board(B.postings(spark, sf))


@register("board_counts", with_ctes("posting") + "," + BOARD_DIM_SQL + f"""
SELECT d.col_pos, d.col_id, d.col_title, CAST(count(p.id) AS BIGINT) AS n_cards
FROM board_dim d LEFT JOIN posting p ON {ST.replace('status', 'p.status')} = d.col_status
GROUP BY 1, 2, 3""")
def q_board_counts(spark, sf):
    return V.board_counts(B.postings(spark, sf, with_customer=False))


@register("board_nested", with_ctes("posting") + "," + BOARD_DIM_SQL + f""",
listed AS (SELECT {ST} AS col_status, id, company, title, coalesce(match_score, 0) AS score, created_at,
                  CASE WHEN length(description) > 100 THEN substr(description, 1, 100) || '...' ELSE description END AS reason,
                  row_number() OVER (PARTITION BY {ST} ORDER BY created_at DESC, id) AS n
           FROM posting),
first AS (SELECT col_status, string_agg(n || ':' || id || ':' || company || ':' || title || ':' || score || ':Location Unspecified:' || reason, '|' ORDER BY n)
            FILTER (WHERE n <= 25) AS jobs, count(*) AS total, max(created_at) FILTER (WHERE n = 25) AS next_at, max(id) FILTER (WHERE n = 25) AS next_id
          FROM listed GROUP BY col_status)
SELECT d.col_pos, d.col_id, d.col_title, CAST(coalesce(total, 0) AS BIGINT) AS total, coalesce(jobs, '') AS jobs,
       CASE WHEN total > 25 THEN CAST(next_at AS TIMESTAMP) END AS next_at, CAST(CASE WHEN total > 25 THEN next_id END AS DOUBLE) AS next_id
FROM board_dim d LEFT JOIN first USING (col_status)""")
def q_board_nested(spark, sf):
    # the cards as one text; the operator returns an array of structs
    b = V.board_nested(B.postings(spark, sf))
    text = F.transform("jobs", lambda c, i: F.concat_ws(":", (i + 1).cast("string"), c["id"].cast("string"), c["company"], c["title"],
                                                       c["score"].cast("string"), c["location"], c["matchReason"]))
    return b.select("col_pos", "col_id", "col_title", "total", F.array_join(text, "|").alias("jobs"), "next_at",
                    F.col("next_id").cast("double").alias("next_id"))


@register("by_status", with_ctes("posting") + f"""
SELECT {ST} AS status, count(*) AS n FROM posting GROUP BY 1""")
def q_by_status(spark, sf):
    return V.by_status(B.postings(spark, sf, with_customer=False))


@register("score_bands", with_ctes("posting") + f"""
SELECT {ST} AS status,
       CASE WHEN match_score IS NULL THEN 'none'
            WHEN match_score BETWEEN 90 AND 100 THEN '90-100'
            WHEN match_score BETWEEN 75 AND 89 THEN '75-89'
            WHEN match_score BETWEEN 55 AND 74 THEN '55-74'
            WHEN match_score BETWEEN 35 AND 54 THEN '35-54'
            WHEN match_score BETWEEN 0 AND 34 THEN '0-34'
            ELSE 'out_of_range' END AS band,
       count(*) AS n
FROM posting GROUP BY 1, 2""")
def q_score_bands(spark, sf):
    return V.score_bands(B.postings(spark, sf, with_customer=False))


def _list(name, pred_sql, fn, with_customer=False):
    register(name, with_ctes("posting") + f"SELECT {LIST_SQL} FROM posting WHERE {pred_sql}")(
        lambda spark, sf: fn(B.postings(spark, sf, with_customer)).select(*list_cols()))


_list("inbox", f"{ST} = 'FETCHED'", V.inbox)
_list("in_pipeline", "status IS NOT NULL AND status <> 'FETCHED'", V.pipeline)
_list("busy", "processing_status IN ('QUEUED', 'PROCESSING')", V.busy)
_list("idle", "processing_status = 'IDLE'", V.idle)
_list("active", f"{ST} NOT IN ('REJECTED', 'HIRED')", V.active)
_list("scored_since", f"scored_at > {NOW_SQL} - INTERVAL 7 DAY", lambda d: V.scored_since(d, B.NOW))
_list("max_age", f"created_at >= {NOW_SQL} - INTERVAL 30 DAY", lambda d: V.max_age(d, 30, B.NOW))
_list("min_score", "match_score >= 75", lambda d: V.min_score(d, 75))
_list("keyword", "contains(lower(title), 'machinery') OR contains(lower(description), 'machinery')",
      lambda d: V.keyword(d, "Machinery"), with_customer=True)


@register("by_reference", with_ctes("posting") + f"""
SELECT {LIST_SQL} FROM posting
WHERE reference_id IN (SELECT 'REF-' || CAST(l_orderkey AS VARCHAR) FROM lineitem)""")
def q_by_reference(spark, sf):
    keys = (B.table(spark, sf, "lineitem")
            .select(F.concat(F.lit("REF-"), F.col("l_orderkey").cast("string")).alias("reference_id")))
    return V.by_reference(B.postings(spark, sf, with_customer=False), keys).select(*list_cols())


@register("capped_inbox", with_ctes("posting") + f"""
SELECT id, title, company, created_at,
       (SELECT count(*) FROM posting WHERE {ST} = 'FETCHED') AS total_fetched
FROM posting WHERE {ST} = 'FETCHED' ORDER BY created_at, id LIMIT 50""")
def q_capped_inbox(spark, sf):
    return V.capped_inbox(B.postings(spark, sf), 50)


@register("first_application", with_ctes("application") + """
SELECT job_id, arg_min(id, (created_at, id)) AS id,
       arg_min(cv_path, (created_at, id)) AS cv_path,
       arg_min(letter_path, (created_at, id)) AS letter_path,
       min(created_at) AS created_at
FROM application GROUP BY job_id""")
def q_first_application(spark, sf):
    a = B.applications(spark, sf).select("id", "job_id", "cv_path", "letter_path", "created_at")
    return V.first_application(a).select("job_id", "id", "cv_path", "letter_path", "created_at")


@register("has_application", with_ctes("posting") + """
SELECT id, status, id IN (SELECT l_orderkey FROM lineitem) AS has_application FROM posting""")
def q_has_application(spark, sf):
    p = B.postings(spark, sf, with_customer=False).select("id", "status")
    return V.has_application(p, B.applications(spark, sf).select("job_id"))


@register("cards", with_ctes("posting") + f"""
SELECT id, title, company AS employer, {ST} AS status, CAST(match_score AS DOUBLE) AS score, ai_analysis AS analysis,
       coalesce(portal_url, CASE WHEN hash_id IS NOT NULL THEN '{S.PORTAL_BASE}' || hash_id END) AS portal_url, notes,
       strftime(scored_at, '%Y-%m-%dT%H:%M')
         || CASE WHEN microsecond(scored_at) % 1000000 <> 0
                 THEN strftime(scored_at, ':%S.') || CASE WHEN microsecond(scored_at) % 1000 = 0
                      THEN lpad(CAST(microsecond(scored_at) % 1000000 // 1000 AS VARCHAR), 3, '0')
                      ELSE lpad(CAST(microsecond(scored_at) % 1000000 AS VARCHAR), 6, '0') END
                 WHEN second(scored_at) <> 0 THEN strftime(scored_at, ':%S') ELSE '' END AS scored_at_text,
       id IN (SELECT l_orderkey FROM lineitem) AS has_application
FROM posting""")
def q_cards(spark, sf):
    c = V.to_cards(B.postings(spark, sf), B.applications(spark, sf).select("job_id"))
    return c.withColumn("score", F.col("score").cast("double"))


@register("preview", """
SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview,
       length(text) > 100 AS cut
FROM documents""")
def q_preview(spark, sf):
    d = B.long_texts(spark, sf)
    return d.select("doc_id", preview("text").alias("preview"), (F.length("text") > 100).alias("cut"))
