"""Registered dispatch / settings queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import dispatch as DP
from . import bindings as B
from .catalog import register, with_ctes


def q_(s: str) -> str:
    """SQL string literal (newlines as chr(10))."""
    parts = s.replace("'", "''").split("\n")
    return " || chr(10) || ".join(f"'{p}'" for p in parts)


NB = "CASE WHEN {x} IS NOT NULL AND NOT regexp_matches({x}, '^\\s*$') THEN {x} END"

ARTIFACT_SQL = """,
files AS (SELECT 'cv_' || CAST(p_partkey AS VARCHAR) || '.pdf' AS path, CAST((p_size - 1) * 1000 AS BIGINT) AS length
          FROM part
          UNION ALL
          SELECT 'cl_' || CAST(o_orderkey AS VARCHAR) || '.pdf', CAST(floor(o_totalprice) AS BIGINT)
          FROM orders WHERE o_orderstatus <> 'P'),
first AS (SELECT job_id, arg_min(cv_path, (created_at, id)) AS cv_path,
                 arg_min(letter_path, (created_at, id)) AS letter_path
          FROM application GROUP BY job_id)"""


def _state_sql(path, length):
    return (f"CASE WHEN f.job_id IS NULL THEN 'no_application' "
            f"WHEN {NB.format(x=path)} IS NULL THEN 'blank_path' "
            f"WHEN {length} IS NULL THEN 'missing' WHEN {length} = 0 THEN 'empty_file' ELSE 'ok' END")


@register("audit_artifacts", with_ctes("posting", "application") + ARTIFACT_SQL + f"""
SELECT p.id, {_state_sql('f.cv_path', 'cf.length')} AS cv_state,
       {_state_sql('f.letter_path', 'lf.length')} AS letter_state
FROM posting p LEFT JOIN first f ON f.job_id = p.id
LEFT JOIN files cf ON cf.path = f.cv_path LEFT JOIN files lf ON lf.path = f.letter_path""")
def q_audit_artifacts(spark, sf):
    return DP.audit_artifacts(B.postings(spark, sf, with_customer=False).select("id"), B.applications(spark, sf),
                              B.artifact_files(spark, sf))


@register("dispatch_manifest", with_ctes("posting", "application") + ARTIFACT_SQL + f"""
SELECT p.id,
       CASE WHEN f.job_id IS NULL THEN 'skipped_no_application' ELSE 'send' END AS action,
       CASE WHEN f.job_id IS NOT NULL THEN coalesce({NB.format(x='o.override_email')}, nullif(p.employer_email, ''),
              'hr@' || regexp_replace(lower(p.company), '[^a-z0-9]', '', 'g') || '.de') END AS recipient,
       CASE WHEN f.job_id IS NOT NULL THEN {q_(S.DISPATCH_SUBJECT)} END AS subject,
       CASE WHEN f.job_id IS NOT NULL THEN {q_(S.DISPATCH_BODY_OPENING)} || (SELECT 'Regards, ' || n_name FROM nation
         ORDER BY CAST(n_nationkey AS VARCHAR) LIMIT 1) END AS body,
       CASE WHEN f.job_id IS NOT NULL AND cf.path IS NOT NULL THEN {q_(S.CV_ATTACHMENT_NAME)} END AS cv_attachment,
       CASE WHEN f.job_id IS NOT NULL AND lf.path IS NOT NULL THEN {q_(S.LETTER_ATTACHMENT_NAME)} END AS letter_attachment
FROM posting p LEFT JOIN first f ON f.job_id = p.id
LEFT JOIN (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'jobs' || CAST(o_custkey AS VARCHAR) || '@x.example'
                  ELSE ' ' END AS override_email FROM orders WHERE o_orderstatus = 'F') o ON o.id = p.id
LEFT JOIN (SELECT DISTINCT path FROM files) cf ON cf.path = f.cv_path
LEFT JOIN (SELECT DISTINCT path FROM files) lf ON lf.path = f.letter_path""")
def q_dispatch_manifest(spark, sf):
    o = B.table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F")
    overrides = o.select(F.col("o_orderkey").alias("id"), F.when(
        F.col("o_orderkey") % 2 == 0, F.concat(F.lit("jobs"), F.col("o_custkey").cast("string"), F.lit("@x.example")))
        .otherwise(F.lit(" ")).alias("override_email"))
    named = B.profiles(spark, sf).withColumn("email_signature", F.concat(F.lit("Regards, "), "full_name"))
    return DP.dispatch_manifest(B.postings(spark, sf), B.applications(spark, sf), overrides,
                                B.artifact_files(spark, sf), DP.effective_profile(named))


PROFILE_SQL = """prof AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS full_name,
         CASE WHEN n_regionkey = 0 THEN NULL ELSE lower(n_name) END AS search_keyword,
         CASE WHEN n_regionkey = 1 THEN ' ' ELSE 'llama3' END AS ai_model,
         CASE WHEN n_regionkey = 2 THEN NULL ELSE CAST(n_nationkey + 50 AS INTEGER) END AS min_match_score,
         CAST(NULL AS INTEGER) AS max_job_age_days
  FROM nation),
pers AS (
  SELECT lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS id, CAST(s_nationkey AS VARCHAR) AS profile_id,
         CASE WHEN s_acctbal < 0 THEN ' ' WHEN s_acctbal > 5000 THEN 'Override ' || s_name END AS prompt_override,
         CASE WHEN s_acctbal < 1000 THEN NULL ELSE 'cv_s' || CAST(s_suppkey AS VARCHAR) || '.pdf' END AS cv_path,
         s_acctbal > 8000 AS is_default
  FROM supplier)"""


@register("active_persona", "WITH " + PROFILE_SQL + f""",
pick AS (SELECT profile_id, arg_min(id, (NOT coalesce(is_default, false), id)) AS persona_id FROM pers GROUP BY 1)
SELECT prof.id AS profile_id, pick.persona_id,
       coalesce({NB.format(x='pers.prompt_override')}, {q_(DP.DEFAULT_SYSTEM_PROMPT)}) AS system_prompt,
       CASE WHEN {NB.format(x='pers.prompt_override')} IS NOT NULL THEN 'override' ELSE 'default' END AS prompt_source,
       {NB.format(x='pers.cv_path')} AS cv_path,
       CASE WHEN {NB.format(x='pers.cv_path')} IS NOT NULL THEN 'persona' ELSE 'fallback' END AS cv_source
FROM prof LEFT JOIN pick ON pick.profile_id = prof.id LEFT JOIN pers ON pers.id = pick.persona_id""")
def q_active_persona(spark, sf):
    return DP.active_persona(B.profiles(spark, sf), B.personas(spark, sf))


@register("effective_profile", "WITH " + PROFILE_SQL + f"""
SELECT id, full_name, coalesce({NB.format(x='search_keyword')}, 'Java') AS search_keyword,
       CAST(NULL AS VARCHAR) AS system_prompt, CAST(NULL AS VARCHAR) AS email_signature,
       coalesce({NB.format(x='ai_model')}, 'llama3.1') AS ai_model,
       coalesce(min_match_score, 75) AS min_match_score, coalesce(max_job_age_days, 30) AS max_job_age_days
FROM prof WHERE id = (SELECT min(id) FROM prof)""")
def q_effective_profile(spark, sf):
    return DP.effective_profile(B.profiles(spark, sf))


@register("profile_patches", "WITH " + PROFILE_SQL + """,
patch AS (
  SELECT e.event_id AS seq, CAST(c.c_nationkey AS VARCHAR) AS profile_id,
         CASE e.event_type WHEN 'click' THEN 'searchKeyword' WHEN 'view' THEN 'minMatchScore'
              WHEN 'error' THEN 'maxJobAgeDays' WHEN 'purchase' THEN 'aiModel' ELSE 'systemPrompt' END AS key,
         CASE e.event_type WHEN 'click' THEN 'kw' || CAST(e.user_id AS VARCHAR)
              WHEN 'view' THEN CAST(CAST(floor(e.value) AS BIGINT) AS VARCHAR)
              WHEN 'error' THEN ' ' || CAST(CAST(floor(e.value) AS BIGINT) AS VARCHAR) || ' '
              WHEN 'purchase' THEN CASE WHEN e.value > 100 THEN 'x' ELSE 'abc' END
              ELSE 'prompt ' || CAST(e.event_id AS VARCHAR) END AS value
  FROM events e JOIN customer c ON e.user_id = c.c_custkey),
last AS (
  SELECT profile_id,
         arg_max(value, seq) FILTER (WHERE key = 'searchKeyword') AS kw,
         arg_max(value, seq) FILTER (WHERE key = 'minMatchScore' AND regexp_matches(value, '^[+-]?[0-9]+$')
                                     AND TRY_CAST(value AS INTEGER) IS NOT NULL) AS mms,
         arg_max(value, seq) FILTER (WHERE key = 'maxJobAgeDays' AND regexp_matches(value, '^[+-]?[0-9]+$')
                                     AND TRY_CAST(value AS INTEGER) IS NOT NULL) AS age,
         arg_max(value, seq) FILTER (WHERE key = 'systemPrompt') AS sp,
         arg_max(value, seq) FILTER (WHERE key = 'aiModel') AS model
  FROM patch GROUP BY profile_id)
SELECT prof.id, prof.full_name,
       coalesce(l.kw, prof.search_keyword) AS search_keyword,
       coalesce(l.sp, CAST(NULL AS VARCHAR)) AS system_prompt,
       CAST(NULL AS VARCHAR) AS email_signature,
       coalesce(l.model, prof.ai_model) AS ai_model,
       CAST(coalesce(CAST(l.mms AS INTEGER), prof.min_match_score) AS DOUBLE) AS min_match_score,
       CAST(coalesce(CAST(l.age AS INTEGER), prof.max_job_age_days) AS DOUBLE) AS max_job_age_days
FROM prof LEFT JOIN last l ON l.profile_id = prof.id""")
def q_profile_patches(spark, sf):
    from ..operators import actions as A
    out = A.apply_profile_patches(B.profiles(spark, sf), B.profile_patches(spark, sf))
    # integer settings may be null: reported as DOUBLE (see queries_views)
    return (out.withColumn("min_match_score", F.col("min_match_score").cast("double"))
               .withColumn("max_job_age_days", F.col("max_job_age_days").cast("double")))


@register("persona_log", """
WITH s AS (SELECT * FROM supplier),
upd AS (SELECT lpad(CAST(s.s_suppkey AS VARCHAR), 8, '0') AS persona_id, arg_max('P' || CAST(e.event_id AS VARCHAR), e.event_id) AS prompt
        FROM events e JOIN s ON e.user_id = s.s_suppkey WHERE e.event_id % 3 <> 0 GROUP BY 1)
SELECT lpad(CAST(s.s_suppkey AS VARCHAR), 8, '0') AS id, CAST(s.s_nationkey AS VARCHAR) AS profile_id,
       coalesce(CASE WHEN s.s_acctbal > 0 THEN s.s_name END, 'New Persona') AS persona_name,
       coalesce(CASE WHEN s.s_acctbal > 5000 THEN 'Lead' END, '') AS role,
       u.prompt AS prompt_override
FROM s LEFT JOIN upd u ON u.persona_id = lpad(CAST(s.s_suppkey AS VARCHAR), 8, '0')""")
def q_persona_log(spark, sf):
    from .. import schemas as S
    from ..operators import actions as A
    out = A.apply_persona_log(spark.createDataFrame([], S.PERSONA), B.persona_log(spark, sf))
    return out.select("id", "profile_id", "persona_name", "role", "prompt_override")


@register("with_cv", with_ctes("posting") + "," + PROFILE_SQL + f""",
pick AS (SELECT profile_id, arg_min(id, (NOT coalesce(is_default, false), id)) AS persona_id FROM pers GROUP BY 1),
act AS (SELECT prof.id AS profile_id, {NB.format(x='pers.cv_path')} AS cv_path
        FROM prof LEFT JOIN pick ON pick.profile_id = prof.id LEFT JOIN pers ON pers.id = pick.persona_id),
cvt AS (SELECT 'cv_s' || CAST(doc_id AS VARCHAR) || '.pdf' AS cv_path, text AS cv_text FROM documents),
cv AS (SELECT act.profile_id, coalesce({NB.format(x='cvt.cv_text')}, 'fallback cv') AS cv_text
       FROM act LEFT JOIN cvt ON cvt.cv_path = act.cv_path),
pp AS (SELECT p.id, CAST(c.c_nationkey AS VARCHAR) AS profile_id
       FROM posting p JOIN orders o ON o.o_orderkey = p.id JOIN customer c ON c.c_custkey = o.o_custkey)
SELECT pp.id, pp.profile_id, CAST(length(cv.cv_text) AS BIGINT) AS cv_chars, sha256(cv.cv_text) AS cv_hash
FROM pp LEFT JOIN cv ON cv.profile_id = pp.profile_id""")
def q_with_cv(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = B.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    posts = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("id"), F.col("c_nationkey").cast("string").alias("profile_id"))
    act = DP.active_persona(B.profiles(spark, sf), B.personas(spark, sf))
    out = DP.with_cv(posts, act, B.cv_texts(spark, sf), "fallback cv")
    return out.select("id", "profile_id", F.length("cv_text").cast("long").alias("cv_chars"),
                      F.sha2("cv_text", 256).alias("cv_hash"))
