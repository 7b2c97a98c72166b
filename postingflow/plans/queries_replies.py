"""Registered reply-processing queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import json_reply as J
from ..operators import replies as RP
from . import bindings as B
from .catalog import register, with_ctes

JTRIM = "regexp_replace({x}, '^[\\x01-\\x20]+|[\\x01-\\x20]+$', '', 'g')"


def _jt(x):
    return JTRIM.format(x=x)


EXTRACT_SQL = with_ctes("reply") + f""",
t AS (SELECT job_id, raw, {_jt('raw')} AS c0 FROM reply),
f AS (SELECT *, instr(c0, '```json') AS ij, instr(c0, '```') AS ib FROM t),
g AS (SELECT *, CASE WHEN ij > 0 THEN substr(c0, ij + 7) WHEN ib > 0 THEN substr(c0, ib + 3) ELSE c0 END AS c1,
             (ij > 0 OR ib > 0) AS fenced FROM f),
h AS (SELECT *, CASE WHEN instr(reverse(c1), '```') > 0 THEN length(c1) - instr(reverse(c1), '```') - 3 + 2
                     ELSE 0 END AS lf FROM g),
k AS (SELECT *, CASE WHEN fenced AND lf > 0 THEN substr(c1, 1, lf - 1) ELSE c1 END AS c2 FROM h),
m AS (SELECT *, instr(c2, '{{') AS s,
             CASE WHEN instr(reverse(c2), '}}') > 0 THEN length(c2) - instr(reverse(c2), '}}') + 1 ELSE 0 END AS e
      FROM k),
x AS (SELECT job_id,
             CASE WHEN raw IS NULL OR regexp_matches(raw, '^\\s*$') THEN 'LLM returned empty response'
                  WHEN s = 0 OR e = 0 OR e <= s THEN 'No valid JSON object delimiters ({{ }}) found in LLM response'
             END AS error,
             c2, s, e
      FROM m),
ex AS (SELECT job_id, error, CASE WHEN error IS NULL THEN {_jt('substr(c2, s, e - s + 1)')} END AS json FROM x)"""


def _alias_sql(fn, keys):
    return "coalesce(" + ", ".join(f"{fn}(json, '$.{k}')" for k in keys) + ")"


PARSE_SQL = EXTRACT_SQL + f""",
p0 AS (SELECT job_id, error, json,
             {_alias_sql('json_extract_string', S.SCORE_ALIASES)} AS score_txt,
             {_alias_sql('json_extract', S.SCORE_ALIASES)} AS score_json,
             {_alias_sql('json_extract_string', S.LETTER_ALIASES)} AS letter,
             {_alias_sql('json_extract', S.ANALYSIS_ALIASES)} AS analysis_json
      FROM ex),
p AS (SELECT * REPLACE (CASE WHEN error IS NULL AND json_type(score_json) = 'VARCHAR'
                                  AND NOT regexp_matches(trim(score_txt), '^[+-]?[0-9]+$')
                             THEN 'Cannot parse score: ' || score_txt ELSE error END AS error) FROM p0),
parsed AS (
  SELECT job_id, error,
         CASE WHEN error IS NULL THEN coalesce(CAST(trunc(TRY_CAST(trim(score_txt) AS DOUBLE)) AS BIGINT), 0) END AS score,
         CASE WHEN error IS NULL THEN letter END AS letter,
         CASE WHEN error IS NOT NULL THEN NULL
              WHEN analysis_json IS NULL THEN ''
              WHEN json_type(analysis_json) = 'ARRAY'
                THEN {_jt("array_to_string(CAST(analysis_json AS VARCHAR[]), chr(10))")}
              WHEN json_type(analysis_json) = 'OBJECT' THEN ''
              ELSE json_extract_string(analysis_json, '$') END AS analysis,
         CASE WHEN error IS NULL AND json_type(analysis_json) = 'ARRAY'
              THEN CAST(analysis_json AS VARCHAR[]) END AS analysis_items
  FROM p)"""


def parsed_replies(spark, sf):
    r = J.extract_json(B.replies(spark, sf), "raw")
    return J.parse_replies(r)


@register("extract_json", EXTRACT_SQL + "\nSELECT job_id, json, error FROM ex")
def q_extract_json(spark, sf):
    return J.extract_json(B.replies(spark, sf), "raw").select("job_id", "json", "error")


@register("parse_replies", PARSE_SQL + "\nSELECT job_id, CAST(score AS DOUBLE) AS score, letter, analysis, error FROM parsed")
def q_parse_replies(spark, sf):
    return parsed_replies(spark, sf).select("job_id", F.col("score").cast("double").alias("score"),
                                            "letter", "analysis", "error")


@register("reply_quarantine", PARSE_SQL + "\nSELECT job_id, error FROM parsed WHERE error IS NOT NULL")
def q_reply_quarantine(spark, sf):
    return parsed_replies(spark, sf).filter(F.col("error").isNotNull()).select("job_id", "error")


def q_(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _classify_sql(x):
    return (f"CASE WHEN contains({x}, '404') OR contains(lower({x}), {q_(S.FAIL_PATTERN_MODEL_MISSING)}) "
            f"THEN {q_(S.FAIL_TEXT_DOWNLOADING)} "
            f"WHEN contains({x}, {q_(S.FAIL_PATTERN_NO_DELIMITERS)}) THEN {q_(S.FAIL_TEXT_INCOMPLETE)} "
            f"WHEN contains({x}, 'OPEN') THEN {q_(S.FAIL_TEXT_DEFERRED)} ELSE {x} END")


@register("apply_replies", with_ctes("posting") + "," + PARSE_SQL[len("WITH "):] + f"""
SELECT p.id,
       CAST(CASE WHEN r.job_id IS NULL THEN p.match_score WHEN r.error IS NULL THEN CAST(r.score AS INTEGER) ELSE 0 END
         AS DOUBLE) AS match_score,
       CASE WHEN r.job_id IS NULL THEN p.status ELSE 'SCORED' END AS status,
       CASE WHEN r.job_id IS NULL THEN p.ai_analysis WHEN r.error IS NULL THEN r.analysis
            ELSE '{S.FAIL_ANALYSIS_PREFIX}' || {_classify_sql('r.error')} END AS ai_analysis,
       CASE WHEN r.job_id IS NULL THEN p.notes WHEN r.error IS NULL THEN coalesce(p.notes, '')
            WHEN p.notes IS NULL OR p.notes = '' THEN '{S.FAIL_NOTE_PREFIX}' || {_classify_sql('r.error')}
            ELSE p.notes || chr(10) || chr(10) || '{S.FAIL_NOTE_PREFIX}' || {_classify_sql('r.error')} END AS notes,
       CASE WHEN r.job_id IS NULL THEN p.scored_at ELSE TIMESTAMP '2001-08-01 00:00:00' END AS scored_at
FROM posting p LEFT JOIN parsed r ON r.job_id = p.id""")
def q_apply_replies(spark, sf):
    p, _, _ = RP.apply_replies(B.postings(spark, sf), parsed_replies(spark, sf), B.NOW)
    return p.select("id", F.col("match_score").cast("double").alias("match_score"), "status", "ai_analysis",
                    "notes", "scored_at")


@register("reply_applications", with_ctes("posting") + "," + PARSE_SQL[len("WITH "):] + """
SELECT 'app-' || CAST(p.id AS VARCHAR) AS id, p.id AS job_id,
       CASE WHEN r.error IS NULL THEN 'cl_' ELSE 'cl_fallback_' END || CAST(p.id AS VARCHAR) || '.pdf' AS letter_path,
       sha256(CASE WHEN r.error IS NULL THEN coalesce(r.letter, '') ELSE '""" + RP.FAILED_LETTER_HEADING + """' || r.error END)
         AS letter_hash
FROM posting p JOIN parsed r ON r.job_id = p.id""")
def q_reply_applications(spark, sf):
    # no text of the documents holds a tag, so the sanitised letter is the letter
    _, apps, _ = RP.apply_replies(B.postings(spark, sf), parsed_replies(spark, sf), B.NOW)
    return apps.select("id", "job_id", "letter_path", F.sha2("letter_text", 256).alias("letter_hash"))


REPEATED_SQL = """,
rep AS (SELECT job_id // 4 AS id, job_id AS reply_seq, error, score FROM parsed),
lastr AS (SELECT id, max(reply_seq) AS reply_seq, count(*) AS n FROM rep GROUP BY id)"""


@register("apply_repeated_replies", with_ctes("posting") + "," + PARSE_SQL[len("WITH "):] + REPEATED_SQL + f"""
SELECT p.id, CAST(CASE WHEN l.id IS NULL THEN p.match_score WHEN r.error IS NULL THEN r.score ELSE 0 END AS DOUBLE) AS match_score,
       CASE WHEN l.id IS NULL THEN p.status ELSE 'SCORED' END AS status,
       CASE WHEN l.id IS NULL THEN p.notes WHEN r.error IS NULL THEN coalesce(p.notes, '')
            ELSE '{S.FAIL_NOTE_PREFIX}' || {_classify_sql('r.error')} END AS notes,
       coalesce(l.n, 0) AS n_applications
FROM posting p LEFT JOIN lastr l ON l.id = p.id LEFT JOIN rep r ON r.id = l.id AND r.reply_seq = l.reply_seq""")
def q_apply_repeated_replies(spark, sf):
    # four replies for every posting: the last one counts, each makes an application
    r = parsed_replies(spark, sf).withColumn("reply_seq", F.col("job_id")) \
        .withColumn("job_id", F.floor(F.col("job_id") / 4).cast("long"))
    p, apps, _ = RP.apply_replies(B.postings(spark, sf), r, B.NOW)
    n = apps.groupBy(F.col("job_id").alias("id")).agg(F.countDistinct("id").alias("n"))
    return p.join(n, "id", "left").select("id", F.col("match_score").cast("double").alias("match_score"), "status",
                                          "notes", F.coalesce("n", F.lit(0)).alias("n_applications"))


@register("audit_replies", PARSE_SQL + f"""
SELECT count(*) AS n_replies,
       count(*) FILTER (WHERE score >= 0 AND score <= 100) AS score_ok,
       count(*) FILTER (WHERE coalesce(len(regexp_split_to_array(trim(letter), '\\s+')) BETWEEN 200 AND 320, false))
         AS letter_words_ok,
       count(*) FILTER (WHERE coalesce(regexp_matches(letter, '(^|\\n)\\s*Betreff:'), false)) AS subject_ok,
       count(*) FILTER (WHERE coalesce(contains(letter, '{S.LETTER_SALUTATION}'), false)) AS salutation_ok,
       count(*) FILTER (WHERE coalesce(contains(letter, '{S.LETTER_CLOSING}'), false)) AS closing_ok,
       count(*) FILTER (WHERE coalesce(len(analysis_items) BETWEEN 3 AND 5, false)) AS items_ok,
       count(*) FILTER (WHERE coalesce(list_bool_and(list_transform(analysis_items, lambda x: starts_with(x, '• '))), false))
         AS bullets_ok
FROM parsed WHERE error IS NULL""")
def q_audit_replies(spark, sf):
    return RP.audit_replies(parsed_replies(spark, sf))


ALLOWED_RX = "|".join(S.ALLOWED_TAGS)
SANITIZE_SQL = f""",
prot AS (SELECT page_id,
                regexp_replace(html, '<(/?(?:{ALLOWED_RX})(?:[^a-zA-Z0-9>][^>]*)?)>', chr(1) || '\\1' || chr(2), 'gi') AS h
         FROM pages),
s AS (SELECT page_id,
             replace(replace(regexp_replace(h, '<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>', '', 'g'), chr(1), '<'), chr(2), '>')
               AS clean,
             regexp_extract_all(h, '<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>', 2) AS dropped
      FROM prot)"""


@register("sanitize_markup", "WITH dummy AS (SELECT 1)" + SANITIZE_SQL + """
SELECT page_id, clean, CAST(len(dropped) AS BIGINT) AS n_dropped, array_to_string(dropped, ',') AS dropped_names
FROM s""")
def q_sanitize_markup(spark, sf):
    s = RP.sanitize_markup(B.markup(spark, sf), "html")
    return s.select("page_id", "clean", F.size("dropped").cast("long").alias("n_dropped"),
                    F.array_join("dropped", ",").alias("dropped_names"))


@register("overlap_score", """
WITH toks AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'),
                                                      lambda x: length(x) >= 3)) AS t FROM documents),
cv AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 3)) AS term
       FROM benchmark),
hits AS (SELECT doc_id, count(*) AS n_hits FROM (SELECT doc_id, unnest(t) AS term FROM toks) u
         WHERE term IN (SELECT term FROM cv) GROUP BY doc_id)
SELECT k.doc_id, CAST(len(k.t) AS INTEGER) AS n_terms, coalesce(h.n_hits, 0) AS n_hits,
       CASE WHEN len(k.t) > 0 THEN CAST(floor(coalesce(h.n_hits, 0) * 100 / len(k.t)) AS BIGINT) ELSE 0 END
         AS overlap_score
FROM toks k LEFT JOIN hits h ON h.doc_id = k.doc_id""")
def q_overlap_score(spark, sf):
    d = B.long_texts(spark, sf)
    cv = B.table(spark, sf, "benchmark").select(F.explode(RP.tokens("text")).alias("term"))
    return RP.overlap_score(d, cv, "text", "doc_id")


PROMPT_SQL = f"""
WITH cv AS (SELECT arg_min(text, item_id) AS cv_text FROM benchmark),
p AS (SELECT doc_id, source AS title, CASE WHEN lang = 'es' THEN NULL ELSE 'Employer ' || lang END AS company,
             text AS description FROM documents)
SELECT doc_id AS id, CAST(NULL AS VARCHAR) AS system,
       'Rate how well the candidate fits the position "' || coalesce(title, '{S.PROMPT_MISSING_TITLE}') || '" at '
       || coalesce(company, '{S.PROMPT_MISSING_COMPANY}') || ' on a scale of 0 to 100 and write a cover letter. '
       || 'Answer with one JSON object with the keys score, coverLetterMarkdown and analysis.'
       || chr(10) || chr(10) || '## Position' || chr(10)
       || CASE WHEN description IS NULL THEN title
               WHEN length(description) > 4000 THEN substr(description, 1, 4000) || '...' ELSE description END
       || chr(10) || chr(10) || '## Candidate' || chr(10)
       || CASE WHEN length(cv_text) > 4000 THEN substr(cv_text, 1, 4000) || '...' ELSE cv_text END AS user
FROM p, cv"""


def _prompt_inputs(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    posts = d.select(F.col("doc_id").alias("id"), F.col("source").alias("title"),
                     F.when(F.col("lang") == "es", F.lit(None)).otherwise(F.concat(F.lit("Employer "), "lang"))
                      .alias("company"), F.col("text").alias("description"))
    cv = B.table(spark, sf, "benchmark").agg(F.min_by("text", "item_id").alias("cv_text"))
    return posts, cv


@register("build_prompts", PROMPT_SQL)
def q_build_prompts(spark, sf):
    posts, cv = _prompt_inputs(spark, sf)
    return RP.build_prompts(posts, cv)


def _fake_scorer(prompts: pd.Series) -> pd.Series:
    """Deterministic stand-in model: score from the prompt length; prompts
    mentioning a missing company fail like an unreachable model."""
    out = []
    for p in prompts:
        if S.PROMPT_MISSING_COMPANY in p:
            raise RuntimeError("model 'llama3' not found") from ConnectionError("404 Not Found")
        out.append('```json\n{"score": %d, "analysis": ["• fit"]}\n```' % (len(p) % 101))
    return pd.Series(out)


FAKE_REPLY_SQL = """'```json' || chr(10) || '{"score": ' || CAST(length(user) % 101 AS VARCHAR)
         || ', "analysis": ["• fit"]}' || chr(10) || '```'"""


@register("score_with", f"""
WITH pr AS ({PROMPT_SQL})
SELECT id, CASE WHEN contains(user, '{S.PROMPT_MISSING_COMPANY}') THEN NULL ELSE {FAKE_REPLY_SQL} END AS raw,
       CASE WHEN contains(user, '{S.PROMPT_MISSING_COMPANY}') THEN '404 Not Found' END AS error
FROM pr""")
def q_score_with(spark, sf):
    posts, cv = _prompt_inputs(spark, sf)
    return RP.score_with(RP.build_prompts(posts, cv), _fake_scorer)


@register("queue_step", with_ctes("posting") + """,
c AS (SELECT * FROM posting WHERE coalesce(status, 'FETCHED') = 'FETCHED' AND processing_status = 'QUEUED'
      ORDER BY created_at, id LIMIT 20),
pr AS (SELECT id, 'Rate how well the candidate fits the position "' || title || '" at ' || company
       || ' on a scale of 0 to 100 and write a cover letter. '
       || 'Answer with one JSON object with the keys score, coverLetterMarkdown and analysis.'
       || chr(10) || chr(10) || '## Position' || chr(10) || description || chr(10) || chr(10) || '## Candidate' || chr(10)
       || 'own cv' AS user FROM c)
SELECT p.id, CASE WHEN pr.id IS NULL THEN p.status ELSE 'SCORED' END AS status,
       CASE WHEN pr.id IS NULL THEN p.processing_status ELSE 'IDLE' END AS processing_status,
       CAST(CASE WHEN pr.id IS NULL THEN p.match_score ELSE length(pr.user) % 101 END AS DOUBLE) AS match_score
FROM posting p LEFT JOIN pr ON pr.id = p.id""")
def q_queue_step(spark, sf):
    from ..streaming.streams import queue_step
    p, _, _ = queue_step(B.postings(spark, sf), _fake_scorer, B.NOW, 20, fallback_cv="own cv")
    return p.select("id", "status", "processing_status", F.col("match_score").cast("double").alias("match_score"))
