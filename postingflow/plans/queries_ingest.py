"""Registered ingest queries: normalisation, dedup, existence, schema rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X
from ..operators import actions as A
from ..operators import dedup as D
from ..operators import normalize as N
from ..sources import feeds as FD
from ..sources import schema_rules as R
from ..sources import tables as TB
from . import bindings as B
from .catalog import register, with_ctes

NL = "chr(10)"


def _nb(x):   # non-blank value or null (SQL)
    return f"CASE WHEN {x} IS NOT NULL AND NOT regexp_matches({x}, '^\\s*$') THEN {x} END"


INGEST_N = """n AS (
  SELECT coalesce(refnr, '') AS reference_id, coalesce(hashId, '') AS hash_id,
         coalesce(titel, 'Unknown Title') AS title, coalesce(arbeitgeber, 'Unknown Company') AS company,
         page, pos
  FROM feed)"""

SCAN_N = """n AS (
  SELECT coalesce(refnr, hashId, 'gen-' || substr(sha256(concat_ws(chr(31), coalesce(titel, ''),
           coalesce(arbeitgeber, ''), CAST(page AS VARCHAR), CAST(pos AS VARCHAR))), 1, 32)) AS reference_id,
         CAST(NULL AS VARCHAR) AS hash_id,
         coalesce(titel, 'Unknown Title') AS title, coalesce(arbeitgeber, 'Unknown Employer') AS company,
         coalesce(ort, '') AS ort, page, pos
  FROM feed)"""


def _section(field, heading, tail):
    return (f"CASE WHEN NOT regexp_matches(coalesce(d.{field}, ''), '^\\s*$') "
            f"THEN '{heading}' || {NL} || d.{field} || {tail} ELSE '' END")


SCAN_DESC = f"""CASE WHEN d.detail_key IS NOT NULL THEN
  regexp_replace('Position: ' || n.title || {NL}
      || CASE WHEN n.ort <> '' THEN 'Location: ' || n.ort || {NL} ELSE '' END
      || 'Employer: ' || n.company || {NL} || {NL}
      || {_section('stellenbeschreibung', 'Job Description:', f'{NL} || {NL}')}
      || {_section('taetigkeit', 'Responsibilities:', f'{NL} || {NL}')}
      || {_section('anforderungen', 'Requirements:', NL)},
    '^[\\x01-\\x20]+|[\\x01-\\x20]+$', '', 'g')
  ELSE n.title || CASE WHEN n.ort <> '' THEN ' in ' || n.ort ELSE '' END END"""


@register("normalize_ingest", with_ctes("feed", "detail") + "," + INGEST_N + f"""
SELECT n.pos, substr(sha256(n.reference_id), 1, 32) AS id, n.reference_id, n.hash_id, n.title, n.company,
       coalesce(nullif(d.stellenbeschreibung, ''),
                'Role: ' || n.title || {NL} || 'Company: ' || n.company || {NL}
                || 'Requirements: The candidate should have experience matching ' || n.title || '.') AS description,
       coalesce(nullif(d.a_email, ''), nullif(d.k_email, '')) AS employer_email,
       'FETCHED' AS status, 'IDLE' AS processing_status
FROM n LEFT JOIN detail d ON d.detail_key = (CASE WHEN n.hash_id <> '' THEN n.hash_id END)""")
def q_normalize_ingest(spark, sf):
    p = N.normalize_ingest(B.feed(spark, sf), B.details(spark, sf), B.NOW)
    return p.select("pos", "id", "reference_id", "hash_id", "title", "company", "description",
                    "employer_email", "status", "processing_status")


@register("normalize_scan", with_ctes("feed", "detail") + "," + SCAN_N + f"""
SELECT n.pos, substr(sha256(n.reference_id), 1, 32) AS id, n.reference_id, n.hash_id, n.title, n.company,
       {SCAN_DESC} AS description,
       {_nb('d.k_email')} AS employer_email,
       coalesce({_nb('d.externeUrl')},
                CASE WHEN {_nb('d.refnr')} IS NOT NULL THEN '{S.PORTAL_BASE}' || d.refnr END) AS portal_url,
       'FETCHED' AS status
FROM n LEFT JOIN detail d ON d.detail_key = n.reference_id""")
def q_normalize_scan(spark, sf):
    p = N.normalize_scan(B.feed(spark, sf), B.details(spark, sf), B.NOW)
    return p.select("pos", "id", "reference_id", "hash_id", "title", "company", "description",
                    "employer_email", "portal_url", "status")


@register("portal_url_read", with_ctes("feed", "detail") + "," + SCAN_N + f""",
s AS (SELECT 'scan' AS path, n.pos, n.hash_id,
             coalesce({_nb('d.externeUrl')},
                      CASE WHEN {_nb('d.refnr')} IS NOT NULL THEN '{S.PORTAL_BASE}' || d.refnr END) AS portal_url
      FROM n LEFT JOIN detail d ON d.detail_key = n.reference_id
      UNION ALL
      SELECT 'ingest', pos, coalesce(hashId, ''), NULL FROM feed)
SELECT path, pos, coalesce({_nb('portal_url')},
                     CASE WHEN {_nb('hash_id')} IS NOT NULL THEN '{S.PORTAL_BASE}' || hash_id END) AS link
FROM s""")
def q_portal_url_read(spark, sf):
    scan = N.normalize_scan(B.feed(spark, sf), B.details(spark, sf), B.NOW)
    ingest = N.normalize_ingest(B.feed(spark, sf), None, B.NOW)
    return scan.select(F.lit("scan").alias("path"), "pos", N.portal_url_read(scan).alias("link")).unionByName(
        ingest.select(F.lit("ingest").alias("path"), "pos", N.portal_url_read(ingest).alias("link")))


@register("resolve_reference", with_ctes("feed") + "," + SCAN_N + """
SELECT pos, reference_id FROM n""")
def q_resolve_reference(spark, sf):
    return N.resolve_reference(B.feed(spark, sf)).select("pos", "reference_id")


@register("dedup_ingest", with_ctes("feed") + "," + INGEST_N + """
SELECT reference_id, min(pos) AS pos, arg_min(title, pos) AS title FROM n GROUP BY reference_id""")
def q_dedup_ingest(spark, sf):
    p = N.normalize_ingest(B.feed(spark, sf), None, B.NOW).select("reference_id", "title", "page", "pos")
    return D.dedup_first(p, "reference_id", ("page", "pos")).select("reference_id", "pos", "title")


@register("dedup_source", with_ctes("raw_source") + """
SELECT reference_id, min(pos) AS pos FROM raw_source GROUP BY reference_id""")
def q_dedup_source(spark, sf):
    r = B.raw_postings(spark, sf, "source").select("reference_id", "page", "pos")
    return D.dedup_first(r).select("reference_id", "pos")


@register("only_new", with_ctes("raw_text", "stored_text") + """
SELECT reference_id, pos FROM raw_text r
WHERE NOT EXISTS (SELECT 1 FROM stored_text s WHERE s.reference_id = r.reference_id)""")
def q_only_new(spark, sf):
    r = B.raw_postings(spark, sf, "text").select("reference_id", "pos")
    return D.only_new(r, B.stored_keys(spark, sf, "text"))


@register("scan_new", with_ctes("raw_text", "stored_text") + """,
firsts AS (SELECT reference_id, min(pos) AS pos FROM raw_text GROUP BY reference_id)
SELECT reference_id, pos FROM firsts f
WHERE NOT EXISTS (SELECT 1 FROM stored_text s WHERE s.reference_id = f.reference_id)
ORDER BY pos, reference_id LIMIT 10""")
def q_scan_new(spark, sf):
    r = B.raw_postings(spark, sf, "text").select("reference_id", "page", "pos")
    return D.scan_new(r, B.stored_keys(spark, sf, "text"), 10).select("reference_id", "pos")


@register("scan_result", with_ctes("raw_text", "stored_text") + """,
fresh AS (SELECT DISTINCT reference_id FROM raw_text r
          WHERE NOT EXISTS (SELECT 1 FROM stored_text s WHERE s.reference_id = r.reference_id))
SELECT 'Scraped ' || count(*) || ' new jobs' AS message, count(*) AS added FROM fresh""")
def q_scan_result(spark, sf):
    r = B.raw_postings(spark, sf, "text").select("reference_id", "page", "pos")
    return A.scan_result(TB.fresh_rows(r, B.stored_keys(spark, sf, "text")))


def _incoming_imports(spark, sf):
    c = B.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    eng = c.select((F.col("c_custkey") * 2).alias("seq"),
                   F.concat("c_mktsegment", F.lit(" Engineer")).alias("title"), F.col("c_name").alias("company"))
    odd = F.col("c_custkey") % 5
    lead = c.select((F.col("c_custkey") * 2 + 1).alias("seq"),
                    F.when(odd != 1, F.concat("c_mktsegment", F.lit(" Lead"))).alias("title"),
                    F.when(odd != 2, F.col("c_name")).alias("company"))
    return eng.unionByName(lead)


IMPORT_SQL = """,
incoming AS (SELECT c_custkey * 2 AS seq, c_mktsegment || ' Engineer' AS title, c_name AS company FROM customer
             UNION ALL
             SELECT c_custkey * 2 + 1, CASE WHEN c_custkey % 5 = 1 THEN 'Unknown Title' ELSE c_mktsegment || ' Lead' END,
                    CASE WHEN c_custkey % 5 = 2 THEN 'Unknown Employer' ELSE c_name END FROM customer),
existing AS (SELECT title, company, CAST(arg_min(id, (created_at, id)) AS VARCHAR) AS stored_id
             FROM posting GROUP BY title, company),
firsts AS (SELECT title, company, min(seq) AS first_seq FROM incoming GROUP BY title, company),
imp AS (SELECT i.seq, i.title, i.company,
       CASE WHEN e.stored_id IS NOT NULL THEN 'exists' WHEN i.seq = f.first_seq THEN 'imported'
            ELSE 'exists' END AS outcome,
       coalesce(e.stored_id, 'EXT-' || substr(sha256(i.title || chr(31) || i.company), 1, 32)) AS id
FROM incoming i LEFT JOIN existing e ON i.title = e.title AND i.company = e.company
LEFT JOIN firsts f ON i.title = f.title AND i.company = f.company)"""


@register("import_postings", with_ctes("posting") + IMPORT_SQL + """
SELECT * FROM imp""")
def q_import_postings(spark, sf):
    stored = B.postings(spark, sf).select("id", "title", "company", "created_at")
    return D.import_postings(_incoming_imports(spark, sf), stored)


@register("imported_postings", with_ctes("posting") + IMPORT_SQL + """
SELECT id, id AS reference_id, title, company, '' AS description, 'FETCHED' AS status, 'IDLE' AS processing_status
FROM imp WHERE outcome = 'imported'""")
def q_imported_postings(spark, sf):
    stored = B.postings(spark, sf).select("id", "title", "company", "created_at")
    return D.imported_postings(_incoming_imports(spark, sf), stored, B.NOW).select(
        "id", "reference_id", "title", "company", "description", "status", "processing_status")


OLD_POSTING_COLS = ["id", "reference_id", "title", "company", "description", "status", "match_score",
                    "employer_email", "notes", "scored_at", "created_at"]


@register("upgrade_schema", with_ctes("posting") + """
SELECT CAST(id AS VARCHAR) AS id, reference_id, CAST(NULL AS VARCHAR) AS hash_id, title, company, description,
       status, 'IDLE' AS processing_status, CAST(match_score AS DOUBLE) AS match_score, employer_email, notes,
       CAST(NULL AS VARCHAR) AS ai_analysis, CAST(NULL AS VARCHAR) AS portal_url, scored_at, created_at
FROM posting""")
def q_upgrade_schema(spark, sf):
    old = B.postings(spark, sf).select(*OLD_POSTING_COLS).withColumn("id", F.col("id").cast("string"))
    return R.upgrade_schema(old, "posting").withColumn("match_score", F.col("match_score").cast("double"))


@register("validate_postings", with_ctes("doc_posting") + """
SELECT doc_id,
       CASE WHEN reference_id IS NULL THEN 'reference_id is null'
            WHEN length(reference_id) > 255 THEN 'reference_id too long'
            WHEN title IS NULL THEN 'title is null'
            WHEN length(title) > 2000 THEN 'title too long'
            WHEN company IS NULL THEN 'company is null'
            WHEN length(company) > 2000 THEN 'company too long'
            WHEN description IS NULL THEN 'description is null'
            WHEN status IS NULL THEN 'status is null'
            WHEN status NOT IN ('FETCHED', 'SCORED', 'APPROVED', 'APPLIED', 'INTERVIEWING', 'REJECTED', 'HIRED')
              THEN 'status not allowed'
            WHEN processing_status IS NOT NULL AND processing_status NOT IN ('IDLE', 'QUEUED', 'PROCESSING')
              THEN 'processing_status not allowed'
            WHEN length(employer_email) > 255 THEN 'employer_email too long'
            WHEN length(portal_url) > 2000 THEN 'portal_url too long'
       END AS reason
FROM doc_posting""")
def q_validate_postings(spark, sf):
    return R.flag_postings(B.doc_postings(spark, sf)).select("doc_id", "reason")


@register("progress_events", """
SELECT event_id,
       CAST(to_json(struct_pack(type := CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'success'
                                        WHEN 'signup' THEN 'start' ELSE 'info' END,
                                message := replace(coalesce(props, ''), chr(13), ''),
                                time := strftime(ts, '%H:%M:%S'))) AS VARCHAR) AS json
FROM events""")
def q_progress_events(spark, sf):
    e = B.table(spark, sf, "events").select("event_id", "event_type", "props", "ts")
    et = F.col("event_type")
    typed = e.select("event_id", F.when(et == "error", "error").when(et == "purchase", "success")
                     .when(et == "signup", "start").otherwise("info").alias("type"),
                     F.col("props").alias("message"), "ts")
    return TB.progress_events(typed, keep=("event_id",))


@register("predict_email", """
SELECT c_custkey, 'hr@' || regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') || '.de' AS predicted
FROM customer""")
def q_predict_email(spark, sf):
    c = B.table(spark, sf, "customer")
    return c.select("c_custkey", X.predict_email("c_name").alias("predicted"))


RECIPIENT_INPUT_SQL = """r AS (
  SELECT c_custkey, c_name,
         CASE c_mktsegment WHEN 'BUILDING' THEN ' ' WHEN 'MACHINERY' THEN 'jobs@' || lower(c_mktsegment) || '.example' END AS override,
         CASE WHEN c_nationkey < 5 THEN '' WHEN c_nationkey < 10 THEN 'hr@n' || CAST(c_nationkey AS VARCHAR) || '.example' END AS stored
  FROM customer)"""


def _recipient_input(spark, sf):
    c = B.table(spark, sf, "customer")
    seg, nk = F.col("c_mktsegment"), F.col("c_nationkey")
    return c.select(
        "c_custkey", "c_name",
        F.when(seg == "BUILDING", F.lit(" ")).when(seg == "MACHINERY",
                                                  F.concat(F.lit("jobs@"), F.lower(seg), F.lit(".example"))).alias("override"),
        F.when(nk < 5, F.lit("")).when(nk < 10, F.concat(F.lit("hr@n"), nk.cast("string"), F.lit(".example"))).alias("stored"))


@register("resolve_recipient", "WITH " + RECIPIENT_INPUT_SQL + f"""
SELECT c_custkey, coalesce({_nb('override')}, nullif(stored, ''),
                           'hr@' || regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') || '.de') AS recipient
FROM r""")
def q_resolve_recipient(spark, sf):
    r = _recipient_input(spark, sf)
    return r.select("c_custkey", X.resolve_recipient("override", "stored", "c_name").alias("recipient"))


@register("size_label", """
SELECT o_orderkey,
       CASE WHEN b >= 1000000000 THEN CAST((b + 50000000) // 100000000 // 10 AS VARCHAR) || '.'
                                      || CAST((b + 50000000) // 100000000 % 10 AS VARCHAR) || ' GB'
            WHEN b >= 1000000 THEN CAST((b + 500000) // 1000000 AS VARCHAR) || ' MB'
            ELSE CAST(b AS VARCHAR) || ' B' END AS label
FROM (SELECT o_orderkey, CAST(floor(o_totalprice * 10000) AS BIGINT) AS b FROM orders)""")
def q_size_label(spark, sf):
    o = B.table(spark, sf, "orders")
    return o.select("o_orderkey", X.size_label(F.floor(F.col("o_totalprice") * 10000)).alias("label"))


ARTIFACT_NAME_SQL = """CASE WHEN lang = 'en' THEN source || '.' || lang || '.pdf'
            WHEN lang = 'fr' THEN source ELSE source || '.' || lang END"""


@register("artifact_name", f"""
SELECT doc_id, 'cl_' || CAST(doc_id AS VARCHAR) || '.pdf' AS letter_file,
       'cl_fallback_' || CAST(doc_id AS VARCHAR) || '.pdf' AS fallback_file,
       regexp_extract({ARTIFACT_NAME_SQL}, '(\\.[^.]*)$', 1) AS upload_ext
FROM documents""")
def q_artifact_name(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", "lang", "source")
    lang = F.col("lang")
    name = (F.when(lang == "en", F.concat("source", F.lit("."), lang, F.lit(".pdf")))
             .when(lang == "fr", F.col("source")).otherwise(F.concat("source", F.lit("."), lang)))
    return d.select("doc_id", X.letter_file_name("doc_id").alias("letter_file"),
                    X.letter_file_name("doc_id", fallback=True).alias("fallback_file"),
                    X.upload_extension(name).alias("upload_ext"))


def _landed_feed(d, run, page, empty):
    """Envelopes of the documents, one per (run, page); those where ``empty`` holds came without records."""
    rec = F.struct(*(F.concat(F.lit("R-"), F.col("doc_id").cast("string")).alias("refnr") if f.name == "refnr"
                     else F.col("source").alias("titel") if f.name == "titel"
                     else F.lit(None).cast(f.dataType).alias(f.name) for f in S.RAW_SUMMARY.fields))
    return (d.groupBy(run.alias("run"), page.cast("long").alias("page"))
             .agg(F.sort_array(F.collect_list(F.struct("doc_id", rec.alias("r")))).alias("rs"))
             .select("page", F.when(empty, F.array().cast(S.SEARCH_PAGE["stellenangebote"].dataType))
                     .otherwise(F.transform("rs", lambda x: x["r"])).alias("stellenangebote"),
                     F.format_string("/feed/r%d/page_%06d.json", F.col("run"), F.col("page")).alias("_file")))


@register("search_pages", """
SELECT 'R-' || CAST(doc_id AS VARCHAR) AS refnr, source AS titel, CAST(doc_id % 75 // 25 + 1 AS BIGINT) AS page,
       CAST(row_number() OVER (PARTITION BY doc_id // 25 ORDER BY doc_id, source) - 1 AS BIGINT) AS pos
FROM documents""")
def q_search_pages(spark, sf):
    # a run for every 75 ids: three pages of 25 records, then page 4 comes empty and ends the run
    d = B.table(spark, sf, "documents").select("doc_id", "source")
    run = F.floor(F.col("doc_id") / 75)
    pages = _landed_feed(d, run, F.floor(F.col("doc_id") % 75 / 25) + 1, F.lit(False))
    ends = _landed_feed(d.withColumn("doc_id", F.floor(F.col("doc_id") / 75) * 75).distinct(), run, F.lit(4), F.lit(True))
    return FD.explode_pages(pages.unionByName(ends)).select("refnr", "titel", "page", "pos")


@register("search_feed", """
SELECT 'R-' || CAST(doc_id AS VARCHAR) AS refnr, source AS titel, CAST(doc_id // 200 AS BIGINT) AS run,
       CAST(doc_id % 200 // 25 + 1 AS BIGINT) AS page,
       CAST(row_number() OVER (PARTITION BY doc_id // 25 ORDER BY doc_id, source) - 1 AS BIGINT) AS pos
FROM documents WHERE doc_id // 200 % 10 <> 0 OR doc_id % 200 // 25 + 1 < 7""")
def q_search_feed(spark, sf):
    # a run for every 200 ids, eight pages of 25 records; in every tenth run page 7 came empty and page 8 is not read
    d = B.table(spark, sf, "documents").select("doc_id", "source")
    run = F.floor(F.col("doc_id") / 200)
    page = F.floor(F.col("doc_id") % 200 / 25) + 1
    env = _landed_feed(d, run, page, (F.col("run") % 10 == 0) & (F.col("page") == 7))
    raw = FD.explode_pages(env).withColumn("run", F.regexp_extract("_file", "/r([0-9]+)/", 1).cast("long"))
    return raw.select("refnr", "titel", "run", "page", "pos")


@register("fresh_rows", with_ctes("raw_text", "stored_text") + """
SELECT reference_id, min(pos) AS pos FROM raw_text r
WHERE NOT EXISTS (SELECT 1 FROM stored_text s WHERE s.reference_id = r.reference_id)
GROUP BY reference_id""")
def q_fresh_rows(spark, sf):
    batch = B.raw_postings(spark, sf, "text").select("reference_id", "page", "pos")
    return TB.fresh_rows(batch, B.stored_keys(spark, sf, "text")).select("reference_id", "pos")


@register("upgrade_profile", """
SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS full_name, CAST(NULL AS VARCHAR) AS search_keyword,
       CAST(NULL AS VARCHAR) AS system_prompt, CAST(NULL AS VARCHAR) AS email_signature, 'llama3' AS ai_model,
       CAST(CASE WHEN n_regionkey = 2 THEN NULL ELSE n_nationkey + 50 END AS DOUBLE) AS min_match_score,
       CAST(30 AS DOUBLE) AS max_job_age_days
FROM nation""")
def q_upgrade_profile(spark, sf):
    # an old snapshot without model and age settings; its own null scores stay
    old = B.profiles(spark, sf).select("id", "full_name", "min_match_score")
    up = R.upgrade_schema(old, "profile")
    return up.withColumns({c: F.col(c).cast("double") for c in ("min_match_score", "max_job_age_days")})


@register("upgrade_application", with_ctes("application") + """
SELECT id, CAST(job_id AS VARCHAR) AS job_id, CAST(NULL AS VARCHAR) AS cv_path, letter_path, created_at FROM application""")
def q_upgrade_application(spark, sf):
    old = B.applications(spark, sf).select("id", F.col("job_id").cast("string").alias("job_id"), "letter_path", "created_at")
    return R.upgrade_schema(old, "application")


@register("upgrade_persona", """
SELECT lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS id, CAST(s_nationkey AS VARCHAR) AS profile_id, s_name AS persona_name,
       '' AS role, CAST(NULL AS VARCHAR) AS prompt_override, CAST(NULL AS VARCHAR) AS cv_path, s_acctbal > 8000 AS is_default
FROM supplier""")
def q_upgrade_persona(spark, sf):
    return R.upgrade_schema(B.personas(spark, sf).drop("prompt_override", "cv_path"), "persona")
