"""Settings, personas, artifacts and the dispatch manifest.

Profiles and personas are small, per-user tables; they are reduced to one
row per profile (``min_by`` over an explicit order) before they meet the
posting table, and only then joined (a broadcast when AQE sees them small).
Artifacts are checked against a file inventory frame (``sources.tables.
list_artifacts``), never by touching files row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import non_blank, resolve_recipient
from ..sources.tables import plain_path
from .views import first_application

DEFAULT_SYSTEM_PROMPT = ("You are a recruiter and cover-letter writer. Reply with one raw JSON object only.")
SEARCH_FALLBACK = S.SCAN_KEYWORD
MODEL_FALLBACK = "llama3.1"


def effective_profile(profiles: DataFrame) -> DataFrame:
    """The first profile (by id) with defaults filled in; one row of
    defaults when there is no profile at all."""
    # an aggregate without grouping always yields one row (all null when
    # there is no profile), so the defaults below apply in both cases
    p = profiles.agg(F.min_by(F.struct(*profiles.columns), F.col("id")).alias("p")).select("p.*")
    return p.select(
        "id", "full_name",
        F.coalesce(non_blank("search_keyword"), F.lit(SEARCH_FALLBACK)).alias("search_keyword"),
        "system_prompt", "email_signature",
        F.coalesce(non_blank("ai_model"), F.lit(MODEL_FALLBACK)).alias("ai_model"),
        F.coalesce("min_match_score", F.lit(S.DEFAULT_MIN_MATCH_SCORE)).alias("min_match_score"),
        F.coalesce("max_job_age_days", F.lit(S.DEFAULT_MAX_JOB_AGE_DAYS)).alias("max_job_age_days"))


def active_persona(profiles: DataFrame, personas: DataFrame,
                   default_prompt: str = DEFAULT_SYSTEM_PROMPT) -> DataFrame:
    """Per profile the first default persona, else the first persona
    (by id), else none; prompt = non-blank override else the default
    prompt; CV source = persona CV path when non-blank, else the fallback.
    """
    pick = (personas.groupBy("profile_id")
                    .agg(F.min_by(F.struct("id", "prompt_override", "cv_path"),
                                  F.struct((~F.coalesce("is_default", F.lit(False))).alias("nd"), "id")).alias("a")))
    j = profiles.select(F.col("id").alias("profile_id")).join(pick, "profile_id", "left")
    override = non_blank(F.col("a.prompt_override"))
    return j.select(
        "profile_id",
        F.col("a.id").alias("persona_id"),
        F.coalesce(override, F.lit(default_prompt)).alias("system_prompt"),
        F.when(override.isNotNull(), F.lit("override")).otherwise(F.lit("default")).alias("prompt_source"),
        non_blank(F.col("a.cv_path")).alias("cv_path"),
        F.when(non_blank(F.col("a.cv_path")).isNotNull(), F.lit("persona")).otherwise(F.lit("fallback"))
         .alias("cv_source"))


def with_cv(postings: DataFrame, persona: DataFrame, cv_texts: DataFrame, fallback_cv: str) -> DataFrame:
    """Attach the CV text of the active persona (path -> text frame),
    else the fallback CV, to every posting of the profile (AQE broadcasts the
    CVs when their bytes are few, and splits a profile with very many postings)."""
    cv = (persona.join(cv_texts, "cv_path", "left")
                 .select("profile_id", F.coalesce(non_blank("cv_text"), F.lit(fallback_cv)).alias("cv_text")))
    return postings.join(cv, "profile_id", "left")


def _artifact_state(path: Column, length: Column, has_app: Column) -> Column:
    return (F.when(~has_app, F.lit("no_application"))
             .when(non_blank(path).isNull(), F.lit("blank_path"))
             .when(length.isNull(), F.lit("missing"))
             .when(length == 0, F.lit("empty_file"))
             .otherwise(F.lit("ok")))


def application_files(postings: DataFrame, apps: DataFrame, files: DataFrame) -> DataFrame:
    """The first application (J3) of each given posting with the lengths of
    its files: (id, cv_path, letter_path, cv_len, letter_len).

    Applications are cut to the given postings before the first one is
    chosen.  Its two paths are stacked, blank ones dropped, and meet the
    inventory in one join; both sides carry plain paths.
    """
    wanted = apps.select("id", "job_id", "cv_path", "letter_path", "created_at") \
        .join(postings.select(F.col("id").alias("job_id")).distinct(), "job_id", "left_semi")
    first = first_application(wanted).select(F.col("job_id").alias("id"), "cv_path", "letter_path")
    known = files.select(plain_path(F.col("path")).alias("path"), "length").groupBy("path").agg(F.max("length").alias("length"))
    kinds = F.explode(F.array(F.struct(F.lit("cv").alias("kind"), F.col("cv_path").alias("path")),
                              F.struct(F.lit("letter").alias("kind"), F.col("letter_path").alias("path"))))
    stacked = first.select("id", kinds.alias("k")).select("id", "k.kind", plain_path(F.col("k.path")).alias("path")) \
        .filter(non_blank("path").isNotNull())
    found = stacked.join(known, "path").groupBy("id").agg(
        F.max(F.when(F.col("kind") == "cv", F.col("length"))).alias("cv_len"),
        F.max(F.when(F.col("kind") == "letter", F.col("length"))).alias("letter_len"))
    return first.join(found, "id", "left")


def audit_artifacts(postings: DataFrame, apps: DataFrame, files: DataFrame) -> DataFrame:
    """Per posting and kind (cv / letter) one of no_application,
    blank_path, missing, empty_file, ok, judged on the first application."""
    f = application_files(postings, apps, files).withColumn("_has", F.lit(True))
    j = postings.select("id").join(f, "id", "left")
    has = F.coalesce("_has", F.lit(False))
    return j.select(
        "id",
        _artifact_state(F.col("cv_path"), F.col("cv_len"), has).alias("cv_state"),
        _artifact_state(F.col("letter_path"), F.col("letter_len"), has).alias("letter_state"))


def dispatch_manifest(postings: DataFrame, apps: DataFrame, overrides: DataFrame | None,
                      files: DataFrame, signature: str | DataFrame | None) -> DataFrame:
    """One row per posting: recipient (P9), subject, body with signature,
    attachment names for files that exist (whatever their length).  Postings
    without an application are reported as skipped.  ``signature`` is a text
    or the effective profile (J9), whose email signature is used unless null.
    Sending is not built; A11 applies the status change.
    """
    f = application_files(postings, apps, files).withColumn("_has", F.lit(True))
    p = postings.select("id", "company", "employer_email")
    if overrides is not None:
        p = p.join(overrides.select("id", "override_email"), "id", "left")
    else:
        p = p.withColumn("override_email", F.lit(None).cast("string"))
    if isinstance(signature, DataFrame):
        sig = F.coalesce(signature.select("email_signature").scalar(), F.lit(S.FALLBACK_SIGNATURE))
    else:
        sig = F.lit(signature if signature is not None else S.FALLBACK_SIGNATURE)
    j = p.join(f, "id", "left")
    has_app = F.coalesce(F.col("_has"), F.lit(False))
    return j.select(
        "id",
        F.when(has_app, F.lit("send")).otherwise(F.lit("skipped_no_application")).alias("action"),
        F.when(has_app, resolve_recipient("override_email", "employer_email", "company")).alias("recipient"),
        F.when(has_app, F.lit(S.DISPATCH_SUBJECT)).alias("subject"),
        F.when(has_app, F.concat(F.lit(S.DISPATCH_BODY_OPENING), sig)).alias("body"),
        F.when(has_app & F.col("cv_len").isNotNull(), F.lit(S.CV_ATTACHMENT_NAME)).alias("cv_attachment"),
        F.when(has_app & F.col("letter_len").isNotNull(), F.lit(S.LETTER_ATTACHMENT_NAME)).alias("letter_attachment"))
