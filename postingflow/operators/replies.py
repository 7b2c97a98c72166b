"""Prompts, scorer calls and reply processing.

The model itself is not part of the engine: X1 takes any Python function
``fn(batch) -> batch`` and runs it with ``mapInPandas`` (one call per Arrow
batch, concurrency = partitions).  A raising function never fails the job;
the failing rows carry the root message as their error, which then takes
the failure branch of ``apply_replies``.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..session import cut_lineage
from ..functions.json_reply import append_note, classify_failure
from ..functions.text import cut, letter_file_name, ts_lit

# ------------------------------------------------------------------ P11

DEFAULT_TEMPLATE = (
    "Rate how well the candidate fits the position \"{title}\" at {company} on a scale of 0 to 100 "
    "and write a cover letter. Answer with one JSON object with the keys score, coverLetterMarkdown "
    "and analysis.\n\n## Position\n{jd}\n\n## Candidate\n{cv}")


def build_prompts(postings: DataFrame, cv: DataFrame, template: str = DEFAULT_TEMPLATE,
                  system: str | None = None) -> DataFrame:
    """Per posting: (id, system, user) with JD and CV cut to 4000 chars + "...".

    ``cv`` holds one row per profile (``cv_text``, and ``system_prompt`` of its
    persona where known, J6), or a single row for all postings.
    """
    jd = F.when(F.col("description").isNotNull(), cut("description", S.PROMPT_CUT)).otherwise(F.col("title"))
    title = F.coalesce(F.col("title"), F.lit(S.PROMPT_MISSING_TITLE))
    company = F.coalesce(F.col("company"), F.lit(S.PROMPT_MISSING_COMPANY))
    cvc = cut("cv_text", S.PROMPT_CUT)
    parts = []
    prompt = F.lit(system).cast("string")
    rest = template
    fields = {"{title}": title, "{company}": company, "{jd}": jd, "{cv}": cvc}
    while rest:
        nxt = min(((rest.find(k), k) for k in fields if rest.find(k) >= 0), default=(-1, None))
        if nxt[0] < 0:
            parts.append(F.lit(rest))
            break
        if nxt[0] > 0:
            parts.append(F.lit(rest[:nxt[0]]))
        parts.append(fields[nxt[1]])
        rest = rest[nxt[0] + len(nxt[1]):]
    if "profile_id" in cv.columns:
        # one CV per profile: a broadcast only if AQE sees few bytes, else a shuffle join
        j = postings.join(cv.select("profile_id", "cv_text", *(["system_prompt"] if "system_prompt" in cv.columns else [])),
                          "profile_id")
        if "system_prompt" in cv.columns:
            prompt = F.col("system_prompt")
    else:   # one CV for every posting: a scalar subquery (fails loudly on more than one row)
        j = postings.withColumn("cv_text", cv.select("cv_text").scalar())
    return j.select("id", prompt.alias("system"), F.concat(*parts).alias("user"))


# ------------------------------------------------------------------ X1

def root_message(exc: BaseException) -> str:
    """Message of the innermost cause (class name when it has none)."""
    e = exc
    seen = set()
    while True:
        nxt = e.__cause__ or e.__context__
        if nxt is None or id(nxt) in seen:
            break
        seen.add(id(e))
        e = nxt
    msg = str(e)
    return msg if msg else type(e).__name__


def _call_batches(it, fn, in_col, out_col, keep, out_type):
    for pdf in it:
        try:
            res = list(fn(pdf[in_col]))
            err = [None] * len(pdf)
        except Exception:  # noqa: BLE001 - isolate the failing rows
            res, err = [], []
            for v in pdf[in_col]:
                try:
                    res.append(list(fn(pd.Series([v])))[0])
                    err.append(None)
                except Exception as ex:  # noqa: BLE001
                    res.append(None)
                    err.append(root_message(ex))
        out = pdf[list(keep)].copy()
        out[out_col] = res
        out["error"] = err
        yield out


def call_with(df: DataFrame, fn: Callable, in_col: str, out_col: str, out_type: T.DataType,
              keep=("id",)) -> DataFrame:
    fields = [df.schema[k] for k in keep] + [T.StructField(out_col, out_type), T.StructField("error", T.StringType())]
    cols = list(dict.fromkeys([*keep, in_col]))
    return df.select(*cols).mapInPandas(
        lambda it: _call_batches(it, fn, in_col, out_col, keep, out_type), T.StructType(fields))


def score_with(prompts: DataFrame, fn: Callable, keep=("id",)) -> DataFrame:
    """X1 scorer: fn(Series of prompts) -> replies; -> (id, raw, error)."""
    return call_with(prompts, fn, "user", "raw", T.StringType(), keep)


def embed_with(df: DataFrame, fn: Callable, text_col: str = "content", keep=("content",)) -> DataFrame:
    """X1 embedder: fn(Series of texts) -> vectors; -> (keep..., embedding, error)."""
    return call_with(df, fn, text_col, "embedding", T.ArrayType(T.FloatType()), keep)


def reason_with(df: DataFrame, fn: Callable, text_col: str = "body", keep=("id",)) -> DataFrame:
    """X1 reason extractor (rejection mails): fn(Series) -> reasons."""
    return call_with(df, fn, text_col, "reason", T.StringType(), keep)


# ------------------------------------------------------------------ M5

# Opening of the letter that stands in for a failed one.
FAILED_LETTER_HEADING = "No letter was written. Cause: "

def apply_replies(postings: DataFrame, parsed: DataFrame, now: str,
                  cv_path: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Success (A9) and failure (A10) branches in one pass.

    ``parsed`` has (job_id, score, letter, analysis, error) and, where a
    posting may have several replies (retries), their order ``reply_seq``.
    The posting takes its last reply; every reply makes an application (id
    from posting and reply) with its letter: the sanitised letter text, or a
    short failure note.  Returns (postings', new applications with
    ``letter_text``, progress events).  Postings without a reply are
    unchanged; the join is on the posting key.
    """
    several = "reply_seq" in parsed.columns
    seq = F.col("reply_seq") if several else F.lit(None).cast("long")
    r = parsed.select(F.col("job_id").alias("id"), seq.alias("_seq"), "score", "letter", "analysis", "error",
                      F.lit(True).alias("_replied"))
    last = r if not several else r.groupBy("id").agg(
        F.max_by(F.struct("score", "analysis", "error", "_replied"), F.col("_seq")).alias("_l")).select("id", "_l.*")
    j = postings.join(last.select("id", "score", "analysis", "error", "_replied"), "id", "left")
    ok = F.col("_replied") & F.col("error").isNull()
    failed = F.col("_replied") & F.col("error").isNotNull()
    reason = classify_failure(F.col("error"))
    note = F.concat(F.lit(S.FAIL_NOTE_PREFIX), reason)
    updated = j.select(
        *[F.when(ok, F.col("score").cast("int")).when(failed, F.lit(0)).otherwise(F.col("match_score")).alias(c)
          if c == "match_score" else
          F.when(ok, F.col("analysis")).when(failed, F.concat(F.lit(S.FAIL_ANALYSIS_PREFIX), reason))
           .otherwise(F.col("ai_analysis")).alias(c) if c == "ai_analysis" else
          F.when(F.col("_replied"), F.lit("SCORED")).otherwise(F.col("status")).alias(c) if c == "status" else
          F.when(F.col("_replied"), ts_lit(now)).otherwise(F.col("scored_at")).alias(c) if c == "scored_at" else
          F.when(ok, F.coalesce(F.col("notes"), F.lit(""))).when(failed, append_note("notes", note))
           .otherwise(F.col("notes")).alias(c) if c == "notes" else
          F.col(c)
          for c in postings.columns])
    replied = postings.select("id", "title", "company").join(r, "id")
    replied_ok = F.col("error").isNull()
    key = F.concat(F.lit("app-"), F.col("id").cast("string"))
    apps = replied.select(
        (F.concat(key, F.lit("-"), F.col("_seq").cast("string")) if several else key).alias("id"),
        F.col("id").alias("job_id"),
        F.when(replied_ok, cv_path if cv_path is not None else F.lit(None).cast("string")).alias("cv_path"),
        F.when(replied_ok, letter_file_name("id")).otherwise(letter_file_name("id", True)).alias("letter_path"),
        ts_lit(now).alias("created_at"),
        F.when(replied_ok, F.regexp_replace(F.coalesce("letter", F.lit("")), _tag_regex(), ""))
         .otherwise(F.concat(F.lit(FAILED_LETTER_HEADING), F.col("error"))).alias("letter_text"))
    label = job_label()
    events = replied.select(
        F.col("id"),
        F.when(replied_ok, F.lit("success")).otherwise(F.lit("error")).alias("type"),
        F.when(replied_ok,
               F.format_string(S.PROGRESS_OK_FORMAT, label, F.col("score").cast("string")))
         .otherwise(F.format_string(S.PROGRESS_FAIL_FORMAT, label, reason)).alias("message"),
        ts_lit(now).alias("ts"))
    return updated, apps, events


def job_label() -> Column:
    """"title @ company" as the progress messages show it (null prints null)."""
    return F.format_string(S.PROGRESS_LABEL_FORMAT, F.coalesce(F.col("title"), F.lit("null")),
                           F.coalesce(F.col("company"), F.lit("null")))


def scoring_started(claimed: DataFrame, now: str) -> DataFrame:
    """Progress "start" events for claimed postings."""
    return claimed.select(F.col("id"), F.lit("start").alias("type"),
                          F.format_string(S.PROGRESS_START_FORMAT, job_label()).alias("message"),
                          ts_lit(now).alias("ts"))


# ------------------------------------------------------------------ M7

def _tag_regex() -> str:
    allowed = "|".join(S.ALLOWED_TAGS)
    # possessive quantifiers: the same matches as the greedy form (a split of
    # name and attributes can only succeed at the longest name), but no
    # quadratic backtracking on a long unclosed "<..." run
    return f"(?i)<(/?)(?!(?:{allowed})(?![a-zA-Z0-9]))([a-zA-Z][a-zA-Z0-9]*+)([^>]*+)>"


def sanitize_markup(df: DataFrame, col: str = "html") -> DataFrame:
    """Drop every tag whose name is not allowed (content kept), report the
    dropped names."""
    rx = _tag_regex()
    names = F.regexp_extract_all(F.col(col), F.lit(rx), 2)
    return (df.withColumn("clean", F.regexp_replace(F.col(col), rx, ""))
              .withColumn("dropped", names))


# ------------------------------------------------------------------ M8

def tokens(text) -> Column:
    """Distinct lower-case ASCII word tokens of 3+ characters."""
    t = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.filter(F.split(F.lower(t), "[^a-z0-9]+"), lambda x: F.length(x) >= 3))


#: CV terms up to this number are sent to the postings.
SENT_TERMS = 200_000


def overlap_score(postings: DataFrame, cv_terms: DataFrame, text_col: str = "description",
                  key: str = "id", sent_terms: int = SENT_TERMS) -> DataFrame:
    """Share (0-100, floor) of a posting's distinct terms found in the CV.

    Each text is tokenised once.  The CV's terms are counted first: a set of
    checked size is broadcast, so a posting's terms are looked up where they
    are and only its two counts are shuffled; a larger one is joined by term.
    """
    terms = postings.select(key, F.explode_outer(tokens(text_col)).alias("term"))
    known = cut_lineage(cv_terms.select("term").distinct()).withColumn("_hit", F.lit(1))
    if known.limit(sent_terms + 1).count() <= sent_terms:
        known = F.broadcast(known)
    per = (terms.join(known, "term", "left")
                .groupBy(key).agg(F.count("term").alias("n_terms"), F.count("_hit").alias("n_hits")))
    return per.select(key, F.col("n_terms").cast("int").alias("n_terms"), F.col("n_hits").cast("long").alias("n_hits"),
                      F.when(F.col("n_terms") > 0, F.floor(F.col("n_hits") * 100 / F.col("n_terms")))
                       .otherwise(F.lit(0)).cast("long").alias("overlap_score"))


# ------------------------------------------------------------------ B7

def reply_checks(parsed: DataFrame) -> DataFrame:
    """Per parsed reply, one boolean per contract rule."""
    words = F.size(F.split(F.trim(F.col("letter")), "\\s+"))
    items = F.col("analysis_items")
    return parsed.filter(F.col("error").isNull()).select(
        "job_id",
        ((F.col("score") >= 0) & (F.col("score") <= 100)).alias("score_ok"),
        F.coalesce((words >= S.LETTER_MIN_WORDS) & (words <= S.LETTER_MAX_WORDS), F.lit(False)).alias("letter_words_ok"),
        F.coalesce(F.col("letter").rlike(f"(^|\\n)\\s*{S.LETTER_SUBJECT_PREFIX}"), F.lit(False)).alias("subject_ok"),
        F.coalesce(F.col("letter").contains(S.LETTER_SALUTATION), F.lit(False)).alias("salutation_ok"),
        F.coalesce(F.col("letter").contains(S.LETTER_CLOSING), F.lit(False)).alias("closing_ok"),
        F.coalesce((F.size(items) >= S.ANALYSIS_MIN_ITEMS) & (F.size(items) <= S.ANALYSIS_MAX_ITEMS),
                   F.lit(False)).alias("items_ok"),
        F.coalesce(F.forall(items, lambda x: x.startswith(S.ANALYSIS_BULLET)), F.lit(False)).alias("bullets_ok"),
    )


def audit_replies(parsed: DataFrame) -> DataFrame:
    """Pass counts per rule over all readable replies (one row)."""
    c = reply_checks(parsed)
    rules = [x for x in c.columns if x.endswith("_ok")]
    return c.agg(F.count(F.lit(1)).alias("n_replies"),
                 *[F.count(F.when(F.col(r), 1)).alias(r) for r in rules])
