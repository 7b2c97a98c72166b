"""Reply extraction and lenient parsing as column expressions (M1-M4).

Everything stays JVM-side: positions via ``instr``/``reverse``, parsing via
``from_json`` with STRING leaves (an INT leaf would null the whole row on
``72.9`` or ``'72'``), trailing-comma repair only on rows the first pass
could not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from .text import is_blank, java_trim

LENIENT = {
    "allowSingleQuotes": "true",
    "allowUnquotedFieldNames": "true",
    "allowBackslashEscapingAnyCharacter": "true",
    "allowUnquotedControlChars": "true",
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_corrupt",
}

ALL_KEYS = S.SCORE_ALIASES + S.LETTER_ALIASES + S.ANALYSIS_ALIASES
REPLY_SCHEMA = T.StructType([T.StructField(k, T.StringType()) for k in ALL_KEYS]
                            + [T.StructField("_corrupt", T.StringType())])
# Tells a bare number (truncated) from a quoted one (must be a whole number).
NUMBER_SCHEMA = T.StructType([T.StructField(k, T.DoubleType()) for k in S.SCORE_ALIASES])


def _last_index(s: Column, needle: str) -> Column:
    """1-based position of the last occurrence of ``needle`` (0 if absent)."""
    r = F.instr(F.reverse(s), needle[::-1])
    return F.when(r > 0, F.length(s) - r - F.lit(len(needle)) + 2).otherwise(F.lit(0))


def _from(s: Column, pos: Column) -> Column:
    return s.substr(pos, F.lit(1 << 30))


def jtrim(c: Column) -> Column:
    """Java trim as a codegen'd btrim (no regex)."""
    return java_trim(c)


def barrier(df: DataFrame, name: str) -> DataFrame:
    """Row-count observation that also fences the optimizer.

    Filters are not pushed through ``observe``; without it a filter on
    ``error`` would be inlined through every position step below and grow
    into an expression tree of millions of nodes.  The cost: no filter passes
    this point towards the scan, so filter the replies before extracting them.
    The observed count is a useful metric on its own (replies seen per run).
    """
    return df.observe(f"{name}_{uuid.uuid4().hex[:8]}", F.count(F.lit(1)).alias("rows"))


def extract_json(df: DataFrame, col: str = "raw") -> DataFrame:
    """M1: adds (json, error) for a free-text model reply column.

    All steps are positions in the trimmed text (no intermediate strings),
    so every expression refers to the text a bounded number of times and a
    filter pushed through the projections stays small:

    * ``off``: start after the first json-tagged fence, else after the
      first bare fence, else 1;
    * ``end``: just before the last fence when it lies at or after ``off``
      (fenced replies only), else the end of the text;
    * the object runs from the first ``{`` at or after ``off`` to the last
      ``}`` at or before ``end``.
    """
    c = F.col
    d = df.withColumn("_t", jtrim(c(col)))
    d = (d.withColumn("_n", F.length("_t"))
          .withColumn("_ij", F.instr(c("_t"), "```json"))
          .withColumn("_ib", F.instr(c("_t"), "```"))
          .withColumn("_rv", F.reverse("_t")))
    last_fence = F.instr(c("_rv"), "```")
    d = (d.withColumn("_off", F.when(c("_ij") > 0, c("_ij") + 7).when(c("_ib") > 0, c("_ib") + 3).otherwise(1))
          .withColumn("_lf", F.when(last_fence > 0, c("_n") - last_fence - 1).otherwise(0)))
    fenced = (c("_ij") > 0) | (c("_ib") > 0)
    d = d.withColumn("_end", F.when(fenced & (c("_lf") >= c("_off")), c("_lf") - 1).otherwise(c("_n")))
    r_close = F.call_function("locate", F.lit("}"), c("_rv"), c("_n") - c("_end") + 1)
    d = (d.withColumn("_s", F.call_function("locate", F.lit("{"), c("_t"), c("_off")))
          .withColumn("_e", F.when(r_close > 0, c("_n") - r_close + 1).otherwise(0)))
    bad = ((c("_s") == 0) | (c("_s") > c("_end")) | (c("_e") == 0) | (c("_e") < c("_off"))
           | (c("_e") <= c("_s")))
    err = (F.when(c(col).isNull() | is_blank(c(col)), F.lit(S.EMPTY_REPLY_ERROR))
            .when(bad, F.lit(S.NO_DELIMITER_ERROR)))
    d = d.withColumn("error", err)
    d = d.withColumn("json", F.when(c("error").isNull(),
                                    jtrim(c("_t").substr(c("_s"), c("_e") - c("_s") + 1))))
    return barrier(d.drop("_t", "_n", "_ij", "_ib", "_rv", "_off", "_lf", "_end", "_s", "_e"), "replies_extracted")


def _strip_trailing_commas(c: Column) -> Column:
    """Drop commas before a closing bracket; string literals are matched first
    and kept as they are."""
    literal = "\"(?:[^\"\\\\]|\\\\.)*+\"|'(?:[^'\\\\]|\\\\.)*+'"
    return F.regexp_replace(c, f"({literal})|,\\s*([}}\\]])", "$1$2")


def parse_replies(df: DataFrame, json_col: str = "json", error_col: str = "error") -> DataFrame:
    """M2-M4: lenient parse + alias resolution + analysis flattening.

    Adds score (long, truncated; missing -> 0), letter, analysis (text),
    analysis_items (array or null) and updates ``error`` for unreadable
    replies.  Rows already carrying an error pass through untouched.
    """
    c = F.col
    js = c(json_col)
    d = df.withColumn("_p1", F.from_json(js, REPLY_SCHEMA, LENIENT))
    # second pass only for rows the first could not read
    d = d.withColumn("_js", F.when(c("_p1._corrupt").isNotNull(), _strip_trailing_commas(js)).otherwise(js))
    d = d.withColumn("_p", F.when(c("_p1._corrupt").isNotNull(), F.from_json("_js", REPLY_SCHEMA, LENIENT))
                            .otherwise(c("_p1"))).drop("_p1")
    d = d.withColumn("_bare", F.from_json("_js", NUMBER_SCHEMA, LENIENT))
    d = d.select("*",
                 (js.isNotNull() & (c("_p").isNull() | c("_p._corrupt").isNotNull())).alias("_corrupt_row"),
                 F.coalesce(*[c(f"_p.{k}") for k in S.SCORE_ALIASES]).alias("_score_txt"),
                 F.coalesce(*[F.when(c(f"_p.{k}").isNotNull(), c(f"_bare.{k}").isNotNull())
                              for k in S.SCORE_ALIASES]).alias("_score_bare"),
                 F.coalesce(*[c(f"_p.{k}") for k in S.LETTER_ALIASES]).alias("_letter"),
                 F.coalesce(*[c(f"_p.{k}") for k in S.ANALYSIS_ALIASES]).alias("_araw")).drop("_p", "_bare", "_js")
    d = d.select("*",
                 # try_cast: a non-numeric score is a row error, not a failed job
                 # (ANSI mode makes a plain cast raise); Java int range only
                 F.when((F.abs(F.trim(c("_score_txt")).try_cast("double")) < 2147483648.0)
                        & (c("_score_bare") | F.trim(c("_score_txt")).rlike("^[+-]?[0-9]+$")),
                        F.trim(c("_score_txt")).try_cast("double")).alias("_score_num"),
                 F.when(F.trim(c("_araw")).startswith("["),
                        F.from_json(c("_araw"), T.ArrayType(T.StringType()))).alias("_items"),
                 F.trim(c("_araw")).startswith("{").alias("_is_obj"))
    prior = c(error_col)
    err = (F.when(prior.isNotNull(), prior)
            .when(c("_corrupt_row"), F.lit("Unreadable JSON reply"))
            .when(c("_score_txt").isNotNull() & c("_score_num").isNull(),
                  F.concat(F.lit("Cannot parse score: "), c("_score_txt"))))
    d = d.withColumn(error_col, err)
    ok = c(error_col).isNull()
    analysis = (F.when(c("_araw").isNull(), F.lit(""))
                 .when(c("_items").isNotNull(), jtrim(F.array_join(c("_items"), "\n")))
                 .when(c("_is_obj"), F.lit(""))
                 .otherwise(c("_araw")))
    out = (d.withColumn("score", F.when(ok, F.coalesce(c("_score_num").try_cast("long"), F.lit(0).cast("long"))))
            .withColumn("letter", F.when(ok, c("_letter")))
            .withColumn("analysis", F.when(ok, analysis))
            .withColumn("analysis_items", F.when(ok, c("_items")))
            .drop("_corrupt_row", "_score_bare", "_score_txt", "_letter", "_araw", "_score_num", "_is_obj", "_items"))
    return barrier(out, "replies_parsed")


def classify_failure(root) -> Column:
    """M6: user-facing reason for a failure root message (order matters)."""
    r = F.col(root) if isinstance(root, str) else root
    return (F.when(r.contains(S.FAIL_PATTERN_404) | F.lower(r).contains(S.FAIL_PATTERN_MODEL_MISSING),
                   F.lit(S.FAIL_TEXT_DOWNLOADING))
             .when(r.contains(S.FAIL_PATTERN_NO_DELIMITERS), F.lit(S.FAIL_TEXT_INCOMPLETE))
             .when(r.contains(S.FAIL_PATTERN_OPEN), F.lit(S.FAIL_TEXT_DEFERRED))
             .otherwise(r))


def append_note(notes, note) -> Column:
    """notes empty/null -> note, else notes + blank line + note."""
    n = F.col(notes) if isinstance(notes, str) else notes
    return F.when(n.isNull() | (n == ""), note).otherwise(F.concat(n, F.lit("\n\n"), note))
