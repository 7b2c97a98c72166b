"""S7 schema upgrade and S8 constraint check with quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S

TABLE_SCHEMAS = {"posting": S.POSTING, "application": S.APPLICATION,
                 "profile": S.PROFILE, "persona": S.PERSONA}

# Defaults the migrations give to added columns.
UPGRADE_DEFAULTS = {
    "posting": {"processing_status": "IDLE"},
    "profile": {"min_match_score": S.DEFAULT_MIN_MATCH_SCORE,
                "max_job_age_days": S.DEFAULT_MAX_JOB_AGE_DAYS,
                "ai_model": S.DEFAULT_AI_MODEL},
}

# Defaults that also replace a stored null.
BACKFILLED = ("processing_status",)


def upgrade_schema(df: DataFrame, table: str) -> DataFrame:
    """Bring an older snapshot to the current schema: missing columns are
    added as null (or their migration default); a null that the snapshot holds
    stays, but null processing_status is backfilled to IDLE.  Extra columns
    are kept after the current ones."""
    target = TABLE_SCHEMAS[table]
    spark = df.sparkSession
    base = spark.createDataFrame([], target)
    up = base.unionByName(df, allowMissingColumns=True)
    for col, dflt in UPGRADE_DEFAULTS.get(table, {}).items():
        if col not in df.columns or col in BACKFILLED:
            up = up.withColumn(col, F.coalesce(F.col(col), F.lit(dflt).cast(target[col].dataType)))
    return up


def violation_reason(df: DataFrame) -> F.Column:
    """First violated constraint of a posting row, or null when valid."""
    c = F.col
    return (F.when(c("reference_id").isNull(), F.lit("reference_id is null"))
             .when(F.length("reference_id") > S.REFERENCE_MAX_LEN, F.lit("reference_id too long"))
             .when(c("title").isNull(), F.lit("title is null"))
             .when(F.length("title") > S.TITLE_MAX_LEN, F.lit("title too long"))
             .when(c("company").isNull(), F.lit("company is null"))
             .when(F.length("company") > S.COMPANY_MAX_LEN, F.lit("company too long"))
             .when(c("description").isNull(), F.lit("description is null"))
             .when(c("status").isNull(), F.lit("status is null"))
             .when(~c("status").isin(*S.STATUSES), F.lit("status not allowed"))
             .when(c("processing_status").isNotNull() & ~c("processing_status").isin(*S.PROCESSING_STATES),
                   F.lit("processing_status not allowed"))
             .when(F.length("employer_email") > S.EMAIL_MAX_LEN, F.lit("employer_email too long"))
             .when(F.length("portal_url") > S.PORTAL_MAX_LEN, F.lit("portal_url too long")))


def flag_postings(df: DataFrame) -> DataFrame:
    return df.withColumn("reason", violation_reason(df))


def validate_postings(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ok, quarantine).  Every input row lands in exactly one of them."""
    flagged = flag_postings(df)
    ok = flagged.filter(F.col("reason").isNull()).drop("reason")
    bad = flagged.filter(F.col("reason").isNotNull())
    return ok, bad
