"""Feed normalisation (P1-P7): raw feed records (+ optional detail) -> postings.

Two rule sets exist and both are observable: the ingest rules and the scan
rules.  Detail lookup is a left join (J2); at scale the detail table is
joined on its key with a shuffle (or a runtime broadcast when AQE sees that
the detail side is small).  Ids are hashes of the reference key, so a rerun
or a retried task produces the same ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import is_blank, java_trim, non_blank, non_empty, ts_lit

# Fixed value: the description written when the detail gives none (ingest).
INGEST_DESCRIPTION_FORMAT = "Role: %s\nCompany: %s\nRequirements: The candidate should have experience matching %s."


def stable_id(*cols) -> Column:
    """Deterministic 32-hex id from key columns (replaces random UUIDs)."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit(""))
                                                      if isinstance(c, str) else c for c in cols]), 256), 1, 32)


def surrogate_key(df_cols=("titel", "arbeitgeber", "page", "pos")) -> Column:
    """Stand-in for a random UUID: hash of the raw record and its position."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df_cols]
    return F.concat(F.lit("gen-"), F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, 32))


def resolve_reference(df: DataFrame) -> DataFrame:
    """P3 (scan): refnr if non-null, else hashId if non-null, else surrogate."""
    return df.withColumn("reference_id", F.coalesce("refnr", "hashId", surrogate_key()))


def with_detail(raw: DataFrame, detail: DataFrame, key: Column) -> DataFrame:
    """Left join of feed records with detail documents on ``key``."""
    d = detail.select(F.col("detail_key").alias("_dk"),
                      F.struct(*[c for c in detail.columns if c != "detail_key"]).alias("detail"))
    return raw.withColumn("_k", key).join(d, F.col("_k") == F.col("_dk"), "left").drop("_k", "_dk")


def _d(field: str) -> Column:
    return F.col(f"detail.{field}")


def contact_email(mode: str) -> Column:
    """P4.  ingest: angebotskontakt.email, else kontakt.email, empty = absent.
    scan: kontakt.email only, blank = absent."""
    if mode == "ingest":
        return F.coalesce(non_empty(_d("kontakt.angebotskontakt.email")), non_empty(_d("kontakt.email")))
    return non_blank(_d("kontakt.email"))


def describe_ingest(title: Column, company: Column) -> Column:
    """P5: detail text when non-empty (a blank text is kept), else a template."""
    return F.coalesce(non_empty(_d("stellenbeschreibung")),
                      F.format_string(INGEST_DESCRIPTION_FORMAT, title, company, title))


def _section(field: str, heading: str, tail: str) -> Column:
    v = F.coalesce(_d(field), F.lit(""))
    return F.when(~is_blank(v), F.concat(F.lit(heading), v, F.lit(tail))).otherwise(F.lit(""))


def describe_scan(title: Column, company: Column, ort: Column) -> Column:
    """Sectioned text when a detail exists, else title [+ " in " + ort]."""
    loc = F.when(ort != "", F.concat(F.lit("Location: "), ort, F.lit("\n"))).otherwise(F.lit(""))
    with_detail_text = java_trim(F.concat(
        F.lit("Position: "), title, F.lit("\n"), loc,
        F.lit("Employer: "), company, F.lit("\n\n"),
        _section("stellenbeschreibung", "Job Description:\n", "\n\n"),
        _section("taetigkeit", "Responsibilities:\n", "\n\n"),
        _section("anforderungen", "Requirements:\n", "\n")))
    plain = F.concat(title, F.when(ort != "", F.concat(F.lit(" in "), ort)).otherwise(F.lit("")))
    return F.when(F.col("detail").isNotNull(), with_detail_text).otherwise(plain)


def portal_url_scan() -> Column:
    """P7 (scan write): externeUrl if non-blank, else base + detail refnr if non-blank."""
    return F.coalesce(non_blank(_d("externeUrl")),
                      F.when(non_blank(_d("refnr")).isNotNull(), F.concat(F.lit(S.PORTAL_BASE), _d("refnr"))))


def portal_url_read(df: DataFrame) -> Column:
    """P7 (read): stored URL if non-blank, else base + hash_id if non-blank."""
    return F.coalesce(non_blank("portal_url"),
                      F.when(non_blank("hash_id").isNotNull(), F.concat(F.lit(S.PORTAL_BASE), F.col("hash_id"))))


def normalize_ingest(raw: DataFrame, detail: DataFrame | None, now: str) -> DataFrame:
    """P1 + P4 + P5: ingest rules.  Detail is looked up by hashId only when
    hashId is non-empty."""
    d = raw.select(
        F.coalesce("refnr", F.lit(S.INGEST_DEFAULTS["refnr"])).alias("reference_id"),
        F.coalesce("hashId", F.lit(S.INGEST_DEFAULTS["hashId"])).alias("hash_id"),
        F.coalesce("titel", F.lit(S.INGEST_DEFAULTS["titel"])).alias("title"),
        F.coalesce("arbeitgeber", F.lit(S.INGEST_DEFAULTS["arbeitgeber"])).alias("company"),
        *feed_order(raw))
    if detail is not None:
        d = with_detail(d, detail, F.when(F.col("hash_id") != "", F.col("hash_id")))
    else:
        d = d.withColumn("detail", F.lit(None).cast("struct<stellenbeschreibung:string>"))
    if detail is None:
        email = F.lit(None).cast("string")
        desc = F.format_string(INGEST_DESCRIPTION_FORMAT, F.col("title"), F.col("company"), F.col("title"))
    else:
        email, desc = contact_email("ingest"), describe_ingest(F.col("title"), F.col("company"))
    return _posting_with_order(d, now, email, desc)


def _posting_with_order(d: DataFrame, now: str, email: Column, desc: Column) -> DataFrame:
    cols = dict(id=stable_id("reference_id"), reference_id=F.col("reference_id"), hash_id=F.col("hash_id"),
                title=F.col("title"), company=F.col("company"), description=desc,
                status=F.lit("FETCHED"), processing_status=F.lit("IDLE"), employer_email=email,
                created_at=ts_lit(now))
    out = [cols.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.POSTING.fields]
    return d.select(*out, *feed_order(d))


def feed_order(df: DataFrame) -> list[str]:
    """Columns that order feed records: page, then file where it is known, then position."""
    return ["page", *(["_file"] if "_file" in df.columns else []), "pos"]


def normalize_scan(raw: DataFrame, detail: DataFrame | None, now: str) -> DataFrame:
    """P2 + P3 + P4 + P6 + P7: scan rules.  Detail is looked up by the
    resolved reference; scanned postings carry no hash id."""
    d = resolve_reference(raw).select(
        "reference_id", "hashId",
        F.coalesce("titel", F.lit(S.SCAN_DEFAULTS["titel"])).alias("title"),
        F.coalesce("arbeitgeber", F.lit(S.SCAN_DEFAULTS["arbeitgeber"])).alias("company"),
        F.coalesce("ort", F.lit(S.SCAN_DEFAULTS["ort"])).alias("ort"),
        *feed_order(raw))
    if detail is not None:
        d = with_detail(d, detail, F.col("reference_id"))
        email, portal = contact_email("scan"), portal_url_scan()
    else:
        d = d.withColumn("detail", F.lit(None).cast("struct<x:string>"))
        email, portal = F.lit(None).cast("string"), F.lit(None).cast("string")
    desc = describe_scan(F.col("title"), F.col("company"), F.col("ort")) if detail is not None else \
        F.concat(F.col("title"), F.when(F.col("ort") != "", F.concat(F.lit(" in "), F.col("ort"))).otherwise(F.lit("")))
    cols = dict(id=stable_id("reference_id"), reference_id=F.col("reference_id"),
                title=F.col("title"), company=F.col("company"), description=desc,
                status=F.lit("FETCHED"), processing_status=F.lit("IDLE"), employer_email=email,
                portal_url=portal, created_at=ts_lit(now))
    out = [cols.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.POSTING.fields]
    return d.select(*out, *feed_order(d))
