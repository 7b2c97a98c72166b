"""Column expressions for string rules (all JVM-side, inside codegen).

Java's ``trim`` drops every character <= U+0020 and ``isBlank`` tests for
Java whitespace only; Spark's ``trim`` drops spaces only, so both are
re-expressed with regular expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S

# Characters for which Java Character.isWhitespace() is true.
_WS_CLASS = ("[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\u1680\\u2000-\\u2006\\u2008-\\u200A"
             "\\u2028\\u2029\\u205F\\u3000]")


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


_TRIM_CHARS = "".join(chr(i) for i in range(33))


def java_trim(c) -> Column:
    """Java String.trim(): btrim of U+0000..U+0020 (linear, no regex)."""
    return F.btrim(col_(c), F.lit(_TRIM_CHARS))


def is_blank(c) -> Column:
    """True for empty or whitespace-only text; null stays null."""
    return col_(c).rlike(f"^{_WS_CLASS}*$")


def non_blank(c) -> Column:
    """The value when it holds a non-whitespace character, else null."""
    c = col_(c)
    return F.when(c.isNotNull() & ~is_blank(c), c)


def non_empty(c) -> Column:
    """The value when it is not the empty string, else null (blank kept)."""
    c = col_(c)
    return F.when(c != "", c)


def preview(c, n: int = S.PREVIEW_CHARS) -> Column:
    """First ``n`` characters plus "..." when longer, else the whole text."""
    c = col_(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def cut(c, n: int) -> Column:
    """Like ``preview`` with an arbitrary bound (prompt trimming)."""
    return preview(c, n)


def predict_email(company) -> Column:
    """hr@ + lower(company) with everything but [a-z0-9] dropped + .de."""
    domain = F.regexp_replace(F.lower(col_(company)), "[^a-z0-9]", "")
    return F.concat(F.lit("hr@"), domain, F.lit(".de"))


def resolve_recipient(override, stored, company) -> Column:
    """Non-blank override, else non-empty stored address, else predicted."""
    return F.coalesce(non_blank(override), non_empty(stored), predict_email(company))


def size_label(nbytes) -> Column:
    """>= 1e9 one-decimal GB, >= 1e6 rounded MB, else "n B"; null -> Unknown."""
    b = col_(nbytes)
    return (F.when(b.isNull(), F.lit("Unknown"))
            .when(b >= 1_000_000_000, F.format_string("%.1f GB", b / F.lit(1e9)))
            .when(b >= 1_000_000, F.format_string("%.0f MB", b / F.lit(1e6)))
            .otherwise(F.format_string("%d B", b.cast("long"))))


def letter_file_name(job_id, fallback: bool = False) -> Column:
    prefix = "cl_fallback_" if fallback else "cl_"
    return F.concat(F.lit(prefix), col_(job_id).cast("string"), F.lit(".pdf"))


def upload_extension(file_name) -> Column:
    """Text after and including the last dot, else ""."""
    return F.regexp_extract(col_(file_name), "(\\.[^.]*)$", 1)


def contains_any(c, words) -> Column:
    c = col_(c)
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def java_datetime(c) -> Column:
    """A timestamp as Java's LocalDateTime prints it: seconds only when they or
    a fraction are not zero, a fraction of 3 or 6 digits only when not zero."""
    c = col_(c)
    micros = F.date_format(c, "SSSSSS")
    tail = (F.when(micros != "000000", F.concat(
                F.date_format(c, ":ss."), F.when(micros.endswith("000"), micros.substr(1, 3)).otherwise(micros)))
             .when(F.second(c) != 0, F.date_format(c, ":ss")).otherwise(F.lit("")))
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm"), tail)


def ts_lit(value: str) -> Column:
    """A timestamp-without-zone literal ("now" is always passed in)."""
    return F.expr(f"TIMESTAMP_NTZ '{value}'")
