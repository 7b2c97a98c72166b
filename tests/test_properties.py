"""Property checks: the Spark expressions against plain-Python statements of
the same rules, on generated inputs (one Spark job per property)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from postingflow import schemas as S
from postingflow.functions import json_reply as J
from postingflow.operators import replies as RP

ALPHABET = st.sampled_from(list("ab{}`json \n\t,:\"'x") + ["```", "```json", "{\"score\": 1}", "  "])
TEXTS = st.lists(st.lists(ALPHABET, max_size=12).map("".join), min_size=20, max_size=60)


def jtrim(s: str) -> str:
    i, j = 0, len(s)
    while i < j and ord(s[i]) <= 32:
        i += 1
    while j > i and ord(s[j - 1]) <= 32:
        j -= 1
    return s[i:j]


def extract_rule(raw):
    """M1 as stated in SURVEY §2.9 (first fence, last fence, first brace,
    last brace)."""
    if raw is None or raw.strip(" \t\n\x0b\f\r\x1c\x1d\x1e\x1f") == "":
        return None, S.EMPTY_REPLY_ERROR
    c = jtrim(raw)
    if "```json" in c:
        c = c[c.index("```json") + 7:]
        c = c[:c.rindex("```")] if "```" in c else c
    elif "```" in c:
        c = c[c.index("```") + 3:]
        c = c[:c.rindex("```")] if "```" in c else c
    s, e = c.find("{"), c.rfind("}")
    if s == -1 or e == -1 or e <= s:
        return None, S.NO_DELIMITER_ERROR
    return jtrim(c[s:e + 1]), None


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TEXTS)
def test_extract_matches_rule(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "job_id long, raw string")
    got = {r.job_id: (r.json, r.error) for r in J.extract_json(df, "raw").collect()}
    for i, t in enumerate(texts):
        assert got[i] == extract_rule(t), repr(t)


TAGS = st.sampled_from(["<p>", "</p>", "<B>", "<pp>", "<br/>", "<letter>", "<h7>", "<H1 class='x'>", "<p_x>",
                        "<a href=\"u\">", "</anschreiben>", "text", " ", "<", ">", "<1>"])


def sanitize_rule(s: str) -> str:
    import re
    allowed = set(S.ALLOWED_TAGS)
    return re.sub(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>",
                  lambda m: m.group(0) if m.group(2).lower() in allowed else "", s)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(TAGS, max_size=10).map("".join), min_size=20, max_size=40))
def test_sanitize_matches_rule(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "page_id long, html string")
    got = {r.page_id: r.clean for r in RP.sanitize_markup(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == sanitize_rule(t), repr(t)
