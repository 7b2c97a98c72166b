import pandas as pd
from pyspark.sql import functions as F

from conftest import posting_rows
from postingflow import schemas as S
from postingflow.functions import json_reply as J
from postingflow.operators import replies as RP

CASES = [
    ("1", 'text\n```json\n{"score": 72, "analysis": ["x","y"]}\n```\nbye', 72, "x\ny", None),
    ("2", 'Here: {"match_score": 5} thanks', 5, "", None),
    ("3", "{score: '72', 'analysis': 'one'}", 72, "one", None),
    ("4", '{"score": 72.9}', 72, "", None),
    ("5", '{"score": 7,}', 7, "", None),
    ("6", '{"score": 900}', 900, "", None),
    ("7", '{"analysis": {"k":1}}', 0, "", None),
    ("8", "   ", None, None, S.EMPTY_REPLY_ERROR),
    ("9", "no braces here", None, None, S.NO_DELIMITER_ERROR),
    ("10", "}{", None, None, S.NO_DELIMITER_ERROR),
]


def parsed(spark, rows):
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "job_id string, raw string")
    return {r.job_id: r for r in J.parse_replies(J.extract_json(df, "raw")).collect()}


def test_reply_cases(spark):
    out = parsed(spark, CASES)
    for jid, _, score, analysis, err in CASES:
        r = out[jid]
        assert r.error == err, jid
        if err is None:
            assert r.score == score and r.analysis == analysis, jid


def test_letter_comma_kept(spark):
    out = parsed(spark, [("1", '{"score": 1, "letter": "x,}"}')])
    assert out["1"].letter == "x,}" and out["1"].score == 1


def test_alias_first_declared_wins(spark):
    out = parsed(spark, [("1", '{"rating": 3, "score": 9, "cover_letter": "L"}')])
    assert out["1"].score == 9 and out["1"].letter == "L"


def test_failure_branch(spark):
    p = posting_rows(spark, [dict(id="1", status="FETCHED", notes="n", title="T"),
                             dict(id="2", status="FETCHED", title="T"),
                             dict(id="3", status="FETCHED", title="T"),
                             dict(id="4", status="FETCHED", title="T"),
                             dict(id="5", status="FETCHED", title="T", notes=None)])
    rep = spark.createDataFrame([("1", None, None, None, "HTTP 404 from model"),
                                 ("2", None, None, None, "circuit OPEN"),
                                 ("3", None, None, None, S.NO_DELIMITER_ERROR),
                                 ("4", None, None, None, "boom"),
                                 ("5", 80, "L", "a", None)],
                                "job_id string, score long, letter string, analysis string, error string")
    up, apps, ev = RP.apply_replies(p, rep, "2024-01-01 00:00:00")
    u = {r.id: r for r in up.collect()}
    assert u["1"].notes == "n\n\n" + S.FAIL_NOTE_PREFIX + S.FAIL_TEXT_DOWNLOADING
    assert u["2"].ai_analysis == S.FAIL_ANALYSIS_PREFIX + S.FAIL_TEXT_DEFERRED
    assert u["3"].ai_analysis.endswith(S.FAIL_TEXT_INCOMPLETE)
    assert u["4"].notes == S.FAIL_NOTE_PREFIX + "boom"
    assert all(u[k].match_score == 0 and u[k].status == "SCORED" for k in "1234")
    assert u["5"].match_score == 80 and u["5"].notes == "" and u["5"].status == "SCORED"
    letters = {r.job_id: r.letter_path for r in apps.collect()}
    assert letters["1"] == "cl_fallback_1.pdf" and letters["5"] == "cl_5.pdf"
    assert {r.type for r in ev.collect()} == {"error", "success"}


def test_sanitize_markup(spark):
    df = spark.createDataFrame([("<letter>Hi <B>x</B> <p_x> <pp> <br/> <H7>a</anschreiben>",)], "html string")
    r = RP.sanitize_markup(df).first()
    assert r.clean == "Hi <B>x</B> <p_x>  <br/> a"
    assert r.dropped == ["letter", "pp", "H7", "anschreiben"]


def test_scorer_errors_become_rows(spark):
    def fn(s: pd.Series) -> pd.Series:
        if any("bad" in x for x in s):
            raise ValueError("outer") from KeyError("model 'llama3' not found")
        return s.str.upper()
    df = spark.createDataFrame([("1", "ok"), ("2", "bad")], "id string, user string")
    out = {r.id: (r.raw, r.error) for r in RP.score_with(df, fn).collect()}
    assert out["1"] == ("OK", None)
    assert out["2"][0] is None and "llama3" in out["2"][1]


def test_audit_and_overlap(spark):
    letter = "Betreff: Bewerbung\\nSehr geehrte Damen und Herren,\\n" + " ".join(["wort"] * 250) + \
             "\\nMit freundlichen Grüßen"
    out = J.parse_replies(J.extract_json(spark.createDataFrame(
        [("1", '{"score": 50, "letter": "%s", "analysis": ["• a", "• b", "• c"]}' % letter)],
        "job_id string, raw string"), "raw"))
    a = RP.audit_replies(out).first()
    assert (a.n_replies, a.score_ok, a.letter_words_ok, a.subject_ok, a.salutation_ok, a.closing_ok,
            a.items_ok, a.bullets_ok) == (1, 1, 1, 1, 1, 1, 1, 1)
    posts = spark.createDataFrame([("1", "Java Spark Kafka"), ("2", "")], "id string, description string")
    cv = spark.createDataFrame([("java",), ("spark",)], "term string")
    s = {r.id: r.overlap_score for r in RP.overlap_score(posts, cv).collect()}
    assert s == {"1": 66, "2": 0}


def test_prompt_cut(spark):
    posts = spark.createDataFrame([("1", None, None, "d" * 4001)], "id string, title string, company string, description string")
    cv = spark.createDataFrame([("c" * 10,)], "cv_text string")
    u = RP.build_prompts(posts, cv, template="{title}|{company}|{jd}|{cv}").first().user
    t, c, jd, cvt = u.split("|")
    assert (t, c) == (S.PROMPT_MISSING_TITLE, S.PROMPT_MISSING_COMPANY)
    assert jd == "d" * 4000 + "..." and cvt == "c" * 10


def test_unparsable_score_is_a_row_error(spark):
    out = parsed(spark, [("1", '{"score": "abc"}'), ("2", '{"score": 1e30}'), ("3", '{"score": 7.9}')])
    assert out["1"].error.startswith("Cannot parse score") and out["2"].error.startswith("Cannot parse score")
    assert out["3"].score == 7 and out["3"].error is None


def test_quoted_decimal_and_commas_in_strings(spark):
    out = parsed(spark, [("1", '{"score": "72.5"}'), ("2", '{"score": "72"}'), ("3", '{"score": 72.5}'),
                         ("4", '{"score": 5, "letter": "x,} y", "analysis": ["a",],}')])
    assert out["1"].error == "Cannot parse score: 72.5" and out["1"].score is None
    assert (out["2"].score, out["3"].score) == (72, 72)
    assert (out["4"].error, out["4"].letter, out["4"].analysis) == (None, "x,} y", "a")


def test_several_replies_for_one_posting(spark):
    p = posting_rows(spark, [dict(id="1", status="FETCHED", title="T", company="C")])
    rep = spark.createDataFrame([("1", 1, None, None, None, "boom"), ("1", 2, 70, "<x>Dear</x>", "ok", None)],
                                "job_id string, reply_seq long, score long, letter string, analysis string, error string")
    up, apps, ev = RP.apply_replies(p, rep, "2024-01-01 00:00:00", F.lit("cv.pdf"))
    r = up.collect()
    assert len(r) == 1 and (r[0].match_score, r[0].ai_analysis) == (70, "ok")
    a = {x.id: x for x in apps.collect()}
    assert set(a) == {"app-1-1", "app-1-2"} and ev.count() == 2
    assert (a["app-1-2"].letter_text, a["app-1-2"].cv_path, a["app-1-1"].cv_path) == ("Dear", "cv.pdf", None)
    assert a["app-1-1"].letter_text.endswith("boom")
