import json
import os

from pyspark.sql import functions as F

from conftest import posting_rows
from postingflow import schemas as S
from postingflow.functions import text as X
from postingflow.operators import dedup as D
from postingflow.operators import normalize as N
from postingflow.sources import feeds as FD
from postingflow.sources import schema_rules as R
from postingflow.sources import tables as TB

NOW = "2024-05-10 12:00:00"


def land(dirpath, name, obj):
    os.makedirs(dirpath, exist_ok=True)
    with open(os.path.join(dirpath, name), "w") as f:
        json.dump(obj, f, indent=1)


def test_search_page_one_record(spark, tmp):
    land(tmp, "p1.json", {"stellenangebote": [{"refnr": "ref1", "titel": "Java Experte", "arbeitgeber": "Acme Corp"}]})
    raw = FD.read_search_pages(spark, tmp).collect()
    assert len(raw) == 1 and raw[0].refnr == "ref1" and raw[0].pos == 0


def test_empty_page_ends_feed(spark, tmp):
    land(tmp, "p1.json", {"page": 1, "stellenangebote": [{"refnr": "a"}]})
    land(tmp, "p2.json", {"page": 2, "stellenangebote": []})
    land(tmp, "p3.json", {"page": 3, "stellenangebote": [{"refnr": "c"}]})
    assert [r.refnr for r in FD.read_search_pages(spark, tmp).collect()] == ["a"]


def test_two_records_stored_once(spark, tmp):
    feed, table = os.path.join(tmp, "feed"), os.path.join(tmp, "table")
    land(feed, "p1.json", {"stellenangebote": [
        {"refnr": "ref1", "titel": "Java Developer", "arbeitgeber": "Deutsche Bank"},
        {"refnr": "ref2", "titel": "Backend Engineer", "arbeitgeber": "Allianz"}]})
    posts = N.normalize_ingest(FD.read_search_pages(spark, feed), None, NOW)
    assert TB.append_new(posts, table) == 2
    assert TB.append_new(posts, table) == 0            # idempotent
    stored = {r.reference_id: (r.title, r.company) for r in spark.read.parquet(table).collect()}
    assert stored == {"ref1": ("Java Developer", "Deutsche Bank"), "ref2": ("Backend Engineer", "Allianz")}


def raw_df(spark, rows):
    schema = "refnr string, hashId string, titel string, arbeitgeber string, ort string, page long, pos long"
    return spark.createDataFrame(rows, schema)


def detail_df(spark, rows):
    fields = [f.name for f in S.RAW_DETAIL.fields]
    out = []
    for r in rows:
        out.append((r.get("detail_key"),) + tuple(r.get(k) for k in fields))
    schema = "detail_key string, " + ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in S.RAW_DETAIL.fields)
    return spark.createDataFrame(out, schema)


def test_defaults_both_modes(spark):
    raw = raw_df(spark, [(None, "h1", None, None, None, 1, 0)])
    ing = N.normalize_ingest(raw, None, NOW).first()
    scan = N.normalize_scan(raw, None, NOW).first()
    assert (ing.title, ing.company, ing.reference_id) == ("Unknown Title", "Unknown Company", "")
    assert (scan.title, scan.company, scan.reference_id) == ("Unknown Title", "Unknown Employer", "h1")


def test_keyless_records_collapse_on_ingest(spark):
    raw = raw_df(spark, [(None, None, "first", None, None, 1, 0), (None, None, "second", None, None, 1, 1)])
    out = D.dedup_first(N.normalize_ingest(raw, None, NOW)).collect()
    assert len(out) == 1 and out[0].title == "first"


def test_contact_email_modes(spark):
    raw = raw_df(spark, [("r1", "h1", "T", "C", "", 1, 0), ("r2", "h2", "T", "C", "", 1, 1)])
    det = detail_df(spark, [dict(detail_key="h1", kontakt={"email": "a@x", "angebotskontakt": None}),
                            dict(detail_key="h2", kontakt={"email": None, "angebotskontakt": {"email": "b@x"}})])
    ing = {r.hash_id: r.employer_email for r in N.normalize_ingest(raw, det, NOW).collect()}
    assert ing == {"h1": "a@x", "h2": "b@x"}
    raw2 = raw_df(spark, [("h1", None, "T", "C", "", 1, 0), ("h2", None, "T", "C", "", 1, 1)])
    scan = {r.reference_id: r.employer_email for r in N.normalize_scan(raw2, det, NOW).collect()}
    assert scan == {"h1": "a@x", "h2": None}


def test_blank_detail_text(spark):
    raw = raw_df(spark, [("h1", "h1", "T", "C", "", 1, 0)])
    det = detail_df(spark, [dict(detail_key="h1", stellenbeschreibung=" ")])
    assert N.normalize_ingest(raw, det, NOW).first().description == " "
    assert N.normalize_scan(raw, det, NOW).first().description == "Position: T\nEmployer: C"


def test_scan_without_detail_location(spark):
    raw = raw_df(spark, [("r", None, "T", "C", "Berlin", 1, 0)])
    assert N.normalize_scan(raw, None, NOW).first().description == "T in Berlin"


def test_portal_url_read(spark):
    df = posting_rows(spark, [dict(id="1", portal_url=" ", hash_id="h")])
    assert df.select(N.portal_url_read(df).alias("u")).first().u == S.PORTAL_BASE + "h"


def test_predicted_recipient(spark):
    df = spark.createDataFrame([("Müller & Söhne GmbH", None, None), ("Tech Corp", " ", "")],
                               "company string, override string, stored string")
    out = [r.x for r in df.select(X.resolve_recipient("override", "stored", "company").alias("x")).collect()]
    assert out == ["hr@mllershnegmbh.de", "hr@techcorp.de"]


def test_preview_bounds(spark):
    df = spark.createDataFrame([("a" * 100,), ("a" * 101,)], "t string")
    out = [r.p for r in df.select(X.preview("t").alias("p")).collect()]
    assert out == ["a" * 100, "a" * 100 + "..."]


def test_validate_three_reasons(spark):
    df = posting_rows(spark, [
        dict(id="1", reference_id="r1", title="x" * 2001, company="c", description="d", status="FETCHED"),
        dict(id="2", reference_id="r2", title="t", company=None, description="d", status="FETCHED"),
        dict(id="3", reference_id="r3", title="t", company="c", description="d", status="X"),
        dict(id="4", reference_id="r4", title="t", company="c", description="d", status="FETCHED")])
    ok, bad = R.validate_postings(df)
    assert ok.count() == 1
    assert {r.id: r.reason for r in bad.collect()} == {
        "1": "title too long", "2": "company is null", "3": "status not allowed"}


def test_scan_new_limit(spark):
    inc = spark.createDataFrame([(k, 1, i) for i, k in enumerate("abbcd")],
                                "reference_id string, page long, pos long")
    stored = spark.createDataFrame([("a",)], "reference_id string")
    assert [r.reference_id for r in D.scan_new(inc, stored, 2).collect()] == ["b", "c"]


def test_import_postings(spark):
    stored = posting_rows(spark, [dict(id="7", title="Dev", company="Acme")])
    inc = spark.createDataFrame([(1, "Dev", "Acme"), (2, "Ops", "Acme"), (3, "Ops", "Acme")],
                                "seq long, title string, company string")
    out = {r.seq: (r.outcome, r.id) for r in D.import_postings(inc, stored).collect()}
    assert out[1] == ("exists", "7")
    assert out[2][0] == "imported" and out[3] == ("exists", out[2][1])


def test_upgrade_schema_defaults(spark):
    old = spark.createDataFrame([("p1", "Ann")], "id string, full_name string")
    r = R.upgrade_schema(old, "profile").first()
    assert (r.min_match_score, r.max_job_age_days, r.ai_model) == (75, 30, "llama3")
    oldp = spark.createDataFrame([("1", "r", None)], "id string, reference_id string, processing_status string")
    assert R.upgrade_schema(oldp, "posting").first().processing_status == "IDLE"


def test_artifact_inventory_and_progress(spark, tmp):
    open(os.path.join(tmp, "cl_1.pdf"), "wb").write(b"%PDF")
    open(os.path.join(tmp, "cl_2.pdf"), "wb").close()
    files = {os.path.basename(r.path): r.length for r in TB.list_artifacts(spark, tmp).collect()}
    assert files == {"cl_1.pdf": 4, "cl_2.pdf": 0}   # an empty file is listed
    ev = spark.createDataFrame([("info", None), ("error", 'a"b\r\nc')], "type string, message string") \
              .withColumn("ts", F.expr("TIMESTAMP_NTZ '2024-01-01 13:14:15'"))
    out = [json.loads(r.json) for r in TB.progress_events(ev).collect()]
    assert out[0] == {"type": "info", "message": "", "time": "13:14:15"}
    assert out[1]["message"] == 'a"b\nc'


def test_inventory_of_nested_folders(spark, tmp):
    from postingflow.operators import dispatch as DP
    from conftest import posting_rows
    base = os.path.join(tmp, "store")
    for name, text in (("a/b/cv 1.pdf", "x"), ("a/b/c/cv_2.pdf", ""), ("z/letter.pdf", ""), ("top.pdf", "yy"),
                       ("a/.hidden.pdf", "x"), ("_tmp/part.pdf", "x"), ("a/notes.txt", "x")):
        os.makedirs(os.path.dirname(os.path.join(base, name)), exist_ok=True)
        with open(os.path.join(base, name), "w") as f:
            f.write(text)
    found = TB.list_artifacts(spark, base, "*.pdf")
    assert {r.path[len(base) + 1:]: r.length for r in found.collect()} == {
        "a/b/cv 1.pdf": 1, "a/b/c/cv_2.pdf": 0, "z/letter.pdf": 0, "top.pdf": 2}
    assert TB.list_artifacts(spark, "file://" + base, "*.pdf").count() == 4
    assert TB.list_artifacts(spark, os.path.join(tmp, "none")).count() == 0
    posts = posting_rows(spark, [dict(id="1"), dict(id="2")])
    apps = spark.createDataFrame([("a1", "1", f"{base}/a/b/c/cv_2.pdf", f"file://{base}/z/letter.pdf"),
                                  ("a2", "2", f"{base}/top.pdf", f"{base}/gone.pdf")],
                                 "id string, job_id string, cv_path string, letter_path string") \
        .withColumn("created_at", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"))
    got = {r.id: (r.cv_state, r.letter_state) for r in DP.audit_artifacts(posts, apps, found).collect()}
    assert got == {"1": ("empty_file", "empty_file"), "2": ("ok", "missing")}


def test_read_details_keyed_by_file_name(spark, tmp):
    d = os.path.join(tmp, "details")
    os.makedirs(d)
    with open(os.path.join(d, "h1.json"), "w") as f:
        json.dump({"refnr": "R1", "stellenbeschreibung": "Build", "kontakt": {"email": "a@x"}}, f)
    with open(os.path.join(d, "other.json"), "w") as f:
        json.dump({"hashId": "h2", "externeUrl": "https://x"}, f)
    det = {r.detail_key: r for r in FD.read_details(spark, d).collect()}
    assert det["h1"].stellenbeschreibung == "Build" and det["h1"].kontakt.email == "a@x"
    assert det["h2"].externeUrl == "https://x"
    raw = raw_df(spark, [("r1", "h1", "T", "C", "", 1, 0), ("r2", "zz", "T", "C", "", 1, 1)])
    out = {r.hash_id: r.description for r in N.normalize_ingest(raw, FD.read_details(spark, d), NOW).collect()}
    assert out["h1"] == "Build" and out["zz"].startswith("Role: T\nCompany: C")    # missing detail: row survives


def test_quarantine_partitions_input(spark):
    from postingflow.plans import bindings as B
    df = B.doc_postings(spark, "/root/testdata/sf0.01")
    ok, bad = R.validate_postings(df)
    assert ok.count() + bad.count() == df.count() and bad.count() > 0


def test_feed_query_grows_with_the_documents(spark, tmp):
    from postingflow.plans import catalog
    catalog.load_all()
    for n in (1000, 10000):
        sf = os.path.join(tmp, str(n))
        spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source")).write.parquet(f"{sf}/documents.parquet")
        got = catalog.QUERIES["search_feed"](spark, sf).collect()
        ended = -(-n // 2000)  # every tenth run: pages 7 and 8 of 25 records
        assert len({r.refnr for r in got}) == len(got) == n - 50 * ended
        assert not [r for r in got if r.run % 10 == 0 and r.page >= 7]


def test_feed_end_is_per_run(spark, tmp):
    a, b = os.path.join(tmp, "run_a"), os.path.join(tmp, "run_b")
    land(a, "p1.json", {"page": 1, "stellenangebote": [{"refnr": "a1"}]})
    land(a, "p2.json", {"page": 2, "stellenangebote": []})
    land(a, "p3.json", {"page": 3, "stellenangebote": [{"refnr": "a3"}]})
    land(b, "p3.json", {"page": 3, "stellenangebote": [{"refnr": "b3"}]})
    got = sorted(r.refnr for r in FD.read_search_pages(spark, [a, b]).collect())
    assert got == ["a1", "b3"]


def test_upgrade_other_tables(spark):
    old_app = spark.createDataFrame([("a1", "j1")], "id string, job_id string")
    r = R.upgrade_schema(old_app, "application").first()
    assert r.cv_path is None and r.letter_path is None and r.created_at is None
    old_persona = spark.createDataFrame([("x1", "p1", "Dev")], "id string, profile_id string, persona_name string")
    r = R.upgrade_schema(old_persona, "persona").first()
    assert r.persona_name == "Dev" and r.is_default is None


def test_pages_without_numbers_keep_their_records(spark, tmp):
    for folder, names in (("n", ("p1.json", "p2.json", "p10.json")), ("x", ("a.json", "b.json", "c.json"))):
        d = os.path.join(tmp, folder)
        for name, recs in zip(names, ([{"refnr": "a"}], [{"refnr": "b"}, {"refnr": "a", "titel": "later"}], [])):
            land(d, name, {"stellenangebote": recs})
        raw = FD.read_search_pages(spark, d)
        assert [r.refnr for r in raw.orderBy("page", "_file", "pos").collect()] == ["a", "b", "a"]
        posts = N.normalize_ingest(raw, None, NOW)
        table = os.path.join(tmp, "t" + folder)
        assert TB.append_new(posts, table) == 2
        assert {r.reference_id: r.title for r in spark.read.parquet(table).collect()}["a"] == "Unknown Title"


def test_only_a_missing_path_counts_as_empty_table(spark, tmp):
    import pytest
    assert TB.try_read(spark, os.path.join(tmp, "none")) is None
    os.makedirs(os.path.join(tmp, "bad"))
    with open(os.path.join(tmp, "bad", "x.parquet"), "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):
        TB.try_read(spark, os.path.join(tmp, "bad"))


def test_import_defaults(spark):
    from postingflow.operators import dedup as D
    inc = spark.createDataFrame([(1, None, "C", "d"), (2, "Unknown Title", "C", None), (3, "T", None, None)],
                                "seq long, title string, company string, description string")
    stored = spark.createDataFrame([], "id string, title string, company string, created_at timestamp_ntz")
    out = {r.seq: (r.title, r.company, r.outcome) for r in D.import_postings(inc, stored).collect()}
    assert out == {1: ("Unknown Title", "C", "imported"), 2: ("Unknown Title", "C", "exists"),
                   3: ("T", "Unknown Employer", "imported")}
    rows = {r.title: (r.company, r.description, r.status) for r in D.imported_postings(inc, stored, NOW).collect()}
    assert rows == {"Unknown Title": ("C", "d", "FETCHED"), "T": ("Unknown Employer", "", "FETCHED")}


def test_java_datetime(spark):
    rows = [("2024-01-02 03:04:00",), ("2024-01-02 03:04:05",), ("2024-01-02 03:04:05.120",), ("2024-01-02 03:04:00.000007",)]
    df = spark.createDataFrame(rows, "t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert [r[0] for r in df.select(X.java_datetime("t")).collect()] == [
        "2024-01-02T03:04", "2024-01-02T03:04:05", "2024-01-02T03:04:05.120", "2024-01-02T03:04:00.000007"]


def test_upgrade_keeps_stored_nulls(spark):
    old = spark.createDataFrame([("p", None)], "id string, min_match_score int")
    r = R.upgrade_schema(old, "profile").first()
    assert r.min_match_score is None and r.max_job_age_days == S.DEFAULT_MAX_JOB_AGE_DAYS
