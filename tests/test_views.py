import datetime as dt

from pyspark.sql import functions as F

from conftest import posting_rows
from postingflow.operators import views as V

NOW = "2024-05-10 12:00:00"


def seed(spark):
    # REF-1001..1006: 2 FETCHED, 2 SCORED (88, 95), 1 APPROVED (92), 1 APPLIED (85)
    rows = [dict(id="1", reference_id="REF-1001", status="FETCHED", title="a", company="c", description="d"),
            dict(id="2", reference_id="REF-1002", status="FETCHED", title="a", company="c", description="d"),
            dict(id="3", reference_id="REF-1003", status="SCORED", match_score=88, title="a", company="c", description="d"),
            dict(id="4", reference_id="REF-1004", status="SCORED", match_score=95, title="a", company="c", description="d"),
            dict(id="5", reference_id="REF-1005", status="APPROVED", match_score=92, title="a", company="c", description="d"),
            dict(id="6", reference_id="REF-1006", status="APPLIED", match_score=85, title="a", company="c", description="d")]
    return posting_rows(spark, rows)


def test_pipeline_stats_seed(spark):
    r = V.pipeline_stats(seed(spark)).first()
    assert (r.inbox, r.ai_review, r.ready_to_dispatch, r.dispatched) == (2, 2, 1, 1)
    assert r.avg_score == 90 and r.total_in_db == 6 and r.pending_scoring == 2


def test_two_averages(spark):
    now = dt.datetime(2024, 5, 10, 12)
    rows = [dict(id=str(i), status="SCORED", match_score=s, scored_at=now - dt.timedelta(days=1))
            for i, s in enumerate([0, 90, 91, None])]
    df = posting_rows(spark, rows)
    assert V.weekly_stats(df, NOW).first().avg_score == 60      # 60.33 truncated, 0 included
    assert V.pipeline_stats(df).first().avg_score == 91         # 90.5 rounded half up, 0 excluded


def test_stats_empty_and_week_edge(spark):
    empty = posting_rows(spark, [])
    r = V.pipeline_stats(empty).first()
    assert r.avg_score == 0 and r.total_in_db == 0
    w = V.weekly_stats(empty, NOW).first()
    assert w.avg_score == 0 and w.scored_this_week == 0
    edge = posting_rows(spark, [dict(id="1", status="APPLIED", scored_at=dt.datetime(2024, 5, 3, 12))])
    assert V.weekly_stats(edge, NOW).first().scored_this_week == 0   # exactly one week before: excluded


def test_board_keeps_empty_columns(spark):
    df = posting_rows(spark, [dict(id="1", status="FETCHED", title="t", company="c", description="x" * 101),
                              dict(id="2", status="SCORED", title="t", company="c", description="short")])
    b = {r.col_pos: r for r in V.board(df).collect()}
    assert sorted(b) == [1, 2, 3, 4]
    assert b[3].card_id is None and b[4].card_id is None
    assert b[1].card_preview == "x" * 100 + "..." and b[2].card_preview == "short"
    assert b[1].card_score == 0 and b[1].card_location == "Location Unspecified"
    assert b[3].col_title == "Applied"        # APPROVED shows as "Applied"


def test_filters_null_status_is_fetched(spark):
    df = posting_rows(spark, [dict(id="1", status=None), dict(id="2", status="SCORED"),
                              dict(id="3", status="REJECTED"), dict(id="4", status="HIRED")])
    assert {r.id for r in V.inbox(df).collect()} == {"1"}
    assert {r.id for r in V.pipeline(df).collect()} == {"2", "3", "4"}
    assert {r.id for r in V.active(df).collect()} == {"1", "2"}


def test_capped_inbox(spark):
    rows = [dict(id=f"{i:03d}", status="FETCHED", created_at=dt.datetime(2024, 1, 1) + dt.timedelta(hours=i))
            for i in range(60)]
    out = V.capped_inbox(posting_rows(spark, rows), 50).collect()
    assert len(out) == 50 and out[0].total_fetched == 60
    assert max(r.id for r in out) == "049"


def test_has_application_and_first(spark):
    p = posting_rows(spark, [dict(id="a", reference_id="REF-67890", status="SCORED"), dict(id="b")])
    apps = spark.createDataFrame([("x2", "a", dt.datetime(2024, 1, 2)), ("x1", "a", dt.datetime(2024, 1, 1))],
                                 "id string, job_id string, created_at timestamp_ntz")
    flags = {r.id: r.has_application for r in V.has_application(p, apps).collect()}
    assert flags == {"a": True, "b": False}
    assert V.first_application(apps).first().id == "x1"


def test_key_lookup(spark):
    p = posting_rows(spark, [dict(id="1", reference_id="REF-12345", title="Senior Java Developer",
                                  company="Tech Corp", status="FETCHED")])
    keys = spark.createDataFrame([("REF-12345",)], "reference_id string")
    assert V.by_reference(p, keys).first().company == "Tech Corp"


def test_score_bands(spark):
    df = posting_rows(spark, [dict(id=str(i), status="SCORED", match_score=s)
                              for i, s in enumerate([95, 80, 60, 40, 10, 900, None])])
    bands = {r.band: r.n for r in V.score_bands(df).collect()}
    assert bands == {"90-100": 1, "75-89": 1, "55-74": 1, "35-54": 1, "0-34": 1, "out_of_range": 1, "none": 1}


def test_nested_board_pages(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    rows = [dict(id=f"{i:03d}", status=None if i % 2 else "FETCHED", title="T", company="C", description="d" * (95 + i % 10),
                 created_at=None if i % 13 == 0 else t0 + dt.timedelta(hours=i % 7)) for i in range(60)]
    rows += [dict(id=f"s{i}", status="SCORED", created_at=t0, match_score=i or None) for i in range(3)] + [dict(id="x", status="REJECTED")]
    df = posting_rows(spark, rows).repartition(4)
    b = {r.col_id: r for r in V.board_nested(df, cards=8).collect()}
    assert [b[c].total for c in ("discovery", "scored", "applied", "interviewing")] == [60, 3, 0, 0]
    assert b["applied"].jobs == [] and b["applied"].next_id is None and b["scored"].next_id is None
    assert [(j.id, j.score) for j in b["scored"].jobs] == [("s0", 0), ("s1", 1), ("s2", 2)]
    want = [r["id"] for r in sorted(rows[:60], key=lambda r: (r["created_at"] is None, -(r["created_at"] or t0).timestamp(), r["id"]))]
    got, at, last = [j.id for j in b["discovery"].jobs], b["discovery"].next_at, b["discovery"].next_id
    while True:
        more = V.board_more(df, "discovery", at, last, cards=8).collect()
        if not more:
            break
        got += [r.id for r in more]
        at, last = more[-1].created_at, more[-1].id
    assert got == want
