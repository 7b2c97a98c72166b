import datetime as dt

from pyspark.sql import functions as F

from conftest import posting_rows
from postingflow.operators import actions as A
from postingflow.operators import queueing as Q

T0 = dt.datetime(2024, 1, 1)


def acts(spark, rows):
    return spark.createDataFrame([(i + 1, T0 + dt.timedelta(minutes=i), j, a, arg)
                                  for i, (j, a, arg) in enumerate(rows)],
                                 "seq long, ts timestamp_ntz, job_id string, action string, arg string")


def apps(spark, ids):
    return spark.createDataFrame([(f"a{i}", i) for i in ids], "id string, job_id string")


def base(spark, n=3):
    return posting_rows(spark, [dict(id=str(i), status="FETCHED", processing_status="IDLE", company="Tech Corp")
                                for i in range(n)])


def fold(spark, rows, with_apps=()):
    p, o = A.apply_actions(base(spark), apps(spark, with_apps), acts(spark, rows))
    return {r.id: r for r in p.collect()}, [r.outcome for r in o.orderBy("seq").collect()]


def test_last_status_wins(spark):
    p, _ = fold(spark, [("0", "approve", None), ("0", "ignore", None), ("1", "ignore", None), ("1", "approve", None)])
    assert p["0"].status == "REJECTED" and p["1"].status == "APPROVED"


def test_reject_deletes_and_cuts(spark):
    p, o = fold(spark, [("0", "reject", None), ("0", "approve", None)])
    assert "0" not in p and o == ["deleted", "not_found"]


def test_reject_blocked_by_application(spark):
    p, o = fold(spark, [("0", "reject", None)], with_apps=["0"])
    assert "0" in p and o == ["blocked"]


def test_analyze_dispatch_notes_unknown(spark):
    p, o = fold(spark, [("0", "analyze", None), ("1", "dispatched", None), ("2", "dispatched", None),
                        ("0", "notes", None), ("9", "approve", None)], with_apps=["2"])
    assert p["0"].processing_status == "QUEUED" and p["0"].notes == ""
    assert p["1"].status == "FETCHED" and o[1] == "no_application"
    assert p["2"].status == "APPLIED" and p["2"].employer_email == "hr@techcorp.de"
    assert o[-1] == "not_found"


def test_score_all_and_cancel(spark):
    df = posting_rows(spark, [dict(id="1", status="FETCHED", processing_status="IDLE"),
                              dict(id="2", status="FETCHED", processing_status="QUEUED"),
                              dict(id="3", status="SCORED", processing_status="IDLE")])
    assert A.score_all(df)[1].first().queued == 1
    df2 = posting_rows(spark, [dict(id="1", processing_status="QUEUED"), dict(id="2", processing_status="PROCESSING"),
                               dict(id="3", processing_status="IDLE")])
    assert A.cancel_queue(df2)[1].first().cancelled == 2


def test_apply_log_with_barrier(spark):
    a = acts(spark, [("0", "approve", None), (None, "score_all", None), ("1", "analyze", None)])
    p, o = A.apply_log(base(spark), apps(spark, []), a)
    got = {r.id: (r.status, r.processing_status) for r in p.collect()}
    assert got["0"] == ("APPROVED", "IDLE")          # no longer FETCHED when score_all ran
    assert got["1"] == ("FETCHED", "QUEUED") and got["2"] == ("FETCHED", "QUEUED")
    assert "count=2" in [r.outcome for r in o.collect()]


def by_hand(postings, apps, log):
    """The log as a plain loop: postings by id, outcome of every row."""
    state = {p.id: [p.status or "FETCHED", p.processing_status or "IDLE"] for p in postings}
    out = {}
    for a in sorted(log, key=lambda r: r.seq):
        if a.action == "score_all":
            hit = [s for s in state.values() if s == ["FETCHED", "IDLE"]]
            for s in hit:
                s[1] = "QUEUED"
            out[a.seq] = f"count={len(hit)}"
        elif a.action == "cancel_queue":
            hit = [s for s in state.values() if s[1] in ("QUEUED", "PROCESSING")]
            for s in hit:
                s[1] = "IDLE"
            out[a.seq] = f"count={len(hit)}"
        elif a.job_id not in state:
            out[a.seq] = "not_found"
        elif a.action == "reject":
            out[a.seq] = "blocked" if a.job_id in apps else "deleted"
            if a.job_id not in apps:
                del state[a.job_id]
        elif a.action == "dispatched" and a.job_id not in apps:
            out[a.seq] = "no_application"
        else:
            out[a.seq] = "ok"
            if a.action == "analyze":
                state[a.job_id][1] = "QUEUED"
            elif a.action in dict(A.STATUS_OF_ACTION):
                state[a.job_id][0] = dict(A.STATUS_OF_ACTION)[a.action]
    return {k: tuple(v) for k, v in state.items()}, out


def test_logs_with_commands_as_a_plain_loop(spark):
    import random
    for seed, share in ((1, 0.3), (2, 0.05), (3, 0.8), (4, 0.0)):
        rng = random.Random(seed)
        posts = posting_rows(spark, [dict(id=str(i), company="c", status=rng.choice(["FETCHED", "FETCHED", None, "SCORED", "APPLIED"]),
                                          processing_status=rng.choice(["IDLE", "IDLE", None, "QUEUED", "PROCESSING"])) for i in range(40)])
        rows = []
        for _ in range(150):
            if rng.random() < share:
                rows.append((None, rng.choice(["score_all", "cancel_queue"]), None))
            else:
                job = "7" if rng.random() < 0.3 else str(rng.randrange(44))  # one posting holds a third of the log
                rows.append((job, rng.choice(["analyze", "analyze", "approve", "ignore", "notes", "reject", "dispatched"]), "x"))
        log, held = acts(spark, rows), ["7", "3", "11"]
        p, o = A.apply_log(posts, apps(spark, held), log)
        state, out = by_hand(posts.collect(), held, log.collect())
        assert {r.seq: r.outcome for r in o.collect()} == out
        assert {r.id: (r.status or "FETCHED", r.processing_status or "IDLE") for r in p.collect()} == state


def test_ten_thousand_commands(spark):
    """A fixed number of jobs, whatever the number of commands."""
    rows = [(None, ("score_all", "cancel_queue")[i % 2], None) if i % 11 else (str(i % 3), "analyze", None) for i in range(11_000)]
    log = acts(spark, rows)
    p, o = A.apply_log(base(spark), apps(spark, []), log)
    state, out = by_hand(base(spark).collect(), [], log.collect())
    assert {r.seq: r.outcome for r in o.collect()} == out
    assert {r.id: (r.status, r.processing_status) for r in p.collect()} == state


def test_queue_drains_one_by_one(spark):
    rows = [dict(id=f"ref-{i}", status="FETCHED", processing_status="QUEUED", created_at=T0 + dt.timedelta(hours=i))
            for i in range(5)]
    cur = posting_rows(spark, rows)
    seen = []
    for _ in range(5):
        claimed, cur = Q.claim(cur, 1)
        c = claimed.collect()
        assert len(c) == 1
        seen.append(c[0].id)
        cur = Q.release(cur.withColumn("status", F.when(F.col("id") == c[0].id, "SCORED")
                                       .otherwise(F.col("status"))), claimed.select("id"))
        cur = spark.createDataFrame(cur.collect(), cur.schema)   # tiny fixture: keep the plan short
    assert seen == [f"ref-{i}" for i in range(5)]
    assert cur.filter(F.col("processing_status") == "QUEUED").count() == 0


def test_assign_disjoint(spark):
    rows = [dict(id=f"{i:02d}", status="FETCHED", processing_status="QUEUED", created_at=T0 + dt.timedelta(hours=i))
            for i in range(10)]
    out = Q.assign(posting_rows(spark, rows), 7, 3).collect()
    assert len({r.id for r in out}) == 7
    assert sorted(r.worker for r in out) == [0, 0, 0, 1, 1, 2, 2]


def test_breaker_windows(spark):
    calls = [(1, T0 + dt.timedelta(seconds=i), i, i < 8, 1.0) for i in range(10)]
    calls += [(2, T0 + dt.timedelta(seconds=i), 100 + i, True, 1.0) for i in range(9)]
    df = spark.createDataFrame(calls, "service long, ts timestamp_ntz, call_id long, failed boolean, duration_s double")
    w = Q.breaker_windows(df, block=16)
    last = {r.service: r.state for r in w.filter(F.col("call_id").isin(9, 108)).collect()}
    assert last == {1: "OPEN", 2: "CLOSED"}      # 8 of 10 failed; 9 calls only
    a = sorted(tuple(r) for r in w.select("call_id", "window_calls", "failures").collect())
    b = sorted(tuple(r) for r in Q.breaker_windows_simple(df).select("call_id", "window_calls", "failures").collect())
    assert a == b


def test_profile_and_persona_logs(spark):
    from postingflow import schemas as S
    prof = spark.createDataFrame([("p1", "Ann", "Java", None, None, "llama3", 75, 30)], S.PROFILE)
    patches = spark.createDataFrame([(1, "p1", "minMatchScore", "80"), (2, "p1", "searchKeyword", "Go"),
                                     (3, "p1", "minMatchScore", " 85 "), (4, "p1", "maxJobAgeDays", "-7")],
                                    "seq long, profile_id string, key string, value string")
    r = A.apply_profile_patches(prof, patches).first()
    # " 85 " does not parse (a rejected request): the last parsable value wins
    assert (r.min_match_score, r.search_keyword, r.max_job_age_days) == (80, "Go", -7)
    pers = spark.createDataFrame([], S.PERSONA)
    log = spark.createDataFrame([(1, "create", "x1", "p1", None, None, None), (2, "prompt", "x1", None, None, None, "P1"),
                                 (3, "prompt", "x1", None, None, None, "P2")],
                                "seq long, op string, persona_id string, profile_id string, name string, role string, prompt string")
    out = A.apply_persona_log(pers, log).first()
    assert (out.persona_name, out.role, out.prompt_override) == ("New Persona", "", "P2")


def test_keyset_paging_equals_offset(spark):
    rows = [dict(id=f"{i:02d}", created_at=T0 + dt.timedelta(hours=i // 2)) for i in range(23)]
    df = posting_rows(spark, rows)
    pages, after = [], None
    for _ in range(5):
        got = Q.page_after(df, after, 5).collect()
        if not got:
            break
        pages.append([r.id for r in got])
        after = (got[-1].created_at, got[-1].id)
    offset = [[r.id for r in Q.page(df, i, 5).collect()] for i in range(len(pages))]
    assert pages == offset and sum(len(p) for p in pages) == 23


def test_analyze_on_scored_is_never_claimed(spark):
    p = posting_rows(spark, [dict(id="1", status="SCORED", processing_status="IDLE", created_at=T0)])
    p2, _ = A.apply_actions(p, apps(spark, []), acts(spark, [("1", "analyze", None)]))
    assert p2.first().processing_status == "QUEUED"
    claimed, _ = Q.claim(p2, 1)
    assert claimed.count() == 0


def test_address_of_an_earlier_dispatch_stays(spark):
    a = acts(spark, [("0", "dispatched", "hr@first.de"), ("0", "dispatched", None)])
    p, _ = A.apply_actions(base(spark), apps(spark, ["0"]), a)
    assert {r.id: r.employer_email for r in p.collect()}["0"] == "hr@first.de"


def test_prompt_before_its_persona_is_not_found(spark):
    from postingflow import schemas as S
    cols = "seq long, op string, persona_id string, profile_id string, name string, role string, prompt string"
    log = spark.createDataFrame([(1, "prompt", "x", None, None, None, "early"), (2, "create", "x", "p", "N", "R", None),
                                 (3, "prompt", "old", None, None, None, "P")], cols)
    stored = spark.createDataFrame([("old", "p", "O", "", None, None, False)], S.PERSONA)
    got = {r.id: r.prompt_override for r in A.apply_persona_log(stored, log).collect()}
    assert got == {"x": None, "old": "P"}


def test_breaker_windows_null_service_and_blocks(spark):
    rows = [(s, T0 + dt.timedelta(minutes=37 * i), 1000 * (s or 0) + i, i % 3 == 0, float(i % 200))
            for s in (None, 1, 2) for i in range(120)]
    df = spark.createDataFrame(rows, "service long, ts timestamp_ntz, call_id long, failed boolean, duration_s double")
    cols = ["service", "call_id", "window_calls", "failures", "slow_calls", "state"]
    a = sorted(map(tuple, Q.breaker_windows(df, block=13).select(*cols).collect()), key=str)
    assert a == sorted(map(tuple, Q.breaker_windows_simple(df).select(*cols).collect()), key=str)


def test_many_global_commands(spark):
    rows = [(None, "score_all" if i % 2 else "cancel_queue", None) for i in range(4)]
    p, o = A.apply_log(base(spark), apps(spark, []), acts(spark, rows))
    assert o.count() == 4 and {r.processing_status for r in p.collect()} == {"QUEUED"}
