import json
import os

from pyspark.sql import functions as F

from postingflow.operators import actions as A
from postingflow.operators import mailbox as MB
from postingflow.plans import bindings as B
from postingflow.streaming import streams as ST

SF = "/root/testdata/sf0.001"
NOW = "2024-05-10 12:00:00"


def land_pages(d, pages):
    os.makedirs(d, exist_ok=True)
    for i, recs in enumerate(pages):
        with open(os.path.join(d, f"page_{i:03d}.json"), "w") as f:
            json.dump({"page": i + 1, "stellenangebote": recs}, f)


FEED = [[{"refnr": f"r{i}", "titel": f"T{i}", "arbeitgeber": "A"} for i in range(5)],
        [{"refnr": "r3", "titel": "dup"}, {"refnr": "r7", "titel": "T7"}],
        [{"refnr": None, "titel": "nokey"}, {"refnr": "r8", "titel": "T8"}]]


def run(q):
    q.awaitTermination()
    assert q.exception() is None


def table_rows(spark, path):
    return sorted((r.reference_id, r.title) for r in spark.read.parquet(path).collect())


def test_ingest_stream_split_and_restart(spark, tmp):
    one = os.path.join(tmp, "one")
    land_pages(one, [sum(FEED, [])])
    run(ST.ingest_stream(spark, one, os.path.join(tmp, "t1"), NOW, checkpoint=os.path.join(tmp, "c1")))
    split = os.path.join(tmp, "split")
    land_pages(split, FEED[:1])
    ck = os.path.join(tmp, "c2")
    run(ST.ingest_stream(spark, split, os.path.join(tmp, "t2"), NOW, checkpoint=ck, max_files=1))
    land_pages(split, FEED)                      # the first file again (same name) plus two new ones
    run(ST.ingest_stream(spark, split, os.path.join(tmp, "t2"), NOW, checkpoint=ck, max_files=1))
    a, b = table_rows(spark, os.path.join(tmp, "t1")), table_rows(spark, os.path.join(tmp, "t2"))
    assert a == b and len(a) == 8 and ("r3", "T3") in a


def test_state_stream_equals_batch(spark, tmp):
    acts = B.actions(spark, SF)
    posts, apps = B.postings(spark, SF), B.applications(spark, SF)
    src = os.path.join(tmp, "actions")
    # split the log into three files by sequence (later batches carry later actions)
    bounds = acts.agg(F.percentile_approx("seq", [0.33, 0.66]).alias("b")).first().b
    parts = [acts.filter(F.col("seq") <= bounds[0]),
             acts.filter((F.col("seq") > bounds[0]) & (F.col("seq") <= bounds[1])),
             acts.filter(F.col("seq") > bounds[1])]
    out = os.path.join(tmp, "state")
    ck = os.path.join(tmp, "ck")
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(os.path.join(src, f"part{i}"))
        # restart after every file
        run(ST.run_state_stream(spark, src + "/*", posts, apps, out, checkpoint=ck))
    ch = spark.read.parquet(out + "/changes")
    latest = (ch.groupBy("job_id").agg(F.max_by(F.struct("new_status", "queued", "new_notes", "deleted", "n_actions"),
                                                 "epoch").alias("c")).select("job_id", "c.*"))
    batch = A.action_changes(posts, apps, acts)
    cols = ["job_id", "new_status", "queued", "new_notes", "deleted", "n_actions"]
    assert sorted(tuple(r) for r in latest.select(*cols).collect()) == \
        sorted(tuple(r) for r in batch.select(*cols).collect())
    stats = spark.read.parquet(out + "/stats")
    last = stats.filter(F.col("epoch") == stats.agg(F.max("epoch")).first()[0]).drop("epoch")
    from postingflow.streaming.streams import stats_from_changes
    want = stats_from_changes(posts, batch)
    assert sorted(tuple(r) for r in last.collect()) == sorted(tuple(r) for r in want.collect())


def test_mail_stream_carries_pending(spark, tmp):
    msgs = B.messages(spark, SF)
    posts = B.postings(spark, SF)
    src = os.path.join(tmp, "mail")
    half = sorted(r.received_at for r in msgs.select("received_at").collect())[msgs.count() // 2]
    msgs.filter(F.col("received_at") <= F.lit(half)).write.parquet(os.path.join(src, "a"))
    out, ck = os.path.join(tmp, "out"), os.path.join(tmp, "ck")
    run(ST.mail_stream(spark, src + "/*", posts, out, checkpoint=ck))
    msgs.filter(F.col("received_at") > F.lit(half)).write.parquet(os.path.join(src, "b"))
    run(ST.mail_stream(spark, src + "/*", posts, out, checkpoint=ck))
    got = spark.read.parquet(out + "/outcomes").select("message_id", "posting_id", "outcome")
    want = MB.classify_messages(msgs, posts).filter(F.col("outcome") != "pending").select(
        "message_id", "posting_id", "outcome")
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())
    assert ST.pending_of(spark, out).count() == MB.classify_messages(msgs, posts).filter(F.col("outcome") == "pending").count()


def test_mail_stream_does_not_replay(spark, tmp):
    import datetime as dt
    from conftest import posting_rows
    t0 = dt.datetime(2024, 1, 1)
    posts = posting_rows(spark, [dict(id=str(i), company="acme", status="APPLIED", created_at=t0 + dt.timedelta(days=i))
                                 for i in range(2)])
    cols = "message_id long, mailbox string, from_addr string, subject string, body string, received_at timestamp_ntz"
    src = os.path.join(tmp, "mail")
    for k in range(4):        # two rejections, then mail that finds nothing, one file at a time
        spark.createDataFrame([(k, "inbox", "hr@acme", "Status", "unfortunately", t0 + dt.timedelta(minutes=k))], cols) \
            .coalesce(1).write.parquet(os.path.join(src, f"m{k}"))
        run(ST.mail_stream(spark, src + "/*", posts, os.path.join(tmp, "out"), checkpoint=os.path.join(tmp, "ck")))
    got = sorted((r.message_id, r.posting_id) for r in spark.read.parquet(os.path.join(tmp, "out", "outcomes")).collect())
    assert got == [(0, "0"), (1, "1")]
    assert sorted(r.message_id for r in ST.pending_of(spark, os.path.join(tmp, "out")).collect()) == [2, 3]


def test_state_stream_does_not_depend_on_order_or_batches(spark, tmp):
    import datetime as dt
    from conftest import posting_rows
    t0 = dt.datetime(2024, 1, 1)
    posts = posting_rows(spark, [dict(id="1"), dict(id="2")]).withColumn("id", F.col("id").cast("long"))
    apps = spark.createDataFrame([(2,)], "job_id long")
    rows = [(4, 1, "notes", "late"), (1, 1, "approve", None), (3, 1, "reject", None), (2, 1, "notes", "n"),
            (9, 2, "ignore", None), (6, 2, "reject", None), (8, 2, "dispatched", None), (7, 3, "approve", None)]
    acts = spark.createDataFrame([(s, t0, j, a, x) for s, j, a, x in rows],
                                 "seq long, ts timestamp_ntz, job_id long, action string, arg string")
    batch = sorted(map(tuple, A.action_changes(posts, apps, acts).collect()), key=str)
    assert batch[0] == (1, None, False, None, True, 4)
    for name, per_file, size in (("one", 8, 10_000), ("each", 1, 1)):
        src, out = os.path.join(tmp, name), os.path.join(tmp, "out-" + name)
        for k in range(0, 8, per_file):
            spark.createDataFrame(acts.collect()[k:k + per_file], acts.schema).coalesce(1).write.parquet(os.path.join(src, f"p{k}"))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
        run(ST.run_state_stream(spark, src + "/*", posts, apps, out, checkpoint=os.path.join(tmp, "ck-" + name), max_files=1))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        ch = spark.read.parquet(out + "/changes")
        last = ch.groupBy("job_id").agg(F.max_by(F.struct("new_status", "queued", "new_notes", "deleted", "n_actions"),
                                                 "epoch").alias("c")).select("job_id", "c.*")
        assert sorted(map(tuple, last.collect()), key=str) == batch


def test_ingest_stream_quarantine_and_any_batching(spark, tmp):
    """Any order of landing and any split into batches: the rows of a scan of the
    landed run, up to its first empty page."""
    from postingflow.operators import normalize as N
    from postingflow.sources import feeds as FD
    pages = [[{"refnr": "a", "titel": "T", "arbeitgeber": "C"}],
             [{"refnr": "b", "titel": "x" * 3000, "arbeitgeber": "C"}, {"refnr": "c", "titel": "T"}],
             [{"refnr": "d", "titel": "T"}], [], [{"refnr": "e", "titel": "late"}], None]
    tables = []
    for name, files, order in (("all", None, range(6)), ("one", 1, range(6)), ("back", 1, (4, 5, 2, 3, 1, 0)), ("two", 2, (3, 0, 4, 1, 5, 2))):
        src, out = os.path.join(tmp, name, "run"), os.path.join(tmp, name + "-t")
        os.makedirs(src)
        for when, k in enumerate(order):
            path = os.path.join(src, f"p{k + 1}.json")
            json.dump({"stellenangebote": pages[k]}, open(path, "w"))
            os.utime(path, (1000 + when, 1000 + when))
        run(ST.ingest_stream(spark, os.path.join(tmp, name) + "/*", out, NOW, checkpoint=out + "-ck", max_files=files))
        tables.append(table_rows(spark, out))
        bad = spark.read.parquet(out + "_quarantine").collect()
        assert [(r.reference_id, r.reason) for r in bad] == [("b", "title too long")]
    landed = N.normalize_ingest(FD.read_search_pages(spark, os.path.join(tmp, "all", "run")), None, NOW)
    assert {r.reference_id for r in landed.collect()} == {"a", "b", "c", "d"}
    assert tables == [[("a", "T"), ("c", "T"), ("d", "T")]] * 4


def test_a_lost_page_holds_its_run_for_a_time(spark, tmp):
    src, out = os.path.join(tmp, "in", "run"), os.path.join(tmp, "t")
    os.makedirs(src)
    def land(k, recs):
        json.dump({"page": k, "stellenangebote": recs}, open(os.path.join(src, f"p{k}.json"), "w"))
    def go():
        run(ST.ingest_stream(spark, os.path.join(tmp, "in") + "/*", out, NOW, checkpoint=out + "-ck", lost_after=1))
    land(1, [{"refnr": "a", "titel": "T"}])
    land(3, [{"refnr": "c", "titel": "T"}])
    go()
    assert table_rows(spark, out) == [("a", "T")]   # page 2 may still come
    import time
    time.sleep(1.5)
    land(4, [{"refnr": "d", "titel": "T"}])
    go()
    land(5, [])
    go()
    assert table_rows(spark, out) == [("a", "T"), ("c", "T"), ("d", "T")]


def test_weekly_stream_matches_closed_windows(spark, tmp):
    posts, acts = B.postings(spark, SF, with_customer=False), B.actions(spark, SF)
    outcomes = A.action_outcomes(posts, B.applications(spark, SF), acts)
    span = acts.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    # scores inside the log's time, so that neither stream holds back the watermark
    scored = posts.filter(F.col("scored_at").isNotNull()).select("id", F.lit(span.a).alias("a"), F.lit(span.b).alias("b")).select(
        "id", (F.col("a") + (F.col("b") - F.col("a")) * (F.pmod(F.hash("id"), F.lit(1000)) / 1000)).alias("scored_at"))
    acts.write.parquet(os.path.join(tmp, "acts"))
    outcomes.select("seq", (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("done_at"), "outcome").write.parquet(os.path.join(tmp, "done"))
    scored.write.parquet(os.path.join(tmp, "scores"))
    out = os.path.join(tmp, "weekly")
    run(ST.weekly_stream(spark, os.path.join(tmp, "acts"), out, os.path.join(tmp, "done"), os.path.join(tmp, "scores"),
                         lateness="1 day", checkpoint=os.path.join(tmp, "ck")))
    cols = ["window_start", "event", "n"]
    got = sorted(map(tuple, spark.read.parquet(out).select(*cols).collect()))
    events = ST.change_events(outcomes).unionByName(ST.scored_events(scored))
    limit = min(span.b, scored.agg(F.max("scored_at")).first()[0])
    closed = ST.weekly_counts(events).filter(F.col("window_end") <= F.lit(limit) - F.expr("INTERVAL 25 HOURS"))
    want = sorted(map(tuple, closed.select(*cols).collect()))
    assert len(want) > 0 and {r[1] for r in want} >= {"scored", "approved"}
    assert [r for r in got if r[0] in {w[0] for w in want}] == want
    assert sum(r.n for r in ST.weekly_counts(events).collect()) < events.count() + 1 < acts.count() + scored.count()


def test_fifty_epochs_read_their_own_rows(spark, tmp):
    """Live state and board counts after every one of fifty batches: as the batch
    fold of the log so far; a batch reads as many rows at the end as at the start."""
    import datetime as dt
    import random
    from conftest import posting_rows
    rng, t0 = random.Random(3), dt.datetime(2024, 1, 1)
    posts = posting_rows(spark, [dict(id=str(i), status=rng.choice(["FETCHED", None, "SCORED"])) for i in range(12)]) \
        .withColumn("id", F.col("id").cast("long")).cache()
    apps = spark.createDataFrame([(2,), (5,)], "job_id long")
    kinds = ["approve", "ignore", "reject", "notes", "analyze", "dispatched"]
    log = [(k, t0, rng.randrange(14), rng.choice(kinds), "x") for k in range(100)]
    schema = "seq long, ts timestamp_ntz, job_id long, action string, arg string"
    src, out, ck = (os.path.join(tmp, n) for n in ("src", "out", "ck"))
    for e in range(50):
        spark.createDataFrame(log[2 * e:2 * e + 2], schema).coalesce(1).write.parquet(os.path.join(src, f"p{e:03d}"))
        os.utime(next(os.path.join(src, f"p{e:03d}", f) for f in os.listdir(os.path.join(src, f"p{e:03d}")) if f.endswith("parquet")), (e + 1, e + 1))
    run(ST.run_state_stream(spark, src + "/*", posts, apps, out, checkpoint=ck, max_files=1))
    stats = {}
    for r in spark.read.parquet(out + "/stats").collect():
        stats.setdefault(r.epoch, {})[r.status] = r.n
    state = {p.id: p.status or "FETCHED" for p in posts.collect()}
    gone, seen = set(), {-1: dict(_counts(state, set()))}
    for e in range(50):
        for _, _, job, action, _ in log[2 * e:2 * e + 2]:
            if job in state and action == "reject" and job not in (2, 5):
                gone.add(job)
            elif job in state and action in dict(A.STATUS_OF_ACTION) and (action != "dispatched" or job in (2, 5)):
                state[job] = dict(A.STATUS_OF_ACTION)[action]
        seen[e] = _counts(state, gone)
    assert stats == seen
    batch = A.action_changes(posts, apps, spark.createDataFrame(log, schema))
    live = {r.job_id: (None if r.deleted else r.status, r.deleted, r.n_actions) for r in ST.live_state(spark, ck).collect()}
    assert live == {r.job_id: (r.new_status, r.deleted, r.n_actions) for r in batch.collect()}
    changed = spark.read.parquet(out + "/changes").groupBy("epoch").count().collect()
    assert max(r["count"] for r in changed) <= 2


def _counts(state, gone):
    from collections import Counter
    return dict(Counter(s for j, s in state.items() if j not in gone))


def test_queue_stream_ticks(spark, tmp):
    import datetime as dt
    import pandas as pd
    from conftest import posting_rows
    rows = [dict(id=str(i), status="FETCHED", processing_status="QUEUED", title=f"T{i}", company="c",
                 description="d", created_at=dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(3)]
    ppath = os.path.join(tmp, "postings")
    posting_rows(spark, rows).write.parquet(ppath)
    ticks = os.path.join(tmp, "ticks")
    os.makedirs(ticks)
    for t in ("t1", "t2"):
        open(os.path.join(ticks, f"{t}.txt"), "w").write("tick\n")
    calls = os.path.join(tmp, "calls")
    os.makedirs(calls)

    def scorer(prompts):
        import uuid
        for p in prompts:
            open(os.path.join(calls, uuid.uuid4().hex), "w").write(p)
        return pd.Series(['{"score": 7}'] * len(prompts))
    out = os.path.join(tmp, "out")
    # two ticks, one claim each: the second batch must see the first one's change
    run(ST.queue_stream(spark, ticks, ppath, out, scorer, NOW, n=1, checkpoint=os.path.join(tmp, "ck"),
                        trigger="availableNow", fallback_cv="my cv"))
    cur = ST.current_postings(spark, ppath, out + "/postings", 1 << 30)
    got = {r.id: (r.status, r.processing_status) for r in cur.collect()}
    assert got == {"0": ("SCORED", "IDLE"), "1": ("SCORED", "IDLE"), "2": ("FETCHED", "QUEUED")}
    assert spark.read.parquet(out + "/progress").count() == 4     # start + success per claim
    assert len(os.listdir(calls)) == 2                            # each claim is scored once
    assert "my cv" in open(os.path.join(calls, os.listdir(calls)[0])).read()


def _queued(spark, rows):
    import datetime as dt
    from conftest import posting_rows
    t0 = dt.datetime(2024, 1, 1)
    return posting_rows(spark, [dict(id=i, status="FETCHED", processing_status="QUEUED", title=f"T{i}", company="c", description="d",
                                     created_at=None if h is None else t0 + dt.timedelta(hours=h)) for i, h in rows])


def test_queue_stream_takes_late_postings_in_order(spark, tmp):
    import pandas as pd
    ppath, ticks, out, ck = (os.path.join(tmp, d) for d in ("postings", "ticks", "out", "ck"))
    os.makedirs(ticks)
    scorer = lambda prompts: pd.Series(['{"score": 7}'] * len(prompts))

    def go(first, count):
        for t in range(first, first + count):
            open(os.path.join(ticks, f"t{t:03d}.txt"), "w").write("tick\n")
        run(ST.queue_stream(spark, ticks, ppath, out, scorer, NOW, n=1, checkpoint=ck, trigger="availableNow", fallback_cv="cv"))

    _queued(spark, [(f"b{k}", 10 + k) for k in range(5)]).write.parquet(ppath)
    go(0, 3)
    # postings that land late, some of them older than what was claimed
    _queued(spark, [("none", None), ("a0", 0), ("a1", 1), ("z", 99)]).write.mode("append").parquet(ppath)
    go(3, 7)
    got = [r.id for r in spark.read.parquet(out + "/postings").orderBy("epoch").collect()]
    assert got == ["b0", "b1", "b2", "none", "a0", "a1", "b3", "b4", "z"]
    # a batch starts from what is open: two runs in between, nothing in the end
    assert ST.R.last_epoch(spark, out + "/queue_ledger") == 9
    assert ST.R.read_ledger(spark, out + "/queue_ledger", 9) == []
    middle = ST.open_queue(spark, out, 5, spark.read.parquet(ppath).schema)
    assert {f.split("/run=")[1].split("/")[0] for f in middle.inputFiles()} == {"0", "6"}
    assert sorted(r.id for r in middle.collect()) == ["b3", "b4", "z"]


def test_queue_runs_merge_and_keep_the_order(spark, tmp):
    import random
    rng = random.Random(7)
    waiting, want, got, number = [], [], [], 0
    for epoch in range(50):
        new = []
        for _ in range(rng.choice([0, 1, 4])):
            new.append((f"p{number:03d}", rng.choice([None, *range(12)])))
            number += 1
        waiting = sorted(waiting + new, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
        n = rng.choice([0, 1, 3])
        want.append(sorted(i for i, _ in waiting[:n]))
        waiting = waiting[n:]
        rows = _queued(spark, new)
        for _ in range(2 if epoch % 10 == 5 else 1):     # a batch that is run again claims the same
            claimed = ST._claim_open(spark, rows, tmp, epoch, n, 3)
            ids = sorted(r.id for r in claimed.collect())
        got.append(ids)
        assert len(ST.R.read_ledger(spark, tmp + "/queue_ledger", epoch)) <= 3
        if epoch % 5 == 0:
            assert sorted(r.id for r in ST.open_queue(spark, tmp, epoch, rows.schema).collect()) == sorted(i for i, _ in waiting)
    assert got == want and sum(map(len, got)) > 10


def test_mail_stream_reads_open_state_only(spark, tmp):
    import datetime as dt
    from conftest import posting_rows
    t0 = dt.datetime(2024, 1, 1)
    posts = posting_rows(spark, [dict(id=f"{c}{i}", company=c, status="APPLIED", created_at=t0 + dt.timedelta(days=i))
                                 for c in ("acme", "acme berlin", "globex") for i in range(4)])
    cols = "message_id long, mailbox string, from_addr string, subject string, body string, received_at timestamp_ntz"
    who = ["acme", "globex", "acme berlin", "nobody", "globex"]
    rows = [(k, "inbox", f"hr@{who[k % 5]}", "Status", "unfortunately" if k % 3 else "hello", t0 + dt.timedelta(minutes=k))
            for k in range(20)]
    src, out = os.path.join(tmp, "mail"), os.path.join(tmp, "out")
    for k in range(0, 20, 2):
        spark.createDataFrame(rows[k:k + 2], cols).coalesce(1).write.parquet(os.path.join(src, f"m{k:02d}"))
        for f in os.listdir(os.path.join(src, f"m{k:02d}")):
            os.utime(os.path.join(src, f"m{k:02d}", f), (1_700_000_000 + k, 1_700_000_000 + k))
    run(ST.mail_stream(spark, src + "/*", posts, out, checkpoint=os.path.join(tmp, "ck"), max_files=1, max_runs=3))
    got = sorted((r.message_id, r.posting_id, r.outcome) for r in spark.read.parquet(out + "/outcomes").collect())
    want = MB.classify_messages(spark.createDataFrame(rows, cols), posts).filter(F.col("outcome") != "pending")
    assert got == sorted((r.message_id, r.posting_id, r.outcome) for r in want.collect())
    left = {r.message_id for r in ST.pending_of(spark, out).collect()}
    assert left == {r[0] for r in rows} - {r[0] for r in got} and 3 in left
    ledger = ST.R.read_ledger(spark, out + "/closed_ledger", 9)
    assert len(ledger) <= 4 and min(r["run"] for r in ledger) > 0


def test_progress_stream_json_lines(spark, tmp):
    rows = [("1", "start", "go", "2024-01-01 10:00:01"), ("2", "error", None, "2024-01-01 10:00:02")]
    src = os.path.join(tmp, "ev")
    spark.createDataFrame(rows, "id string, type string, message string, ts string") \
         .withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(src)
    out = os.path.join(tmp, "out")
    run(ST.progress_stream(spark, src, out, checkpoint=os.path.join(tmp, "ck")))
    got = sorted(json.loads(r.value)["time"] + json.loads(r.value)["message"] for r in spark.read.text(out).collect())
    assert got == ["10:00:01go", "10:00:02"]
