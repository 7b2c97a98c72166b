import datetime as dt

from pyspark.sql import functions as F

from conftest import posting_rows
from postingflow.operators import dispatch as DP
from postingflow.operators import mailbox as MB
from postingflow.operators import memory as M
from postingflow.operators import vector_index as VI

T0 = dt.datetime(2024, 1, 1)


def postings(spark):
    return posting_rows(spark, [
        dict(id="1", company="acme", status="APPLIED", created_at=T0, title="Dev"),
        dict(id="2", company="acme berlin", status="APPLIED", created_at=T0 + dt.timedelta(days=1), title="Dev"),
        dict(id="3", company="zed", status="REJECTED", created_at=T0, title="Dev"),
        dict(id="4", company="", status="FETCHED", created_at=T0, title="Dev"),
        dict(id="5", company="ab", status="FETCHED", created_at=T0, title="Dev")])


def messages(spark, rows):
    return spark.createDataFrame([(i, "inbox", f, s, b, T0 + dt.timedelta(minutes=i)) for i, (f, s, b) in enumerate(rows)],
                                 "message_id long, mailbox string, from_addr string, subject string, body string, "
                                 "received_at timestamp_ntz")


def test_mail_cases(spark):
    m = messages(spark, [("hr@acme", "Status", "Unfortunately no"),
                         ("hr@acme", "Update", "other candidates"),
                         ("x@y", "Update from Acme Berlin", "next steps"),
                         ("hr@acme", "Hello", "unfortunately"),
                         ("hr@acme", "unfortunate", "bye"),
                         ("hr@zed", "Status", "unfortunately"),
                         ("hr@none", "Status", "interview"),
                         ("x@lab.example", "hi", "")])
    out = {r.message_id: (r.posting_id, r.outcome) for r in MB.classify_messages(m, postings(spark)).collect()}
    assert out[0] == ("1", "rejected")
    assert out[1] == (None, "pending")                # acme's only posting is out by now
    assert out[2] == ("2", "interviewing")            # the next active posting that is named
    assert out[3] == (None, "pending") and out[4] == (None, "pending")
    assert out[5] == (None, "pending") and out[6] == (None, "pending")
    assert out[7] == ("5", "unchanged")               # short company via the exact short path


def one_by_one(messages, postings):
    """The mailbox as a plain loop over messages and postings."""
    state = {p.id: p.status or "FETCHED" for p in postings}
    order = sorted(postings, key=lambda p: (p.created_at, p.id))
    out = {}
    for m in sorted(messages, key=lambda m: (m.received_at, m.message_id)):
        sender, subject, body = m.from_addr.lower(), (m.subject or "").lower(), (m.body or "").lower()
        for p in order:
            name = (p.company or "").lower()
            if state[p.id] in ("REJECTED", "HIRED") or not name or not (name in sender or name in subject):
                continue
            outcome = "unchanged"
            if any(w in subject for w in ("update", "status", "unfortunate", "rejection")):
                if "unfortunately" in body or "unfortunately" in subject or "other candidates" in body:
                    outcome, state[p.id] = "rejected", "REJECTED"
                elif "interview" in body or "interview" in subject or "next steps" in body:
                    outcome, state[p.id] = "interviewing", "INTERVIEWING"
            out[m.message_id] = (p.id, outcome)
            break
        else:
            out[m.message_id] = (None, "pending")
    return out, state


def test_mail_is_taken_in_order(spark):
    import random
    rng = random.Random(5)
    names = ["acme", "acme berlin", "ab", "a very long company name gmbh", "zed", "Berlin", "x", "ingenieurbuero nord"]
    posts = posting_rows(spark, [dict(id=f"{i:03d}", company=rng.choice(names + [None, ""]), title="Dev",
                                      status=rng.choice(["APPLIED", None, "REJECTED", "HIRED", "FETCHED"]),
                                      created_at=T0 + dt.timedelta(hours=rng.randrange(60))) for i in range(30)])
    rows = [(f"hr@{rng.choice(names)}", rng.choice(["Status", "Update from " + rng.choice(names), "Hello", "unfortunately", None]),
             rng.choice(["Unfortunately no", "next steps", "hi", "other candidates"])) for _ in range(36)]
    m = messages(spark, rows)
    m = m.withColumn("received_at", F.col("received_at") + F.make_dt_interval(hours=F.pmod(F.hash("message_id"), F.lit(40))))
    want, state = one_by_one(m.collect(), posts.collect())
    outcomes = MB.classify_messages(m, posts).cache()
    assert {r.message_id: (r.posting_id, r.outcome) for r in outcomes.collect()} == want
    got = {r.id: r.status or "FETCHED" for r in MB.apply_mail_outcomes(posts, outcomes).collect()}
    assert got == state


def test_nested_names_settle_in_few_rounds(spark):
    """500 rejections that name both companies, among others that name one."""
    import random
    rng = random.Random(9)
    names = ["acme", "acme berlin", "berlin", "zed"]
    posts = posting_rows(spark, [dict(id=f"{i:04d}", company=rng.choice(names), title="Dev", status="APPLIED",
                                      created_at=T0 + dt.timedelta(minutes=rng.randrange(4000))) for i in range(900)])
    texts = ["acme berlin"] * 500 + ["acme"] * 90 + ["berlin"] * 60 + ["zed"] * 40 + ["zed and acme"] * 40
    rng.shuffle(texts)
    rows = [(f"hr@{t}", "Status", "Unfortunately no" if rng.random() < 0.9 else "next steps") for t in texts]
    m = messages(spark, rows).repartition(5)
    want, _ = one_by_one(m.collect(), posts.collect())
    got = {r.message_id: (r.posting_id, r.outcome) for r in MB.classify_messages(m, posts).collect()}
    assert got == want
    # The same in slices: at most a round for each, and the same takes.
    active = MB.active_postings(posts)
    ranked = MB.running_before(active, "company_l", F.date_trunc("hour", "created_at"), ["created_at", "posting_id"],
                               name="before").withColumn("rank", F.col("before") + 1).drop("before")
    named = MB.named_companies(m, active).join(m.select("message_id", "received_at", (MB.classify(
        F.col("subject"), F.col("body")) == "rejected").alias("rejects")), "message_id")
    whole, rounds = MB.settle(named, ranked)
    assert rounds == 1
    sliced, rounds = MB.settle(named, ranked, size=110)
    assert 1 < rounds <= 7
    assert sorted(map(tuple, sliced.collect())) == sorted(map(tuple, whole.collect()))


def test_names_in_texts(spark, monkeypatch):
    from postingflow.operators import names as NM
    texts = spark.createDataFrame([(1, "acme berlin gmbh"), (2, None), (3, ""), (4, "x"), (1, "berlin"), (5, "aaa")], "k long, t string")
    names = spark.createDataFrame([("acme",), ("acme berlin",), ("berlin",), (None,), ("",), ("x",), ("x",), ("aa",)], "name string")
    want = [(1, "acme"), (1, "acme berlin"), (1, "berlin"), (1, "berlin"), (4, "x"), (5, "aa")]
    assert sorted(map(tuple, NM.names_in(texts, names, "k", "t", "name").collect())) == want
    monkeypatch.setattr(NM, "SHARD_BYTES", 7)
    assert len(NM.shards(names, "name")) > 1
    assert sorted(map(tuple, NM.names_in(texts, names, "k", "t", "name").collect())) == want
    assert NM.names_in(texts, names.limit(0), "k", "t", "name").collect() == []


def test_running_sums_in_slices(spark):
    from postingflow.operators.ordering import running_before
    rows = [(k, i // 4, i, i % 3) for k in ("a", "b", None) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, s int, i int, v int")
    got = {(r.k, r.i): r.before for r in running_before(df, "k", F.col("s"), ["i"], F.col("v")).collect()}
    assert got == {(k, i): sum(j % 3 for j in range(i)) for k, _, i, _ in rows}


def test_many_queries_no_cap(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    vecs = rng.standard_normal((50, 4))
    mem = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "mem_id long, embedding array<float>")
    q = spark.range(10_500).select(F.col("id").alias("query_id"), F.array(
        *(F.lit(float(k)) - F.col("id") % (k + 7) for k in range(4))).cast("array<double>").alias("vec"))
    got = M.top_k(q, mem.repartition(3), 1, block=1000)
    assert got.count() == 10_500
    want = {}
    m = vecs.astype(np.float32).astype(float)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    for r in q.where("query_id % 997 = 3").collect():
        want[r.query_id] = int(np.argmax(m @ np.array(r.vec)))
    assert {r.query_id: r.mem_id for r in got.where("query_id % 997 = 3").collect()} == want


def test_files_meet_applications_by_plain_path(spark, tmp):
    import os
    from postingflow.sources import tables as TB
    os.makedirs(os.path.join(tmp, "f"))
    for name in ("cv.pdf", "letter.pdf"):
        open(os.path.join(tmp, "f", name), "w").write("x")
    files = TB.list_artifacts(spark, os.path.join(tmp, "f"))
    posts = posting_rows(spark, [dict(id="1", company="acme", created_at=T0), dict(id="2", company="b", created_at=T0),
                                 dict(id="3", company="c", created_at=T0)])
    apps = spark.createDataFrame([("a1", "1", f"{tmp}/f/cv.pdf", f"file://{tmp}/f/letter.pdf", T0),
                                  ("a2", "2", " ", f"{tmp}/f/none.pdf", T0)],
                                 "id string, job_id string, cv_path string, letter_path string, created_at timestamp_ntz")
    got = {r.id: (r.cv_state, r.letter_state) for r in DP.audit_artifacts(posts, apps, files).collect()}
    assert got == {"1": ("ok", "ok"), "2": ("blank_path", "missing"), "3": ("no_application", "no_application")}
    over = spark.createDataFrame([("1", "me@x.de"), ("2", " ")], "id string, override_email string")
    prof = spark.createDataFrame([("Yours, N",)], "email_signature string")
    m = {r.id: r for r in DP.dispatch_manifest(posts, apps, over, files, prof).collect()}
    assert (m["1"].recipient, m["2"].recipient, m["3"].action) == ("me@x.de", "hr@b.de", "skipped_no_application")
    assert (m["1"].cv_attachment, m["2"].letter_attachment) == ("Lebenslauf.pdf", None)
    assert m["1"].body.endswith("Yours, N")


def test_pending_matched_later(spark):
    m = messages(spark, [("hr@none", "Status", "interview")])
    p2 = postings(spark).unionByName(posting_rows(spark, [dict(id="9", company="none", status="FETCHED", created_at=T0)]))
    assert MB.classify_messages(m, p2).first().outcome == "interviewing"


def test_rejection_memory(spark):
    m = messages(spark, [("hr@acme", "Status", "Unfortunately no")])
    p = postings(spark)
    out = MB.classify_messages(m, p)
    r = MB.rejection_memory(out, p, m.select("message_id", F.lit("too junior").alias("reason"))).first()
    assert r.content == "Rejection for Dev at acme: too junior"
    assert r.metadata == {"type": "rejection_learning", "company": "acme", "jobTitle": "Dev"}


def test_topk_ties_and_overflow(spark):
    mem = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [0.6, 0.8])],
                                "mem_id long, embedding array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vec array<double>")
    r = [(x.rank, x.mem_id) for x in M.top_k(q, mem, 2).orderBy("rank").collect()]
    assert r == [(1, 1), (2, 3)]                         # duplicate pair, tie broken by id
    assert M.top_k(q, mem, 10).count() == 4              # k above the table size -> all rows


def test_memorize_and_filter(spark, tmp):
    df = spark.createDataFrame([("a", None, [0.1]), ("b", {"type": "x"}, [0.2])],
                               "content string, metadata map<string,string>, embedding array<float>")
    out = M.memorize(df, tmp + "/mem")
    assert {r.content: r.metadata for r in out.collect()} == {"a": {}, "b": {"type": "x"}}
    assert M.memory_where(spark.read.parquet(tmp + "/mem"), "type", "x").count() == 1


def vector_rows(spark, vecs):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "mem_id long, embedding array<float>")


def test_index_holds_every_row_and_bounds_hold(spark, tmp):
    import numpy as np
    rng = np.random.default_rng(1)
    vecs = rng.standard_normal((700, 15)).astype("float32")   # a dimension that fills no whole part
    mem = vector_rows(spark, vecs).repartition(3)
    model = VI.train(mem)
    index = VI.build(mem, model, path=tmp + "/index")
    seen = []
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    for r in index.collect():
        x = model.lists[r["list"]] + model.decoded(np.frombuffer(r.codes, np.uint8).reshape(len(r.ids), -1))
        off = np.linalg.norm(unit[r.ids] - x, axis=1)
        assert np.allclose(off, np.frombuffer(r.rests, np.float32), atol=1e-4)
        assert np.linalg.norm(unit[r.ids] - model.lists[r["list"]], axis=1).max() <= r.radius + 1e-6
        seen += r.ids
    assert sorted(seen) == list(range(700))


def test_approximate_search_reaches_its_recall(spark):
    import numpy as np
    rng = np.random.default_rng(2)
    vecs = rng.standard_normal((2000, 16)).astype("float32")
    vecs[:8] = vecs[0] + 0.01 * rng.standard_normal((8, 16))  # one query with close neighbours, the others without
    vecs[100:700] = vecs[100]                                 # a third of all rows are copies
    mem = vector_rows(spark, vecs).repartition(4)
    q = spark.createDataFrame([(str(i), vecs[i].astype("float64").tolist()) for i in (0, *range(10, 30), 100)]
                              + [("far", rng.standard_normal(16).tolist()), ("zero", [0.0] * 16), ("none", None)],
                              "query_id string, vec array<double>")
    found = VI.top_k_approx(q, mem, 5).cache()
    assert all(r["count"] == 5 for r in found.groupBy("query_id").count().collect())
    vals = {r.query_id: r.recall for r in M.recall_at_k(found, M.top_k(q, mem, 5)).collect()}
    assert len(vals) == 24 and min(vals.values()) >= 0.9
    shares = {r.query_id: r.share_scored for r in found.collect()}
    assert max(v for n, v in shares.items() if n not in ("100", "zero")) < 0.2


def test_clustered_memory_is_probed_in_part(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 32)) * 3
    vecs = np.repeat(centres, 60, axis=0) + 0.2 * rng.standard_normal((2400, 32))
    mem = vector_rows(spark, vecs)
    q = spark.createDataFrame([(str(i), vecs[i].tolist()) for i in range(0, 2400, 100)], "query_id string, vec array<double>")
    found = VI.top_k_approx(q, mem, 5).cache()
    assert min(r.recall for r in M.recall_at_k(found, M.top_k(q, mem, 5)).collect()) >= 0.9
    assert max(r.share_probed for r in found.collect()) < 0.5


def test_batches_and_coding_are_bounded_in_bytes(spark):
    import tracemalloc
    import numpy as np
    from postingflow.session import ship_package
    ship_package(spark)

    def sizes(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})
    wide = spark.range(0, 24, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))
    assert max(r.n for r in wide.mapInArrow(sizes, "n long").collect()) < 12 << 20
    rng = np.random.default_rng(3)
    x = rng.standard_normal((10_000, 32))
    model = VI.Model(rng.standard_normal((341, 32)), rng.standard_normal((16, 256, 2)))
    tracemalloc.start()
    own, codes = model.nearest(x), model.codes(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20
    assert (own[-300:] == np.argmin(((x[-300:, None, :] - model.lists[None]) ** 2).sum(2), axis=1)).all()
    assert codes.shape == (10_000, 16)


def test_index_of_an_empty_memory(spark):
    q = spark.createDataFrame([("a", [1.0, 0.0])], "query_id string, vec array<double>")
    assert VI.top_k_approx(q, vector_rows(spark, []), 3).collect() == []
    assert M.top_k(q, vector_rows(spark, []), 3).collect() == []
    assert M.top_k(q.limit(0), vector_rows(spark, [[1.0, 2.0]]), 3).collect() == []


def test_top_k_by_blocks_and_stripes(spark, monkeypatch):
    """Many small blocks, stripes and salts, string ids, copies: as a plain sort."""
    import numpy as np
    rng = np.random.default_rng(8)
    vecs = rng.standard_normal((300, 6))
    vecs[40:140] = vecs[40]
    mem = spark.createDataFrame([(f"m{i:03d}", [float(x) for x in v]) for i, v in enumerate(vecs)] + [("none", None)],
                                "mem_id string, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(f"m{i:03d}", [float(x) for x in vecs[i]]) for i in range(0, 300, 7)], "query_id string, vec array<double>")
    monkeypatch.setattr(M, "BLOCK_BYTES", 6 * 8 * 16)
    monkeypatch.setattr(M, "STRIPE_BYTES", 600)
    monkeypatch.setattr(M, "HELD", 40)
    got = {(r.query_id, r["rank"]): r.mem_id for r in M.top_k(q, mem, 4, exclude_self=True, block=5).collect()}
    u = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    want = {}
    for i in range(0, 300, 7):
        sims = np.round(u @ u[i], 9)
        best = [j for j in sorted(range(300), key=lambda j: (-sims[j], j)) if j != i][:4]
        want.update({(f"m{i:03d}", k + 1): f"m{j:03d}" for k, j in enumerate(best)})
    assert got == want


def test_artifact_audit_states(spark):
    p = posting_rows(spark, [dict(id=str(i)) for i in range(5)])
    apps = spark.createDataFrame([("a1", "1", " ", "l1", T0), ("a2", "2", "cv2", "l2", T0), ("a3", "3", "cv3", "l3", T0),
                                  ("a4", "4", "cv4", "l4", T0)],
                                 "id string, job_id string, cv_path string, letter_path string, created_at timestamp_ntz")
    files = spark.createDataFrame([("cv3", 0), ("cv4", 10), ("l4", 5)], "path string, length long")
    s = {r.id: (r.cv_state, r.letter_state) for r in DP.audit_artifacts(p, apps, files).collect()}
    assert s["0"] == ("no_application", "no_application")
    assert s["1"][0] == "blank_path" and s["2"][0] == "missing" and s["3"][0] == "empty_file"
    assert s["4"] == ("ok", "ok")


def test_dispatch_manifest(spark):
    p = posting_rows(spark, [dict(id="1", company="Tech Corp", status="APPROVED"), dict(id="2", company="X")])
    apps = spark.createDataFrame([("a1", "1", "cv1", "l1", T0)],
                                 "id string, job_id string, cv_path string, letter_path string, created_at timestamp_ntz")
    files = spark.createDataFrame([("l1", 0)], "path string, length long")
    m = {r.id: r for r in DP.dispatch_manifest(p, apps, None, files, None).collect()}
    assert m["1"].recipient == "hr@techcorp.de" and m["1"].letter_attachment == "Anschreiben.pdf" and m["1"].cv_attachment is None
    assert m["1"].body.endswith("Mit freundlichen Grüßen,\nJohn Doe")
    assert m["2"].action == "skipped_no_application"


def test_profile_and_persona(spark):
    from postingflow import schemas as S
    empty = spark.createDataFrame([], S.PROFILE)
    r = DP.effective_profile(empty).first()
    assert (r.search_keyword, r.min_match_score, r.max_job_age_days) == ("Java", 75, 30)
    prof = spark.createDataFrame([("p1", "A", None, None, None, None, None, None),
                                  ("p2", "B", None, None, None, None, None, None)], S.PROFILE)
    pers = spark.createDataFrame([("x1", "p1", "n", "", " ", "cv1", False), ("x2", "p1", "n", "", "Be kind", None, True)],
                                 S.PERSONA)
    a = {r.profile_id: r for r in DP.active_persona(prof, pers).collect()}
    assert a["p1"].persona_id == "x2" and a["p1"].prompt_source == "override" and a["p1"].cv_source == "fallback"
    assert a["p2"].persona_id is None and a["p2"].prompt_source == "default"


def test_delete_rules_and_clear(spark):
    from postingflow import schemas as S
    from postingflow.operators import actions as A
    p = posting_rows(spark, [dict(id="1"), dict(id="2")])
    apps = spark.createDataFrame([("a", "1")], "id string, job_id string")
    ids = spark.createDataFrame([("1",), ("2",)], "id string")
    left, blocked = A.delete_postings(p, apps, ids)
    assert [r.id for r in left.collect()] == ["1"] and [r.id for r in blocked.collect()] == ["1"]
    prof = spark.createDataFrame([("p1", "A", None, None, None, None, None, None)], S.PROFILE)
    pers = spark.createDataFrame([("x1", "p1", "n", "", None, None, True), ("x2", "p9", "n", "", None, None, True)],
                                 S.PERSONA)
    prof2, pers2 = A.delete_profiles(prof, pers, spark.createDataFrame([("p1",)], "id string"))
    assert prof2.count() == 0 and [r.id for r in pers2.collect()] == ["x2"]
    e1, e2 = A.clear(p, apps)
    assert e1.count() == 0 and e2.count() == 0 and e1.schema == p.schema


def test_embedder_and_queue_step(spark):
    import pandas as pd
    from postingflow.operators import replies as RP
    from postingflow.streaming import streams as ST
    df = spark.createDataFrame([("a",), ("bb",)], "content string")
    emb = {r.content: r.embedding for r in RP.embed_with(df, lambda s: [[float(len(x))] for x in s]).collect()}
    assert emb == {"a": [1.0], "bb": [2.0]}
    rows = [dict(id=str(i), status="FETCHED", processing_status="QUEUED", title=f"T{i}", company="c",
                 description="d", created_at=T0 + dt.timedelta(hours=i)) for i in range(3)]
    scorer = lambda s: pd.Series(['{"score": 42, "analysis": ["• ok"]}'] * len(s))
    posts, apps, events = ST.queue_step(posting_rows(spark, rows), scorer, "2024-01-01 00:00:00", n=2)
    got = {r.id: (r.status, r.processing_status, r.match_score) for r in posts.collect()}
    assert got["0"] == ("SCORED", "IDLE", 42) and got["1"] == ("SCORED", "IDLE", 42)
    assert got["2"] == ("FETCHED", "QUEUED", None)
    assert apps.count() == 2 and sorted(r.type for r in events.collect()) == ["start", "start", "success", "success"]
    assert {r.message for r in events.collect() if r.type == "success"} == {"✓ T0 @ c — 42% match", "✓ T1 @ c — 42% match"}


def test_names_are_found_through_a_small_filter(spark, monkeypatch):
    import random
    from postingflow.operators import names as NM
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abé𝔘ß ") for _ in range(n))
    names = sorted({word(rnd.randint(1, 9)) for _ in range(150)} | {"x" * 40})
    texts = [(k, word(rnd.randint(0, 30)) if k % 9 else None) for k in range(200)] + [(500, "y" + "x" * 41), (500, "x" * 40)]
    want = sorted((k, n) for k, t in texts for n in names if t and n in t)
    read = spark.createDataFrame(texts, "k long, t string")
    frame = spark.createDataFrame([(n,) for n in names + names[:9] + ["", None]], "name string")
    assert sorted(map(tuple, NM.names_in(read, frame, "k", "t", "name").collect())) == want
    # a full filter sends more runs to the join, the pairs stay; so do they in small blocks
    monkeypatch.setattr(NM, "TEXT_BYTES", 64)
    monkeypatch.setattr(NM, "MOST_BITS", 64)
    monkeypatch.setattr(NM, "LEAST_BITS", 64)
    assert sorted(map(tuple, NM.names_in(read, frame, "k", "t", "name").collect())) == want


def test_what_is_sent_of_many_names_is_small(spark):
    from postingflow.operators import names as NM
    many = spark.range(200_000).select(F.format_string("customer#%09d", "id").alias("name"))
    words, lengths = NM.name_filter(many)
    assert words.nbytes <= 1 << 20 and lengths == [18]


def test_competing_messages_in_order(spark):
    # two rejections from "acme berlin" in one batch: the first takes posting
    # #1 out, so the second goes to the next active posting it names
    m = messages(spark, [("x@acme berlin", "Status", "unfortunately"),
                         ("x@acme berlin", "Status", "unfortunately")])
    out = MB.classify_messages(m, postings(spark))
    assert [r.posting_id for r in out.orderBy("message_id").collect()] == ["1", "2"]
    st = {r.id: r.status for r in MB.apply_mail_outcomes(postings(spark), out).collect()}
    assert st["1"] == "REJECTED" and st["2"] == "REJECTED"


def test_with_cv_and_profile_prompts(spark):
    from postingflow import schemas as S
    from postingflow.operators import replies as RP
    prof = spark.createDataFrame([("p1", "A", None, None, None, None, None, None),
                                  ("p2", "B", None, None, None, None, None, None)], S.PROFILE)
    pers = spark.createDataFrame([("x1", "p1", "n", "", None, "cv1.pdf", True)], S.PERSONA)
    act = DP.active_persona(prof, pers)
    texts = spark.createDataFrame([("cv1.pdf", "Kotlin Spark")], "cv_path string, cv_text string")
    posts = spark.createDataFrame([("j1", "p1", "T", "C", "D"), ("j2", "p2", "T", "C", "D")],
                                  "id string, profile_id string, title string, company string, description string")
    with_cv = DP.with_cv(posts, act, texts, "fallback cv")
    got = {r.id: r.cv_text for r in with_cv.collect()}
    assert got == {"j1": "Kotlin Spark", "j2": "fallback cv"}
    prompts = {r.id: r.user for r in RP.build_prompts(posts, with_cv.select("profile_id", "cv_text").distinct(),
                                                        template="{cv}").collect()}
    assert prompts == {"j1": "Kotlin Spark", "j2": "fallback cv"}
