"""Ranked lexical search against plain Python."""

import random

import brute
import fixtures
import numpy as np
import pyarrow as pa
import pytest

from postingflow.llm import queries, ranked_search

SF = "/root/testdata/sf0.001"


def key(values):
    return sorted(values, key=repr)


def items(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], "item_id long, text string, doc_id string, term string")


@pytest.fixture(scope="module")
def rows(spark):
    sample = [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    return fixtures.awkward() + sample


@pytest.fixture(scope="module")
def asked(spark):
    sample = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    return sample + [(900, "w1 W2 w3, w1"), (901, None), (902, ""), (903, " .,; "), (904, "nowhere tobefound"),
                     (905, "in"), (906, "IN. in"), (907, " ".join(fixtures.words(2000, 5, 10 ** 6))), (908, "é ß 𝔘nicode")]


def run(spark, tmp_path, docs, asked):
    fixtures.frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    items(spark, asked).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = queries.QUERIES["op11_ranked_search"](spark, str(tmp_path)).collect()
    return [(r.item_id, r["rank"], r.doc_id, r.score) for r in got]


def test_search_query(spark, tmp_path, rows, asked):
    distinct = [r for k, r in enumerate(rows) if r not in rows[:k]]  # order of equal rows is open
    assert key(run(spark, tmp_path, distinct, asked)) == key(brute.ranked(distinct, asked))


def test_shards_buckets_and_chunks_change_nothing(spark, tmp_path, rows, asked, monkeypatch):
    monkeypatch.setattr(ranked_search, "PAIRS", 300)
    monkeypatch.setattr(ranked_search, "BUCKET_COORDINATES", 200)
    distinct = [r for k, r in enumerate(rows) if r not in rows[:k]]
    assert key(run(spark, tmp_path, distinct, asked)) == key(brute.ranked(distinct, asked))


def test_ties_take_the_smallest_ids(spark, tmp_path):
    """A third of all rows are copies; other ties straddle the fiftieth place."""
    rng = random.Random(5)
    docs = [(k, "alpha beta gamma " + " ".join(fixtures.words(20, 77))) for k in range(400)]
    docs += [(1000 + k, " ".join(fixtures.words(30, k, 60))) for k in range(700)]
    docs += [(3000 + k, "w1 w2") for k in range(100)] + [(None, "w1 w2")]
    rng.shuffle(docs)
    asked = [(1, "alpha"), (2, "w1 w2 w3"), (3, "beta w5"), (4, "w1")]
    assert key(run(spark, tmp_path, docs, asked)) == key(brute.ranked(docs, asked))


def test_rows_of_one_item_and_string_ids(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one two"), ("c", "two three")], "name string, body string")
    asked = spark.createDataFrame([("i", "one"), ("i", "THREE"), ("i", "one"), (None, "two")], "item string, body string")
    got = ranked_search.search(docs, asked, id="name", text="body", item="item", item_text="body").collect()
    ranks = {i: [r.id for r in sorted(got, key=lambda r: r["rank"]) if r["item"] == i] for i in ("i", None)}
    assert ranks["i"] == ["c", "a", "b", None] and sorted(map(str, ranks[None])) == ["None", "a", "b", "c"]


@pytest.mark.parametrize("docs, asked", [([], [(1, "a")]), ([(1, "a")], []), ([], []), ([(1, None)], [(1, "a")])])
def test_empty(spark, docs, asked):
    assert ranked_search.search(fixtures.frame(spark, docs), items(spark, asked)).collect() == []


def test_bounds_leave_out_most_documents():
    """The survivors of a floor hold every document above it, and few others."""
    rng = np.random.default_rng(3)
    n, terms = 4000, 300
    df = np.maximum(1, (n * 0.5 / np.arange(1, terms + 1)).astype(int))
    rows = [np.flatnonzero(rng.random(terms) < df / n) for _ in range(n)]
    weight = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n)), pa.array(rng.integers(20, 400, n)), pa.array(rows, pa.list_(pa.int32())),
         pa.array([rng.integers(1, 4, len(r)) for r in rows], pa.list_(pa.int32()))], ["id", "n", "terms", "counts"])
    item = np.sort(rng.choice(terms, 25, replace=False))
    q = ranked_search.Items(pa.array([1]), np.zeros(25, int), item, weight, n, n * 100)
    chunk = ranked_search.Chunk(batch, q)
    inside = np.zeros(terms, bool)
    inside[item] = True
    every = chunk.scores(np.arange(n), inside, weight)
    for place in (5, 50, 200):
        floor = max(1, np.sort(every)[-place])
        found = chunk.survivors(q.terms, weight, floor)
        assert set(np.flatnonzero(every >= floor)) <= set(found.tolist())
        assert len(found) < n / 4 + place, place


def test_impacts_of_very_large_corpora():
    q = ranked_search.Items(pa.array([1]), np.zeros(1, int), np.zeros(1, int), np.ones(1, np.int64), 10 ** 12, 10 ** 15)
    n = np.array([10 ** 8, 5])
    want = [10 ** 9 * 7 // (7000 + 20 * (50 + 50 * int(x) * 10 ** 12 // 10 ** 15)) for x in n]
    assert q.impacts(n, np.array([0, 1]), np.array([7, 7])).tolist() == want
