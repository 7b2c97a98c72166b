"""Plan-shape guards: the properties that keep the operators scalable."""

import contextlib
import io

from pyspark.sql import functions as F

import __spark_entry__ as E
from postingflow.operators import dedup as D

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_first_wins_aggregates_before_the_shuffle(spark):
    # one key holding most rows: the partial aggregate runs before the Exchange
    df = spark.range(0, 5000).select(F.when(F.col("id") % 10 == 0, F.col("id").cast("string"))
                                     .otherwise(F.lit("")).alias("reference_id"),
                                     F.lit(1).cast("long").alias("page"), F.col("id").alias("pos"))
    tree = plan_of(D.dedup_first(df)).split("\n\n")[0]
    lines = [ln.strip() for ln in tree.splitlines()]
    agg = [i for i, ln in enumerate(lines) if "Aggregate" in ln]
    ex = [i for i, ln in enumerate(lines) if "Exchange" in ln]
    assert len(agg) == 2 and agg[0] < ex[0] < agg[1]


def test_no_nested_loops_anywhere(spark):
    qs = E.queries()
    for name in ["match_messages", "classify_messages", "board", "top_k", "import_postings", "apply_actions"]:
        p = plan_of(qs[name](spark, SF))
        assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p, name


def test_topk_limits_before_shuffle(spark):
    tree = plan_of(E.queries()["top_k"](spark, SF)).split("\n\n")[0]
    lines = [ln.strip() for ln in tree.splitlines()]
    wgl = [i for i, ln in enumerate(lines) if "WindowGroupLimit" in ln]
    ex = [i for i, ln in enumerate(lines) if ln.endswith(")") and "Exchange" in ln and "Broadcast" not in ln]
    assert len(wgl) == 2 and wgl[0] < ex[0] < wgl[1]


def test_pruning_and_pushdown(spark):
    qs = E.queries()
    p = plan_of(qs["pipeline_stats"](spark, SF))
    # status and score only: two columns of orders, no customer scan
    assert "ReadSchema: struct<o_totalprice:double,o_orderpriority:string>" in p
    assert "customer" not in p
    p = plan_of(qs["max_age"](spark, SF))
    assert "GreaterThanOrEqual(o_orderdate" in p
