"""What the physical plans must look like, so that they hold at scale."""

import pytest
from pyspark.sql import functions as F

from weir.catalog.registry import Tables
from weir.catalog.runlogs import definitions_of, runs_of
from weir.contracts import infer_schema, profile
from weir.operators import aggregate, keyset_page, latest_per_key, look_back, top_k
from weir.runlog import analytics, definitions, evidence
from weir.sources import incremental


@pytest.fixture(scope="module")
def t(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return Tables(spark, "/root/testdata/sf0.001")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_ranks_before_the_shuffle(t):
    plan = plan_of(analytics.latest_runs(runs_of(t)))
    below_exchange = plan.split("Exchange hashpartitioning")[1]
    assert "WindowGroupLimit" in below_exchange and "Partial" in below_exchange


def test_first_and_last_aggregate_before_the_shuffle(t):
    measures = [{"fn": "first", "column": "event_type"}, {"fn": "last", "column": "value"}]
    plan = plan_of(aggregate(t.events, measures, ["user_id"], ["ts", "event_id"]))
    assert "partial_min_by" in plan and "partial_max_by" in plan and "Window" not in plan


def test_look_back_is_dealt_by_slices_of_keys(t):
    df = look_back(runs_of(t), ["pipeline_id"], ["queued_at", "id"], 2, lambda w: {"n": F.count("id").over(w.rowsBetween(-2, 0))})
    plan = plan_of(df)
    assert "events.parquet" not in plan  # the input was read when the slices were made
    window = next(line for line in plan.splitlines() if "Window [count" in line)
    assert "__slice" in window


def test_top_and_pages_do_not_sort_everything(t):
    assert "TakeOrderedAndProject" in plan_of(top_k(t.lineitem, [("l_extendedprice", "desc")], 5))
    plan = plan_of(keyset_page(t.events, "ts", "event_id", ("2024-01-20 00:00:00", "5")).rows)
    assert "TakeOrderedAndProject" in plan and "LessThan(ts," in plan


def test_watermark_and_window_bounds_reach_the_scan(t):
    assert "GreaterThan(o_orderdate," in plan_of(incremental(t.orders, "o_orderdate", "1999-01-01"))
    assert "GreaterThanOrEqual(ts," in plan_of(analytics.run_totals(runs_of(t), "2024-01-05", "2024-01-06"))


def test_inference_and_profile_are_one_aggregation(t):
    for df in (infer_schema(t.documents), profile(t.orders, exact_distinct=False)):
        plan = plan_of(df)
        assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "SinglePartition" in plan


def test_evidence_never_crosses_tables(t):
    runs = runs_of(t)
    tasks = runs.select(F.col("id"), F.col("id").alias("run_id"), F.lit("n").alias("node_id"), F.lit("x").alias("node_type"), "state", F.col("queued_at").alias("finished_at"), "error")
    attempts = runs.select(F.col("id").alias("task_run_id"), F.lit(1).alias("attempt"), "state", "error")
    logs = runs.select("id", F.col("id").alias("task_run_id"), F.col("queued_at").alias("ts"), F.lit("error").alias("level"), F.col("error").alias("message"))
    results = runs.select(F.col("id").alias("run_id"), F.lit("c").alias("check_id"), F.lit("FAILED").alias("status"))
    plan = plan_of(evidence.failure_evidence(runs, tasks, attempts, logs, results))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_definition_diff_joins_once(t):
    plan = plan_of(definitions.diff_edges(definitions_of(t, False), definitions_of(t, True)))
    assert plan.count("Join") == 1


def test_percentile_counts_before_the_shuffle(t):
    plan = plan_of(analytics.duration_percentile(runs_of(t), by=["pipeline_id"]))
    assert "partial_count" in plan


def test_latest_keeps_ties_out(t):
    rows = latest_per_key(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], 2)
    assert rows.groupBy("l_orderkey").count().agg(F.max("count")).head()[0] <= 2
