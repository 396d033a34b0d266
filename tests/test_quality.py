from datetime import datetime, timedelta, timezone

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from weir.errors import ConfigError
from weir.quality import (
    RESULT_SCHEMA, check_expectations, evaluate_gate, gate_table, parse_checks, quarantine, results_in_scope, run_checks, split_rows, summarize,
)

NOW = datetime(2026, 3, 31, 12, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def customers(spark):
    newest = NOW - timedelta(hours=1)
    rows = [
        ("c1", "ann@example.com", 100, "north", newest), ("c1", "bob@example.com", 50, "south", newest - timedelta(days=1)),
        (None, "not-an-email", 20, "north", newest - timedelta(days=2)), ("c3", "cat@example.com", -5, "mars", newest - timedelta(days=3)),
        ("c4", "", None, "south", newest - timedelta(days=4)),
    ]
    return spark.createDataFrame(rows, "customer_id STRING, email STRING, revenue BIGINT, region STRING, updated_at TIMESTAMP")


def result(df, **check):
    spec = {"id": "it"} | check
    return run_checks(df, [spec], NOW).head()


def test_row_checks(customers):
    r = result(customers, type="not_null", column="customer_id")
    assert (r.status, r.passed_rows, r.failed_rows, r.total_rows, r.pass_rate) == ("FAILED", 4, 1, 5, 0.8)
    assert r.expected == "NOT NULL, expected 100%" and r.actual == "80%" and r.message == "1/5 rows not fine" and r.failed_samples == [None]
    assert result(customers, type="not_null", column="email").failed_samples == [""]
    r = result(customers, type="range", column="revenue", min=0)
    assert (r.failed_rows, r.failed_samples, r.expected) == (1, ["-5"], "BETWEEN 0 AND +inf, expected 100%")
    assert result(customers, type="range", column="email", max=1).failed_rows == 5
    r = result(customers, type="regex", column="email", pattern="^[^@]+@EXAMPLE.com$", caseInsensitive=True)
    assert r.failed_rows == 2 and sorted(r.failed_samples) == ["", "not-an-email"]
    r = result(customers, type="accepted_values", column="region", values=["north", "south"], threshold=0.8)
    assert r.status == "PASSED" and r.expected == "IN (north, south), expected 80%" and r.failed_samples == ["mars"]


def test_unique(customers):
    r = result(customers, type="unique", column="customer_id")
    assert (r.status, r.failed_rows, r.passed_rows, r.failed_samples, r.message) == ("FAILED", 2, 3, ["c1"], "2 rows have a value that others have")
    assert result(customers, type="unique", column="email").message == "5 different values, each once"


def test_counts_freshness_sql(customers):
    assert result(customers, type="row_count", min=5, max=5).status == "PASSED"
    r = result(customers, type="row_count", minRows=6)
    assert (r.status, r.passed_rows, r.failed_rows, r.actual, r.pass_rate) == ("FAILED", 0, 5, "5", 0.0)
    r = result(customers, type="freshness", column="updated_at", maxAgeSeconds=7200)
    assert (r.status, r.actual, r.failed_samples) == ("PASSED", "3600s old", ["2026-03-31T11:00:00.000Z"])
    assert result(customers, type="freshness", column="updated_at", maxAgeSeconds=60).message.startswith("too old")
    assert result(customers, type="freshness", column="region", maxAgeSeconds=60).actual == "no time found"
    r = result(customers, type="custom_sql", sql="SELECT customer_id FROM input WHERE revenue < 0")
    assert (r.status, r.failed_rows, r.actual, r.failed_samples) == ("FAILED", 1, "1 rows against the rule", ['{"customer_id":"c3"}'])
    assert result(customers, type="custom_sql", sql="SELECT 1 FROM input WHERE false").message == "nothing against the rule"


def test_large_rate_text(spark):
    df = spark.range(1000).select(F.when(F.col("id") >= 6, F.concat(F.lit("c"), "id")).alias("customer_id"))
    r = result(df, type="not_null", column="customer_id", threshold=0.995)
    assert r.actual == "99.4%" and r.status == "FAILED"
    assert result(df, type="not_null", column="customer_id", threshold=0.99).status == "PASSED"


def test_errors_do_not_stop_others(customers):
    checks = [
        {"id": "missing", "type": "not_null", "column": "nope"}, {"id": "bad_sql", "type": "custom_sql", "sql": "SELECT nope FROM input"},
        {"id": "failing_sql", "type": "custom_sql", "sql": "SELECT * FROM input WHERE 1 / (revenue - 50) > 0"}, {"id": "ok", "type": "row_count", "min": 1},
    ]
    results = run_checks(customers, checks, NOW)
    assert [f.name for f in results.schema] == [c.split()[0] for c in RESULT_SCHEMA.split(", ")]
    found = results.collect()
    assert [(r.check_id, r.status) for r in found] == [("missing", "ERRORED"), ("bad_sql", "ERRORED"), ("failing_sql", "ERRORED"), ("ok", "PASSED")]
    assert found[0].total_rows == 5 and found[0].pass_rate == 0 and "Available columns: customer_id" in found[0].message


def test_empty_input(customers):
    checks = [
        {"id": "a", "type": "not_null", "column": "email"}, {"id": "u", "type": "unique", "column": "email"}, {"id": "f", "type": "freshness", "column": "updated_at", "maxAgeSeconds": 1},
        {"id": "s", "type": "custom_sql", "sql": "SELECT * FROM input"},
    ]
    found = {r.check_id: r for r in run_checks(customers.where("false"), checks, NOW).collect()}
    assert found["a"].message == "no rows" and found["a"].status == "PASSED" and found["u"].status == "PASSED" and found["s"].status == "PASSED"
    assert found["f"].status == "FAILED"
    assert run_checks(customers, []).count() == 0


def test_custom_sql_restores_a_view_called_input(spark, customers):
    spark.range(3).createOrReplaceTempView("input")
    result(customers, type="custom_sql", sql="SELECT * FROM input WHERE revenue < 0")
    assert spark.table("input").count() == 3
    spark.catalog.dropTempView("input")


@pytest.mark.parametrize(
    "spec",
    [
        {"id": "-x", "type": "unique", "column": "a"}, {"id": "a", "type": "nope"}, {"id": "a", "type": "unique"}, {"id": "a", "type": "range", "column": "a"},
        {"id": "a", "type": "regex", "column": "a", "pattern": "("}, {"id": "a", "type": "accepted_values", "column": "a", "values": []}, {"id": "a", "type": "row_count"},
        {"id": "a", "type": "freshness", "column": "a"}, {"id": "a", "type": "custom_sql"}, {"id": "a", "type": "unique", "column": "a", "threshold": 2},
        {"id": "a", "type": "unique", "column": "a", "severity": "fatal"}, "text",
    ],
)
def test_bad_checks(spec):
    with pytest.raises(ConfigError):
        parse_checks([spec])


def test_duplicate_ids():
    with pytest.raises(ConfigError, match="Duplicate"):
        parse_checks([{"id": "a", "type": "row_count", "min": 1}] * 2)


def test_fused_checks_scan_once(customers, spark):
    path = "/root/testdata/sf0.001/lineitem.parquet"
    checks = [{"id": f"c{i}", "type": "range", "column": "l_quantity", "min": i} for i in range(10)]
    plan = run_checks(spark.read.parquet(path), checks, NOW, samples=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "ReadSchema: struct<l_quantity:double>" in plan


# ---- summary and gate


@pytest.fixture(scope="module")
def results(spark):
    rows = [("a", "PASSED", "error", 1.0, "x"), ("b", "FAILED", "warn", 0.5, "x"), ("c", "ERRORED", "error", 0.0, "y")]
    return spark.createDataFrame(rows, "check_id STRING, status STRING, severity STRING, pass_rate DOUBLE, node STRING")


def test_summary(results):
    assert tuple(summarize(results).head()) == (3, 1, 1, 1, 0.5, True)
    assert tuple(summarize(results.where("false")).head()) == (0, 0, 0, 0, 1.0, False)


def test_gates(results):
    every = evaluate_gate(results)
    assert every.blocked and every.reason == "2 of 3 checks failed: b, c" and every.failed_checks == ["b", "c"]
    assert evaluate_gate(results.where("check_id = 'a'")).reason == "All 1 checks passed"
    errors = evaluate_gate(results.where("check_id <> 'c'"), "error_only")
    assert not errors.blocked and errors.reason == "nothing of severity error failed (1 of lesser severity)"
    low = evaluate_gate(results, "score_below", 0.6)
    assert low.blocked and low.reason == "score 50.00% under the minimum 60.00%" and low.failed_checks == ["b", "c"]
    fine = evaluate_gate(results, "score_below", 0.5)
    assert not fine.blocked and fine.failed_checks == []
    empty = evaluate_gate(results.where("false"))
    assert (empty.blocked, empty.score, empty.evaluated_checks) == (False, 1.0, 0)
    with pytest.raises(ConfigError):
        evaluate_gate(results, "never")


def test_scope_and_groups(results):
    edges = [("x", "g"), ("y", "other")]
    assert results_in_scope(results, "node", edges, "g").count() == 2
    assert results_in_scope(results, "node", edges, "g", "run").count() == 3
    assert rows_of(gate_table(results, by=["node"]), "node", "blocked") == [("x", True), ("y", True)]


# ---- quarantine and expectations


def test_quarantine_partitions_the_input(customers):
    checks = [
        {"id": "id", "type": "not_null", "column": "customer_id"}, {"id": "rev", "type": "range", "column": "revenue", "min": 0},
        {"id": "soft", "type": "accepted_values", "column": "region", "values": ["x"], "severity": "warn"}, {"id": "u", "type": "unique", "column": "email"},
    ]
    good, bad = split_rows(customers, checks)
    assert good.count() == 3 and rows_of(bad.select(F.array_join("failed_checks", ","))) == [("id",), ("rev",)]
    assert quarantine(customers, checks).count() == 5 and good.columns == customers.columns


def test_expectations(spark):
    sizes = spark.createDataFrame([("d", 10)], "name STRING, row_count BIGINT")
    ran = spark.createDataFrame([("d", "a", "not_null", "PASSED"), ("d", "a", "not_null", "FAILED"), ("d", "b", "unique", "PASSED")], "dataset STRING, column STRING, type STRING, status STRING")
    wanted = [{"dataset": "d", "minRows": 10, "maxRows": 9, "notNull": ["a"], "unique": ["b"], "nonNegative": ["c"]}, {"dataset": "gone", "minRows": 1}]
    assert rows_of(check_expectations(wanted, ran, sizes), "dataset", "expectation", "target", "passed") == [
        ("d", "maxRows", "9", False), ("d", "minRows", "10", True), ("d", "nonNegative", "c", False), ("d", "notNull", "a", False), ("d", "unique", "b", True),
        ("gone", "minRows", "1", False),
    ]
