import json
import random
from datetime import datetime, timedelta

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from weir.runlog import analytics, definitions, evidence, incidents, search

T0 = datetime(2026, 3, 30, 8)
RUNS = (
    "id STRING, pipeline_id STRING, pipeline_name STRING, state STRING, queued_at TIMESTAMP_NTZ, duration_ms BIGINT, error STRING"
)


def make_runs(spark, rows):
    data = [(f"r{i}", p, f"pipe {p}", s, T0 + timedelta(hours=h), d, "boom" if s == "FAILED" else None) for i, (p, s, h, d) in enumerate(rows)]
    return spark.createDataFrame(data, RUNS)


def test_totals(spark):
    runs = make_runs(spark, [("p", "SUCCESS", 0, 1000), ("p", "SUCCESS", 1, 3000), ("p", "FAILED", 20, 2000), ("q", "SUCCESS", 22, 5000), ("q", "RUNNING", 23, None), ("q", "QUEUED", 90, None)])
    r = analytics.run_totals(runs, T0, T0 + timedelta(hours=24)).head()
    assert (r.runs, r.succeeded, r.failed, r.cancelled, r.running, r.success_rate, r.average_duration_ms) == (5, 3, 1, 0, 1, 0.75, 2750)
    empty = analytics.run_totals(runs, "2030-01-01").head()
    assert (empty.runs, empty.success_rate, empty.average_duration_ms) == (0, 0.0, None)
    assert rows_of(analytics.daily_series(runs, until=T0 + timedelta(hours=24))) == [(datetime(2026, 3, 30).date(), 2, 0, 0, 2000), (datetime(2026, 3, 31).date(), 1, 1, 0, 3500)]
    assert analytics.duration_percentile(runs, 0.5).head()[0] == 2500.0
    assert rows_of(analytics.latest_runs(runs), "pipeline_id", "id") == [("p", "r2"), ("q", "r5")]
    assert dict(rows_of(analytics.runs_by_state(runs)))["CANCELLED"] == 0


def test_top_failing_sorts_by_number(spark):
    runs = make_runs(spark, [("p", "FAILED", i, 1) for i in range(21)])
    tasks = spark.createDataFrame([(f"r{i % 21}", "n10" if i < 10 else "n9", "x", "FAILED") for i in range(19)], "run_id STRING, node_id STRING, node_type STRING, state STRING")
    assert [(r.node_id, r.failures) for r in analytics.top_failing(tasks, runs).collect()] == [("n10", 10), ("n9", 9)]
    assert analytics.top_failing(tasks, runs, until=T0).count() == 1


@pytest.mark.parametrize("slices", [4, 1, None])
def test_repeated_failure(spark, slices):
    runs = make_runs(spark, [("p", s, i, 1) for i, s in enumerate(["FAILED", "FAILED", "FAILED", "FAILED", "SUCCESS", "FAILED", "FAILED"])] + [("q", "FAILED", 3, 1)])
    found = incidents.repeated_failure(runs, slices=slices)
    assert rows_of(found, "run_id", "fingerprint", "title") == [
        ("r2", "repeated_failure:p", "pipe p failed 3 consecutive times"), ("r3", "repeated_failure:p", "pipe p failed 3 consecutive times"),
    ]
    shown = json.loads(found.where("run_id = 'r3'").head().evidence)
    assert shown["runIds"] == ["r3", "r2", "r1"] and shown["consecutiveFailures"] == 3 and shown["lastError"] == "boom"


def test_duration_spike(spark):
    runs = make_runs(spark, [("p", "SUCCESS", i, 40_000) for i in range(6)] + [("p", "FAILED", 6, 1), ("p", "SUCCESS", 7, 200_000), ("q", "SUCCESS", 8, 500_000)])
    found = incidents.duration_spike(runs).head()
    assert found.run_id == "r7" and found.title == "pipe p took 200.0s, 5.0x its recent average"
    assert json.loads(found.evidence) == {"durationMs": 200000, "recentAverageMs": 40000, "sampleSize": 6, "multiplier": 5.0}
    assert incidents.duration_spike(runs.where("id <> 'r7'")).count() == 0


@pytest.mark.parametrize("slices", [27, 1, None])
def test_missing_data_of_other_runs(spark, slices):
    import random

    random.seed(11)
    states = [random.choice(["SUCCESS", "SUCCESS", "FAILED"]) for _ in range(80)]
    reads = [random.choice([0, 0, 0, 0, 0, 9]) for _ in range(80)]
    runs = make_runs(spark, [("p", s, i, 1) for i, s in enumerate(states)])
    tasks = spark.createDataFrame([(f"r{i}", "src", "csv.source", "SUCCESS", n) for i, n in enumerate(reads)], "run_id STRING, node_id STRING, node_type STRING, state STRING, rows_read BIGINT")
    want = []
    for i in range(80):
        earlier = [reads[j] for j in range(i) if states[j] == "SUCCESS"]
        if reads[i] == 0 and any(earlier[-(4 if states[i] == "SUCCESS" else 5) :]):
            want.append((f"r{i}",))
    assert rows_of(incidents.missing_data(tasks, runs, slices), "run_id") == sorted(want)


def test_missing_data(spark):
    runs = make_runs(spark, [("p", "SUCCESS", i, 1) for i in range(7)])
    reads = [10, 0, 0, 0, 0, 0, 3]
    tasks = spark.createDataFrame([(f"r{i}", "src", "csv.source", "SUCCESS", n) for i, n in enumerate(reads)], "run_id STRING, node_id STRING, node_type STRING, state STRING, rows_read BIGINT")
    assert rows_of(incidents.missing_data(tasks, runs), "run_id") == [("r1",), ("r2",), ("r3",), ("r4",)]


def test_quality_drift_stale(spark):
    results = spark.createDataFrame(
        [("p", "r1", None, "a", "warn", "FAILED"), ("p", "r1", "d", "b", "error", "ERRORED"), ("p", "r1", "d", "c", "warn", "FAILED"), ("p", "r1", "d", "e", "warn", "PASSED")],
        "pipeline_id STRING, run_id STRING, dataset STRING, check_id STRING, severity STRING, status STRING",
    )
    for name in ("column", "expected", "actual"):
        results = results.withColumn(name, F.lit("x"))
    results = results.withColumn("failed_rows", F.lit(1)).withColumn("total_rows", F.lit(2)).withColumn("created_at", F.lit(T0))
    assert rows_of(incidents.quality_failure(results), "dataset", "severity", "title") == [
        ("(unnamed dataset)", "low", "1 checks failed on dataset (unnamed dataset)"), ("d", "high", "2 checks failed on dataset d"),
    ]
    datasets = spark.createDataFrame([("old", T0 - timedelta(days=30), "r0"), ("fresh", T0 - timedelta(hours=3), "r0"), ("orphan", T0 - timedelta(days=30), None)], "name STRING, last_updated_at TIMESTAMP_NTZ, last_run_id STRING")
    schedules = spark.createDataFrame([("s1", "p", True, None), ("s2", "p", False, 60)], "id STRING, pipeline_id STRING, enabled BOOLEAN, interval_seconds INT")
    stale = incidents.stale_datasets(datasets, make_runs(spark, [("p", "SUCCESS", 0, 1)]), schedules, F.lit(T0).cast("timestamp_ntz"))
    assert rows_of(stale, "dataset", "title") == [("old", "old has not been refreshed for 720h")]


def test_roll_up(spark):
    runs = make_runs(spark, [(p, "FAILED", i, 1) for p in ("p", "q", "z") for i in range(4)])
    found = incidents.repeated_failure(runs)
    first = incidents.roll_up(found)
    assert rows_of(first, "fingerprint", "status", "occurrences") == [(f"repeated_failure:{p}", "open", 2) for p in ("p", "q", "z")]
    status = F.when(F.col("pipeline_id") == "p", "acknowledged").when(F.col("pipeline_id") == "q", "resolved").otherwise("open")
    known = first.withColumn("status", status)
    assert sorted(map(str, incidents.roll_up(found, known).collect())) == sorted(map(str, known.collect()))  # counted already
    later = incidents.repeated_failure(make_runs(spark, [(p, "FAILED", i, 1) for p in ("p", "q", "z") for i in range(10, 14)]))
    again = incidents.roll_up(later.where("pipeline_id <> 'z'"), known)
    assert rows_of(again, "fingerprint", "status", "occurrences") == [
        ("repeated_failure:p", "acknowledged", 4), ("repeated_failure:q", "open", 2), ("repeated_failure:q", "resolved", 2), ("repeated_failure:z", "open", 2),
    ]
    assert again.where("fingerprint = 'repeated_failure:p'").head().first_seen_at == first.where("pipeline_id = 'p'").head().first_seen_at


def test_evidence(spark):
    runs = make_runs(spark, [("p", "SUCCESS", 0, 1), ("p", "FAILED", 1, 1), ("p", "FAILED", 2, 1)])
    tasks = spark.createDataFrame(
        [("t1", "r1", "load", "x", "FAILED", T0, "e1"), ("t2", "r2", "load", "x", "FAILED", T0 + timedelta(hours=2), "late"), ("t3", "r2", "clean", "x", "FAILED", T0 + timedelta(hours=1), "first"), ("t4", "r2", "out", "x", "BLOCKED", None, None)],
        "id STRING, run_id STRING, node_id STRING, node_type STRING, state STRING, finished_at TIMESTAMP_NTZ, error STRING",
    )
    attempts = spark.createDataFrame([("t3", 2, "FAILED", "b"), ("t3", 1, "FAILED", "a"), ("t1", 1, "FAILED", "c")], "task_run_id STRING, attempt INT, state STRING, error STRING")
    logs = spark.createDataFrame([(f"l{i:03}", "t3", T0 + timedelta(seconds=i), "error" if i >= 90 else "info", f"m{i}") for i in range(100)], "id STRING, task_run_id STRING, ts TIMESTAMP_NTZ, level STRING, message STRING")
    results = spark.createDataFrame([("r2", "c1", "FAILED"), ("r2", "c2", "PASSED")], "run_id STRING, check_id STRING, status STRING")
    found = {r.run_id: r for r in evidence.failure_evidence(runs, tasks, attempts, logs, results).collect()}
    r = found["r2"]
    assert (r.node_id, r.task_error, r.attempts, r.last_success_run_id, r.failed_checks, r.affected_nodes) == ("clean", "first", 2, "r0", ["c1"], ["out"])
    assert [a.error for a in r.attempt_list] == ["a", "b"] and len(r.logs) == r.log_lines_total == 100 and r.logs[0].message == "m0" and r.logs[-1].message == "m99"
    cut = evidence.failure_evidence(runs, tasks, attempts, logs, results, log_limit=50, recent_runs=1).where("run_id = 'r2'").head()
    assert len(cut.logs) == 60 and cut.log_lines_total == 100
    assert found["r1"].recent_failures == 2 and found["r1"].failing_since == T0 + timedelta(hours=1) and r.recent_failures == 1


def test_version_changes(spark):
    runs = make_runs(spark, [("p", "SUCCESS", 0, 1), ("p", "FAILED", 1, 1), ("p", "FAILED", 2, 1)])
    runs = runs.withColumn("pipeline_version_id", F.when(F.col("id") == "r2", "v2").otherwise("v1"))
    tasks = runs.where("state = 'FAILED'").select(F.concat(F.lit("t"), "id").alias("id"), F.col("id").alias("run_id"), F.lit("n").alias("node_id"), F.lit("x").alias("node_type"), "state", F.col("queued_at").alias("finished_at"), "error")
    empty = tasks.where("false")
    attempts = empty.select(F.col("id").alias("task_run_id"), F.lit(1).alias("attempt"), "state", "error")
    logs = empty.select("id", F.col("id").alias("task_run_id"), F.col("finished_at").alias("ts"), F.lit("error").alias("level"), F.col("error").alias("message"))
    results = empty.select("run_id", F.lit("c").alias("check_id"), F.lit("FAILED").alias("status"))
    found = evidence.failure_evidence(runs, tasks, attempts, logs, results)
    node = lambda n: json.dumps({"nodes": [{"id": "a", "type": "x", "config": {"limit": n}}], "edges": []})
    versions = spark.createDataFrame([("v1", node(1)), ("v2", node(2))], "pipeline_version_id STRING, definition STRING")
    assert rows_of(evidence.version_changes(found, versions), "run_id", "path", "before", "after") == [("r2", "limit", "1", "2")]


def test_search(spark):
    table = spark.createDataFrame([("1", "sales"), ("2", "Sales daily"), ("3", "all SALES"), ("4", "other")], "id STRING, name STRING")
    hits = search.search_catalog({"pipeline": (table, "id", "name", ["name"])}, " SALES ")
    assert [(h.id, h.score) for h in hits.collect()] == [("1", 3), ("2", 2), ("3", 1)]
    assert search.search_catalog({"pipeline": (table, "id", "name", ["name"])}, "  ").count() == 0
    runs = make_runs(spark, [("p", "SUCCESS", i, i) for i in range(60)])
    page = search.find_runs(runs, ["SUCCESS"], "p", limit=50)
    rest = search.find_runs(runs, ["SUCCESS"], "p", cursor=page.next_cursor(), limit=50)
    assert page.rows.count() == 50 and rest.rows.count() == 10 and rest.next_cursor() is None


def test_definition_diff(spark):
    old = {"nodes": [{"id": "a", "type": "x", "config": {"q": [1, {"r": 2}], "same": {}}, "metadata": {"position": {"x": 1}}}, {"id": "b", "type": "x", "config": {}}], "edges": [{"from": "a", "to": "b"}]}
    new = {"nodes": [{"id": "a", "type": "y", "config": {"same": {}, "q": [1, {"r": 3}], "n": None}, "retry": {"max": 2}, "metadata": {"position": {"x": 9}}}, {"id": "c", "type": "x", "config": {}}], "edges": [{"from": "a", "to": "c"}]}
    moved = json.loads(json.dumps(old))
    moved["nodes"][0]["metadata"]["position"]["x"] = 5
    schema = "pipeline_id STRING, definition STRING"
    before = spark.createDataFrame([("p", json.dumps(old)), ("m", json.dumps(old))], schema)
    after = spark.createDataFrame([("p", json.dumps(new)), ("m", json.dumps(moved))], schema)
    assert rows_of(definitions.diff_settings(before, after), "pipeline_id", "node_id", "path", "before", "after") == [("p", "a", "n", None, "null"), ("p", "a", "q[1].r", "2", "3")]
    assert rows_of(definitions.diff_nodes(before, after), "pipeline_id", "node_id", "change") == [
        ("m", "a", "position"), ("p", "a", "position"), ("p", "a", "retry"), ("p", "a", "type"), ("p", "b", "removed"), ("p", "c", "added"),
    ]
    assert rows_of(definitions.diff_edges(before, after), "to", "change") == [("b", "removed"), ("c", "added")]
    assert rows_of(definitions.semantically_equal(before, after)) == [("m", True), ("p", False)]


def test_definitions_are_compared_in_one_pass(spark):
    """Settings that are deep, hold brackets and quotes in text, or give one path twice; one join, and no shuffle behind the write."""
    deep = {"a": {"b": [[{"c": [1, {"d": "x"}]}]]}, "text": 'one " and ]}[{ \\', "k.l": 1, "k": {"l": 2}, "e": {}, "gone": []}
    other = json.loads(json.dumps(deep))
    other["a"]["b"][0][0]["c"][1]["d"], other["e"], other["k"]["l"] = "y", {"new": None}, 1
    del other["gone"]
    turned = dict(reversed(deep.items()))

    def table(config):
        return spark.createDataFrame([("p", json.dumps({"nodes": [{"id": "a", "type": "x", "config": config}], "edges": None}))], "pipeline_id STRING, definition STRING")

    found = definitions.compare(table(deep), table(other))
    assert rows_of(found.select(F.inline("settings"))) == [
        ("a", "a.b[0][0].c[1].d", '"x"', '"y"'), ("a", "e", "{}", None), ("a", "e.new", None, "null"), ("a", "gone", "[]", None), ("a", "k.l", "2", "1"),
    ]
    assert not found.head().equal and definitions.compare(table(deep), table(turned)).head().equal
    assert rows_of(definitions.diff_settings(table(deep), table(other))) == rows_of(found.select("pipeline_id", F.inline("settings")))
    for df in (found, definitions.semantically_equal(table(deep), table(other)), definitions.diff_settings(table(deep), table(other))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan


def test_leaf_paths(spark):
    texts = ['{"a": {"b": [1, {"c": null}, []], "d": {}}, "e": "x\\"y", "f": 1.5}', "[]", '"s"', None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id INT, t STRING")
    assert rows_of(definitions.leaf_paths(rows, ["id"], "t")) == [
        (0, "a.b[0]", "1"), (0, "a.b[1].c", "null"), (0, "a.b[2]", "[]"), (0, "a.d", "{}"), (0, "e", '"x\\"y"'), (0, "f", "1.5"), (1, "", "[]"), (2, "", '"s"'),
    ]


def test_percentile_without_groups(spark):
    rng = random.Random(3)
    for values in ([7], [1, 2], [rng.randint(0, 10**6) for _ in range(501)], [5] * 90 + [10**12] * 10):
        df = spark.createDataFrame([(datetime(2026, 1, 1), v) for v in values], "queued_at TIMESTAMP_NTZ, duration_ms BIGINT")
        for fraction in (0.0, 0.5, 0.95, 1.0):
            ordered, at = sorted(values), fraction * (len(values) - 1)
            low, high = ordered[int(at)], ordered[min(int(at) + (at > int(at)), len(ordered) - 1)]
            found = analytics.duration_percentile(df, fraction)
            assert found.head()[0] == pytest.approx(low + (high - low) * (at - int(at)))
    assert analytics.duration_percentile(df.limit(0)).head()[0] is None
    windows = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
    assert windows and all("__slice" in line for line in windows)
