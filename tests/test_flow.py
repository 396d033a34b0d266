import shutil
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from weir.catalog.incremental import DEMO
from weir.errors import ConfigError, ValidationError
from weir.plans import backfill_dates, backfill_progress, map_groups, map_rows, missing_dates, run_backfill, run_flow, unique_runs
from weir.plans.flow import landed_source
from weir.sources import Datasets
from weir.sources.objects import RunInfo
from weir.streaming import event_feed, events_after, gated_stream, upsert_stream


def spec(nodes, edges):
    return {"name": "f", "nodes": [{"id": i, "type": t, "config": c} for i, t, c in nodes], "edges": [dict(zip(("from", "to", "port"), e)) for e in edges]}


ROWS = [{"id": 1, "v": 5, "k": "a"}, {"id": 2, "v": -1, "k": "b"}, {"id": 3, "v": 7, "k": "a"}]


def test_demo(spark, folder):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    datasets = Datasets(spark, folder)
    result = run_flow(spark, DEMO, {"lines": lines}, datasets)
    assert set(result.states.values()) == {"SUCCESS"}
    suppliers = lines.select("l_suppkey").distinct().count()
    assert datasets.read("supplier_load").count() == suppliers
    assert result.details["store"]["rowsWritten"] == suppliers and result.rows_out("shipped") == lines.count()
    assert datasets.catalog().head().quality_status == "PASSED"


def test_checked_data_is_written_once(spark, folder):
    """Two check nodes, a gate and a sink: one folder of files, and no source is computed for a second time."""
    ran = spark.sparkContext.accumulator(0)

    def count(row):
        ran.add(1)
        return row

    flow = spec(
        [
            ("src", "dataset.source", {"dataset": "t"}), ("py", "python.transform", {}), ("one", "quality.check", {"checks": [{"id": "a", "type": "not_null", "column": "id"}]}),
            ("two", "quality.check", {"checks": [{"id": "b", "type": "unique", "column": "id"}]}), ("gate", "quality.gate", {}), ("out", "dataset.destination", {"dataset": "d"}),
        ],
        [("src", "py"), ("py", "one"), ("one", "two"), ("two", "gate"), ("gate", "out")],
    )
    rows = spark.range(50, numPartitions=3).select("id")  # the function gets each of the three partitions once
    datasets = Datasets(spark, folder)
    result = run_flow(spark, flow, {"t": rows}, datasets, {"py": (count, rows.schema)})
    assert datasets.read("d").count() == 50 and ran.value == 3 and result.metrics("out") == {"rows_in": 50, "rows_out": 50}
    assert len(list(Path(folder).glob("_parts/stage=*"))) == 1 and datasets.snapshot("d").parts[0].stage == result.staged["one"].stage
    result.release()


def test_http_source_opens_landed_responses(spark):
    bodies = spark.createDataFrame([("a", 1, '{"items": [{"id": 1}, {"id": 2}]}'), ("a", 2, '{"items": []}')], "source STRING, page INT, body STRING")
    flow = spec([("api", "http.source", {"recordPath": "items", "pagination": "page"}), ("keep", "filter.transform", {"predicates": [{"column": "id", "op": "gt", "value": 1}]})], [("api", "keep")])
    assert rows_of(run_flow(spark, flow, {"api": bodies}).outputs["keep"], "id") == [(2,)]


def test_row_metrics_after_decisions(spark, folder):
    """A branch and an onEmpty filter look at the data before the sink does, and the counts are still those of the whole run."""
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    kept = orders.where("o_totalprice >= 100000").count()
    flow = spec(
        [
            ("src", "dataset.source", {"dataset": "orders"}), ("many", "condition.branch", {"expression": "row_count_gt", "value": 10}),
            ("dear", "filter.transform", {"predicates": [{"column": "o_totalprice", "op": "gte", "value": 100000}], "onEmpty": "fail"}),
            ("some", "condition.branch", {"expression": "row_count_gt", "value": 3}),
            ("per", "aggregate.transform", {"measures": [{"fn": "count", "as": "n"}], "groupBy": ["o_orderstatus"]}), ("out", "dataset.destination", {"dataset": "d"}),
        ],
        [("src", "many"), ("many", "dear", "true"), ("dear", "some"), ("some", "per", "true"), ("per", "out")],
    )
    result = run_flow(spark, flow, {"orders": orders}, Datasets(spark, folder))
    groups = orders.where("o_totalprice >= 100000").select("o_orderstatus").distinct().count()
    total = orders.count()
    assert result.metrics("src") == {"rows_in": 0, "rows_out": total}
    assert result.metrics("many") == {"rows_in": total, "rows_out": total}
    assert result.metrics("dear") == {"rows_in": total, "rows_out": kept, "rows_removed": total - kept}
    assert result.metrics("per") == {"rows_in": kept, "rows_out": groups, "groups": groups}
    assert result.metrics("out") == {"rows_in": groups, "rows_out": groups}


def test_blocked_gate_leaves_no_data(spark, folder):
    flow = spec(
        [
            ("src", "inline.source", {"rows": ROWS}), ("chk", "quality.check", {"dataset": "d", "checks": [{"id": "pos", "type": "range", "column": "v", "min": 0}]}),
            ("gate", "quality.gate", {}), ("out", "dataset.destination", {"dataset": "d"}), ("side", "dataset.destination", {"dataset": "side"}),
        ],
        [("src", "chk"), ("chk", "gate"), ("gate", "out"), ("src", "side")],
    )
    result = run_flow(spark, flow, datasets=Datasets(spark, folder))
    assert result.states == {"src": "SUCCESS", "chk": "SUCCESS", "gate": "SUCCESS", "side": "SUCCESS", "out": "BLOCKED"}
    assert result.decisions["gate"].failed_checks == ["pos"] and not Path(f"{folder}/d").exists() and Path(f"{folder}/side").exists()
    flow["nodes"][1]["config"]["onFailure"] = "fail"
    with pytest.raises(ValidationError, match="pos"):
        run_flow(spark, flow, datasets=Datasets(spark, folder))


def test_gate_only_sees_its_ancestors(spark):
    bad = {"checks": [{"id": "bad", "type": "row_count", "min": 99}]}
    good = {"checks": [{"id": "good", "type": "row_count", "min": 1}]}
    nodes = [("src", "inline.source", {"rows": ROWS}), ("c1", "quality.check", bad), ("c2", "quality.check", good), ("g", "quality.gate", {})]
    edges = [("src", "c1"), ("src", "c2"), ("c2", "g")]
    assert not run_flow(spark, spec(nodes, edges)).decisions["g"].blocked
    nodes[3] = ("g", "quality.gate", {"scope": "run"})
    assert run_flow(spark, spec(nodes, [("src", "c1"), ("c1", "c2"), ("c2", "g")])).decisions["g"].blocked


@pytest.mark.parametrize(
    ("config", "taken"),
    [
        ({"expression": "row_count_gt", "value": 2}, "yes"), ({"expression": "row_count_gt", "value": 3}, "no"), ({"expression": "row_count_eq", "value": 3}, "yes"),
        ({"expression": "has_column", "column": "zz"}, "no"), ({"expression": "param_equals", "param": "env", "value": "prod"}, "yes"),
    ],
)
def test_branch(spark, config, taken):
    nodes = [("src", "inline.source", {"rows": ROWS}), ("if", "condition.branch", config), ("yes", "filter.transform", {}), ("no", "filter.transform", {}), ("after", "filter.transform", {})]
    edges = [("src", "if"), ("if", "yes", "true"), ("if", "no", "false"), ("no", "after")]
    result = run_flow(spark, spec(nodes, edges), run=RunInfo(params={"env": "prod"}))
    assert result.states[taken] == "SUCCESS" and result.states["no" if taken == "yes" else "yes"] == "SKIPPED"
    assert result.states["after"] == result.states["no"]


def test_transforms(spark, folder):
    def double(rows):
        return [r | {"v": r["v"] * 2} for r in rows]

    nodes = [
        ("src", "inline.source", {"rows": ROWS}), ("names", "inline.source", {"rows": [{"k": "a", "name": "Ann"}]}), ("twice", "python.transform", {}),
        ("joined", "join.transform", {"left": "twice", "right": "names", "on": [{"left": "k", "right": "k"}], "type": "left"}),
        ("sql", "sql.transform", {"query": "SELECT j.name, sum(j.v) AS total FROM j GROUP BY j.name", "aliases": {"j": "joined"}}),
        ("agg", "aggregate.transform", {"measures": [{"fn": "max", "column": "total", "as": "top"}]}),
        ("file", "s3.destination", {"path": folder + "/{{ run.id }}", "format": "ndjson"}),
    ]
    edges = [("src", "twice"), ("twice", "joined"), ("names", "joined"), ("joined", "sql"), ("sql", "agg"), ("sql", "file")]
    result = run_flow(spark, spec(nodes, edges), functions={"twice": (double, "id BIGINT, v BIGINT, k STRING")}, run=RunInfo("r7"))
    assert rows_of(result.outputs["sql"]) == [("Ann", 24), (None, -2)] and result.outputs["agg"].head().top == 24
    assert spark.read.json(f"{folder}/r7").count() == 2
    assert not [t for t in spark.catalog.listTables() if t.name in ("input", "j", "joined")]


def test_flow_errors(spark):
    src = ("src", "inline.source", {"rows": ROWS})
    for nodes, edges in (
        ([src, ("f", "filter.transform", {"predicates": [{"column": "zz", "op": "null"}]})], [("src", "f")]), ([src, ("s", "sql.transform", {"aliases": {"x": "y"}})], [("src", "s")]),
        ([src], [("src", "nope")]), ([("a", "filter.transform", {}), ("b", "filter.transform", {})], [("a", "b"), ("b", "a")]), ([("x", "magic.box", {})], []),
        ([src, ("t", "inline.source", {"rows": ROWS}), ("f", "filter.transform", {})], [("src", "f"), ("t", "f")]), ([("p", "postgres.source", {"connectionId": "c"})], []),
    ):
        with pytest.raises(ConfigError):
            run_flow(spark, spec(nodes, edges))


def test_jdbc_and_file_nodes(spark, folder):
    Path(f"{folder}/in.csv").write_text("id,v\n1,2\n2,3\n")
    nodes = [("src", "csv.source", {"fileId": f"{folder}/in.csv"}), ("out", "postgres.destination", {"connectionId": "db", "table": "T", "writeMode": "append", "createTable": True})]
    connection = {"db": {"url": f"jdbc:derby:{folder}/db;create=true"}}
    assert run_flow(spark, spec(nodes, [("src", "out")]), jdbc=connection).details["out"]["rowsWritten"] == 2
    back = run_flow(spark, spec([("t", "postgres.source", {"connectionId": "db", "table": "T"}), ("v", "schema.validate", {"dataset": "d"})], [("t", "v")]), jdbc=connection)
    assert back.outputs["v"].count() == 2 and back.details["v"]["classification"] == "COMPATIBLE"
    landed = spark.createDataFrame([("s", 1, '{"r": [{"id": 1}]}'), ("s", 2, '{"r": [{"id": 2}]}')], "source STRING, page BIGINT, body STRING")
    assert landed_source(landed, {"recordPath": "r", "pagination": "page"}).count() == 2 and landed_source(landed, {"recordPath": "r"}).count() == 1


# ---- Python functions


def test_map_rows_and_groups(spark):
    df = spark.range(20).select("id", (F.col("id") % 3).alias("k"))

    def keep_even(rows):
        return [r for r in rows if r["id"] % 2 == 0]

    def size(rows):
        return [{"k": rows[0]["k"], "n": len(rows)}]

    assert map_rows(df, keep_even, df.schema).count() == 10
    assert map_rows(df, lambda rows: None, df.schema).count() == 0
    assert rows_of(map_groups(df, ["k"], size, "k BIGINT, n BIGINT")) == [(0, 7), (1, 7), (2, 6)]
    with pytest.raises(ValidationError, match="a group has 7 rows"):
        map_groups(df, ["k"], size, "k BIGINT, n BIGINT", max_group_rows=6)
    with pytest.raises(Exception, match="must return a list of dicts"):
        map_rows(df, lambda rows: 5, df.schema).collect()


# ---- backfill


def test_backfill_dates(spark):
    a, b = datetime(2024, 1, 1), datetime(2024, 1, 4, 12)
    assert [r[0].day for r in backfill_dates(spark, a, b).collect()] == [1, 2, 3, 4]
    assert backfill_dates(spark, a, a + timedelta(minutes=5), 60).count() == 6
    far = a + timedelta(days=150)
    assert backfill_dates(spark, a, far, confirm_large=True).count() == 151
    for arguments in ((b, a), (a, far), (a, b, 30), (a, b + timedelta(days=9), 60), (datetime(2999, 1, 1), datetime(2999, 1, 2))):
        with pytest.raises(ConfigError):
            backfill_dates(spark, *arguments)


def test_backfill_tables(spark):
    day = lambda n: datetime(2024, 1, n)
    schema = "id BIGINT, schedule_id STRING, backfill_id STRING, logical_date TIMESTAMP_NTZ, queued_at TIMESTAMP_NTZ, state STRING"
    runs = spark.createDataFrame([(1, "s", "b", day(1), day(5), "SUCCESS"), (2, "s", "b", day(2), day(5), "FAILED"), (3, "s", "b", day(2), day(6), "RUNNING"), (4, None, None, None, day(1), "SUCCESS")], schema)
    dates = spark.createDataFrame([("s", "b", day(n)) for n in range(1, 5)], "schedule_id STRING, backfill_id STRING, logical_date TIMESTAMP_NTZ")
    assert rows_of(missing_dates(dates.drop("backfill_id"), runs), "logical_date") == [(day(3),), (day(4),)]
    assert tuple(backfill_progress(dates, runs).head()) == ("b", 4, 1, 1, 1, 2, 50)
    assert rows_of(unique_runs(runs), "id") == [(1,), (2,), (4,)]


def test_backfill_replaces_only_its_days(spark, folder):
    events = spark.sql("SELECT explode(sequence(TIMESTAMP_NTZ '2024-01-01', TIMESTAMP_NTZ '2024-01-05 23:00:00', INTERVAL 1 HOUR)) AS ts")
    build = lambda factor: lambda df: df.groupBy("run_date").agg((F.count(F.lit(1)) * factor).alias("n"))
    run_backfill(events, "ts", datetime(2024, 1, 1), datetime(2024, 1, 5), build(1), folder + "/t")
    run_backfill(events, "ts", datetime(2024, 1, 2), datetime(2024, 1, 3), build(10), folder + "/t")
    assert [r.n for r in spark.read.parquet(folder + "/t").orderBy("run_date").collect()] == [24, 240, 240, 24, 24]
    with pytest.raises(ConfigError):
        run_backfill(events, "ts", datetime(2024, 1, 1), datetime(2024, 1, 1), lambda df: df.drop("run_date"), folder + "/t")


# ---- streams


def test_streams_pick_up_where_they_stopped(spark, folder):
    schema = "k BIGINT, v BIGINT, at BIGINT"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder + "/in")
    datasets = Datasets(spark, folder + "/out")

    def run():
        stream = event_feed(spark, folder + "/in", spark.createDataFrame([], schema).schema, 1)
        upsert_stream(stream, datasets, "latest", ["k"], folder + "/ck", [("at", "desc")]).awaitTermination()
        return rows_of(datasets.read("latest"), "k", "v")

    put([(1, 10, 1), (1, 11, 2), (2, 20, 1)])
    assert run() == [(1, 11), (2, 20)]
    put([(2, 21, 3), (3, 30, 3)])
    assert run() == [(1, 11), (2, 21), (3, 30)] and run() == [(1, 11), (2, 21), (3, 30)]


def test_gated_stream(spark, folder):
    schema = "k BIGINT, v BIGINT"
    spark.createDataFrame([(1, 5), (2, -5), (None, 6)], schema).coalesce(1).write.parquet(folder + "/in")
    datasets = Datasets(spark, folder + "/out")
    stream = lambda: event_feed(spark, folder + "/in", spark.createDataFrame([], schema).schema)
    checks = [{"id": "k", "type": "not_null", "column": "k"}, {"id": "v", "type": "range", "column": "v", "min": 0}]
    gated_stream(stream(), datasets, "good", checks, folder + "/c1", quarantine_name="bad").awaitTermination()
    assert rows_of(datasets.read("good"), "k") == [(1,)] and rows_of(datasets.read("bad").select(F.array_join("failed_checks", ","))) == [("k",), ("v",)]
    gated_stream(stream(), datasets, "all", checks, folder + "/c2").awaitTermination()
    assert datasets.read("all_blocked").count() == 3 and not Path(f"{folder}/out/all").exists()

def test_repeated_batches_and_keys(spark, folder):
    """A key that an earlier batch published fails `unique`; batches that run again change nothing."""
    schema = "k BIGINT, v BIGINT"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder + "/in")
    datasets = Datasets(spark, folder + "/out")
    checks = [{"id": "one", "type": "unique", "column": "k"}, {"id": "v", "type": "range", "column": "v", "min": 0}]

    def run(checkpoint="/ck"):
        stream = event_feed(spark, folder + "/in", spark.createDataFrame([], schema).schema, 1)
        gated_stream(stream, datasets, "good", checks, folder + checkpoint, quarantine_name="bad").awaitTermination()

    put([(1, 1), (2, 2), (7, -7)])
    run()
    put([(2, 3), (3, 3), (8, -8)])
    run()
    assert rows_of(datasets.read("good"), "k", "batch_id") == [(1, 0), (2, 0)]
    assert rows_of(datasets.read("good_blocked"), "k", "batch_id") == [(2, 1), (3, 1)] and rows_of(datasets.read("bad"), "k") == [(7,), (8,)]
    put([(4, 4)])
    run()
    assert rows_of(datasets.read("good"), "k") == [(1,), (2,), (4,)]
    shutil.rmtree(folder + "/ck/commits")  # the engine does not know that its batches ended
    run()
    assert rows_of(datasets.read("good"), "k") == [(1,), (2,), (4,)] and datasets.read("bad").count() == 2 and datasets.read("good_blocked").count() == 2


def test_feeds(spark):
    events = spark.createDataFrame([("r", 1), ("r", 2), ("q", 1)], "run_id STRING, sequence BIGINT")
    assert rows_of(events_after(events, 1, "r")) == [("r", 2)]
    assert rows_of(events_after(events, spark.createDataFrame([("r", 2)], "run_id STRING, last_sequence BIGINT"))) == [("q", 1)]


def test_missing_dates_of_ranges_are_found_in_their_rows(spark):
    """As the dates of the ranges without a run, but no date is shuffled: repeated runs, runs beside the dates, two ranges of one schedule, no schedule."""
    from weir.plans import missing_in_ranges
    from weir.plans.backfill import expand_ranges

    day = lambda n: datetime(2024, 1, n)
    ranges = spark.createDataFrame([("s", day(1), day(9)), ("s", day(2), day(5)), ("s", day(2), day(5)), ("t", day(3), day(3)), (None, day(1), day(4))], "schedule_id STRING, range_start TIMESTAMP_NTZ, range_end TIMESTAMP_NTZ")
    runs = spark.createDataFrame(
        [("s", day(1)), ("s", day(4)), ("s", day(4)), ("s", day(5)), ("s", datetime(2024, 1, 7, 1)), ("s", day(30)), ("t", day(3)), (None, day(1)), ("s", None)], "schedule_id STRING, logical_date TIMESTAMP_NTZ"
    )
    found = missing_in_ranges(ranges, runs, 3 * 86_400)
    assert rows_of(found, "logical_date", "schedule_id") == rows_of(missing_dates(expand_ranges(ranges, 3 * 86_400), runs), "logical_date", "schedule_id")
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert "Generate explode" in lines[0] or "Generate explode" in lines[1]
