"""Pipelines, Python, backfills and streams (N, B, T)."""

from datetime import datetime

from pyspark.sql import functions as F

from weir.catalog.registry import query
from weir.plans import map_rows, run_flow
from weir.plans.backfill import backfill_progress, expand_ranges, missing_in_ranges, run_backfill, unique_runs
from weir.session import scratch_path
from weir.sources import Datasets
from weir.streaming import events_after, gated_stream, upsert_stream

DEMO = {
    "name": "supplier-load",
    "version": 1,
    "nodes": [
        {"id": "lines", "type": "inline.source", "config": {"dataset": "lineitem"}},
        {"id": "shipped", "type": "filter.transform", "config": {"predicates": [{"column": "l_quantity", "op": "gt", "value": 0}], "onEmpty": "fail"}},
        {
            "id": "load",
            "type": "sql.transform",
            "config": {
                "dataset": "supplier_load",
                "query": "SELECT l_suppkey AS supplier, COUNT(DISTINCT l_orderkey) AS orders_served, MAX(l_quantity) AS largest, "
                "CAST(SUM(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS discounts FROM input GROUP BY l_suppkey",
            },
        },
        {
            "id": "audit",
            "type": "quality.check",
            "config": {
                "dataset": "supplier_load",
                "checks": [
                    {"id": "one_row_each", "type": "unique", "column": "supplier"},
                    {"id": "discounts_add_up", "type": "range", "column": "discounts", "min": 0},
                    {"id": "served_someone", "type": "custom_sql", "sql": "SELECT supplier FROM input WHERE orders_served < 1"},
                    {"id": "largest_known", "type": "not_null", "column": "largest"},
                ],
            },
        },
        {"id": "let_through", "type": "quality.gate", "config": {"severity": "error_only", "scope": "upstream"}},
        {"id": "store", "type": "dataset.destination", "config": {"dataset": "supplier_load", "writeMode": "replace"}},
    ],
    "edges": [
        {"from": "lines", "to": "shipped"}, {"from": "shipped", "to": "load"}, {"from": "load", "to": "audit"}, {"from": "audit", "to": "let_through"},
        {"from": "let_through", "to": "store"},
    ],
}


@query(
    """
    SELECT l_suppkey AS supplier, COUNT(DISTINCT l_orderkey) AS orders_served, MAX(l_quantity) AS largest,
           CAST(SUM(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS discounts
    FROM lineitem WHERE l_quantity > 0 GROUP BY l_suppkey
    """
)
def demo_flow(t):
    datasets = Datasets(t.spark, scratch_path(t.spark, "datasets"))
    run_flow(t.spark, DEMO, inputs={"lines": t.lineitem}, datasets=datasets)
    return datasets.read("supplier_load")


_COUNTED = {
    "name": "counted",
    "nodes": [
        {"id": "orders", "type": "inline.source"}, {"id": "many", "type": "condition.branch", "config": {"expression": "row_count_gt", "value": 10}},
        {"id": "dear", "type": "filter.transform", "config": {"predicates": [{"column": "o_totalprice", "op": "gte", "value": 100000}], "onEmpty": "fail"}},
        {"id": "per_status", "type": "aggregate.transform", "config": {"measures": [{"fn": "count", "as": "n"}], "groupBy": ["o_orderstatus"]}},
        {"id": "store", "type": "dataset.destination", "config": {"dataset": "per_status"}},
    ],
    "edges": [
        {"from": "orders", "to": "many"}, {"from": "many", "to": "dear", "port": "true"}, {"from": "dear", "to": "per_status"}, {"from": "per_status", "to": "store"},
    ],
}


@query(
    """
    WITH c AS (SELECT count(*) AS n, CAST(count_if(o_totalprice >= 100000) AS BIGINT) AS dear,
                      count(DISTINCT CASE WHEN o_totalprice >= 100000 THEN o_orderstatus END) AS g FROM orders)
    SELECT 'orders' AS node, CAST(0 AS BIGINT) AS rows_in, n AS rows_out, CAST(NULL AS BIGINT) AS rows_removed, CAST(NULL AS BIGINT) AS groups FROM c
    UNION ALL SELECT 'many', n, n, NULL, NULL FROM c UNION ALL SELECT 'dear', n, dear, n - dear, NULL FROM c
    UNION ALL SELECT 'per_status', dear, g, NULL, g FROM c UNION ALL SELECT 'store', g, g, NULL, NULL FROM c
    """
)
def flow_row_metrics(t):
    """Rows in, out and removed of every node, after a branch and a filter that looked at the data first."""
    result = run_flow(t.spark, _COUNTED, inputs={"orders": t.orders}, datasets=Datasets(t.spark, scratch_path(t.spark, "datasets")))
    rows = [(node, m["rows_in"], m["rows_out"], m.get("rows_removed"), m.get("groups")) for node, m in ((n, result.metrics(n)) for n in result.states)]
    return t.spark.createDataFrame(rows, "node STRING, rows_in BIGINT, rows_out BIGINT, rows_removed BIGINT, groups BIGINT")


_BRANCH = {
    "name": "branching",
    "nodes": [
        {"id": "orders", "type": "inline.source"}, {"id": "customers", "type": "inline.source"},
        {"id": "many", "type": "condition.branch", "config": {"expression": "row_count_gt", "value": 100}},
        {"id": "joined", "type": "join.transform", "config": {"left": "many", "right": "customers", "on": [{"left": "o_custkey", "right": "c_custkey"}], "type": "left"}},
        {"id": "per_segment", "type": "aggregate.transform", "config": {"groupBy": ["c_mktsegment"], "measures": [{"fn": "count", "as": "n"}, {"fn": "max", "column": "o_totalprice"}]}},
        {"id": "few", "type": "aggregate.transform", "config": {"measures": [{"fn": "count", "as": "n"}]}},
    ],
    "edges": [
        {"from": "orders", "to": "many"}, {"from": "many", "to": "joined", "port": "true"}, {"from": "customers", "to": "joined"}, {"from": "joined", "to": "per_segment"},
        {"from": "many", "to": "few", "port": "false"},
    ],
}


@query(
    """
    SELECT c_mktsegment, count(*) AS n, max(o_totalprice) AS max_o_totalprice, 'SKIPPED' AS other_branch
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
    """
)
def branch_row_count(t):
    result = run_flow(t.spark, _BRANCH, inputs={"orders": t.orders, "customers": t.customer})
    return result.outputs["per_segment"].withColumn("other_branch", F.lit(result.states["few"]))


@query("SELECT o_orderkey, upper(o_orderstatus) || '-' || len(o_orderpriority) AS tag FROM orders WHERE o_totalprice > 1000")
def python_map(t):
    def transform(rows):
        return [
            {"o_orderkey": r["o_orderkey"], "tag": f"{r['o_orderstatus'].upper()}-{len(r['o_orderpriority'])}"} for r in rows if r["o_totalprice"] > 1000
        ]

    columns = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return map_rows(columns, transform, "o_orderkey BIGINT, tag STRING")


@query(
    """
    WITH b AS (SELECT o_custkey AS schedule_id, CAST(date_trunc('month', min(o_orderdate)) AS TIMESTAMP) AS a, max(o_orderdate) AS z FROM orders GROUP BY 1)
    SELECT schedule_id, strftime(unnest(generate_series(a, z, INTERVAL 30 DAY)), '%Y-%m-%d') AS logical_date FROM b
    """
)
def backfill_expand(t):
    ranges = t.orders.groupBy(F.col("o_custkey").alias("schedule_id")).agg(
        F.date_trunc("month", F.min("o_orderdate")).cast("timestamp_ntz").alias("range_start"), F.max("o_orderdate").alias("range_end")
    )
    return expand_ranges(ranges, 30 * 86_400).withColumn("logical_date", F.date_format("logical_date", "yyyy-MM-dd"))


_PLAN = """
    b AS (SELECT o_custkey AS schedule_id, min(o_orderdate) AS a, max(o_orderdate) AS z FROM orders GROUP BY 1),
    planned AS (SELECT schedule_id, unnest(generate_series(a, z, INTERVAL 7 DAY)) AS logical_date FROM b)
"""


def _ranges(t):
    return t.orders.groupBy(F.col("o_custkey").alias("schedule_id")).agg(F.min("o_orderdate").alias("range_start"), F.max("o_orderdate").alias("range_end"))


def _planned(t):
    return expand_ranges(_ranges(t), 7 * 86_400)


def _order_runs(t):
    state = F.col("o_orderstatus")
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("schedule_id"), F.col("o_custkey").alias("backfill_id"), F.col("o_orderdate").alias("logical_date"),
        F.col("o_orderdate").alias("queued_at"), F.when(state == "F", "SUCCESS").when(state == "O", "FAILED").otherwise("RUNNING").alias("state"),
    )


@query(
    f"""
    WITH {_PLAN} SELECT p.schedule_id, count(*) AS missing, strftime(min(p.logical_date), '%Y-%m-%d') AS first_missing
    FROM planned p LEFT JOIN orders o ON o.o_custkey = p.schedule_id AND o.o_orderdate = p.logical_date WHERE o.o_orderkey IS NULL GROUP BY 1
    """
)
def backfill_missing(t):
    missing = missing_in_ranges(_ranges(t), _order_runs(t), 7 * 86_400)
    return missing.groupBy("schedule_id").agg(F.count(F.lit(1)).alias("missing"), F.date_format(F.min("logical_date"), "yyyy-MM-dd").alias("first_missing"))


@query(
    f"""
    WITH {_PLAN}, n AS (SELECT schedule_id, count(*) AS total FROM planned GROUP BY 1),
         r AS (SELECT o_custkey, count_if(o_orderstatus = 'F') AS c, count_if(o_orderstatus = 'O') AS f, count_if(o_orderstatus = 'P') AS g, count(DISTINCT o_orderdate) AS s FROM orders GROUP BY 1)
    SELECT schedule_id AS backfill_id, total, CAST(c AS BIGINT) AS completed, CAST(f AS BIGINT) AS failed, CAST(g AS BIGINT) AS running, total - s AS remaining,
           CAST(round((c + f) / total * 100) AS INTEGER) AS percent_complete
    FROM n JOIN r ON n.schedule_id = r.o_custkey
    """
)
def backfill_status(t):
    return backfill_progress(_planned(t).withColumnRenamed("schedule_id", "backfill_id"), _order_runs(t))


@query("SELECT min(o_orderkey) AS id, o_custkey AS schedule_id, strftime(o_orderdate, '%Y-%m-%d') AS logical_date FROM orders GROUP BY o_custkey, o_orderdate")
def backfill_unique_runs(t):
    return unique_runs(_order_runs(t)).select("id", "schedule_id", F.date_format("logical_date", "yyyy-MM-dd").alias("logical_date"))


@query(
    """
    WITH e AS (SELECT *, CAST(ts AS DATE) AS d FROM events)
    SELECT strftime(d, '%Y-%m-%d') AS run_date, event_type, count(*) * CASE WHEN d BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' THEN 100 ELSE 1 END AS n
    FROM e GROUP BY d, event_type
    """
)
def backfill_run(t):
    """All days are built, then three of them are built again by another rule; the others stay."""
    path = scratch_path(t.spark, "backfill")

    def counts(factor):
        return lambda rows: rows.groupBy("run_date", "event_type").agg((F.count(F.lit(1)) * factor).alias("n"))

    run_backfill(t.events, "ts", datetime(2024, 1, 1), datetime(2024, 2, 1), counts(1), path)
    run_backfill(t.events, "ts", datetime(2024, 1, 10), datetime(2024, 1, 12), counts(100), path)
    return t.spark.read.parquet(path).select(F.date_format("run_date", "yyyy-MM-dd").alias("run_date"), "event_type", "n")


@query(
    """
    WITH seen AS (SELECT user_id, (min(event_id) + max(event_id)) // 2 AS last FROM events WHERE user_id % 4 <> 0 GROUP BY 1)
    SELECT e.event_id FROM events e LEFT JOIN seen ON e.user_id = seen.user_id WHERE e.event_id > coalesce(seen.last, 0)
    """
)
def event_feed_resume(t):
    events = t.events.select("event_id", F.col("user_id").alias("run_id"), F.col("event_id").alias("sequence"))
    seen = events.where(F.col("run_id") % 4 != 0).groupBy("run_id").agg(F.floor((F.min("sequence") + F.max("sequence")) / 2).alias("last_sequence"))
    return events_after(events, seen).select("event_id")


def _event_stream(t):
    return t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)


@query(
    """
    SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1
    """
)
def stream_incremental(t):
    root = scratch_path(t.spark, "stream")
    datasets = Datasets(t.spark, root)
    stream = _event_stream(t).select("user_id", "event_type", "event_id", "value", "ts")
    started = upsert_stream(stream, datasets, "latest_events", ["user_id", "event_type"], f"{root}/_checkpoint", [("ts", "desc"), ("event_id", "desc")])
    started.awaitTermination()
    return datasets.read("latest_events").select("user_id", "event_type", "event_id", "value")


@query("SELECT event_id, CASE WHEN value <= 300 AND event_type <> 'error' THEN 'good' ELSE 'bad' END AS side FROM events")
def stream_gate(t):
    root = scratch_path(t.spark, "stream")
    datasets = Datasets(t.spark, root)
    checks = [
        {"id": "small", "type": "range", "column": "value", "max": 300}, {"id": "kind", "type": "accepted_values", "column": "event_type", "values": ["click", "view", "signup", "purchase"]},
        {"id": "some", "type": "row_count", "min": 1},
    ]
    started = gated_stream(_event_stream(t), datasets, "events_good", checks, f"{root}/_checkpoint", quarantine_name="events_bad")
    started.awaitTermination()
    good = datasets.read("events_good").select("event_id", F.lit("good").alias("side"))
    return good.unionByName(datasets.read("events_bad").select("event_id", F.lit("bad").alias("side")))


@query("SELECT c_custkey AS k, 'published' AS side FROM customer UNION ALL SELECT s_suppkey, 'blocked' FROM supplier")
def stream_unique(t):
    """Customer keys pass; a later batch with supplier keys, which are customer keys too, does not."""
    root = scratch_path(t.spark, "stream")
    datasets = Datasets(t.spark, root)
    for keys in (t.customer.select(F.col("c_custkey").alias("k")), t.supplier.select(F.col("s_suppkey").alias("k"))):
        keys.write.mode("append").parquet(f"{root}/in")
        stream = t.spark.readStream.schema(keys.schema).parquet(f"{root}/in")
        gated_stream(stream, datasets, "keys", [{"id": "once", "type": "unique", "column": "k"}], f"{root}/_checkpoint").awaitTermination()
    published = datasets.read("keys").select("k", F.lit("published").alias("side"))
    return published.unionByName(datasets.read("keys_blocked").select("k", F.lit("blocked").alias("side")))
