"""Run analytics, incidents, evidence, search, definition diffs (A).

There are no run-log tables among the inputs, so `events` stands in for them: a user is a pipeline,
an event is a run, its type is the state and its value the duration.
"""

from pyspark.sql import functions as F

from weir.catalog.registry import query
from weir.runlog import analytics, definitions, evidence, incidents, search

_RUNS = """
    runs AS (SELECT event_id AS id, user_id AS pipeline_id, 'pipeline ' || user_id AS pipeline_name,
                    CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'CANCELLED' WHEN 'click' THEN 'RUNNING' ELSE 'SUCCESS' END AS state,
                    ts AS queued_at, CAST(round(value * 1000) AS BIGINT) AS duration_ms, props AS error FROM events)
"""


def runs_of(t):
    kind = F.col("event_type")
    return t.events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("pipeline_id"), F.concat(F.lit("pipeline "), "user_id").alias("pipeline_name"),
        F.when(kind == "error", "FAILED").when(kind == "signup", "CANCELLED").when(kind == "click", "RUNNING").otherwise("SUCCESS").alias("state"),
        F.col("ts").alias("queued_at"), F.round(F.col("value") * 1000).cast("bigint").alias("duration_ms"), F.col("props").alias("error"),
    )


# One task per run: its node is the last digit of k, it reads k rows if that digit is odd and none otherwise.
_TASKS = """
    tasks AS (SELECT event_id AS id, event_id AS run_id, 'node_' || (CAST(props ->> '$.k' AS BIGINT) % 10) AS node_id,
                     CASE WHEN CAST(props ->> '$.k' AS BIGINT) % 10 < 5 THEN 'csv.source' ELSE 'sql.transform' END AS node_type,
                     CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'BLOCKED' ELSE 'SUCCESS' END AS state,
                     CASE WHEN CAST(props ->> '$.k' AS BIGINT) >= 50 THEN 0 ELSE CAST(props ->> '$.k' AS BIGINT) END AS rows_read, ts AS finished_at, props AS error
              FROM events)
"""


def tasks_of(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.col("event_type")
    return t.events.select(
        F.col("event_id").alias("id"), F.col("event_id").alias("run_id"), F.concat(F.lit("node_"), (k % 10).cast("string")).alias("node_id"),
        F.when(k % 10 < 5, "csv.source").otherwise("sql.transform").alias("node_type"),
        F.when(kind == "error", "FAILED").when(kind == "signup", "BLOCKED").otherwise("SUCCESS").alias("state"),
        F.when(k >= 50, 0).otherwise(k).cast("bigint").alias("rows_read"), F.col("ts").alias("finished_at"), F.col("props").alias("error"),
    )


_WINDOW = "queued_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 12:00:00'"
_SINCE, _UNTIL = "2024-01-05 00:00:00", "2024-01-25 12:00:00"


def _n(condition: str) -> str:
    return f"CAST(count_if({condition}) AS BIGINT)"


@query(
    f"""
    WITH {_RUNS}
    SELECT count(*) AS runs, {_n("state = 'SUCCESS'")} AS succeeded, {_n("state = 'FAILED'")} AS failed, {_n("state = 'CANCELLED'")} AS cancelled,
           {_n("state IN ('RUNNING', 'QUEUED')")} AS running, CAST(round(avg(duration_ms)) AS BIGINT) AS average_duration_ms,
           count_if(state = 'SUCCESS') / count_if(state IN ('SUCCESS', 'FAILED')) AS success_rate
    FROM runs WHERE {_WINDOW}
    """
)
def run_totals(t):
    return analytics.run_totals(runs_of(t), _SINCE, _UNTIL)


@query(
    f"""
    WITH {_RUNS}
    SELECT pipeline_id, {_n("state = 'SUCCESS'")} AS succeeded, {_n("state = 'FAILED'")} AS failed,
           coalesce(count_if(state = 'SUCCESS') / nullif(count_if(state IN ('SUCCESS', 'FAILED')), 0), 0.0) AS success_rate
    FROM runs GROUP BY pipeline_id
    """
)
def run_success_rates(t):
    return analytics.run_totals(runs_of(t), by=["pipeline_id"]).select("pipeline_id", "succeeded", "failed", "success_rate")


@query(f"WITH {_RUNS} SELECT pipeline_id, round(quantile_cont(CAST(duration_ms AS DOUBLE), 0.95), 6) AS p_duration_ms FROM runs GROUP BY pipeline_id")
def run_p95(t):
    return analytics.duration_percentile(runs_of(t), by=["pipeline_id"]).withColumn("p_duration_ms", F.round("p_duration_ms", 6))


@query(f"WITH {_RUNS} SELECT round(quantile_cont(CAST(duration_ms AS DOUBLE), 0.95), 6) AS p_duration_ms FROM runs")
def run_p95_of_all(t):
    return analytics.duration_percentile(runs_of(t)).withColumn("p_duration_ms", F.round("p_duration_ms", 6))


@query(
    f"""
    WITH {_RUNS}
    SELECT strftime(queued_at, '%Y-%m-%d') AS date, {_n("state = 'SUCCESS'")} AS succeeded, {_n("state = 'FAILED'")} AS failed,
           {_n("state = 'CANCELLED'")} AS cancelled, CAST(round(avg(duration_ms)) AS BIGINT) AS average_duration_ms
    FROM runs GROUP BY 1
    """
)
def run_daily_series(t):
    return analytics.daily_series(runs_of(t)).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(
    f"""
    WITH {_RUNS}
    SELECT id, pipeline_id, state, duration_ms FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY queued_at DESC, id DESC) AS r FROM runs) WHERE r = 1
    """
)
def latest_run_per_key(t):
    return analytics.latest_runs(runs_of(t)).select("id", "pipeline_id", "state", "duration_ms")


@query(
    f"""
    WITH {_RUNS}, states AS (SELECT unnest(['PENDING', 'QUEUED', 'RUNNING', 'SUCCESS', 'FAILED', 'CANCELLED']) AS state)
    SELECT s.state, count(r.id) AS runs FROM states s LEFT JOIN runs r ON s.state = r.state GROUP BY s.state
    """
)
def count_by_run_state(t):
    return analytics.runs_by_state(runs_of(t))


@query(
    f"""
    WITH {_RUNS}, {_TASKS}
    SELECT node_id, node_type, count(*) AS failures FROM tasks t JOIN (SELECT id FROM runs WHERE {_WINDOW}) r ON t.run_id = r.id
    WHERE state = 'FAILED' GROUP BY ALL ORDER BY failures DESC, node_id LIMIT 10
    """
)
def top_failing_nodes(t):
    return analytics.top_failing(tasks_of(t), runs_of(t), _SINCE, _UNTIL)


@query("SELECT CAST(count_if(value > 200) AS BIGINT) AS quality_failures FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25 12:00:00'")
def quality_failure_count(t):
    results = t.events.select(F.when(F.col("value") > 200, "FAILED").otherwise("PASSED").alias("status"), F.col("ts").alias("created_at"))
    return analytics.quality_failures(results, _SINCE, _UNTIL)


@query(
    """
    SELECT event_id AS check_id, CAST(user_id AS VARCHAR) AS dataset, CASE WHEN value > 200 THEN 'FAILED' ELSE 'PASSED' END AS status FROM events
    WHERE user_id = 7
    """
)
def quality_results_history(t):
    results = t.events.select(
        F.col("event_id").alias("check_id"), F.col("user_id").cast("string").alias("dataset"),
        F.when(F.col("value") > 200, "FAILED").otherwise("PASSED").alias("status"), F.col("ts").alias("created_at"),
    )
    return analytics.quality_history(results, dataset="7").select("check_id", "dataset", "status")


@query(
    f"""
    WITH {_RUNS}
    SELECT id, pipeline_id, state FROM runs WHERE state IN ('FAILED', 'CANCELLED') AND {_WINDOW} ORDER BY queued_at DESC, id DESC LIMIT 50
    """
)
def find_runs(t):
    page = search.find_runs(runs_of(t), ["FAILED", "CANCELLED"], since=_SINCE, until=_UNTIL)
    return page.rows.select("id", "pipeline_id", "state")


@query(f"WITH {_RUNS} SELECT id, duration_ms FROM runs ORDER BY duration_ms DESC, id LIMIT 30")
def longest_runs(t):
    return search.longest_runs(runs_of(t), 30).select("id", "duration_ms")


@query("SELECT conv_id AS run_id, turn AS attempt, text AS message FROM conversations WHERE role = 'user' AND contains(lower(text), 'the')")
def find_logs(t):
    logs = t.conversations.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("attempt"), F.col("role").alias("level"), F.col("text").alias("message"), F.current_timestamp().alias("ts"))
    return search.find_logs(logs, level="user", text="THE").select("run_id", "attempt", "message")


@query(
    f"""
    WITH {_RUNS}, w AS (SELECT id, pipeline_id, state, queued_at,
           lag(state, 1) OVER p AS s1, lag(state, 2) OVER p AS s2, lag(id, 1) OVER p AS i1, lag(id, 2) OVER p AS i2, lag(queued_at, 2) OVER p AS q2
         FROM runs WINDOW p AS (PARTITION BY pipeline_id ORDER BY queued_at, id))
    SELECT id AS run_id, 'repeated_failure:' || pipeline_id AS fingerprint, 'pipeline ' || pipeline_id || ' failed 3 consecutive times' AS title,
           id || ',' || i1 || ',' || i2 AS run_ids, strftime(q2, '%Y-%m-%d %H:%M:%S') AS first_failure
    FROM w WHERE state = 'FAILED' AND s1 = 'FAILED' AND s2 = 'FAILED'
    """
)
def incident_repeated_failure(t):
    found = incidents.repeated_failure(runs_of(t))
    parsed = F.from_json("evidence", "runIds ARRAY<BIGINT>, firstFailureAt TIMESTAMP_NTZ")
    return found.select(
        F.col("run_id").cast("bigint").alias("run_id"), "fingerprint", "title", F.array_join(parsed["runIds"].cast("array<string>"), ",").alias("run_ids"),
        F.date_format(parsed["firstFailureAt"], "yyyy-MM-dd HH:mm:ss").alias("first_failure"),
    )


@query(
    f"""
    WITH {_RUNS}, w AS (SELECT *, avg(duration_ms) OVER p AS mean, count(duration_ms) OVER p AS n FROM runs WHERE state = 'SUCCESS'
         WINDOW p AS (PARTITION BY pipeline_id ORDER BY queued_at, id ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING))
    SELECT id AS run_id, 'duration_spike:' || pipeline_id AS fingerprint, duration_ms, CAST(round(mean) AS BIGINT) AS mean_ms, n AS samples
    FROM w WHERE duration_ms > 30000 AND n >= 5 AND duration_ms > 2 * mean
    """
)
def incident_duration_spike(t):
    parsed = F.from_json("evidence", "durationMs BIGINT, recentAverageMs BIGINT, sampleSize BIGINT")
    return incidents.duration_spike(runs_of(t)).select(
        F.col("run_id").cast("bigint").alias("run_id"), "fingerprint", parsed["durationMs"].alias("duration_ms"),
        parsed["recentAverageMs"].alias("mean_ms"), parsed["sampleSize"].alias("samples"),
    )


@query(
    f"""
    WITH {_RUNS}, {_TASKS}, reads AS (SELECT t.run_id, r.pipeline_id, t.node_id, t.rows_read, r.queued_at, r.state = 'SUCCESS' AS good
                                  FROM tasks t JOIN runs r ON t.run_id = r.id WHERE t.state = 'SUCCESS'),
         g AS (SELECT *, row_number() OVER (PARTITION BY pipeline_id, node_id ORDER BY queued_at, run_id) AS place FROM reads WHERE good),
         c AS (SELECT r.*, (SELECT count(*) FROM g WHERE g.pipeline_id = r.pipeline_id AND g.node_id = r.node_id AND (g.queued_at, g.run_id) < (r.queued_at, r.run_id)) + 1 AS place
               FROM reads r WHERE r.rows_read = 0)
    SELECT run_id, 'missing_data:' || pipeline_id || ':' || node_id AS fingerprint, node_id || ' read 0 rows in pipeline ' || pipeline_id AS title
    FROM c WHERE EXISTS (SELECT 1 FROM g WHERE g.pipeline_id = c.pipeline_id AND g.node_id = c.node_id AND g.rows_read > 0
                         AND g.place BETWEEN c.place - CASE WHEN c.good THEN 4 ELSE 5 END AND c.place - 1)
    """
)
def incident_missing_data(t):
    return incidents.missing_data(tasks_of(t), runs_of(t)).select(F.col("run_id").cast("bigint").alias("run_id"), "fingerprint", "title")


@query(
    """
    SELECT event_id AS run_id, 'quality_failure:' || user_id || ':' || coalesce(dataset, '(unnamed dataset)') AS fingerprint,
           CASE WHEN value > 250 THEN 'high' ELSE 'low' END AS severity, '1 checks failed on dataset ' || coalesce(dataset, '(unnamed dataset)') AS title
    FROM (SELECT *, nullif(event_type, 'view') AS dataset FROM events) WHERE value > 200
    """
)
def incident_quality_failure(t):
    results = t.events.select(
        F.col("user_id").alias("pipeline_id"), F.col("event_id").alias("run_id"), F.nullif("event_type", F.lit("view")).alias("dataset"),
        F.lit("value_range").alias("check_id"), F.lit("value").alias("column"), F.lit("<= 200").alias("expected"), F.col("value").cast("string").alias("actual"),
        F.lit(1).alias("failed_rows"), F.lit(1).alias("total_rows"), F.when(F.col("value") > 200, "FAILED").otherwise("PASSED").alias("status"),
        F.when(F.col("value") > 250, "error").otherwise("warn").alias("severity"), F.col("ts").alias("created_at"),
    )
    return incidents.quality_failure(results).select(F.col("run_id").cast("bigint").alias("run_id"), "fingerprint", "severity", "title")


@query(
    """
    SELECT event_id AS run_id, CASE event_type WHEN 'error' THEN 'high' ELSE 'medium' END AS severity,
           'schema_change:' || user_id || ':' || coalesce(nullif(props, '{"k": 1}'), 'check') AS fingerprint
    FROM events WHERE event_type IN ('error', 'click')
    """
)
def incident_schema_drift(t):
    kind = F.col("event_type")
    validations = t.events.select(
        F.col("user_id").alias("pipeline_id"), F.col("event_id").alias("run_id"), F.lit("check").alias("node_id"),
        F.nullif("props", F.lit('{"k": 1}')).alias("dataset"), F.lit(1).alias("changes"), F.col("ts").alias("seen_at"),
        F.when(kind == "error", "BREAKING").when(kind == "click", "WARNING").otherwise("COMPATIBLE").alias("classification"),
    )
    return incidents.schema_drift(validations).select(F.col("run_id").cast("bigint").alias("run_id"), "severity", "fingerprint")


@query(
    f"""
    WITH {_RUNS}, d AS (SELECT user_id || '-' || event_type AS name, max(ts) AS last_updated_at, max_by(event_id, ts) AS last_run_id FROM events GROUP BY user_id, event_type),
         s AS (SELECT DISTINCT pipeline_id, CASE WHEN pipeline_id % 2 = 0 THEN 21600 END AS every FROM runs WHERE pipeline_id % 5 <> 0)
    SELECT d.name, CAST(round(epoch(TIMESTAMP '2024-01-31 00:00:00' - d.last_updated_at)) AS BIGINT) AS age, 'stale_dataset:' || d.name AS fingerprint
    FROM d JOIN runs r ON d.last_run_id = r.id JOIN s ON s.pipeline_id = r.pipeline_id
    WHERE epoch(TIMESTAMP '2024-01-31 00:00:00' - d.last_updated_at) > coalesce(s.every, 86400) * 2.0
    """
)
def incident_stale_dataset(t):
    runs = runs_of(t)
    datasets = t.events.groupBy(F.concat("user_id", F.lit("-"), "event_type").alias("name")).agg(
        F.max("ts").alias("last_updated_at"), F.max_by("event_id", "ts").alias("last_run_id")
    )
    pipeline = F.col("pipeline_id")
    schedules = runs.select("pipeline_id").distinct().select(
        pipeline.alias("id"), pipeline, F.when(pipeline % 2 == 0, 21600).alias("interval_seconds"), (pipeline % 5 != 0).alias("enabled")
    )
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    found = incidents.stale_datasets(datasets, runs, schedules, now)
    return found.select(F.col("dataset").alias("name"), F.get_json_object("evidence", "$.ageSeconds").cast("bigint").alias("age"), "fingerprint")


@query(
    f"""
    WITH {_RUNS}, f AS (SELECT 'failure:' || pipeline_id AS fingerprint, id, queued_at FROM runs WHERE state = 'FAILED'),
         n AS (SELECT fingerprint, count(*) AS c, min(queued_at) AS a, max(queued_at) AS b, max_by(id, queued_at) AS run_id FROM f GROUP BY 1),
         o AS (SELECT 'failure:' || pipeline_id AS fingerprint, CASE pipeline_id % 3 WHEN 0 THEN 'acknowledged' WHEN 1 THEN 'open' ELSE 'resolved' END AS status,
                      5 AS occurrences, TIMESTAMP '2023-12-01 00:00:00' AS first_seen FROM (SELECT DISTINCT pipeline_id FROM runs)),
         merged AS (SELECT n.fingerprint, CASE WHEN o.status = 'acknowledged' THEN 'acknowledged' ELSE 'open' END AS status, coalesce(o.occurrences, 0) + n.c AS occurrences,
                           coalesce(o.first_seen, n.a) AS first_seen, CAST(n.run_id AS VARCHAR) AS run_id
                    FROM n LEFT JOIN o ON n.fingerprint = o.fingerprint AND o.status <> 'resolved'
                    UNION ALL SELECT fingerprint, status, occurrences, first_seen, NULL FROM o WHERE status = 'resolved' OR fingerprint NOT IN (SELECT fingerprint FROM n))
    SELECT fingerprint, status, occurrences, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, run_id FROM merged
    """
)
def incident_roll_up(t):
    runs = runs_of(t)
    fingerprint = F.concat(F.lit("failure:"), "pipeline_id").alias("fingerprint")
    none = F.lit(None).cast("string")
    findings = runs.where("state = 'FAILED'").select(
        fingerprint, F.lit("repeated_failure").alias("kind"), F.lit("high").alias("severity"), F.col("pipeline_name").alias("title"), "pipeline_id",
        F.col("id").cast("string").alias("run_id"), none.alias("dataset"), F.col("error").alias("evidence"), F.col("queued_at").alias("seen_at"),
    )
    rest = F.col("pipeline_id") % 3
    known = runs.select("pipeline_id", "pipeline_name").distinct().select(
        fingerprint, F.lit("repeated_failure").alias("kind"), F.lit("high").alias("severity"), F.col("pipeline_name").alias("title"), "pipeline_id",
        none.alias("run_id"), none.alias("dataset"), none.alias("evidence"),
        F.when(rest == 0, "acknowledged").when(rest == 1, "open").otherwise("resolved").alias("status"), F.lit(5).cast("bigint").alias("occurrences"),
        F.lit("2023-12-01 00:00:00").cast("timestamp_ntz").alias("first_seen_at"), F.lit("2023-12-01 00:00:00").cast("timestamp_ntz").alias("last_seen_at"),
    )
    rolled = incidents.roll_up(findings, known)
    return rolled.select("fingerprint", "status", "occurrences", F.date_format("first_seen_at", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), "run_id")


@query(
    f"""
    WITH {_RUNS}, {_TASKS}, failed AS (SELECT id AS run_id, pipeline_id FROM runs WHERE state = 'FAILED'),
         logs AS (SELECT event_id AS task_id, count(*) AS lines FROM (SELECT event_id FROM events UNION ALL SELECT event_id FROM events WHERE value > 50) GROUP BY 1),
         good AS (SELECT pipeline_id, max_by(id, queued_at) AS last_success FROM runs WHERE state = 'SUCCESS' GROUP BY 1),
         rec AS (SELECT r.pipeline_id, t.node_id, count(*) AS n FROM runs r JOIN tasks t ON t.run_id = r.id WHERE t.state = 'FAILED' GROUP BY ALL)
    SELECT f.run_id, f.pipeline_id, t.node_id, CAST(2 AS BIGINT) AS attempts, CAST(l.lines AS INTEGER) AS log_lines, l.lines AS log_lines_total, g.last_success AS last_success_run_id,
           coalesce(rec.n, 0) AS recent_failures, CASE WHEN e.value > 200 THEN 'value_range' ELSE '' END AS failed_checks
    FROM failed f JOIN tasks t ON t.run_id = f.run_id JOIN logs l ON l.task_id = f.run_id JOIN events e ON e.event_id = f.run_id
    LEFT JOIN good g ON g.pipeline_id = f.pipeline_id LEFT JOIN rec ON rec.pipeline_id = f.pipeline_id AND rec.node_id = t.node_id
    """
)
def failure_evidence(t):
    e = t.events
    attempts = e.select(
        F.col("event_id").alias("task_run_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"), F.lit("FAILED").alias("state"), F.col("props").alias("error")
    )
    error = e.where("value > 50").select(F.concat("event_id", F.lit("-e")).alias("id"), F.col("event_id").alias("task_run_id"), "ts", F.lit("error").alias("level"), F.col("props").alias("message"))
    info = e.select(F.concat("event_id", F.lit("-i")).alias("id"), F.col("event_id").alias("task_run_id"), "ts", F.lit("info").alias("level"), F.col("event_type").alias("message"))
    results = e.select(F.col("event_id").alias("run_id"), F.lit("value_range").alias("check_id"), F.when(F.col("value") > 200, "FAILED").otherwise("PASSED").alias("status"))
    found = evidence.failure_evidence(runs_of(t), tasks_of(t), attempts, error.unionByName(info), results)
    return found.select(
        "run_id", "pipeline_id", "node_id", "attempts", F.size("logs").alias("log_lines"), "log_lines_total", "last_success_run_id", "recent_failures",
        F.coalesce(F.array_join("failed_checks", ","), F.lit("")).alias("failed_checks"),
    )


@query(
    """
    WITH e AS (SELECT 'part' AS kind, CAST(p_partkey AS VARCHAR) AS id, p_name AS title, lower(p_name) AS a, lower(p_type) AS b FROM part
               UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), n_name, lower(n_name), '' FROM nation
               UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), c_name, lower(c_name), lower(c_mktsegment) FROM customer
               UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name, lower(s_name), '' FROM supplier
               UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), r_name, lower(r_name), '' FROM region),
         s AS (SELECT kind, id, title, greatest(CASE WHEN a = 'small' THEN 3 WHEN starts_with(a, 'small') THEN 2 WHEN contains(a, 'small') THEN 1 ELSE 0 END,
                                                CASE WHEN b = 'small' THEN 3 WHEN starts_with(b, 'small') THEN 2 WHEN contains(b, 'small') THEN 1 ELSE 0 END) AS score FROM e)
    SELECT * FROM s WHERE score > 0
    """
)
def catalog_search(t):
    return search.search_catalog(
        {
            "part": (t.part, "p_partkey", "p_name", ["p_name", "p_type"]),
            "nation": (t.nation, "n_nationkey", "n_name", ["n_name"]),
            "customer": (t.customer, "c_custkey", "c_name", ["c_name", "c_mktsegment"]),
            "supplier": (t.supplier, "s_suppkey", "s_name", ["s_name"]),
            "region": (t.region, "r_regionkey", "r_name", ["r_name"]),
        },
        " Small ",
    )


def definitions_of(t, later: bool):
    """A definition per order, as JSON text; the later one has edits that depend on the order."""
    finished = F.col("o_orderstatus") == "F"
    price = (F.col("o_totalprice") + F.when(finished, 1).otherwise(0)) if later else F.col("o_totalprice")
    config = F.struct(
        F.struct(price.alias("price"), F.array("o_orderpriority", F.when(finished & F.lit(later), "new")).alias("tags")).alias("inner"),
        F.col("o_custkey").alias("customer"),
    )
    nodes = [F.struct(F.lit("a").alias("id"), F.lit("csv.source").alias("type"), config.alias("config"))]
    plain = F.struct(
        F.struct(F.lit(None).cast("double").alias("price"), F.lit(None).cast("array<string>").alias("tags")).alias("inner"), F.lit(0).cast("bigint").alias("customer")
    )
    last = F.when((F.col("o_orderstatus") == "O") & F.lit(later), "c").otherwise("b")
    nodes.append(F.struct(last.alias("id"), F.lit("sql.transform").alias("type"), plain.alias("config")))
    edges = F.array(F.struct(F.lit("a").alias("from"), last.alias("to")))
    return t.orders.select(F.col("o_orderkey").alias("pipeline_id"), F.to_json(F.struct(F.array(*nodes).alias("nodes"), edges.alias("edges"))).alias("definition"))


@query(
    """
    SELECT o_orderkey AS pipeline_id, 'a' AS node_id, 'inner.price' AS path FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT o_orderkey, 'a', 'inner.tags[1]' FROM orders WHERE o_orderstatus = 'F'
    """
)
def definition_setting_diff(t):
    return definitions.diff_settings(definitions_of(t, False), definitions_of(t, True)).select("pipeline_id", "node_id", "path")


@query(
    """
    SELECT o_orderkey AS pipeline_id, 'node' AS item, 'b' AS name, 'removed' AS change FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT o_orderkey, 'node', 'c', 'added' FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT o_orderkey, 'edge', 'a->b', 'removed' FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT o_orderkey, 'edge', 'a->c', 'added' FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT o_orderkey, 'equal', '', CASE WHEN o_orderstatus = 'P' THEN 'same' ELSE 'different' END FROM orders
    """
)
def definition_structure_diff(t):
    def entry(item, name, change):
        return F.struct(F.lit(item).alias("item"), name.alias("name"), change.alias("change"))

    found = definitions.compare(definitions_of(t, False), definitions_of(t, True))
    nodes = F.transform("nodes", lambda n: entry("node", n["node_id"], n["change"]))
    edges = F.transform("edges", lambda e: entry("edge", F.concat(e["from"], F.lit("->"), e["to"]), e["change"]))
    equal = F.array(entry("equal", F.lit(""), F.when(F.col("equal"), F.lit("same")).otherwise(F.lit("different"))))
    return found.select("pipeline_id", F.inline(F.concat(nodes, edges, equal)))


@query(
    f"""
    WITH {_RUNS}, p AS (SELECT DISTINCT pipeline_id FROM runs)
    SELECT 'pipelines_total' AS name, count(*) AS value FROM p
    UNION ALL SELECT 'pipelines_active', count(DISTINCT pipeline_id) FROM runs WHERE queued_at >= TIMESTAMP '2024-01-28 00:00:00'
    UNION ALL SELECT 'pipelines_scheduled', CAST(count_if(pipeline_id % 5 <> 0) AS BIGINT) FROM p
    UNION ALL SELECT 'runs_total', count(*) FROM runs
    UNION ALL SELECT 'incidents_open', CAST(count_if(state = 'FAILED') AS BIGINT) FROM runs
    """
)
def dashboard_counts(t):
    runs = runs_of(t)
    pipelines = runs.select(F.col("pipeline_id").alias("id")).distinct()
    schedules = pipelines.select(F.col("id").alias("pipeline_id"), (F.col("id") % 5 != 0).alias("enabled"))
    open_incidents = runs.select(F.when(F.col("state") == "FAILED", "open").otherwise("resolved").alias("status"))
    return analytics.dashboard(pipelines, runs, schedules, open_incidents, "2024-01-28 00:00:00")
