"""Data quality (Q)."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from weir.catalog.registry import query
from weir.quality import check_expectations, gate_table, quarantine, results_in_scope, run_checks, split_rows, summarize

_NOW = datetime(2024, 2, 1, tzinfo=timezone.utc)

_FUSED = [
    {"id": "q_not_null", "type": "not_null", "column": "l_returnflag"},
    {"id": "q_range", "type": "range", "column": "l_quantity", "min": 2, "max": 49, "threshold": 0.9},
    {"id": "q_regex", "type": "regex", "column": "l_linestatus", "pattern": "^o$", "caseInsensitive": True, "severity": "warn"},
    {"id": "q_values", "type": "accepted_values", "column": "l_returnflag", "values": ["A", "N"], "threshold": 0.5},
    {"id": "q_rows", "type": "row_count", "minRows": 1, "maxRows": 1000},
]


@query(
    """
    WITH m AS (SELECT count(*) AS n, count_if(l_quantity NOT BETWEEN 2 AND 49) AS r, count_if(l_linestatus <> 'O') AS x,
                      count_if(l_returnflag NOT IN ('A', 'N')) AS v FROM lineitem),
         p AS (SELECT 'q_not_null' AS check_id, 0 AS failed, 1.0 AS threshold FROM m UNION ALL SELECT 'q_range', r, 0.9 FROM m
               UNION ALL SELECT 'q_regex', x, 1.0 FROM m UNION ALL SELECT 'q_values', v, 0.5 FROM m
               UNION ALL SELECT 'q_rows', CASE WHEN n <= 1000 THEN 0 ELSE n END, 1.0 FROM m)
    SELECT check_id, CASE WHEN (n - failed) / n >= threshold THEN 'PASSED' ELSE 'FAILED' END AS status, CAST(n - failed AS BIGINT) AS passed_rows,
           CAST(failed AS BIGINT) AS failed_rows, n AS total_rows, (n - failed) / n AS pass_rate
    FROM p, m
    """
)
def quality_fused_lineitem(t):
    results = run_checks(t.lineitem, _FUSED, _NOW, samples=False)
    return results.select("check_id", "status", "passed_rows", "failed_rows", "total_rows", "pass_rate")


@query(
    """
    WITH k AS (SELECT l_orderkey || '-' || l_linenumber AS key, count(*) AS n FROM lineitem GROUP BY 1),
         f AS (SELECT coalesce(sum(n) FILTER (n > 1), 0) AS failed, sum(n) AS total, count(*) AS groups FROM k)
    SELECT 'key_unique' AS check_id, 'FAILED' AS status, CAST(failed AS BIGINT) AS failed_rows, CAST(total AS BIGINT) AS total_rows,
           CAST(failed AS BIGINT) || ' rows have a value that others have' AS message,
           (SELECT string_agg(key, ',' ORDER BY key) FROM (SELECT key FROM k WHERE n > 1 ORDER BY key LIMIT 5)) AS samples
    FROM f
    """
)
def quality_unique_lineitem(t):
    keyed = t.lineitem.select(F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("key"))
    results = run_checks(keyed, [{"id": "key_unique", "type": "unique", "column": "key"}], _NOW)
    return results.select("check_id", "status", "failed_rows", "total_rows", "message", F.array_join("failed_samples", ",").alias("samples"))


@query(
    """
    WITH v AS (SELECT count(*) AS bad FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 15)), n AS (SELECT count(*) AS n FROM orders)
    SELECT 'few_orders' AS check_id, CASE WHEN (n - bad) / n >= 0.99 THEN 'PASSED' ELSE 'FAILED' END AS status, CAST(n - bad AS BIGINT) AS passed_rows,
           bad AS failed_rows, n AS total_rows, bad || ' rows against the rule' AS actual FROM v, n
    UNION ALL SELECT 'broken', 'ERRORED', 0, 0, n, 'error' FROM n
    """
)
def quality_custom_sql(t):
    checks = [
        {"id": "few_orders", "type": "custom_sql", "sql": "SELECT o_custkey FROM input GROUP BY o_custkey HAVING count(*) > 15", "threshold": 0.99},
        {"id": "broken", "type": "not_null", "column": "no_such_column"},
    ]
    results = run_checks(t.orders, checks, _NOW, samples=False)
    return results.select("check_id", "status", "passed_rows", "failed_rows", "total_rows", "actual")


@query(
    """
    WITH m AS (SELECT max(ts) AS newest, count(*) AS n FROM events)
    SELECT check_id, CASE WHEN ok THEN 'PASSED' ELSE 'FAILED' END AS status, CAST(CASE WHEN ok THEN n ELSE 0 END AS BIGINT) AS passed_rows,
           CAST(round(epoch(TIMESTAMP '2024-02-01 00:00:00' - newest)) AS BIGINT) || 's old' AS actual
    FROM (SELECT 'fresh_week' AS check_id, newest >= TIMESTAMP '2024-02-01' - INTERVAL 7 DAY AS ok, n, newest FROM m
          UNION ALL SELECT 'fresh_hour', newest >= TIMESTAMP '2024-02-01' - INTERVAL 1 HOUR, n, newest FROM m)
    """
)
def quality_freshness(t):
    checks = [
        {"id": "fresh_week", "type": "freshness", "column": "ts", "maxAgeSeconds": 7 * 86400},
        {"id": "fresh_hour", "type": "freshness", "column": "ts", "maxAgeSeconds": 3600},
    ]
    return run_checks(t.events, checks, _NOW, samples=False).select("check_id", "status", "passed_rows", "actual")


@query(
    """
    SELECT 'price_range' AS check_id, (SELECT string_agg(v, ';' ORDER BY v) FROM (SELECT CAST(o_totalprice AS VARCHAR) AS v FROM orders
             WHERE o_totalprice NOT BETWEEN 1000 AND 400000 ORDER BY v LIMIT 5)) AS samples
    UNION ALL SELECT 'status_values', (SELECT string_agg(v, ';' ORDER BY v) FROM (SELECT o_orderstatus AS v FROM orders WHERE o_orderstatus <> 'F' ORDER BY v LIMIT 5))
    """
)
def quality_samples(t):
    checks = [
        {"id": "price_range", "type": "range", "column": "o_totalprice", "min": 1000, "max": 400000},
        {"id": "status_values", "type": "accepted_values", "column": "o_orderstatus", "values": ["F"]},
    ]
    return run_checks(t.orders, checks, _NOW).select("check_id", F.array_join("failed_samples", ";").alias("samples"))


# One recorded result per user and event type: the check passes if no value is above 200.
_RESULTS = """
    WITH r AS (SELECT user_id, event_type AS check_id, CASE WHEN max(value) > 200 THEN 'FAILED' ELSE 'PASSED' END AS status,
                      CASE WHEN event_type IN ('error', 'purchase') THEN 'error' ELSE 'warn' END AS severity,
                      count_if(value <= 200) / count(*) AS pass_rate FROM events GROUP BY ALL)
"""


def recorded_results(t):
    """Recorded results derived from events: a run per user, a check per event type."""
    kind = F.col("event_type")
    return t.events.groupBy("user_id", kind.alias("check_id")).agg(
        F.when(F.max("value") > 200, "FAILED").otherwise("PASSED").alias("status"),
        F.when(kind.isin("error", "purchase"), "error").otherwise("warn").alias("severity"),
        (F.count_if(F.col("value") <= 200) / F.count(F.lit(1))).alias("pass_rate"),
    )


@query(
    _RESULTS
    + """
    SELECT user_id, count(*) AS total, CAST(count_if(status = 'PASSED') AS BIGINT) AS passed, CAST(count_if(status = 'FAILED') AS BIGINT) AS failed,
           CAST(0 AS BIGINT) AS errored, round(avg(pass_rate), 9) AS score, bool_or(severity = 'error' AND status <> 'PASSED') AS blocking
    FROM r GROUP BY user_id
    """
)
def quality_summary(t):
    return summarize(recorded_results(t), ["user_id"]).withColumn("score", F.round("score", 9))


@query(
    _RESULTS
    + """
    , g AS (SELECT user_id, count(*) AS n, count_if(status <> 'PASSED') AS bad, count_if(status <> 'PASSED' AND severity = 'error') AS hard,
                 avg(pass_rate) AS score, string_agg(check_id, ', ' ORDER BY check_id) FILTER (status <> 'PASSED') AS ids,
                 string_agg(check_id, ', ' ORDER BY check_id) FILTER (status <> 'PASSED' AND severity = 'error') AS hard_ids FROM r GROUP BY user_id)
    SELECT user_id, 'any_failure' AS rule, bad > 0 AS blocked,
           CASE WHEN bad > 0 THEN bad || ' of ' || n || ' checks failed: ' || ids ELSE 'All ' || n || ' checks passed' END AS reason,
           coalesce(ids, '') AS failed_checks, n AS evaluated_checks FROM g
    UNION ALL SELECT user_id, 'error_only', hard > 0,
           CASE WHEN hard > 0 THEN hard || ' checks of severity error failed: ' || hard_ids ELSE 'nothing of severity error failed (' || bad || ' of lesser severity)' END,
           coalesce(hard_ids, ''), n FROM g
    UNION ALL SELECT user_id, 'score_below', score < 0.97, '', CASE WHEN score < 0.97 THEN coalesce(ids, '') ELSE '' END, n FROM g
    """
)
def quality_gates(t):
    results = recorded_results(t)
    parts = []
    for rule in ("any_failure", "error_only", "score_below"):
        table = gate_table(results, rule, 0.97, by=["user_id"])
        reason = F.lit("") if rule == "score_below" else F.col("reason")
        parts.append(
            table.select(
                "user_id", F.lit(rule).alias("rule"), "blocked", reason.alias("reason"), F.array_join("failed_checks", ", ").alias("failed_checks"), "evaluated_checks"
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    _RESULTS
    + """
    SELECT user_id, bool_or(status <> 'PASSED') AS blocked, count(*) AS evaluated_checks FROM r WHERE check_id IN ('error', 'view', 'click') GROUP BY user_id
    """
)
def quality_gate_scope(t):
    edges = [("error", "view"), ("view", "join"), ("click", "join"), ("join", "gate"), ("signup", "other")]
    scoped = results_in_scope(recorded_results(t), "check_id", edges, "gate")
    return gate_table(scoped, by=["user_id"]).select("user_id", "blocked", "evaluated_checks")


_ROW_CHECKS = [
    {"id": "price", "type": "range", "column": "o_totalprice", "min": 5000},
    {"id": "status", "type": "accepted_values", "column": "o_orderstatus", "values": ["F", "O"]},
    {"id": "priority", "type": "regex", "column": "o_orderpriority", "pattern": "^[1-4]"},
    {"id": "soft", "type": "range", "column": "o_totalprice", "max": 1, "severity": "warn"},
]
_BROKEN = """
    concat_ws(',', CASE WHEN o_totalprice < 5000 THEN 'price' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' END,
              CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-4]') THEN 'priority' END)
"""


@query(f"SELECT o_orderkey, o_totalprice, {_BROKEN} AS failed_checks FROM orders")
def quarantine_marks(t):
    return quarantine(t.orders, _ROW_CHECKS).select("o_orderkey", "o_totalprice", F.array_join("failed_checks", ",").alias("failed_checks"))


@query(
    f"""
    SELECT CASE WHEN {_BROKEN} = '' THEN 'good' ELSE 'bad' END AS side, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS price
    FROM orders GROUP BY 1
    """
)
def quarantine_split(t):
    good, bad = split_rows(t.orders, _ROW_CHECKS)
    both = good.select(F.lit("good").alias("side"), "o_totalprice").unionByName(bad.select(F.lit("bad").alias("side"), "o_totalprice"))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("price"))


@query(
    """
    WITH c AS (SELECT c_mktsegment AS dataset, count(*) AS row_count, bool_and(c_acctbal >= 0) AS ok FROM customer GROUP BY 1)
    SELECT dataset, 'minRows' AS expectation, '100' AS target, row_count >= 100 AS passed FROM c WHERE dataset IN ('BUILDING', 'MACHINERY')
    UNION ALL SELECT 'NOWHERE', 'minRows', '1', false
    UNION ALL SELECT dataset, 'maxRows', '250', row_count <= 250 FROM c WHERE dataset = 'BUILDING'
    UNION ALL SELECT dataset, 'nonNegative', 'c_acctbal', ok FROM c WHERE dataset IN ('BUILDING', 'MACHINERY')
    UNION ALL SELECT 'BUILDING', 'unique', 'c_custkey', false
    """
)
def dataset_expectations(t):
    sizes = t.customer.groupBy(F.col("c_mktsegment").alias("name")).agg(F.count(F.lit(1)).alias("row_count"), F.bool_and(F.col("c_acctbal") >= 0).alias("ok"))
    results = sizes.select(
        F.col("name").alias("dataset"), F.lit("c_acctbal").alias("column"), F.lit("range").alias("type"), F.when(F.col("ok"), "PASSED").otherwise("FAILED").alias("status")
    )
    expectations = [
        {"dataset": "BUILDING", "minRows": 100, "maxRows": 250, "nonNegative": ["c_acctbal"], "unique": ["c_custkey"]},
        {"dataset": "MACHINERY", "minRows": 100, "nonNegative": ["c_acctbal"]},
        {"dataset": "NOWHERE", "minRows": 1},
    ]
    return check_expectations(expectations, results, sizes).select("dataset", "expectation", "target", "passed")
