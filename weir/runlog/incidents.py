"""Incident detectors over run-log tables.

Each detector looks at every run as the run that just ended and returns one row per finding:
kind, severity, title, fingerprint, pipeline_id, run_id, dataset, evidence (JSON text), seen_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weir.operators.keyed import look_back

# Thresholds of the detectors.
FAILURE_THRESHOLD = 3
SPIKE_MULTIPLIER = 2.0
SPIKE_FLOOR_MS = 30_000
SPIKE_HISTORY = 19
SPIKE_MIN_SAMPLES = 5
MISSING_DATA_HISTORY = 4
STALE_TOLERANCE = 2.0
DEFAULT_INTERVAL_SECONDS = 86_400

COLUMNS = ("kind", "severity", "title", "fingerprint", "pipeline_id", "run_id", "dataset", "evidence", "seen_at")


def _incident(kind: str, severity, title, fingerprint, run_id, evidence: Column, seen_at, dataset=None) -> list[Column]:
    def column(value) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    return [
        F.lit(kind).alias("kind"), column(severity).alias("severity"), title.alias("title"),
        F.concat_ws(":", F.lit(kind), *fingerprint).alias("fingerprint"), F.col("pipeline_id"), column(run_id).cast("string").alias("run_id"),
        column(dataset).cast("string").alias("dataset"), F.to_json(evidence).alias("evidence"), column(seen_at).alias("seen_at"),
    ]


def _fixed(number: Column, digits: int) -> Column:
    return F.call_function("format_number", number, F.lit("0." + "0" * digits))


def repeated_failure(runs: DataFrame, threshold: int = FAILURE_THRESHOLD, slices: int | None = None) -> DataFrame:
    """Runs that failed and whose `threshold - 1` predecessors failed too."""
    columns = runs.select("id", "pipeline_id", "pipeline_name", "state", "queued_at", "error")

    def build(window):
        frame = window.rowsBetween(-(threshold - 1), 0)
        return {
            "failures": F.count_if(F.col("state") == "FAILED").over(frame),
            # The frame holds `threshold` rows.
            "run_ids": F.collect_list("id").over(frame),
            "first_failure_at": F.min("queued_at").over(frame),
        }

    seen = look_back(columns, ["pipeline_id"], ["queued_at", "id"], threshold - 1, build, slices)
    hits = seen.where((F.col("state") == "FAILED") & (F.col("failures") == threshold))
    evidence = F.struct(
        F.col("failures").alias("consecutiveFailures"), F.reverse("run_ids").alias("runIds"),
        F.col("first_failure_at").alias("firstFailureAt"), F.col("error").alias("lastError"),
    )
    title = F.concat(F.col("pipeline_name"), F.lit(f" failed {threshold} consecutive times"))
    return hits.select(*_incident("repeated_failure", "high", title, [F.col("pipeline_id")], F.col("id"), evidence, F.col("queued_at")))


def duration_spike(
    runs: DataFrame, multiplier: float = SPIKE_MULTIPLIER, floor_ms: int = SPIKE_FLOOR_MS, slices: int | None = None
) -> DataFrame:
    """Successful runs far slower than the mean of the successful runs just before them."""
    succeeded = runs.where(F.col("state") == "SUCCESS").select("id", "pipeline_id", "pipeline_name", "queued_at", "duration_ms")

    def build(window):
        frame = window.rowsBetween(-SPIKE_HISTORY, -1)
        return {"recent_average": F.avg("duration_ms").over(frame), "samples": F.count("duration_ms").over(frame)}

    seen = look_back(succeeded, ["pipeline_id"], ["queued_at", "id"], SPIKE_HISTORY, build, slices)
    duration, average = F.col("duration_ms"), F.col("recent_average")
    hits = seen.where((duration > floor_ms) & (F.col("samples") >= SPIKE_MIN_SAMPLES) & (duration > average * multiplier))
    evidence = F.struct(
        duration.alias("durationMs"), F.round(average).cast("bigint").alias("recentAverageMs"), F.col("samples").alias("sampleSize"),
        F.round(duration / average, 2).alias("multiplier"),
    )
    title = F.concat(
        F.col("pipeline_name"), F.lit(" took "), _fixed(duration / 1000, 1), F.lit("s, "), _fixed(duration / average, 1),
        F.lit("x its recent average"),
    )
    return hits.select(*_incident("duration_spike", "medium", title, [F.col("pipeline_id")], F.col("id"), evidence, F.col("queued_at")))


def missing_data(tasks: DataFrame, runs: DataFrame, slices: int | None = None) -> DataFrame:
    """Sources that read nothing although one of the five newest successful runs read something.

    A successful run is one of the five itself, so it looks four runs back, and a run of another
    state five. Only tasks that succeeded and report `rows_read` count.
    """
    known = runs.select(F.col("id").alias("run_id"), "pipeline_id", "pipeline_name", "queued_at", (F.col("state") == "SUCCESS").alias("good"))
    reads = (
        tasks.where((F.col("state") == "SUCCESS") & F.col("rows_read").isNotNull())
        .select("run_id", "node_id", "node_type", "rows_read").join(known, "run_id")
        # Other runs matter only where they read nothing.
        .where(F.col("good") | (F.col("rows_read") <= 0))
    )
    good = F.col("good")

    def build(window):
        # The place of the row among the successful runs of its node.
        before = F.count_if(good).over(window.rowsBetween(Window.unboundedPreceding, -1))
        return {"place": F.coalesce(before, F.lit(0)) + 1}

    def then(keys):
        by_place = Window.partitionBy(*keys).orderBy("place")
        rows_read = F.max(F.when(good, F.col("rows_read")))
        return {
            "recent_rows": F.when(good, rows_read.over(by_place.rangeBetween(-MISSING_DATA_HISTORY, -1))).otherwise(
                rows_read.over(by_place.rangeBetween(-MISSING_DATA_HISTORY - 1, -1))
            )
        }

    seen = look_back(
        reads, ["pipeline_id", "node_id"], ["queued_at", "run_id"], MISSING_DATA_HISTORY + 1, build, slices, good, then
    )
    hits = seen.where((F.col("rows_read") <= 0) & (F.col("recent_rows") > 0))
    evidence = F.struct(F.col("node_id").alias("nodeId"), F.col("node_type").alias("nodeType"), F.lit(0).alias("rowsRead"), F.col("run_id").alias("runId"))
    title = F.concat(F.col("node_id"), F.lit(" read 0 rows in "), F.col("pipeline_name"))
    return hits.select(
        *_incident("missing_data", "medium", title, [F.col("pipeline_id"), F.col("node_id")], F.col("run_id"), evidence, F.col("queued_at"))
    )


def quality_failure(results: DataFrame) -> DataFrame:
    """One finding per run and dataset with checks that did not pass."""
    failing = results.where(F.col("status") != "PASSED").withColumn("dataset", F.coalesce("dataset", F.lit("(unnamed dataset)")))
    # The checks of one run on one dataset, which a spec bounds.
    check = F.struct(
        F.col("check_id").alias("checkId"), F.col("column"), F.col("expected"), F.col("actual"),
        F.col("failed_rows").alias("failedRows"), F.col("total_rows").alias("totalRows"),
    )
    grouped = failing.groupBy("pipeline_id", "run_id", "dataset").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("severity") == "error").alias("hard"),
        F.array_sort(F.collect_list(check)).alias("checks"), F.max("created_at").alias("seen"),
    )
    title = F.concat(F.col("n").cast("string"), F.lit(" checks failed on dataset "), F.col("dataset"))
    return grouped.select(
        *_incident(
            "quality_failure", F.when(F.col("hard"), "high").otherwise("low"), title, [F.col("pipeline_id"), F.col("dataset")],
            F.col("run_id"), F.struct("checks", F.col("run_id").alias("runId")), F.col("seen"), F.col("dataset"),
        )
    )


def schema_drift(validations: DataFrame) -> DataFrame:
    """Contract checks that were not COMPATIBLE. Columns: pipeline_id, run_id, node_id, dataset, classification, changes, seen_at."""
    drifted = validations.where(F.col("classification") != "COMPATIBLE")
    target = F.coalesce("dataset", "node_id")
    title = F.concat(F.col("classification"), F.lit(" schema change detected on "), target)
    evidence = F.struct("classification", "changes", F.col("node_id").alias("nodeId"), F.col("run_id").alias("runId"))
    return drifted.select(
        *_incident(
            "schema_change", F.when(F.col("classification") == "BREAKING", "high").otherwise("medium"), title,
            [F.col("pipeline_id"), target], F.col("run_id"), evidence, F.col("seen_at"), F.col("dataset"),
        )
    )


def stale_datasets(datasets: DataFrame, runs: DataFrame, schedules: DataFrame, now: Column, tolerance: float = STALE_TOLERANCE) -> DataFrame:
    """Datasets not refreshed within a multiple of the interval of a schedule of their pipeline."""
    last_run = runs.select(F.col("id").alias("last_run_id"), "pipeline_id")
    active = schedules.where("enabled").select(
        F.col("id").alias("schedule_id"), "pipeline_id", F.coalesce("interval_seconds", F.lit(DEFAULT_INTERVAL_SECONDS)).alias("every")
    )
    owned = (
        datasets.where(F.col("last_updated_at").isNotNull() & F.col("last_run_id").isNotNull())
        .select("name", "last_updated_at", "last_run_id").join(last_run, "last_run_id").join(active, "pipeline_id")
    )
    def micros(moment: Column) -> Column:
        return F.unix_micros(moment.cast("timestamp"))

    age = (micros(now) - micros(F.col("last_updated_at"))) / 1_000_000
    stale = owned.withColumn("age", age).where(F.col("age") > F.col("every") * tolerance)
    evidence = F.struct(
        F.col("name").alias("dataset"), F.col("last_updated_at").alias("lastUpdatedAt"), F.col("every").alias("expectedEverySeconds"),
        F.round("age").cast("bigint").alias("ageSeconds"), F.col("schedule_id").alias("scheduleId"),
    )
    hours = F.round(F.col("age") / 3600).cast("bigint").cast("string")
    title = F.concat(F.col("name"), F.lit(" has not been refreshed for "), hours, F.lit("h"))
    return stale.select(
        *_incident("stale_dataset", "medium", title, [F.col("name")], F.col("last_run_id"), evidence, now, F.col("name"))
    )


def roll_up(findings: DataFrame, incidents: DataFrame | None = None) -> DataFrame:
    """Findings folded into incidents, one per fingerprint, on top of the incidents already known.

    Findings that are not newer than their incident's last one have been counted, so rolling up the same findings again
    changes nothing. An acknowledged incident stays acknowledged and an open one stays open; a resolved one is left
    as it is, and findings newer than it open a new one next to it.
    """
    if incidents is not None:
        counted = incidents.groupBy("fingerprint").agg(F.max("last_seen_at").alias("counted_to"))
        findings = findings.join(counted, "fingerprint", "left").where(F.col("counted_to").isNull() | (F.col("seen_at") > F.col("counted_to"))).drop("counted_to")
    newest = F.struct("seen_at", "run_id")
    fresh = findings.groupBy("fingerprint").agg(
        F.max_by(F.struct("kind", "severity", "title", "pipeline_id", "run_id", "dataset", "evidence"), newest).alias("last"),
        F.count(F.lit(1)).alias("new_occurrences"), F.min("seen_at").alias("new_first"), F.max("seen_at").alias("new_last"),
    ).select("fingerprint", "last.*", "new_occurrences", "new_first", "new_last")
    columns = [
        "fingerprint", "kind", "severity", "title", "pipeline_id", "run_id", "dataset", "evidence", "status", "occurrences",
        "first_seen_at", "last_seen_at",
    ]
    if incidents is None:
        return fresh.select(
            *columns[:8], F.lit("open").alias("status"), F.col("new_occurrences").alias("occurrences"),
            F.col("new_first").alias("first_seen_at"), F.col("new_last").alias("last_seen_at"),
        )
    live = incidents.where(F.col("status") != "resolved").select(
        "fingerprint", F.col("status").alias("old_status"), F.col("occurrences").alias("old_occurrences"), F.col("first_seen_at").alias("old_first")
    )
    updated = fresh.join(live, "fingerprint", "left").select(
        *columns[:8],
        F.when(F.col("old_status") == "acknowledged", "acknowledged").otherwise("open").alias("status"),
        (F.coalesce("old_occurrences", F.lit(0)) + F.col("new_occurrences")).alias("occurrences"),
        F.coalesce("old_first", "new_first").alias("first_seen_at"), F.col("new_last").alias("last_seen_at"),
    )
    untouched_live = incidents.where(F.col("status") != "resolved").join(fresh.select("fingerprint"), "fingerprint", "left_anti")
    resolved = incidents.where(F.col("status") == "resolved")
    return updated.unionByName(untouched_live.select(*columns)).unionByName(resolved.select(*columns))
