"""What there is to know about each failed run: one row per run, gathered from the run-log tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weir.operators.keyed import latest_per_key
from weir.runlog.definitions import diff_settings

def failure_evidence(
    runs: DataFrame,
    tasks: DataFrame,
    attempts: DataFrame,
    logs: DataFrame,
    results: DataFrame,
    log_limit: int | None = None,
    recent_runs: int | None = None,
) -> DataFrame:
    """For every FAILED run: its first failed task with attempts and logs, the last successful run of the
    pipeline, checks that failed, tasks held back, and how often the node failed before.

    All log lines of the failed task are listed, and all runs of the pipeline count, unless the caller asks for
    the newest `log_limit` errors and lines, or the newest `recent_runs`; `log_lines_total` has the full number.
    """
    run_version = F.col("pipeline_version_id") if "pipeline_version_id" in runs.columns else F.lit(None).cast("string")
    failed_runs = runs.where(F.col("state") == "FAILED").select(
        F.col("id").alias("run_id"), "pipeline_id", "queued_at", "error", run_version.alias("version_id")
    )
    run_ids = failed_runs.select("run_id")
    failed_tasks = tasks.where(F.col("state") == "FAILED").join(run_ids, "run_id", "left_semi")
    first_failed = failed_tasks.groupBy("run_id").agg(
        F.min_by(F.struct(F.col("id").alias("task_run_id"), "node_id", "node_type", "error"), F.struct("finished_at", "id")).alias("failed_task")
    )
    task_ids = first_failed.select("run_id", F.col("failed_task.task_run_id").alias("task_run_id"))

    tried = attempts.join(task_ids.select("task_run_id"), "task_run_id", "left_semi").groupBy("task_run_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.array_sort(F.collect_list(F.struct("attempt", "state", "error"))).alias("attempt_list"),
    )
    lines = logs.join(task_ids.select("task_run_id"), "task_run_id", "left_semi").select("id", "task_run_id", "ts", "level", "message")
    order = ["ts", "id"]
    kept = lines
    if log_limit is not None:
        errors = latest_per_key(lines.where(F.col("level") == "error"), ["task_run_id"], order, log_limit)
        kept = errors.unionByName(latest_per_key(lines, ["task_run_id"], order, log_limit)).distinct()
    log_lists = kept.groupBy("task_run_id").agg(F.array_sort(F.collect_list(F.struct("ts", "id", "level", "message"))).alias("logs"))
    log_counts = lines.groupBy("task_run_id").agg(F.count(F.lit(1)).alias("log_lines_total"))

    newest = F.struct("queued_at", "id")
    succeeded = runs.where(F.col("state") == "SUCCESS").groupBy("pipeline_id").agg(
        F.max_by("id", newest).alias("last_success_run_id"), F.max("queued_at").alias("last_success_at"),
        F.max_by(run_version, newest).alias("last_success_version_id"),
    )
    checks = (
        results.where(F.col("status") != "PASSED").join(run_ids, "run_id", "left_semi").groupBy("run_id")
        .agg(F.array_sort(F.collect_list("check_id")).alias("failed_checks"))
    )
    held = (
        tasks.where(F.col("state").isin("BLOCKED", "SKIPPED")).join(run_ids, "run_id", "left_semi").groupBy("run_id")
        .agg(F.array_sort(F.collect_list("node_id")).alias("affected_nodes"))
    )
    recent = runs.select("id", "pipeline_id", "queued_at")
    if recent_runs is not None:
        recent = latest_per_key(recent, ["pipeline_id"], [("queued_at", "desc"), ("id", "desc")], recent_runs)
    failing_nodes = tasks.where(F.col("state") == "FAILED").select(F.col("run_id").alias("id"), "node_id").distinct()
    recurrence = (
        recent.join(failing_nodes, "id").groupBy("pipeline_id", "node_id")
        .agg(F.count(F.lit(1)).alias("recent_failures"), F.min("queued_at").alias("failing_since"))
    )
    with_task = failed_runs.join(first_failed, "run_id", "left").select(
        "run_id", "pipeline_id", "queued_at", "error", "version_id", F.col("failed_task.task_run_id").alias("task_run_id"),
        F.col("failed_task.node_id").alias("node_id"), F.col("failed_task.error").alias("task_error"),
    )
    return (
        with_task.join(tried, "task_run_id", "left")
        .join(log_lists, "task_run_id", "left")
        .join(log_counts, "task_run_id", "left")
        .join(succeeded, "pipeline_id", "left")
        .join(checks, "run_id", "left")
        .join(held, "run_id", "left")
        .join(recurrence, ["pipeline_id", "node_id"], "left")
        .select(
            "run_id", "pipeline_id", "queued_at", "error", "node_id", "task_error", F.coalesce("attempts", F.lit(0)).alias("attempts"),
            "attempt_list", "logs", F.coalesce("log_lines_total", F.lit(0)).alias("log_lines_total"), "last_success_run_id", "last_success_at", "version_id", "last_success_version_id", "failed_checks", "affected_nodes",
            F.coalesce("recent_failures", F.lit(0)).alias("recent_failures"), "failing_since",
        )
    )


def version_changes(found: DataFrame, versions: DataFrame) -> DataFrame:
    """Settings that differ between a failed run's definition and that of the last successful run.

    `found` comes from `failure_evidence`, `versions` has pipeline_version_id and definition (JSON text).
    """
    changed = found.where(F.col("version_id") != F.col("last_success_version_id"))

    def side(column: str) -> DataFrame:
        wanted = changed.select(F.col("run_id").alias("pipeline_id"), F.col(column).alias("pipeline_version_id"))
        return wanted.join(versions.select("pipeline_version_id", "definition"), "pipeline_version_id").select("pipeline_id", "definition")

    return diff_settings(side("last_success_version_id"), side("version_id")).withColumnRenamed("pipeline_id", "run_id")
