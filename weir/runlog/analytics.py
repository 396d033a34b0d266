"""Numbers about runs: totals, rates, durations, daily series, top failures, dashboard counts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from weir.operators.keyed import count_by_state, latest_per_key, sliced_rows
from weir.operators.sort import order_by, top_k

# The states of a run.
RUN_STATES = ("PENDING", "QUEUED", "RUNNING", "SUCCESS", "FAILED", "CANCELLED")
TOP_FAILURES = 10


def in_window(df: DataFrame, column: str, since=None, until=None) -> DataFrame:
    """Rows between the two bounds, both included; the predicate reaches the scan."""
    data_type = df.schema[column].dataType
    if since is not None:
        df = df.where(F.col(column) >= F.lit(since).cast(data_type))
    if until is not None:
        df = df.where(F.col(column) <= F.lit(until).cast(data_type))
    return df


def _state(*states: str) -> Column:
    return F.count_if(F.col("state").isin(*states))


def run_totals(runs: DataFrame, since=None, until=None, by: Sequence[str] = ()) -> DataFrame:
    """Runs by outcome, success rate and mean duration, in one pass."""
    windowed = in_window(runs, "queued_at", since, until)
    totals = windowed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), _state("SUCCESS").alias("succeeded"), _state("FAILED").alias("failed"),
        _state("CANCELLED").alias("cancelled"), _state("RUNNING", "QUEUED").alias("running"),
        F.round(F.avg("duration_ms")).cast("bigint").alias("average_duration_ms"),
    )
    finished = F.col("succeeded") + F.col("failed")
    return totals.withColumn("success_rate", F.coalesce(F.try_divide(F.col("succeeded"), finished), F.lit(0.0)))


def duration_percentile(
    runs: DataFrame, fraction: float = 0.95, since=None, until=None, by: Sequence[str] = (), exact: bool = True, accuracy: int = 10_000
) -> DataFrame:
    """The interpolated percentile of durations.

    Exact: runs are counted per distinct duration first, in the map tasks, so what is sorted per group
    is the distinct durations and not the runs. Without groups the durations are dealt into ranges, and only the ranges that hold
    the position are sorted. `exact=False` uses a sketch of fixed size instead.
    """
    windowed = in_window(runs, "queued_at", since, until).where(F.col("duration_ms").isNotNull())
    if not exact:
        value = F.percentile_approx("duration_ms", F.lit(fraction), F.lit(accuracy))
        return windowed.groupBy(*by).agg(value.cast("double").alias("p_duration_ms"))
    counts = windowed.groupBy(*by, "duration_ms").agg(F.count(F.lit(1)).alias("n"))
    if not by:
        return _selected(counts, fraction)
    group = Window.partitionBy(*by)
    ranked = counts.select(
        *by, "duration_ms", F.sum("n").over(group.orderBy("duration_ms")).alias("upto"),
        (F.lit(fraction) * (F.sum("n").over(group) - 1)).alias("position"),
    )
    low = F.min(F.when(F.col("upto") > F.floor("position"), F.col("duration_ms")))
    high = F.min(F.when(F.col("upto") > F.ceil("position"), F.col("duration_ms")))
    share = F.max(F.col("position") - F.floor("position"))
    return ranked.groupBy(*by).agg((low + (high - low) * share).cast("double").alias("p_duration_ms"))


def _selected(counts: DataFrame, fraction: float) -> DataFrame:
    """The percentile of all runs; the driver sees the number of runs in each range."""
    ranged = sliced_rows(counts, [], ["duration_ms"])
    before, offsets = 0, {}
    totals = ranged.groupBy("__slice").agg(F.sum("n").alias("n")).orderBy("__slice").collect()
    for row in totals:
        offsets[row["__slice"]] = before
        before += row["n"]
    position = fraction * (before - 1)
    ranks = [math.floor(position), math.ceil(position)] if before else []
    holding = sorted({max(s for s, o in offsets.items() if o <= rank) for rank in ranks})
    within = Window.partitionBy("__slice").orderBy("duration_ms")
    offset = F.create_map(*[F.lit(v) for s in holding for v in (s, offsets[s])])[F.col("__slice")] if holding else F.lit(0)
    upto = ranged.where(F.col("__slice").isin(holding)).select("duration_ms", (offset + F.sum("n").over(within)).alias("upto"))
    low, high = (F.min(F.when(F.col("upto") > rank, F.col("duration_ms"))) for rank in ranks or (0, 0))
    return upto.agg((low + (high - low) * F.lit(position - math.floor(position))).cast("double").alias("p_duration_ms"))


def daily_series(runs: DataFrame, since=None, until=None) -> DataFrame:
    """One row per UTC day that has runs."""
    return (
        in_window(runs, "queued_at", since, until)
        .groupBy(F.col("queued_at").cast("date").alias("date"))
        .agg(
            _state("SUCCESS").alias("succeeded"), _state("FAILED").alias("failed"), _state("CANCELLED").alias("cancelled"),
            F.round(F.avg("duration_ms")).cast("bigint").alias("average_duration_ms"),
        )
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each pipeline."""
    return latest_per_key(runs, ["pipeline_id"], [("queued_at", "desc"), ("id", "desc")])


def runs_by_state(runs: DataFrame) -> DataFrame:
    return count_by_state(runs, "state", RUN_STATES)


def top_failing(tasks: DataFrame, runs: DataFrame, since=None, until=None, k: int = TOP_FAILURES) -> DataFrame:
    """The nodes with most failed tasks among the runs of a window."""
    wanted = in_window(runs, "queued_at", since, until).select(F.col("id").alias("run_id"))
    failed = tasks.where(F.col("state") == "FAILED").join(wanted, "run_id", "left_semi")
    counted = failed.groupBy("node_id").agg(F.min("node_type").alias("node_type"), F.count(F.lit(1)).alias("failures"))
    return top_k(counted, [("failures", "desc"), "node_id"], k)


def quality_failures(results: DataFrame, since=None, until=None) -> DataFrame:
    return in_window(results, "created_at", since, until).agg(F.count_if(F.col("status") != "PASSED").alias("quality_failures"))


def quality_history(
    results: DataFrame, run_id: str | None = None, dataset: str | None = None, pipeline_id: str | None = None, since=None, limit: int | None = None
) -> DataFrame:
    """The recorded results that match, latest first; the newest `limit` of them if one is given."""
    for column, value in (("run_id", run_id), ("dataset", dataset), ("pipeline_id", pipeline_id)):
        if value is not None:
            results = results.where(F.col(column) == value)
    order = [("created_at", "desc"), *[(c, "asc") for c in ("run_id", "check_id") if c in results.columns]]
    found = in_window(results, "created_at", since)
    return order_by(found, order) if limit is None else top_k(found, order, limit)


def dashboard(pipelines: DataFrame, runs: DataFrame, schedules: DataFrame, incidents: DataFrame, since) -> DataFrame:
    """Counts as rows (name, value), so that no single-row tables have to be crossed."""
    recent = in_window(runs, "queued_at", since).select("pipeline_id").distinct()
    # Each entry is one aggregated row.
    active = pipelines.join(recent, pipelines["id"] == recent["pipeline_id"], "left_semi")
    entries = [
        ("pipelines_total", pipelines, F.count(F.lit(1))),
        ("pipelines_active", active, F.count(F.lit(1))),
        ("pipelines_scheduled", schedules.where("enabled"), F.count_distinct("pipeline_id")),
        ("runs_total", runs, F.count(F.lit(1))),
        ("incidents_open", incidents.where(F.col("status") == "open"), F.count(F.lit(1))),
    ]
    table = None
    for name, source, measure in entries:
        row = source.agg(measure.cast("bigint").alias("value")).select(F.lit(name).alias("name"), "value")
        table = row if table is None else table.unionByName(row)
    return table
