"""Backfills: the logical dates of a range, what is missing, how far it is, and one job for all of it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from weir.errors import ConfigError

# Guards against ranges nobody meant.
WARN_RUNS = 100
MAX_RUNS = 10_000
MIN_INTERVAL_SECONDS = 60
DEFAULT_INTERVAL_SECONDS = 86_400


def backfill_dates(
    spark: SparkSession,
    start: datetime,
    end: datetime,
    interval_seconds: int = DEFAULT_INTERVAL_SECONDS,
    confirm_large: bool = False,
    now: datetime | None = None,
) -> DataFrame:
    """One row `logical_date` per step from start to end, both included."""
    if end < start:
        raise ConfigError("Backfill end must not be earlier than its start")
    if start > (now or datetime.now(start.tzinfo)):
        raise ConfigError("Backfill start is in the future; backfills replay the past")
    if not isinstance(interval_seconds, int) or interval_seconds < MIN_INTERVAL_SECONDS:
        raise ConfigError(f"Backfill interval must be an integer of at least {MIN_INTERVAL_SECONDS} seconds")
    count = int((end - start).total_seconds() // interval_seconds) + 1
    if count > MAX_RUNS:
        raise ConfigError(f"That range would create {count:,} runs, over the {MAX_RUNS:,} limit. Narrow the range or widen the interval.")
    if count > WARN_RUNS and not confirm_large:
        raise ConfigError(f"This backfill would create {count} runs. Re-submit with confirmation to proceed.")
    step = F.make_dt_interval(secs=F.lit(interval_seconds))
    bounds = spark.range(1).select(F.lit(start).cast("timestamp_ntz").alias("a"), F.lit(end).cast("timestamp_ntz").alias("b"))
    return bounds.select(F.explode(F.sequence("a", "b", step)).alias("logical_date"))


def expand_ranges(ranges: DataFrame, interval_seconds: int = DEFAULT_INTERVAL_SECONDS) -> DataFrame:
    """The logical dates of many ranges (schedule_id, range_start, range_end) at once."""
    step = F.make_dt_interval(secs=F.lit(interval_seconds))
    return ranges.select("schedule_id", F.explode(F.sequence("range_start", "range_end", step)).alias("logical_date"))


def missing_dates(dates: DataFrame, runs: DataFrame) -> DataFrame:
    """Logical dates (schedule_id, logical_date) that have no run yet."""
    return dates.join(runs.select("schedule_id", "logical_date"), ["schedule_id", "logical_date"], "left_anti")


def missing_in_ranges(ranges: DataFrame, runs: DataFrame, interval_seconds: int = DEFAULT_INTERVAL_SECONDS) -> DataFrame:
    """`missing_dates` of `expand_ranges`, without a shuffle of the dates: they are made and compared inside the row of their range.

    The runs that fall on a date of a range are gathered first, each date once, so a row holds no more than the dates of its range.
    """
    key = ["schedule_id", "range_start", "range_end"]
    step, place = F.make_dt_interval(secs=F.lit(interval_seconds)), F.timestamp_diff("MICROSECOND", F.col("range_start"), F.col("logical_date"))
    planned = F.col("logical_date").between(F.col("range_start"), F.col("range_end")) & (place % (interval_seconds * 1_000_000) == 0)
    met = ranges.select(*key).distinct().join(runs.select("schedule_id", "logical_date"), "schedule_id").where(planned)
    seen = met.groupBy(*key).agg(F.collect_set("logical_date").alias("__seen"))
    dates = F.sequence("range_start", "range_end", step)
    missing = F.when(F.col("__seen").isNull(), dates).otherwise(F.array_except(dates, "__seen"))
    return ranges.join(seen, key, "left").select("schedule_id", F.explode(missing).alias("logical_date"))


def unique_runs(runs: DataFrame) -> DataFrame:
    """At most one run per schedule and logical date: the first one queued."""
    scheduled = runs.where(F.col("schedule_id").isNotNull() & F.col("logical_date").isNotNull())
    others = [c for c in runs.columns if c not in ("schedule_id", "logical_date")]
    first = scheduled.groupBy("schedule_id", "logical_date").agg(
        F.min_by(F.struct(*others), F.struct("queued_at", "id")).alias("__first")
    )
    kept = first.select("schedule_id", "logical_date", "__first.*").select(*runs.columns)
    return kept.unionByName(runs.where(F.col("schedule_id").isNull() | F.col("logical_date").isNull()))


def backfill_progress(planned: DataFrame, runs: DataFrame) -> DataFrame:
    """Per backfill: total, completed, failed, running, remaining, percent.

    `planned` has backfill_id and logical_date; runs have backfill_id, logical_date and state.
    """
    totals = planned.groupBy("backfill_id").agg(F.count(F.lit(1)).alias("total"))
    state = F.col("state")
    seen = runs.where(F.col("backfill_id").isNotNull()).groupBy("backfill_id").agg(
        F.count_if(state == "SUCCESS").alias("completed"), F.count_if(state.isin("FAILED", "CANCELLED")).alias("failed"),
        F.count_if(state.isin("RUNNING", "QUEUED")).alias("running"), F.count_distinct("logical_date").alias("started"),
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("completed", "failed", "running", "started")}
    return totals.join(seen, "backfill_id", "left").withColumns(zero).select(
        "backfill_id", "total", "completed", "failed", "running", (F.col("total") - F.col("started")).alias("remaining"),
        F.round((F.col("completed") + F.col("failed")) / F.col("total") * 100).cast("int").alias("percent_complete"),
    )


def run_backfill(
    source: DataFrame, date_column: str, start: datetime, end: datetime, build: Callable[[DataFrame], DataFrame], path: str
) -> None:
    """Rebuilds all days of a range in one job and replaces just those days of the target.

    `build` gets the source rows of the range with a `run_date` column and must keep that column;
    days outside the range stay as they are, so running it again changes nothing.
    """
    data_type = source.schema[date_column].dataType
    day = F.col(date_column).cast("date")
    until = end + timedelta(days=1)
    # Plain bounds on the column itself, so that they reach the scan.
    wanted = source.where(
        (F.col(date_column) >= F.lit(datetime(start.year, start.month, start.day)).cast(data_type))
        & (F.col(date_column) < F.lit(datetime(until.year, until.month, until.day)).cast(data_type))
    ).withColumn("run_date", day)
    built = build(wanted)
    if "run_date" not in built.columns:
        raise ConfigError("the backfill must keep the run_date column")
    built.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path)
