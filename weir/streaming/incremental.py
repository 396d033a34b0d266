"""Incremental loads and gated loads as streams that stop when the input is used up."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import replace
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from weir.quality.checks import parse_checks, run_checks
from weir.quality.gate import evaluate_gate
from weir.quality.quarantine import quarantine
from weir.sources.dataset import Datasets
from weir.sources.snapshots import load


def upsert_stream(
    stream: DataFrame, datasets: Datasets, name: str, keys: Sequence[str], checkpoint: str, order_by: Sequence = (), partition_by: Sequence[str] = ()
) -> StreamingQuery:
    """Upserts each micro-batch into a dataset.

    The checkpoint is the watermark of what was read. A batch commits under its number, so one that is repeated after a
    failure changes nothing. Of all rows with one key the first in `order_by` wins, so a batch with late rows replaces no newer ones.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        datasets.write(
            name, batch, "upsert", keys, run_id=f"batch-{batch_id}", order_by=order_by, partition_by=partition_by, transaction=(f"stream-{checkpoint}", batch_id)
        )

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def gated_stream(
    stream: DataFrame,
    datasets: Datasets,
    name: str,
    checks: Iterable[Mapping[str, Any]],
    checkpoint: str,
    rule: str = "any_failure",
    min_score: float = 1.0,
    quarantine_name: str | None = None,
    now: datetime | None = None,
) -> StreamingQuery:
    """Checks each micro-batch before it is published; rows get their `batch_id`.

    A batch is written once, checked as written, and committed to `name`, or to `<name>_blocked` if the gate blocks it. Rows that
    fail row-level checks are committed to `quarantine_name` if one is given. `unique` looks at the batch and at all that was
    published before it: a value that is there already fails, and counts among the failed rows. A batch commits under its number and
    its own target last, so a repeated batch changes nothing once it is decided, and is decided on the same rows before that.
    """
    specs = list(checks)
    token = f"stream-{checkpoint}"

    def committed(target: str, batch_id: int) -> bool:
        known = load(datasets.spark, f"{datasets.path(target)}/_commits")
        return known is not None and known.has((token, batch_id))

    def write(batch: DataFrame, batch_id: int) -> None:
        blocked_name, transaction = f"{name}_blocked", (token, batch_id)
        if any(committed(target, batch_id) for target in (name, blocked_name)):
            return
        numbered = batch.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        if quarantine_name:
            staged = datasets.stage(quarantine(numbered, specs), bad=F.size("failed_checks") > 0)
            datasets.commit(quarantine_name, staged, "append", run_id=f"batch-{batch_id}", transaction=transaction, side="bad")
        else:
            staged = datasets.stage(numbered)
        kept = replace(staged, schema=numbered.schema)
        results = run_checks(datasets.staged_rows(kept), specs, now, samples=False)
        results = _with_earlier(datasets, name, datasets.staged_rows(kept), specs, results, now)
        decision = evaluate_gate(results, rule, min_score)
        datasets.commit(blocked_name if decision.blocked else name, kept, "append", run_id=f"batch-{batch_id}", transaction=transaction)

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _with_earlier(datasets: Datasets, name: str, rows: DataFrame, specs: list, results: DataFrame, now: datetime | None) -> DataFrame:
    """The results with those of `unique` checks replaced by ones that also see what was published before.

    Only the column's values that the batch has are looked up: the batch is the small side of a semi-join with one column of the dataset.
    """
    for check in parse_checks(specs):
        if check.type != "unique" or load(datasets.spark, f"{datasets.path(name)}/_commits") is None:
            continue
        column = rows.select(F.col(f"`{check.column}`").alias(check.column))
        earlier = datasets.read(name).select(F.col(f"`{check.column}`").alias(check.column)).join(column.distinct(), [check.column], "left_semi").distinct()
        again = run_checks(column.unionAll(earlier), [check], now, samples=False)
        results = results.where(F.col("check_id") != check.id).unionByName(again)
    return results
