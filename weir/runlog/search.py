"""Finding runs, log lines and catalog entries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from weir.operators.sort import Page, keyset_page, order_by, top_k
from weir.runlog.analytics import in_window


def find_runs(
    runs: DataFrame,
    states: Sequence[str] = (),
    pipeline_id: str | None = None,
    trigger: str | None = None,
    backfill_id: str | None = None,
    schedule_id: str | None = None,
    since=None,
    until=None,
    cursor: str | None = None,
    limit: int | None = None,
) -> Page:
    """The runs that match, newest first, one keyset page at a time."""
    if states:
        runs = runs.where(F.col("state").isin(*states))
    wanted = {"pipeline_id": pipeline_id, "trigger": trigger, "backfill_id": backfill_id, "schedule_id": schedule_id}
    for column, value in wanted.items():
        if value is not None:
            runs = runs.where(F.col(column) == value)
    return keyset_page(in_window(runs, "queued_at", since, until), "queued_at", "id", cursor, limit)


def longest_runs(runs: DataFrame, limit: int) -> DataFrame:
    return top_k(runs, [(F.coalesce("duration_ms", F.lit(0)), "desc"), ("id", "asc")], limit)


def find_logs(
    logs: DataFrame,
    run_id: str | None = None,
    task_run_id: str | None = None,
    attempt: int | None = None,
    level: str | None = None,
    since=None,
    text: str | None = None,
) -> DataFrame:
    """Log lines that match; text is looked for anywhere, in any case."""
    for column, value in (("run_id", run_id), ("task_run_id", task_run_id), ("attempt", attempt), ("level", level)):
        if value is not None:
            logs = logs.where(F.col(column) == value)
    logs = in_window(logs, "ts", since)
    return logs if not text else logs.where(F.lower("message").contains(text.lower()))


def match_score(column: Column | str, needle: str) -> Column:
    """3 for the whole text, 2 for its start, 1 for a part of it, else 0; case does not matter."""
    text = F.lower(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")))
    return F.when(text == needle, 3).when(text.startswith(needle), 2).when(text.contains(needle), 1).otherwise(0)


def search_catalog(entities: Mapping[str, tuple[DataFrame, str, str, Sequence[str]]], query: str, limit: int | None = None) -> DataFrame:
    """The hits over several tables, best first, or the best `limit` of them: `{kind: (table, id column, title column, searched columns)}`."""
    needle = query.strip().lower()
    branches = []
    for kind, (table, id_column, title, searched) in entities.items():
        scores = [match_score(c, needle) for c in searched]
        score = F.greatest(*scores) if len(scores) > 1 else scores[0]
        branches.append(
            table.select(F.lit(kind).alias("kind"), F.col(id_column).cast("string").alias("id"), F.col(title).alias("title"), score.alias("score"))
        )
    found = reduce(DataFrame.unionByName, branches).where(F.col("score") > (0 if needle else 99))
    order = [("score", "desc"), "title", "kind", "id"]
    return order_by(found, order) if limit is None else top_k(found, order, limit)
