"""Splitting rows by the checks that can be decided row by row."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, functions as F

from weir.quality.checks import ROW_LEVEL, Check, parse_checks, row_predicate


def quarantine(df: DataFrame, checks: Iterable[Check | Mapping[str, Any]], column: str = "failed_checks") -> DataFrame:
    """Adds the ids of the error-severity row-level checks each row fails; an empty list means good."""
    given = list(checks)
    parsed = given if given and all(isinstance(c, Check) for c in given) else parse_checks(given)
    failed = [
        F.when(~row_predicate(df, c), F.lit(c.id)) for c in parsed if c.type in ROW_LEVEL and c.severity == "error"
    ]
    ids = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    return df.withColumn(column, ids)


def split_rows(df: DataFrame, checks: Iterable[Check | Mapping[str, Any]]) -> tuple[DataFrame, DataFrame]:
    """Good rows as they came, and bad rows with their reasons. Together they are the input."""
    marked = quarantine(df, checks)
    size = F.size("failed_checks")
    return marked.where(size == 0).drop("failed_checks"), marked.where(size > 0)
