"""Declarative filters: a list of predicates folded into one `where`, so Catalyst can push it down."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from weir.errors import ConfigError, ValidationError
from weir.functions.scalar import TRUE_WORDS
from weir.functions.types import as_text, is_text

# Predicate operators and the longest regular expression accepted.
OPERATORS = (
    "eq", "ne", "gt", "gte", "lt", "lte", "in", "not_in", "null", "not_null",
    "contains", "not_contains", "starts_with", "ends_with", "matches", "between",
)
MAX_PATTERN_LENGTH = 512


@dataclass(frozen=True)
class Predicate:
    column: str
    op: str
    value: Any = None
    high: Any = None
    ignore_case: bool = False


def check_pattern(pattern: Any, where: str) -> str:
    """A pattern must be text, short and readable, so that a bad one fails before the job starts."""
    if not isinstance(pattern, str):
        raise ConfigError(f"{where} requires a string pattern")
    if len(pattern) > MAX_PATTERN_LENGTH:
        raise ConfigError(f"{where} pattern exceeds {MAX_PATTERN_LENGTH} characters")
    try:
        re.compile(pattern)
    except re.error as error:
        raise ConfigError(f"{where} pattern is invalid: {error}") from error
    return pattern


def parse_predicates(specs: Iterable[Mapping[str, Any]]) -> list[Predicate]:
    if isinstance(specs, (str, Mapping)) or not isinstance(specs, Iterable):
        raise ConfigError("predicates must be a list")
    parsed = []
    for number, spec in enumerate(specs):
        where = f"predicates[{number}]"
        if not isinstance(spec, Mapping):
            raise ConfigError(f"{where} must be an object")
        column, op = spec.get("column"), spec.get("op")
        if not isinstance(column, str) or not column:
            raise ConfigError(f"{where}.column must be a non-empty string")
        if op not in OPERATORS:
            raise ConfigError(f"{where}.op must be one of: {', '.join(OPERATORS)}")
        if op in ("in", "not_in") and not isinstance(spec.get("value"), (list, tuple)):
            raise ConfigError(f'{where} with op "{op}" requires a list value')
        if op == "between" and ("value" not in spec or "high" not in spec):
            raise ConfigError(f'{where} with op "between" requires value and high')
        if op == "matches":
            check_pattern(spec.get("value"), where)
        parsed.append(
            Predicate(column, op, spec.get("value"), spec.get("high"), bool(spec.get("caseInsensitive", False)))
        )
    return parsed


def _number(value: Any) -> float | int | None:
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (int, float)):
        return value
    try:
        return float(str(value).strip())
    except ValueError:
        return None


def _literal_text(value: Any) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


def _operands(column: Column, data_type: T.DataType, value: Any) -> tuple[Column, Column]:
    """The two sides of a comparison, with the literal moved to the column's type.

    Only the literal is cast, so the comparison still reaches the parquet reader. A literal that
    cannot take the column's type is compared as text, which never equals and never fails.
    """
    if isinstance(data_type, T.BooleanType):
        number = _number(value)
        truth = value.lower() in TRUE_WORDS if isinstance(value, str) else bool(number)
        return column, F.lit(truth)
    if isinstance(data_type, (T.NumericType, T.DecimalType)):
        number = _number(value)
        if number is not None:
            if isinstance(number, float) and number.is_integer() and isinstance(data_type, T.IntegralType):
                number = int(number)
            return column, F.lit(number)
    elif isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        if not isinstance(value, (bool, int, float)):
            literal = F.lit(value).cast("string").try_cast(data_type)
            # An unreadable literal folds to NULL, and the comparison to "no match".
            return column, literal
        return column, F.timestamp_millis(F.lit(int(value))).cast(data_type)
    elif is_text(data_type) and isinstance(value, (int, float)) and not isinstance(value, bool):
        return column, F.lit(_literal_text(value))
    return as_text(column, data_type), F.lit(_literal_text(value))


def _compare(column: Column, data_type: T.DataType, op: str, value: Any) -> Column:
    if value is None:
        return F.lit(False)
    left, right = _operands(column, data_type, value)

    def test(a: Column, b: Column) -> Column:
        return {"eq": a == b, "ne": a != b, "gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]

    if is_text(data_type) and isinstance(value, (int, float)) and not isinstance(value, bool):
        # Text against a number: numbers where the text is one, text order otherwise.
        number = column.try_cast("double")
        return F.when(number.isNotNull(), test(number, F.lit(float(value)))).otherwise(test(left, right))
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)) and op == "ne":
        return F.when(right.isNull(), column.isNotNull()).otherwise(left != right)
    return test(left, right)


def predicate_column(df: DataFrame, predicate: Predicate) -> Column:
    """The predicate as a boolean column. NULL means "does not pass"."""
    field = df.schema[predicate.column]
    column, data_type = F.col(f"`{predicate.column}`"), field.dataType
    op, value = predicate.op, predicate.value

    if op == "null":
        return column.isNull()
    if op == "not_null":
        return column.isNotNull()
    if op in ("eq", "ne", "gt", "gte", "lt", "lte"):
        return _compare(column, data_type, op, value)
    if op in ("in", "not_in"):
        members = [_compare(column, data_type, "eq", item) for item in value if item is not None]
        literals = [_operands(column, data_type, item) for item in value if item is not None]
        uniform = not any(isinstance(i, (int, float)) for i in value) or not is_text(data_type)
        if members and uniform and len({str(left) for left, _ in literals}) == 1:
            found = literals[0][0].isin(*[right for _, right in literals])
        else:
            found = reduce(lambda a, b: a | b, members, F.lit(False))
        return found if op == "in" else column.isNotNull() & ~F.coalesce(found, F.lit(False))
    if op == "between":
        return _compare(column, data_type, "gte", value) & _compare(column, data_type, "lte", predicate.high)

    text = as_text(column, data_type)
    if op == "matches":
        return text.rlike(f"(?i){value}" if predicate.ignore_case else value)
    if value is None:
        return F.lit(False)
    needle = F.lit(_literal_text(value))
    if predicate.ignore_case:
        text, needle = F.lower(text), F.lower(needle)
    if op == "contains":
        return text.contains(needle)
    if op == "not_contains":
        return ~text.contains(needle)
    return text.startswith(needle) if op == "starts_with" else text.endswith(needle)


def filter_rows(
    df: DataFrame,
    predicates: Iterable[Predicate | Mapping[str, Any]],
    combine: str = "and",
    on_empty: str = "continue",
) -> DataFrame:
    """Keeps the rows that pass all (`and`) or any (`or`) of the predicates; no predicate keeps all rows."""
    given = list(predicates)
    parsed = [p for p in given if isinstance(p, Predicate)]
    if len(parsed) != len(given):
        parsed = parse_predicates(given)
    if combine not in ("and", "or"):
        raise ConfigError("combine must be and or or")
    missing = sorted({p.column for p in parsed} - set(df.columns))
    if missing:
        raise ConfigError(
            f"Filter references column(s) not present in the input: {', '.join(missing)}. "
            f"Available columns: {', '.join(df.columns)}"
        )
    kept = df
    if parsed:
        tests = [predicate_column(df, p) for p in parsed]
        kept = df.where(reduce((lambda a, b: a & b) if combine == "and" else (lambda a, b: a | b), tests))
    if on_empty == "fail" and kept.isEmpty():
        raise ValidationError("Filter removed every row and is configured to fail when empty")
    return kept
