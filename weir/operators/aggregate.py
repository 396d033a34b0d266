"""Grouped measures. Every measure keeps a partial (map-side) form, so a hot group never reaches one task whole."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from weir.errors import ConfigError
from weir.functions.types import as_text, is_nested, is_text

# The measure functions.
FUNCTIONS = ("sum", "avg", "min", "max", "count", "count_distinct", "first", "last")

_POSITION = "__row_position"


@dataclass(frozen=True)
class Measure:
    fn: str
    column: str | None
    name: str


def parse_measures(specs: Iterable[Mapping[str, Any]]) -> list[Measure]:
    if isinstance(specs, (str, Mapping)) or not isinstance(specs, Iterable):
        raise ConfigError("measures must be a non-empty list")
    parsed = []
    for number, spec in enumerate(specs):
        if not isinstance(spec, Mapping):
            raise ConfigError(f"measures[{number}] must be an object")
        fn, column = spec.get("fn"), spec.get("column")
        if fn not in FUNCTIONS:
            raise ConfigError(f"measures[{number}].fn must be one of: {', '.join(FUNCTIONS)}")
        if fn != "count" and not isinstance(column, str):
            raise ConfigError(f'measures[{number}] with fn "{fn}" requires a column')
        name = spec.get("as") or (f"{fn}_{column}" if isinstance(column, str) else fn)
        if not isinstance(name, str):
            raise ConfigError(f"measures[{number}].as must be a non-empty string")
        parsed.append(Measure(fn, column if isinstance(column, str) else None, name))
    if not parsed:
        raise ConfigError("measures must be a non-empty list")
    return parsed


def _numeric(column: Column, data_type: T.DataType, measure: Measure) -> Column:
    if isinstance(data_type, T.NumericType):
        return column
    if isinstance(data_type, T.BooleanType):
        return column.cast("bigint")
    if is_text(data_type):
        failure = F.raise_error(
            F.concat(F.lit(f'Measure "{measure.name}" cannot {measure.fn} non-numeric value '), column)
        ).cast("double")
        number = column.try_cast("double")
        return F.when(column.isNotNull() & number.isNull(), failure).otherwise(number)
    raise ConfigError(f'Measure "{measure.name}" cannot {measure.fn} column "{measure.column}" of type {data_type.simpleString()}')


def _measure_column(df: DataFrame, measure: Measure, order: Sequence[Column]) -> Column:
    if measure.fn == "count":
        return F.count(F.lit(1))
    column, data_type = F.col(f"`{measure.column}`"), df.schema[measure.column].dataType
    if measure.fn == "sum":
        return F.sum(_numeric(column, data_type, measure))
    if measure.fn == "avg":
        return F.avg(_numeric(column, data_type, measure).cast("double"))
    if measure.fn == "min":
        return F.min(column)
    if measure.fn == "max":
        return F.max(column)
    if measure.fn == "count_distinct":
        return F.count_distinct(as_text(column, data_type) if is_nested(data_type) else column)
    # The value of the extreme row survives even when it is NULL.
    key = F.struct(*order)
    return F.min_by(column, key) if measure.fn == "first" else F.max_by(column, key)


def aggregate(
    df: DataFrame,
    measures: Iterable[Measure | Mapping[str, Any]],
    group_by: Sequence[str] = (),
    order_by: Sequence[str] = (),
) -> DataFrame:
    """One row per group, or one row in all without `group_by`.

    `first` and `last` follow `order_by`; without it they follow the position of the rows in their
    files, which is only as stable as the layout of the input.
    """
    given = list(measures)
    parsed = given if given and all(isinstance(m, Measure) for m in given) else parse_measures(given)
    wanted = [*group_by, *order_by, *[m.column for m in parsed if m.column]]
    for name in wanted:
        if name not in df.columns:
            raise ConfigError(f'Aggregate references unknown column "{name}". Available columns: {", ".join(df.columns)}')
    ordered = any(m.fn in ("first", "last") for m in parsed)
    source = df
    order = [F.col(f"`{name}`") for name in order_by]
    if ordered and not order:
        source = df.withColumn(_POSITION, F.monotonically_increasing_id())
        order = [F.col(_POSITION)]
    columns = [_measure_column(df, m, order).alias(m.name) for m in parsed]
    return source.groupBy(*[F.col(f"`{g}`") for g in group_by]).agg(*columns)


def string_agg(df: DataFrame, group_by: Sequence[str], column: str, name: str, separator: str = ",", distinct: bool = False) -> DataFrame:
    """The values of each group, sorted and joined; NULLs are left out.

    With `distinct` duplicates go first, in a partial aggregation, so the final task sees each value once.
    """
    values = df.select(*group_by, F.col(column).cast("string").alias("__value"))
    return (values.distinct() if distinct else values).groupBy(*group_by).agg(
        F.expr(f"listagg(__value, '{separator.replace(chr(39), chr(39) * 2)}') WITHIN GROUP (ORDER BY __value)").alias(name)
    )
