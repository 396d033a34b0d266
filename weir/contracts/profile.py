"""Column statistics of a whole table, one row per column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from weir.contracts.infer import _class_bit, _type_of_bits
from weir.functions.types import as_text, is_blank, is_text, logical_type
from weir.operators.sort import capped

# Samples per column, and rows of a preview unless the caller says otherwise.
SAMPLES = 5
PREVIEW_ROWS = 100


def profile(df: DataFrame, exact_distinct: bool = False, samples: bool = False) -> DataFrame:
    """name, type, nullable, null_count, unique_count, min, max (as text), and optionally samples.

    The profile is one partial aggregation; distinct counts are estimates unless `exact_distinct` asks for a
    shuffle of every value of every column.
    """
    measures, entries = [F.count(F.lit(1)).alias("n")], []
    for i, field in enumerate(df.schema.fields):
        column, text = F.col(f"`{field.name}`"), is_text(field.dataType)
        blank = is_blank(column, field.dataType)
        kind = logical_type(field.dataType)
        # Only nested values need a text form to be compared; others are cheaper as they are.
        value = F.when(~blank, as_text(column, field.dataType) if kind == "json" else column)
        measures += [
            F.count_if(blank).alias(f"b{i}"),
            (F.count_distinct(value) if exact_distinct else F.approx_count_distinct(value)).alias(f"u{i}"),
        ]
        low = high = F.lit(None).cast("string")
        if text:
            # The type is only known once all rows are seen, so both orders are measured.
            number = value.try_cast("double")
            measures += [
                F.bit_or(F.when(~blank, _class_bit(column))).alias(f"t{i}"),
                F.min(number).alias(f"ln{i}"), F.max(number).alias(f"hn{i}"),
                F.min(value).alias(f"lt{i}"), F.max(value).alias(f"ht{i}"),
            ]
            type_column = _type_of_bits(F.col(f"t{i}"))
            numeric, temporal = type_column.isin("integer", "float"), type_column.isin("date", "timestamp")
            low = F.when(numeric, F.col(f"ln{i}").cast("string")).when(temporal, F.col(f"lt{i}"))
            high = F.when(numeric, F.col(f"hn{i}").cast("string")).when(temporal, F.col(f"ht{i}"))
        else:
            type_column = F.when(F.col(f"b{i}") == F.col("n"), "unknown").otherwise(kind)
            if kind in ("integer", "float", "date", "timestamp"):
                measures += [F.min(column).alias(f"l{i}"), F.max(column).alias(f"h{i}")]
                low, high = F.col(f"l{i}").cast("string"), F.col(f"h{i}").cast("string")
        entries.append(
            F.struct(
                F.lit(i).alias("position"), F.lit(field.name).alias("name"), type_column.alias("type"),
                (F.col(f"b{i}") > 0).alias("nullable"), F.col(f"b{i}").alias("null_count"),
                F.col(f"u{i}").alias("unique_count"), low.alias("min"), high.alias("max"),
            )
        )
    profiled = df.agg(*measures).select(F.inline(F.array(*entries)))
    return profiled.join(_samples(df), "name", "left") if samples else profiled


def _samples(df: DataFrame) -> DataFrame:
    """A few distinct values per column out of all rows: the least one of each of SAMPLES groups of hashes."""
    lists = []
    for i, field in enumerate(df.schema.fields):
        column = F.col(f"`{field.name}`")
        value = F.when(~is_blank(column, field.dataType), as_text(column, field.dataType))
        group = F.pmod(F.xxhash64(value), F.lit(SAMPLES))
        lists.append(F.array_sort(F.array_compact(F.array(*[F.min(F.when(group == g, value)) for g in range(SAMPLES)]))).alias(f"s{i}"))
    entries = [F.struct(F.lit(f.name).alias("name"), F.col(f"s{i}").alias("sample")) for i, f in enumerate(df.schema.fields)]
    return df.agg(*lists).select(F.inline(F.array(*entries)))


@dataclass(frozen=True)
class Preview:
    rows: DataFrame
    profile: DataFrame
    truncated: bool


def preview(df: DataFrame, limit: int = PREVIEW_ROWS) -> Preview:
    """The first rows, with the profile of those rows."""
    head = capped(df, limit)
    return Preview(head.df, profile(head.df, exact_distinct=True, samples=True), head.truncated)
