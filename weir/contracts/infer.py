"""Schema inference over all rows, in one aggregation, and coercion to what was inferred."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from weir.functions.scalar import coerce_boolean
from weir.functions.types import SPARK_TYPES, is_blank, is_text, logical_type

# The text patterns of each type, tried in this order. A run of more than 15 digits
# is an identifier, not a number.
TEXT_CLASSES = (
    ("timestamp", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?\z"),
    ("date", r"^\d{4}-\d{2}-\d{2}\z"),
    ("integer", r"^[+-]?\d{1,15}\z"),
    ("float", r"^[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?\z|^[+-]?\d+[eE][+-]?\d+\z"),
    ("boolean", r"(?i)^(true|false)\z"),
)
_BITS = {name: 1 << i for i, (name, _) in enumerate(TEXT_CLASSES)} | {"string": 1 << len(TEXT_CLASSES)}

# Columns handled by one aggregation; wider tables use several.
COLUMNS_PER_PASS = 200


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    nullable: bool


def unify(types: Iterable[str]) -> str:
    """The narrowest type that holds all the given ones."""
    seen = set(types) - {"unknown"}
    if not seen:
        return "unknown"
    if len(seen) == 1:
        return next(iter(seen))
    if "json" in seen:
        return "json"
    if seen == {"integer", "float"}:
        return "float"
    if seen == {"date", "timestamp"}:
        return "timestamp"
    return "string"


def _class_bit(column: Column) -> Column:
    """The bit of the first pattern the text matches.

    Length and first character rule most patterns out without running them.
    """
    patterns = dict(TEXT_CLASSES)
    length, first = F.length(column), F.substring(column, 1, 1)
    numeric_start = first.isin(*"0123456789+-.")
    return (
        F.when(length.isin(4, 5) & F.lower(column).isin("true", "false"), _BITS["boolean"])
        .when(~numeric_start, _BITS["string"])
        .when((length >= 16) & column.rlike(patterns["timestamp"]), _BITS["timestamp"])
        .when((length == 10) & column.rlike(patterns["date"]), _BITS["date"])
        .when((length <= 16) & column.rlike(patterns["integer"]), _BITS["integer"])
        .when(column.rlike(patterns["float"]), _BITS["float"])
        .otherwise(_BITS["string"])
    )


def _type_of_bits(bits: Column) -> Column:
    """`unify` over the set of observed classes, as an expression."""
    only = reduce(lambda acc, item: acc.when(bits == item[1], item[0]), _BITS.items(), F.when(bits.isNull(), "unknown"))
    return (
        only.when(bits == _BITS["integer"] | _BITS["float"], "float")
        .when(bits == _BITS["date"] | _BITS["timestamp"], "timestamp")
        .otherwise("string")
    )


def infer_schema(df: DataFrame, null_values: Sequence[str] = ()) -> DataFrame:
    """One row per column: position, name, type, nullable. Nullability is what the data shows.

    Text columns are classified by pattern; other columns keep their own type.
    """
    parts = [
        _infer_pass(df, df.schema.fields[i : i + COLUMNS_PER_PASS], i, null_values)
        for i in range(0, len(df.schema.fields), COLUMNS_PER_PASS)
    ]
    return reduce(DataFrame.unionByName, parts)


def _infer_pass(df: DataFrame, fields: Sequence[T.StructField], start: int, null_values: Sequence[str]) -> DataFrame:
    measures, entries = [F.count(F.lit(1)).alias("n")], []
    for i, field in enumerate(fields):
        column = F.col(f"`{field.name}`")
        blank = is_blank(column, field.dataType)
        if is_text(field.dataType) and null_values:
            blank = blank | column.isin(*null_values)
        measures.append(F.count_if(blank).alias(f"b{i}"))
        if is_text(field.dataType):
            measures.append(F.bit_or(F.when(~blank, _class_bit(column))).alias(f"t{i}"))
            kind = _type_of_bits(F.col(f"t{i}"))
        else:
            kind = F.when(F.col(f"b{i}") == F.col("n"), "unknown").otherwise(logical_type(field.dataType))
        entries.append(
            F.struct(
                F.lit(start + i).alias("position"), F.lit(field.name).alias("name"), kind.alias("type"),
                (F.col(f"b{i}") > 0).alias("nullable"),
            )
        )
    return df.agg(*measures).select(F.inline(F.array(*entries)))


def infer_columns(df: DataFrame, null_values: Sequence[str] = ()) -> list[ColumnSpec]:
    """The inferred schema on the driver: one entry per column."""
    return [ColumnSpec(r.name, r.type, r.nullable) for r in infer_schema(df, null_values).orderBy("position").collect()]


def probe(df: DataFrame, rows: int | None = None) -> list[ColumnSpec]:
    """A look at a source: the columns and types that all rows show, or the first `rows` if the caller wants no more."""
    return infer_columns(df if rows is None else df.limit(rows))


def columns_table(df_or_session, columns: Iterable[ColumnSpec | Mapping], dataset: str | None = None) -> DataFrame:
    """A contract given as a list, as a table like the one `infer_schema` returns."""
    spark = df_or_session.sparkSession if isinstance(df_or_session, DataFrame) else df_or_session
    specs = [c if isinstance(c, ColumnSpec) else ColumnSpec(c["name"], c["type"], bool(c.get("nullable", True))) for c in columns]
    table = spark.createDataFrame(
        [(i, c.name, c.type, c.nullable) for i, c in enumerate(specs)],
        "position INT, name STRING, type STRING, nullable BOOLEAN",
    )
    return table if dataset is None else table.withColumn("dataset", F.lit(dataset))


def coerce_column(column: Column, kind: str) -> Column:
    """Text to the logical type; what cannot be read becomes NULL."""
    if kind == "integer":
        return column.try_cast("bigint")
    if kind == "float":
        return column.try_cast("double")
    if kind == "boolean":
        return coerce_boolean(column)
    if kind == "json":
        return F.try_parse_json(column)
    if kind in ("date", "timestamp"):
        return column.try_cast(SPARK_TYPES[kind])
    return column


def coerce(df: DataFrame, columns: Iterable[ColumnSpec]) -> DataFrame:
    """Casts the text columns of a table to the given types; other columns stay."""
    kinds = {c.name: c.type for c in columns}
    return df.select(
        *[
            (coerce_column(F.col(f"`{f.name}`"), kinds.get(f.name, "string")) if is_text(f.dataType) else F.col(f"`{f.name}`")).alias(f.name)
            for f in df.schema.fields
        ]
    )
