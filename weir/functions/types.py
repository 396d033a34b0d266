"""The eight logical types and how they map to Spark and to relational column types."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# The logical type names, widest use first.
LOGICAL_TYPES = ("string", "integer", "float", "boolean", "timestamp", "date", "json", "unknown")

# Column types used when a table is created over JDBC.
JDBC_TYPES = {
    "postgres": {
        "string": "text",
        "integer": "bigint",
        "float": "double precision",
        "boolean": "boolean",
        "timestamp": "timestamptz",
        "date": "date",
        "json": "jsonb",
        "unknown": "text",
    },
    "mysql": {
        "string": "text",
        "integer": "bigint",
        "float": "double",
        "boolean": "tinyint(1)",
        "timestamp": "datetime",
        "date": "date",
        "json": "json",
        "unknown": "text",
    },
    "derby": {
        "string": "varchar(32000)",
        "integer": "bigint",
        "float": "double",
        "boolean": "boolean",
        "timestamp": "timestamp",
        "date": "date",
        "json": "clob",
        "unknown": "varchar(32000)",
    },
}

SPARK_TYPES = {
    "string": T.StringType(),
    "integer": T.LongType(),
    "float": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "date": T.DateType(),
    "json": T.VariantType(),
    "unknown": T.StringType(),
}


def logical_type(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.IntegralType):
        return "integer"
    if isinstance(data_type, (T.FractionalType, T.DecimalType)):
        return "float"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(data_type, T.DateType):
        return "date"
    if isinstance(data_type, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return "json"
    if isinstance(data_type, T.NullType):
        return "unknown"
    return "string"


def is_nested(data_type: T.DataType) -> bool:
    return logical_type(data_type) == "json"


def is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StringType, T.CharType, T.VarcharType))


def as_text(column: Column, data_type: T.DataType) -> Column:
    """Text form of any value; nested values become JSON."""
    if is_text(data_type):
        return column
    if is_nested(data_type):
        return F.to_json(column)
    return column.cast("string")


def is_blank(column: Column, data_type: T.DataType) -> Column:
    """NULL or, for text, the empty string; never NULL itself."""
    if is_text(data_type):
        return column.isNull() | (column == "")
    return column.isNull()
