"""Projections: named expressions, flattening, record paths and collision renaming."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from weir.errors import ConfigError


def project(df: DataFrame, columns: Mapping[str, Column | str]) -> DataFrame:
    """`{output name: expression}`; text is a SQL expression."""
    return df.select(*[(F.expr(e) if isinstance(e, str) else e).alias(name) for name, e in columns.items()])


def rename_collisions(left: DataFrame, right: DataFrame, prefix: str) -> tuple[DataFrame, dict[str, str]]:
    """The right side with colliding columns prefixed, and its old-to-new names."""
    taken = set(left.columns)
    names = {name: (prefix + name if name in taken else name) for name in right.columns}
    produced = list(names.values())
    clash = sorted({n for n in produced if n in taken or produced.count(n) > 1})
    if clash:
        raise ConfigError(f"column(s) {', '.join(clash)} still collide after adding the prefix {prefix!r}")
    return right.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()]), names


def flatten_once(df: DataFrame) -> DataFrame:
    """Object fields `k` become columns `k_sub`, one level deep; arrays and deeper objects stay as they are.

    A later column replaces an earlier one of the same name, keeping the earlier position.
    """
    columns: dict[str, Column] = {}
    for field in df.schema.fields:
        source = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StructType):
            for sub in field.dataType.fields:
                columns[f"{field.name}_{sub.name}"] = source.getField(sub.name)
        else:
            columns[field.name] = source
    return df.select(*[column.alias(name) for name, column in columns.items()])


def record_path(df: DataFrame, path: str) -> DataFrame:
    """Rows of the array found at a dotted path; structs become columns, other elements a `value` column."""
    segments = [s for s in path.split(".") if s]
    if not segments:
        return df
    data_type: T.DataType = df.schema
    column: Column | None = None
    for segment in segments:
        if not isinstance(data_type, T.StructType) or segment not in data_type.fieldNames():
            raise ConfigError(f'Path "{path}" did not resolve to an array')
        column = F.col(f"`{segment}`") if column is None else column.getField(segment)
        data_type = data_type[segment].dataType
    if not isinstance(data_type, T.ArrayType):
        raise ConfigError(f'Path "{path}" did not resolve to an array')
    records = df.select(F.explode(column).alias("value"))
    return records.select("value.*") if isinstance(data_type.elementType, T.StructType) else records
