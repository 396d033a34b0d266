"""User Python over rows, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weir.errors import ValidationError

Rows = list[dict]


def _checked(result, name: str) -> Rows:
    if result is None:
        return []
    if not isinstance(result, list) or not all(isinstance(r, dict) for r in result):
        raise TypeError(f"{name} must return a list of dicts")
    return result


def map_rows(df: DataFrame, function: Callable[[Rows], Rows], schema) -> DataFrame:
    """Runs `function(rows) -> rows` on batches of rows. It must not depend on rows of other batches."""
    names = [f.name for f in _fields(df, schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _checked(function(batch.to_pylist()), function.__name__)
            columns = {n: [r.get(n) for r in rows] for n in names}
            if rows:
                yield from pa.table({n: pa.array(v, type=arrow_types[n]) for n, v in columns.items()}).to_batches()

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_types = {f.name: to_arrow_type(f.dataType) for f in _fields(df, schema)}
    return df.mapInArrow(run, schema)


def map_groups(
    df: DataFrame, keys: Sequence[str], function: Callable[[Rows], Rows], schema, max_group_rows: int = 1_000_000
) -> DataFrame:
    """Runs the function on whole groups. Every group must fit one task, so their sizes are checked first."""
    largest = df.groupBy(*keys).count().agg(F.max("count")).head()[0] or 0
    if largest > max_group_rows:
        raise ValidationError(f"a group has {largest} rows, more than {max_group_rows}; use finer keys or map_rows")
    names = [f.name for f in _fields(df, schema)]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.astype(object).where(group.notna(), None).to_dict("records")
        return pd.DataFrame(_checked(function(rows), function.__name__), columns=names)

    return df.groupBy(*keys).applyInPandas(run, schema)


def _fields(df: DataFrame, schema):
    if isinstance(schema, str):
        return df.sparkSession.createDataFrame([], schema).schema.fields
    return schema.fields
