"""Ordering, limits, keyset pages and capped reads."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from weir.errors import ConfigError
from weir.functions.ordering import sort_columns

# Rows of a page unless the caller says otherwise.
DEFAULT_PAGE = 50


def order_by(df: DataFrame, keys: Iterable) -> DataFrame:
    """Sorts with NULLs as the largest value, unless a key says otherwise."""
    return df.orderBy(*sort_columns(keys))


def top_k(df: DataFrame, keys: Iterable, k: int) -> DataFrame:
    """Sort and limit in one, which Spark runs as a per-task heap with no full sort."""
    return df.orderBy(*sort_columns(keys)).limit(k)


def limit_offset(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    if offset < 0 or (limit is not None and limit < 0):
        raise ConfigError("LIMIT and OFFSET must not be negative")
    shifted = df.offset(offset) if offset else df
    return shifted if limit is None else shifted.limit(limit)


def distinct_rows(df: DataFrame, keys: Iterable = ()) -> DataFrame:
    """Distinct before the sort, so the order survives."""
    columns = sort_columns(keys)
    return df.distinct().orderBy(*columns) if columns else df.distinct()


@dataclass(frozen=True)
class Capped:
    df: DataFrame
    truncated: bool


def capped(df: DataFrame, limit: int) -> Capped:
    """The first `limit` rows, and whether there were more. Spark stops reading once it has enough."""
    if limit < 1:
        raise ConfigError("limit must be at least 1")
    return Capped(df.limit(limit), df.limit(limit + 1).count() > limit)


def encode_cursor(value: str, row_id: str) -> str:
    return base64.urlsafe_b64encode(f"{value}\x00{row_id}".encode()).decode().rstrip("=")


def decode_cursor(cursor: str | None) -> tuple[str, str] | None:
    if not cursor:
        return None
    try:
        text = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode()
    except ValueError:
        return None
    value, separator, row_id = text.partition("\x00")
    return (value, row_id) if separator else None


def page_size(limit: int | None) -> int:
    if limit is not None and limit < 1:
        raise ConfigError("a page has at least one row")
    return DEFAULT_PAGE if limit is None else int(limit)


@dataclass(frozen=True)
class Page:
    df: DataFrame
    value_column: str
    id_column: str
    size: int

    def next_cursor(self) -> str | None:
        """Runs the page, one row more than its size, and names the place where the next one starts."""
        rows = self.df.select(
            F.col(self.value_column).cast("string"), F.col(self.id_column).cast("string")
        ).take(self.size + 1)
        return encode_cursor(*rows[self.size - 1]) if len(rows) > self.size else None

    @property
    def rows(self) -> DataFrame:
        return self.df.limit(self.size)


def keyset_page(
    df: DataFrame,
    value_column: str,
    id_column: str,
    cursor: str | Sequence | None = None,
    limit: int | None = None,
    direction: str = "desc",
) -> Page:
    """The page after `cursor` in (value, id) order. The seek predicate reaches the scan."""
    if direction not in ("asc", "desc"):
        raise ConfigError("direction must be asc or desc")
    position = decode_cursor(cursor) if isinstance(cursor, str) else cursor
    source = df
    if position is not None:
        value = F.lit(position[0]).cast(df.schema[value_column].dataType)
        row_id = F.lit(position[1]).cast(df.schema[id_column].dataType)
        v, i = F.col(value_column), F.col(id_column)
        beyond = (v < value) | ((v == value) & (i < row_id)) if direction == "desc" else (v > value) | ((v == value) & (i > row_id))
        source = df.where(beyond)
    size = page_size(limit)
    ordered = source.orderBy(*sort_columns([(value_column, direction), (id_column, direction)]))
    return Page(ordered.limit(size + 1), value_column, id_column, size)
