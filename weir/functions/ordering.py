"""Sort order of the dialect: NULLs are the largest value, as in PostgreSQL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from weir.errors import ConfigError

SortKey = "str | tuple[str | Column, str] | tuple[str | Column, str, str] | Column"


def sort_column(key) -> Column:
    """`"c"`, `("c", "desc")` or `("c", "desc", "last")`; a Column is taken as ascending."""
    parts = key if isinstance(key, tuple) else (key,)
    column = F.col(parts[0]) if isinstance(parts[0], str) else parts[0]
    direction = parts[1].lower() if len(parts) > 1 else "asc"
    if direction not in ("asc", "desc"):
        raise ConfigError(f"sort direction must be asc or desc, got {direction!r}")
    nulls = parts[2].lower() if len(parts) > 2 else ("last" if direction == "asc" else "first")
    if nulls not in ("first", "last"):
        raise ConfigError(f"null order must be first or last, got {nulls!r}")
    method = f"{direction}_nulls_{nulls}"
    return getattr(column, method)()


def sort_columns(keys: Iterable) -> list[Column]:
    return [sort_column(key) for key in keys]
