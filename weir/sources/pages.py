"""Records out of landed API responses: a table of raw bodies, one row per fetched page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from weir.errors import ConfigError
from weir.sources.json import typed_records, variant_path

# How an API says that it has more.
PAGINATION = ("none", "page", "cursor")


def landed_records(
    responses: DataFrame,
    record_path: str | None = None,
    pagination: str = "page",
    cursor_path: str = "next_cursor",
    max_pages: int | None = None,
    source: Sequence[str] = ("source",),
    page: str = "page",
    body: str = "body",
    schema: str | None = None,
) -> DataFrame:
    """Keeps the pages a client would have read, and gives their records columns.

    A source ends before its first page without records; with cursors also after the first page whose
    cursor is missing or empty; without pagination after its first page. The end of each source is a
    small aggregate joined back, so a source with very many pages is still spread over many tasks.
    """
    if pagination not in PAGINATION:
        raise ConfigError(f"pagination must be one of: {', '.join(PAGINATION)}")
    parsed = responses.withColumn("__doc", F.parse_json(F.col(body)))
    found = F.try_variant_get("__doc", variant_path(record_path), "array<variant>")
    what = F.lit(f'Path "{record_path or ""}" did not resolve to an array')
    parsed = parsed.withColumn(
        "__records", F.when(found.isNull(), F.raise_error(what).cast("array<variant>")).otherwise(found)
    )
    number = F.col(page)
    ends = [F.min(F.when(F.size("__records") == 0, number)).alias("__empty")]
    if pagination == "cursor":
        cursor = F.try_variant_get("__doc", variant_path(cursor_path), "string")
        ends.append(F.min(F.when(cursor.isNull() | (cursor == ""), number)).alias("__last"))
    elif pagination == "none":
        ends.append(F.min(number).alias("__last"))
    else:
        ends.append(F.lit(None).cast("bigint").alias("__last"))
    limits = parsed.groupBy(*source).agg(*ends)
    kept = parsed.join(limits, list(source)).where(
        (F.col("__empty").isNull() | (number < F.col("__empty"))) & (F.col("__last").isNull() | (number <= F.col("__last")))
    )
    if max_pages is not None:
        kept = kept.where(number <= max_pages)
    exploded = kept.select(*source, page, F.explode("__records").alias("record"))
    return typed_records(exploded, schema=schema)
