"""Every operator as a registered query over the test tables, with the SQL that gives the same rows."""

from weir.catalog import aggregates, filters, incremental, joins, lineages, quality_checks, runlogs, scalars, schemas, sorts, sources
from weir.catalog.registry import ORACLES, QUERIES

__all__ = [
    "ORACLES", "QUERIES", "aggregates", "filters", "incremental", "joins", "lineages", "quality_checks", "runlogs", "scalars",
    "schemas", "sorts", "sources",
]
