"""Files and objects by path or key, in CSV, JSON or NDJSON, with templated target keys."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from weir.errors import ConfigError
from weir.sources.csv import read_csv, write_csv
from weir.sources.json import read_json, read_ndjson, write_ndjson

# Object formats.
FORMATS = ("csv", "json", "ndjson")


@dataclass(frozen=True)
class RunInfo:
    """What templates can refer to."""

    id: str = "run"
    pipeline: str = ""
    version: int = 1
    queued_at: str = "1970-01-01T00:00:00.000Z"
    logical_date: str | None = None
    params: Mapping[str, Any] = field(default_factory=dict)

    @staticmethod
    def at(moment: datetime, **values) -> RunInfo:
        return RunInfo(queued_at=moment.strftime("%Y-%m-%dT%H:%M:%S.000Z"), **values)


def render(template: str, run: RunInfo) -> str:
    """Fills `{{ run.* }}` and `{{ params.a.b }}`; what it does not know is left as written."""
    moment = run.logical_date or run.queued_at
    known = {
        "run.id": run.id, "run.date": moment[:10], "run.logicalDate": moment, "run.pipeline": run.pipeline,
        "run.version": str(run.version),
    }

    def value(match: re.Match) -> str:
        path = match.group(1)
        if path in known:
            return known[path]
        root, _, rest = path.partition(".")
        if root != "params" or not rest:
            return match.group(0)
        current: Any = run.params
        for part in rest.split("."):
            current = current.get(part) if isinstance(current, Mapping) else None
        return match.group(0) if current is None else str(current)

    return re.sub(r"\{\{\s*([a-zA-Z0-9_.]+)\s*\}\}", value, template)


def read_object(spark: SparkSession, path: str, fmt: str = "csv", limit: int | None = None, **options) -> DataFrame:
    """Any Hadoop path: `s3a://bucket/key`, `hdfs://...`, `file:///...`."""
    if fmt not in FORMATS:
        raise ConfigError(f"format must be one of: {', '.join(FORMATS)}")
    if fmt == "csv":
        return read_csv(spark, path, limit=limit, **options)
    df = read_json(spark, path, **options) if fmt == "json" else read_ndjson(spark, path, **options)
    return df if limit is None else df.limit(limit)


def write_object(df: DataFrame, key: str, run: RunInfo, fmt: str = "csv", partition_by: Sequence[str] = ()) -> str:
    """Overwrites the rendered key. With `partition_by` only the partitions present in the data are replaced."""
    if fmt not in FORMATS:
        raise ConfigError(f"format must be one of: {', '.join(FORMATS)}")
    path = render(key, run)
    if fmt == "csv":
        write_csv(df, path, partition_by=partition_by)
    elif partition_by:
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
        writer.option("ignoreNullFields", "false").json(path)
    elif fmt == "ndjson":
        write_ndjson(df, path)
    else:
        # Each part file is one JSON array, so that no task has to hold the whole table.
        objects = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
        objects.mapInArrow(_array_document, "value STRING").write.mode("overwrite").option("lineSep", "\n").text(path)
    return path


def _array_document(batches):
    """Lines of one partition as the lines of a JSON array."""
    import pyarrow as pa

    previous = None
    first = True
    for batch in batches:
        lines = []
        for text in batch.column(0).to_pylist():
            if previous is not None:
                lines.append(("[" if first else "") + previous + ",")
                first = False
            previous = text
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
    last = ("[" if first else "") + (previous or "") + "]"
    yield pa.RecordBatch.from_arrays([pa.array([last], pa.string())], ["value"])
