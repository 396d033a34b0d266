"""Versioned schemas: fingerprints, registration, history, and the contract check of a table.

`versions` tables have one row per column of each version:
dataset, version, name, type, nullable, fingerprint, created_at.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from weir.contracts.evolve import SEVERITY, diff_schemas
from weir.contracts.infer import columns_table, infer_schema
from weir.errors import ConfigError, ValidationError

VERSIONS_SCHEMA = (
    "dataset STRING, version INT, name STRING, type STRING, nullable BOOLEAN, fingerprint STRING, created_at TIMESTAMP"
)


def fingerprints(columns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A 32-digit digest of each schema that does not depend on the order of its columns."""
    entry = F.concat_ws(":", "name", "type", F.when(F.col("nullable"), "null").otherwise("notnull"))
    # One entry per column of a schema.
    text = F.array_join(F.array_sort(F.collect_list(entry)), "|")
    return columns.groupBy(*by).agg(F.substring(F.sha2(text, 256), 1, 32).alias("fingerprint"))


def _latest(versions: DataFrame) -> DataFrame:
    newest = versions.groupBy("dataset").agg(F.max("version").alias("version"))
    return versions.join(newest, ["dataset", "version"])


def register(observed: DataFrame, versions: DataFrame, now: datetime | None = None) -> DataFrame:
    """The rows to append to `versions`: datasets whose fingerprint differs from their latest version.

    `observed` has dataset, name, type, nullable, for as many datasets as you like.
    """
    current = fingerprints(observed, ["dataset"])
    latest = versions.groupBy("dataset").agg(
        F.max("version").alias("last_version"), F.max_by("fingerprint", "version").alias("last_fingerprint")
    )
    changed = (
        current.join(latest, "dataset", "left")
        .where(~F.col("fingerprint").eqNullSafe(F.col("last_fingerprint")))
        .select("dataset", (F.coalesce("last_version", F.lit(0)) + 1).cast("int").alias("version"), "fingerprint")
    )
    stamp = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return observed.join(changed, "dataset").select(
        "dataset", "version", "name", "type", "nullable", "fingerprint", stamp.alias("created_at")
    )


def schema_history(versions: DataFrame) -> DataFrame:
    """Every change between consecutive versions: dataset, version (the newer one) and the change."""
    newer = versions.select("dataset", "version", "name", "type", "nullable")
    # Versions are numbered without gaps, so the previous one is found by an equi-join.
    older = newer.withColumn("version", F.col("version") + 1)
    both = newer.select("dataset", "version").distinct().join(older.select("dataset", "version").distinct(), ["dataset", "version"])
    older = older.join(both, ["dataset", "version"], "left_semi")
    followed = newer.join(both, ["dataset", "version"], "left_semi")
    return diff_schemas(older, followed, ["dataset", "version"])


def latest_changes(versions: DataFrame) -> DataFrame:
    """The changes between the last two versions of each dataset."""
    newest = versions.groupBy("dataset").agg(F.max("version").alias("newest"))
    last_two = versions.join(newest, "dataset").where(F.col("version") >= F.col("newest") - 1)
    return schema_history(last_two.drop("newest"))


@dataclass(frozen=True)
class ContractResult:
    df: DataFrame
    classification: str
    changes: list
    new_rows: DataFrame | None
    first_version: bool = False


def validate(
    df: DataFrame,
    dataset: str,
    versions: DataFrame | None = None,
    expected: Iterable[Mapping] = (),
    on_breaking: str = "fail",
    on_warning: str = "warn",
    register_changes: bool = True,
    now: datetime | None = None,
) -> ContractResult:
    """Compares a table with its contract (`expected`, else the latest registered version).

    The data passes through; `new_rows` is what to append to the versions table. The driver sees
    the columns of the two schemas, never rows of the data.
    """
    for rule in (on_breaking, on_warning):
        if rule not in ("fail", "warn"):
            raise ConfigError("on_breaking and on_warning must be fail or warn")
    spark = df.sparkSession
    # One scan of the data; everything after it works on a handful of rows.
    observed = columns_table(spark, [r.asDict() for r in infer_schema(df).orderBy("position").collect()], dataset)
    known = versions if versions is not None else spark.createDataFrame([], VERSIONS_SCHEMA)
    declared = list(expected)
    contract = columns_table(spark, declared, dataset) if declared else _latest(known.where(F.col("dataset") == dataset))
    if not declared and contract.isEmpty():
        rows = register(observed, known, now) if register_changes else None
        return ContractResult(df, "COMPATIBLE", [], rows, first_version=True)
    changes = diff_schemas(contract, observed).orderBy("column", "kind").collect()
    worst = max([c.classification for c in changes], key=SEVERITY.index, default="COMPATIBLE")
    if worst == "BREAKING" and on_breaking == "fail":
        names = ", ".join(c.column for c in changes if c.classification == "BREAKING")
        raise ValidationError(f'Schema change on "{dataset}" is BREAKING: {names}')
    if worst == "WARNING" and on_warning == "fail":
        raise ValidationError(f'Schema change on "{dataset}" needs review: {", ".join(c.column for c in changes)}')
    rows = register(observed, known, now) if register_changes and changes else None
    return ContractResult(df, worst, changes, rows)
