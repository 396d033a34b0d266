"""Declared expectations of datasets, checked against recorded results and row counts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, functions as F

from weir.errors import ConfigError

# Which check type stands for which expectation.
EXPECTED_TYPES = {"notNull": "not_null", "unique": "unique", "nonNegative": "range"}


def check_expectations(expectations: Iterable[Mapping[str, Any]], results: DataFrame, datasets: DataFrame) -> DataFrame:
    """Rows `(dataset, expectation, target, passed, detail)`; a check that never ran fails.

    `results` has dataset, column, type, status; `datasets` has name and row_count.
    """
    bounds, columns = [], []
    for entry in expectations:
        dataset = entry.get("dataset")
        if not isinstance(dataset, str):
            raise ConfigError("an expectation must name its dataset")
        for key in ("minRows", "maxRows"):
            if entry.get(key) is not None:
                bounds.append((dataset, key, int(entry[key])))
        for key, kind in EXPECTED_TYPES.items():
            columns += [(dataset, key, name, kind) for name in entry.get(key) or ()]
    spark = results.sparkSession
    wanted_bounds = spark.createDataFrame(bounds, "dataset STRING, expectation STRING, bound BIGINT")
    wanted_columns = spark.createDataFrame(columns, "dataset STRING, expectation STRING, target STRING, kind STRING")

    sizes = datasets.select(F.col("name").alias("dataset"), "row_count")
    bounded = wanted_bounds.join(sizes, "dataset", "left").select(
        "dataset", "expectation", F.col("bound").cast("string").alias("target"),
        F.coalesce(
            F.when(F.col("expectation") == "minRows", F.col("row_count") >= F.col("bound")).otherwise(F.col("row_count") <= F.col("bound")),
            F.lit(False),
        ).alias("passed"),
        F.coalesce(F.col("row_count").cast("string"), F.lit("dataset not found")).alias("detail"),
    )
    verdicts = results.groupBy("dataset", F.col("column").alias("target"), F.col("type").alias("kind")).agg(
        F.bool_and(F.col("status") == "PASSED").alias("all_passed"), F.count(F.lit(1)).alias("n")
    )
    checked = wanted_columns.join(verdicts, ["dataset", "target", "kind"], "left").select(
        "dataset", "expectation", "target",
        F.coalesce("all_passed", F.lit(False)).alias("passed"),
        F.coalesce(
            F.concat(F.col("n").cast("string"), F.lit(" check(s) ran")),
            F.concat(F.lit("no "), F.col("kind"), F.lit(" check ran for "), F.col("target")),
        ).alias("detail"),
    )
    return bounded.unionByName(checked)
