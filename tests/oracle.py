"""Runs registered queries against their SQL in DuckDB and compares rows and types.

    python tests/oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPE_NAMES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
}


def connect(folder: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, list):
        return tuple(value)
    return value


def compare(df, connection, sql: str) -> list[str]:
    """The differences, empty when both sides agree."""
    expected = connection.sql(sql)
    problems = []
    if sorted(df.columns) != sorted(expected.columns):
        return [f"columns {sorted(df.columns)} != {sorted(expected.columns)}"]
    names = sorted(df.columns)
    spark_types = dict(df.dtypes)
    duck_types = dict(zip(expected.columns, [str(t) for t in expected.types]))
    for name in names:
        if TYPE_NAMES.get(spark_types[name], spark_types[name]) != duck_types[name]:
            problems.append(f"type of {name}: {spark_types[name]} != {duck_types[name]}")
    got = Counter(tuple(_cell(v) for v in row) for row in df.select(*names).collect())
    want = Counter(tuple(_cell(v) for v in row) for row in expected.select(*[f'"{n}"' for n in names]).fetchall())
    if got != want:
        extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
        problems.append(f"rows {sum(got.values())} != {sum(want.values())}; only in spark {extra}; only in sql {missing}")
    return problems


def main() -> int:
    from pyspark.sql import SparkSession

    from weir.catalog import ORACLES, QUERIES
    from weir.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--plain", action="store_true", help="a session with Spark's defaults")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    folder = f"/root/testdata/sf{options.sf}"
    spark = SparkSession.builder.master("local[8]").getOrCreate() if options.plain else local_session(cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    failed = 0
    for name, function in QUERIES.items():
        if options.names and not any(n in name for n in options.names):
            continue
        start = time.time()
        try:
            df = function(spark, folder)
            problems = compare(df, connection, ORACLES[name]) if name in ORACLES else []
            note = "" if name in ORACLES else f" (no sql, {df.count()} rows)"
        except Exception as error:  # report and go on with the next query
            problems, note = [f"{type(error).__name__}: {str(error)[:600]}"], ""
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s{note}", *problems, sep="\n      " if problems else "", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
