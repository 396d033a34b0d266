"""Relational tables over JDBC: guarded reads, high-watermark reads, append, replace and upsert."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce
from itertools import pairwise
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from weir.errors import ConfigError
from weir.functions.types import JDBC_TYPES, logical_type

# Stretches of values that are counted at once, and cut again where they hold too many rows.
STRETCHES = 64

# Fixed value: what a table or column may be called.
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_$]{0,62}"


def check_identifier(name: str, what: str = "identifier") -> str:
    if not re.fullmatch(IDENTIFIER, name):
        raise ConfigError(
            f'"{name}" cannot be a {what}: up to 63 letters, digits, underscores or $, not starting with a digit or $'
        )
    return name


def check_table(name: str) -> str:
    parts = name.split(".")
    if len(parts) > 2:
        raise ConfigError(f'"{name}" is not a table or schema.table')
    for part in parts:
        check_identifier(part, "table name")
    return name


# Text in quotes, and comments.
_QUOTED = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|--[^\n]*|/\*.*?\*/""", re.DOTALL)


def check_read_only(query: str) -> str:
    """The query without comments, if it is one statement that can stand as a table.

    It is sent as `SELECT ... FROM (query) t`, where a database takes nothing but a query; what has to be kept out here is a
    second statement, and a changing one in parentheses, as some allow in WITH. What stands inside quotes is text.
    """
    plain = _QUOTED.sub(lambda m: " " if m[0].startswith(("--", "/*")) else m[0], query).strip().removesuffix(";").rstrip()
    if not plain:
        raise ConfigError("The source query is empty")
    bare = _QUOTED.sub("", plain).lower()
    if ";" in bare:
        raise ConfigError("The source query has more than one statement")
    if not re.match(r"(select|with|values|table|\()", bare.lstrip()) or re.search(r"\(\s*(insert|update|delete|merge)\b", bare):
        raise ConfigError("The source query does not only read")
    return plain


def dialect_of(url: str) -> str:
    name = url.split(":")[1] if url.startswith("jdbc:") else ""
    return {"postgresql": "postgres", "mysql": "mysql", "mariadb": "mysql", "derby": "derby"}.get(name, "postgres")


def _quote(url: str, name: str) -> str:
    mark = "`" if dialect_of(url) == "mysql" else '"'
    return ".".join(f"{mark}{part}{mark}" for part in name.split("."))


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str | None = None,
    query: str | None = None,
    limit: int | None = None,
    partition: Mapping[str, Any] | None = None,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """A table or a read-only query. Filters, projections and limits are pushed to the database.

    `partition` holds column and parts, and spreads the read over that many connections. With lower and upper each reads an
    equal stretch of the column's values; without them the database counts the rows of ranges, and each reads about as many rows.
    """
    if (table is None) == (query is None):
        raise ConfigError("give either a table or a query")
    # A query is passed as a derived table because only those can be read in partitions.
    source = _quote(url, check_table(table)) if table else f"({check_read_only(query)}) weir_source"
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", source).options(**dict(properties or {}))
    if partition and "lower" not in partition:
        shares = equal_shares(spark, url, source, check_identifier(partition["column"], "column"), int(partition["parts"]), properties)
        df = spark.read.jdbc(url, source, predicates=shares, properties=dict(properties or {}))
        return df if limit is None else df.limit(limit)
    if partition:
        reader = (
            reader.option("partitionColumn", check_identifier(partition["column"], "column"))
            .option("lowerBound", str(partition["lower"]))
            .option("upperBound", str(partition["upper"]))
            .option("numPartitions", str(partition["parts"]))
        )
    df = reader.load()
    return df if limit is None else df.limit(limit)


def equal_shares(
    spark: SparkSession, url: str, source: str, column: str, parts: int, properties: Mapping[str, str] | None = None
) -> list[str]:
    """Conditions on a number column that cut a source into about `parts` shares with about the same number of rows.

    The database counts the rows of equal stretches of values; a stretch that holds more than a quarter of a share is cut
    again, until it is small enough or a single value. The driver sees counts of stretches only. NULLs are in the first share.
    """
    name = _quote(url, column)

    def ask(query: str) -> list:
        return spark.read.format("jdbc").options(url=url, dbtable=f"({query}) weir_counts", **dict(properties or {})).load().collect()

    low, high, rows = ask(f"SELECT MIN({name}) AS low, MAX({name}) AS high, COUNT({name}) AS n FROM {source}")[0]
    if not rows or parts < 2:
        return ["1 = 1"]
    whole = isinstance(low, int)
    if not whole and not isinstance(low, (float, Decimal)):
        raise ConfigError(f'"{column}" is not a number; give lower and upper')
    low, high = (int(low), int(high) + 1) if whole else (float(low), math.nextafter(float(high), math.inf))
    share, done, open_ranges = rows / parts, [], [(low, high, rows)]
    while open_ranges:
        asked, steps = [], {}
        for number, (a, b, _) in enumerate(open_ranges):
            step = max(1, -(-(b - a) // STRETCHES)) if whole else (b - a) / STRETCHES
            steps[number] = a, b, step
            inner = f"SELECT FLOOR(({name} - {a}) / {step}) AS b FROM {source} WHERE {name} >= {a} AND {name} < {b}"
            asked.append(f"SELECT {number} AS r, b, COUNT(*) AS n FROM ({inner}) u{number} GROUP BY b")
        open_ranges = []
        for number, bin, count in ask(" UNION ALL ".join(asked)):
            a, b, step = steps[int(number)]
            left = a + int(bin) * step
            right = min(left + step, b)
            finer = (right - left > 1) if whole else (left < left + step / STRETCHES < right)
            (open_ranges if count > share / 4 and finer else done).append((left, right, count))
    borders, held = [], 0
    for left, _, count in sorted(done):
        if held and held + count / 2 > share:
            borders.append(left)
            held = 0
        held += count
    if not borders:
        return ["1 = 1"]
    between = [f"{name} >= {a} AND {name} < {b}" for a, b in pairwise(borders)]
    return [f"{name} < {borders[0]} OR {name} IS NULL", *between, f"{name} >= {borders[-1]}"]


def incremental(df: DataFrame, column: str, since: Any = None) -> DataFrame:
    """Rows beyond the watermark; all rows when there is none. Works on any source and is pushed down."""
    if column not in df.columns:
        raise ConfigError(f'incremental column "{column}" is not in the source')
    return df if since is None else df.where(F.col(column) > F.lit(since).cast(df.schema[column].dataType))


def next_watermark(df: DataFrame, column: str, since: Any = None) -> Any:
    """The largest value read, to be stored once the sink has committed; unchanged when nothing came."""
    newest = df.agg(F.max(column)).head()[0]
    return since if newest is None else newest


def _execute(spark: SparkSession, url: str, statements: Sequence[str], properties: Mapping[str, str]) -> list[int]:
    """Runs control statements on the database in one transaction; no rows pass through here."""
    jvm = spark.sparkContext._jvm
    settings = jvm.java.util.Properties()
    for key, value in properties.items():
        settings.setProperty(key, value)
    connection = jvm.java.sql.DriverManager.getConnection(url, settings)
    try:
        connection.setAutoCommit(False)
        counts = []
        for text in statements:
            statement = connection.createStatement()
            counts.append(statement.executeUpdate(text))
            statement.close()
        connection.commit()
        return counts
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def table_exists(spark: SparkSession, url: str, table: str, properties: Mapping[str, str] | None = None) -> bool:
    try:
        spark.read.format("jdbc").options(url=url, dbtable=_quote(url, check_table(table)), **dict(properties or {})).load()
        return True
    except Exception as error:  # the drivers have no common "no such table" error
        if re.search(r"does not exist|doesn't exist|not found|unknown table", str(error), re.IGNORECASE):
            return False
        raise


def create_table_sql(df: DataFrame, url: str, table: str, required: Sequence[str] = ()) -> str:
    types = JDBC_TYPES[dialect_of(url)]
    columns = ", ".join(
        f"{_quote(url, check_identifier(f.name, 'column'))} {types[logical_type(f.dataType)]}"
        + (" NOT NULL" if f.name in required or not f.nullable else "")
        for f in df.schema.fields
    )
    return f"CREATE TABLE {_quote(url, check_table(table))} ({columns})"


def upsert_sql(url: str, table: str, stage: str, columns: Sequence[str], keys: Sequence[str]) -> list[str]:
    """The statements that move a staged table into its target, one row per key."""
    target, source = _quote(url, table), _quote(url, stage)
    q = [_quote(url, c) for c in columns]
    key_q = [_quote(url, k) for k in keys]
    others = [_quote(url, c) for c in columns if c not in keys]
    listed = ", ".join(q)
    dialect = dialect_of(url)
    if dialect == "postgres":
        action = f"UPDATE SET {', '.join(f'{c} = EXCLUDED.{c}' for c in others)}" if others else "NOTHING"
        return [f"INSERT INTO {target} ({listed}) SELECT {listed} FROM {source} ON CONFLICT ({', '.join(key_q)}) DO {action}"]
    if dialect == "mysql":
        if not others:
            return [f"INSERT IGNORE INTO {target} ({listed}) SELECT {listed} FROM {source}"]
        updates = ", ".join(f"{c} = VALUES({c})" for c in others)
        return [f"INSERT INTO {target} ({listed}) SELECT {listed} FROM {source} ON DUPLICATE KEY UPDATE {updates}"]
    matched = " AND ".join(f"t.{k} = s.{k}" for k in key_q)
    update = f"WHEN MATCHED THEN UPDATE SET {', '.join(f't.{c} = s.{c}' for c in others)} " if others else ""
    return [
        f"MERGE INTO {target} t USING {source} s ON {matched} {update}"
        f"WHEN NOT MATCHED THEN INSERT ({listed}) VALUES ({', '.join(f's.{c}' for c in q)})"
    ]


def write_jdbc(
    df: DataFrame,
    url: str,
    table: str,
    mode: str = "append",
    keys: Sequence[str] = (),
    create_table: bool = False,
    batch_size: int = 1000,
    order_by: Sequence = (),
    properties: Mapping[str, str] | None = None,
) -> int:
    """Append, replace or upsert; returns the rows the database reports as written.

    All executors write to a staging table; one transaction then moves it into the target, so a load
    that fails half way leaves the target as it was.
    """
    from weir.operators.keyed import content_order, latest_per_key

    if mode not in ("append", "replace", "upsert"):
        raise ConfigError("write mode must be append, replace or upsert")
    if mode == "upsert" and not keys:
        raise ConfigError("Upsert requires at least one key column")
    check_table(table)
    for name in [*df.columns, *keys]:
        check_identifier(name, "column")
    spark, settings = df.sparkSession, dict(properties or {})
    rows = df
    if mode == "upsert":  # rows with a NULL in the key conflict with nothing
        has_key = reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in keys])
        rows = latest_per_key(df.where(has_key), keys, [*order_by, content_order(df)]).unionByName(df.where(~has_key))
    if create_table and not table_exists(spark, url, table, settings):
        _execute(spark, url, [create_table_sql(df, url, table, keys)], settings)
    schema, _, bare = table.rpartition(".")
    stage = (schema + "." if schema else "") + f"weir_{bare[:40]}_{uuid.uuid4().hex[:8]}"
    _execute(spark, url, [create_table_sql(rows, url, stage)], settings)
    try:
        rows.write.format("jdbc").mode("append").options(
            url=url, dbtable=_quote(url, stage), batchsize=str(batch_size), **settings
        ).save()
        listed = ", ".join(_quote(url, c) for c in df.columns)
        target = _quote(url, table)
        if mode == "upsert":
            statements = upsert_sql(url, table, stage, df.columns, keys)
        else:
            statements = [f"DELETE FROM {target}"] if mode == "replace" else []
            statements.append(f"INSERT INTO {target} ({listed}) SELECT {listed} FROM {_quote(url, stage)}")
        return _execute(spark, url, statements, settings)[-1]
    finally:
        _execute(spark, url, [f"DROP TABLE {_quote(url, stage)}"], settings)
