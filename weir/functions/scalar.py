"""Scalar functions whose meaning differs from the Spark built-in of the same name.

Everything else in the dialect (`coalesce`, `nullif`, `lower`, `upper`, `replace`, `abs`, `round`,
`floor`, `ceil`, `power`, `md5`, ...) is the built-in itself and needs no wrapper.
All of these are plain expressions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

from weir.errors import ConfigError

# What counts as true or false in text, and the units of date_trunc.
TRUE_WORDS = ("true", "t", "yes", "y", "1")
FALSE_WORDS = ("false", "f", "no", "n", "0")
TRUNC_UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


# ---- casts: a value that cannot be read becomes NULL instead of failing the query


def to_integer(value) -> Column:
    """Truncates toward zero."""
    return _col(value).try_cast("double").try_cast("bigint")


def to_float(value) -> Column:
    return _col(value).try_cast("double")


def to_text(value) -> Column:
    return _col(value).cast("string")


def to_boolean(value, numeric: bool = False) -> Column:
    """Text: the true words are true and all else is false. Numbers: nonzero is true."""
    column = _col(value)
    if numeric:
        return column != 0
    return F.lower(column.cast("string")).isin(*TRUE_WORDS)


def to_date(value) -> Column:
    return _col(value).try_cast("date")


def to_timestamp(value) -> Column:
    return _col(value).try_cast("timestamp")


def to_variant(value) -> Column:
    return F.try_parse_json(_col(value))


def coerce_boolean(value) -> Column:
    """Ingest rule: true and false words only, anything else NULL."""
    text = F.lower(_col(value))
    return F.when(text.isin(*TRUE_WORDS), True).when(text.isin(*FALSE_WORDS), False)


# ---- text


def trim(value) -> Column:
    """Strips every kind of white space, not only blanks."""
    return F.regexp_replace(_col(value), r"^\s+|\s+\z", "")


def ltrim(value) -> Column:
    return F.regexp_replace(_col(value), r"^\s+", "")


def rtrim(value) -> Column:
    return F.regexp_replace(_col(value), r"\s+\z", "")


def substr(value, start, length=None) -> Column:
    """1-based; a start below 1 is moved to 1 and the length is kept."""
    first = F.greatest(_as_column(start), F.lit(1))
    # greatest skips NULLs, but a NULL start gives a NULL result.
    first = F.when(_as_column(start).isNotNull(), first)
    if length is None:
        return F.substr(_col(value), first)
    return F.substr(_col(value), first, F.greatest(_as_column(length), F.lit(0)))


def concat(*values) -> Column:
    """NULL arguments are skipped."""
    return F.concat_ws("", *[_col(v).cast("string") for v in values])


def concat_ws(separator, *values) -> Column:
    """A NULL separator counts as the empty string."""
    arguments = F.array(*[_col(v).cast("string") for v in values])
    return F.call_function("array_join", F.array_compact(arguments), F.coalesce(_as_column(separator), F.lit("")))


def split_part(value, delimiter, position) -> Column:
    """Positions below 1 or past the end give the empty string."""
    number = _as_column(position)
    part = F.split_part(_col(value), _as_column(delimiter), F.greatest(number, F.lit(1)))
    known = _col(value).isNotNull() & _as_column(delimiter).isNotNull() & number.isNotNull()
    return F.when(known, F.when(number < 1, F.lit("")).otherwise(part))


def position(needle, haystack) -> Column:
    return F.locate(needle, _col(haystack)) if isinstance(needle, str) else F.position(needle, _col(haystack))


def like(value, pattern: str, ignore_case: bool = False) -> Column:
    """Only % and _ are special; a backslash is a plain character."""
    escaped = pattern.replace("\\", "\\\\")
    column = _col(value)
    return column.ilike(escaped) if ignore_case else column.like(escaped)


# ---- numbers


def sqrt(value) -> Column:
    """Fails on a negative number."""
    number = _col(value).cast("double")
    failure = F.raise_error(F.lit("SQRT of a negative number")).cast("double")
    return F.when(number < 0, failure).otherwise(F.sqrt(number))


def modulo(left, right) -> Column:
    """Sign of the dividend; a zero divisor fails whatever the session's ANSI setting."""
    divisor = _as_column(right)
    failure = F.raise_error(F.lit("Division by zero")).cast("double")
    return F.when(divisor == 0, failure).otherwise(_col(left).cast("double") % divisor)


def divide(left, right) -> Column:
    divisor = _as_column(right).cast("double")
    failure = F.raise_error(F.lit("Division by zero")).cast("double")
    return F.when(divisor == 0, failure).otherwise(_col(left).cast("double") / divisor)


def greatest(*values) -> Column:
    """Like the built-in, but a single argument is allowed."""
    columns = [_col(v) for v in values]
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def least(*values) -> Column:
    columns = [_col(v) for v in values]
    return F.least(*columns) if len(columns) > 1 else columns[0]


# ---- time


def date_trunc(unit: str, value) -> Column:
    """Weeks start on Monday; an unknown unit is an error, unreadable text is NULL."""
    if unit.lower() not in TRUNC_UNITS:
        raise ConfigError(f"date_trunc unit must be one of {', '.join(TRUNC_UNITS)}, got {unit!r}")
    return F.date_trunc(unit.lower(), _col(value).try_cast("timestamp_ntz"))


def _as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


# SQL forms of the same functions, so that query text can use them.
_SQL_FUNCTIONS = {
    "w_int": ("x STRING", "BIGINT", "try_cast(try_cast(x AS DOUBLE) AS BIGINT)"),
    "w_float": ("x STRING", "DOUBLE", "try_cast(x AS DOUBLE)"),
    "w_bool": (
        "x STRING",
        "BOOLEAN",
        "CASE WHEN x IS NULL THEN NULL ELSE lower(x) IN ('true', 't', 'yes', 'y', '1') END",
    ),
    "w_date": ("x STRING", "DATE", "try_cast(x AS DATE)"),
    "w_timestamp": ("x STRING", "TIMESTAMP", "try_cast(x AS TIMESTAMP)"),
    "w_trim": ("x STRING", "STRING", r"regexp_replace(x, r'^\s+|\s+\z', '')"),
    "w_ltrim": ("x STRING", "STRING", r"regexp_replace(x, r'^\s+', '')"),
    "w_rtrim": ("x STRING", "STRING", r"regexp_replace(x, r'\s+\z', '')"),
    "w_substr": (
        "x STRING, s INT, n INT DEFAULT 2147483647",
        "STRING",
        "CASE WHEN s IS NULL THEN NULL ELSE substr(x, greatest(s, 1), greatest(n, 0)) END",
    ),
    "w_split_part": (
        "x STRING, d STRING, n INT",
        "STRING",
        "CASE WHEN x IS NULL OR d IS NULL OR n IS NULL THEN NULL WHEN n < 1 THEN '' "
        "ELSE split_part(x, d, greatest(n, 1)) END",
    ),
    "w_sqrt": (
        "x DOUBLE",
        "DOUBLE",
        "CASE WHEN x < 0 THEN CAST(raise_error('SQRT of a negative number') AS DOUBLE) ELSE sqrt(x) END",
    ),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Adds the `w_*` functions to the session; Spark inlines them, so they cost nothing extra."""
    if spark.catalog.functionExists(sorted(_SQL_FUNCTIONS)[-1]):
        return sorted(_SQL_FUNCTIONS)
    for name, (arguments, result, body) in _SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return sorted(_SQL_FUNCTIONS)
