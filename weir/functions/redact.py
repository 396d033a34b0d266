"""Credential scrubbing for text, and masking of fields whose name says they hold a secret."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

REDACTED = "[REDACTED]"

# Fragments of field names that mark a secret.
SENSITIVE_NAMES = (
    "pass(word|wd)?",
    "secret",
    "token",
    "api[-_]?key",
    "access[-_]?key",
    "private[-_]?key",
    "authorization",
    "auth",
    "credential",
    "session",
    "cookie",
    "connection[-_]?string",
    "dsn",
    "client[-_]?secret",
    "signature",
    "encryption[-_]?key",
)

# A reference to a secret is safe to show, so this name is never masked.
SAFE_NAME = "secretRef"

# The shapes of credentials inside text, each with its replacement.
TEXT_PATTERNS = (
    (r"\b([a-zA-Z][a-zA-Z0-9+.-]*://)([^:/?#\s]+):([^@/?#\s]+)@", r"$1$2:[REDACTED]@"),
    (r"(?i)\b(bearer|basic|token)\s+[A-Za-z0-9._~+/=-]{8,}", r"$1 [REDACTED]"),
    (
        r"\b(sk-[A-Za-z0-9_-]{8,}|gh[pousr]_[A-Za-z0-9]{8,}|AKIA[0-9A-Z]{12,}|xox[abprs]-[A-Za-z0-9-]{8,}"
        r"|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{4,})",
        r"[REDACTED]",
    ),
)

_NAME_PATTERN = "|".join(SENSITIVE_NAMES)


def scrub(value) -> Column:
    """Three chained replacements over the whole text."""
    column = F.col(value) if isinstance(value, str) else value
    for pattern, replacement in TEXT_PATTERNS:
        column = F.regexp_replace(column, pattern, replacement)
    return column


def is_sensitive_name(name: str) -> bool:
    return name != SAFE_NAME and re.search(_NAME_PATTERN, name, re.IGNORECASE) is not None


def _mask(column: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StringType):
        return scrub(column)
    if isinstance(data_type, T.ArrayType):
        return F.transform(column, lambda item: _mask(item, data_type.elementType))
    if isinstance(data_type, T.MapType) and isinstance(data_type.keyType, T.StringType):
        # A masked entry must keep the map's value type; only text values can show the marker.
        shown = F.lit(REDACTED) if isinstance(data_type.valueType, T.StringType) else F.lit(None).cast(data_type.valueType)
        return F.transform_values(
            column,
            lambda key, item: F.when(key == SAFE_NAME, item)
            .when(key.rlike(f"(?i){_NAME_PATTERN}"), shown)
            .otherwise(_mask(item, data_type.valueType)),
        )
    if isinstance(data_type, T.StructType):
        fields = [_mask_field(column.getField(f.name), f).alias(f.name) for f in data_type.fields]
        return F.when(column.isNotNull(), F.struct(*fields))
    return column


def _mask_field(column: Column, field: T.StructField) -> Column:
    if field.name == SAFE_NAME:
        return column
    if is_sensitive_name(field.name):
        return F.lit(REDACTED)
    return _mask(column, field.dataType)


def redact(df: DataFrame) -> DataFrame:
    """Masks secret-named columns, fields and map keys at any depth and scrubs all other text."""
    return df.select(*[_mask_field(F.col(f"`{f.name}`"), f).alias(f.name) for f in df.schema.fields])
