"""Key-pair joins with collision renaming and a cardinality estimate."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, functions as F

from weir.errors import ConfigError, ValidationError
from weir.functions.types import is_text, logical_type
from weir.operators.project import rename_collisions
from weir.session import plain_unions

# Join kinds.
KINDS = ("inner", "left", "right", "full")


def parse_keys(specs: Iterable[Mapping[str, Any]]) -> list[tuple[str, str]]:
    if isinstance(specs, (str, Mapping)) or not isinstance(specs, Iterable):
        raise ConfigError("on must be a non-empty list of key pairs")
    pairs = []
    for number, spec in enumerate(specs):
        if not isinstance(spec, Mapping):
            raise ConfigError(f"on[{number}] must be an object")
        left, right = spec.get("left"), spec.get("right")
        if not isinstance(left, str) or not isinstance(right, str):
            raise ConfigError(f"on[{number}] requires string left and right column names")
        pairs.append((left, right))
    if not pairs:
        raise ConfigError("on must be a non-empty list of key pairs")
    return pairs


def _check_keys(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> None:
    for left_key, right_key in pairs:
        if left_key not in left.columns:
            raise ConfigError(f'Join key "{left_key}" is not present on the left input')
        if right_key not in right.columns:
            raise ConfigError(f'Join key "{right_key}" is not present on the right input')
        types = {logical_type(left.schema[left_key].dataType), logical_type(right.schema[right_key].dataType)}
        if "string" in types and types & {"integer", "float", "boolean"}:
            raise ConfigError(f'Join keys "{left_key}" and "{right_key}" hold text and numbers and can never match; cast one')


def join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]],
    kind: str = "inner",
    right_prefix: str = "",
    max_output_rows: int | None = None,
) -> DataFrame:
    """Joins on equal keys; NULL keys never match. Both key columns stay.

    No side is broadcast by hand: Catalyst broadcasts what its statistics show to be small, and AQE
    splits hot keys of inner, left and right joins. A full join cannot be split by AQE, and its
    merge scanner keeps all rows of one key in memory, so it is built from a left join and an anti
    join, which can.
    """
    if kind not in KINDS:
        raise ConfigError(f"join type must be one of: {', '.join(KINDS)}")
    _check_keys(left, right, on)
    if max_output_rows is not None and join_cardinality(left, right, on).head()[0] > max_output_rows:
        raise ValidationError(
            f"Join produced more than {max_output_rows} rows; the join keys are probably not unique enough"
        )
    renamed, names = rename_collisions(left, right, right_prefix or "right_")
    condition = reduce(lambda a, b: a & b, [left[l] == renamed[names[r]] for l, r in on])
    if kind != "full":
        return left.join(renamed, condition, kind)

    plain_unions(left.sparkSession)
    matched = left.join(renamed, condition, "left")
    keys = left.select(*[F.col(f"`{l}`").alias(f"__k{i}") for i, (l, _) in enumerate(on)]).distinct()
    unmatched_condition = reduce(
        lambda a, b: a & b, [renamed[names[r]] == keys[f"__k{i}"] for i, (_, r) in enumerate(on)]
    )
    unmatched = renamed.join(keys, unmatched_condition, "left_anti")
    padding = [F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema.fields]
    return matched.unionByName(unmatched.select(*padding, "*"))


def join_cardinality(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """One row, `estimated_rows`: the exact size of the inner join, without building it."""
    _check_keys(left, right, on)
    plain_unions(left.sparkSession)
    names = [f"__k{i}" for i in range(len(on))]

    def side(df: DataFrame, keys: Sequence[str], others: Sequence[Any], counts: tuple[int, int]) -> DataFrame:
        # text meets a date or time as one, as it does in a comparison
        typed = [F.col(f"`{k}`").cast(o) if is_text(df.schema[k].dataType) and not is_text(o) else F.col(f"`{k}`") for k, o in zip(keys, others)]
        picked = df.select(*[c.alias(n) for n, c in zip(names, typed)]).dropna(subset=names)
        return picked.select(*names, *[F.lit(c).cast("bigint").alias(n) for n, c in zip(("__left", "__right"), counts)])

    left_keys, right_keys = zip(*on)
    types = [[df.schema[k].dataType for k in keys] for df, keys in ((left, left_keys), (right, right_keys))]
    both = side(left, left_keys, types[1], (1, 0)).unionByName(side(right, right_keys, types[0], (0, 1)))
    # one grouping of both sides: half the tables of counts in memory, and nothing to sort
    per_key = both.groupBy(*names).agg(F.sum("__left").alias("__left"), F.sum("__right").alias("__right"))
    return per_key.agg(
        F.coalesce(F.sum(F.col("__left") * F.col("__right")), F.lit(0)).cast("bigint").alias("estimated_rows")
    )
