"""Operators that work per key: latest row, keyed merge, look-back windows, counts by state.

A key may hold a third of all rows. The latest row and the dedupe before a merge rank within the
map tasks first (Spark's window group limit), and look-back windows cut keys into slices of equal size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from weir.errors import ConfigError
from weir.functions.ordering import sort_columns
from weir.session import cut_lineage, plain_unions


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence, n: int = 1) -> DataFrame:
    """The first `n` rows of each key in the given order, e.g. `[("queued_at", "desc"), ("id", "desc")]`."""
    window = Window.partitionBy(*keys).orderBy(*sort_columns(order_by))
    return df.withColumn("__rank", F.row_number().over(window)).where(F.col("__rank") <= n).drop("__rank")


def merge_rows(target: DataFrame, source: DataFrame, keys: Sequence[str], order_by: Sequence = ()) -> DataFrame:
    """The target after an upsert of the source: known keys are replaced, new keys are added.

    Of all rows with one key the first in `order_by` wins (pass the newest first), so a late source row does not replace a
    newer one of the target; the target takes part if it has all the order's columns. Between equals, and without an order, source
    rows win over the target, and among source rows their content decides, whatever files they come from. Rows with a NULL in the
    key conflict with nothing, so they are all added. Columns that only the target has keep their old values, or NULL for
    new keys.
    """
    if not keys:
        raise ConfigError("Upsert requires at least one key column")
    plain_unions(target.sparkSession)
    unknown = sorted((set(keys) - set(source.columns)) | (set(source.columns) - set(target.columns)))
    if unknown:
        raise ConfigError(f"Upsert column(s) missing on one side: {', '.join(unknown)}")
    has_key = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    loose = source.where(~has_key)
    keyed = latest_per_key(source.where(has_key), keys, [*order_by, content_order(source)])
    carried = [c for c in target.columns if c not in source.columns]
    if carried:
        keyed = keyed.join(target.select(*keys, *carried), list(keys), "left")
    named = [k[0] if isinstance(k, tuple) else k for k in order_by]
    if order_by and all(isinstance(n, str) and n in source.columns for n in named):
        old = target.join(keyed.select(*keys), list(keys), "left_semi").withColumn("__new", F.lit(False))
        meeting = old.unionByName(keyed.withColumn("__new", F.lit(True)))
        keyed = latest_per_key(meeting, keys, [*order_by, ("__new", "desc")]).drop("__new")
    kept = target.join(source.where(has_key).select(*keys), list(keys), "left_anti").select(*target.columns)
    return kept.unionByName(keyed, allowMissingColumns=True).unionByName(loose, allowMissingColumns=True).select(*target.columns)


def content_order(df: DataFrame) -> tuple[Column, str]:
    """A last sort key that tells rows apart by what is in them."""
    return F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]))), "asc"


def count_by_state(df: DataFrame, column: str, states: Sequence[str]) -> DataFrame:
    """One row per known state, zero where there is none, from a single aggregation."""
    counted = df.agg(*[F.count_if(F.col(column) == s).alias(f"s{i}") for i, s in enumerate(states)])
    entries = [F.struct(F.lit(s).alias("state"), F.col(f"s{i}").alias("runs")) for i, s in enumerate(states)]
    return counted.select(F.inline(F.array(*entries)))


def look_back(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    rows: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    slices: int | None = None,
    relevant: Column | None = None,
    then: Callable[[list[str]], dict[str, Column]] | None = None,
) -> DataFrame:
    """Adds window columns that depend on at most `rows` earlier rows of each key.

    All rows are dealt by ranges of keys and order columns, whose bounds Spark takes from a sample of the rows, so a key
    of any size is cut into slices with about the same number of rows (`slices` in all; by default as many as there are
    shuffle partitions), wherever its times lie. Only the key that a slice begins with can have earlier rows elsewhere: the
    last `rows` of these are carried over as a prefix. So the result is that of one window per key, and no task sees more of
    a key than a slice. With `relevant` only the rows it holds for are looked back at. `then` gets the partition
    columns and may build on the columns of the first step.
    """
    sliced = sliced_rows(df, keys, order_by, slices)
    prefixes = _prefixes(_split_keys(sliced, keys), keys, order_by, rows, F.lit(True) if relevant is None else relevant)
    prefixed = sliced.withColumn("__prefix", F.lit(False)).unionByName(prefixes)
    done = _with_windows(prefixed, [*keys, "__slice"], order_by, build, then)
    return done.where("NOT __prefix").drop("__prefix", "__slice")


def _with_windows(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], build, then) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*[F.col(c).asc() for c in order_by])
    first = df.withColumns(build(window))
    return first if then is None else first.withColumns(then(list(keys)))


def sliced_rows(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], slices: int | None = None) -> DataFrame:
    """The rows with `__slice`, the number of their range of keys and order columns; written out, since it is read more than once."""
    columns = [F.col(c) for c in [*keys, *order_by]]
    ranged = df.repartitionByRange(*columns) if slices is None else df.repartitionByRange(slices, *columns)
    return cut_lineage(ranged.withColumn("__slice", F.spark_partition_id()), "slices")


def _split_keys(sliced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of the keys that some slice begins with; no other key is in two slices."""
    names = [f"__first_{i}" for i in range(len(keys))]
    first = sliced.groupBy("__slice").agg(F.min(F.struct(*[F.col(k).alias(n) for k, n in zip(keys, names)])).alias("first")).where("__slice > 0")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
    return sliced.join(F.broadcast(first.select("first.*").distinct()), same, "left_semi")  # at most one row for each slice


def _prefixes(sliced: DataFrame, keys: Sequence[str], order_by: Sequence[str], rows: int, relevant: Column) -> DataFrame:
    """For each slice of each key, the last `rows` relevant rows of the slices before it."""
    columns = [c for c in sliced.columns if c != "__slice"]
    newest_first = [(c, "desc", "last") for c in order_by]
    tails = latest_per_key(sliced.where(relevant), [*keys, "__slice"], newest_first, rows)
    per_slice = tails.groupBy(*keys, "__slice").agg(F.collect_list(F.struct(*columns)).alias("__tail"))
    # Every slice listed here holds at least one row, so `rows` slices hold `rows` rows.
    recent = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(-(rows - 1), 0)
    state = per_slice.withColumn("__state", F.flatten(F.collect_list("__tail").over(recent))).drop("__tail")
    slices = sliced.select(*keys, "__slice").distinct()
    same = reduce(lambda a, b: a & b, [slices[k].eqNullSafe(state[k]) for k in [*keys, "__slice"]])
    listed = slices.join(state, same, "left").select(*[slices[k] for k in [*keys, "__slice"]], "__state")
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    gathered = listed.select("__slice", F.last("__state", ignorenulls=True).over(before).alias("__before"))
    exploded = gathered.select("__slice", F.explode("__before").alias("__row")).select("__row.*", "__slice")
    newest = latest_per_key(exploded, [*keys, "__slice"], newest_first, rows)
    return newest.withColumn("__prefix", F.lit(True))
