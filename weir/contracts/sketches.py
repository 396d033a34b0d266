"""Column profiles that merge: what is known of two sets of rows gives what is known of both, without reading either again."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weir.contracts.infer import _class_bit, _type_of_bits
from weir.functions.types import as_text, is_blank, is_text, logical_type

#: Size of the distinct-count sketch (2^17 registers: a standard error of 0.3 %) and of the quantile sketch (rank error about 1 %).
DISTINCT_BITS, QUANTILE_SIZE = 17, 400

SKETCH = (
    "position INT, name STRING, kind STRING, rows BIGINT, filled BIGINT, classes BIGINT, distinct BINARY, quantiles BINARY, "
    "low_number DOUBLE, high_number DOUBLE, low_text STRING, high_text STRING, low_whole BIGINT, high_whole BIGINT"
)


def sketch_profile(df: DataFrame) -> DataFrame:
    """One row for each column, of bounded size: counts, types seen, least and greatest values, sketches. One partial aggregation."""
    measures, entries = [F.count(F.lit(1)).alias("n")], []
    for i, field in enumerate(df.schema.fields):
        column = F.col(f"`{field.name}`")
        kind = logical_type(field.dataType)
        known = ~is_blank(column, field.dataType)
        plain = as_text(column, field.dataType) if kind == "json" else column
        value = F.when(known, plain)
        number = value.try_cast("double") if is_text(field.dataType) else F.when(known, column.cast("double")) if kind in ("integer", "float") else F.lit(None).cast("double")
        whole = value.cast("bigint") if kind == "integer" else F.lit(None).cast("bigint")
        text = value.cast("string") if is_text(field.dataType) or kind in ("date", "timestamp") else F.lit(None).cast("string")
        bits = F.bit_or(F.when(known, _class_bit(column)).cast("bigint")) if is_text(field.dataType) else F.max(F.lit(None).cast("bigint"))
        measures += [
            F.count_if(known).alias(f"f{i}"), bits.alias(f"t{i}"), F.hll_sketch_agg(F.when(known, F.xxhash64(plain)), DISTINCT_BITS).alias(f"d{i}"),
            F.kll_sketch_agg_double(number, QUANTILE_SIZE).alias(f"q{i}"), F.min(number).alias(f"ln{i}"), F.max(number).alias(f"hn{i}"),
            F.min(text).alias(f"lt{i}"), F.max(text).alias(f"ht{i}"), F.min(whole).alias(f"lw{i}"), F.max(whole).alias(f"hw{i}"),
        ]
        entries.append(F.struct(
            F.lit(i).alias("position"), F.lit(field.name).alias("name"), F.lit("text" if is_text(field.dataType) else kind).alias("kind"), F.col("n").alias("rows"),
            *[F.col(f"{c}{i}").alias(n) for c, n in zip(("f", "t", "d", "q", "ln", "hn", "lt", "ht", "lw", "hw"), [c.split()[0] for c in SKETCH.split(", ")][4:])],
        ))
    return df.agg(*measures).select(F.inline(F.array(*entries)))


def merged_profile(sketches: DataFrame, quantiles: tuple[float, ...] = (0.5,)) -> DataFrame:
    """The profile of all rows behind the sketches: name, type, row_count, null_count, unique_count (estimate), min, max, quantiles.

    Columns that some sketches lack count as null there; a column that was of several kinds is text.
    """
    sizes = sketches.groupBy("part").agg(F.max("rows").alias("rows")).agg(F.sum("rows").alias("all_rows"))
    merged = sketches.groupBy("name").agg(
        F.min("position").alias("position"), F.min("kind").alias("kind"), F.max("kind").alias("other"), F.sum("filled").alias("filled"), F.bit_or("classes").alias("classes"),
        # sketches kept by an earlier release are smaller
        F.hll_sketch_estimate(F.hll_union_agg("distinct", True)).alias("unique_count"), F.kll_merge_agg_double("quantiles").alias("merged"),
        *[F.min(c).alias(c) for c in ("low_number", "low_text", "low_whole")], *[F.max(c).alias(c) for c in ("high_number", "high_text", "high_whole")],
    )
    kind = F.when(F.col("kind") != F.col("other"), "string").when(F.col("kind") == "text", _type_of_bits(F.col("classes"))).otherwise(F.when(F.col("filled") == 0, "unknown").otherwise(F.col("kind")))

    def bound(side: str):
        number, text, whole = (F.col(f"{side}_{c}") for c in ("number", "text", "whole"))
        return F.when(F.col("type").isin("date", "timestamp"), text).when(F.col("type").isin("integer", "float"), F.coalesce(whole.cast("string"), number.cast("string")))

    # one row beside one row for each column
    counted = merged.withColumn("type", kind).join(F.broadcast(sizes.withColumn("k", F.lit(1))), F.lit(1) == F.col("k"))
    numeric = F.col("type").isin("integer", "float") & (F.kll_sketch_get_n_double("merged") > 0)
    return counted.select(
        "position", "name", "type", F.col("all_rows").alias("row_count"), (F.col("all_rows") - F.col("filled")).alias("null_count"), "unique_count",
        bound("low").alias("min"), bound("high").alias("max"),
        F.when(numeric, F.kll_sketch_get_quantile_double("merged", F.array(*[F.lit(float(q)) for q in quantiles]))).alias("quantiles"),
    )
