"""Column lineage: which input columns each output column is made of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

_DESCRIPTOR = "position INT, name STRING, sources ARRAY<STRING>, expression STRING, is_star BOOLEAN"


def describe_select(df: DataFrame) -> DataFrame:
    """Descriptors of a query's select list, read from the plan Spark's own analyzer made of it."""
    plan = df._jdf.queryExecution().analyzed()
    # Step down to the node that computes the select list.
    while plan.nodeName() not in ("Project", "Aggregate") and plan.children().size() == 1:
        plan = plan.children().apply(0)
    listed = plan.projectList() if plan.nodeName() == "Project" else (
        plan.aggregateExpressions() if plan.nodeName() == "Aggregate" else plan.output()
    )
    rows = []
    for i in range(listed.size()):
        expression = listed.apply(i)
        references = expression.references().toSeq()
        sources = sorted({references.apply(k).name() for k in range(references.size())})
        rows.append((i, expression.name(), sources, expression.sql(), False))
    return df.sparkSession.createDataFrame(rows, _DESCRIPTOR)


def column_lineage(descriptors: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per output and source column; `*` is reported as unresolved.

    `descriptors` has name, sources, expression, is_star. An output made of no column has a NULL source.
    """
    star = F.col("is_star")
    sources = F.when(star, F.array().cast("array<string>")).otherwise(F.array_distinct("sources"))
    return descriptors.select(
        *by, F.when(star, "*").otherwise(F.col("name")).alias("column"),
        F.when(star, "*").otherwise(F.col("expression")).alias("expression"), (~star).alias("resolved"),
        F.explode_outer(sources).alias("source"),
    )


def unused_columns(lineage: DataFrame, inputs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Input columns (`name`) no output depends on; nothing where any output is unresolved."""
    used = lineage.where(F.col("source").isNotNull()).select(*by, F.col("source").alias("name")).distinct()
    unused = inputs.select(*by, "name").join(used, [*by, "name"], "left_anti")
    if by:
        gaps = lineage.where(~F.col("resolved")).select(*by).distinct()
        return unused.join(gaps, list(by), "left_anti")
    # Without groups the gap is one flag, joined as a single row.
    clear = lineage.agg(F.coalesce(F.bool_and("resolved"), F.lit(True)).alias("__clear")).where("__clear").withColumn("__one", F.lit(1))
    return unused.withColumn("__one", F.lit(1)).join(F.broadcast(clear.select("__one")), "__one", "left_semi").drop("__one")
