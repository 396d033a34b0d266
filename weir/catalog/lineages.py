"""Lineage (L)."""

from pyspark.sql import functions as F

from weir.catalog.registry import query
from weir.lineage import column_lineage, describe_select, first_nodes, lineage_edges, merge_edges, parse_definitions, producers, reachable, unresolved, unused_columns


def definitions_of(t, orders="true"):
    """A pipeline per order: a source (unnamed for pending orders), a publishing SQL node, a filter, a destination."""
    named = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("customer_"), "o_custkey"))
    def node(name, kind, dataset=None, table=None):
        none = F.lit(None).cast("string")
        return F.struct(
            F.lit(name).alias("id"), F.lit(kind).alias("type"),
            F.struct((none if dataset is None else dataset).alias("dataset"), (none if table is None else table).alias("table")).alias("config"),
        )

    nodes = F.array(
        node("read", "csv.source", named), node("sum", "sql.transform", F.concat(F.lit("sums_"), "o_custkey")), node("keep", "filter.transform"),
        node("write", "postgres.destination", None, F.concat(F.lit("prio_"), F.substring("o_orderpriority", 1, 1))),
    )
    edges = F.array(*[F.struct(F.lit(a).alias("from"), F.lit(b).alias("to")) for a, b in (("read", "sum"), ("sum", "keep"), ("keep", "write"))])
    return t.orders.where(orders).select(
        F.col("o_orderkey").alias("pipeline_id"), F.lit(1).alias("pipeline_version_id"),
        F.to_json(F.struct(F.lit("orders").alias("name"), nodes.alias("nodes"), edges.alias("edges"))).alias("definition"),
    )


_EDGES = """
    edges AS (SELECT o_orderkey AS pipeline_id, 'dataset:customer_' || o_custkey AS a, 'node:read' AS b, 'read' AS node_id, NULL AS transformation FROM orders WHERE o_orderstatus <> 'P'
              UNION ALL SELECT o_orderkey, 'node:sum', 'dataset:sums_' || o_custkey, 'sum', 'sql.transform' FROM orders
              UNION ALL SELECT o_orderkey, 'node:write', 'dataset:prio_' || substr(o_orderpriority, 1, 1), 'write', 'postgres.destination' FROM orders
              UNION ALL SELECT o_orderkey, 'node:read', 'node:sum', 'sum', 'sql.transform' FROM orders
              UNION ALL SELECT o_orderkey, 'dataset:sums_' || o_custkey, 'node:keep', 'keep', NULL FROM orders
              UNION ALL SELECT o_orderkey, 'node:keep', 'node:write', 'write', 'postgres.destination' FROM orders)
"""


def _edges(t):
    return lineage_edges(parse_definitions(definitions_of(t)))


@query(f"WITH {_EDGES} SELECT * FROM edges")
def lineage_from_definitions(t):
    return _edges(t).select(
        "pipeline_id", F.concat_ws(":", "from_type", "from_id").alias("a"), F.concat_ws(":", "to_type", "to_id").alias("b"), "node_id", "transformation"
    )


@query(
    """
    SELECT o_orderkey AS pipeline_id, 'read' AS node_id, 'reads from a place without a dataset name' AS reason
    FROM orders WHERE o_orderstatus = 'P'
    """
)
def lineage_unresolved(t):
    return unresolved(parse_definitions(definitions_of(t))).select("pipeline_id", "node_id", "reason")


@query(
    """
    WITH d AS (SELECT 'customer_' || o_custkey AS id, o_orderkey AS p, 'csv.source' AS node_type FROM orders WHERE o_orderstatus <> 'P'
               UNION ALL SELECT 'sums_' || o_custkey, o_orderkey, 'sql.transform' FROM orders
               UNION ALL SELECT 'prio_' || substr(o_orderpriority, 1, 1), o_orderkey, 'postgres.destination' FROM orders)
    SELECT id, min(p) AS first_pipeline, any_value(node_type) AS node_type FROM d GROUP BY id
    """
)
def lineage_merged_datasets(t):
    merged = first_nodes(parse_definitions(definitions_of(t)))
    return merged.where("type = 'dataset'").select("id", F.col("pipeline_id").alias("first_pipeline"), "node_type")


@query(f"WITH {_EDGES} SELECT count(*) AS edges, count(DISTINCT pipeline_id) AS pipelines FROM edges")
def lineage_merged_edges(t):
    # Two overlapping graphs: the pipelines of finished and open orders, and those of all but open ones.
    first = lineage_edges(parse_definitions(definitions_of(t, "o_orderstatus <> 'P'")))
    second = lineage_edges(parse_definitions(definitions_of(t, "o_orderstatus <> 'O'")))
    merged = merge_edges(first, second)
    return merged.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("pipeline_id").alias("pipelines"))


@query("SELECT 'prio_' || substr(o_orderpriority, 1, 1) AS dataset, o_orderkey AS pipeline_id, 'write' AS node_id FROM orders UNION ALL SELECT 'sums_' || o_custkey, o_orderkey, 'sum' FROM orders")
def lineage_producers(t):
    return producers(_edges(t))


# Suppliers feed parts, parts feed orders, orders feed customers, customers feed nations and nations suppliers: a graph with cycles.
_GRAPH = """
    g AS (SELECT DISTINCT 'supplier:' || l_suppkey AS a, 'part:' || l_partkey AS b FROM lineitem
          UNION SELECT DISTINCT 'part:' || l_partkey, 'order:' || l_orderkey FROM lineitem
          UNION SELECT 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders
          UNION SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
          UNION SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation
          UNION SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier)
"""


def _graph(t):
    def edge(df, a, a_key, b, b_key):
        return df.select(
            F.lit(a).alias("from_type"), F.col(a_key).cast("string").alias("from_id"), F.lit(b).alias("to_type"), F.col(b_key).cast("string").alias("to_id")
        )

    lines = t.lineitem
    parts = [
        edge(lines, "supplier", "l_suppkey", "part", "l_partkey"), edge(lines, "part", "l_partkey", "order", "l_orderkey"),
        edge(t.orders, "order", "o_orderkey", "customer", "o_custkey"), edge(t.customer, "customer", "c_custkey", "nation", "c_nationkey"),
        edge(t.nation, "nation", "n_nationkey", "region", "n_regionkey"), edge(t.supplier, "nation", "s_nationkey", "supplier", "s_suppkey"),
    ]
    graph = parts[0]
    for part in parts[1:]:
        graph = graph.unionByName(part)
    return graph


def _reach_sql(step: str) -> str:
    return f"""
    WITH RECURSIVE {_GRAPH}, walk AS (SELECT '{{start}}' AS x UNION SELECT {step} )
    SELECT split_part(x, ':', 1) AS type, count(*) AS n FROM walk WHERE x <> '{{start}}' GROUP BY 1
    """


@query(_reach_sql("g.b FROM walk JOIN g ON g.a = walk.x").format(start="supplier:1"))
def lineage_downstream(t):
    starts = t.spark.createDataFrame([("supplier", "1")], "type STRING, id STRING")
    return reachable(_graph(t), starts, "down").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(_reach_sql("g.a FROM walk JOIN g ON g.b = walk.x").format(start="region:2"))
def lineage_upstream(t):
    starts = t.spark.createDataFrame([("region", "2")], "type STRING, id STRING")
    return reachable(_graph(t), starts, "up").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


# A select list per part: `label` is made of two or three columns, `everything` is a star for small parts.
def _descriptors(t):
    sources = F.when(F.col("p_size") > 25, F.array(F.lit("p_name"), F.lit("p_brand"), F.lit("p_name"))).otherwise(F.array(F.lit("p_name"), F.lit("p_size")))
    return t.part.select(
        F.col("p_partkey").alias("query_id"),
        F.inline(
            F.array(
                F.struct(F.lit("label").alias("name"), sources.alias("sources"), F.lit("concat(...)").alias("expression"), F.lit(False).alias("is_star")),
                F.struct(F.lit("extra").alias("name"), F.array("p_type").alias("sources"), F.col("p_type").alias("expression"), (F.col("p_type") == "SMALL").alias("is_star")),
            )
        ),
    )


@query(
    """
    SELECT p_partkey AS query_id, 'label' AS "column", s AS source, true AS resolved FROM part, unnest(CASE WHEN p_size > 25 THEN ['p_name', 'p_brand'] ELSE ['p_name', 'p_size'] END) AS u(s)
    UNION ALL SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN '*' ELSE 'extra' END, nullif(p_type, 'SMALL'), p_type <> 'SMALL' FROM part
    """
)
def column_lineage_table(t):
    return column_lineage(_descriptors(t), ["query_id"]).select("query_id", "column", "source", "resolved")


@query("SELECT p_partkey AS query_id, CASE WHEN p_size > 25 THEN 'p_size' ELSE 'p_brand' END AS name FROM part WHERE p_type <> 'SMALL'")
def column_lineage_unused(t):
    inputs = t.part.select(F.col("p_partkey").alias("query_id"), F.explode(F.array(F.lit("p_name"), F.lit("p_brand"), F.lit("p_size"))).alias("name"))
    return unused_columns(column_lineage(_descriptors(t), ["query_id"]), inputs, ["query_id"])


@query(
    """
    SELECT 'revenue' AS "column", unnest(['l_discount', 'l_extendedprice']) AS source, (SELECT count(*) FROM lineitem) AS rows_behind
    UNION ALL SELECT 'l_returnflag', 'l_returnflag', (SELECT count(*) FROM lineitem) UNION ALL SELECT 'n', NULL, (SELECT count(*) FROM lineitem)
    """
)
def column_lineage_of_sql(t):
    from weir.plans.flow import sql_transform

    summary = sql_transform(
        t.spark, "SELECT l_returnflag, sum(l_extendedprice * (1 - l_discount)) AS revenue, count(*) AS n FROM lineitem GROUP BY l_returnflag", {"lineitem": t.lineitem}
    )
    lineage = column_lineage(describe_select(summary)).select("column", "source")
    behind = summary.agg(F.sum("n").alias("rows_behind")).withColumn("k", F.lit(1))
    return lineage.withColumn("k", F.lit(1)).join(F.broadcast(behind), "k").drop("k")
