"""Aggregation (G)."""

from pyspark.sql import functions as F

from weir.catalog.registry import query
from weir.operators import aggregate
from weir.operators.aggregate import string_agg


@query(
    """
    SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, round(avg(l_discount), 6) AS avg_l_discount,
           min(l_shipdate) AS first_ship, max(l_extendedprice) AS max_l_extendedprice, count(*) AS count, count(DISTINCT l_suppkey) AS suppliers
    FROM lineitem GROUP BY ALL
    """
)
def agg_measures(t):
    grouped = aggregate(
        t.lineitem.withColumn("quantity", F.col("l_quantity").cast("decimal(18,2)")),
        [
            {"fn": "sum", "column": "quantity", "as": "sum_qty"},
            {"fn": "avg", "column": "l_discount"},
            {"fn": "min", "column": "l_shipdate", "as": "first_ship"},
            {"fn": "max", "column": "l_extendedprice"},
            {"fn": "count"},
            {"fn": "count_distinct", "column": "l_suppkey", "as": "suppliers"},
        ],
        ["l_returnflag", "l_linestatus"],
    )
    return grouped.withColumns({"sum_qty": F.col("sum_qty").cast("double"), "avg_l_discount": F.round("avg_l_discount", 6)})


@query(
    """
    WITH e AS (SELECT user_id, ts, event_id, event_type, nullif(value, 6.55) AS v FROM events)
    SELECT user_id, first(event_type ORDER BY ts, event_id) AS first_type, last(event_type ORDER BY ts, event_id) AS last_type,
           first(v ORDER BY ts, event_id) AS first_v, count(*) AS n
    FROM e GROUP BY user_id
    """
)
def agg_first_last(t):
    return aggregate(
        t.events.withColumn("v", F.nullif("value", F.lit(6.55))),
        [
            {"fn": "first", "column": "event_type", "as": "first_type"},
            {"fn": "last", "column": "event_type", "as": "last_type"},
            {"fn": "first", "column": "v", "as": "first_v"},
            {"fn": "count", "as": "n"},
        ],
        ["user_id"],
        order_by=["ts", "event_id"],
    )


@query(
    """
    SELECT count(*) AS n, sum(l_quantity) AS q, max(l_tax) AS t FROM lineitem WHERE l_quantity > 1000000
    UNION ALL SELECT count(*), sum(l_quantity), max(l_tax) FROM lineitem
    """
)
def agg_bare(t):
    measures = [
        {"fn": "count", "as": "n"}, {"fn": "sum", "column": "l_quantity", "as": "q"}, {"fn": "max", "column": "l_tax", "as": "t"},
    ]
    return aggregate(t.lineitem.where("l_quantity > 1000000"), measures).union(aggregate(t.lineitem, measures))


@query(
    """
    SELECT nullif(o_orderpriority, '5-LOW') AS priority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS finished, count(*) AS n
    FROM orders GROUP BY 1
    """
)
def agg_null_group_bool_sum(t):
    orders = t.orders.select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"), (F.col("o_orderstatus") == "F").alias("finished"))
    return aggregate(orders, [{"fn": "sum", "column": "finished", "as": "finished"}, {"fn": "count", "as": "n"}], ["priority"])


@query(
    """
    SELECT year(o_orderdate) AS year, count(*) AS n, count(nullif(o_orderstatus, 'P')) AS known, count(DISTINCT o_custkey) AS customers,
           CAST(sum(DISTINCT CAST(floor(o_totalprice / 1000) AS BIGINT)) AS BIGINT) AS distinct_sum, min(o_orderpriority) AS first_priority
    FROM orders GROUP BY year(o_orderdate)
    """
)
def agg_sql_group_by(t):
    t.orders.createOrReplaceTempView("weir_orders")
    return t.spark.sql(
        "SELECT year(o_orderdate) AS year, count(*) AS n, count(nullif(o_orderstatus, 'P')) AS known, count(DISTINCT o_custkey) AS customers, "
        "sum(DISTINCT floor(o_totalprice / 1000)) AS distinct_sum, min(o_orderpriority) AS first_priority FROM weir_orders GROUP BY year(o_orderdate)"
    ).withColumn("year", F.col("year").cast("bigint"))


@query(
    """
    SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean_price,
           CASE WHEN max(o_totalprice) > 300000 THEN 'big' ELSE 'small' END AS class
    FROM orders GROUP BY o_custkey HAVING count(*) >= 12 AND min(o_totalprice) < 50000
    """
)
def agg_having(t):
    grouped = t.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("s"),
        F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"),
    )
    kept = grouped.where((F.col("n") >= 12) & (F.col("low") < 50000))
    return kept.select(
        "o_custkey", "n", (F.col("s") / F.col("n")).alias("mean_price"), F.when(F.col("high") > 300000, "big").otherwise("small").alias("class")
    )


@query(
    """
    SELECT p_type, string_agg(p_brand, ',' ORDER BY p_brand) AS brands FROM (SELECT DISTINCT p_type, p_brand FROM part) GROUP BY p_type
    """
)
def agg_string_agg(t):
    return string_agg(t.part, ["p_type"], "p_brand", "brands", distinct=True)


@query("SELECT p_type, string_agg(p_brand, ',' ORDER BY p_brand) AS brands FROM part GROUP BY p_type")
def agg_string_agg_all(t):
    return string_agg(t.part, ["p_type"], "p_brand", "brands")
