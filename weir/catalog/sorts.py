"""Sort, limit, distinct, pages, union (O, S16)."""

from pyspark.sql import functions as F

from weir.catalog.registry import query
from weir.operators import capped, distinct_rows, keyset_page, limit_offset, order_by, top_k


@query(
    """
    WITH c AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, nullif(c_acctbal, 1863.84) AS c_acctbal FROM customer)
    SELECT 'last' AS side, * FROM (SELECT * FROM c ORDER BY c_acctbal ASC NULLS LAST, segment DESC NULLS FIRST, c_custkey LIMIT 200)
    UNION ALL SELECT 'first', * FROM (SELECT * FROM c ORDER BY segment DESC NULLS FIRST, c_acctbal ASC NULLS LAST, c_custkey LIMIT 400)
    """
)
def order_nulls(t):
    """The default places of NULLs: last where ascending, first where descending."""
    customers = t.customer.select(
        "c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.nullif("c_acctbal", F.lit(1863.84)).alias("c_acctbal")
    )
    last = top_k(customers, ["c_acctbal", ("segment", "desc"), "c_custkey"], 200).withColumn("side", F.lit("last"))
    return last.unionByName(top_k(customers, [("segment", "desc"), "c_acctbal", "c_custkey"], 400).withColumn("side", F.lit("first")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 25")
def topk(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return top_k(rows, [("l_extendedprice", "desc"), "l_orderkey", "l_linenumber", "l_partkey"], 25)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 40 OFFSET 15")
def limit_with_offset(t):
    return limit_offset(order_by(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]), 40, 15)


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_pairs(t):
    return distinct_rows(t.part.select("p_brand", "p_type"), [("p_brand", "desc"), "p_type"])


@query("SELECT p_partkey, p_name, p_size * 2 AS double_size FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 60")
def order_by_unselected(t):
    return order_by(t.part, [("p_retailprice", "desc"), "p_partkey"]).select("p_partkey", "p_name", (F.col("p_size") * 2).alias("double_size")).limit(60)


@query(
    """
    SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at FROM events
    WHERE ts < TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts DESC, event_id DESC LIMIT 500
    """
)
def keyset_second_page(t):
    page = keyset_page(t.events, "ts", "event_id", ("2024-01-20 00:00:00", "0"), limit=500)
    return page.rows.select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


@query(
    """
    SELECT 'customer' AS kind, c_custkey AS id, c_name AS title FROM customer
    UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier
    UNION ALL SELECT 'part', p_partkey, p_name FROM part
    """
)
def union_entities(t):
    parts = [
        t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("title")),
        t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("title")),
        t.part.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("title")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    """
    WITH r AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
    SELECT o_custkey, n, (SELECT count(*) FROM r) > 100 AS truncated FROM r ORDER BY n DESC, o_custkey LIMIT 100
    """
)
def capped_report(t):
    per_customer = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    head = capped(order_by(per_customer, [("n", "desc"), "o_custkey"]), 100)
    return head.df.withColumn("truncated", F.lit(head.truncated))
