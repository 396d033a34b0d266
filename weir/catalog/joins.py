"""Joins (J)."""

from pyspark.sql import functions as F

from weir.catalog.registry import query
from weir.errors import ValidationError
from weir.operators import join, join_cardinality


@query(
    """
    SELECT o.o_orderkey, o.o_custkey, c.c_custkey, c.c_name, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
    """
)
def join_inner(t):
    return join(t.orders, t.customer, [("o_custkey", "c_custkey")]).select("o_orderkey", "o_custkey", "c_custkey", "c_name", "c_mktsegment")


@query("SELECT d.doc_id, d.lang, l.doc_id AS right_doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_left(t):
    return join(t.documents.select("doc_id", "lang"), t.labels.select("doc_id", "quality"), [("doc_id", "doc_id")], "left")


@query(
    """
    WITH d AS (SELECT CASE WHEN lang <> 'en' THEN doc_id END AS doc_id, lang FROM documents), l AS (SELECT doc_id, toxic FROM labels)
    SELECT d.doc_id, d.lang, l.doc_id AS label_doc_id, l.toxic FROM d RIGHT JOIN l ON d.doc_id = l.doc_id
    """
)
def join_right(t):
    documents = t.documents.select(F.when(F.col("lang") != "en", F.col("doc_id")).alias("doc_id"), "lang")
    return join(documents, t.labels.select("doc_id", "toxic"), [("doc_id", "doc_id")], "right", right_prefix="label_")


_NULL_KEYS = """
    WITH a AS (SELECT o_custkey AS k, count(*) AS orders FROM orders GROUP BY 1),
         left_side AS (SELECT CASE WHEN c_mktsegment <> 'BUILDING' AND c_nationkey < 15 THEN c_custkey END AS k, c_name FROM customer),
         right_side AS (SELECT CASE WHEN k % 10 = 3 THEN NULL ELSE k END AS k, orders FROM a)
"""


def _null_key_sides(t):
    left = t.customer.select(F.when((F.col("c_mktsegment") != "BUILDING") & (F.col("c_nationkey") < 15), F.col("c_custkey")).alias("k"), "c_name")
    counts = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("orders"))
    return left, counts.select(F.when(F.col("k") % 10 != 3, F.col("k")).alias("k"), "orders")


@query(_NULL_KEYS + "SELECT l.k, l.c_name, r.k AS right_k, r.orders FROM left_side l FULL JOIN right_side r ON l.k = r.k")
def join_full_null_keys(t):
    return join(*_null_key_sides(t), [("k", "k")], "full")


@query(
    """
    SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, s.l_orderkey AS again_l_orderkey, s.total AS total
    FROM lineitem l JOIN (SELECT l_orderkey, l_suppkey, count(*) AS total FROM lineitem GROUP BY ALL) s
      ON l.l_orderkey = s.l_orderkey AND l.l_suppkey = s.l_suppkey
    """
)
def join_composite_collision(t):
    per_supplier = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("total"))
    joined = join(
        t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey"), per_supplier,
        [("l_orderkey", "l_orderkey"), ("l_suppkey", "l_suppkey")], right_prefix="again_",
    )
    return joined.drop("again_l_suppkey")


@query("SELECT CAST(count(*) AS BIGINT) AS estimated_rows FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey")
def join_estimate(t):
    keys = [("l_orderkey", "l_orderkey"), ("l_suppkey", "l_suppkey")]
    return join_cardinality(t.lineitem, t.lineitem, keys)


@query(_NULL_KEYS + "SELECT CAST(count(*) AS BIGINT) AS estimated_rows FROM left_side l JOIN right_side r ON l.k = r.k")
def join_estimate_null_keys(t):
    return join_cardinality(*_null_key_sides(t), [("k", "k")])


@query(
    """
    SELECT s.s_suppkey, n.n_nationkey, n.n_name FROM supplier s
    LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > n.n_regionkey * 2000
    """
)
def join_equi_and_theta(t):
    s, n = t.supplier, t.nation
    return s.join(n, (s.s_nationkey == n.n_nationkey) & (s.s_acctbal > n.n_regionkey * 2000), "left").select("s_suppkey", "n_nationkey", "n_name")


@query("SELECT a.n_name AS name_a, b.r_name AS name_b FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey")
def join_theta(t):
    # Both sides are dimension tables whose row count does not grow with the data.
    a, b = t.nation, t.region
    return a.join(b, a.n_regionkey < b.r_regionkey).select(F.col("n_name").alias("name_a"), F.col("r_name").alias("name_b"))


@query("SELECT doc_id, d.lang, l.quality FROM (SELECT CASE WHEN lang = 'de' THEN doc_id END AS doc_id, lang FROM documents) d FULL JOIN labels l USING (doc_id)")
def join_using(t):
    german = t.documents.select(F.when(F.col("lang") == "de", F.col("doc_id")).alias("doc_id"), "lang")
    return german.join(t.labels.select("doc_id", "quality"), on=["doc_id"], how="full")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t):
    # Dimension tables of fixed size; the operator is the reference's own.
    return t.region.select("r_name").crossJoin(t.nation.select("n_name"))


@query(
    """
    SELECT r.r_name, CAST(count(*) AS BIGINT) AS lines, CAST(sum(CAST(l.l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
    GROUP BY r.r_name
    """
)
def join_multiway(t):
    # Lines are summed per order before the joins, so the fact table meets them already reduced.
    per_order = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("quantity")
    )
    joined = join(per_order, t.orders.select("o_orderkey", "o_custkey"), [("l_orderkey", "o_orderkey")])
    per_customer = joined.groupBy("o_custkey").agg(F.sum("lines").alias("lines"), F.sum("quantity").alias("quantity"))
    placed = join(per_customer, t.customer.select("c_custkey", "c_nationkey"), [("o_custkey", "c_custkey")])
    named = join(join(placed, t.nation, [("c_nationkey", "n_nationkey")]), t.region, [("n_regionkey", "r_regionkey")])
    return named.groupBy("r_name").agg(F.sum("lines").alias("lines"), F.sum("quantity").cast("double").alias("quantity"))


@query(
    """
    WITH n AS (SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT 'as many as there are' AS bound, n, true AS joined FROM n UNION ALL SELECT 'one less', n, false FROM n
    """
)
def join_fan_out_guard(t):
    """A bound on the rows of a join lets it through, or stops it before it is built."""
    lines, orders = t.lineitem.select("l_orderkey", "l_linenumber"), t.orders.select("o_orderkey", "o_orderdate")
    on = [("l_orderkey", "o_orderkey")]
    size = join_cardinality(lines, orders, on).head()[0]
    found = []
    for name, bound in (("as many as there are", size), ("one less", size - 1)):
        try:
            found.append((name, join(lines, orders, on, max_output_rows=bound).count(), True))
        except ValidationError:
            found.append((name, size, False))
    return t.spark.createDataFrame(found, "bound STRING, n BIGINT, joined BOOLEAN")
