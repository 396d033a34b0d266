"""Filters and predicates (F)."""

from pyspark.sql import functions as F

from weir.catalog.registry import query
from weir.functions.scalar import like
from weir.operators import filter_rows, project


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus = 'F'")
def filter_and(t):
    kept = filter_rows(
        t.orders,
        [{"column": "o_totalprice", "op": "gte", "value": 100000}, {"column": "o_orderstatus", "op": "eq", "value": "F"}],
    )
    return kept.select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice < 20000 OR o_orderpriority <> '5-LOW' AND o_orderstatus = 'P'")
def filter_or(t):
    low = filter_rows(
        t.orders,
        [{"column": "o_orderpriority", "op": "ne", "value": "5-LOW"}, {"column": "o_orderstatus", "op": "eq", "value": "P"}],
    ).select("o_orderkey")
    cheap = filter_rows(t.orders, [{"column": "o_totalprice", "op": "lt", "value": "20000"}]).select("o_orderkey")
    return low.union(cheap).distinct()


@query("SELECT * FROM nation")
def filter_no_predicates(t):
    return filter_rows(t.nation, [], "or")


@query(
    """
    SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    WHERE l_quantity > 10 OR l_discount <= 0.02 OR l_shipdate < TIMESTAMP '1996-06-01'
    """
)
def filter_comparisons(t):
    kept = filter_rows(
        t.lineitem,
        [
            {"column": "l_quantity", "op": "gt", "value": 10},
            {"column": "l_discount", "op": "lte", "value": 0.02},
            {"column": "l_shipdate", "op": "lt", "value": "1996-06-01"},
        ],
        combine="or",
    )
    return kept.select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    """
    WITH p AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority FROM orders)
    SELECT o_orderkey, priority, 'in' AS rule FROM p WHERE priority IN ('1-URGENT', '2-HIGH')
    UNION ALL SELECT o_orderkey, priority, 'not_in' FROM p WHERE priority NOT IN ('1-URGENT', '2-HIGH')
    """
)
def filter_in_null(t):
    orders = t.orders.select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))
    values = ["1-URGENT", None, "2-HIGH"]
    parts = [
        filter_rows(orders, [{"column": "priority", "op": op, "value": values}]).withColumn("rule", F.lit(op))
        for op in ("in", "not_in")
    ]
    return parts[0].unionByName(parts[1])


@query(
    """
    WITH p AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders)
    SELECT 'null' AS rule, count(*) AS n FROM p WHERE status IS NULL
    UNION ALL SELECT 'not_null', count(*) FROM p WHERE status IS NOT NULL
    UNION ALL SELECT 'ne', count(*) FROM p WHERE status <> 'F'
    """
)
def filter_nulls(t):
    orders = t.orders.select(F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    rules = [{"column": "status", "op": "null"}, {"column": "status", "op": "not_null"}, {"column": "status", "op": "ne", "value": "F"}]
    parts = [filter_rows(orders, [r]).agg(F.lit(r["op"]).alias("rule"), F.count(F.lit(1)).alias("n")) for r in rules]
    return parts[0].union(parts[1]).union(parts[2])


@query(
    """
    WITH p AS (SELECT p_partkey, p_name, p_type, nullif(p_brand, 'Brand#1') AS brand FROM part)
    SELECT p_partkey, 'contains' AS rule FROM p WHERE contains(lower(p_name), 'ring')
    UNION ALL SELECT p_partkey, 'not_contains' FROM p WHERE NOT contains(brand, '#2')
    UNION ALL SELECT p_partkey, 'starts_with' FROM p WHERE starts_with(p_name, 'small')
    UNION ALL SELECT p_partkey, 'ends_with' FROM p WHERE ends_with(lower(p_type), 'my')
    """
)
def filter_text_ops(t):
    part = t.part.withColumn("brand", F.nullif("p_brand", F.lit("Brand#1")))
    rules = [
        {"column": "p_name", "op": "contains", "value": "RING", "caseInsensitive": True},
        {"column": "brand", "op": "not_contains", "value": "#2"},
        {"column": "p_name", "op": "starts_with", "value": "small"},
        {"column": "p_type", "op": "ends_with", "value": "My", "caseInsensitive": True},
    ]
    parts = [filter_rows(part, [r]).select("p_partkey", F.lit(r["op"]).alias("rule")) for r in rules]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(
    r"""
    SELECT doc_id, 'hex' AS rule FROM documents WHERE regexp_matches(text, '[0-9a-f]{16}')
    UNION ALL SELECT doc_id, 'mail' FROM documents WHERE regexp_matches(text, '(?i)[a-z0-9._]+@[a-z0-9.]+\.[a-z]{2,}')
    """
)
def filter_regex(t):
    documents = t.documents.select("doc_id", "text")
    hexadecimal = filter_rows(documents, [{"column": "text", "op": "matches", "value": "[0-9a-f]{16}"}])
    mail = filter_rows(
        documents,
        [{"column": "text", "op": "matches", "value": r"[a-z0-9._]+@[a-z0-9.]+\.[a-z]{2,}", "caseInsensitive": True}],
    )
    return hexadecimal.select("doc_id", F.lit("hex").alias("rule")).union(mail.select("doc_id", F.lit("mail").alias("rule")))


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity BETWEEN 5 AND 24")
def filter_between(t):
    kept = filter_rows(
        t.lineitem,
        [
            {"column": "l_discount", "op": "between", "value": 0.05, "high": 0.07},
            {"column": "l_quantity", "op": "between", "value": 5, "high": 24},
        ],
    )
    return kept.select("l_orderkey", "l_linenumber", "l_discount")


@query(
    """
    SELECT c_custkey, 'text_eq_number' AS rule FROM customer WHERE substr(c_name, 10) = '000000042'
    UNION ALL SELECT c_custkey, 'number_ne_text' FROM customer
    UNION ALL SELECT c_custkey, 'number_eq_numeric_text' FROM customer WHERE c_nationkey = 7
    """
)
def filter_mixed_types(t):
    customer = t.customer.withColumn("number_text", F.substr("c_name", F.lit(10)))
    rules = {
        "text_eq_number": {"column": "number_text", "op": "eq", "value": 42},
        "number_ne_text": {"column": "c_nationkey", "op": "ne", "value": "abc"},
        "number_eq_numeric_text": {"column": "c_nationkey", "op": "eq", "value": "7"},
    }
    parts = [filter_rows(customer, [r]).select("c_custkey", F.lit(name).alias("rule")) for name, r in rules.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query(
    """
    WITH p AS (SELECT o_orderkey, o_totalprice, nullif(o_orderstatus, 'P') AS s, nullif(o_orderpriority, '5-LOW') AS q FROM orders)
    SELECT o_orderkey,
           (s = 'F' AND q <> '1-URGENT') AS both_hold,
           (s = 'F' OR q IN ('1-URGENT', '2-HIGH')) AS either_holds,
           NOT (s = 'O') AS negated,
           q NOT IN ('1-URGENT', '3-MEDIUM') AS outside_list,
           o_totalprice NOT BETWEEN 50000 AND 150000 AS outside_range,
           s IS NOT NULL AS known
    FROM p
    """
)
def predicate_logic(t):
    p = t.orders.select(
        "o_orderkey", "o_totalprice", F.nullif("o_orderstatus", F.lit("P")).alias("s"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("q")
    )
    s, q = F.col("s"), F.col("q")
    return project(
        p,
        {
            "o_orderkey": "o_orderkey",
            "both_hold": (s == "F") & (q != "1-URGENT"),
            "either_holds": (s == "F") | q.isin("1-URGENT", "2-HIGH"),
            "negated": ~(s == "O"),
            "outside_list": ~q.isin("1-URGENT", "3-MEDIUM"),
            "outside_range": ~F.col("o_totalprice").between(50000, 150000),
            "known": s.isNotNull(),
        },
    )


@query(
    r"""
    WITH p AS (SELECT p_partkey, p_name, p_name || CASE WHEN p_size < 25 THEN '\x' ELSE '_x' END AS tagged FROM part)
    SELECT p_partkey, p_name LIKE 'sm%' AS starts, p_name ILIKE '%RING' AS ends_any_case, p_name LIKE '_ed%' AS one_char,
           p_name NOT LIKE '%t' AS no_t, ends_with(tagged, '\x') AS plain_backslash
    FROM p
    """
)
def like_ilike(t):
    tagged = F.concat("p_name", F.when(F.col("p_size") < 25, "\\x").otherwise("_x"))
    return project(
        t.part,
        {
            "p_partkey": "p_partkey",
            "starts": like("p_name", "sm%"),
            "ends_any_case": like("p_name", "%RING", ignore_case=True),
            "one_char": like("p_name", "_ed%"),
            "no_t": ~like("p_name", "%t"),
            "plain_backslash": like(tagged, "%\\x"),
        },
    )


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'")
def sql_where(t):
    t.orders.createOrReplaceTempView("weir_orders")
    return t.spark.sql(
        "SELECT o_orderkey, o_totalprice FROM weir_orders "
        "WHERE o_orderdate >= TIMESTAMP_NTZ '1998-01-01' AND o_orderdate < TIMESTAMP_NTZ '1999-01-01'"
    )
