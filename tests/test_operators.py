import random

import pytest
from conftest import rows_of
from pyspark.errors import PySparkException
from pyspark.sql import Row, functions as F

from weir.errors import ConfigError, ValidationError
from weir.functions import scalar as S
from weir.functions.redact import is_sensitive_name, redact, scrub
from weir.operators import (
    aggregate, capped, count_by_state, distinct_rows, flatten_once, join, join_cardinality, keyset_page, limit_offset, look_back, merge_rows,
    order_by, parse_keys, parse_measures, record_path,
)
from weir.operators.keyed import sliced_rows
from weir.operators.sort import decode_cursor, encode_cursor


@pytest.fixture(scope="module")
def sales(spark):
    rows = [(1, "c1", "north", 100, None), (2, "c1", "south", -5, "late"), (3, None, "north", 40, "x"), (4, "c2", "south", 60, None)]
    return spark.createDataFrame(rows, "id BIGINT, customer_id STRING, region STRING, amount BIGINT, note STRING")


@pytest.fixture(scope="module")
def customers(spark):
    return spark.createDataFrame([("c1", "Ann"), ("c2", "Bob"), ("c9", "Eve")], "id STRING, name STRING")


# ---- aggregate


def test_measures(sales):
    measures = [
        {"fn": "sum", "column": "amount", "as": "total"}, {"fn": "avg", "column": "amount"}, {"fn": "count"}, {"fn": "count", "column": "note", "as": "rows"},
        {"fn": "count_distinct", "column": "customer_id"}, {"fn": "first", "column": "note"}, {"fn": "last", "column": "note"},
    ]
    out = aggregate(sales, measures, ["region"], order_by=["id"])
    assert out.columns == ["region", "total", "avg_amount", "count", "rows", "count_distinct_customer_id", "first_note", "last_note"]
    assert rows_of(out) == [("north", 140, 70.0, 2, 2, 1, None, "x"), ("south", 55, 27.5, 2, 2, 2, "late", None)]


def test_no_groups_is_one_row(sales):
    measures = [{"fn": "count", "as": "n"}, {"fn": "sum", "column": "amount", "as": "s"}]
    assert rows_of(aggregate(sales.where("false"), measures)) == [(0, None)]


def test_null_group_and_text_sums(spark, sales):
    assert rows_of(aggregate(sales, [{"fn": "count", "as": "n"}], ["customer_id"])) == [("c1", 2), ("c2", 1), (None, 1)]
    texts = spark.createDataFrame([("1.5",), ("2",), (None,)], "v STRING")
    assert rows_of(aggregate(texts, [{"fn": "sum", "column": "v", "as": "s"}])) == [(3.5,)]
    with pytest.raises(PySparkException, match="non-numeric"):
        aggregate(spark.createDataFrame([("a",)], "v STRING"), [{"fn": "sum", "column": "v"}]).collect()


def test_aggregate_errors(sales):
    for specs in ([], [{"fn": "median", "column": "amount"}], [{"fn": "sum"}], ["x"]):
        with pytest.raises(ConfigError):
            parse_measures(specs)
    with pytest.raises(ConfigError, match="unknown column"):
        aggregate(sales, [{"fn": "sum", "column": "nope"}])


# ---- join


@pytest.mark.parametrize(("kind", "size"), [("inner", 3), ("left", 4), ("right", 4), ("full", 5)])
def test_join_kinds(sales, customers, kind, size):
    out = join(sales, customers, [("customer_id", "id")], kind)
    assert out.columns == ["id", "customer_id", "region", "amount", "note", "right_id", "name"]
    assert out.count() == size


def test_join_null_keys_never_match(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k STRING, v BIGINT")
    right = spark.createDataFrame([(None, 3), ("a", 4)], "k STRING, w BIGINT")
    assert rows_of(join(left, right, [("k", "k")])) == [("a", 2, "a", 4)]
    assert rows_of(join(left, right, [("k", "k")], "full")) == [("a", 2, "a", 4), (None, 1, None, None), (None, None, None, 3)]
    assert join_cardinality(left, right, [("k", "k")]).head()[0] == 1


def test_self_join_and_full_join_equal_spark(spark):
    random.seed(3)
    left = spark.createDataFrame([(random.choice([1, 1, 1, 2, 3, None]), i) for i in range(60)], "k BIGINT, v BIGINT")
    right = spark.createDataFrame([(random.choice([1, 2, 5, None]), i) for i in range(40)], "k BIGINT, w BIGINT")
    ours = join(left, right, [("k", "k")], "full")
    renamed = right.withColumnRenamed("k", "right_k")
    theirs = left.join(renamed, left.k == renamed.right_k, "full").select(*ours.columns)
    assert rows_of(ours) == rows_of(theirs)
    assert join(left, left, [("k", "k")], right_prefix="r_").count() == join_cardinality(left, left, [("k", "k")]).head()[0]


def test_join_guards(spark, sales, customers):
    keys = spark.createDataFrame([(1,)] * 50, "k BIGINT")
    with pytest.raises(ValidationError, match="more than 100 rows"):
        join(keys, keys, [("k", "k")], max_output_rows=100)
    assert join(keys, keys, [("k", "k")], max_output_rows=2500).count() == 2500
    with pytest.raises(ConfigError):
        join(sales, customers, [("nope", "id")])
    with pytest.raises(ConfigError, match="never match"):
        join(sales, customers, [("id", "id")])
    with pytest.raises(ConfigError, match="still collide"):
        join(spark.createDataFrame([(1, 2)], "k BIGINT, r_k BIGINT"), keys, [("k", "k")], right_prefix="r_")
    with pytest.raises(ConfigError):
        parse_keys([])


# ---- sort and pages


def test_null_order(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "v BIGINT")
    assert [r.v for r in order_by(df, ["v"]).collect()] == [1, 3, None]
    assert [r.v for r in order_by(df, [("v", "desc")]).collect()] == [None, 3, 1]
    assert [r.v for r in order_by(df, [("v", "desc", "last")]).collect()] == [3, 1, None]
    with pytest.raises(ConfigError):
        order_by(df, [("v", "down")])
    assert [r.v for r in distinct_rows(df.union(df), [("v", "desc")]).collect()] == [None, 3, 1]
    assert [r.v for r in limit_offset(order_by(df, ["v"]), 1, 1).collect()] == [3]


def test_capped(spark):
    assert capped(spark.range(10), 10).truncated is False
    head = capped(spark.range(11), 10)
    assert head.truncated is True and head.df.count() == 10


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_pages_cover_everything_once(spark, direction):
    df = spark.range(23).select((F.col("id") % 5).alias("v"), "id")
    seen, cursor = [], None
    while True:
        page = keyset_page(df, "v", "id", cursor, 6, direction)
        seen += [tuple(r) for r in page.rows.collect()]
        cursor = page.next_cursor()
        if cursor is None:
            break
    assert seen == sorted([(i % 5, i) for i in range(23)], reverse=direction == "desc")
    assert decode_cursor(encode_cursor("a b", "7")) == ("a b", "7")
    assert decode_cursor("!!") is None


# ---- per key


def test_merge_rows(spark):
    target = spark.createDataFrame([(1, "a", "keep"), (2, "b", "keep"), (None, "n", "keep")], "k BIGINT, v STRING, extra STRING")
    source = spark.createDataFrame([(2, "old", 1), (2, "new", 2), (3, "c", 1), (None, "m", 1), (None, "o", 1)], "k BIGINT, v STRING, at BIGINT")
    newest = merge_rows(target, source.withColumn("extra", F.lit("x")).drop("at"), ["k"])
    assert newest.where("k = 2").count() == 1
    first = merge_rows(target, source.orderBy("at").drop("at"), ["k"], [("v", "asc")])
    # the row that is there comes before both of the source's, so it stays
    assert rows_of(first) == [(1, "a", "keep"), (2, "b", "keep"), (3, "c", None), (None, "m", None), (None, "n", "keep"), (None, "o", None)]
    last = merge_rows(target, source.drop("at"), ["k"], [("v", "desc")])
    assert rows_of(last.where("k = 2")) == [(2, "old", "keep")]
    spark.conf.unset("spark.sql.unionOutputPartitioning")  # as in a session that knows nothing of it
    assert rows_of(merge_rows(target, source.drop("at"), ["k"], [("v", "desc")]).where("k = 2")) == [(2, "old", "keep")]
    timed = spark.createDataFrame([(1, 9, "there"), (2, 1, "there")], "k BIGINT, at BIGINT, v STRING")
    late = spark.createDataFrame([(1, 3, "late"), (2, 5, "newer"), (2, 4, "between")], timed.schema)
    assert rows_of(merge_rows(timed, late, ["k"], [("at", "desc")])) == [(1, 9, "there"), (2, 5, "newer")]
    without_order = [rows_of(merge_rows(timed, late.repartition(n), ["k"])) for n in (1, 3)]
    assert without_order[0] == without_order[1]
    keyed = source.where("k IS NOT NULL").drop("at")
    once = merge_rows(target, keyed, ["k"], ["v"])
    assert rows_of(merge_rows(once, keyed, ["k"], ["v"])) == rows_of(once)
    with pytest.raises(ConfigError):
        merge_rows(target, source, [])


def test_count_by_state(spark):
    df = spark.createDataFrame([("A",), ("A",), ("B",)], "s STRING")
    assert rows_of(count_by_state(df, "s", ["A", "B", "C"])) == [("A", 2), ("B", 1), ("C", 0)]


@pytest.mark.parametrize("slices", [57, 10, 1, None])
def test_look_back_slices_change_nothing(spark, slices):
    random.seed(5)
    # One hot key with most rows, ties in time, NULL times, and some cold keys.
    data = [(1 if random.random() < 0.7 else random.randint(2, 6), random.choice([None, *range(50)]), i, random.randint(0, 9)) for i in range(400)]
    df = spark.createDataFrame(data, "k BIGINT, at BIGINT, id BIGINT, v BIGINT")

    def build(window):
        frame = window.rowsBetween(-3, -1)
        return {"total": F.sum("v").over(frame), "ids": F.collect_list("id").over(window.rowsBetween(-3, 0))}

    got = {r.id: (r.total, list(r.ids)) for r in look_back(df, ["k"], ["at", "id"], 3, build, slices).collect()}
    want = {}
    for key in {d[0] for d in data}:
        ordered = sorted([d for d in data if d[0] == key], key=lambda d: (d[1] is not None, d[1] or 0, d[2]))
        for i, d in enumerate(ordered):
            before = ordered[max(0, i - 3) : i]
            want[d[2]] = (sum(b[3] for b in before) if before else None, [b[2] for b in before] + [d[2]])
    assert got == want


@pytest.mark.parametrize("times", ["one far off", "all the same"])
def test_slices_are_even(spark, times):
    """A hot key whose times are all alike, or all but one: no slice has twice the rows it should have."""
    at = F.when(F.col("id") == 0, F.lit(10**12)).otherwise(F.col("id") % 7) if times == "one far off" else F.lit(5)
    df = spark.range(24_000, numPartitions=6).select(F.lit("hot").alias("k"), at.cast("bigint").alias("at"), "id")
    sizes = [r["count"] for r in sliced_rows(df, ["k"], ["at", "id"], 12).groupBy("__slice").count().collect()]
    assert len(sizes) == 12 and max(sizes) < 2 * 24_000 / 12
    seen = look_back(df, ["k"], ["at", "id"], 2, lambda w: {"before": F.sum("id").over(w.rowsBetween(-2, -1))}, 12)
    ordered = [r.id for r in df.orderBy("at", "id").collect()]
    assert {r.id: r.before for r in seen.collect()} == {d: (sum(ordered[max(0, i - 2) : i]) if i else None) for i, d in enumerate(ordered)}


# ---- projection


def test_flatten_and_record_path(spark):
    df = spark.createDataFrame([Row(a=Row(x=1, y=Row(z=2)), b=[1, 2], c=3)])
    flat = flatten_once(df)
    assert flat.columns == ["a_x", "a_y", "b", "c"] and flat.head().a_y.z == 2
    nested = spark.createDataFrame([Row(data=Row(items=[Row(id=1), Row(id=2)], tags=["p", "q"]))])
    assert rows_of(record_path(nested, "data.items")) == [(1,), (2,)]
    assert rows_of(record_path(nested, "data..tags")) == [("p",), ("q",)]
    for path in ("data.nope", "data"):
        with pytest.raises(ConfigError, match="did not resolve to an array"):
            record_path(nested, path)


# ---- scalar functions


def test_scalar_table(spark):
    from weir.functions.scalar import register_sql_functions

    register_sql_functions(spark)
    one = spark.range(1)
    null = F.lit(None).cast("string")
    cases = [
        (S.to_integer(F.lit("12.9")), 12), (S.to_integer(F.lit("-12.9")), -12), (S.to_integer(F.lit("x")), None), (S.to_float(F.lit("1e2")), 100.0),
        (S.to_boolean(F.lit("Yes")), True), (S.to_boolean(F.lit("on")), False), (S.to_boolean(null), None), (S.to_boolean(F.lit(2), numeric=True), True),
        (S.coerce_boolean(F.lit("n")), False), (S.coerce_boolean(F.lit("maybe")), None), (S.trim(F.lit("\t a b \n")), "a b"), (S.ltrim(F.lit("\n a ")), "a "),
        (S.rtrim(F.lit(" a\t\n")), " a"), (S.substr(F.lit("hello"), 0, 2), "he"), (S.substr(F.lit("hello"), -3, 2), "he"), (S.substr(F.lit("hello"), 4), "lo"),
        (S.concat(F.lit("a"), null, F.lit(1)), "a1"), (S.concat_ws(null, F.lit("a"), F.lit("b")), "ab"), (S.concat_ws("-", F.lit("a"), null, F.lit("b")), "a-b"),
        (S.split_part(F.lit("a,b,c"), ",", 2), "b"), (S.split_part(F.lit("a,b,c"), ",", 0), ""), (S.split_part(F.lit("a,b,c"), ",", -1), ""),
        (S.split_part(F.lit("a,b,c"), ",", 9), ""), (S.position("lo", F.lit("hello")), 4), (S.position("z", F.lit("hello")), 0), (S.sqrt(F.lit(9)), 3.0),
        (S.modulo(F.lit(-7), 3), -1.0), (S.divide(F.lit(5), 2), 2.5), (S.greatest(F.lit(3)), 3), (S.least(F.lit(3), F.lit(None).cast("int"), F.lit(1)), 1),
        (S.like(F.lit("a.c"), "a.c"), True), (S.like(F.lit("abc"), "a.c"), False), (S.like(F.lit("a\\c"), "a\\c"), True), (S.like(F.lit("ABC"), "a_c", ignore_case=True), True),
        (F.expr("w_int('7.8')"), 7), (F.expr("w_bool('T')"), True), (F.expr("w_split_part('a b', ' ', 2)"), "b"), (F.expr("w_substr('hello', -1, 3)"), "hel"),
        (F.expr("w_trim('\\t x ')"), "x"), (F.round(F.lit(-2.5)), -3.0), (F.round(F.lit(2.345), 2), 2.35),
    ]
    out = one.select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).head()
    for i, (_, expected) in enumerate(cases):
        assert out[i] == expected, (i, out[i], expected)


def test_scalar_failures(spark):
    for column in (S.sqrt(F.lit(-1)), S.divide(F.lit(1), 0), S.modulo(F.lit(1), 0), F.expr("1 / 0"), F.expr("5 % 0")):
        with pytest.raises(PySparkException):
            spark.range(1).select(column).collect()
    with pytest.raises(ConfigError):
        S.date_trunc("decade", F.lit("2024-01-01"))


def test_date_trunc(spark):
    df = spark.sql("SELECT '2026-03-29 13:45:10' AS t, 'never' AS bad")
    out = df.select(S.date_trunc("week", "t").alias("w"), S.date_trunc("QUARTER", "t").alias("q"), S.date_trunc("day", "bad").alias("n")).head()
    assert str(out.w) == "2026-03-23 00:00:00" and str(out.q) == "2026-01-01 00:00:00" and out.n is None


# ---- redaction


def test_scrub(spark):
    texts = {
        "postgres://ann:s3cret@db:5432/x": "postgres://ann:[REDACTED]@db:5432/x", "Authorization: Bearer abc.def-123456": "Authorization: Bearer [REDACTED]",
        "key sk-abcdefgh12 end": "key [REDACTED] end", "AKIAABCDEFGHIJKL": "[REDACTED]", "basic info": "basic info", "http://host/path": "http://host/path",
    }
    df = spark.createDataFrame([(k, v) for k, v in texts.items()], "a STRING, b STRING")
    assert df.where(scrub("a") != F.col("b")).count() == 0


def test_redact_structure(spark):
    df = spark.createDataFrame(
        [Row(user="bob", api_key="k", secretRef="vault/1", cfg=Row(password="p", host="h", deep=[Row(token="t", n=1)]), extra={"cookie": "c", "note": "Bearer abcdefgh1"})]
    )
    out = redact(df).head()
    assert out.user == "bob" and out.api_key == "[REDACTED]" and out.secretRef == "vault/1"
    assert out.cfg.password == "[REDACTED]" and out.cfg.host == "h" and out.cfg.deep[0].token == "[REDACTED]" and out.cfg.deep[0].n == 1
    assert out.extra == {"cookie": "[REDACTED]", "note": "Bearer [REDACTED]"}
    assert is_sensitive_name("userPasswd") and is_sensitive_name("X-Api-Key") and not is_sensitive_name("secretRef") and not is_sensitive_name("amount")


def test_join_cardinality_is_one_grouping(spark):
    left = spark.createDataFrame([(1, "2024-01-01"), (1, "2024-01-01"), (2, "2024-01-02"), (None, "2024-01-01"), (3, None)], "k INT, d STRING")
    right = spark.sql("SELECT * FROM VALUES (1L, DATE '2024-01-01'), (1L, DATE '2024-01-01'), (1L, DATE '2024-01-01'), (2L, DATE '2024-01-03'), (NULL, NULL) AS t(k, d)")
    found = join_cardinality(left, right, [("k", "k"), ("d", "d")])
    assert found.head()[0] == 6 and join_cardinality(left, right.limit(0), [("k", "k")]).head()[0] == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
