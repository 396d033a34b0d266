import pytest
from conftest import rows_of
from pyspark.sql import Row

from weir.errors import ConfigError, ValidationError
from weir.operators import filter_rows, parse_predicates


@pytest.fixture(scope="module")
def row(spark):
    return spark.createDataFrame([(10, "hello world", None, True)], "n BIGINT, s STRING, z STRING, b BOOLEAN")


@pytest.mark.parametrize(
    ("column", "op", "value", "passes"),
    [
        ("n", "eq", 10, True), ("n", "eq", "10", True), ("n", "eq", "ten", False), ("n", "ne", 11, True), ("n", "ne", "ten", True),
        ("n", "gt", 9, True), ("n", "gte", 10, True), ("n", "lt", 10, False), ("n", "lte", 10.5, True), ("n", "in", [1, 10, None], True),
        ("n", "not_in", [1, 2, None], True), ("n", "not_in", [10], False), ("n", "in", [], False), ("n", "in", ["10", "x"], True),
        ("s", "contains", "lo w", True), ("s", "not_contains", "zzz", True), ("s", "starts_with", "hell", True), ("s", "ends_with", "rld", True),
        ("s", "matches", "w.rld$", True), ("s", "matches", "^world", False), ("s", "gt", "abc", True), ("s", "eq", 5, False),
        ("z", "eq", "x", False), ("z", "ne", "x", False), ("z", "not_in", ["x"], False), ("z", "not_contains", "x", False), ("z", "null", None, True),
        ("s", "not_null", None, True), ("n", "eq", None, False), ("b", "eq", True, True), ("b", "eq", 0, False), ("n", "contains", "1", True),
    ],
)
def test_predicates(row, column, op, value, passes):
    spec = {"column": column, "op": op} | ({} if value is None and op in ("null", "not_null") else {"value": value})
    assert (filter_rows(row, [spec]).count() == 1) is passes


def test_case_and_between(row):
    assert filter_rows(row, [{"column": "s", "op": "contains", "value": "HELLO", "caseInsensitive": True}]).count() == 1
    assert filter_rows(row, [{"column": "s", "op": "matches", "value": "WORLD", "caseInsensitive": True}]).count() == 1
    assert filter_rows(row, [{"column": "n", "op": "between", "value": 10, "high": 12}]).count() == 1
    assert filter_rows(row, [{"column": "n", "op": "between", "value": None, "high": 12}]).count() == 0


def test_text_column_against_numbers(spark):
    df = spark.createDataFrame([("9",), ("10",), ("x",), (None,)], "s STRING")
    assert rows_of(filter_rows(df, [{"column": "s", "op": "lt", "value": 10}])) == [("9",)]
    assert rows_of(filter_rows(df, [{"column": "s", "op": "in", "value": [10.0, "x"]}])) == [("10",), ("x",)]


def test_dates(spark):
    df = spark.sql("SELECT DATE '2024-03-01' AS d, TIMESTAMP_NTZ '2024-03-01 10:00:00' AS t")
    assert filter_rows(df, [{"column": "d", "op": "eq", "value": "2024-03-01"}, {"column": "t", "op": "gt", "value": "2024-03-01T09:59:59"}]).count() == 1
    assert filter_rows(df, [{"column": "d", "op": "eq", "value": "soon"}]).count() == 0
    assert filter_rows(df, [{"column": "d", "op": "ne", "value": "soon"}]).count() == 1


def test_nested_values_compare_as_json(spark):
    df = spark.createDataFrame([Row(o=Row(a=1, b="x"))])
    assert filter_rows(df, [{"column": "o", "op": "contains", "value": '"a":1'}]).count() == 1


def test_combine_and_empty(spark, row):
    either = [{"column": "n", "op": "eq", "value": 1}, {"column": "s", "op": "not_null"}]
    assert filter_rows(row, either, "or").count() == 1
    assert filter_rows(row, either, "and").count() == 0
    assert filter_rows(row, []).count() == 1
    with pytest.raises(ValidationError):
        filter_rows(row, either, "and", on_empty="fail")


@pytest.mark.parametrize(
    "spec",
    [
        {"op": "eq"}, {"column": "n", "op": "like"}, {"column": "n", "op": "in", "value": 3}, {"column": "n", "op": "between", "value": 1},
        {"column": "s", "op": "matches", "value": "["}, {"column": "s", "op": "matches", "value": "x" * 513}, "text",
    ],
)
def test_bad_specs(spec):
    with pytest.raises(ConfigError):
        parse_predicates([spec])


def test_unknown_column_names_the_known_ones(row):
    with pytest.raises(ConfigError, match="Available columns: n, s, z, b"):
        filter_rows(row, [{"column": "nope", "op": "null"}])


def test_filters_reach_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = filter_rows(orders, [{"column": "o_totalprice", "op": "gte", "value": "100"}, {"column": "o_orderstatus", "op": "in", "value": ["F", None]}])
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan.select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_totalprice,100.0)" in text and "EqualTo(o_orderstatus,F)" in text
    assert "o_orderdate" not in text.split("ReadSchema")[1]
