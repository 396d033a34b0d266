import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from weir.contracts import coerce, diff_schemas, fingerprints, infer_columns, infer_schema, latest_changes, preview, probe, profile, register, schema_history, unify, validate
from weir.contracts.evolve import classify_type_change, worst_classification
from weir.contracts.infer import ColumnSpec, columns_table
from weir.contracts.registry import VERSIONS_SCHEMA
from weir.errors import ValidationError


@pytest.mark.parametrize(
    ("value", "kind"),
    [
        ("", "unknown"), (None, "unknown"), ("12", "integer"), ("-7", "integer"), ("+5", "integer"), ("123456789012345", "integer"), ("12345678901234567890", "string"),
        ("1.5", "float"), (".5", "float"), ("5.", "float"), ("1e5", "float"), ("-2.5E-3", "float"), ("true", "boolean"), ("FALSE", "boolean"), ("yes", "string"),
        ("2024-01-31", "date"), ("2024-01-31T10:00", "timestamp"), ("2024-01-31 10:00:00.123Z", "timestamp"), ("2024-01-31T10:00:00+02:00", "timestamp"),
        ("31/01/2024", "string"), ("12 ", "string"), ("7\n", "string"),
    ],
)
def test_value_classes(spark, value, kind):
    df = spark.createDataFrame([(value,)], "v STRING")
    assert infer_columns(df) == [ColumnSpec("v", kind, value in ("", None))]


@pytest.mark.parametrize(
    ("types", "expected"),
    [
        ([], "unknown"), (["unknown", "date"], "date"), (["integer", "float"], "float"), (["date", "timestamp"], "timestamp"), (["integer", "json"], "json"),
        (["integer", "date"], "string"), (["integer", "float", "date"], "string"), (["boolean", "boolean"], "boolean"),
    ],
)
def test_unify(types, expected):
    assert unify(types) == expected


def test_inference_over_columns(spark):
    rows = [("1", "Ann", "1.5", "true", "2024-01-01", 1), ("2", None, "2", "false", "2024-01-01T00:00:00", None), ("3", "x", "", "true", "2024-01-02", 3)]
    df = spark.createDataFrame(rows, "id STRING, name STRING, score STRING, active STRING, joined STRING, n BIGINT").withColumn("o", F.struct("n"))
    assert [(c.name, c.type, c.nullable) for c in infer_columns(df)] == [
        ("id", "integer", False), ("name", "string", True), ("score", "float", True), ("active", "boolean", False), ("joined", "timestamp", False), ("n", "integer", True),
        ("o", "json", False),
    ]
    assert infer_columns(df.select("id"), null_values=["1"])[0].nullable
    assert probe(df, 1)[1] == ColumnSpec("name", "string", False)
    typed = coerce(df, infer_columns(df))
    assert dict(typed.dtypes)["id"] == "bigint" and dict(typed.dtypes)["active"] == "boolean" and typed.agg(F.sum("score")).head()[0] == 3.5


def test_coerce_bad_values(spark):
    df = spark.createDataFrame([("12abc", "maybe", "{bad", "2024-13-01")], "i STRING, b STRING, j STRING, d STRING")
    specs = [ColumnSpec("i", "integer", True), ColumnSpec("b", "boolean", True), ColumnSpec("j", "json", True), ColumnSpec("d", "date", True)]
    assert tuple(coerce(df, specs).select("i", "b", F.col("j").cast("string"), "d").head()) == (None, None, None, None)


def test_profile(spark):
    df = spark.createDataFrame([("5", 1, "a"), ("40", None, ""), (None, 3, "a")], "t STRING, n BIGINT, s STRING")
    assert rows_of(profile(df, samples=True), "name", "type", "nullable", "null_count", "unique_count", "min", "max") == [
        ("n", "integer", True, 1, 2, "1", "3"), ("s", "string", True, 1, 1, None, None), ("t", "integer", True, 1, 2, "5.0", "40.0"),
    ]
    assert {r.name: r.sample for r in profile(df, exact_distinct=False, samples=True).collect()}["s"] == ["a"]
    late = spark.range(3000).select(F.when(F.col("id") > 2990, F.col("id").cast("string")).alias("x"))
    assert len(profile(late, samples=True).head().sample) > 1
    shown = preview(spark.range(150))
    assert shown.rows.count() == 100 and shown.truncated
    assert preview(spark.range(150), 120).rows.count() == 120


# ---- evolution


def columns(spark, *specs):
    return columns_table(spark, [{"name": n, "type": t, "nullable": nullable} for n, t, nullable in specs])


@pytest.mark.parametrize(
    ("a", "b", "kind"),
    [
        ("integer", "float", "COMPATIBLE"), ("date", "timestamp", "COMPATIBLE"), ("unknown", "json", "COMPATIBLE"), ("integer", "string", "WARNING"), ("string", "json", "WARNING"),
        ("float", "integer", "BREAKING"), ("string", "integer", "BREAKING"), ("timestamp", "date", "BREAKING"), ("json", "json", "COMPATIBLE"),
    ],
)
def test_type_changes(spark, a, b, kind):
    assert spark.range(1).select(classify_type_change(F.lit(a), F.lit(b))).head()[0] == kind


def test_diff(spark):
    before = columns(spark, ("id", "integer", False), ("name", "string", True), ("gone", "date", True), ("age", "integer", False))
    after = columns(spark, ("id", "float", True), ("name", "string", False), ("extra", "string", True), ("must", "string", False), ("age", "integer", False))
    assert rows_of(diff_schemas(before, after), "column", "kind", "classification") == [
        ("extra", "column_added", "COMPATIBLE"), ("gone", "column_removed", "BREAKING"), ("id", "nullability_relaxed", "WARNING"), ("id", "type_changed", "COMPATIBLE"),
        ("must", "column_added", "WARNING"), ("name", "nullability_tightened", "COMPATIBLE"),
    ]
    assert diff_schemas(before, after).agg(worst_classification("classification")).head()[0] == "BREAKING"
    assert diff_schemas(before, before).agg(worst_classification("classification")).head()[0] == "COMPATIBLE"
    reason = diff_schemas(before, after).where("kind = 'type_changed'").head().reason
    assert reason == "Widened integer to float"


def test_fingerprint_ignores_column_order(spark):
    import hashlib

    a, b = ("id", "integer", False), ("name", "string", True)
    expected = hashlib.sha256(b"id:integer:notnull|name:string:null").hexdigest()[:32]
    assert fingerprints(columns(spark, a, b)).head()[0] == fingerprints(columns(spark, b, a)).head()[0] == expected
    assert fingerprints(columns(spark, a, ("name", "string", False))).head()[0] != expected


def test_register_and_history(spark):
    versions = spark.createDataFrame([], VERSIONS_SCHEMA)
    v1 = columns(spark, ("id", "integer", False)).withColumn("dataset", F.lit("d"))
    rows = register(v1, versions)
    assert rows_of(rows, "dataset", "version", "name") == [("d", 1, "id")]
    versions = versions.unionByName(rows)
    assert register(v1, versions).count() == 0
    v2 = columns(spark, ("id", "float", False)).withColumn("dataset", F.lit("d"))
    versions = versions.unionByName(register(v2, versions))
    v3 = columns(spark, ("id", "float", False), ("x", "string", True)).withColumn("dataset", F.lit("d"))
    versions = versions.unionByName(register(v3, versions))
    assert rows_of(schema_history(versions), "version", "column", "kind") == [(2, "id", "type_changed"), (3, "x", "column_added")]
    assert rows_of(latest_changes(versions), "version", "column", "kind") == [(3, "x", "column_added")]


def test_validate(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id BIGINT, name STRING")
    first = validate(df, "d")
    assert first.first_version and first.classification == "COMPATIBLE" and first.new_rows.count() == 2
    versions = first.new_rows
    assert validate(df, "d", versions).changes == []
    wider = df.withColumn("extra", F.lit(None).cast("string"))
    grown = validate(wider, "d", versions)
    assert grown.classification == "COMPATIBLE" and rows_of(grown.new_rows, "version", "name")[0] == (2, "extra")
    with pytest.raises(ValidationError, match="BREAKING: name"):
        validate(df.drop("name"), "d", versions)
    assert validate(df.drop("name"), "d", versions, on_breaking="warn").classification == "BREAKING"
    contract = [{"name": "id", "type": "integer", "nullable": False}, {"name": "name", "type": "string", "nullable": False}]
    with pytest.raises(ValidationError, match="needs review"):
        validate(df, "d", expected=contract, on_warning="fail")
    assert infer_schema(df).count() == 2
