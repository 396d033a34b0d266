import csv
import importlib
import random
import json
from datetime import datetime, timezone
from pathlib import Path

import pytest
from conftest import rows_of
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weir.catalog import QUERIES
from weir.errors import ConfigError, GateBlocked, ValidationError
from weir.sources import (
    Datasets, generate, incremental, landed_records, next_watermark, publish_checked, read_csv, read_jdbc, read_json, read_ndjson, read_object, render, write_csv,
    write_jdbc, write_object,
)
from weir.sources.csv import unique_header
from weir.sources.json import array_elements
from weir.sources.splits import read_lines
from weir.sources.jdbc import check_read_only, check_table, create_table_sql, upsert_sql
from weir.sources.objects import RunInfo


def put(folder, name, text):
    path = Path(folder) / name
    path.parent.mkdir(exist_ok=True)
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


# ---- CSV


def test_csv_quoting_and_types(spark, folder):
    path = put(folder, "a.csv", 'id,note,when,flag,score\r\n1,"a, ""b""\nnext",2024-01-01,TRUE,1.5\r\n2,plain,2024-01-02,false,2\r\n')
    df = read_csv(spark, path)
    assert dict(df.dtypes) == {"id": "bigint", "note": "string", "when": "date", "flag": "boolean", "score": "double"}
    assert rows_of(df, "id", "note", "flag", "score") == [(1, 'a, "b"\nnext', True, 1.5), (2, "plain", False, 2.0)]


def test_csv_bom_nulls_short_rows(spark, folder):
    path = put(folder, "a.csv", "﻿id;name;name; \n1;NULL;null;x\n2;\\N\n3;;b;\n\n")
    df = read_csv(spark, path, delimiter=";", infer_types=False)
    assert df.columns == ["id", "name", "name_2", "column_4"]
    assert rows_of(df) == [("1", None, None, "x"), ("2", None, None, None), ("3", None, "b", None)]


def test_csv_own_null_values_and_no_header(spark, folder):
    path = put(folder, "a.csv", "1,,n/a\n2,x\n")
    df = read_csv(spark, path, has_header=False, null_values=["n/a"], infer_types=False)
    assert df.columns == ["column_1", "column_2", "column_3"]
    assert rows_of(df) == [("1", "", None), ("2", "x", None)]


def test_csv_errors(spark, folder):
    long_row = put(folder, "long.csv", 'a,b\n1,2\n3,"x,y",5\n')
    with pytest.raises(PySparkException, match="has 3 fields but the header declares 2"):
        read_csv(spark, long_row, infer_types=False).collect()
    with pytest.raises(ValidationError, match="inside a quoted field"):
        read_csv(spark, put(folder, "open.csv", 'a,b\n1,"x\n2,y\n'))
    with pytest.raises(ConfigError):
        read_csv(spark, long_row, delimiter="||")


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_csv_files_are_split(spark, folder, small_splits):
    flat = put(folder, "flat.csv", "a,b\n" + "".join(f'{i},"x{i}"\n' for i in range(5000)))
    assert read_csv(spark, flat, infer_types=False).rdd.getNumPartitions() > 3
    spanning = put(folder, "span.csv", "a,b\n" + "".join(f'{i},"x\n{i}"\n' for i in range(5000)))
    assert read_lines(spark, spanning).rdd.getNumPartitions() > 3
    df = read_csv(spark, spanning, infer_types=False)
    assert rows_of(df) == sorted((str(i), f"x\n{i}") for i in range(5000))


def test_csv_records_over_splits(spark, folder, small_splits):
    """Fields with line ends, quotes, delimiters and no end to them, cut in 4 KB splits, against a plain reader."""
    rng = random.Random(8)
    bits = ["a", "é", '"', ",", "\n", "\r\n", " ", "x" * 50, "日本", '""', '"\n,"']
    for turn, newline in enumerate(("\n", "\r\n")):
        rows = [[str(n), *("".join(rng.choices(bits, k=rng.choice([0, 1, 3, 8, 40]))) for _ in range(2))] for n in range(300)]
        rows[100][1] = "long\n" * 4000  # over several splits
        rows[200][2] = "no line end " * 1500
        path = f"{folder}/{turn}.csv"
        with open(path, "w", newline="") as file:
            csv.writer(file, lineterminator=newline).writerows([["id", "one", "two\nlines"], *rows])
        df = read_csv(spark, path, null_values=[], infer_types=False)
        assert df.columns == ["id", "one", "two\nlines"]
        assert rows_of(df) == sorted(tuple(r) for r in rows)


def test_csv_quotes_inside_fields(spark, folder):
    path = put(folder, "bare.csv", 'n,size,t\n1,5" pipe,x\n2,6",y\n3,"7""",z\n4,a"b"c,"q, r"\n')
    assert rows_of(read_csv(spark, path)) == [(1, '5" pipe', "x"), (2, '6"', "y"), (3, '7"', "z"), (4, 'a"b"c', "q, r")]


def test_csv_headers_per_file(spark, folder):
    put(folder, "in/a.csv", "id,name\n1,aa\n")
    put(folder, "in/b.csv", "name,id,more\ncc,3,x\n")
    put(folder, "in/c.csv", 'more,name,id\n"two\nlines",dd,4\n')
    put(folder, "in/d.csv", 'id,name\n5,"e\ne"\n')
    put(folder, "in/empty.csv", "")
    df = read_csv(spark, f"{folder}/in")
    assert df.columns == ["id", "name", "more"]
    assert rows_of(df) == [(1, "aa", None), (3, "cc", "x"), (4, "dd", "two\nlines"), (5, "e\ne", None)]


def test_csv_partition_folders(spark, folder):
    rows = [(1, "a", 2024, "x"), (2, "b\nb", 2024, "y"), (3, "c", 2025, "x")]
    write_csv(spark.createDataFrame(rows, "id BIGINT, t STRING, year INT, k STRING"), f"{folder}/p", partition_by=["year", "k"])
    assert rows_of(read_csv(spark, f"{folder}/p")) == rows


def test_csv_write(spark, folder):
    df = spark.createDataFrame([(1, 'say "hi", x', None), (2, "plain", "")], "id BIGINT, t STRING, n STRING").withColumn("o", F.struct("id"))
    write_csv(df.coalesce(1), f"{folder}/out")
    text = next(Path(f"{folder}/out").glob("part-*")).read_text()
    assert text.splitlines() == ["id,t,n,o", '1,"say ""hi"", x",,"{""id"":1}"', '2,plain,,"{""id"":2}"']


def test_unique_header():
    assert unique_header(["a", "a", "", None, "b ", "a"]) == ["a", "a_2", "column_3", "column_4", "b", "a_3"]
    assert unique_header(["a", "a", "a_2"]) == ["a", "a_3", "a_2"]


# ---- JSON


def test_json_array_and_path(spark, folder):
    path = put(folder, "a.json", json.dumps([{"id": 1, "o": {"x": 2, "deep": {"y": 3}}, "l": [1, 2]}, {"id": 2, "o": None, "new": "z"}]))
    df = read_json(spark, path)
    assert set(df.columns) == {"id", "o_x", "o_deep", "l", "new"}
    assert rows_of(df, "id", "o_x", "new") == [(1, 2, None), (2, None, "z")]
    nested = put(folder, "b.json", json.dumps({"data": {"items": [{"id": 5}]}}))
    assert rows_of(read_json(spark, nested, "data.items")) == [(5,)]
    with pytest.raises(PySparkException, match="did not resolve to an array"):
        read_json(spark, nested, "data.nope").collect()
    with pytest.raises(Exception, match="MALFORMED"):
        read_json(spark, put(folder, "c.json", "{bad")).collect()


@pytest.mark.parametrize("indent", [None, 1])
def test_large_json_array_is_read_by_many_tasks(spark, folder, small_splits, indent):
    """One array with braces and brackets in strings, escapes, nested and scalar elements, on one line or many."""
    rng = random.Random(9)
    texts = ["}", "{", "],[", '\\"', 'say "}"', "a\\\\", "é\n", ",", "x" * 30, "{" * 9000, "", "\\"]
    rows = [{"id": n, "t": "".join(rng.choices(texts, k=rng.choice([0, 1, 2, 4]))), "o": {"l": [n, {"k": rng.choice(texts)}]}} for n in range(400)]
    path = put(folder, "big.json", json.dumps(rows, indent=indent, ensure_ascii=False) + "\n")
    assert read_lines(spark, path, "}").rdd.getNumPartitions() > 10
    df = read_json(spark, path)
    assert rows_of(df, "id", "t") == [(r["id"], r["t"]) for r in rows]
    small = put(folder, "few/a.json", json.dumps(rows[:2]))
    put(folder, "few/b.json", json.dumps(rows[2:], indent=indent))
    assert rows_of(read_json(spark, str(Path(small).parent)), "id", "t") == [(r["id"], r["t"]) for r in rows]


def test_large_json_arrays_of_scalars_and_errors(spark, folder, small_splits):
    values = [*range(3000), [], [1, "]"], "}", None]
    path = put(folder, "v.json", json.dumps(values))
    got = [r["text"].strip() for r in array_elements(spark, [path]).collect()]
    assert sorted(got) == sorted(json.dumps(v) for v in values)
    with pytest.raises(Exception, match="Expected a JSON array"):
        read_json(spark, put(folder, "o.json", json.dumps({"a": values}))).collect()


def test_json_scalars(spark, folder):
    assert rows_of(read_json(spark, put(folder, "a.json", "[1, 2, 3]"))) == [(1,), (2,), (3,)]
    mixed = read_json(spark, put(folder, "b.json", '[{"id": 1}, 7]'))
    assert rows_of(mixed, "id", "value") == [(1, None), (None, 7)]


def test_ndjson(spark, folder):
    path = put(folder, "a.ndjson", '{"id": 1, "o": {"k": "v"}}\n\n{"id": 2}\n')
    assert rows_of(read_ndjson(spark, path), "id", "o_k") == [(1, "v"), (2, None)]
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        read_ndjson(spark, put(folder, "b.ndjson", '{"id": 1}\nnot json\n')).collect()


def test_landed_pages(spark):
    def body(items, cursor=None):
        return json.dumps({"items": items, "next_cursor": cursor})

    rows = [("s", 1, body([{"id": 1}], "a")), ("s", 2, body([{"id": 2}, {"id": 3}], "")), ("s", 3, body([{"id": 4}], "b")), ("t", 1, body([])), ("t", 2, body([{"id": 9}]))]
    df = spark.createDataFrame(rows, "source STRING, page BIGINT, body STRING")
    assert rows_of(landed_records(df, "items"), "source", "id") == [("s", 1), ("s", 2), ("s", 3), ("s", 4)]
    assert rows_of(landed_records(df, "items", "cursor"), "id") == [(1,), (2,), (3,)]
    assert rows_of(landed_records(df, "items", "none"), "id") == [(1,)]
    assert rows_of(landed_records(df, "items", max_pages=1), "id") == [(1,)]


# ---- objects and templates


def test_render():
    run = RunInfo("r9", "sales", 4, "2024-05-06T01:00:00.000Z", None, {"a": {"b": 7}})
    assert render("x/{{ run.date }}/{{run.id}}-{{ params.a.b }}-{{ params.zzz }}-{{ other }}", run) == "x/2024-05-06/r9-7-{{ params.zzz }}-{{ other }}"
    assert render("{{ run.pipeline }}{{ run.version }}{{ run.logicalDate }}", run) == "sales42024-05-06T01:00:00.000Z"


@pytest.mark.parametrize("fmt", ["csv", "json", "ndjson"])
def test_objects(spark, folder, fmt):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "id BIGINT, name STRING").repartition(3)
    path = write_object(df, f"{folder}/{{{{ run.id }}}}/out", RunInfo("r1"), fmt)
    assert path.endswith("/r1/out")
    assert rows_of(read_object(spark, path, fmt), "id", "name") == [(i, f"n{i}") for i in range(20)]
    assert read_object(spark, path, fmt, limit=5).count() == 5


# ---- generator


@pytest.mark.parametrize("preset", ["sales", "customers", "events"])
def test_generator(spark, preset):
    a, b = generate(spark, preset, 300, 7, 0.2), generate(spark, preset, 300, 7, 0.2).repartition(5)
    assert rows_of(a) == rows_of(b) and rows_of(a) != rows_of(generate(spark, preset, 300, 8, 0.2))
    nullable = {"sales": "customer_id", "customers": "email", "events": "value"}[preset]
    assert 20 < a.where(F.col(nullable).isNull()).count() < 110
    assert generate(spark, preset, 50).where(F.col(nullable).isNull()).count() == 0
    with pytest.raises(ConfigError):
        generate(spark, "weather")


# ---- JDBC, against the embedded Derby that Spark ships


@pytest.fixture
def url(folder):
    return f"jdbc:derby:{folder}/db;create=true"


def test_jdbc_write_modes(spark, url):
    first = spark.createDataFrame([(1, "a"), (2, "b")], "id BIGINT, name STRING")
    assert write_jdbc(first, url, "T", create_table=True, keys=["id"]) == 2
    assert write_jdbc(spark.createDataFrame([(3, "c")], first.schema), url, "T") == 1
    changed = spark.createDataFrame([(3, "C"), (4, "d"), (4, "dd")], first.schema)
    assert write_jdbc(changed, url, "T", "upsert", ["id"], order_by=[("name", "desc")]) == 2
    assert rows_of(read_jdbc(spark, url, "T")) == [(1, "a"), (2, "b"), (3, "C"), (4, "dd")]
    write_jdbc(first.where("id = 1"), url, "T", "replace")
    assert rows_of(read_jdbc(spark, url, "T")) == [(1, "a")]
    with pytest.raises(ConfigError):
        write_jdbc(first, url, "T", "upsert")
    # A load that fails leaves the target alone.
    with pytest.raises(Exception):
        write_jdbc(spark.createDataFrame([(None, "x")], first.schema), url, "T", "replace")
    assert rows_of(read_jdbc(spark, url, "T")) == [(1, "a")]


def test_jdbc_reads(spark, url):
    rows = spark.range(100).select("id", (F.col("id") * 2).alias("v"))
    write_jdbc(rows, url, "N", create_table=True)
    parts = read_jdbc(spark, url, "N", partition={"column": "id", "lower": 0, "upper": 100, "parts": 4})
    assert parts.rdd.getNumPartitions() == 4 and parts.count() == 100
    assert read_jdbc(spark, url, query='SELECT "v" FROM "N" WHERE "id" > 90 -- comment').count() == 9
    assert read_jdbc(spark, url, "N", limit=7).count() == 7
    fresh = incremental(read_jdbc(spark, url, "N"), "id", 95)
    assert rows_of(fresh, "id") == [(96,), (97,), (98,), (99,)] and next_watermark(fresh, "id", 95) == 99
    assert next_watermark(fresh.where("false"), "id", 95) == 95
    assert incremental(rows, "id").count() == 100


def test_jdbc_guards():
    assert check_table("public.orders") == "public.orders"
    for name in ('users"; DROP TABLE x', "a.b.c", "1a", ""):
        with pytest.raises(ConfigError):
            check_table(name)
    assert check_read_only("SELECT 1 /* drop */ ;") .startswith("SELECT 1")
    for sql in ("DELETE FROM t", "SELECT 1; SELECT 2", "WITH x AS (DELETE FROM t RETURNING *) SELECT * FROM x", "-- select\nDROP TABLE t"):
        with pytest.raises(ConfigError):
            check_read_only(sql)


def test_jdbc_statements(spark):
    pg, my = "jdbc:postgresql://h/db", "jdbc:mysql://h/db"
    assert upsert_sql(pg, "t", "s", ["a", "b"], ["a"]) == [
        'INSERT INTO "t" ("a", "b") SELECT "a", "b" FROM "s" ON CONFLICT ("a") DO UPDATE SET "b" = EXCLUDED."b"'
    ]
    assert upsert_sql(pg, "t", "s", ["a"], ["a"])[0].endswith("DO NOTHING")
    assert upsert_sql(my, "t", "s", ["a", "b"], ["a"])[0].endswith("ON DUPLICATE KEY UPDATE `b` = VALUES(`b`)")
    df = spark.sql("SELECT 1L AS a, 'x' AS b, true AS c, current_timestamp() AS d")
    assert create_table_sql(df, my, "t", ["a"]) == "CREATE TABLE `t` (`a` bigint NOT NULL, `b` text NOT NULL, `c` tinyint(1) NOT NULL, `d` datetime NOT NULL)"


# ---- datasets


def test_datasets(spark, folder):
    datasets = Datasets(spark, folder)
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id BIGINT, v STRING")
    with pytest.raises(ConfigError, match="does not exist"):
        datasets.read("d")
    at = lambda day: datetime(2024, 1, day, tzinfo=timezone.utc)
    assert datasets.write("d", rows, "append", now=at(1)) == 2
    assert datasets.write("d", rows, "append", now=at(2)) == 2 and datasets.read("d").count() == 4
    assert datasets.write("d", rows.where("id = 1"), run_id="r", now=at(3)) == 1 and datasets.read("d").count() == 1
    datasets.write("d", spark.createDataFrame([(1, "A"), (3, "c")], rows.schema), "upsert", ["id"], now=at(4))
    assert rows_of(datasets.read("d")) == [(1, "A"), (3, "c")]
    assert rows_of(datasets.catalog(), "name", "write_mode", "row_count") == [("d", "upsert", 2)]
    # Reading and replacing the same dataset in one step is safe.
    datasets.write("d", datasets.read("d").withColumn("v", F.lower("v")), now=at(5))
    assert rows_of(datasets.read("d")) == [(1, "a"), (3, "c")]
    assert datasets.preview("d", 1).count() == 1
    with pytest.raises(ConfigError):
        datasets.write("Bad Name", rows)


def test_partitioned_datasets(spark, folder):
    datasets = Datasets(spark, folder)
    rows = spark.createDataFrame([(1, "01", "a"), (2, "01", "b"), (3, "02", "c"), (4, None, "n")], "id BIGINT, p STRING, v STRING")
    datasets.write("d", rows, partition_by=["p"])
    assert dict(datasets.read("d").dtypes) == {"id": "bigint", "p": "string", "v": "string"}
    untouched = {str(f): f.stat().st_mtime_ns for f in Path(folder).glob("_parts/*/side=rows/p=*/part-*")}
    incoming = spark.createDataFrame([(2, "01", "B"), (9, "03", "new"), (5, None, "m")], rows.schema)
    datasets.write("d", incoming, "upsert", ["id", "p"])
    assert rows_of(datasets.read("d")) == [(1, "01", "a"), (2, "01", "B"), (3, "02", "c"), (4, None, "n"), (5, None, "m"), (9, "03", "new")]
    assert untouched.items() <= {str(f): f.stat().st_mtime_ns for f in Path(folder).glob("_parts/*/side=rows/p=*/part-*")}.items()
    datasets.write("d", incoming.where("id = 9"), "append")
    assert datasets.read("d").count() == 7 and datasets.catalog().head().row_count == 7
    with pytest.raises(ConfigError):
        datasets.write("d", incoming, "upsert", ["id"])


def test_publish_checked(spark, folder):
    datasets = Datasets(spark, folder)
    rows = spark.createDataFrame([(1, 5), (2, -5), (3, 7)], "id BIGINT, v BIGINT")
    checks = [{"id": "pos", "type": "range", "column": "v", "min": 0}, {"id": "n", "type": "row_count", "min": 1}]
    with pytest.raises(GateBlocked) as blocked:
        publish_checked(datasets, "d", rows, checks)
    assert blocked.value.failed_checks == ["pos"] and not Path(f"{folder}/d").exists() and not list(Path(folder).glob("_parts/*"))
    done = publish_checked(datasets, "d", rows, checks, quarantine_name="d_bad")
    assert done.rows_written == 2 and done.quarantined == 1 and not done.decision.blocked
    assert rows_of(datasets.read("d")) == [(1, 5), (3, 7)] and rows_of(datasets.read("d_bad"), "id") == [(2,)]
    warned = publish_checked(datasets, "d", rows, [checks[0] | {"severity": "warn"}], rule="error_only")
    assert warned.rows_written == 3 and rows_of(datasets.catalog(), "name", "quality_status")[0] == ("d", "FAILED")


def test_merged_distinct_counts_are_close(spark):
    """Two parts of 900,000 keys; a sketch of the size kept before merges with a new one."""
    from weir.contracts import sketches

    keys = spark.range(900_000).select("id")
    parts = [sketches.sketch_profile(keys.where(f"id % 2 = {k}")).withColumn("part", F.lit(str(k))) for k in (0, 1)]
    found = sketches.merged_profile(parts[0].unionByName(parts[1])).head().unique_count
    assert abs(found - 900_000) <= 0.01 * 900_000
    small = parts[0].withColumn("distinct", F.lit(keys.where("id % 2 = 0").agg(F.hll_sketch_agg(F.xxhash64("id"), 14)).head()[0]))
    assert abs(sketches.merged_profile(small.unionByName(parts[1])).head().unique_count - 900_000) <= 0.04 * 900_000


def test_profiles_of_appended_data_merge(spark, folder):
    """A second profile reads only what was appended: the first files are gone by then."""
    datasets = Datasets(spark, folder)
    rows = lambda a, b: spark.range(a, b).select(F.col("id"), (F.col("id") % 700).cast("string").alias("t"), F.when(F.col("id") % 10 > 0, F.col("id") / 2).alias("x"))
    datasets.write("d", rows(0, 20_000))
    first = {r.name: r for r in datasets.profile("d").collect()}
    assert first["id"].row_count == 20_000 and abs(first["id"].unique_count - 20_000) < 400 and first["x"].null_count == 2_000
    for file in Path(folder).glob("_parts/*/side=rows/part-*"):
        file.unlink()
    datasets.write("d", rows(10_000, 50_000).withColumn("more", F.lit("2024-01-05").cast("date")), "append")
    both = {r.name: r for r in datasets.profile("d", (0.25, 0.5)).collect()}
    assert both["id"].row_count == 60_000 and abs(both["id"].unique_count - 50_000) < 1_000 and (both["id"].min, both["id"].max) == ("0", "49999")
    assert both["t"].type == "integer" and abs(both["t"].unique_count - 700) < 15 and both["x"].null_count == 6_000
    assert (both["more"].type, both["more"].null_count, both["more"].min) == ("date", 20_000, "2024-01-05") and both["more"].quantiles is None
    assert abs(both["id"].quantiles[1] - 20_000) < 1_500


def test_jdbc_shares_are_even(spark, url):
    """A key of which most rows lie in a narrow range, with one far off, repeated values and NULLs."""
    keys = [*range(1000, 1400), *[7] * 60, 10**9, -(10**6), None, None]
    rows = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "k BIGINT, n BIGINT")
    write_jdbc(rows, url, "skewed", create_table=True)
    df = read_jdbc(spark, url, "skewed", partition={"column": "k", "parts": 5})
    sizes = [len(part) for part in df.rdd.glom().collect()]
    assert rows_of(df, "n") == [(n,) for n in range(len(keys))] and len(sizes) >= 4 and max(sizes) < 2 * len(keys) / 5
    some = read_jdbc(spark, url, query='SELECT "k", "n" FROM "skewed" WHERE "k" > 5', partition={"column": "k", "parts": 3})
    assert some.count() == 461 and some.rdd.getNumPartitions() == 3
    write_jdbc(rows.limit(0), url, "empty_one", create_table=True)
    assert read_jdbc(spark, url, "empty_one", partition={"column": "k", "parts": 3}).count() == 0


def _upserts(spark, datasets, rows, **more):
    datasets.write("d", spark.createDataFrame(rows, "k BIGINT, at BIGINT, v STRING"), "upsert", ["k"], order_by=[("at", "desc")], **more)


def test_late_rows_lose(spark, folder):
    datasets = Datasets(spark, folder)
    _upserts(spark, datasets, [(1, 9, "new"), (2, 1, "a"), (None, 1, "x")])
    _upserts(spark, datasets, [(1, 3, "late"), (2, 2, "b"), (3, 5, "c"), (3, 4, "older"), (None, 1, "x")])
    want = [(1, 9, "new"), (2, 2, "b"), (3, 5, "c"), (None, 1, "x"), (None, 1, "x")]
    assert rows_of(datasets.read("d")) == want and datasets.catalog().head().row_count == 5
    _upserts(spark, datasets, [(3, 5, "same time, later write")])
    assert rows_of(datasets.read("d").where("k = 3"), "v") == [("same time, later write",)]
    assert rows_of(datasets.read("d", version=2)) == want  # an older version stays readable


def test_repeated_batches_change_nothing(spark, folder):
    datasets = Datasets(spark, folder)
    for _ in range(2):
        _upserts(spark, datasets, [(1, 1, "a"), (None, 1, "loose")], transaction=("feed", 0))
    _upserts(spark, datasets, [(1, 2, "b")], transaction=("feed", 1))
    _upserts(spark, datasets, [(1, 3, "replayed")], transaction=("feed", 0))
    _upserts(spark, datasets, [(2, 1, "other feed")], transaction=("other", 0))
    assert rows_of(datasets.read("d")) == [(1, 2, "b"), (2, 1, "other feed"), (None, 1, "loose")]
    assert datasets.snapshot("d").version == 3


def test_changes_are_merged_and_compacted(spark, folder):
    """Many upserts with an append between them: the same rows before and after their parts are brought together."""
    datasets, state, loose = Datasets(spark, folder), {}, 0
    rng = random.Random(7)
    for turn in range(12):
        batch = {rng.randint(0, 30): rng.randint(0, 50) for _ in range(6)}
        _upserts(spark, datasets, [(k, at, f"{turn}") for k, at in batch.items()])
        for k, at in batch.items():
            if k not in state or at >= state[k][0]:
                state[k] = (at, f"{turn}")
    want = sorted((k, at, v) for k, (at, v) in state.items())
    assert rows_of(datasets.read("d")) == want and len(datasets.snapshot("d").parts) < 12
    before = datasets.snapshot("d").version
    assert len(datasets.compact("d").parts) == 1 and rows_of(datasets.read("d")) == want
    assert rows_of(datasets.read("d", version=before)) == want
    assert datasets.history("d").where("change_rows > 0").count() > 5
    assert datasets.vacuum("d", 1) > 5 and rows_of(datasets.read("d")) == want
    assert len(list(Path(folder).glob("_parts/stage=*"))) == 1


def test_writers_do_not_lose_each_other(spark, folder):
    """A writer that commits between another one's look and its commit, and one that fails half way."""
    datasets = Datasets(spark, folder)
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id BIGINT")
    datasets.write("d", rows(1))
    staged = datasets.stage(rows(2))
    slow = Datasets(spark, folder)
    seen = []

    import weir.sources.snapshots as snapshots

    claim = snapshots._claim

    def claim_after_another(*args):
        if not seen:
            seen.append(1)
            datasets.write("d", rows(3), "append")
        return claim(*args)

    snapshots._claim = claim_after_another
    try:
        slow.commit("d", staged, "append")
    finally:
        snapshots._claim = claim
    assert rows_of(datasets.read("d")) == [(1,), (2,), (3,)] and datasets.catalog().head().row_count == 3
    with pytest.raises(PySparkException):
        datasets.write("d", rows(4).withColumn("id", F.raise_error(F.lit("lost")).cast("bigint")))
    assert rows_of(datasets.read("d")) == [(1,), (2,), (3,)]
    assert not list(Path(folder).glob("d/_commits/_draft*"))


def test_columns_and_empty_writes(spark, folder):
    datasets = Datasets(spark, folder)
    datasets.write("d", spark.createDataFrame([(1, "a")], "id BIGINT, v STRING"))
    datasets.write("d", spark.createDataFrame([(2, 5.0)], "id BIGINT, w DOUBLE"), "append")
    assert rows_of(datasets.read("d")) == [(1, "a", None), (2, None, 5.0)]
    datasets.write("d", spark.createDataFrame([(1, 9.0), (3, 1.0)], "id BIGINT, w DOUBLE"), "upsert", ["id"])
    assert rows_of(datasets.read("d")) == [(1, "a", 9.0), (2, None, 5.0), (3, None, 1.0)]
    with pytest.raises(ConfigError, match="another type"):
        datasets.write("d", spark.createDataFrame([("x",)], "id STRING"), "append")
    datasets.write("d", datasets.read("d").limit(0), "replace")
    assert datasets.read("d").count() == 0 and datasets.read("d").columns == ["id", "v", "w"]
    with pytest.raises(ConfigError, match="no version 99"):
        datasets.read("d", version=99)


def test_publishing_again_changes_nothing(spark, folder):
    datasets = Datasets(spark, folder)
    rows = spark.createDataFrame([(1, 5), (2, -5), (3, 7)], "id BIGINT, v BIGINT")
    checks = [{"id": "pos", "type": "range", "column": "v", "min": 0}, {"id": "many", "type": "row_count", "min": 3}]
    for _ in range(2):
        with pytest.raises(GateBlocked):
            publish_checked(datasets, "d", rows, checks, quarantine_name="bad", run_id="r1")
    assert datasets.names() == [] and not list(Path(folder).glob("_parts/*"))
    more = rows.unionAll(spark.createDataFrame([(4, 4)], rows.schema))
    first, again = (publish_checked(datasets, "d", more, checks, mode="append", quarantine_name="bad", run_id="r2") for _ in range(2))
    assert (first.rows_written, first.quarantined, again.rows_written, again.quarantined) == (3, 1, 0, 0)
    assert rows_of(datasets.read("d")) == [(1, 5), (3, 7), (4, 4)] and datasets.read("bad").count() == 1


def test_partitioned_csv_keeps_blanks_times_and_nested_values(spark, folder):
    rows = [("x", "  a ", datetime(2024, 1, 2, 3, 4, 5), [1, 2]), ("y", "b", None, None)]
    df = spark.createDataFrame(rows, "k STRING, t STRING, at TIMESTAMP_NTZ, list ARRAY<INT>")
    write_object(df, f"{folder}/out", RunInfo(), "csv", ["k"])
    back = read_csv(spark, f"{folder}/out/k=x", infer_types=False)
    assert [tuple(r) for r in back.collect()] == [("  a ", "2024-01-02T03:04:05.000", "[1,2]")]


def test_few_lines_of_a_batch_are_python_objects_at_once():
    import pyarrow as pa
    from weir.sources import splits

    taken = []

    class Batch:
        def __init__(self, batch):
            self.batch, self.num_rows = batch, batch.num_rows

        def slice(self, at, length):
            return Batch(self.batch.slice(at, length))

        @property
        def columns(self):
            taken.append(self.num_rows)
            return self.batch.columns

    batch = Batch(pa.RecordBatch.from_pydict({"value": [str(n) for n in range(5000)], "file": ["f"] * 5000, "split": [n // 3000 for n in range(5000)]}))
    assert [(key, list(lines)) for key, lines in splits.by_split([batch])] == [(("f", 0), [str(n) for n in range(3000)]), (("f", 1), [str(n) for n in range(3000, 5000)])]
    assert max(taken) <= 256


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_records_when_executors_come_between_passes(spark, folder, monkeypatch, fmt):
    """Spark cuts files by the cores it has; a file is read twice, and each time there are others."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "17")
    module = importlib.import_module(f"weir.sources.{fmt}")

    def later(df, label="step", plain=module.cut_lineage):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "5")
        return plain(df, label)

    monkeypatch.setattr(module, "cut_lineage", later)
    try:
        if fmt == "csv":
            path = put(folder, "a.csv", "a,b\n" + "".join(f'{i},"x\n{i},\n,"\n' for i in range(9000)))
            assert rows_of(read_csv(spark, path, infer_types=False)) == sorted((str(i), f"x\n{i},\n,") for i in range(9000))
        else:
            path = put(folder, "a.json", json.dumps([{"t": f"}}{i}{{"} for i in range(9000)]))
            assert sorted(json.loads(r["text"])["t"] for r in array_elements(spark, [path]).collect()) == sorted(f"}}{i}{{" for i in range(9000))
        assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None
    finally:
        for key in ("files.maxPartitionBytes", "files.openCostInBytes", "leafNodeDefaultParallelism"):
            spark.conf.unset(f"spark.sql.{key}")


ODD_TEXTS = [
    "plain", None, "", "NULL", "null", "\\N", "a\rb", "a\r\nb", "end\r", " lead", '"start', 'say "x" y', "a;b", "a,b", "﻿mark", "nul\0", '""', "x\n\ny", "\n", "\r", "\n\"", " ", "q\"\nq",
]


@pytest.mark.parametrize("files", [1, len(ODD_TEXTS)])
def test_csv_queries_give_odd_texts_back(spark, folder, files):
    """Empty text is not NULL, words for NULL are text, and a carriage return in quotes ends no record, whatever else is in its file."""
    rows = [(n, t, ("en", "de", "7")[n % 3], "s" if n % 2 else None) for n, t in enumerate(ODD_TEXTS)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING")
    df.repartitionByRange(files, "doc_id").write.parquet(f"{folder}/documents.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")  # about a file of documents
    spark.conf.set("spark.sql.files.openCostInBytes", "1500")
    try:
        multi = [(r["doc_id"], r["text"], r["lang"]) for r in QUERIES["csv_multi_line"](spark, folder).collect()]
        names = ("doc_id", "text", "source", "lang", "header")
        twice = [tuple(r[n] for n in names) for r in QUERIES["csv_partitioned_round_trip"](spark, folder).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(multi) == [r[:3] for r in rows]
    assert sorted(twice, key=lambda r: (r[0], r[4])) == [x for n, t, lang, s in rows for x in ((n, t, s, lang, "with source"), (n, t, None, lang, "without"))]
