"""Sources and sinks (S, K): tables go out to files and come back, or are read incrementally and merged."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from weir.catalog.registry import query
from weir.contracts.infer import ColumnSpec, columns_table, probe
from weir.errors import GateBlocked
from weir.operators import flatten_once, latest_per_key, merge_rows, record_path
from weir.session import scratch_path
from weir.sources import Datasets, generate_for, incremental, landed_records, next_watermark, publish_checked, read_csv, read_json, read_ndjson, read_object, render, write_csv, write_ndjson, write_object
from weir.sources.objects import RunInfo


@query(
    """
    SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS status, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS day,
           o_orderpriority || ', "quoted" ' || o_orderstatus AS note
    FROM orders
    """
)
def csv_round_trip(t):
    path = scratch_path(t.spark, "csv")
    note = F.concat("o_orderpriority", F.lit(', "quoted" '), "o_orderstatus")
    orders = t.orders.select(
        "o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), "o_totalprice", F.col("o_orderdate").cast("date").alias("day"), note.alias("note")
    )
    write_csv(orders, path)
    return read_csv(t.spark, path).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("SELECT doc_id, text, lang FROM documents")
def csv_multi_line(t):
    path = scratch_path(t.spark, "csv")
    documents = t.documents.select("doc_id", "text", "lang")
    write_csv(documents, path, delimiter=";", quote_empty=True)
    columns = [ColumnSpec("doc_id", "integer", False), ColumnSpec("text", "string", False), ColumnSpec("lang", "string", False)]
    return read_csv(t.spark, path, delimiter=";", columns=columns, null_values=None)


@query(
    """
    SELECT doc_id, text, source, lang, 'with source' AS header FROM documents UNION ALL SELECT doc_id, text, NULL, lang, 'without' FROM documents
    """
)
def csv_partitioned_round_trip(t):
    """Whole documents in folders by language, twice: files with the columns in one order, and files with fewer in another."""
    path = scratch_path(t.spark, "csv")
    write_csv(t.documents.select("doc_id", "text", "source", F.lit("with source").alias("header"), "lang"), path, partition_by=["lang"], quote_empty=True)
    write_csv(t.documents.select("text", "doc_id", "lang"), path, mode="append", partition_by=["lang"], quote_empty=True)
    names = {"doc_id": "integer", "text": "string", "source": "string", "header": "string", "lang": "string"}
    rows = read_csv(t.spark, path, columns=[ColumnSpec(name, kind, name in ("source", "header")) for name, kind in names.items()], null_values=None)
    return rows.withColumns({"header": F.coalesce("header", F.lit("without")), "lang": F.col("lang").cast("string")})


@query("SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS props_k, event_type, CASE WHEN event_type <> 'view' THEN value END AS value FROM events")
def ndjson_flatten(t):
    path = scratch_path(t.spark, "ndjson")
    nested = t.events.select(
        "event_id", F.from_json("props", "k BIGINT").alias("props"), "event_type", F.when(F.col("event_type") != "view", F.col("value")).alias("value")
    )
    write_ndjson(nested, path)
    return read_ndjson(t.spark, path).select("event_id", "props_k", "event_type", "value")


@query("SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS props_k, ['a', event_type][2] AS second_tag FROM events")
def json_flatten_props(t):
    nested = t.events.select("event_id", F.from_json("props", "k BIGINT").alias("props"), F.array(F.lit("a"), "event_type").alias("tags"))
    return flatten_once(nested).select("event_id", "props_k", F.col("tags")[1].alias("second_tag"))


@query("SELECT o_orderkey AS id, o_custkey AS customer_key, o_orderstatus AS customer_status FROM orders")
def record_path_explode(t):
    item = F.struct(F.col("o_orderkey").alias("id"), F.struct(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status")).alias("customer"))
    documents = t.orders.select(F.struct(F.array(item).alias("items")).alias("data"))
    return flatten_once(record_path(documents, "data.items"))


@query("SELECT o_orderkey AS id, o_totalprice AS amount, o_orderpriority AS info_priority FROM orders")
def json_documents(t):
    """A JSON array document per part file, read back from its record path."""
    path = scratch_path(t.spark, "json")
    orders = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.struct(F.col("o_orderpriority").alias("priority")).alias("info"))
    write_object(orders, path, RunInfo(), "json")
    typed = read_json(t.spark, path)
    return typed.select("id", F.col("amount").cast("double").alias("amount"), "info_priority")


def _responses(t):
    """A landed page per event; an error page has no records, a signup page no cursor."""
    record = F.struct(F.col("event_id").alias("id"), F.struct(F.col("event_type").alias("kind")).alias("meta"))
    items = F.when(F.col("event_type") == "error", F.array().cast("array<struct<id:bigint,meta:struct<kind:string>>>")).otherwise(F.array(record))
    cursor = F.when(F.col("event_type") != "signup", F.col("event_id").cast("string"))
    body = F.to_json(F.struct(F.struct(items.alias("items")).alias("data"), cursor.alias("next_cursor")))
    return t.events.select(F.col("user_id").alias("source"), F.col("event_id").alias("page"), body.alias("body"))


@query(
    """
    WITH e AS (SELECT *, min(event_id) FILTER (event_type = 'error') OVER (PARTITION BY user_id) AS stop FROM events)
    SELECT user_id AS source, event_id AS id, event_type AS meta_kind FROM e WHERE stop IS NULL OR event_id < stop
    """
)
def landed_pages(t):
    schema = "STRUCT<id: BIGINT, meta: STRUCT<kind: STRING>>"
    return landed_records(_responses(t), "data.items", schema=schema).select("source", "id", "meta_kind")


@query(
    """
    WITH e AS (SELECT *, min(event_id) FILTER (event_type = 'error') OVER (PARTITION BY user_id) AS stop, min(event_id) FILTER (event_type = 'signup') OVER (PARTITION BY user_id) AS last FROM events)
    SELECT user_id AS source, event_id AS id FROM e WHERE (stop IS NULL OR event_id < stop) AND (last IS NULL OR event_id <= last)
    """
)
def landed_cursor_pages(t):
    schema = "STRUCT<id: BIGINT, meta: STRUCT<kind: STRING>>"
    return landed_records(_responses(t), "data.items", "cursor", schema=schema).select("source", "id")


def _fraction(preset: str, field: int) -> str:
    return f"(('0x' || substr(md5('{preset}:7:' || i), {1 + field * 6}, 6))::BIGINT / 16777216.0::DOUBLE)"


def _pick(preset: str, field: int, words) -> str:
    return f"({list(words)})[CAST(floor({_fraction(preset, field)} * {len(words)}) AS BIGINT) + 1]"


@query(
    f"""
    WITH n AS (SELECT o_orderkey AS i, (SELECT count(*) FROM orders) AS total FROM orders)
    SELECT i + 1 AS order_id,
           CASE WHEN {_fraction('sales', 1)} >= 0.01 THEN 'c' || (CAST(floor({_fraction('sales', 0)} * greatest(1.0, total / 5)) AS BIGINT) + 1) END AS customer_id,
           {_pick('sales', 2, ('harbour', 'hills', 'plains', 'islands'))} AS region, {_pick('sales', 3, ('drafted', 'confirmed', 'fulfilled', 'returned'))} AS status,
           round({_fraction('sales', 4)} * 500, 2) AS amount, strftime(TIMESTAMP '2026-01-01' + to_hours(CAST(i AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS created_at
    FROM n
    """
)
def generator_sales(t):
    """As many sales as there are orders, one for each order number."""
    rows = generate_for(t.orders.select("o_orderkey"), "o_orderkey", t.orders.count(), "sales", 7, 0.01)
    return rows.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query(
    """
    WITH w AS (SELECT TIMESTAMP '1999-06-30 00:00:00' AS since)
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, (SELECT strftime(max(o_orderdate), '%Y-%m-%d') FROM orders) AS next_since FROM orders, w WHERE o_orderdate > since
    """
)
def incremental_orders(t):
    since = datetime(1999, 6, 30)
    fresh = incremental(t.orders, "o_orderdate", since)
    mark = next_watermark(fresh, "o_orderdate", since)
    return fresh.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.lit(mark.strftime("%Y-%m-%d")).alias("next_since"))


@query(
    """
    WITH incoming AS (SELECT CASE WHEN event_id % 2 = 0 THEN user_id ELSE user_id + 100000 END AS k, value, ts, event_id FROM events),
         last AS (SELECT k, value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) AS r FROM incoming) WHERE r = 1),
         target AS (SELECT c_custkey AS k, c_acctbal AS value, c_name AS name FROM customer)
    SELECT t.k, t.value, t.name FROM target t WHERE t.k NOT IN (SELECT k FROM last)
    UNION ALL SELECT l.k, l.value, t.name FROM last l LEFT JOIN target t ON l.k = t.k
    """
)
def upsert_merge(t):
    target = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("value"), F.col("c_name").alias("name"))
    key = F.when(F.col("event_id") % 2 == 0, F.col("user_id")).otherwise(F.col("user_id") + 100000)
    incoming = latest_per_key(t.events.select(key.alias("k"), "value", "ts", "event_id"), ["k"], [("ts", "desc"), ("event_id", "desc")])
    return merge_rows(target, incoming.select("k", "value"), ["k"])


@query(
    """
    WITH f AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'O'), o AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O')
    SELECT *, 'after_append' AS step FROM f UNION ALL SELECT *, 'after_append' FROM o UNION ALL SELECT *, 'after_replace' FROM o
    """
)
def dataset_append_replace(t):
    datasets = Datasets(t.spark, scratch_path(t.spark, "datasets"))
    finished = t.orders.where("o_orderstatus <> 'O'").select("o_orderkey", "o_totalprice")
    opened = t.orders.where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice")
    for name in ("grown", "replaced"):
        datasets.write(name, finished, "replace")
    datasets.write("grown", opened, "append")
    datasets.write("replaced", opened, "replace")
    return datasets.read("grown").withColumn("step", F.lit("after_append")).unionByName(datasets.read("replaced").withColumn("step", F.lit("after_replace")))


@query(
    """
    SELECT 'orders_copy' AS name, 'replace' AS write_mode, count(*) AS rows_written, count(*) AS row_count, 'run-2' AS run_id FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT 'customers_copy', 'append', count(*), count(*) * 2, 'run-4' FROM customer
    """
)
def dataset_catalog(t):
    datasets = Datasets(t.spark, scratch_path(t.spark, "datasets"))
    datasets.write("orders_copy", t.orders, run_id="run-1", now=datetime(2024, 1, 1, tzinfo=timezone.utc))
    datasets.write("orders_copy", t.orders.where("o_orderstatus = 'O'"), run_id="run-2", now=datetime(2024, 1, 2, tzinfo=timezone.utc))
    datasets.write("customers_copy", t.customer, run_id="run-3", now=datetime(2024, 1, 1, tzinfo=timezone.utc))
    datasets.write("customers_copy", t.customer, "append", run_id="run-4", now=datetime(2024, 1, 3, tzinfo=timezone.utc))
    return datasets.catalog().select("name", "write_mode", "rows_written", "row_count", "run_id")


@query(
    """
    SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1
    """
)
def upsert_late_rows(t):
    """Events arrive by type, so most batches bring rows that are older than what is there; one batch comes twice."""
    datasets = Datasets(t.spark, scratch_path(t.spark, "datasets"))
    order = [("ts", "desc"), ("event_id", "desc")]
    batches = [t.events.where("event_type = 'click'"), t.events.where("event_type = 'view'"), t.events.where("event_type NOT IN ('click', 'view')")]
    for number, batch in enumerate([*batches, batches[0]]):
        rows = batch.select("user_id", "event_id", "event_type", "value", "ts")
        datasets.write("last_seen", rows, "upsert", ["user_id"], order_by=order, transaction=("events", number % 3))
    return datasets.read("last_seen").drop("ts")


@query(
    """
    WITH n AS (SELECT count(*) AS o, count(DISTINCT o_custkey) AS k FROM orders), c AS (SELECT count(*) AS c FROM customer),
         b AS (SELECT count(*) AS b FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders))
    SELECT 1::BIGINT AS version, 'replace' AS write_mode, c AS rows_written, c AS row_count, 0::BIGINT AS change_rows, c AS rows_read FROM c
    UNION ALL SELECT 2, 'upsert', k, b, k, b FROM n, b UNION ALL SELECT 3, 'upsert', k, b, 0, b FROM n, b
    UNION ALL SELECT 4, 'append', c, b + c, 0, b + c FROM b, c
    """
)
def dataset_snapshots(t):
    """Customers, the last order of each, the same brought together, and customers once more: every version stays readable."""
    datasets = Datasets(t.spark, scratch_path(t.spark, "datasets"))
    customers = t.customer.select(F.col("c_custkey").alias("k"), F.lit(None).cast("timestamp_ntz").alias("at"), F.col("c_acctbal").alias("v"))
    datasets.write("accounts", customers)
    orders = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"), F.col("o_totalprice").alias("v"))
    datasets.write("accounts", orders, "upsert", ["k"], order_by=[("at", "desc", "last"), ("v", "desc")])
    datasets.compact("accounts")
    datasets.write("accounts", customers, "append")
    counts = [datasets.read("accounts", version=v).agg(F.lit(v).cast("bigint").alias("version"), F.count(F.lit(1)).alias("rows_read")) for v in (1, 2, 3, 4)]
    read = counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])
    return datasets.history("accounts").drop("run_id", "parts").join(read, "version")


@query(
    """
    SELECT o_orderkey, o_totalprice, 'published' AS side FROM orders WHERE o_totalprice >= 5000
    UNION ALL SELECT o_orderkey, o_totalprice, 'quarantined' FROM orders WHERE o_totalprice < 5000
    """
)
def publish_retry(t):
    """A load that a gate blocks leaves nothing behind, and one that is published twice under one run id counts once."""
    datasets = Datasets(t.spark, scratch_path(t.spark, "datasets"))
    rows = t.orders.select("o_orderkey", "o_totalprice")
    price, impossible = {"id": "price", "type": "range", "column": "o_totalprice", "min": 5000}, {"id": "none", "type": "row_count", "max": 0}
    try:
        publish_checked(datasets, "orders", rows, [price, impossible], mode="append", quarantine_name="orders_bad", run_id="run-1")
    except GateBlocked:
        pass
    for _ in range(2):
        publish_checked(datasets, "orders", rows, [price], mode="append", quarantine_name="orders_bad", run_id="run-2")
    good = datasets.read("orders").withColumn("side", F.lit("published"))
    return good.unionByName(datasets.read("orders_bad").drop("failed_checks").withColumn("side", F.lit("quarantined")))


@query(
    """
    SELECT l_returnflag, l_orderkey, l_quantity FROM lineitem WHERE l_returnflag <> 'R' UNION ALL
    SELECT l_returnflag, l_orderkey, -l_quantity FROM lineitem WHERE l_returnflag = 'R'
    """
)
def object_partitioned_overwrite(t):
    """A templated target whose partitions are replaced one day's run at a time."""
    run = RunInfo("r1", "lines", 3, logical_date="2024-01-05T00:00:00.000Z")
    key = scratch_path(t.spark, "objects") + "/{{ run.pipeline }}/v{{ run.version }}/{{ run.date }}"
    lines = t.lineitem.select("l_orderkey", "l_quantity", "l_returnflag")
    write_object(lines, key, run, "ndjson", ["l_returnflag"])
    again = lines.where("l_returnflag = 'R'").withColumn("l_quantity", -F.col("l_quantity"))
    write_object(again, key, run, "ndjson", ["l_returnflag"])
    return t.spark.read.schema("l_orderkey BIGINT, l_quantity DOUBLE, l_returnflag STRING").json(render(key, run)).select("l_returnflag", "l_orderkey", "l_quantity")


@query(
    """
    SELECT o_orderkey, o_totalprice, o_orderstatus, 'published' AS side FROM orders WHERE o_totalprice >= 5000 AND o_orderstatus IN ('F', 'O')
    UNION ALL SELECT o_orderkey, o_totalprice, o_orderstatus, 'quarantined' FROM orders WHERE NOT (o_totalprice >= 5000 AND o_orderstatus IN ('F', 'O'))
    """
)
def publish_with_quarantine(t):
    datasets = Datasets(t.spark, scratch_path(t.spark, "datasets"))
    checks = [
        {"id": "price", "type": "range", "column": "o_totalprice", "min": 5000}, {"id": "status", "type": "accepted_values", "column": "o_orderstatus", "values": ["F", "O"]},
        {"id": "keys", "type": "unique", "column": "o_orderkey"}, {"id": "some", "type": "row_count", "min": 1},
    ]
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    publish_checked(datasets, "orders", rows, checks, quarantine_name="orders_bad")
    good = datasets.read("orders").withColumn("side", F.lit("published"))
    bad = datasets.read("orders_bad").drop("failed_checks").withColumn("side", F.lit("quarantined"))
    return good.unionByName(bad)


@query(
    """
    SELECT 'csv' AS kind, c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT 'json', c_custkey, c_name, c_acctbal FROM customer
    UNION ALL SELECT 'ndjson', c_custkey, c_name, c_acctbal FROM customer
    """
)
def object_reads(t):
    """The same table under templated keys in each format, read back by key."""
    run = RunInfo("r1", "customers", 1)
    root = scratch_path(t.spark, "objects")
    parts = []
    for kind in ("csv", "json", "ndjson"):
        key = write_object(t.customer.select("c_custkey", "c_name", "c_acctbal"), root + "/{{ run.pipeline }}/" + kind, run, kind)
        parts.append(read_object(t.spark, key, kind).select(F.lit(kind).alias("kind"), F.col("c_custkey").cast("bigint"), "c_name", F.col("c_acctbal").cast("double")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    """
    SELECT 'o_orderkey' AS name, 'integer' AS type, false AS nullable UNION ALL SELECT 'o_totalprice', 'float', false
    UNION ALL SELECT 'status', 'string', true UNION ALL SELECT 'day', 'date', false
    """
)
def source_probe(t):
    """Columns and types of a CSV source, as all its rows show them."""
    path = scratch_path(t.spark, "csv")
    write_csv(t.orders.select("o_orderkey", "o_totalprice", F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.col("o_orderdate").cast("date").alias("day")), path)
    return columns_table(t.spark, probe(read_csv(t.spark, path, infer_types=False))).drop("position")
