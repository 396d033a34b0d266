"""Schema inference, profiling, evolution, registry (D)."""

from pyspark.sql import functions as F

from weir.catalog.registry import query
from weir.contracts import coerce, diff_schemas, fingerprints, infer_columns, infer_schema, latest_changes, preview, profile, register, schema_history, validate
from weir.contracts.evolve import classify_type_change, worst_classification
from weir.contracts.infer import columns_table
from weir.session import scratch_path
from weir.sources import Datasets

# Texts of every class, made from the columns of `events`.
_TEXTS = """
    SELECT CAST(event_id AS VARCHAR) AS id_text,
           CASE WHEN event_type = 'error' THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS day_text,
           CASE WHEN event_type = 'view' THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS mixed_time,
           CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE CAST(event_id AS VARCHAR) || '.5' END AS number_text,
           CASE WHEN event_type = 'click' THEN 'TRUE' ELSE 'false' END AS flag_text,
           CAST(event_id AS VARCHAR) || '00000000000000000000' AS long_digits,
           CASE WHEN event_type = 'click' THEN '12' ELSE event_type END AS any_text,
           CAST(NULL AS VARCHAR) AS nothing, value
    FROM events
"""


def _texts(t):
    number = F.col("event_id").cast("string")
    kind = F.col("event_type")
    day = F.date_format("ts", "yyyy-MM-dd")
    return t.events.select(
        number.alias("id_text"),
        F.when(kind == "error", "").otherwise(day).alias("day_text"),
        F.when(kind == "view", day).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("mixed_time"),
        F.when(F.col("event_id") % 2 == 0, number).otherwise(F.concat(number, F.lit(".5"))).alias("number_text"),
        F.when(kind == "click", "TRUE").otherwise("false").alias("flag_text"),
        F.concat(number, F.lit("0" * 20)).alias("long_digits"),
        F.when(kind == "click", "12").otherwise(kind).alias("any_text"),
        F.lit(None).cast("string").alias("nothing"),
        "value",
    )


def _classified(column: str, name: str) -> str:
    empty = f"{column} IS NULL OR {column} = ''"
    return rf"""
        SELECT '{name}' AS name, count_if({empty}) > 0 AS nullable,
               list_sort(list_distinct(list(CASE WHEN {empty} THEN NULL
                    WHEN regexp_matches({column}, '^\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}(:\d{{2}}(\.\d{{1,9}})?)?(Z|[+-]\d{{2}}:?\d{{2}})?$') THEN 'timestamp'
                    WHEN regexp_matches({column}, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN 'date'
                    WHEN regexp_matches({column}, '^[+-]?\d{{1,15}}$') THEN 'integer'
                    WHEN regexp_matches({column}, '^[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?\d+[eE][+-]?\d+$') THEN 'float'
                    WHEN lower({column}) IN ('true', 'false') THEN 'boolean' ELSE 'string' END))) AS seen
        FROM texts
    """


_TEXT_COLUMNS = ("id_text", "day_text", "mixed_time", "number_text", "flag_text", "long_digits", "any_text", "nothing")


@query(
    f"""
    WITH texts AS ({_TEXTS}), flags AS ({' UNION ALL '.join(_classified(c, c) for c in _TEXT_COLUMNS)})
    SELECT name, nullable, CASE WHEN len(seen) = 0 THEN 'unknown' WHEN len(seen) = 1 THEN seen[1]
                WHEN seen = ['float', 'integer'] THEN 'float' WHEN seen = ['date', 'timestamp'] THEN 'timestamp' ELSE 'string' END AS type
    FROM flags UNION ALL SELECT 'value', false, 'float'
    """
)
def infer_schema_events(t):
    return infer_schema(_texts(t)).select("name", "nullable", "type")


@query(
    f"""
    WITH texts AS ({_TEXTS})
    SELECT CAST(id_text AS BIGINT) AS id_text, strftime(TRY_CAST(nullif(day_text, '') AS DATE), '%Y-%m-%d') AS day_text,
           CAST(number_text AS DOUBLE) AS number_text, lower(flag_text) = 'true' AS flag_text, any_text, long_digits FROM texts
    """
)
def coerce_to_inferred(t):
    texts = _texts(t)
    typed = coerce(texts, infer_columns(texts))
    return typed.select("id_text", F.date_format("day_text", "yyyy-MM-dd").alias("day_text"), "number_text", "flag_text", "any_text", "long_digits")


def _profiled(column: str, kind: str, low: str, high: str) -> str:
    return (
        f"SELECT '{column}' AS name, '{kind}' AS type, CAST(count(*) - count({column}) AS BIGINT) AS null_count, "
        f"count(DISTINCT {column}) AS unique_count, {low} AS min, {high} AS max FROM o"
    )


@query(
    "WITH o AS (SELECT o_orderkey, o_totalprice, o_orderdate, nullif(o_orderpriority, '5-LOW') AS priority FROM orders) "
    + " UNION ALL ".join(
        [
            _profiled("o_orderkey", "integer", "CAST(min(o_orderkey) AS VARCHAR)", "CAST(max(o_orderkey) AS VARCHAR)"),
            _profiled("o_totalprice", "float", "CAST(min(o_totalprice) AS VARCHAR)", "CAST(max(o_totalprice) AS VARCHAR)"),
            _profiled("o_orderdate", "timestamp", "strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S')", "strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S')"),
            _profiled("priority", "string", "NULL", "NULL"),
        ]
    )
)
def profile_orders(t):
    orders = t.orders.select("o_orderkey", "o_totalprice", "o_orderdate", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))
    return profile(orders, exact_distinct=True).select("name", "type", "null_count", "unique_count", "min", "max")


@query(
    """
    SELECT lang AS dataset, 'doc_id' AS column, 'type_changed' AS kind, 'WARNING' AS classification, 'integer' AS from_type, 'string' AS to_type
    FROM documents GROUP BY lang
    UNION ALL SELECT DISTINCT lang, 'n_chars', 'column_removed', 'BREAKING', 'integer', NULL FROM documents
    UNION ALL SELECT DISTINCT lang, 'quality', 'column_added', 'COMPATIBLE', NULL, 'integer' FROM documents
    UNION ALL SELECT lang, 'source', 'nullability_relaxed', 'WARNING', 'string', 'string' FROM documents GROUP BY lang HAVING bool_or(source = 'src0')
    UNION ALL SELECT lang, 'text', 'nullability_tightened', 'COMPATIBLE', 'string', 'string' FROM documents GROUP BY lang HAVING bool_or(source = 'src1')
    """
)
def schema_diff(t):
    """One schema per language, with nullability as the data shows it, before and after an edit."""
    before = t.documents.groupBy(F.col("lang").alias("dataset")).agg(
        F.bool_or(F.col("source") == "src1").alias("text_nullable")
    )
    old = before.select(
        "dataset",
        F.inline(
            F.array(
                _column("doc_id", "integer"), _column("text", "string", F.col("text_nullable")), _column("source", "string"), _column("n_chars", "integer"),
            )
        ),
    )
    after = t.documents.groupBy(F.col("lang").alias("dataset")).agg(F.bool_or(F.col("source") == "src0").alias("source_nullable"))
    new = after.select(
        "dataset",
        F.inline(
            F.array(
                _column("doc_id", "string"), _column("text", "string"), _column("source", "string", F.col("source_nullable")),
                _column("quality", "integer", F.lit(True)),
            )
        ),
    )
    return diff_schemas(old, new, ["dataset"]).select("dataset", "column", "kind", "classification", "from_type", "to_type")


def _column(name, kind, nullable=None):
    nullable = F.lit(False) if nullable is None else nullable
    return F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), nullable.alias("nullable"))


@query(
    """
    WITH pairs AS (SELECT DISTINCT p_type, CASE p_type WHEN 'ECONOMY' THEN 'integer' WHEN 'SMALL' THEN 'float' WHEN 'LARGE' THEN 'date' ELSE 'unknown' END AS a,
                   p_brand, CASE p_brand WHEN 'Brand#1' THEN 'float' WHEN 'Brand#2' THEN 'string' WHEN 'Brand#3' THEN 'json' ELSE 'timestamp' END AS b FROM part),
         classed AS (SELECT p_type, CASE WHEN a = b OR a || '->' || b IN ('integer->float', 'date->timestamp', 'unknown->string', 'unknown->float', 'unknown->timestamp', 'unknown->json') THEN 0
                                  WHEN a || '->' || b IN ('integer->string', 'float->string', 'date->string', 'integer->json', 'float->json') THEN 1 ELSE 2 END AS s FROM pairs)
    SELECT p_type, CASE max(s) WHEN 0 THEN 'COMPATIBLE' WHEN 1 THEN 'WARNING' ELSE 'BREAKING' END AS worst, CAST(count_if(s = 1) AS BIGINT) AS warnings
    FROM classed GROUP BY p_type
    """
)
def type_change_classes(t):
    kind, brand = F.col("p_type"), F.col("p_brand")
    before = F.when(kind == "ECONOMY", "integer").when(kind == "SMALL", "float").when(kind == "LARGE", "date").otherwise("unknown")
    after = F.when(brand == "Brand#1", "float").when(brand == "Brand#2", "string").when(brand == "Brand#3", "json").otherwise("timestamp")
    pairs = t.part.select("p_type", "p_brand").distinct().select("p_type", classify_type_change(before, after).alias("c"))
    return pairs.groupBy("p_type").agg(worst_classification("c").alias("worst"), F.count_if(F.col("c") == "WARNING").alias("warnings"))


@query(
    """
    WITH c AS (SELECT lang AS dataset, 'text' AS name, 'string' AS type, bool_or(n_chars < 50) AS nullable FROM documents GROUP BY lang
               UNION ALL SELECT lang, 'doc_id', 'integer', false FROM documents GROUP BY lang)
    SELECT dataset, substr(sha256(string_agg(name || ':' || type || ':' || CASE WHEN nullable THEN 'null' ELSE 'notnull' END, '|'
                                  ORDER BY name || ':' || type || ':' || CASE WHEN nullable THEN 'null' ELSE 'notnull' END)), 1, 32) AS fingerprint
    FROM c GROUP BY dataset
    """
)
def schema_fingerprint(t):
    flags = t.documents.groupBy(F.col("lang").alias("dataset")).agg(F.bool_or(F.col("n_chars") < 50).alias("short"))
    columns = flags.select("dataset", F.inline(F.array(_column("text", "string", F.col("short")), _column("doc_id", "integer"))))
    return fingerprints(columns, ["dataset"])


def _versions(t):
    """A version per user and event type: the columns seen up to the k-th type of that user."""
    kinds = t.events.groupBy(F.col("user_id").cast("string").alias("dataset"), "event_type").agg(F.min("ts").alias("first_seen"), F.count("*").alias("n"))
    from pyspark.sql import Window

    # At most five event types per user.
    ranked = kinds.withColumn("version", F.row_number().over(Window.partitionBy("dataset").orderBy("first_seen", "event_type")))
    steps = ranked.select("dataset", "version").withColumnRenamed("version", "upto")
    return (
        steps.join(ranked, "dataset").where("version <= upto")
        .select(
            "dataset", F.col("upto").cast("int").alias("version"), F.col("event_type").alias("name"),
            F.when(F.col("upto") >= 4, "float").otherwise("integer").alias("type"), (F.col("upto") > F.col("version") + 2).alias("nullable"),
        )
    )


_VERSIONS = """
    WITH kinds AS (SELECT CAST(user_id AS VARCHAR) AS dataset, event_type, min(ts) AS first_seen FROM events GROUP BY ALL),
         ranked AS (SELECT dataset, event_type, row_number() OVER (PARTITION BY dataset ORDER BY first_seen, event_type) AS v FROM kinds),
         versions AS (SELECT s.dataset, s.v AS version, r.event_type AS name, CASE WHEN s.v >= 4 THEN 'float' ELSE 'integer' END AS type, s.v > r.v + 2 AS nullable
                      FROM ranked s JOIN ranked r ON s.dataset = r.dataset AND r.v <= s.v),
         changes AS (SELECT n.dataset, n.version, n.name, o.type AS ot, n.type AS nt, o.nullable AS onl, n.nullable AS nnl, o.name IS NULL AS is_new
                     FROM versions n LEFT JOIN versions o ON n.dataset = o.dataset AND n.version = o.version + 1 AND n.name = o.name WHERE n.version > 1),
         listed AS (SELECT dataset, version, name AS "column", 'column_added' AS kind, CASE WHEN nnl THEN 'COMPATIBLE' ELSE 'WARNING' END AS classification FROM changes WHERE is_new
                    UNION ALL SELECT dataset, version, name, 'type_changed', 'COMPATIBLE' FROM changes WHERE NOT is_new AND ot <> nt
                    UNION ALL SELECT dataset, version, name, 'nullability_relaxed', 'WARNING' FROM changes WHERE NOT is_new AND NOT onl AND nnl)
"""


@query(_VERSIONS + 'SELECT dataset, CAST(version AS INTEGER) AS version, "column", kind, classification FROM listed')
def schema_versions_history(t):
    return schema_history(_versions(t)).select("dataset", "version", "column", "kind", "classification")


@query(
    _VERSIONS
    + """SELECT dataset, CAST(version AS INTEGER) AS version, "column", kind, classification FROM listed l
         WHERE version = (SELECT max(version) FROM versions v WHERE v.dataset = l.dataset)"""
)
def schema_latest_change(t):
    return latest_changes(_versions(t)).select("dataset", "version", "column", "kind", "classification")


@query(
    """
    WITH f AS (SELECT lang, bool_or(n_chars < 50) AS short, bool_or(source = 'src3') AS third FROM documents GROUP BY lang)
    SELECT lang AS dataset, CAST(CASE WHEN lang = 'fr' THEN 1 ELSE 2 END AS INTEGER) AS version, 'text' AS name, 'string' AS type, short AS nullable
    FROM f WHERE lang = 'fr' OR short <> third
    """
)
def schema_register(t):
    """The observed schema of each language against registered versions that know all but one of them."""
    flags = t.documents.groupBy(F.col("lang").alias("dataset")).agg(
        F.bool_or(F.col("n_chars") < 50).alias("short"), F.bool_or(F.col("source") == "src3").alias("third")
    )
    observed = flags.select("dataset", F.lit("text").alias("name"), F.lit("string").alias("type"), F.col("short").alias("nullable"))
    known = flags.where("dataset <> 'fr'").select("dataset", F.lit("text").alias("name"), F.lit("string").alias("type"), F.col("third").alias("nullable"))
    versions = known.join(fingerprints(known, ["dataset"]), "dataset").withColumn("version", F.lit(1))
    return register(observed, versions).select("dataset", "version", "name", "type", "nullable")


@query(
    """
    SELECT 'o_orderpriority' AS column, 'type_changed' AS kind, 'WARNING' AS classification
    UNION ALL SELECT 'o_clerk', 'column_removed', 'BREAKING' UNION ALL SELECT 'o_orderstatus', 'column_added', 'WARNING'
    """
)
def schema_contract_check(t):
    """The observed schema of all orders against a declared contract."""
    orders = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus")
    contract = [
        {"name": "o_orderkey", "type": "integer", "nullable": False}, {"name": "o_orderpriority", "type": "integer", "nullable": False},
        {"name": "o_clerk", "type": "string", "nullable": True},
    ]
    found = validate(orders, "orders", expected=contract, on_breaking="warn")
    # integer to string keeps the values readable
    return t.spark.createDataFrame([(c["column"], c["kind"], c["classification"]) for c in found.changes], "column STRING, kind STRING, classification STRING")


@query(
    """
    WITH head AS (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100)
    SELECT 'o_custkey' AS name, count(DISTINCT o_custkey) AS unique_count, CAST(min(o_custkey) AS VARCHAR) AS min, CAST(max(o_custkey) AS VARCHAR) AS max FROM head
    UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus), NULL, NULL FROM head
    """
)
def preview_orders(t):
    ordered = t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderstatus")
    shown = preview(ordered)
    return shown.profile.select("name", "unique_count", "min", "max")


@query(
    """
    WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, nullif(o_orderpriority, '5-LOW') AS priority FROM orders)
    SELECT 'o_orderkey' AS name, 'integer' AS type, count(*) AS row_count, 0::BIGINT AS null_count, CAST(min(o_orderkey) AS VARCHAR) AS min, CAST(max(o_orderkey) AS VARCHAR) AS max, true AS close, true AS middle FROM o
    UNION ALL SELECT 'o_custkey', 'integer', count(*), 0, CAST(min(o_custkey) AS VARCHAR), CAST(max(o_custkey) AS VARCHAR), true, true FROM o
    UNION ALL SELECT 'o_totalprice', 'float', count(*), 0, CAST(min(o_totalprice) AS VARCHAR), CAST(max(o_totalprice) AS VARCHAR), true, true FROM o
    UNION ALL SELECT 'priority', 'string', count(*), count(*) - count(priority), NULL, NULL, true, NULL FROM o
    """
)
def profile_appended(t):
    """A dataset that grows by three appends, profiled after each from what is kept of the parts before; distinct counts within 2 %, medians within 2 % of the ranks."""
    datasets = Datasets(t.spark, scratch_path(t.spark, "datasets"))
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"), "o_orderstatus")
    for status in ("F", "O", "P"):
        datasets.write("orders", orders.where(F.col("o_orderstatus") == status).drop("o_orderstatus"), "append")
        found = datasets.profile("orders")
    rows = datasets.read("orders")
    numbers = ("o_orderkey", "o_custkey", "o_totalprice")
    exact = rows.agg(
        *[F.count_distinct(c).alias(f"d_{c}") for c in rows.columns], *[F.percentile_approx(c, F.array(F.lit(0.48), F.lit(0.52)), F.lit(100_000)).alias(f"q_{c}") for c in numbers],
    ).select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("name"), F.col(f"d_{c}").alias("distinct"),
            *[(F.col(f"q_{c}")[k].cast("double") if c in numbers else F.lit(None).cast("double")).alias(n) for k, n in enumerate(("low", "high"))],
        ) for c in rows.columns
    ])))
    close = F.abs(F.col("unique_count") - F.col("distinct")) <= F.greatest(F.lit(2), 0.02 * F.col("distinct"))
    middle = (F.col("quantiles")[0] >= F.col("low")) & (F.col("quantiles")[0] <= F.col("high"))
    return found.join(exact, "name").select("name", "type", "row_count", "null_count", "min", "max", close.alias("close"), middle.alias("middle"))
