"""Dataset lineage out of pipeline definitions, for a whole table of definitions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weir.session import plain_unions

# The part each node type plays.
SOURCES = (
    "postgres.source", "mysql.source", "csv.source", "json.source", "http.source", "s3.source", "inline.source", "generator.source",
)
DESTINATIONS = ("postgres.destination", "mysql.destination", "s3.destination", "dataset.destination")
PUBLISHING_TRANSFORMS = ("sql.transform", "aggregate.transform", "join.transform")

_DEFINITION = (
    "name STRING, nodes ARRAY<STRUCT<id: STRING, type: STRING, "
    "config: STRUCT<dataset: STRING, table: STRING, key: STRING>, metadata: STRUCT<label: STRING>>>, "
    "edges ARRAY<STRUCT<from: STRING, to: STRING, port: STRING>>"
)

EDGE_KEY = ["from_type", "from_id", "to_type", "to_id"]
WHO = ["pipeline_id", "pipeline_version_id"]


def parse_definitions(definitions: DataFrame) -> DataFrame:
    """One row per definition of a table (pipeline_id, pipeline_version_id, definition as JSON text).

    Its nodes and edges stay arrays in the row: all that is derived from one definition is derived
    in place, so the whole derivation needs no join and no shuffle.
    """
    parsed = definitions.select(*WHO, F.from_json("definition", _DEFINITION, {"mode": "FAILFAST"}).alias("d"))

    def node(n: Column) -> Column:
        # The dataset a node names: its dataset, else its table, else its object key.
        dataset = F.coalesce(*[F.nullif(n["config"][f], F.lit("")) for f in ("dataset", "table", "key")])
        publishes = dataset.isNotNull() & n["type"].isin(*DESTINATIONS, *PUBLISHING_TRANSFORMS)
        return F.struct(
            n["id"].alias("node_id"), n["type"].alias("node_type"), F.coalesce(n["metadata"]["label"], n["id"]).alias("label"),
            dataset.alias("dataset"), F.when(publishes, dataset).alias("published"),
        )

    return parsed.select(
        *WHO, F.col("d.name").alias("pipeline_name"), F.transform("d.nodes", node).alias("nodes"),
        F.coalesce("d.edges", F.array().cast("array<struct<from:string,to:string,port:string>>")).alias("edges"),
    )


def _edge(from_type, from_id, to_type, to_id, node_id, transformation=None) -> Column:
    def column(value) -> Column:
        return value if isinstance(value, Column) else F.lit(value).cast("string")

    values = {
        "from_type": from_type, "from_id": from_id, "to_type": to_type, "to_id": to_id, "node_id": node_id, "transformation": transformation,
    }
    return F.struct(*[column(v).alias(k) for k, v in values.items()])


def lineage_edges(parsed: DataFrame) -> DataFrame:
    """Edges between datasets and nodes; an edge is only claimed where the definition names something."""
    read = F.transform(
        F.filter("nodes", lambda n: n["node_type"].isin(*SOURCES) & n["dataset"].isNotNull()),
        lambda n: _edge("dataset", n["dataset"], "node", n["node_id"], n["node_id"]),
    )
    written = F.transform(
        F.filter("nodes", lambda n: n["published"].isNotNull()),
        lambda n: _edge("node", n["node_id"], "dataset", n["published"], n["node_id"], n["node_type"]),
    )
    by_id = F.map_from_entries(F.transform("nodes", lambda n: F.struct(n["node_id"], F.struct(n["node_type"], n["published"]))))

    def between(e: Column) -> Column:
        source, target = F.try_element_at("by_id", e["from"]), F.try_element_at("by_id", e["to"])
        published = source["published"]
        # A node that publishes a dataset feeds the next node through it.
        routed = published.isNotNull()
        edge = _edge(
            F.when(routed, "dataset").otherwise("node"), F.coalesce(published, e["from"]), "node", e["to"], e["to"],
            F.when(~routed, target["node_type"]),
        )
        return F.when(source.isNotNull() & target.isNotNull(), edge)

    known = parsed.withColumn("by_id", by_id)
    all_edges = F.array_distinct(F.concat(read, written, F.array_compact(F.transform("edges", between))))
    return known.select(*WHO, F.inline(all_edges))


def _node_rows(parsed: DataFrame) -> DataFrame:
    """A row for each node of each definition, and one for each dataset that a node names."""
    own = parsed.select(*WHO, "pipeline_name", F.inline("nodes"))
    touching = F.col("dataset").isNotNull() & (F.col("node_type").isin(*SOURCES) | F.col("published").isNotNull())
    entry = F.array(
        F.struct(F.lit("node").alias("type"), F.col("node_id").alias("id"), F.col("label").alias("label")),
        F.when(touching, F.struct(F.lit("dataset").alias("type"), F.col("dataset").alias("id"), F.col("dataset").alias("label"))),
    )
    return own.select("pipeline_id", "pipeline_name", "node_type", "node_id", F.inline(F.array_compact(entry)))


def lineage_nodes(parsed: DataFrame) -> DataFrame:
    """One row per pipeline node, and one per dataset and pipeline with the type of a node that names it."""
    return _node_rows(parsed).groupBy("type", "id", "pipeline_id", "pipeline_name").agg(
        F.min_by("label", "node_id").alias("label"), F.min_by("node_type", "node_id").alias("node_type")
    ).select("type", "id", "label", "node_type", "pipeline_id", "pipeline_name")


def unresolved(parsed: DataFrame) -> DataFrame:
    """Sources and destinations that name nothing, so that a gap is visible."""
    reason = F.when(
        F.col("node_type").isin(*SOURCES), "reads from a place without a dataset name"
    ).otherwise("writes to a place without a dataset name")
    nameless = F.filter("nodes", lambda n: n["dataset"].isNull() & n["node_type"].isin(*SOURCES, *DESTINATIONS))
    return parsed.select("pipeline_id", F.inline(nameless)).select("pipeline_id", "node_id", "node_type", reason.alias("reason"))


def merge_edges(*tables: DataFrame) -> DataFrame:
    """The edges of several graphs, each once per pipeline."""
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table)
    return merged.dropDuplicates([*EDGE_KEY, "pipeline_id"])


def _firsts(rows: DataFrame, *order: str) -> DataFrame:
    """Of each node or dataset the row that is first in an order with NULLs last; map tasks keep one row of each before anything is shuffled."""
    rest = [c for c in rows.columns if c not in ("type", "id")]
    ranked = [x for c in order for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]
    first = F.min(F.struct(*ranked, F.struct(*rest).alias("row"))).alias("first")
    return rows.groupBy("type", "id").agg(first).select("type", "id", *[F.col(f"first.row.{c}").alias(c) for c in rest])


def merge_nodes(*tables: DataFrame) -> DataFrame:
    """The nodes of several graphs; a dataset shared by pipelines keeps its first producer."""
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table)
    if len(tables) > 1:
        plain_unions(merged.sparkSession)
    return _firsts(merged, "pipeline_id", "label")


def first_nodes(parsed: DataFrame) -> DataFrame:
    """`merge_nodes(lineage_nodes(parsed))` in one grouping: the first pipeline decides, and within it the first node."""
    return _firsts(_node_rows(parsed), "pipeline_id", "node_id").select("type", "id", "label", "node_type", "pipeline_id", "pipeline_name")


def producers(edges: DataFrame, dataset: str | None = None) -> DataFrame:
    """Which node of which pipeline writes a dataset; all datasets without a name."""
    into = edges.where((F.col("to_type") == "dataset") & F.col("node_id").isNotNull())
    if dataset is not None:
        into = into.where(F.col("to_id") == dataset)
    return into.select(F.col("to_id").alias("dataset"), "pipeline_id", "node_id")
