"""Everything upstream or downstream of a dataset or node."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from weir.errors import ConfigError
from weir.session import cut_lineage, plain_unions, scratch_path

#: Rounds before what is left of the graph is searched for chains.
PLAIN_ROUNDS = 12

#: Pairs of node types that a round's steps are picked by; a graph with more of them is searched whole in every round.
KINDS = 400

_NODE = ["type", "id"]
_VISITED = "type STRING, id STRING, distance BIGINT, round INT"


def reachable(edges: DataFrame, starts: DataFrame, direction: str = "down") -> DataFrame:
    """(type, id, distance) of all that can be reached from `starts` (type, id), the starts left out.

    Breadth first. Every round writes what it found as one more part of one folder, and the next reads that folder as a
    single table, so a round's plan has the same size however deep the graph is; the driver sees one count for each round.
    What lies deeper than a few rounds is contracted first: nodes with one way in and one way out follow their only
    predecessor by pointer doubling up to the node where their chain begins, and the search goes from there to the chain's end
    in one step. So a chain of n nodes takes about log2(n) rounds, and its nodes get their distances at the end. Cycles end by
    themselves.
    """
    if direction not in ("up", "down"):
        raise ConfigError("direction must be up or down")
    plain_unions(edges.sparkSession)
    here, there = ("from", "to") if direction == "down" else ("to", "from")
    spark = edges.sparkSession
    steps = cut_lineage(
        edges.select(
            F.col(f"{here}_type").alias("type"), F.col(f"{here}_id").alias("id"),
            F.col(f"{there}_type").alias("next_type"), F.col(f"{there}_id").alias("next_id"),
        ).withColumn("length", F.lit(1).cast("bigint")),
        "edges",
    )
    folder = scratch_path(spark, "reached")
    first = starts.select(*_NODE).distinct().withColumn("distance", F.lit(0).cast("bigint"))
    turn, found, chains = 0, _add(first, folder, 0), None
    # a round reads only the steps from the types it can have come to, and the visited nodes of the types these lead to
    kinds, begun = _kinds(steps), [r["type"] for r in first.select("type").distinct().limit(KINDS).collect()]
    types = set(begun) if len(begun) < KINDS else None
    while found:
        if turn == PLAIN_ROUNDS:
            steps, chains = _contracted(steps, _nearest(_visited(spark, folder)))
            kinds = _kinds(steps)
        tried, known, ahead = steps, _visited(spark, folder), None
        if kinds is not None and types is not None:
            ahead = {there for here, there in kinds if here in types}
            tried, known = steps.where(F.col("type").isin(*types)), known.where(F.col("type").isin(*ahead))
        fresh = _next(tried, spark.read.schema("type STRING, id STRING, distance BIGINT").parquet(f"{folder}/round={turn}"), known)
        types = ahead
        turn += 1
        found = _add(fresh, folder, turn)
    reached = _visited(spark, folder).select(*_NODE, "distance")
    if chains is not None:  # before, steps are of one length and no node is found again
        reached = _nearest(reached)
    if chains is not None:
        heads = reached.select(F.col("type").alias("head_type"), F.col("id").alias("head_id"), F.col("distance").alias("before"))
        inner = chains.join(heads, ["head_type", "head_id"]).select(*_NODE, (F.col("before") + F.col("depth")).alias("distance"))
        reached = reached.unionByName(inner)
    return reached.where("distance > 0").withColumn("distance", F.col("distance").cast("int"))


def _add(df: DataFrame, folder: str, turn: int) -> int:
    """Writes the part of one round; the number of its rows is counted on the way."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{folder}/round={turn}")
    return seen.get["rows"]


def _kinds(steps: DataFrame) -> set[tuple[str, str]] | None:
    """The types that steps lead from and to; None if there are too many, or unnamed ones."""
    pairs = steps.select("type", "next_type").distinct().limit(KINDS).collect()
    return {(r["type"], r["next_type"]) for r in pairs} if len(pairs) < KINDS and all(r["next_type"] is not None for r in pairs) else None


def _visited(spark, folder: str) -> DataFrame:
    return spark.read.schema(_VISITED).parquet(folder)


def _nearest(visited: DataFrame) -> DataFrame:
    return visited.groupBy(*_NODE).agg(F.min("distance").alias("distance"))


def _next(steps: DataFrame, frontier: DataFrame, visited: DataFrame) -> DataFrame:
    """The nodes that one more step reaches, or reaches by a shorter way than known; one grouping of both tables."""
    ahead = steps.join(frontier, _NODE).select(F.col("next_type").alias("type"), F.col("next_id").alias("id"), (F.col("distance") + F.col("length")).alias("new"))
    none = F.lit(None).cast("bigint")
    both = visited.select(*_NODE, F.col("distance").alias("old"), none.alias("new")).unionByName(ahead.select(*_NODE, none.alias("old"), "new"))
    best = both.groupBy(*_NODE).agg(F.min("old").alias("old"), F.min("new").alias("new"))
    return best.where("new is not null and (old is null or new < old)").select(*_NODE, F.col("new").alias("distance"))


def _contracted(steps: DataFrame, reached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps between the ends of chains with their lengths, and each inner node's chain: type, id, head_type, head_id, depth.

    Inner nodes have one step in and one out and are not reached yet. A ring of them that nothing leads into has no head; its
    pointers still end inside after enough rounds, and it is left out, as nothing reaches it.
    """
    steps = steps.distinct()
    ways = F.count(F.lit(1)).alias("ways")
    once_out = steps.groupBy(*_NODE).agg(ways).where("ways = 1").select(*_NODE)
    once_in = steps.groupBy(F.col("next_type").alias("type"), F.col("next_id").alias("id")).agg(ways).where("ways = 1").select(*_NODE)
    inner = cut_lineage(once_out.join(once_in, _NODE, "left_semi").join(reached, _NODE, "left_anti"), "inner")
    marks = inner.select(F.col("type").alias("head_type"), F.col("id").alias("head_id"), F.lit(True).alias("inside"))
    before = steps.select(F.col("next_type").alias("type"), F.col("next_id").alias("id"), F.col("type").alias("head_type"), F.col("id").alias("head_id"), F.col("length").alias("depth"))
    moving = cut_lineage(before.join(inner, _NODE, "left_semi").join(marks, ["head_type", "head_id"], "left").withColumn("inside", F.col("inside").isNotNull()), "pointers")
    rounds = moving.count().bit_length()
    for _ in range(rounds):
        if moving.where("inside").isEmpty():
            break
        ahead = moving.select(
            F.col("type").alias("head_type"), F.col("id").alias("head_id"), F.col("head_type").alias("far_type"), F.col("head_id").alias("far_id"),
            F.col("depth").alias("far"), F.col("inside").alias("far_inside"),
        )
        jumped = moving.join(ahead, ["head_type", "head_id"], "left")
        moving = cut_lineage(
            jumped.select(
                *_NODE, F.coalesce("far_type", "head_type").alias("head_type"), F.coalesce("far_id", "head_id").alias("head_id"),
                (F.col("depth") + F.coalesce("far", F.lit(0))).alias("depth"), F.coalesce("far_inside", F.lit(False)).alias("inside"),
            ),
            "pointers",
        )
    chains = moving.where("not inside").drop("inside")
    ends = steps.join(inner.select(F.col("type").alias("next_type"), F.col("id").alias("next_id")), ["next_type", "next_id"], "left_anti")
    joined = ends.join(moving, _NODE, "left").where("inside is null or not inside").select(
        F.coalesce("head_type", "type").alias("type"), F.coalesce("head_id", "id").alias("id"), "next_type", "next_id", (F.col("length") + F.coalesce("depth", F.lit(0))).alias("length")
    )
    shortest = joined.groupBy(*_NODE, "next_type", "next_id").agg(F.min("length").alias("length"))
    return cut_lineage(shortest, "contracted"), chains
