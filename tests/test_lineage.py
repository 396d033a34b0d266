import json
import random

import pytest
from conftest import rows_of

from weir.errors import ConfigError
from weir.lineage import (
    column_lineage, describe_select, first_nodes, lineage_edges, lineage_nodes, merge_edges, merge_nodes, parse_definitions, producers, reachable, unresolved, unused_columns,
)

SPEC = {
    "name": "sales",
    "nodes": [
        {"id": "in", "type": "csv.source", "config": {"dataset": "raw"}, "metadata": {"label": "Input"}},
        {"id": "nameless", "type": "inline.source", "config": {"rows": []}},
        {"id": "sql", "type": "sql.transform", "config": {"dataset": "clean", "query": "SELECT 1"}},
        {"id": "keep", "type": "filter.transform", "config": {"dataset": "ignored"}},
        {"id": "out", "type": "postgres.destination", "config": {"table": "public.t"}},
        {"id": "lost", "type": "s3.destination", "config": {"key": ""}},
    ],
    "edges": [
        {"from": "in", "to": "sql"}, {"from": "sql", "to": "keep"}, {"from": "keep", "to": "out"}, {"from": "keep", "to": "out", "port": "x"}, {"from": "gone", "to": "out"},
    ],
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [("p1", "v1", json.dumps(SPEC)), ("p2", "v1", json.dumps({"name": "b", "nodes": SPEC["nodes"][:1], "edges": []}))]
    return parse_definitions(spark.createDataFrame(rows, "pipeline_id STRING, pipeline_version_id STRING, definition STRING"))


def test_edges(parsed):
    edges = lineage_edges(parsed).where("pipeline_id = 'p1'")
    assert rows_of(edges, "from_type", "from_id", "to_type", "to_id", "node_id", "transformation") == [
        ("dataset", "clean", "node", "keep", "keep", None), ("dataset", "raw", "node", "in", "in", None), ("node", "in", "node", "sql", "sql", "sql.transform"),
        ("node", "keep", "node", "out", "out", "postgres.destination"), ("node", "out", "dataset", "public.t", "out", "postgres.destination"),
        ("node", "sql", "dataset", "clean", "sql", "sql.transform"),
    ]
    assert rows_of(producers(edges, "clean")) == [("clean", "p1", "sql")]
    plan = lineage_edges(parsed)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_nodes_and_gaps(parsed):
    nodes = lineage_nodes(parsed)
    assert rows_of(nodes.where("type = 'dataset' AND pipeline_id = 'p1'"), "id", "node_type") == [
        ("clean", "sql.transform"), ("public.t", "postgres.destination"), ("raw", "csv.source"),
    ]
    assert nodes.where("type = 'node' AND id = 'in' AND pipeline_id = 'p1'").head().label == "Input"
    assert rows_of(unresolved(parsed), "node_id", "node_type") == [("lost", "s3.destination"), ("nameless", "inline.source")]
    merged = merge_nodes(nodes.where("pipeline_id = 'p1'"), nodes.where("pipeline_id = 'p2'"))
    assert rows_of(merged.where("id = 'raw'"), "pipeline_id") == [("p1",)]
    edges = lineage_edges(parsed)
    assert merge_edges(edges, edges).count() == edges.count() == 7


def test_first_nodes_equal_merged_nodes_in_one_grouping(parsed):
    first, merged = first_nodes(parsed), merge_nodes(lineage_nodes(parsed))
    assert first.columns == merged.columns and rows_of(first) == rows_of(merged)
    assert first_nodes(parsed)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert "Window" not in merge_nodes(lineage_nodes(parsed))._jdf.queryExecution().executedPlan().toString()


def test_reachability_with_cycle(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "a"), ("d", "d")]
    edges = spark.createDataFrame([("dataset", f, "dataset", t) for f, t in pairs], "from_type STRING, from_id STRING, to_type STRING, to_id STRING")
    starts = spark.createDataFrame([("dataset", "a")], "type STRING, id STRING")
    assert rows_of(reachable(edges, starts), "id", "distance") == [("b", 1), ("c", 2), ("d", 3)]
    assert rows_of(reachable(edges, starts, "up"), "id", "distance") == [("b", 2), ("c", 1), ("x", 1)]
    with pytest.raises(ConfigError):
        reachable(edges, starts, "sideways")


def _edges(spark, pairs):
    return spark.createDataFrame([("dataset", f, "dataset", t) for f, t in pairs], "from_type STRING, from_id STRING, to_type STRING, to_id STRING")


def _breadth_first(pairs, start):
    distance, frontier = {start: 0}, [start]
    while frontier:
        ahead = []
        for node in frontier:
            for a, b in pairs:
                if a == node and b not in distance:
                    distance[b] = distance[node] + 1
                    ahead.append(b)
        frontier = ahead
    return sorted((n, d) for n, d in distance.items() if d)


def test_reachability_of_a_long_chain(spark, monkeypatch):
    """100 nodes in a row: few rounds, and no round's plan is larger than that of another."""
    import weir.lineage.reach as reach
    from weir.lineage.reach import PLAIN_ROUNDS

    sizes = []

    def add(df, folder, turn):
        sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        return kept(df, folder, turn)

    kept = reach._add
    monkeypatch.setattr(reach, "_add", add)
    pairs = [(f"n{k}", f"n{k + 1}") for k in range(100)] + [(f"ring{k}", f"ring{(k + 1) % 3}") for k in range(3)]
    got = rows_of(reachable(_edges(spark, pairs), spark.createDataFrame([("dataset", "n0")], "type STRING, id STRING")), "id", "distance")
    assert got == _breadth_first(pairs, "n0")
    assert len(sizes) <= PLAIN_ROUNDS + 4 and len(set(sizes[1:])) == 1


def test_reachability_of_deep_graphs(spark):
    """Chains that branch, meet again by ways of different lengths, lead back, and end."""
    rng = random.Random(4)
    for _ in range(3):
        pairs, last = [("s", "c0_0")], 0
        for chain in range(14):
            length = rng.randint(1, 12)
            pairs += [(f"c{chain}_{k}", f"c{chain}_{k + 1}") for k in range(length)]
            pairs += [(f"c{chain}_{length}", f"c{rng.randint(0, chain + 2)}_{rng.randint(0, 4)}") for _ in range(rng.randint(1, 3))]
        pairs = sorted(set(pairs) | {("far0", "far1"), ("far1", "far0"), ("far1", "far2")})
        for direction, start in (("down", "s"), ("up", "c3_1")):
            turned = pairs if direction == "down" else [(b, a) for a, b in pairs]
            got = rows_of(reachable(_edges(spark, pairs), spark.createDataFrame([("dataset", start)], "type STRING, id STRING"), direction), "id", "distance")
            assert got == _breadth_first(turned, start)
    none = spark.createDataFrame([], "type STRING, id STRING")
    assert reachable(_edges(spark, pairs), none).count() == 0


def test_rounds_read_only_the_types_they_can_have_come_to(spark, monkeypatch):
    import weir.lineage.reach as reach

    tried = []
    monkeypatch.setattr(reach, "_next", lambda steps, frontier, visited, kept=reach._next: (tried.append((rows_of(steps.select("type").distinct()), rows_of(visited.select("type").distinct()))), kept(steps, frontier, visited))[1])
    rows = [("a", "1", "b", "1"), ("b", "1", "c", "1"), ("c", "1", "d", "1"), ("d", "2", "d", "3"), ("x", "1", "a", "1")]
    schema = "from_type STRING, from_id STRING, to_type STRING, to_id STRING"
    starts = spark.createDataFrame([("a", "1")], "type STRING, id STRING")
    assert rows_of(reachable(spark.createDataFrame(rows, schema), starts)) == [("b", "1", 1), ("c", "1", 2), ("d", "1", 3)]
    assert tried == [([("a",)], []), ([("b",)], []), ([("c",)], []), ([("d",)], [("d",)])]
    unnamed = [*rows, ("c", "1", None, "1"), ("a", "1", None, "1")]
    assert rows_of(reachable(spark.createDataFrame(unnamed, schema), starts), "id", "distance") == [("1", 1), ("1", 1), ("1", 2), ("1", 3)]


def test_columns(spark):
    spark.createDataFrame([(1, 2, "x")], "a INT, b INT, c STRING").createOrReplaceTempView("lineage_t")
    described = describe_select(spark.sql("SELECT a + b AS total, upper(c) AS c, 1 AS one FROM lineage_t WHERE a > 0 ORDER BY c LIMIT 3"))
    lineage = column_lineage(described)
    assert rows_of(lineage, "column", "source") == [("c", "c"), ("one", None), ("total", "a"), ("total", "b")]
    inputs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "name STRING")
    assert rows_of(unused_columns(lineage, inputs)) == [("d",)]
    star = spark.createDataFrame([("*", [], "*", True)], described.select("name", "sources", "expression", "is_star").schema)
    mixed = column_lineage(star.unionByName(described.select("name", "sources", "expression", "is_star")))
    assert mixed.where("NOT resolved").count() == 1 and unused_columns(mixed, inputs).count() == 0
    spark.catalog.dropTempView("lineage_t")
