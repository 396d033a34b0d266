"""Exact search against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weir.llm import search
from weir.llm.search import top_k


def brute(rows, asked, k):
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            vectors[i] = [math.floor(1024 * x) for x in v]
    out = []
    for q in filter(asked, vectors):
        scores = sorted(((sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q), key=lambda p: (-p[0], p[1]))
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def check(spark, rows, k=10):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit(1), "q": F.lit(2), "class_id": F.lit(3), "rank": F.lit(0)})
    got = top_k(df, F.col("vec_id") % 100 == 0, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 100 == 0, k)


def test_random_with_ties_and_copies(spark):
    rng = np.random.default_rng(1)
    rows = [(n, (rng.integers(-3, 4, 6) / 4).tolist()) for n in range(700)]  # few values: many equal scores and vectors
    rows += [(n, rows[200][1]) for n in range(700, 760)] + [(n, rows[0][1]) for n in range(900, 1001)]
    check(spark, rows)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (100, None), (200, [float("nan"), 1.0]), (300, [None, 1.0]), (400, [float("inf"), 0.0]), (1, [0.5]), (2, []), (None, [1.0, 1.0]), (500, [-1.0, 3.0, 0.25])]
    check(spark, rows)
    check(spark, [(0, [1.0])])
    check(spark, [])
    check(spark, [(0, [1.0, -1.0])] * 3 + [(100, [2.0, 2.0])])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_vectors_go_through_the_driver(spark):
    """Files of vectors are small, what is made of them is not: copies of queries for all blocks grow with the square of the rows."""
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 1 << 20
    rows = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.col("id") % 7 / 8, F.col("id") % 5 / 4).alias("embedding"))
    assert "Join" in (plan := plan_of(top_k(rows, F.col("vec_id") % 100 == 0))) and "Broadcast" not in plan
    classes = rows.select(F.col("vec_id").alias("class_id"), search.whole_numbers(F.col("embedding")).alias("q"))
    vectors, blocks = search._blocks(classes, 2, 2, "v", 64)
    queries, _ = search._blocks(classes, 2, 2, "q", 32)
    assert blocks == 5 and "Broadcast" not in plan_of(search._meet(queries, vectors, blocks))


@pytest.mark.parametrize("slices", [1, 3, 9])
def test_slices_and_blocks_of_any_size(spark, monkeypatch, slices):
    """Entries are added up over all slices, components of any size, scores of both signs and queries without a positive score."""
    monkeypatch.setattr(search, "BLOCK", 50)
    monkeypatch.setattr(search, "QUERIES", 2)
    monkeypatch.setattr(search, "PAIRS", 7)
    rng = np.random.default_rng(slices)
    rows = [(n, (rng.normal(0, (1, 90, 2e5)[n % 3], 5)).tolist()) for n in range(400)] + [(n, (-abs(rng.normal(0, 1, 5))).tolist()) for n in (500, 600)] + [(700, [0.0] * 5), (701, [2.2e6] + [0.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_k(df, F.col("vec_id") % 100 == 0, 4, slices=slices).collect()
    assert sorted(map(tuple, got)) == brute(rows, lambda i: i % 100 == 0, 4)
