"""The stages one by one against plain versions, and the registered queries against their SQL."""

import importlib
import sys

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from weir.llm.secrets import find_secrets
from weir.llm.toxicity import toxicity


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = (docs, stage(spark, docs, sf))
        docs = out[name][1]
    return out


def test_stages(spark, sf, stages):
    assert [*stages] == ["toxicity", "near_dedup", "secrets", "packing"]
    before, after = stages["toxicity"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r["doc_id"] for r in toxicity(before, labels).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in after.collect()} == kept and after.columns == before.columns

    before, after = stages["near_dedup"]
    from llm.test_dedup import brute

    components = brute([(r["doc_id"], r["text"]) for r in before.collect()])
    assert {r["doc_id"] for r in after.collect()} == {i for i, (_, c) in components.items() if i == c} and after.columns == before.columns

    before = stages["secrets"][0]
    planted = before.limit(4).withColumns({"doc_id": F.col("doc_id") + 10**6, "text": F.concat("text", F.lit(' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end'))})
    before = before.unionByName(planted)
    after = corpus_pipeline.blank_secrets(spark, before, sf)
    assert after.columns == before.columns and after.count() == before.count()
    old, new = ({r["doc_id"]: r for r in df.collect()} for df in (before, after))
    hit = {r["doc_id"] for r in find_secrets(before).where("size(spans) > 0").collect()}
    assert len(hit) >= 4 and all(("<secret>" in new[i]["text"]) == (i in hit) for i in new) and all(new[i] == old[i] for i in new if i not in hit)
    assert all(new[i]["n_chars"] == len(new[i]["text"]) for i in hit)

    before, after = stages["packing"]
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()}


def test_run_and_empty(spark, sf, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, stages["packing"][1].collect()))
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


@pytest.mark.parametrize("name", ["op2_top_k", "op7_near_dedup"])
def test_query_equals_sql(spark, sf, name):
    assert compare(queries()[name](spark, sf), connect(sf), oracle_sql()[name]) == []


def test_ten_operators_and_the_pipeline_are_registered():
    names = queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names


def test_entry_works_without_the_subpackage(monkeypatch):
    """As if the folders had been removed: the other queries stay."""
    for name in [n for n in sys.modules if n in ("__spark_entry__", "corpus_pipeline") or n.startswith("weir.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    assert not any(n.startswith("op1_") or n == "pipeline" for n in entry.queries()) and len(entry.queries()) > 130
    monkeypatch.delitem(sys.modules, "__spark_entry__")
