"""What the operators hold in memory at once."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

import corpus_pipeline
from weir.llm.packing import pack
from weir.llm.toxicity import WINDOW, norms
from weir.session import BATCH_BYTES

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unset(spark):
    """The session without a bound of its own, as the stages find it."""
    before = spark.conf.get(LIMIT, None)
    spark.conf.unset(LIMIT)
    yield
    spark.conf.set(LIMIT, before) if before is not None else spark.conf.unset(LIMIT)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_bound_batches(spark, sf, unset, name, stage):
    stage(spark, spark.read.parquet(f"{sf}/documents.parquet").limit(3), sf)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["size"])

    long = spark.range(0, 10_000, 1, 1).select(F.repeat(F.lit("x"), 2_000).alias("text"))
    found = [r["size"] for r in long.mapInArrow(sizes, "size long").collect()]
    assert sum(found) > 20_000_000 and max(found) < 1.2 * BATCH_BYTES


def test_a_bound_of_the_session_stays(spark, sf, unset):
    spark.conf.set(LIMIT, "1000000")
    pack(spark.read.parquet(f"{sf}/documents.parquet").limit(3))
    assert spark.conf.get(LIMIT) == "1000000"


def test_offsets_need_no_workers_of_their_own(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(3)
    monkeypatch.setattr(SparkContext, "parallelize", lambda *a, **b: pytest.fail("rows of the driver pass through Python workers"))
    assert pack(docs).select("doc_id").distinct().count() == 3


def test_norms_of_long_words_in_parts():
    codes = np.random.default_rng(3).integers(1, 27, (8192, WINDOW)).astype(np.uint8)
    tracemalloc.start()
    found = norms(codes)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20_000_000
    assert all(norms(codes[n : n + 1])[0] == pytest.approx(found[n], rel=1e-6) for n in (0, 454, 455, 4096, 8191))
