import random

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
#: Names that operators use inside, as extra columns of their input.
CLASHES = ["key", "bands", "spans", "score", "n_shingles", "chunk", "row", "base", "slot", "shard", "ids", "n_tokens", "held_out", "class_id", "info", "unit"]


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def odd_rows():
    """Ids and texts with nulls, empty, blank, long, repeated and equal ones."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "épée", "日本", "x.y@mail.com", "10.0.0.1", "idiot"]
    long_text = " ".join(rng.choice(words) for _ in range(6000))
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two three four five six"), (6, "one two three four five six"), (6, "one two three four five six"),
        (7, long_text), (8, "ends here\n"), (None, "no id"), (9, "😀 nul \x01 \x02 ok"), (10, "a" * 3000),
    ]


@pytest.fixture
def odd_docs(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, "doc_id long, text string").repartition(3)
    return df.withColumns({name: F.lit("clash") for name in CLASHES})


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
