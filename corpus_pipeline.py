"""From documents to training sequences: toxic documents go, one of each near-duplicate group stays, secrets are blanked, the rest is packed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.dedup import near_duplicates
from weir.llm.packing import pack
from weir.llm.queries import pieces_digest
from weir.llm.secrets import finder, redacted
from weir.llm.toxicity import THRESHOLD, scorer
from weir.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the machine does not call toxic, with all their columns; a null id is kept."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return docs.where(scorer(docs, labels)(F.col("text")) < THRESHOLD)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest id."""
    dropped = near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti")


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark and their lengths counted anew; texts without secrets stay as they are."""
    found = docs.select(F.struct("*").alias("doc"), finder(docs)(F.col("text")).alias("spans"))
    text, some = redacted(F.col("doc.text"), F.col("spans")), F.size("spans") > 0
    new = {"text": text, "n_chars": F.when(some, F.length(text).cast("long")).otherwise(F.col("doc.n_chars"))}
    return found.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, one row for each piece of a document."""
    return pieces_digest(pack(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one),
    ("secrets", blank_secrets),
    ("packing", packing),
]

#: The model of the first stage and the tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
