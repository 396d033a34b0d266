"""Lines of text files with the split they were read in, so that records which span lines and splits can be put together.

Spark cuts files into splits at line feeds and reads the lines of a split in order. What a line means can depend on all lines
before it (is it inside a quoted field?), so every split is first summed up for each state that it can begin in; the sums of a
file, one row for each split, are combined in order, and then every split is read again with its state known. What lies over the
border of two splits is given as fragments, at most two for each split, which are joined by themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

Split = tuple[str, int]

#: Lines of a batch that are Python objects at once.
LINES = 256


def read_lines(spark: SparkSession, path: str | list[str], end: str = "\n") -> DataFrame:
    """value, file, split (where it begins in the file); lines end at line feeds, or at another character."""
    return spark.read.text(path, lineSep=end).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


@contextmanager
def cut_alike(spark: SparkSession) -> Iterator[None]:
    """Has all jobs inside cut their files into the same splits, also if executors come or go between them.

    Spark sizes the splits of a job by the cores that it has when the job is planned, unless the session names a number.
    """
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is not None:
        yield
        return
    spark.conf.set(key, spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(key)


def by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Split, Iterator[str]]]:
    """The lines of each split in order; a few of a batch at a time become Python objects."""
    parts = (batch.slice(at, LINES) for batch in batches for at in range(0, batch.num_rows, LINES))
    rows = ((file, split, value) for part in parts for value, file, split in zip(*(c.to_pylist() for c in part.columns)))
    for key, part in groupby(rows, lambda r: (r[0], r[1])):
        yield key, (value for _, _, value in part)


def starting_inside(lines: DataFrame, ends: Callable[[str], tuple[bool, bool]]) -> tuple[list[Split], list[str]]:
    """The splits that begin inside a record that a split before them began, and the files that end inside one.

    `ends` gives for a line whether it ends inside if it begins outside, and if it begins inside. The driver sees the splits that
    begin inside, no others.
    """

    def sum_up(batches):
        for (file, split), values in by_split(batches):
            outside, inside = False, True
            for value in values:
                from_outside, from_inside = ends(value)
                outside, inside = (from_inside if outside else from_outside), (from_inside if inside else from_outside)
            yield pa.RecordBatch.from_pydict({"file": [file], "split": pa.array([split], pa.int64()), "outside": [outside], "inside": [inside]})

    sums = lines.mapInArrow(sum_up, "file string, split long, outside boolean, inside boolean")

    def combine(batches):
        for batch in batches:
            for file, parts in zip(*(c.to_pylist() for c in batch.columns)):
                state, found = False, []
                for part in parts:
                    if state:
                        found.append(part["split"])
                    state = part["inside"] if state else part["outside"]
                if state:
                    found.append(-1)
                yield pa.RecordBatch.from_pydict({"file": pa.array([file] * len(found), pa.string()), "split": pa.array(found, pa.int64())})

    per_file = sums.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("split", "outside", "inside"))).alias("parts"))  # the splits of one file
    found = per_file.mapInArrow(combine, "file string, split long").collect()
    return [(r["file"], r["split"]) for r in found if r["split"] >= 0], sorted(r["file"] for r in found if r["split"] < 0)


def joined_fragments(fragments: DataFrame, between: str = "\n") -> DataFrame:
    """Whole records out of fragments (text, file, split, place, first): a tail, whole splits behind it, and a head."""
    order = Window.partitionBy("file").orderBy("split", "place")
    # places in their order within a split: 0 head or whole split, 2 tail
    chained = fragments.withColumn("chain", F.last(F.when(F.col("place") == 2, F.col("split")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = F.array_sort(F.collect_list(F.struct("split", "place", "text")))
    return chained.groupBy("file", "chain").agg(F.array_join(F.transform(parts, lambda p: p["text"]), between).alias("text"), F.max("first").alias("first")).select("text", "file", "first")
