"""Packing: all documents end to end, cut into sequences of one length.

Pass one encodes each document once and writes its ids with their place in the task's own run of tokens. The totals of the
tasks, one number each, become global offsets by a prefix sum. Pass two cuts every document at the multiples of the window,
each by itself: nothing is sorted, shuffled or brought together.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.text import need
from weir.llm.tokens import word_encoder
from weir.session import scratch_path, small_batches

#: The id that ends a document.
END = 1
WINDOW = 2048
#: Rows of one Arrow batch that the second pass gives.
BATCH = 4096

STAGED = "task int, doc_id long, n_tokens long, start_in_task long, ids binary"
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def stage_tokens(df: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int = END) -> DataFrame:
    """Every document's ids with the closing id, as written to the shared folder: task, doc_id, n_tokens, start_in_task, ids (16 bit).

    The files are what later passes read, so a task that runs again cannot change an offset that was given out.
    """

    def encode(batches):
        task, at = TaskContext.get().partitionId(), 0
        encoder, closing = word_encoder(vocabulary), np.array([end], dtype="<u2").tobytes()
        for batch in batches:
            ids = [encoder.encode(t.as_py() or "") + closing for t in batch.column(1)]
            counts = [len(x) // 2 for x in ids]
            starts = [*accumulate(counts, initial=at)]
            at = starts.pop()
            yield pa.RecordBatch.from_arrays(
                [pa.array([task] * len(ids), pa.int32()), batch.column(0), pa.array(counts, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())],
                names=["task", "doc_id", "n_tokens", "start_in_task", "ids"],
            )

    small_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, "tokens")
    source = need(df, id, text).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    source.mapInArrow(encode, STAGED).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(STAGED).parquet(path)


def with_offsets(staged: DataFrame, amount: str, start_in_task: str, name: str) -> tuple[DataFrame, int]:
    """Adds the global offset `name`: the totals of earlier tasks plus the place within the task; also returns the grand total.

    The driver holds one number for each task of the first pass, never one for each row.
    """
    totals = sorted(staged.groupBy("task").agg(F.sum(amount).alias("total")).collect())
    starts = [*accumulate((r["total"] for r in totals), initial=0)]
    # as a table: rows would pass through Python workers of another kind, which executors then keep beside those of the operators
    bases = pa.table({"task": pa.array([r["task"] for r in totals], pa.int32()), "base": pa.array(starts[:-1], pa.int64())})
    bases = staged.sparkSession.createDataFrame(bases)
    return staged.join(F.broadcast(bases), "task").withColumn(name, F.col("base") + F.col(start_in_task)).drop("base"), starts[-1]


def cut(placed: DataFrame, window: int = WINDOW, width: str = "<u4") -> DataFrame:
    """Cuts documents with a global `position` at the multiples of `window`; each piece has its ids as bytes, 32-bit little-endian by default."""

    def pieces(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for doc, total, position, raw in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(raw, dtype="<u2").astype(width)
                first = position - position % window
                for left in range(first, position + total, window):
                    a, b = max(left, position), min(left + window, position + total)
                    for column, value in zip(columns, (doc, a - position, b - a, total, left // window, a - left, ids[a - position : b - position].tobytes())):
                        column.append(value)
            for at in range(0, len(columns[0]), BATCH):
                parts = [pa.array(c[at : at + BATCH], pa.int64()) for c in columns[:6]] + [pa.array(columns[6][at : at + BATCH], pa.binary())]
                yield pa.RecordBatch.from_arrays(parts, names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return placed.select("doc_id", "n_tokens", "position", "ids").mapInArrow(pieces, PIECES)


def pack(df: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    """One row for each piece of a document in a sequence of `window` tokens.

    Columns: doc_id, start (ids of the document before the piece), length, doc_tokens, sequence_id, offset (in the sequence,
    gapless from 0), ids (32-bit little-endian), sequence_tokens (`window`, less in the last) and padded_tokens (what the
    sequence is stored as: `window`, but a last sequence whose length is a power of two stays as it is).

    Every id is in exactly one piece. A null or empty text is its closing id alone. Repeated rows and repeated ids are packed
    as often as they occur. The order is that of the input's files; no input gives no rows. A null id stays null.
    """
    placed, total = with_offsets(stage_tokens(df, id, text, vocabulary, end), "n_tokens", "start_in_task", "position")
    last, rest = divmod(max(total - 1, 0), window)
    rest += 1
    tail = F.col("sequence_id") == last
    return cut(placed, window).withColumns({
        "sequence_tokens": F.when(tail, F.lit(rest)).otherwise(F.lit(window)).cast("long"),
        "padded_tokens": F.when(tail & F.lit(rest & (rest - 1) == 0), F.lit(rest)).otherwise(F.lit(window)).cast("long"),
    })
