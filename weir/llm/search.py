"""Exact top-k search over vectors by inner product, with a uniform threshold over slices of the dimensions.

Every vector is held in slices: a node is one slice of a block of vectors, and knows only the part of a score that its slice makes.

1. Each node sends, for each query, its k + 1 best partial scores. The vectors named are scored exactly; the least score among a query's
   best k + 1 of these is its cutoff: the true answers score no less.
2. The cutoff goes out with the queries. A score that reaches it has, in at least one of m slices, a partial score of at least a
   m-th of it, so each node sends all entries that reach this, and no answer can be missing.
3. Entries are added up, those of a block of queries and a block of vectors in one place. A vector that was sent by all slices has its
   score; one whose missing parts, being below the threshold, cannot lift it to the cutoff is dropped; the missing parts of the rest are
   worked out. Only what reaches the cutoff goes on.

Equal vectors form a class that is searched once, with its k + 1 smallest ids. Blocks of queries meet blocks of vectors, so a task holds two
blocks at a time, whatever the number of either, and nothing that grows with the rows goes through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.llm.text import need
from weir.session import cut_lineage, small_batches

SCALE = 1024
SLICES = 2
#: Vectors of a block, and queries of a block, about.
BLOCK = 4096
QUERIES = 512
#: Sums of products below this are exact as floats of the kind.
EXACT = {np.float32: 2.0**23, np.float64: 2.0**52}


#: Kinds of packed numbers by their bytes.
KINDS = {2: np.int16, 4: np.int32, 8: np.int64}


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """Each component as floor(scale * x), x as double; null for a vector that is null or holds a null or a number that is not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)


def _blocks(vectors: DataFrame, slices: int, width: int, name: str, size: int, *extra: str) -> tuple[DataFrame, int]:
    """Vectors (class_id, q) as blocks of one slice each, in the order of their ids: block, slice, ids, the slice's components end to end.

    Numbers are packed, components in as few bytes as the block needs. Also gives the number of blocks.
    """
    many = max(1, -(-vectors.count() // size))
    step = -(-width // slices)
    block = vectors.select(F.pmod(F.xxhash64("class_id"), F.lit(many)).alias("block"), "class_id", F.col("q").cast("array<long>").alias("q"), *extra)
    packed = block.groupBy("block").agg(F.collect_list(F.struct("class_id", "q", *extra)).alias("rows"))
    packed = packed.select("block", "rows.class_id", F.flatten("rows.q").alias("q"), *[F.col(f"rows.{e}").alias(e) for e in extra])
    names = [f"{name}_{n}" for n in ("block", "ids", "bytes", "parts", *extra)]

    def pack(batches):
        for batch in batches:
            for n in range(len(batch)):
                ids = batch.column("class_id")[n].values.to_numpy()
                order = np.argsort(ids)
                full = batch.column("q")[n].values.to_numpy().reshape(len(ids), width)[order]
                kind = _kind(full, *KINDS.values())
                more = [batch.column(e)[n].values.to_numpy()[order].tobytes() for e in extra]
                for part in range(slices):
                    cut = full[:, part * step : (part + 1) * step].astype(kind).tobytes()
                    row = [batch.column("block")[n].as_py(), ids[order].tobytes(), np.dtype(kind).itemsize, cut, *more]
                    yield pa.RecordBatch.from_pydict({"slice": pa.array([part], pa.int32()), **{m: [x] for m, x in zip(names, row)}})

    kinds = ("long", "binary", "long", "binary", *["binary"] * len(extra))
    return cut_lineage(packed.mapInArrow(pack, f"slice int, {', '.join(f'{n} {t}' for n, t in zip(names, kinds))}"), "blocks"), many


def _joined(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """A join that is sorted and merged: a small file may hold many vectors, so its size must not have it sent through the driver."""
    return left.join(right.hint("merge"), on)


def _spread(queries: DataFrame, vector_blocks: int) -> DataFrame:
    """A copy of every block of queries for each block of vectors."""
    return queries.withColumn("v_block", F.explode(F.sequence(F.lit(0), F.lit(vector_blocks - 1)).cast("array<long>")))


def _meet(queries: DataFrame, vectors: DataFrame, vector_blocks: int) -> DataFrame:
    """Every block of queries beside every block of vectors of the same slice; blocks of vectors are sent once, the smaller blocks of queries to each."""
    return _joined(_spread(queries, vector_blocks), vectors, ["v_block", "slice"])


def _numbers(packed: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(packed, dtype=kind)


def _side(row: dict, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and components of a block of one slice."""
    ids = _numbers(row[f"{name}_ids"])
    parts = _numbers(row[f"{name}_parts"], KINDS[row[f"{name}_bytes"]])
    return ids, parts.reshape(len(ids), len(parts) // len(ids))


def _partial(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Partial scores of a block of queries against a block of vectors: exact whole numbers, as floats where they suffice.

    No sum of products, nor a part of one, is larger than the lengths of the two vectors multiplied.
    """
    if not q.size or not v.size:
        return np.zeros((len(q), len(v)), dtype=np.int64)
    bound = float(np.prod([np.sqrt(np.square(x.astype(float)).sum(axis=1).max()) for x in (q, v)]))
    kind = next((t for t, most in EXACT.items() if bound < most), np.int64)
    return q.astype(kind) @ v.astype(kind).T


def _rows(batches):
    """One row at a time as a dictionary."""
    for batch in batches:
        for n in range(len(batch)):
            yield batch.slice(n, 1).to_pylist()[0]


def _best(met: DataFrame, k: int) -> DataFrame:
    """Each node's k best partial scores of each query."""

    def best(batches):
        for row in _rows(batches):
            (q_ids, q), (v_ids, v) = _side(row, "q"), _side(row, "v")
            scores = _partial(q, v)
            keep = min(k, scores.shape[1])
            columns = np.argpartition(scores, scores.shape[1] - keep, axis=1)[:, -keep:].ravel()
            lines = np.repeat(np.arange(len(q_ids)), keep)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q_ids[lines]), pa.array(v_ids[columns]), pa.array(np.full(len(lines), row["slice"], dtype=np.int32)), pa.array(scores[lines, columns].astype(np.int64))],
                names=["query_class", "class_id", "slice", "part"],
            )

    return met.mapInArrow(best, "query_class long, class_id long, slice int, part long")


def _kind(values: np.ndarray, *kinds: type) -> type:
    """The first kind that holds all values."""
    return next(t for t in kinds if not values.size or (values.min() >= np.iinfo(t).min and values.max() <= np.iinfo(t).max))


def _reaching(met: DataFrame, slices: int) -> DataFrame:
    """Each node's entries that reach the m-th part of the query's cutoff, packed: places in the table of the two blocks, and partial scores.

    The slice of the queries comes along, also without entries, as another slice's entries may lack its parts.
    """

    def reach(batches):
        for row in _rows(batches):
            (_, q), (_, v) = _side(row, "q"), _side(row, "v")
            scores = _partial(q, v)
            least = -(-_numbers(row["q_cutoff"]) // slices).astype(scores.dtype)  # what this rounds is beyond all scores
            at = np.flatnonzero(scores >= least[:, None])
            part = scores.ravel()[at]
            kind = _kind(part, np.int32, np.int64)
            sent = {"at": at.astype(np.int32).tobytes(), "part_bytes": np.dtype(kind).itemsize, "part": part.astype(kind).tobytes()}
            once = {n: row[n] if row["slice"] == 0 else b"" for n in ("q_ids", "q_cutoff")}
            same = {n: row[n] for n in ("q_block", "v_block", "slice", "q_bytes", "q_parts")}
            yield pa.RecordBatch.from_pylist([same | sent | once], schema=schema)

    fields = [(n, pa.int64()) for n in ("q_block", "v_block", "slice", "q_bytes")] + [("q_parts", pa.binary()), ("at", pa.binary()), ("part_bytes", pa.int64())]
    schema = pa.schema([*fields, *[(n, pa.binary()) for n in ("part", "q_ids", "q_cutoff")]])
    ddl = "q_block long, v_block long, slice long, q_bytes long, q_parts binary, at binary, part_bytes long, part binary, q_ids binary, q_cutoff binary"
    return met.mapInArrow(reach, ddl)


#: Pairs whose missing parts are worked out at once.
PAIRS = 1 << 14


def _resolved(sent: DataFrame, vectors: DataFrame, slices: int, k: int) -> DataFrame:
    """The entries of all slices added up within their two blocks, missing parts worked out where the cutoff can still be reached; each query's k best."""
    gathered = F.sort_array(F.collect_list(F.struct("slice", *[c for c in sent.columns if c not in ("q_block", "v_block", "slice")])))
    # dealt by the block of vectors alone, so that entries move once
    entries = sent.repartition("v_block").groupBy("v_block", "q_block").agg(gathered.alias("sent"))
    v = vectors.groupBy("v_block").agg(F.first("v_ids").alias("v_ids"), F.sort_array(F.collect_list(F.struct("slice", "v_bytes", "v_parts"))).alias("v_slices"))
    met = _joined(entries, v, "v_block")

    def resolve(batches):
        for row in _rows(batches):
            sent, v_ids = row["sent"], _numbers(row["v_ids"])
            q_ids, cutoff = _numbers(sent[0]["q_ids"]), _numbers(sent[0]["q_cutoff"])
            lists = [_numbers(e["at"], np.int32) for e in sent]
            at = np.unique(np.concatenate(lists))
            seen, has = np.zeros(len(at), dtype=np.int64), np.zeros((slices, len(at)), dtype=bool)
            for own, places, e in zip(has, lists, sent):
                found = np.searchsorted(at, places)
                seen[found] += _numbers(e["part"], KINDS[e["part_bytes"]])
                own[found] = True
            parts = has.sum(axis=0)
            line, column = np.divmod(at, len(v_ids))
            least = cutoff[line]
            # a missing part times the number of slices is below the cutoff
            possible = (parts == slices) | (seen * slices + (slices - parts) * (least - 1) >= least * slices)
            for own, q_slice, v_slice in zip(has, sent, row["v_slices"]):
                lacking = np.flatnonzero(possible & ~own)
                if len(lacking):
                    (_, qs), (_, vs) = _side(q_slice | {"q_ids": sent[0]["q_ids"]}, "q"), _side(v_slice | {"v_ids": row["v_ids"]}, "v")
                    for start in range(0, len(lacking), PAIRS):
                        some = lacking[start : start + PAIRS]
                        seen[some] += np.einsum("ij,ij->i", qs[line[some]].astype(np.int64), vs[column[some]].astype(np.int64))
            good = np.flatnonzero(possible & (seen >= least))
            order = good[np.lexsort((column[good], -seen[good], line[good]))]
            first = np.searchsorted(line[order], line[order])  # where the query's own begin
            order = order[np.arange(len(order)) - first < k]
            if len(order):
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[line[order]]), pa.array(v_ids[column[order]]), pa.array(seen[order])], names=["query_class", "class_id", "score"])

    return met.mapInArrow(resolve, "query_class long, class_id long, score long")


def _score(pairs: DataFrame, queries: DataFrame, classes: DataFrame) -> DataFrame:
    """Exact scores of pairs of classes."""
    v = classes.select("class_id", F.col("q").alias("v"))
    q = queries.select(F.col("class_id").alias("query_class"), "q")
    return _joined(_joined(pairs, v, "class_id"), q, "query_class").select("query_class", "class_id", _inner(F.col("q"), F.col("v")).alias("score"))


def _top(scored: DataFrame, k: int) -> DataFrame:
    """Each query's k best classes by score, then by smaller id; ranked before the shuffle as well as after it."""
    ranked = scored.selectExpr("*", "row_number() over (partition by query_class order by score desc, class_id) as place")
    return ranked.where(F.col("place") <= k)


def top_k(
    df: DataFrame, queries: Column, k: int = 10, id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, slices: int = SLICES
) -> DataFrame:
    """The k highest inner products of each query row with all other rows: query_id, rank (from 1), vec_id, score.

    `queries` is a condition on the column `id`. Components become floor(scale * x); scores must fit 64 bits. Ties go to the smaller id.
    A query has fewer rows if there are fewer others, and none if it is alone. Vectors that are null, or hold a null or a number that
    is not finite, take no part, nor do rows with a null id. Vectors of different lengths count as filled up with zeros.
    Repeated rows of an id with the same vector are one; if their vectors differ, each is a candidate and the id is named for each.
    """
    small_batches(df.sparkSession)
    rows = need(df, id, vector).toDF("vec_id", "vector")
    rows = rows.select(F.col("vec_id").cast("long"), whole_numbers(F.col("vector"), scale).alias("q")).where("vec_id is not null and q is not null")
    width = rows.agg(F.max(F.size("q"))).first()[0] or 0
    filled = F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(width) - F.size("q"), F.lit(0))))
    rows = rows.select("vec_id", filled.alias("q")).distinct() if width else rows.limit(0)
    # the k + 1 smallest ids of each class; the window limits groups within each task before it shuffles
    ranked = rows.selectExpr("*", "row_number() over (partition by q order by vec_id) as place").where(F.col("place") <= k + 1)
    classes = cut_lineage(ranked.groupBy("q").agg(F.min("vec_id").alias("class_id"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "classes")
    asked = _joined(rows.where(queries), classes.select("q", "class_id"), "q").select(F.col("vec_id").alias("query_id"), "class_id", "q")
    asked = cut_lineage(asked, "asked")
    wanted = cut_lineage(asked.select("class_id", "q").dropDuplicates(["class_id"]), "queries")

    vector_side, vector_blocks = _blocks(classes.select("class_id", "q"), slices, width, "v", BLOCK)
    query_side, _ = _blocks(wanted, slices, width, "q", QUERIES)
    near = _best(_meet(query_side, vector_side, vector_blocks), k + 1)
    order = "row_number() over (partition by query_class, slice order by part desc, class_id) as place"
    listed = near.selectExpr("*", order).where(F.col("place") <= k + 1).select("query_class", "class_id").distinct()
    first = _top(_score(listed, wanted, classes), k + 1)
    cutoffs = first.groupBy("query_class").agg(F.min("score").alias("cutoff"))
    with_cutoff = cut_lineage(_joined(wanted, cutoffs.withColumnRenamed("query_class", "class_id"), "class_id"), "cutoffs")

    query_side, _ = _blocks(with_cutoff, slices, width, "q", QUERIES, "cutoff")
    sent = _reaching(_meet(query_side, vector_side, vector_blocks), slices)
    best = _top(_resolved(sent, vector_side, slices, k + 1), k + 1)

    # k + 1 classes, each with its k + 1 smallest ids, hold the k + 1 best rows of a query class; its own row is one of them at most
    named = _joined(best, classes.select("class_id", "ids"), "class_id").select("query_class", "score", F.explode("ids").alias("vec_id"))
    heads = (
        named.selectExpr("*", "row_number() over (partition by query_class order by score desc, vec_id) as place").where(F.col("place") <= k + 1)
        .groupBy("query_class").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id"))).alias("list"))
    )
    others = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    found = _joined(asked.select("query_id", F.col("class_id").alias("query_class")), heads, "query_class").select("query_id", F.posexplode(others).alias("at", "x"))
    return found.select("query_id", (F.col("at") + 1).cast(T.IntegerType()).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.down")).alias("score"))
