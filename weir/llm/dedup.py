"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidates, exact confirmation.

Each document's set of word shingles is hashed once; one permutation cut into bins gives all the minima of its signature, and
empty bins borrow from bins chosen by a hash that is the same for all documents (optimal densification), so two documents agree
in a bin with a probability equal to their similarity. Bands of the signature are buckets.

Documents with equal sets form a class, and one of each class goes on. In each bucket one member is the hub and is compared with
the others; nothing else is, so a bucket of n members gives n - 1 pairs. The hub is the member that meets most others over all its
buckets, which is the original of a group of copies where it is there. Pairs are confirmed on full sets. A star can miss a link
between two members that are not linked with the hub, so further rounds look at the buckets whose members are still in several
components, take a hub out of the smallest of these, and compare it with the members of the others, until a round finds nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.components import components
from weir.llm.text import WordHashes, mixed, need, words_of
from weir.session import cut_lineage, small_batches

SHINGLE_WORDS = 5
THRESHOLD_PERCENT = 75
BANDS, ROWS_PER_BAND = 32, 4
#: Attempts of the densification before an empty bin takes the next filled one to its right.
ATTEMPTS = 512
#: Counters that tell rare shingles from common ones; shingles may share one, since any order of the shingles that is the same for all sets is exact.
COUNTERS = 1 << 18

_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingles(words: list[bytes], hashes: WordHashes, size: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the runs of `size` words; of fewer words, one hash of them all; of none, nothing."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = mixed(hashes.of(words))
    size = min(size, len(words))
    places = mixed(np.arange(1, size + 1, dtype=np.uint64) * _PLACES[0]) | np.uint64(1)
    runs = len(words) - size + 1
    total = np.full(runs, size, dtype=np.uint64)
    for k in range(size):
        total += h[k : k + runs] * places[k]
    return np.unique(mixed(total))


class Signatures:
    """Band keys of sets of 64-bit hashes."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS_PER_BAND):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        places = np.arange(self.bins * ATTEMPTS, dtype=np.uint64).reshape(self.bins, ATTEMPTS) + np.uint64(1)
        self.tries = (mixed(places * _PLACES[1]) % np.uint64(self.bins)).astype(np.int64)

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        """The least hash of every bin; `hashes` is sorted and not empty."""
        bins = ((hashes >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        where = np.full(self.bins, -1)
        where[bins[first]] = first
        empty = np.flatnonzero(where < 0)
        if len(empty):
            filled = where >= 0
            hit = filled[self.tries[empty]]
            pick = self.tries[empty, hit.argmax(axis=1)]
            none = ~hit.any(axis=1)
            if none.any():
                full = bins[first]
                pick[none] = full[np.searchsorted(full, empty[none]) % len(full)]
            where[empty] = where[pick]
        return hashes[where]

    def keys(self, hashes: np.ndarray) -> list[int]:
        parts = self.minima(hashes).reshape(self.bands, self.rows)
        return [xxhash.xxh64_intdigest(part.tobytes(), seed=band) - (1 << 63) for band, part in enumerate(parts)]


def signatures(df: DataFrame, id: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS_PER_BAND, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits over the whole set; null for an empty set) and the band keys of every document."""

    def sign(batches):
        hashes, signer = WordHashes(), Signatures(bands, rows)
        for batch in batches:
            sets = [shingles(words_of(t.as_py()), hashes, size) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets], pa.string()),
                    pa.array([signer.keys(s) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_key", "bands"],
            )

    return _texts(df, id, text).mapInArrow(sign, "doc_id long, n_shingles long, set_key string, bands array<long>")


def _texts(df: DataFrame, id: str, text: str) -> DataFrame:
    return need(df, id, text).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """doc_id and its whole set as bytes of sorted 64-bit hashes."""

    def make(batches):
        hashes = WordHashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([shingles(words_of(t.as_py()), hashes, size).tobytes() for t in batch.column(1)], pa.binary())], names=["doc_id", "hashes"]
            )

    return texts.mapInArrow(make, "doc_id long, hashes binary")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets overlap enough, compared whole."""

    def check(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(a.as_buffer(), dtype=np.uint64), np.frombuffer(b.as_buffer(), dtype=np.uint64)
                both = np.concatenate((a, b))
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("doc_id").alias(x), F.col("hashes").alias(f"{x}_hashes")) for x in "uv")
    joined = pairs.select("u", "v").join(right, "v").join(left, "u").select("u", "v", "u_hashes", "v_hashes")
    return joined.mapInArrow(check, "u long, v long")


def near_duplicates(
    df: DataFrame, id: str = "doc_id", text: str = "text", percent: int = THRESHOLD_PERCENT, bands: int = BANDS, rows: int = ROWS_PER_BAND, size: int = SHINGLE_WORDS
) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (the smallest id reachable over links), kept, n_links.

    Two documents are linked if 100 * |both| >= percent * |either| for their sets of shingles. `n_links` counts the confirmed
    links to other classes of equal sets that were needed to connect the document's class. Documents without words, null texts
    included, have an empty set and stand alone. Repeated rows of one id fall together; they are kept or dropped as one. A null
    id takes no part in linking and is kept. Empty input gives no rows.

    Links are found with a probability above 1 - (1 - (percent/100)**rows)**bands (0.999995 at the threshold itself with the
    defaults): two linked documents that share a band end in one component; none is confirmed by estimate.
    """
    small_batches(df.sparkSession)
    texts = _texts(df, id, text)
    signed = cut_lineage(signatures(texts, "doc_id", "text", bands, rows, size), "signatures")
    classes = cut_lineage(signed.where("doc_id is not null and n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("class_id")), "classes")
    ids = classes.select(F.col("class_id").alias("doc_id"))
    members = (
        signed.where("n_shingles > 0").join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        .select(F.col("doc_id").alias("class_id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    )
    sizes = members.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    met = cut_lineage(members.join(sizes, "key"), "buckets")
    weights = met.groupBy("class_id").agg(F.sum("many").alias("weight"))
    shared = cut_lineage(met.join(weights, "class_id").drop("many"), "buckets")
    hubs = shared.groupBy("key").agg(F.min(F.struct((-F.col("weight")).alias("down"), "class_id", "n")).alias("hub"))

    fits = (F.least("n", "hub.n") * 100 >= F.greatest("n", "hub.n") * percent) & (F.col("class_id") != F.col("hub.class_id"))
    ends = [F.col("hub.class_id"), F.col("class_id")]
    tried = cut_lineage(shared.join(hubs, "key").where(fits).select(F.least(*ends).alias("u"), F.greatest(*ends).alias("v")).distinct(), "pairs")
    wanted = shared.select(F.col("class_id").alias("doc_id")).distinct()
    # the same plan at every size: the ids grow with the data, and the texts are dealt by them
    picked = texts.where("doc_id is not null").join(wanted.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = cut_lineage(_sets(picked, size), "sets")
    links = cut_lineage(_confirm(tried, sets, percent), "confirmed")
    joined = components(links)

    tried, links, joined = _stars(shared, tried, links, joined, sets, percent, 2)
    apart = cut_lineage(_open(_labelled(shared, joined)).select("class_id", "n").distinct(), "open")
    if not apart.isEmpty():
        rarest = _rarest(apart, sets, percent)
        rarest = cut_lineage(rarest.join(_open(_labelled(rarest, joined)).select("key").distinct(), "key", "left_semi"), "rarest")
        tried, links, joined = _stars(rarest, tried, links, joined, sets, percent, 1)
        pairs = cut_lineage(_all_pairs(rarest, joined, percent).join(tried, ["u", "v"], "left_anti"), "pairs")
        found = cut_lineage(_confirm(pairs, sets, percent), "confirmed")
        links, joined = links.unionAll(found), _merged(joined, found)

    degree = links.select(F.explode(F.array("u", "v")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    placed = (
        classes.join(joined.withColumnRenamed("node", "class_id"), "class_id", "left").join(degree, "class_id", "left")
        .select("set_key", F.coalesce("component", "class_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    result = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(placed, "set_key", "left")
    return result.select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def _merged(joined: DataFrame, found: DataFrame) -> DataFrame:
    """The components after new links."""
    return components(joined.select(F.col("node").alias("u"), F.col("component").alias("v")).unionAll(found))


def _stars(
    groups: DataFrame, tried: DataFrame, links: DataFrame, joined: DataFrame, sets: DataFrame, percent: int, patience: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rounds of stars over groups of sets until so many in a row find nothing: tried pairs, links and components after them."""
    turn = idle = 0
    while idle < patience:
        pairs = cut_lineage(_missed(groups, joined, percent, turn).join(tried, ["u", "v"], "left_anti"), "pairs")
        turn, idle = turn + 1, idle + 1
        if pairs.isEmpty():
            continue
        found = cut_lineage(_confirm(pairs, sets, percent), "confirmed")
        tried = tried.unionAll(pairs)
        if not found.isEmpty():
            links, joined, idle = links.unionAll(found), _merged(joined, found), 0
    return tried, links, joined


def _labelled(groups: DataFrame, joined: DataFrame) -> DataFrame:
    return groups.join(joined.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "key", "class_id", "n", F.coalesce("component", "class_id").alias("component")
    )


def _open(labelled: DataFrame) -> DataFrame:
    """The rows of the groups that hold several components."""
    several = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return labelled.join(several.select("key"), "key", "left_semi")


def _missed(groups: DataFrame, joined: DataFrame, percent: int, turn: int) -> DataFrame:
    """Star-shaped pairs of groups whose members lie in several components: one of the largest (odd turns: the smallest) against the others."""
    labelled = _labelled(groups, joined)
    order = F.xxhash64("class_id", "key", F.lit(turn))
    parts = labelled.groupBy("key", "component").agg((F.count("*") * F.lit(1 if turn % 2 else -1)).alias("many"), F.min(F.struct(order.alias("o"), "class_id", "n")).alias("hub"))
    hubs = (
        parts.groupBy("key").agg(F.count("*").alias("parts"), F.min(F.struct("many", "hub.o", "hub.class_id", "hub.n", "component")).alias("hub"))
        .where("parts > 1").select("key", "hub")
    )
    fits = (F.least("n", "hub.n") * 100 >= F.greatest("n", "hub.n") * percent) & (F.col("component") != F.col("hub.component"))
    ends = [F.col("hub.class_id"), F.col("class_id")]
    return labelled.join(hubs, "key").where(fits).select(F.least(*ends).alias("u"), F.greatest(*ends).alias("v")).distinct()


def _rarest(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rarest shingles (key) of each set and their places (at), so many that two linked sets share one: class_id, n, key, at.

    A linked set has at least `percent` of the shingles in common with the other, so in any order of all shingles one of the
    common ones is among its first n - ceil(n * percent / 100) + 1. Rare ones come first, so passages of many texts seldom count.
    """
    chosen = cut_lineage(apart.join(sets.withColumnRenamed("doc_id", "class_id"), "class_id"), "sets")
    mask = np.uint64(COUNTERS - 1)

    def count(batches):
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for part in batch.column(0):
                np.add.at(total, (np.frombuffer(part.as_buffer(), dtype=np.uint64) & mask).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["counter", "many"])

    counted = chosen.select("hashes").mapInArrow(count, "counter long, many long").groupBy("counter").agg(F.sum("many").alias("many")).toArrow()
    total = np.zeros(COUNTERS, dtype=np.int64)  # bounded, whatever the input
    total[counted.column("counter").to_numpy()] = counted.column("many").to_numpy()
    known = apart.sparkSession.sparkContext.broadcast(total)

    def cut(batches):
        common = known.value
        for batch in batches:
            parts = [np.empty(0, dtype=np.uint64)]
            for part in batch.column(2):
                h = np.frombuffer(part.as_buffer(), dtype=np.uint64)
                first = np.argsort(common[(h & mask).astype(np.int64)], kind="stable")  # equally common ones stay in the order of their hashes
                parts.append(h[first[: len(h) + percent * len(h) // -100 + 1]])
            lengths = [len(p) for p in parts[1:]]
            owner = [pa.array(np.repeat(batch.column(k).to_numpy(), lengths), pa.int64()) for k in (0, 1)]
            places = pa.array(np.concatenate([np.empty(0, dtype=np.int64), *map(np.arange, lengths)]), pa.int64())
            yield pa.RecordBatch.from_arrays([*owner, pa.array(np.concatenate(parts).view(np.int64), pa.int64()), places], names=["class_id", "n", "key", "at"])

    return cut_lineage(chosen.select("class_id", "n", "hashes").mapInArrow(cut, "class_id long, n long, key long, at long"), "rarest")


def _all_pairs(rarest: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """All pairs of sets of different components that share one of their rarest shingles, where it and all later ones could be enough for a link.

    The first shingle that two sets share has all the others that they share behind it in both, so no linked pair is lost.
    """
    labelled = rarest.join(joined.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    left, right = (labelled.select("key", F.col("class_id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "component", "at")]) for x in "uv")
    enough = F.least(F.col("u_n") - F.col("u_at"), F.col("v_n") - F.col("v_at")) * (100 + percent) >= (F.col("u_n") + F.col("v_n")) * percent
    return left.join(right, "key").where(enough & (F.col("u_component") != F.col("v_component")) & (F.col("u") < F.col("v"))).select("u", "v").distinct()
