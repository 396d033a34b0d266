"""Language-model scores: a hidden Markov model trained by Baum-Welch, beside smoothed counts of words.

The states emit one of a fixed number of word buckets (a hash of the word; the end of a text has its own), and a word comes out of its
bucket by smoothed counts, so the model is a proper distribution over all words, its states stay small and its counts cover the corpus.

Texts are split once. They are kept in chunks of bounded size: each chunk has its distinct words and its texts as numbers of these.
Counts come from the chunks' words, and go back to them by a join on the word; no text is shuffled word by word. In every round
of Baum-Welch each task sends the expected counts of its chunks, which are added up. Scores are exact: the scaled forward recursion runs
over each whole text. Training cuts texts into segments; those after the first start from the states' average occupancy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.text import need, words_of
from weir.session import cut_lineage, scratch_path

STATES = 8
BUCKETS = 4096
ROUNDS = 5
#: What each word's count is raised by.
SMOOTHING = 0.1
#: Texts of so many bytes, or one longer text, make a chunk.
CHUNK_BYTES = 4_000_000
SEGMENT = 256

CHUNKS = (
    "chunk long, doc_ids array<long>, learns array<boolean>, lengths array<int>, numbers binary, words array<string>, word_counts array<long>, buckets binary"
)


def split_chunks(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The texts as chunks, written to the shared folder. `word_counts` are over texts that may be learnt from: crc32 of the id mod 10 not 0."""

    def split(batches):
        task, number, packer = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=3)
        place: dict[bytes, int] = {}
        ids, learns, lengths, parts, size = [], [], [], [], 0

        def chunk():
            flat = np.concatenate([np.empty(0, dtype=np.uint32), *parts])
            owner = np.repeat(np.array(learns, dtype=bool), lengths)
            counts = np.bincount(flat[owner], minlength=len(place))
            words = list(place)
            buckets = np.array([xxhash.xxh64_intdigest(w, seed=42) % BUCKETS for w in words], dtype="<u2")
            return pa.RecordBatch.from_pylist(
                [dict(chunk=(task << 32) + number, doc_ids=ids, learns=learns, lengths=lengths, numbers=packer.compress(flat.tobytes()),
                      words=[w.decode() for w in words], word_counts=counts.tolist(), buckets=buckets.tobytes())],
                schema=schema,
            )

        for batch in batches:
            for doc, learn, value in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(value)
                for word in set(words).difference(place):
                    place[word] = len(place)
                parts.append(np.fromiter(map(place.__getitem__, words), dtype=np.uint32, count=len(words)))
                ids.append(doc)
                learns.append(learn)
                lengths.append(len(words))
                size += len(value or "")
                if size >= CHUNK_BYTES:
                    yield chunk()
                    number += 1
                    place, ids, learns, lengths, parts, size = {}, [], [], [], [], 0
        if ids:
            yield chunk()

    schema = pa.schema([
        ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("learns", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())), ("numbers", pa.binary()),
        ("words", pa.list_(pa.string())), ("word_counts", pa.list_(pa.int64())), ("buckets", pa.binary()),
    ])
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 != 0, F.lit(False))
    texts = need(df, id, text).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), learn.alias("learn"), F.col("text").cast("string"))
    path = scratch_path(df.sparkSession, "chunks")
    texts.mapInArrow(split, CHUNKS).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(CHUNKS).parquet(path)


@dataclass
class Model:
    """start, rest (states of a segment in the middle of a text), move and emit (bucket by state) of the hidden Markov model."""

    start: np.ndarray
    rest: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_model(bucket_counts: np.ndarray, states: int = STATES) -> Model:
    """States that differ a little in what they emit, by a hash of bucket and state, around the counts of the buckets."""
    n = len(bucket_counts)
    tilt = np.array([[xxhash.xxh32_intdigest(f"{b}:{s}") / 2**32 for s in range(states)] for b in range(n)])
    emit = (bucket_counts[:, None] + 0.5) * (0.2 + 1.6 * tilt)
    move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    even = np.full(states, 1 / states)
    return Model(even, even.copy(), move, emit / emit.sum(axis=0))


def _time_major(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences sorted by falling length: how many are still running at each step, and where each step's row block starts."""
    running = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
    starts = np.concatenate(([0], np.cumsum(running)))
    return running, starts[:-1], starts


def forward(model: Model, sequences: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of each sequence of buckets; `starts` says which distribution each begins with (0: start, 1: rest)."""
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    lengths = np.array([len(sequences[n]) for n in order])
    running, at, _ = _time_major(lengths)
    flat = np.empty(int(lengths.sum()), dtype=np.int64)
    for rank, n in enumerate(order):
        flat[at[: lengths[rank]] + rank] = sequences[n]
    log, alpha = np.zeros(len(sequences)), np.stack([model.start, model.rest])[starts[order]]
    for t, count in enumerate(running):
        now = model.emit[flat[at[t] : at[t] + count]]
        alpha = (alpha[:count] if t == 0 else alpha[:count] @ model.move) * now
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        log[:count] += np.log(scale)
    out = np.empty(len(sequences))
    out[order] = log
    return out


def expected(model: Model, sequences: list[np.ndarray], middle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, moves, emissions and state occupancy over sequences, and their log-likelihood: one scaled pass each way."""
    states = len(model.start)
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    lengths = np.array([len(sequences[n]) for n in order])
    running, at, _ = _time_major(lengths)
    flat = np.empty(int(lengths.sum()), dtype=np.int64)
    for rank, n in enumerate(order):
        flat[at[: lengths[rank]] + rank] = sequences[n]
    out, inside, scales = model.emit[flat], np.empty((len(flat), states)), np.empty(len(flat))
    before = np.stack([model.start, model.rest])[middle[order]]
    for t, count in enumerate(running):
        a, b = at[t], at[t] + count
        alpha = (before[:count] if t == 0 else before[:count] @ model.move) * out[a:b]
        scales[a:b] = alpha.sum(axis=1)
        before = inside[a:b] = alpha / scales[a:b, None]
    moves = np.zeros((states, states))
    beta = np.ones((0, states))
    for t in range(len(running) - 1, -1, -1):
        a, b = at[t], at[t] + running[t]
        after = np.ones((running[t], states))
        if len(beta):
            onward = out[b : b + len(beta)] * beta / scales[b : b + len(beta), None]
            moves += inside[a : a + len(beta)].T @ onward
            after[: len(beta)] = onward @ model.move.T
        inside[a:b] *= after  # from here on the posterior
        beta = after
    emitted = np.stack([np.bincount(flat, weights=inside[:, s], minlength=len(model.emit)) for s in range(states)], axis=1)
    first = inside[: running[0]] if len(running) else np.empty((0, states))
    return first[middle[order] == 0].sum(axis=0), moves * model.move, emitted, inside.sum(axis=0), float(np.log(scales).sum())


def _sequences(lengths: list[int], numbers: bytes, buckets: bytes) -> list[np.ndarray]:
    """Each text of a chunk as buckets, with the end."""
    flat = np.frombuffer(buckets, dtype="<u2").astype(np.int64)[np.frombuffer(zstandard.decompress(numbers), dtype=np.uint32)] if numbers else np.empty(0, np.int64)
    cuts = np.cumsum(lengths)
    return [np.append(flat[b - n : b], BUCKETS) for n, b in zip(lengths, cuts)]


def train(chunks: DataFrame, bucket_counts: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all texts that may be learnt from; the driver holds the model only, which does not grow with the data."""
    model = first_model(bucket_counts, states)
    needed = chunks.select("learns", "lengths", "numbers", "buckets")
    size = BUCKETS + 1
    for _ in range(rounds):
        shared = chunks.sparkSession.sparkContext.broadcast(model)

        def count(batches, shared=shared):
            total = np.zeros((size + states + 2, states))
            for batch in batches:
                for row in batch.to_pylist():
                    parts, middle = [], []
                    for learn, sequence in zip(row["learns"], _sequences(row["lengths"], row["numbers"], row["buckets"])):
                        if learn:
                            cut = [sequence[a : a + SEGMENT] for a in range(0, len(sequence), SEGMENT)]
                            parts += cut
                            middle += [0] + [1] * (len(cut) - 1)
                    if parts:
                        start, move, emitted, seen, _ = expected(shared.value, parts, np.array(middle))
                        total += np.vstack([emitted, move, start[None], seen[None]])
            used = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(used * states, states) + np.tile(np.arange(states), len(used)), pa.int64()), pa.array(total[used].ravel(), pa.float64())],
                names=["cell", "amount"],
            )

        total = np.zeros((size + states + 2) * states)
        for cell, amount in needed.mapInArrow(count, "cell long, amount double").groupBy("cell").agg(F.sum("amount")).collect():
            total[cell] = amount
        total = total.reshape(-1, states)
        emit, move, start, seen = total[:size] + 0.01, total[size : size + states] + 0.1, total[-2] + 0.1, total[-1] + 0.1
        model = Model(start / start.sum(), seen / seen.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return model


def language_scores(df: DataFrame, id: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of `df`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Tokens are the words and one end. A null text is an empty one: the end alone. A null id is held out. Repeated rows are learnt from
    as often as they occur and score alike. Without rows to learn from, all words are unknown and every bucket is as likely as any other.
    """
    chunks = split_chunks(df, id, text)
    each = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "word_counts")).alias("number", "w")).select(
        "chunk", "number", F.col("w.words").alias("word"), F.col("w.word_counts").alias("amount")
    )
    counts = cut_lineage(each.where("amount > 0").groupBy("word").agg(F.sum("amount").alias("c")), "words")
    totals = np.zeros((BUCKETS, 2), dtype=np.int64)
    for bucket, total, distinct in counts.groupBy(F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).alias("b")).agg(F.sum("c"), F.count("*")).collect():
        totals[bucket] = total, distinct
    ends = chunks.select(F.sum(F.size(F.filter("learns", lambda x: x))).alias("n")).first()["n"] or 0
    tokens, different = int(totals[:, 0].sum()) + ends, int(totals[:, 1].sum()) + (ends > 0)
    model = train(chunks, np.append(totals[:, 0], ends), states, rounds)
    shared = df.sparkSession.sparkContext.broadcast((model, totals))

    known = (
        each.select("chunk", "number", "word").join(counts, "word")
        .groupBy("chunk").agg(F.collect_list(F.struct("number", "c")).alias("known")).select("chunk", F.col("known.number").alias("at"), F.col("known.c").alias("c"))
    )
    placed = chunks.select("chunk", "doc_ids", "learns", "lengths", "numbers", "buckets").join(known, "chunk", "left").drop("chunk")

    def score(batches):
        model, totals = shared.value
        inside = totals[:, 0] + SMOOTHING * (totals[:, 1] + 1)
        whole = tokens + SMOOTHING * (different + 1)
        end = np.log10((ends + SMOOTHING) / whole)
        for batch in batches:
            for row in (r for n in range(len(batch)) for r in batch.slice(n, 1).to_pylist()):
                buckets = np.frombuffer(row["buckets"], dtype="<u2").astype(np.int64)
                c = np.zeros(len(buckets), dtype=np.int64)
                if row["at"]:
                    c[row["at"]] = row["c"]
                flat = np.frombuffer(zstandard.decompress(row["numbers"]), dtype=np.uint32)
                owner = np.repeat(np.arange(len(row["lengths"])), row["lengths"])

                def per_text(values, flat=flat, owner=owner, many=len(row["lengths"])):
                    return np.bincount(owner, weights=values[flat], minlength=many)

                base = per_text(np.log10((c + SMOOTHING) / whole)) + end
                in_bucket = per_text(np.log10((c + SMOOTHING) / inside[buckets]))
                sequences = _sequences(row["lengths"], row["numbers"], row["buckets"])
                log = forward(model, sequences, np.zeros(len(sequences), dtype=np.int64)) / np.log(10)
                found = per_text((c > 0).astype(float)).astype(np.int64) + (ends > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()), pa.array([not x for x in row["learns"]], pa.bool_()), pa.array(np.array(row["lengths"], dtype=np.int64) + 1),
                        pa.array(found), pa.array([tokens] * len(found), pa.int64()), pa.array(base), pa.array(log + in_bucket),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return placed.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
