"""Toxicity: a support vector machine on a gap-weighted subsequence kernel, with Nyström landmarks.

Two words are as alike as the three-letter subsequences they share, each weighted down by the gaps it spans, so letters put into
an insult, or spread over it, change little. The kernel is normalised. Landmarks are words that mark toxic documents in the labelled
sample and ordinary words; kernel values against them, whitened, are the features of a linear machine.

Only documents are labelled, not words. A toxic document has at least one toxic word, its witness: the machine is fitted to the
witnesses and to the words of clean documents, witnesses are chosen anew by its scores, and words of clean documents that score
high become landmarks too. A document's score is a logistic function of its worst few words, fitted on labelled documents that the
machine has not seen.

Kernel values are sums over subsequences, so the weights of all landmarks add up to one table of letter triples (`Model.triples`),
and scoring a word is a sum over its triples divided by its norm; this equals the sum over landmarks.
"""

from __future__ import annotations

import heapq
import itertools
import re
import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.llm.text import HASHED_WORDS, need
from weir.session import small_batches

#: Labelled documents of each class that the machine is fitted on, at most: those with the least hashes of their ids.
SAMPLE = 1_500
LANDMARKS = 160
#: A document is judged by so many of its worst distinct words.
WORST = 3
#: Scores below this say nothing more, and a document with fewer words is filled up with it.
FLOOR = -0.5
DECAY = 0.85
#: Longer words are scored in overlapping windows of so many characters.
WINDOW = 24
#: a to z, the start of a word, ß to ÿ, codes that the letters of all other scripts share by their code points, and 0 for any other sign.
ALPHABET = 96
ROUNDS = 4
#: A word that is in so many toxic documents, and in so many times the share of clean ones, is a witness wherever it stands.
LEAST_SUPPORT, LEAST_RATIO = 4, 8
#: What a clean document's word counts for beside a toxic one's witness, so that words which stand in both are called clean.
CLEAN_WEIGHT = 16
#: Words of clean documents that the machine sees: the commonest, and a quarter as many of those that it scores highest.
NEGATIVES = 12_000
THRESHOLD = 0.3
#: Cells of the letter tables (a word's letters against themselves) that a worker fills at once; there are about six tables of 4 bytes a cell.
CELLS = 1 << 18
#: Bytes of text that a worker splits at once.
CHUNK = 1_000_000

#: Digits and signs that stand for letters (fixed values).
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Signs at the ends of words that say nothing.
MARKS = ".,;:!?%&*#|()\"'-"
SPACED = re.compile(r"(?<!\S)\S(?:\s+\S(?!\S)){2,}")
_START, _OTHER = 27, 61
_CODES = np.where(np.fromiter((chr(n).isalpha() for n in range(0x110000)), dtype=bool, count=0x110000), _OTHER + np.arange(0x110000) % (ALPHABET - _OTHER), 0).astype(np.uint8)
_CODES[97:123] = np.arange(1, 27)
_CODES[0xDF:0x100] = np.arange(28, _OTHER)
_ALIKE = _CODES.copy()
for _sign, _letter in LOOKALIKES.items():
    _ALIKE[ord(_sign)] = _CODES[ord(_letter)]


def tokens(text: str | None) -> set[str]:
    """The distinct words in lower case, and words spelt letter by letter with spaces between."""
    lower = (text or "").lower()
    found = {word.strip(MARKS) for word in set(lower.split())}
    found.update("".join(run.split()) for run in SPACED.findall(lower))
    return found


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter numbers of the windows of all words (0: no letter), one row each, and each row's word.

    Digits and signs count as the letters they look like in words that have a letter. Words of fewer than three letters have no row; two are enough in scripts other than Latin.
    """
    if not words:
        return np.zeros((0, WINDOW), dtype=np.uint8), np.empty(0, dtype=np.int64)
    points = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(sizes)
    spelt = np.logical_or.reduceat(_CODES[points] > 0, ends - sizes)
    flat = np.where(np.repeat(spelt, sizes), _ALIKE[points], 0)
    letters = np.flatnonzero(flat)
    of = np.searchsorted(ends, letters, side="right")
    word, at, many = np.unique(of, return_index=True, return_counts=True)
    first, last = letters[at], letters[at + many - 1]
    if not len(letters):
        return np.zeros((0, WINDOW), dtype=np.uint8), np.empty(0, dtype=np.int64)
    enough = (many >= 3) | ((many == 2) & (flat[letters[at]] >= _OTHER))
    word, first, length = word[enough], first[enough], (last - first + 2)[enough]  # with the sign of the start
    windows = np.maximum(1, -(-(length - WINDOW // 2) // (WINDOW // 2)))
    owner = np.repeat(word, windows)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    offset = turn[:, None] * (WINDOW // 2) + np.arange(WINDOW)[None, :]
    inside = offset < np.repeat(length, windows)[:, None]
    source = np.where(inside & (offset > 0), np.repeat(first, windows)[:, None] + offset - 1, 0)
    out = np.where(inside, np.where(offset > 0, flat[source], _START), 0).astype(np.uint8)
    return out, owner


def by_length(codes: np.ndarray):
    """Row numbers and codes cut to few lengths, so that short words cost little."""
    lengths = (WINDOW - (codes[:, ::-1] != 0).argmax(axis=1)) * codes.any(axis=1)
    low = 0
    for high in (5, 7, 9, 12, 16, WINDOW):
        rows = np.flatnonzero((lengths > low) & (lengths <= high))
        low = high
        for part in np.array_split(rows, max(1, -(-len(rows) // 8192))):
            if len(part):
                yield part, codes[part, :high]


def norms(codes: np.ndarray) -> np.ndarray:
    """The square root of each row's kernel with itself, by the kernel's recursion over prefixes."""
    out = np.ones(len(codes), dtype=np.float32)
    parts = ((rows[at : at + step], c[at : at + step]) for rows, c in by_length(codes) for step in [CELLS // c.shape[1] ** 2] for at in range(0, len(rows), step))
    for rows, c in parts:
        size = c.shape[1]
        same = ((c[:, :, None] == c[:, None, :]) & (c[:, :, None] > 0)).astype(np.float32)
        steps = np.arange(size)
        decay = np.where(steps[:, None] >= steps[None, :], np.float32(DECAY) ** np.maximum(steps[:, None] - steps[None, :], 0), 0).astype(np.float32)
        inner = np.ones_like(same)
        for _ in range(2):
            grown = decay @ (np.float32(DECAY**2) * same * inner) @ decay.T
            inner = np.zeros_like(same)
            inner[:, 1:, 1:] = grown[:, :-1, :-1]
        value = (np.float32(DECAY**2) * same * inner).sum(axis=(1, 2))
        out[rows] = np.sqrt(np.maximum(value, 1e-12))
    return out


class Triples:
    """Rows of numbers for triples of letters; the triples that have none share the first row, which is zero."""

    def __init__(self, used: np.ndarray, rows: np.ndarray):
        self.index = np.zeros(ALPHABET**3, dtype=np.int32)
        self.index[used] = np.arange(1, len(used) + 1)
        self.rows = np.vstack([np.zeros((1, rows.shape[1])), rows]).astype(np.float32)

    def times(self, vector: np.ndarray) -> Triples:
        """The table with one column that the rows make with weights of their columns."""
        return Triples(np.flatnonzero(self.index), (self.rows[self.index[self.index > 0]] @ vector)[:, None])

    def sums(self, codes: np.ndarray) -> np.ndarray:
        """For each coded word the sum over its triples of letters, weighted by the letters and gaps that each spans."""
        out = np.zeros((len(codes), self.rows.shape[1]), dtype=np.float32)
        single = self.rows[self.index, 0] if self.rows.shape[1] == 1 else None
        for rows, c in by_length(codes):
            third = np.ascontiguousarray(c.T).astype(np.int32)
            second, first = third * ALPHABET, third * ALPHABET**2
            total = np.zeros((len(c), self.rows.shape[1]), dtype=np.float32)
            for i, j in itertools.combinations(range(len(third)), 2):
                pair = first[i] + second[j]
                for k in range(j + 1, len(third)):
                    at = pair + third[k]
                    if single is None:
                        total += np.float32(DECAY ** (k - i + 1)) * self.rows[self.index[at]]
                    else:
                        total[:, 0] += np.float32(DECAY ** (k - i + 1)) * single[at]
            out[rows] = total
        return out


def triples_of(codes: np.ndarray, length: np.ndarray) -> Triples:
    """A column for each coded word with its triples' weights over its norm; triples with a sign that is no letter have none."""
    found: dict[int, dict[int, float]] = {}
    for n, c in enumerate(codes.astype(np.int64)):
        for i, j, k in itertools.combinations(np.flatnonzero(c), 3):
            row = found.setdefault(int((c[i] * ALPHABET + c[j]) * ALPHABET + c[k]), {})
            row[n] = row.get(n, 0.0) + DECAY ** (k - i + 1)
    used = np.array(sorted(found), dtype=np.int64)
    rows = np.zeros((len(used), len(codes)), dtype=np.float32)
    for at, triple in enumerate(used.tolist()):
        rows[at, list(found[triple])] = list(found[triple].values())
    return Triples(used, rows / length)


@dataclass
class Model:
    """triples and bias score a word; slope and offset turn a document's worst words into a probability; floor is the score of no word."""

    triples: Triples
    bias: float
    slope: np.ndarray
    offset: float
    floor: float

    def words(self, words: list[str]) -> np.ndarray:
        codes, owner = coded(words)
        best = np.full(len(words), self.floor, dtype=np.float32)
        if len(owner):
            np.maximum.at(best, owner, self.triples.sums(codes)[:, 0] / norms(codes) + np.float32(self.bias))
        return best

    def worst(self, scores: Iterable[float]) -> list[float]:
        """The greatest few of a document's word scores, filled up with the score of no word."""
        found = [max(x, self.floor) for x in heapq.nlargest(WORST, scores)]
        return found + [self.floor] * (WORST - len(found))

    def probability(self, worst: list[list[float]]) -> np.ndarray:
        x = np.array(worst, dtype=float).reshape(-1, WORST) @ self.slope + self.offset
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _constant(share: float) -> Model:
    """The model that gives every document the same probability."""
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Model(Triples(np.empty(0, dtype=np.int64), np.empty((0, 1))), 0.0, np.zeros(WORST), float(np.log(share / (1 - share))), FLOOR)


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of the linear machine with squared hinge loss, by Newton steps on the margin violators; the last is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-9])
    for _ in range(30):
        inside = y * (x @ w) < 1
        xs, scale = x[inside], weight[inside, None]
        new = np.linalg.solve(penalty + (xs * scale).T @ xs, (xs * scale).T @ y[inside])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def _sigmoid_fit(worst: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and offset of the logistic curve, with targets drawn in from 0 and 1 so that separable scores keep a finite slope."""
    up, down = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.hstack([worst, np.ones((len(worst), 1))]).astype(float)
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (target - p) - 1e-4 * w)
        w += step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def _marking(pair: np.ndarray, down: int, up: int) -> np.ndarray:
    """Words that mark toxic documents by themselves: in several of them, and many times as often as in clean ones."""
    return (pair[:, 1] >= LEAST_SUPPORT) & (pair[:, 1] / up >= LEAST_RATIO * (pair[:, 0] + 0.5) / down)


def fit(bags: list[tuple[bool, bool, list[str]]]) -> Model:
    """The model from labelled documents as (toxic, for calibration only, distinct words). One class alone gives a constant score."""
    toxic = np.array([b[0] for b in bags], dtype=bool)
    if not toxic.any() or toxic.all():
        return _constant(float(toxic.any()))
    aside = np.array([b[1] for b in bags], dtype=bool)
    for kind in (toxic, ~toxic):  # a class of very few documents is used for both
        if not (kind & aside).any() or not (kind & ~aside).any():
            aside[kind] = False
    known = [b for b, a in zip(bags, aside) if not a]
    known = list({(t, *words): (t, a, words) for t, a, words in known}.values())  # copies count once
    counts: dict[str, list[int]] = {}
    for is_toxic, _, words in known:
        for word in words:
            counts.setdefault(word, [0, 0])[is_toxic] += 1
    down, up = (sum(b[0] == t for b in known) for t in (False, True))
    words = sorted(counts)
    pair = np.array([counts[w] for w in words], dtype=float)
    signal = (pair[:, 1] / up) * np.log(((pair[:, 1] + 0.5) / (up + 1)) / ((pair[:, 0] + 0.5) / (down + 1)))
    place = {w: n for n, w in enumerate(words)}
    codes, owner = coded(words)
    if not len(owner):
        return _constant(float(toxic.mean()))
    length = norms(codes)
    marking = _marking(pair, down, up)[owner]

    row_signal = signal[owner]
    rows_of: dict[int, list[int]] = {}
    for row, word in enumerate(owner):
        rows_of.setdefault(int(word), []).append(row)
    hot_bags = [np.array(sorted({r for w in words_ for r in rows_of.get(place[w], ())}), dtype=np.int64) for t, _, words_ in known if t]
    hot_bags = [b for b in hot_bags if len(b)]
    negative = np.flatnonzero(pair[owner, 0] > 0)
    if not hot_bags or not len(negative):
        return _constant(float(toxic.mean()))
    common = negative[np.lexsort((negative, -pair[owner[negative], 0]))[:NEGATIVES]]
    third = LANDMARKS // 3
    ordinary = negative[:: max(1, len(negative) // third)][:third]
    marks, confusing = np.lexsort((owner, -row_signal))[:third], np.empty(0, dtype=np.int64)
    score = row_signal
    for _ in range(ROUNDS):
        chosen = np.unique(np.concatenate([marks, ordinary, confusing]))
        table = triples_of(codes[chosen], length[chosen])
        values, vectors = np.linalg.eigh((table.sums(codes[chosen]) / length[chosen, None]).astype(float) + 1e-6 * np.eye(len(chosen)))
        white = vectors / np.sqrt(np.maximum(values, 1e-6))
        picked = [b[marking[b] | (np.arange(len(b)) == score[b].argmax())] for b in hot_bags]
        witness, times = np.unique(np.concatenate(picked), return_counts=True)
        hard = negative[np.lexsort((negative, -score[negative]))[: NEGATIVES // 4]]
        clean = np.union1d(common, hard)
        rows = np.concatenate([witness, clean])
        x = (table.sums(codes[rows]) / length[rows, None]).astype(float) @ white
        y = np.concatenate([np.ones(len(witness)), -np.ones(len(clean))])
        w = _machine(x, y, np.concatenate([times / up, CLEAN_WEIGHT * pair[owner[clean], 0] / down]))
        triples = table.times(white @ w[:-1])
        score = triples.sums(codes)[:, 0] / length + w[-1]
        blame = np.where(marking[negative], 0, np.maximum(score[negative] + 0.5, 0) * pair[owner[negative], 0])
        confusing = negative[np.lexsort((negative, -blame))[:third]]
    model = Model(triples, float(w[-1]), np.zeros(WORST), 0.0, FLOOR)
    judged = [b for b, a in zip(bags, aside) if a] or known
    worst = np.array([model.worst(model.words(ws).tolist()) for _, _, ws in judged])
    model.slope, model.offset = _sigmoid_fit(worst, np.array([b[0] for b in judged], dtype=bool))
    return model


def sample_bags(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[bool, bool, list[str]]]:
    """The words of at most `sample` labelled documents of each class, from the rows that may be learnt from.

    Rows with crc32 of the id as text mod 4 equal to 2 are held out. Of repeated labels of an id the greatest counts.
    """
    known = (
        need(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).withColumn("order", F.xxhash64("doc_id"))
    )
    ids = [known.where(F.col("toxic") == t).orderBy("order", "doc_id").limit(sample).select("doc_id", "toxic") for t in (0, 1)]
    chosen = F.broadcast(ids[0].unionAll(ids[1]))  # at most 2 * sample rows

    def words(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sorted(tokens(t.as_py())) for t in batch.column(2)], pa.list_(pa.string()))],
                                             names=["doc_id", "toxic", "words"])

    picked = docs.join(chosen, "doc_id").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"), "text")
    rows = picked.mapInArrow(words, "doc_id long, toxic int, words array<string>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["words"]))
    return [(bool(r["toxic"]), i % 10 < 3, [*map(sys.intern, r["words"])]) for i, r in enumerate(rows)]


def scorer(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Callable[[Column], Column]:
    """The function that scores a text column, fitted on the labelled rows of `df`; it can be used beside any other columns."""
    small_batches(df.sparkSession)
    docs = need(df, id, text).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    shared = df.sparkSession.sparkContext.broadcast(fit(sample_bags(docs, labels, sample)))

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, memory = shared.value, {}
        for texts in batches:
            worst, pending, size = [], [], 0
            for n, text in enumerate(texts):
                pending.append(tokens(text))
                size += len(text or "")
                if size >= CHUNK or n + 1 == len(texts):
                    new = sorted(set().union(*pending).difference(memory))
                    if len(memory) + len(new) > HASHED_WORDS:
                        memory.clear()
                        new = sorted(set().union(*pending))
                    memory.update(zip(new, model.words(new).tolist()))
                    worst += [model.worst(map(memory.__getitem__, words)) for words in pending]
                    pending, size = [], 0
            yield pd.Series(model.probability(worst))

    return F.pandas_udf(score, T.DoubleType())


def toxicity(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Letters of every script are scored. A null or empty text, or one without a word of three letters (two in scripts other than Latin), has the score of the least toxic words possible. Without labels
    of both classes all scores are the same. Repeated rows get equal scores; a null id is scored and not held out. No rows give none.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = need(df, id, text).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = docs.select("doc_id", held.alias("held_out"), scorer(df, labels, id, text, sample)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
