"""Scores against plain counts and a plain forward recursion; training raises the likelihood; held-out texts are scored better than by counts."""

import math
import zlib
from collections import Counter

import numpy as np

from weir.llm.language import BUCKETS, expected, first_model, forward, language_scores
from weir.llm.text import words_of


def plain(rows):
    learn = [i is not None and zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in rows]
    counts = Counter()
    for (_, text), yes in zip(rows, learn):
        if yes:
            counts.update([*words_of(text), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for (i, text), yes in zip(rows, learn):
        tokens = [*words_of(text), None]
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        out.append((str(i), not yes, len(tokens), sum(counts[t] > 0 for t in tokens), n, round(base, 4)))
    return sorted(out)


def shape(df):
    return sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in df.collect())


def test_base_equals_plain(spark, sf, odd_docs, odd_rows, no_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    scored = language_scores(docs)
    assert shape(scored) == plain([tuple(r) for r in docs.collect()])
    held = [r for r in scored.collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    odd = language_scores(odd_docs)
    assert shape(odd) == plain(odd_rows) and all(math.isfinite(r["score"]) for r in odd.collect())
    assert language_scores(no_docs).collect() == []


def test_forward_is_the_sum_over_all_paths():
    model = first_model(np.arange(4), states=3)
    sequences = [np.array([0, 3, 1]), np.array([2]), np.array([1, 1, 1, 0])]
    for sequence, log in zip(sequences, forward(model, sequences, np.zeros(3, dtype=np.int64))):
        total = 0.0
        for path in np.ndindex(*[3] * len(sequence)):
            p = model.start[path[0]] * model.emit[sequence[0], path[0]]
            for k in range(1, len(sequence)):
                p *= model.move[path[k - 1], path[k]] * model.emit[sequence[k], path[k]]
            total += p
        assert math.isclose(math.log(total), log, rel_tol=1e-9)


def test_expected_counts_add_up_and_raise_the_likelihood():
    rng = np.random.default_rng(4)
    sequences = [np.concatenate([rng.integers(0, 3, 20), rng.integers(3, 6, 20)]) for _ in range(30)] + [np.array([5])]
    model, middle = first_model(np.bincount(np.concatenate(sequences)), states=2), np.zeros(31, dtype=np.int64)
    logs = []
    for _ in range(8):
        start, move, emitted, seen, log = expected(model, sequences, middle)
        assert math.isclose(start.sum(), 31) and math.isclose(emitted.sum(), 1201) and math.isclose(move.sum(), 1201 - 31) and math.isclose(seen.sum(), 1201)
        assert math.isclose(log, forward(model, sequences, middle).sum(), rel_tol=1e-9)
        logs.append(log)
        model.start, model.move, model.emit = start / start.sum(), move / move.sum(axis=1, keepdims=True), emitted / emitted.sum(axis=0)
    assert all(b > a for a, b in zip(logs, logs[1:])) and BUCKETS > 0
