"""Near duplicates against brute force over all pairs."""

import itertools
import random

import numpy as np

from weir.llm.components import components
from weir.llm.dedup import Signatures, near_duplicates, shingles
from weir.llm.text import WordHashes, words_of


def brute(rows):
    """component of each id, by comparing every pair."""
    sets = {}
    for i, text in rows:
        words = words_of(text)
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    parent = {i: i for i in sets}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus(rng):
    """Families of near copies around one original, chains of small steps, exact copies, short texts and a passage that many share."""
    vocabulary = [f"w{n}" for n in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        texts.append(base)
        for _ in range(rng.randint(0, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy)
        step = list(base)
        for _ in range(4):
            step = list(step)
            step[rng.randrange(len(step))] = rng.choice(vocabulary)
            texts.append(step)
    texts += [passage + [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))] for _ in range(40)]
    texts += [["same", "few", "words"]] * 3 + [["same", "few", "Words"], ["other"], []]
    rng.shuffle(texts)
    return [(n, " ".join(t)) for n, t in enumerate(texts)]


def test_equals_brute_force(spark):
    rows = corpus(random.Random(11))
    want = brute(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_odd_rows(odd_docs, no_docs):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(odd_docs).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 2, 5, True), (6, 2, 5, False), (None, 1, None, True)} <= got
    assert near_duplicates(odd_docs).count() == odd_docs.count()
    assert near_duplicates(no_docs).collect() == []


def test_signature_agreement_follows_similarity():
    rng = np.random.default_rng(3)
    signer, rates = Signatures(), []
    for _ in range(60):
        shared, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (12, 2, 2))
        left, right = np.unique(np.r_[shared, a]), np.unique(np.r_[shared, b])
        rates.append((signer.minima(left) == signer.minima(right)).mean())
    assert abs(np.mean(rates) - 12 / 16) < 0.06  # few hashes in many bins: most bins are borrowed


def test_shingles():
    hashes = WordHashes()
    assert len(shingles(words_of("a b c d e f a b c d e"), hashes)) == 6 and len(shingles(words_of("A b"), hashes)) == 1
    assert (shingles(words_of("A B\x0bc"), hashes) == shingles(words_of("a  b c"), hashes)).all()
    assert shingles(words_of("a b"), hashes)[0] != shingles(words_of("b a"), hashes)[0]


def test_components(spark):
    links = [(n, n + 1) for n in range(40)] + [(100, 50), (50, 75), (7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {n: 0 for n in range(1, 41)} | {75: 50, 100: 50, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_links_in_a_bucket_full_of_singletons(spark):
    """One bucket holds 60 documents that link with nothing, a group of three and a pair: a hub drawn at random seldom is one of these."""
    rng, hashes = random.Random(5), WordHashes()
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = min(([word() for _ in range(20)] for _ in range(3000)), key=lambda p: shingles(p_bytes(p), hashes)[0])
    texts = [passage + [word() for _ in range(30)] for _ in range(62)]
    texts += [texts[-1][:-3 * k] + [word() for _ in range(3 * k)] for k in (1, 2)] + [texts[-2][:-2] + [word()]]
    rows = [(n, " ".join(t)) for n, t in enumerate(texts)]
    least = shingles(p_bytes(passage), hashes)[0]
    assert all(shingles(words_of(t), hashes)[0] == least for _, t in rows)
    want = brute(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bands=1, rows=1).collect()
    assert len({c for _, c in want.values()}) == 62
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def p_bytes(words):
    return words_of(" ".join(words))
