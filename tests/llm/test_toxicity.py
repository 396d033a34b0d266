"""The kernel against its definition, and held-out accuracy."""

import itertools
import random

import numpy as np
import pytest

from weir.llm.toxicity import DECAY, coded, fit, norms, tokens, toxicity, triples_of


def kernel(a, b):
    """Sum over common subsequences of three letters, each weighted by the lengths it spans."""

    def features(codes):
        out = {}
        for i, j, k in itertools.combinations(range(len(codes)), 3):
            if codes[i] and codes[j] and codes[k]:
                key = (codes[i], codes[j], codes[k])
                out[key] = out.get(key, 0.0) + DECAY ** (k - i + 1)
        return out

    x, y = features(a), features(b)
    return sum(v * y.get(k, 0.0) for k, v in x.items())


WORDS = ["idiot", "i.d.i.o.t", "banana", "abc", "réeux", "aaaaaa", "worthless"]


def test_kernel_equals_definition():
    codes, owner = coded(WORDS)
    assert owner.tolist() == [*range(len(WORDS))]
    assert np.allclose(norms(codes) ** 2, [kernel(c.tolist(), c.tolist()) for c in codes], rtol=1e-4)
    table = triples_of(codes, norms(codes))
    want = [[kernel(a.tolist(), b.tolist()) for b in codes] for a in codes]
    assert np.allclose(table.sums(codes) * norms(codes)[None, :], want, rtol=1e-3, atol=1e-5)


def test_tokens_and_windows():
    assert tokens("You s t u p i d Idiot!! a b") == {"you", "s", "t", "u", "p", "i", "d", "idiot", "a", "b", "stupid"}
    assert tokens(None) == set() and coded([""])[0].shape[0] == 0 and coded([])[0].shape[0] == 0
    codes, owner = coded(["x" * 100])
    assert len(owner) == 8 and codes.shape[1] == 24


@pytest.fixture(scope="module")
def bags():
    rng = random.Random(9)
    syllables = ["the", "ing", "ou", "er", "an", "re", "st", "en", "at", "on"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    rows = []
    for n in range(400):
        toxic = n % 4 == 0
        words = [word() for _ in range(40)] + (rng.sample(["idiot", "stupid", "moron", "trash", "loser", "scum"], 2) if toxic else [])
        rows.append((toxic, n % 10 < 3, sorted(set(words))))
    return rows


def test_gapped_insults(bags):
    model = fit(bags)
    scores = dict(zip(["idiot", "id-iot", "i.d.i.o.t", "thering", "onaner"], model.words(["idiot", "id-iot", "i.d.i.o.t", "thering", "onaner"]).tolist()))
    assert min(scores["idiot"], scores["id-iot"], scores["i.d.i.o.t"]) > 0.5 > 0 > max(scores["thering"], scores["onaner"])
    judge = lambda words: float(model.probability([model.worst(model.words(words).tolist())])[0])
    assert judge(["thering", "m-oron", "s.t.u.p.i.d"]) >= 0.3 > judge(["thering", "onaner", "stouer"])


def test_lookalike_digits_and_other_scripts(bags):
    rng = random.Random(4)
    parts = ["ка", "ро", "сте", "ни", "ло", "во", "при", "го", "та", "мен"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    insults = ["дурак", "идиот", "тупица", "сволочь"]
    other = [(n % 4 == 0, n % 10 < 3, sorted({word() for _ in range(40)} | (set(rng.sample(insults, 2)) if n % 4 == 0 else set()))) for n in range(400)]
    model = fit([*bags, *other])
    judge = lambda words: float(model.probability([model.worst(model.words(words).tolist())])[0])
    bad = [*insults, "ду-рак", "с.в.о.л.о.ч.ь", "1d10t", "5tup1d", "m0r0n"]
    assert min(model.words(bad)) > 0.5 and all(judge([word(), one, two, word()]) >= 0.3 for one, two in zip(bad, bad[1:]))
    assert sum(judge([word() for _ in range(30)]) >= 0.3 for _ in range(50)) <= 1
    assert judge(["2024", "10", "31415"]) < 0.3 and len(coded(["2024", "$5", "ab"])[1]) == 0 and coded(["дa", "你好"])[1].tolist() == [0, 1]


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity(docs, labels).where("held_out").join(labels, "doc_id").select("toxic", "predicted", "score").collect()
    toxic, clean = [r for r in rows if r["toxic"] == 1], [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) / len(toxic) > 0.75 and sum(r["predicted"] for r in clean) / len(clean) < 0.05
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (5, 0, 1), (None, 1, 1), (4, None, 1)], "doc_id long, toxic int, quality int")
    got = toxicity(odd_docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == odd_docs.count()
    assert toxicity(odd_docs, labels.limit(0)).select("score").distinct().count() == 1
    assert toxicity(no_docs, labels).collect() == []
    assert [fit([(True, False, ["a"])]).probability([[0.0] * 3])[0] > 0.99, fit([]).probability([[0.0] * 3])[0] < 0.01] == [True, True]
