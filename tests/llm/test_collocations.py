"""Collocations against plain counting, with ranges so small that words and pairs are split between them."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weir.llm.collocations import collocations, counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, percent=50, top=2000):
    f, words = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for size in (1, 2, 3):
                for k in range(len(w) - size + 1):
                    f[lang, tuple(w[k : k + size])] += 1
    candidates = {k: n for k, n in f.items() if len(k[1]) > 1 and n >= least}
    covered = set()
    for (lang, g), n in candidates.items():
        if len(g) == 3:
            covered |= {(lang, part) for part in (g[:2], g[1:]) if 100 * n >= percent * candidates[lang, part]}
    found = []
    for (lang, g), a in candidates.items():
        if (lang, g) in covered:
            continue
        cuts = [(1000000 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        found.append((lang, -score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


def corpus(rng, documents):
    """A third of all words are one word; marks, tabs, upper case, other scripts and controls occur."""
    words = ["the", "The", "a", "of", "new", "York", "Ärger", "日本", "x\x01y", "o'k", "😀", *[f"w{n}" for n in range(30)]]
    weights = [30, 10, 10, 8, 6, 6, 3, 3, 2, 2, 2] + [1] * 30
    rows = []
    for _ in range(documents):
        out = []
        for _ in range(rng.randint(0, 60)):
            out += rng.choices(words, weights, k=1) if rng.random() < 0.8 else ["new", "York", "city"]
            out.append(rng.choice([" ", " ", " ", " ", "\t", "  ", ", ", ". ", "\n", "!", "\x0b", "\x1f"]))
        rows.append((rng.choice(["en", "en", "en", "fr", None, "und", "e"]), "".join(out)))
    return rows


@pytest.mark.parametrize("range_bytes, run_words", [(1 << 23, 2_000_000), (700, 500)])
def test_equals_plain(spark, range_bytes, run_words):
    rows = corpus(random.Random(3), 300)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = sorted(tuple(r) for r in collocations(df, least=5, range_bytes=range_bytes, run_words=run_words).collect())
    want = plain(rows, 5)
    assert len(want) > 50 and got == want


def test_top_and_share(spark):
    rows = corpus(random.Random(4), 120)
    df = spark.createDataFrame(rows, "lang string, text string")
    got = sorted(tuple(r) for r in collocations(df, least=3, covered_percent=90, top=7).collect())
    assert got == plain(rows, 3, 90, 7)


def test_counts_do_not_depend_on_ranges(spark):
    rows = corpus(random.Random(5), 150)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    tables = [sorted(map(str, counts(df, least=4, range_bytes=b, run_words=w).where("level > 0").collect())) for b, w in ((1 << 23, 10**6), (300, 10**6), (2000, 90))]
    assert tables[0] == tables[1] == tables[2]


def test_few_long_texts_are_cut_into_ranges(spark):
    """Two long texts, neither of which a sample of rows need hold: ranges all the same, and the counts of a plain version."""
    from weir.llm.collocations import _bounds, _texts

    rng = random.Random(6)
    rows = [("en", " ".join(rng.choices([f"w{n}" for n in range(50)], k=6000))) for _ in range(2)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert len(_bounds(_texts(df, "text", "lang"), 2000)) > 8
    assert sorted(tuple(r) for r in collocations(df, least=4, range_bytes=2000).collect()) == plain(rows, 4)


def test_long_words_and_slices(spark, monkeypatch):
    import weir.llm.collocations as module

    text = "Ab cd\tef, " * 50 + "x" * 500 + " ab cd ef" * 3
    want = [w for part in module.slices(text) for w in part]
    monkeypatch.setattr(module, "SLICE", 64)
    parts = list(module.slices(text))
    assert [w for part in parts for w in part] == want and len(parts) > 10


def test_odd_rows(odd_docs, no_docs, spark):
    df = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    rows = [(None, r["text"]) for r in odd_docs.collect()]
    assert sorted(tuple(r) for r in collocations(df, least=2).collect()) == plain(rows, 2)
    assert collocations(no_docs).collect() == []
    clash = df.withColumns({c: F.lit("clash") for c in ("a", "l", "r", "n", "x", "y", "z", "phrase", "rank", "level", "range", "words")})
    assert collocations(clash, least=2).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    with pytest.raises(ValueError):
        collocations(df.drop("lang"))


def test_scores_beyond_64_bits(spark):
    from weir.llm.collocations import exact_score

    df = spark.createDataFrame([(10**12 - 1, 10**12, 10**12 + 7)], "a long, l long, r long")
    a, left, right = 10**12 - 1, 10**12, 10**12 + 7
    assert df.select(F.expr(exact_score("l", "r")).alias("s")).first()["s"] == 10**6 * a * a // (left * right)
