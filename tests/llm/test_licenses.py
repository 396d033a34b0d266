"""License search against every block with every template."""

import random
import re

import pytest
from pyspark.sql import functions as F

from weir.llm.licenses import PHRASES, TEMPLATES, block_starts, find_licenses, level_of


def cut(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, templates=TEMPLATES, phrases=PHRASES, percent=80):
    words = cut(text)
    places = sorted((k, label) for body, label in phrases for p in [body.split()] for k in range(len(words)) if words[k : k + len(p)] == p)
    blocks = []
    for number, (label, body) in enumerate(templates):
        whole = cut(body)
        level = 16
        while level < 2 * len(whole):
            level *= 2
        starts = [0]
        while starts[-1] + level < len(words):
            starts.append(starts[-1] + level // 2)
        for s in starts:
            both = len(set(whole) & set(words[s : s + level]))
            if 100 * both >= percent * len(set(whole)):
                blocks.append((s, min(s + level, len(words)), label, number, both / len(set(whole))))
    return len(words), places, sorted(blocks)


def found(df, **more):
    return sorted(
        (str(r["doc_id"]), r["n_words"], [(p["start"], p["label"]) for p in r["places"]], [tuple(b) for b in r["blocks"]]) for r in find_licenses(df, **more).collect()
    )


def corpus(rng):
    filler = ["the", "of", "this", "software", "license", "to", "and", "mit", "apache", "général", "日本", "general", "public", "x1"]
    rows = []
    for n in range(150):
        out = []
        for _ in range(rng.randint(0, 5)):
            out += rng.choices(filler, k=rng.randint(0, 90))
            if rng.random() < 0.6:  # a template, some words of it lost, doubled or replaced
                words = rng.choice(TEMPLATES)[1].split()
                loss = rng.choice([0, 0.1, 0.2, 0.3, 0.5])
                out += [w for w in words if rng.random() >= loss]
        rows.append((n, rng.choice([" ", "\n", "-"]).join(out)))
    return rows


def test_equals_plain(spark):
    rows = corpus(random.Random(2))
    got = found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    want = sorted((str(i), *plain(t)) for i, t in rows)
    assert got == want
    assert sum(len(w[3]) for w in want) > 40 and any(not w[3] for w in want)


def test_own_templates_and_threshold(spark):
    rows = [(1, "one two three four five"), (2, "one two three"), (3, "five four"), (4, "one one one two"), (5, "a b " * 40 + "one two four three")]
    templates, phrases = [("t", "One, two; three. Four!"), ("u", "five five five")], [("one two", "p"), ("two", "q")]
    for percent in (50, 75, 100):
        got = found(spark.createDataFrame(rows, "doc_id long, text string"), templates=templates, phrases=phrases, percent=percent)
        assert got == sorted((str(i), *plain(t, templates, phrases, percent)) for i, t in rows)
    with pytest.raises(ValueError):
        find_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates=[("none", "...")])


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 24, 25, 160, 1000])
def test_blocks_cover_every_run(n):
    starts = list(block_starts(n, 16))
    assert starts[0] == 0 and starts[-1] + 16 >= n
    for at in range(n):
        assert any(s <= at and min(at + 8, n) <= s + 16 for s in starts)
    assert [level_of(m) for m in (1, 8, 9, 16, 17, 64)] == [16, 16, 32, 32, 64, 128]


def test_odd_rows(odd_docs, no_docs):
    df = odd_docs.withColumns({c: F.lit("clash") for c in ("task", "places", "blocks", "met", "level", "n_words", "label")})
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert found(df) == sorted((str(i), *plain(t)) for i, t in rows)
    assert find_licenses(no_docs).collect() == []


def test_clean_prose_stays_clean(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = find_licenses(docs).join(docs.select("doc_id", "text"), "doc_id").select("text", (F.size("places") + F.size("blocks")).alias("hits")).collect()
    assert all(bool(r["hits"]) == bool(re.search("licen[sc]e", r["text"] or "", re.I)) for r in rows) and any(r["hits"] for r in rows)
