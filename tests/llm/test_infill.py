"""Fill in the middle against regular expressions and slices."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import weir.llm.infill as module
from weir.llm.infill import Cutter, Memory, chunk_ends, fill_in_middle, restored


def plain(doc, text, rate=100, suffix_first=50):
    text = text or ""
    units = re.findall("[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return str(doc), n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < suffix_first:
        return str(doc), n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return str(doc), n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def found(df, **more):
    made = fill_in_middle(df, **more)
    rows = made.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    return sorted(((str(r["doc_id"]), r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]), r["back"]) for r in rows)


def texts(rng):
    parts = ["line\n", "\n", "Größe und Maß ", "日本語\n", "< P> <", "<S", "S>", "😀", "\r", " ", "x" * 200, "word " * 30 + "\n"]
    out = ["", "\n", "\n\n\n", "no end", "<P>", "a<S>b\n", "<<M>>\n" * 3, "<P<S<M", "<", "M>\n<M"]
    out += ["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(120)]
    shared = "".join(rng.choices(parts, k=400))
    return out + [rng.choice(parts) * rng.randint(0, 3) + shared + rng.choice(parts) for _ in range(20)] + [shared * 20]


def test_equals_plain(spark):
    rows = [*enumerate(texts(random.Random(1))), (None, "no id\nat all\n"), (5000, None), (5001, "same\n"), (5001, "same\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for more in ({}, {"rate": 40, "suffix_first": 10}):
        got = found(df, **more)
        assert [g for g, _ in got] == sorted(plain(i, t, **more) for i, t in rows)
        want = sorted((plain(i, t, **more), t or "") for i, t in rows)
        assert got == want
        assert {g[2] for g, _ in got} == {"plain", "psm", "spm"}


def test_counts_of_chunks_equal_counts_of_text():
    memory = Memory()
    for text in texts(random.Random(2)):
        raw = text.encode()
        cutter = Cutter(raw, memory)
        units = re.findall("[^\n]*\n|[^\n]+", text)
        assert cutter.n == len(units) and cutter.chars[-1] == len(text)
        assert cutter.marked() == any(m in text for m in ("<P>", "<S>", "<M>"))
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert cutter.place(k) == (len(head.encode()), len(head))


def test_chunks_follow_content(monkeypatch):
    rng = random.Random(3)
    body = bytes(rng.choices(range(32, 127), k=60_000))
    chunks = lambda raw: {raw[a:b] for a, b in zip([0, *chunk_ends(raw)], chunk_ends(raw))}
    one, two = chunks(body), chunks(b"something else in front " * 40 + body)
    assert len(one & two) > 0.9 * len(one) > 20
    assert chunk_ends(b"") == [] and chunk_ends(b"a" * 20_000)[-1] == 20_000 and max(len(c) for c in chunks(b"a" * 20_000)) <= module.MOST
    ends = chunk_ends(body)
    monkeypatch.setattr(module, "SLICE", 1000)
    assert chunk_ends(body) == ends


@pytest.mark.parametrize("place", range(60, 70))
def test_mark_over_a_border(monkeypatch, place):
    monkeypatch.setattr(module, "MOST", 64)
    assert Cutter(b"x" * place + b"<M>" + b"y" * 90, Memory()).marked()
    assert not Cutter(b"x" * place + b"<M" + b"y" * 90 + b"<M>"[1:], Memory()).marked()


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(module, "REMEMBERED", 1000)
    memory = Memory()
    for k in range(200):
        assert memory[b"%d\n" % k * 20].chars == len(b"%d\n" % k * 20)
    assert sum(map(len, memory)) <= 1000 + 100


def test_odd_rows(odd_docs, no_docs):
    df = odd_docs.withColumns({c: F.lit("clash") for c in ("a", "b", "moved", "turned", "n", "form", "output")})
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert [g for g, _ in found(df)] == sorted(plain(i, t) for i, t in rows)
    assert fill_in_middle(no_docs).collect() == []
