"""Packing against a plain one-loop version, and the word-wise encoder against the library's own."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weir.llm.packing import END, pack
from weir.llm.tokens import vocabulary, word_encoder

ODD = [
    "don't stop'LL  'S x²½ ÀÉß ŉ", "ééé ÿþ x", "tab\tnew\nline\r\x0b\x0c", "<|endoftext|> hi", "a <|endoftext|> b<|startoftext|>", "<|ENDOFTEXT|> c <|endoftext| >", "é<|endoftext|>日本", "日本語 text", "ŒUVRE İstanbul ſ", "\x7f\x01", "...'s ''s've",
    "ª º ¹ 12345", "", " ", "é combining", "ΑΣ ας", "😀 ok", "don’t", "x" * 3000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_encoder_equals_library(library, text):
    assert np.frombuffer(word_encoder(None).encode(text), dtype="<u2").tolist() == ids_of(library, text)


def test_encoder_on_documents(spark, library):
    for (text,) in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert np.frombuffer(word_encoder(None).encode(text or ""), dtype="<u2").tolist() == ids_of(library, text)


def test_pack_equals_plain(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(1000, None), (1001, ""), (1002, "again"), (1002, "again"), (None, "no id"), (1003, "long " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({"length": F.lit(1), "ids": F.lit("clash"), "task": F.lit(None)})
    pieces = sorted(pack(df).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    # every sequence is full but the last, and gapless
    at = 0
    for p in pieces:
        assert p["sequence_id"] * 2048 + p["offset"] == at and p["offset"] + p["length"] <= 2048 and p["length"] > 0
        assert len(p["ids"]) == 4 * p["length"]
        at += p["length"]
    # the pieces of a document are its ids and the closing one
    want = sorted((str(i), ids_of(library, t) + [END]) for i, t in rows)
    got, current = [], None
    for p in pieces:
        if p["start"] == 0:
            current = []
            got.append((str(p["doc_id"]), current))
        assert p["start"] == len(current)
        current += np.frombuffer(p["ids"], dtype="<u4").tolist()
    assert sorted(got) == want
    assert all(p["doc_tokens"] >= p["start"] + p["length"] for p in pieces)
    last = at % 2048 or 2048
    assert {p["sequence_tokens"] for p in pieces if p["sequence_id"] == (at - 1) // 2048} == {last}
    crc = pack(df).select(F.crc32("ids").alias("c"), "ids").first()
    assert crc["c"] == zlib.crc32(crc["ids"])


def test_pack_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pack(none).collect() == []
    one = pack(spark.createDataFrame([(7, None)], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"], r["padded_tokens"]) for r in one] == [(7, 0, 1, 0, 0, 1)]
