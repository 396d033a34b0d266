"""The lattice against the library: the public byte-pair model, and a unigram model put together here."""

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_file

from weir.llm import pieces
from weir.llm.pieces import decode, encode, vocabulary

TEXTS = [
    "hello world", " two  spaces   three ", "line\nbreak\n\n x", "é日本😀 tail", "", "a", "▁sign", "Donaudampfschifffahrtsgesellschaft " * 3, "x" * 200 + " y", "tab\tand\rcr", "100,000.50 (ok)", " ",
    "word" * 40, "😀" * 70,
]


def library_ids(path, text):
    return sentencepiece.SentencePieceProcessor(model_file=path).encode(text)


def encoded(df, model=None):
    return {r["doc_id"]: np.frombuffer(r["ids"], dtype="<u4").tolist() for r in encode(df, model=model).collect()}


def test_byte_pairs_equal_library(spark, sf):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(10_000 + n, t) for n, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = encoded(df)
    assert {i: library_ids(path, t or "") for i, t in rows} == got
    back = {r["doc_id"]: r["text"] for r in encode(df).select("doc_id", decode(F.col("ids")).alias("text")).collect()}
    assert {i: (t or "").replace("▁", " ") for i, t in rows} == {i: t.replace("▁", " ") for i, t in back.items()}


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """A model file with pieces and scores written down here: no training."""
    model = model_file.ModelProto()
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = 1, True
    model.normalizer_spec.name, model.normalizer_spec.add_dummy_prefix = "identity", True
    model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.escape_whitespaces = False, True
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [(p, -1.5 - 0.37 * n % 4.1, 1) for n, p in enumerate(["▁", "a", "b", "c", "▁a", "ab", "bc", "abc", "▁ab", "ca", "bca", "▁abc", "cab", "é", "éa"])]
    for piece, score, kind in pieces:
        added = model.pieces.add()
        added.piece, added.score, added.type = piece, score, kind
    path = str(tmp_path_factory.mktemp("model") / "unigram.model")
    with open(path, "wb") as file:
        file.write(model.SerializeToString())
    return path


def test_viterbi_equals_library(spark, unigram):
    texts = ["abcab", "a b c", "abcabcabc cab", "éa bé", "  ab", "aéx", "cabcabbacbacbac abcbabca", "z"]
    got = encoded(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), unigram)
    assert got == {n: library_ids(unigram, t) for n, t in enumerate(texts)}


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    got = encode(odd_docs)
    assert got.columns == ["doc_id", "ids"] and got.count() == len(odd_rows)
    assert got.where("doc_id in (1, 2)").where("octet_length(ids) = 0").count() == 2
    assert encode(no_docs).collect() == []
    assert vocabulary().longest == 16


def test_nothing_is_stored_or_shuffled(spark, sf):
    plan = encode(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "Exchange hashpartitioning" not in physical and "Aggregate" not in physical and "units-" not in physical


def test_small_chunks_and_long_units_equal_library(spark, unigram, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(pieces, "CHUNK_UNITS", 5)
    texts = [*TEXTS, "abc." * 50, "é" * 150 + "ab", "(a)b.c, abc\n\nca 日.本", "cab" * 70]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1)
    for path in (public_tokenizers.path("piece_bpe_32k.model"), unigram):
        assert encoded(df, path) == {n: library_ids(path, t) for n, t in enumerate(texts)}


def test_no_row_holds_the_texts_of_a_chunk(spark):
    """Texts of few distinct units, four million numbers in one chunk: they once came as one row of 16 MB, which every operator behind it copied."""
    docs = spark.range(0, 100, 1, 1).select("id", F.expr("repeat(concat('a b', id, ' '), 20000)").alias("text"))
    rows = pieces._units(docs, "id", "text", vocabulary()).toDF("number", "unit", "note")
    assert rows.select(F.max(F.octet_length("note"))).first()[0] < 4_000_000


def test_small_notes_equal_library(spark, unigram, monkeypatch):
    import public_tokenizers

    for name, value in (("FOLDED", 3), ("NOTE_NUMBERS", 4), ("BATCH_BYTES", 8)):
        monkeypatch.setattr(pieces, name, value)
    texts = [*TEXTS, None, "abc." * 50, "(a)b.c, abc\n\nca 日.本"]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1)
    for path in (public_tokenizers.path("piece_bpe_32k.model"), unigram):
        assert encoded(df, path) == {n: library_ids(path, t or "") for n, t in enumerate(texts)}


def test_texts_given_back_are_those_of_decode(spark, odd_docs):
    got = encode(odd_docs, back=True)
    assert got.columns == ["doc_id", "ids", "text"] and got.where(~F.col("text").eqNullSafe(decode(F.col("ids")))).count() == 0


def test_units_of_earlier_chunks_are_not_looked_at_again(spark, unigram, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(pieces, "CHUNK_CHARACTERS", 10)
    texts = [*TEXTS, "", "cab" * 70, "abc ab", *TEXTS, "abc ab " + "cab" * 70]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1)
    rows = [r[0] for r in pieces._units(df, "doc_id", "text", vocabulary()).where("unit IS NOT NULL").select("unit").collect()]
    assert len(rows) == len({*rows})
    for remembered in (16_000_000, 300):
        monkeypatch.setattr(pieces, "REMEMBERED_CHARACTERS", remembered, raising=False)
        for path in (public_tokenizers.path("piece_bpe_32k.model"), unigram):
            assert encoded(df, path) == {n: library_ids(path, t) for n, t in enumerate(texts)}
