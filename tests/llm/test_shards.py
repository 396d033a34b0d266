"""Shards against the packed sequences, read in order and from any slot."""

import hashlib
import zlib

import numpy as np
import pytest

from weir.llm.packing import pack
from weir.llm.shards import PAD, permuted, read_slots, sequences, write_shards
from weir.session import scratch_path


@pytest.mark.parametrize("total", [1, 2, 3, 4, 5, 16, 17, 1000, 4097])
def test_permutation(total):
    slots = permuted(np.arange(total), total, 7)
    assert sorted(slots) == [*range(total)] and (permuted(slots, total, 7, back=True) == np.arange(total)).all()
    if total > 100:
        assert (slots != permuted(np.arange(total), total, 8)).mean() > 0.9 and abs(np.corrcoef(slots, np.arange(total))[0, 1]) < 0.2


def test_shards_hold_every_sequence(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want: dict[int, np.ndarray] = {}
    for p in pack(docs, window=128).collect():
        want.setdefault(p["sequence_id"], np.full(128, PAD, dtype="<u2"))[p["offset"] : p["offset"] + p["length"]] = np.frombuffer(p["ids"], dtype="<u4")
    folder = scratch_path(spark, "shards-test")
    manifest = write_shards(docs, folder, window=128, key=3, shard=50).orderBy("shard").collect()
    total = len(want)
    order = permuted(np.arange(total), total, 3, back=True)
    got = [*read_slots(folder, 0, total + 5, window=128, shard=50)]
    assert len(got) == total and all((g == want[order[n]]).all() for n, g in enumerate(got))
    assert [m["first_slot"] for m in manifest] == [*range(0, total, 50)] and sum(m["sequences"] for m in manifest) == total
    data = b"".join(g.tobytes() for g in got[:50])
    assert manifest[0]["sha256"] == hashlib.sha256(data).hexdigest() and manifest[0]["bytes"] == len(data)
    resumed = [*read_slots(folder, 73, 40, window=128, shard=50)]
    assert len(resumed) == 40 and all((a == b).all() for a, b in zip(resumed, got[73:]))
    rows = sequences(spark.read.parquet(f"{folder}/_manifest").selectExpr("*", f"{total} as total", f"{manifest[0]['tokens']} as tokens", "128L as window", "3L as key")).collect()
    assert {(r["slot"], r["sequence_id"], r["ids_crc32"]) for r in rows} == {(n, int(order[n]), zlib.crc32(g.tobytes())) for n, g in enumerate(got)}
    assert sum(r["n_tokens"] for r in rows) == manifest[0]["tokens"]


def test_odd_rows(spark, odd_docs, no_docs):
    tokens = write_shards(odd_docs, window=64, shard=8).first()["tokens"]
    assert tokens == sum(p["length"] for p in pack(odd_docs).collect())
    assert write_shards(no_docs).count() == 0 and sequences(write_shards(no_docs)).count() == 0
