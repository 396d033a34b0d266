"""Token shards in training order: every sequence gets a slot by a keyed permutation, and slots are written as records of one length.

Documents are joined end to end and cut into sequences, as for packing. The permutation is a Feistel network over the next power of four,
walked until it falls below the number of sequences, so it is a bijection that any reader can compute both ways from key and number:
no list of the order is kept anywhere. Slot n is the record n mod SHARD of shard n div SHARD, so training reads files from front to back
and resumes at any slot with one seek.

Shards are written under another name and renamed, and what a task writes depends on nothing but its input, so a task that runs again, or
twice at once, leaves the same files.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.packing import END, WINDOW, cut, stage_tokens, with_offsets
from weir.session import scratch_path

ROUNDS = 4
#: Sequences of a shard; with 2048 ids of 16 bits a shard has 16 MB.
SHARD = 4096
#: Tasks that write, at most; beyond so many shards each writes a range of them.
WRITERS = 10_000
#: What fills up the last sequence.
PAD = 0


def _round(half: np.ndarray, key: int, number: int, mask: np.uint64) -> np.ndarray:
    x = half * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * 0xD1342543DE82EF95 + number * 0xAF251AF3B0F025B5) % 2**64)
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(32))) & mask


def permuted(numbers: np.ndarray, total: int, key: int, back: bool = False) -> np.ndarray:
    """A bijection of 0 to total - 1 that depends on the key; `back` is its inverse."""
    bits = max(1, ((max(total - 1, 1)).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    out = np.array(numbers, dtype=np.uint64)
    left_to_do = np.arange(len(out))
    while len(left_to_do):
        high, low = out[left_to_do] >> shift, out[left_to_do] & mask
        for n in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                high, low = low ^ _round(high, key, n, mask), high
            else:
                high, low = low, high ^ _round(low, key, n, mask)
        out[left_to_do] = high << shift | low
        left_to_do = left_to_do[out[left_to_do] >= np.uint64(total)]
    return out.astype(np.int64)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _slots(pieces: DataFrame, total: int, key: int, shard: int) -> DataFrame:
    """Pieces with their slot, ids compressed for the shuffle."""

    def place(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            slots = permuted(batch.column(0).to_numpy(), total, key)
            ids = [packer.compress(x.as_buffer().to_pybytes()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([pa.array(slots // shard), pa.array(slots), batch.column(1), pa.array(ids, pa.binary())], names=["shard", "slot", "offset", "ids"])

    return pieces.select("sequence_id", "offset", "ids").mapInArrow(place, "shard long, slot long, offset long, ids binary")


def write_shards(
    df: DataFrame, folder: str | None = None, id: str = "doc_id", text: str = "text", vocabulary: str | None = None, window: int = WINDOW, key: int = 1, shard: int = SHARD
) -> DataFrame:
    """Writes all documents as shards below `folder`, a path that every executor can write to, and returns the manifest.

    The manifest has a row for each shard: shard, path, first_slot, sequences, bytes, sha256, total (sequences in all), tokens (in all),
    window and key. It is written beside the shards. Null or empty texts are their closing id alone; the last sequence is filled up with
    PAD. Repeated rows are written as often as they occur. Without documents there are no shards and the manifest is empty.
    """
    spark = df.sparkSession
    folder = (folder or scratch_path(spark, "shards")).rstrip("/")
    placed, tokens = with_offsets(stage_tokens(df, id, text, vocabulary, END), "n_tokens", "start_in_task", "position")
    total = -(-tokens // window)
    shards = max(1, -(-total // shard))
    writers = min(shards, WRITERS)
    stride = 2 * window

    def write(batches):
        store, base = fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")
        store.create_dir(base, recursive=True)
        unpack = zstandard.ZstdDecompressor()
        number, out, name, digest, size, current = -1, None, "", None, 0, None

        def record():
            nonlocal size
            data = bytes(current[1])
            out.write(data)
            digest.update(data)
            size += len(data)

        def close():
            if out is None:
                return []
            record()
            out.close()
            store.move(name, f"{base}/{shard_name(number)}")
            return [(number, f"{folder}/{shard_name(number)}", number * shard, size // stride, size, digest.hexdigest())]

        def rows(done):
            return pa.RecordBatch.from_arrays([pa.array([d[n] for d in done], t) for n, t in enumerate(kinds)], names=names)

        for batch in batches:
            for at, slot, offset, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if at != number:
                    done = close()
                    if done:
                        yield rows(done)
                    number, size, digest, current = at, 0, hashlib.sha256(), None
                    name = f"{base}/.{shard_name(at)}-{uuid.uuid4().hex[:8]}"
                    out = store.open_output_stream(name)
                if current is None or current[0] != slot:
                    if current is not None:
                        record()
                    current = (slot, bytearray(np.full(window, PAD, dtype="<u2").tobytes()))
                data = unpack.decompress(ids)
                current[1][2 * offset : 2 * offset + len(data)] = data
        done = close()
        if done:
            yield rows(done)

    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    names = ["shard", "path", "first_slot", "sequences", "bytes", "sha256"]
    pieces = _slots(cut(placed, window, "<u2"), total, key, shard)
    ordered = pieces.repartitionById(writers, (F.col("shard") * writers / F.lit(shards)).cast("int")).sortWithinPartitions("shard", "slot", "offset")
    manifest = ordered.mapInArrow(write, "shard long, path string, first_slot long, sequences long, bytes long, sha256 string")
    manifest.write.parquet(f"{folder}/_manifest")
    facts = {"total": total, "tokens": tokens, "window": window, "key": key}
    return spark.read.parquet(f"{folder}/_manifest").withColumns({n: F.lit(v).cast("long") for n, v in facts.items()})


def read_slots(folder: str, first: int, count: int, window: int = WINDOW, shard: int = SHARD):
    """The ids of `count` sequences from slot `first` on, one array each, read in sequence; fewer at the end."""
    store, base = fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")
    stride, slot, end = 2 * window, first, first + count
    while slot < end:
        path = f"{base}/{shard_name(slot // shard)}"
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return
        with store.open_input_file(path) as file:
            file.seek(slot % shard * stride)
            while slot < end and (data := file.read(stride)):
                yield np.frombuffer(data, dtype="<u2")
                slot += 1
                if slot % shard == 0:
                    break
            else:
                return


def sequences(manifest: DataFrame) -> DataFrame:
    """One row for each sequence of the shards, read back: slot, sequence_id, shard, position (byte in the shard), n_tokens, ids_crc32.

    `n_tokens` leaves out what fills up the last sequence; the checksum is over all bytes of the record.
    """

    def read(batches):
        for batch in batches:
            for path, shard, first, total, tokens, window, key in zip(*(c.to_pylist() for c in batch.columns)):
                store, base = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
                stride = 2 * window
                with store.open_input_stream(base) as file:
                    sums = [zlib.crc32(data) for data in iter(lambda: file.read(stride), b"")]
                slots = np.arange(first, first + len(sums))
                numbers = permuted(slots, total, key, back=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (slots, numbers, np.full(len(sums), shard), (slots - first) * stride, np.minimum(tokens - numbers * window, window), sums)],
                    names=["slot", "sequence_id", "shard", "position", "n_tokens", "ids_crc32"],
                )

    facts = manifest.select("path", "shard", "first_slot", "total", "tokens", "window", "key")
    spread = facts.repartition(max(1, min(facts.count(), WRITERS)), "shard")
    return spread.mapInArrow(read, "slot long, sequence_id long, shard long, position long, n_tokens long, ids_crc32 long")
