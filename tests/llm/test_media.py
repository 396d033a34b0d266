"""Containers: exact round trips, and files made by hand."""

import hashlib
import struct
import zlib

import pytest

from weir.llm.media import FRAME, box, boxes, container, first_track, full_box, padded, payload_of, read_media, store_media
from weir.llm.queries import op9_media


@pytest.mark.parametrize("size", [0, 1, 191, 192, 193, 192 * 8, 192 * 16, 192 * 17 + 5, 192 * 40])
def test_round_trip(size):
    payload = padded(bytes(range(256)) * (size // 256) + bytes(size % 256))
    data = container(payload)
    track = first_track(data)
    assert payload_of(data, track) == payload and len(payload) % FRAME == 0
    assert (track.codec, track.width, track.height, track.duration) == ("raw ", 16, 12, len(payload) // FRAME)
    assert b"".join(data[a:b] for a, b in track.keys) == payload  # key ranges cover all frames
    assert [b - a for a, b in track.keys[:-1]] == [FRAME * 16] * (len(track.keys) - 1)


def test_boxes_nest_and_check_sizes():
    assert [p for p, *_ in boxes(box(b"moov", box(b"trak", box(b"tkhd", b"x"))))] == [(b"moov",), (b"moov", b"trak"), (b"moov", b"trak", b"tkhd")]
    open_ended = struct.pack(">I4s", 0, b"free") + b"rest"
    assert [*boxes(open_ended)] == [((b"free",), 8, 12)]
    for broken in (b"\0\0\0\x05free", b"\0\0\0\xffmoov", b"abc", struct.pack(">I4s", 1, b"mdat")):
        with pytest.raises(ValueError):
            list(boxes(broken))


def test_tables_of_other_writers():
    """32-bit offsets, sizes sample by sample, no list of key frames, a chunk layout with two runs."""
    sizes, data = [3, 5, 2, 7], b"AAABBBBBCCDDDDDDD"
    head = box(b"ftyp", b"isom")
    mdat_at = len(head) + 8
    table = box(
        b"stbl", full_box(b"stsd", struct.pack(">I", 1), box(b"avc1", struct.pack(">24xHH", 640, 480), bytes(50))),
        full_box(b"stts", struct.pack(">III", 1, 4, 10)), full_box(b"stsc", struct.pack(">I6I", 2, 1, 2, 1, 2, 1, 1)),
        full_box(b"stsz", struct.pack(">II4I", 0, 4, *sizes)), full_box(b"stco", struct.pack(">I3I", 3, mdat_at, mdat_at + 8, mdat_at + 10)),
    )
    mdhd = full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 40, 0, 0))
    track = first_track(head + box(b"mdat", data) + box(b"moov", box(b"trak", box(b"mdia", mdhd, box(b"minf", table)))))
    assert (track.codec, track.width, track.height, track.timescale, track.duration) == ("avc1", 640, 480, 1000, 40)
    assert [b - a for a, b in track.ranges] == sizes and len(track.keys) == 4


def test_query_and_odd_rows(spark, sf, odd_docs, no_docs):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op9_media(spark, sf).collect():
        payload = padded(texts[r["doc_id"]].encode())
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["n_bytes"] == len(texts[r["doc_id"]].encode())
        assert r["tail_crc32"] == zlib.crc32(payload[-16:]) and r["media_sha256"] == hashlib.sha256(container(payload)).hexdigest()
        assert r["payload_bytes"] == len(payload) and r["media_bytes"] == len(container(payload))
    rows = read_media(store_media(odd_docs)).select("text", "info.payload", "info.error").collect()
    assert all(bytes(r["payload"]) == padded((r["text"] or "").encode()) and r["error"] is None for r in rows)
    assert read_media(store_media(no_docs)).count() == 0
    bad = spark.createDataFrame([(bytearray(b"junk file"),), (None,)], "media binary")
    assert [(r[0], r[1] is None) for r in read_media(bad).select("info.codec", "info.error").collect()] == [(None, False), (None, True)]
