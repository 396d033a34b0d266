"""Media columns: texts stored as raw grey frames in ISO media containers, and containers read by their boxes.

A container is a tree of boxes (size, four letters, content). `store_media` writes one video track whose frames are 16 x 12
grey pixels of 8 bits, so 192 bytes each; `read_media` walks the nested boxes of any such file, decodes its sample tables and
returns codec, duration and the byte ranges from each key frame to the next, without touching the payload.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

WIDTH, HEIGHT = 16, 12
FRAME = WIDTH * HEIGHT
TIMESCALE = 25
FRAMES_PER_CHUNK = 8
FRAMES_PER_KEY = 16
#: Boxes that hold boxes (fixed values of the format).
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"moof", b"traf", b"mvex"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
MAX_DEPTH = 12

def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full_box(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def container(payload: bytes) -> bytes:
    """A file with one track of whole frames; the payload's length must be a positive multiple of the frame's."""
    frames, rest = divmod(len(payload), FRAME)
    if rest or not frames:
        raise ValueError(f"{len(payload)} bytes are not whole frames of {FRAME}")
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    chunks = -(-frames // FRAMES_PER_CHUNK)
    layout = [(1, FRAMES_PER_CHUNK)] if frames >= FRAMES_PER_CHUNK else []
    if frames % FRAMES_PER_CHUNK:
        layout.append((chunks, frames % FRAMES_PER_CHUNK))
    keys = range(1, frames + 1, FRAMES_PER_KEY)

    def movie(base: int) -> bytes:
        entry = struct.pack(">6xH16xHHIIIH32sHh", 1, WIDTH, HEIGHT, 72 << 16, 72 << 16, 0, 1, b"\x04grey".ljust(32, b"\0"), 8, -1)
        table = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), box(b"raw ", entry)),
            full_box(b"stts", struct.pack(">III", 1, frames, 1)),
            full_box(b"stss", struct.pack(f">{1 + len(keys)}I", len(keys), *keys)),
            full_box(b"stsc", struct.pack(">I", len(layout)), *[struct.pack(">III", first, count, 1) for first, count in layout]),
            full_box(b"stsz", struct.pack(">II", FRAME, frames)),
            full_box(b"co64", struct.pack(f">I{chunks}Q", chunks, *range(base, base + len(payload), FRAME * FRAMES_PER_CHUNK))),
        )
        media = box(
            b"mdia",
            full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, frames, 0x55C4, 0)),
            full_box(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"grey frames\0"),
            box(
                b"minf",
                full_box(b"vmhd", bytes(8), flags=1),
                box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))),
                table,
            ),
        )
        track = box(
            b"trak",
            full_box(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, frames, 0, 0, 0, 0), MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=3),
            media,
        )
        return box(b"moov", full_box(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, frames, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2)), track)

    data = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16)
    return b"".join((head, movie(len(head) + len(movie(0)) + len(data)), data, payload))


def boxes(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Every box below a range of the file as (path of kinds, start of content, end), parents before children."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError(f"{end - start} stray bytes at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        inner = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError(f"long size of box at {start} is cut")
            size, inner = struct.unpack_from(">Q", data, inner)[0], start + 16
        stop = end if size == 0 else start + size
        if stop < inner or stop > end:
            raise ValueError(f"box {kind!r} at {start} leaves its parent")
        yield (*path, kind), inner, stop
        if kind in CONTAINERS and len(path) < MAX_DEPTH:
            yield from boxes(data, inner, stop, (*path, kind))
        start = stop


@dataclass
class Track:
    codec: str
    width: int
    height: int
    timescale: int
    duration: int
    ranges: list[tuple[int, int]]
    keys: list[tuple[int, int]]


def _longs(data: bytes, at: int, end: int, count: int, code: str = "I") -> tuple[int, ...]:
    form = struct.Struct(f">{count}{code}")
    if at + form.size > end:
        raise ValueError(f"a table at {at} is cut")
    return form.unpack_from(data, at)


def first_track(data: bytes) -> Track:
    """The first track's description from its boxes; ValueError names what is broken or absent."""
    trak = next((span for path, *span in boxes(data) if path == (b"moov", b"trak")), None)
    if trak is None:
        raise ValueError("no track")
    found = {path[-1]: (at, end) for path, at, end in boxes(data, *trak)}

    def table(kind: bytes) -> tuple[int, int]:
        if kind not in found:
            raise ValueError(f"no box {kind.decode('latin-1')}")
        at, end = found[kind]
        return at + 4, end

    at, end = table(b"mdhd")
    timescale, duration = struct.unpack_from(">IQ", data, at + 16) if data[at - 4] == 1 else struct.unpack_from(">II", data, at + 8)
    at, end = table(b"stsd")
    codec = data[at + 8 : at + 12].decode("latin-1")
    width, height = _longs(data, at + 12 + 24, end, 2, "H")
    at, end = table(b"stsz")
    size, count = _longs(data, at, end, 2)
    sizes = (size,) * min(count, len(data)) if size else _longs(data, at + 8, end, count)
    if b"co64" in found:
        at, end = table(b"co64")
        offsets = _longs(data, at + 4, end, _longs(data, at, end, 1)[0], "Q")
    else:
        at, end = table(b"stco")
        offsets = _longs(data, at + 4, end, _longs(data, at, end, 1)[0])
    at, end = table(b"stsc")
    flat = _longs(data, at + 4, end, 3 * _longs(data, at, end, 1)[0])
    layout = [*zip(flat[::3], flat[1::3]), (len(offsets) + 1, 0)]
    ranges: list[tuple[int, int]] = []
    for (first, per_chunk), (until, _) in zip(layout, layout[1:]):
        for offset in offsets[first - 1 : until - 1]:
            for size in sizes[len(ranges) : len(ranges) + per_chunk]:
                ranges.append((offset, offset + size))
                offset += size
    if len(ranges) != count or any(stop > len(data) for _, stop in ranges):
        raise ValueError("the sample tables disagree with the file")
    if b"stss" in found:
        at, end = table(b"stss")
        sync = _longs(data, at + 4, end, _longs(data, at, end, 1)[0])
    else:
        sync = range(1, count + 1)
    stops = [*sync[1:], count + 1]
    keys = [(ranges[a - 1][0], ranges[b - 2][1]) for a, b in zip(sync, stops) if 0 < a < b <= count + 1]
    return Track(codec, width, height, timescale, duration, ranges, keys)


def payload_of(data: bytes, track: Track) -> bytes:
    return b"".join(data[a:b] for a, b in track.ranges)


def padded(text: bytes) -> bytes:
    """The bytes with spaces up to a positive multiple of the frame size."""
    return text.ljust(max(1, -(-len(text) // FRAME)) * FRAME, b" ")


@F.pandas_udf(T.BinaryType())
def _stored(texts):
    return texts.map(lambda text: container(padded((text or "").encode())))


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
INFO = T.StructType([
    T.StructField("codec", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
    T.StructField("timescale", T.LongType()), T.StructField("duration", T.LongType()), T.StructField("samples", T.LongType()),
    T.StructField("keyframes", T.ArrayType(SPAN)), T.StructField("payload", T.BinaryType()), T.StructField("error", T.StringType()),
])


@F.arrow_udf(INFO)
def _read(files):
    names = INFO.names
    rows = []
    for value in files:
        data = value.as_py()
        if data is None:
            rows.append(dict.fromkeys(names))
            continue
        try:
            t = first_track(data)
        except (ValueError, struct.error, IndexError) as error:
            rows.append(dict.fromkeys(names) | {"error": str(error)})
            continue
        spans = [{"start": a, "end": b} for a, b in t.keys]
        rows.append(dict(zip(names, (t.codec, t.width, t.height, t.timescale, t.duration, len(t.ranges), spans, payload_of(data, t), None))))
    return pa.array(rows, to_arrow_type(INFO))


def store_media(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds the column `media`: each text as a container (a null text is stored as an empty one, which is one frame of spaces).

    A column that already has that name is replaced.
    """
    return df.withColumn(media, _stored(F.col(f"`{text}`")))


def read_media(df: DataFrame, media: str = "media", info: str = "info") -> DataFrame:
    """Adds the struct `info` of each file: codec, size, timescale, duration, samples, key frame byte ranges, payload, error.

    A null file gives nulls in all fields; a broken one gives nulls and `error` says why. The walk reads box headers and sample
    tables only; `payload` is the samples' stored bytes, copied by their ranges.
    """
    return df.withColumn(info, _read(F.col(f"`{media}`")))
