"""Fill-in-the-middle examples: every text cut at two line ends and put together anew, with exact restoration.

A rolling hash over 32 bytes cuts texts into chunks where their content says so, thus texts with common passages have common
chunks. What a chunk holds (line ends, code points, marks, and its first and last bytes, in which a mark can lie over a border)
is worked out once and remembered under the chunk itself, so a remembered chunk is always the same bytes. The sums of the chunks'
counts tell the number of lines and the chunk of any line end; only in that chunk is a place looked up.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.text import mixed, need

SEED = "7:"
#: Percent of the texts that are rearranged, and of these in the order suffix, prefix, middle.
RATE, SUFFIX_FIRST = 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Chunks end where the ten upper bits of the hash are zero, after at least LEAST and at most MOST bytes.
ENDS = np.uint32(0xFFC00000)
LEAST, MOST = 64, 8192
#: Bytes whose hashes are worked out at once, and bytes of chunks that a Python worker remembers.
SLICE, REMEMBERED = 1 << 20, 32 << 20

_GEAR = (mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
_WINDOW = 32
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
_BORDER = max(map(len, _MARKS)) - 1


def chunk_ends(raw: bytes) -> list[int]:
    """Where the chunks of a text end; the last one ends with the text."""
    data, cuts = np.frombuffer(raw, dtype=np.uint8), []
    for at in range(0, len(data), SLICE):
        left = max(at - _WINDOW + 1, 0)
        h = _GEAR[data[left : at + SLICE]]
        for width in (1, 2, 4, 8, 16):  # the sum of the last 2 * width bytes' values, each shifted by its distance
            h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        here = np.flatnonzero((h & ENDS) == 0) + left + 1
        cuts += here[here > at].tolist()
    out, last = [], 0
    for end in [*cuts, len(raw)]:
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end - last >= LEAST or (end == len(raw) and end > last):
            out.append(end)
            last = end
    return out


class Summary(NamedTuple):
    """What a chunk adds to the counts of a text."""

    line_ends: tuple[int, ...]
    chars: int
    marked: bool
    head: bytes
    tail: bytes


def chars_in(raw: bytes) -> int:
    """Bytes that begin a character."""
    data = np.frombuffer(raw, dtype=np.uint8)
    return int(np.count_nonzero((data & 0xC0) != 0x80))


class Memory(dict):
    """Summaries of chunks by their bytes, up to a bound of remembered bytes."""

    held = 0

    def __missing__(self, chunk: bytes) -> Summary:
        if self.held > REMEMBERED:
            self.clear()
            self.held = 0
        self.held += len(chunk)
        ends = tuple((np.flatnonzero(np.frombuffer(chunk, dtype=np.uint8) == 10) + 1).tolist())
        value = self[chunk] = Summary(ends, chars_in(chunk), any(m in chunk for m in _MARKS), chunk[:_BORDER], chunk[-_BORDER:])
        return value


class Cutter:
    """A text as its chunks' summaries: lines, marks, and places of line ends."""

    def __init__(self, raw: bytes, memory: Memory):
        self.raw, self.ends = raw, [0, *chunk_ends(raw)]
        self.parts = [memory[raw[a:b]] for a, b in pairwise(self.ends)]
        self.lines = [*accumulate((len(p.line_ends) for p in self.parts), initial=0)]
        self.chars = [*accumulate((p.chars for p in self.parts), initial=0)]
        self.n = self.lines[-1] + (bool(raw) and not raw.endswith(b"\n"))

    def marked(self) -> bool:
        border = b""
        for part in self.parts:
            if part.marked or any(m in border + part.head for m in _MARKS):
                return True
            border = (border + part.tail)[-_BORDER:]
        return False

    def place(self, lines: int) -> tuple[int, int]:
        """Bytes and code points before the end of the first so many lines."""
        if lines == 0:
            return 0, 0
        if lines > self.lines[-1]:
            return len(self.raw), self.chars[-1]
        chunk = bisect_left(self.lines, lines) - 1
        inside = self.parts[chunk].line_ends[lines - self.lines[chunk] - 1]
        at = self.ends[chunk]
        return at + inside, self.chars[chunk] + chars_in(self.raw[at : at + inside])


def _draws(id: Column, seed: str) -> list[Column]:
    """Four unsigned 32-bit numbers from the seed and the id (null: nothing) in decimal digits."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, n_chunks long, output string"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]


def fill_in_middle(df: DataFrame, id: str = "doc_id", text: str = "text", seed: str = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row for each row of the input: doc_id, n (lines), form, prefix_chars, middle_chars (code points), n_chunks, output.

    Lines keep their line feed. Two draws from the id choose the line ends that bound the middle, two more whether the text is
    rearranged (`rate` percent) and in which order. Forms: `psm` is `<P>`prefix`<S>`suffix`<M>`middle, `spm` is
    `<S>`suffix`<P>`prefix`<M>`middle, `plain` is the text as it was: an empty or null one, one with a mark in it, one not drawn;
    it has no prefix_chars and middle_chars. Repeated rows give repeated results; a null id stays null and draws as an empty one.
    No input gives no rows. A text is handled whole, in the memory of one task.
    """
    source = need(df, id, text).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    a, b, c, d = _draws(F.col("doc_id"), seed)
    drawn = source.select("doc_id", "text", a.alias("a"), b.alias("b"), (c % 100 < rate).alias("moved"), (d % 100 < suffix_first).alias("turned"))

    def make(batches):
        memory = Memory()
        for batch in batches:
            rows = [_arranged(memory, *row) for row in zip(*(batch.column(k).to_pylist() for k in range(1, 6)))]
            columns = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, _TYPES[1:]))], names=[f.split()[0] for f in RESULT.split(", ")])

    return drawn.mapInArrow(make, RESULT)


def _arranged(memory: Memory, text: str, a: int, b: int, moved: bool, turned: bool) -> tuple:
    raw = text.encode()
    cutter = Cutter(raw, memory)
    n, chunks = cutter.n, len(cutter.parts)
    if not raw or not moved or cutter.marked():
        return n, "plain", None, None, chunks, text
    first, last = sorted((a % (n + 1), b % (n + 1)))
    (left, before), (right, until) = cutter.place(first), cutter.place(last)
    p, m, s = (x.decode() for x in (raw[:left], raw[left:right], raw[right:]))
    output = f"{SUFFIX}{s}{PREFIX}{p}{MIDDLE}{m}" if turned else f"{PREFIX}{p}{SUFFIX}{s}{MIDDLE}{m}"
    return n, "spm" if turned else "psm", before, until - before, chunks, output


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of; no mark can arise where parts meet, since a mark holds `<` only in front."""
    inner = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    second, third = F.instr(output, inner), F.instr(output, F.lit(MIDDLE))
    one, two, three = F.substr(output, F.lit(4), second - 4), F.substr(output, second + 3, third - second - 3), F.substr(output, third + 3)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))
