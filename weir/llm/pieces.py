"""SentencePiece encoding as a relational lattice, and decoding.

A text is cut where no piece of the vocabulary can lie across: before each run of spaces, which are written as `▁`, and between characters that no chain
of neighbours in pieces connects, such as letters and full stops. Each task takes its texts in chunks of
bounded size and passes on the units of a chunk that it has not seen before, then the chunk's texts as numbers of units. It remembers a bounded number of units.
The substrings of a unit that are no longer than the longest piece are exploded and joined to the table of pieces (broadcast), longer ones only where a
piece begins as they do; those that match are the edges of the unit's lattice. Explode and join keep the order of rows, so the edges of a unit come
one after the other, and before the texts that hold it: nothing is shuffled or stored, and what folds the edges holds the ids of the units
remembered and a few texts. A path is folded over the edges, for some thousand units at once:

* for a unigram model the best sum of scores over positions from left to right (Viterbi);
* for a byte-pair model the merges in the order of their scores, where an edge that spans exactly two parts of the present path is a merge. Viterbi over
  a byte-pair model's scores, which are ranks, would give other pieces than the library does.

Characters without a piece become their bytes.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import pickle
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.llm.text import need

SPACE = "▁"
#: Longer units are encoded by the same rule in one function, as a path is kept in the bits of one number.
LONGEST = 60
#: A chunk ends with the text that brings it to so many characters, or the units remembered to so many.
CHUNK_UNITS, CHUNK_CHARACTERS = 400_000, 4_000_000
#: After a chunk that brings the units remembered to CHUNK_UNITS, or to so many characters, they are forgotten.
REMEMBERED_CHARACTERS = 16_000_000
UNITS = "number long, unit string, note binary"
#: Units that are folded at once, and numbers of units after which a note of texts ends with its text.
FOLDED, NOTE_NUMBERS = 10_000, 500_000
#: Longest beginning of a piece that a substring is joined to before it is joined to longer pieces.
HEAD = 4
#: So many kinds of characters are told apart where texts are cut, the rest is one.
CLASSES = 8
#: Bytes of ids after which a batch of results ends with its text.
BATCH_BYTES = 2_000_000
#: Kinds of notes: first number, sizes and code points of the units whose edges follow; first number of the chunk's units (0: forget others) and the longer ones; ids and numbers of units of some texts.
SHORT, LONG, ROWS = range(3)
#: Kinds of pieces in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNIGRAM, BYTE_PAIR = 1, 2
#: What a character without a piece costs in a unigram model beyond the worst piece (fixed value of the format).
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Vocabulary:
    """The pieces of a model file: text, id and score of those that texts can contain; bytes by id; the first byte's id."""

    pieces: tuple[tuple[str, int, float], ...]
    data: tuple[bytes, ...]
    first_byte: int
    kind: int
    cut: re.Pattern
    prefix: bool

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.pieces)


def unit_pattern(pieces: list[str]) -> re.Pattern:
    """What cuts texts into units: signs for spaces with the characters of one kind behind them. Characters are of one kind if they stand side by side in a piece."""
    leads: dict[str, str] = {}

    def lead(char: str) -> str:
        while leads.setdefault(char, char) != char:
            leads[char] = char = leads[leads[char]]
        return char

    for piece in pieces:
        word = piece.lstrip(SPACE)
        for a, b in zip(word, word[1:]):
            leads[lead(a)] = lead(b)
    kinds: dict[str, list[str]] = {}
    for char in sorted(leads):
        kinds.setdefault(lead(char), []).append(re.escape(char))
    sets = ["".join(kind) for kind in sorted(kinds.values(), key=len, reverse=True)[:CLASSES]]
    return re.compile(f"{SPACE}*(?:{''.join(f'[{kind}]+|' for kind in sets)}[^{SPACE}{''.join(sets)}]+)|{SPACE}+")


@functools.cache
def vocabulary(path: str | None = None) -> Vocabulary:
    """The vocabulary of a model file without normalisation and with bytes for unknown characters; others raise ValueError."""
    from sentencepiece import sentencepiece_model_pb2 as model_file

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = model_file.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    normal, kind = model.normalizer_spec, model.trainer_spec.model_type
    if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces:
        raise ValueError(f"{path} normalises texts, which is not supported")
    if kind not in (UNIGRAM, BYTE_PAIR) or not model.trainer_spec.byte_fallback or {p.type for p in model.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError(f"{path} has a kind of model or of pieces that is not supported")
    byte_ids = [n for n, p in enumerate(model.pieces) if p.type == BYTE]
    if byte_ids != [*range(byte_ids[0], byte_ids[0] + 256)]:
        raise ValueError(f"{path} does not have its bytes in order")
    pieces = tuple((p.piece, n, p.score) for n, p in enumerate(model.pieces) if p.type == NORMAL)
    if len(model.pieces) > _ID:
        raise ValueError(f"{path} has more pieces than an edge can name")
    if any(SPACE in p.lstrip(SPACE) for p, _, _ in pieces):
        raise ValueError(f"{path} has pieces over several words")
    data = [b"" if p.type in (UNKNOWN, CONTROL) else bytes([n - byte_ids[0]]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() for n, p in enumerate(model.pieces)]
    return Vocabulary(pieces, tuple(data), byte_ids[0], kind, unit_pattern([p for p, _, _ in pieces]), normal.add_dummy_prefix)


def units(text: str | None, cut: re.Pattern, prefix: bool) -> list[str]:
    """The text cut where no piece can cross, spaces as signs and one in front if the model asks for it."""
    return cut.findall((SPACE if prefix else "") + text.replace(" ", SPACE)) if text else []


class _Places(dict):
    """Numbers for units in the order in which they are first seen."""

    def __missing__(self, unit: str) -> int:
        number = self[unit] = len(self)
        return number


def _units(df: DataFrame, id: str, text: str, v: Vocabulary) -> DataFrame:
    """For each chunk its new units of up to LONGEST characters, FOLDED behind a note on them (a row for each that has two characters or more), then notes of the longer units and of the texts."""

    def split(batches):
        place, known, kept, ids, parts, size = _Places(), 0, 0, [], [], 0  # known, kept: units of earlier chunks and their characters

        def rows(note, numbers=(), names=()):
            none = len(numbers)
            columns = pa.array([None, *numbers], pa.int64()), pa.array([None, *names], pa.string()), pa.array([pickle.dumps(note, protocol=5), *[None] * none], pa.binary())
            return pa.RecordBatch.from_arrays([*columns], schema=schema)

        def chunk():
            nonlocal kept
            names = [*itertools.islice(place, known, None)]
            sizes = np.fromiter(map(len, names), dtype=np.int64, count=len(names))
            if len(names) and sizes.max() > LONGEST:  # longer units have the last numbers
                order = np.argsort(sizes > LONGEST, kind="stable")
                moved = np.arange(known + len(names), dtype=np.uint32)
                moved[known + order] = np.arange(known, known + len(names), dtype=np.uint32)
                names, sizes, parts[:] = [names[n] for n in order], sizes[order], [moved[n] for n in parts]
                place.update(zip(names, range(known, known + len(names))))
            kept += int(sizes.sum())
            short = int((sizes <= LONGEST).sum())
            for first in range(0, short, FOLDED):
                some = names[first : min(first + FOLDED, short)]
                chars = np.frombuffer("".join(some).encode("utf-32-le"), dtype=np.uint32)
                wider = [n for n, name in enumerate(some) if len(name) > 1]
                yield rows((SHORT, known + first, sizes[first : first + len(some)], chars), [known + first + n for n in wider], [some[n] for n in wider])
            yield rows((LONG, known, names[short:]))
            del names
            begin = many = 0
            for end, numbers in enumerate(parts, 1):
                many += len(numbers)
                if many >= NOTE_NUMBERS or end == len(parts):
                    yield rows((ROWS, ids[begin:end], parts[begin:end]))
                    parts[begin:end] = [None] * (end - begin)
                    begin, many = end, 0

        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = units(value.as_py(), cut, prefix)
                parts.append(np.fromiter(map(place.__getitem__, found), dtype=np.uint32, count=len(found)))
                ids.append(doc)
                size += sum(map(len, found))
                if len(place) >= CHUNK_UNITS or size >= CHUNK_CHARACTERS:
                    yield from chunk()
                    if len(place) >= CHUNK_UNITS or kept >= REMEMBERED_CHARACTERS:
                        place, kept = _Places(), 0
                    known, ids, parts, size = len(place), [], [], 0
            batch = value = found = None  # else two batches are held while the next one is read
        if ids:
            yield from chunk()

    cut, prefix = v.cut, v.prefix
    schema = pa.schema([("number", pa.int64()), ("unit", pa.string()), ("note", pa.binary())])
    return need(df, id, text).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(split, UNITS)


def piece_tables(spark: SparkSession, v: Vocabulary) -> tuple[DataFrame, DataFrame]:
    """Beginnings of pieces of 2 to HEAD characters: head, head_id if it is a piece, tries (0 for the head itself, and the lengths of longer pieces from HEAD on); the longer pieces: piece, id."""
    heads: dict[str, tuple[int | None, list[int]]] = {p: (n, [0]) for p, n, _ in v.pieces if 2 <= len(p) <= HEAD}
    longer = [(p, n) for p, n, _ in v.pieces if len(p) > HEAD]
    for p, _ in longer:
        heads.setdefault(p[:HEAD], (None, []))[1].append(len(p))
    rows = [(h, n, sorted({*tries})) for h, (n, tries) in heads.items()]
    return spark.createDataFrame(rows, "head string, head_id long, tries array<int>"), spark.createDataFrame(longer, "piece string, id long")


#: An edge is one number: its unit's number, start (6 bits) and id (21 bits).
_START, _ID = 21, (1 << 21) - 1
_EDGE = f"shiftleft(number, {_START + 6}) | cast((start - 1) * {1 << _START} AS BIGINT) | if(try = 0, head_id, id)"


def lattice(units: DataFrame, v: Vocabulary) -> DataFrame:
    """The edges of over one character of units, in their order. Rows with a `note` pass."""
    heads, longer = (F.broadcast(t) for t in piece_tables(units.sparkSession, v))  # as large as the vocabulary file
    starts = units.select("*", F.explode_outer(F.sequence(F.lit(1), F.length("unit") - 1)).alias("start"))
    left = F.length("unit") - F.col("start") + 1
    spans = starts.select("*", F.explode_outer(F.when(F.col("note").isNull(), F.sequence(F.lit(2), F.least(F.lit(HEAD), left)))).alias("many"))
    parts = spans.withColumn("part", F.expr("substring(unit, start, many)"))
    begun = parts.join(heads, F.col("part") == F.col("head"), "left").where("head IS NOT NULL OR note IS NOT NULL")
    tried = begun.select("number", "unit", "start", "head_id", "note", F.explode_outer("tries").alias("try"))
    whole = tried.withColumn("part", F.when((F.col("try") > 0) & (F.col("try") <= left), F.expr("substring(unit, start, try)")))
    edges = whole.join(longer, F.col("part") == F.col("piece"), "left").where("id IS NOT NULL OR try = 0 OR note IS NOT NULL")
    return edges.select(F.expr(_EDGE).alias("edge"), "note")


def _merges(unit: np.ndarray, start: np.ndarray, end: np.ndarray, rank: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which edges of over one character are parts of the units' paths: of each unit the first edge by rank and place that spans two parts is merged, until none is left."""
    one = np.uint64(1)
    bits = lambda n: one << n.astype(np.uint64)
    path = bits(sizes + 1) - one  # the cuts of each unit
    ends, inner = bits(start) | bits(end), bits(end) - bits(start + 1)
    left = np.lexsort((start, rank, unit))
    while len(left):
        own, between = path[unit[left]], inner[left]
        between &= own
        whole = ((own & ends[left]) == ends[left]) & (between != 0)  # cuts only go: what fails here fails for good
        left, between = left[whole], between[whole]
        ready = left[(between & (between - one)) == 0]
        first = ready[np.flatnonzero(np.diff(unit[ready], prepend=-1))]
        path[unit[first]] &= ~inner[first]
        merged = np.zeros(len(sizes), dtype=bool)
        merged[unit[first]] = True
        left = left[merged[unit[left]]]
    own = path[unit]
    return ((own & ends) == ends) & ((own & inner) == 0)


def _best(unit: np.ndarray, start: np.ndarray, end: np.ndarray, score: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which edges are on the units' paths of greatest score; of equal ones the longer last edge."""
    base = np.cumsum(sizes + 1) - sizes - 1
    best, way = np.zeros(int((sizes + 1).sum())), np.zeros(int((sizes + 1).sum()), dtype=np.int64)
    order = np.lexsort((start, unit, end))
    for step in np.split(order, np.flatnonzero(np.diff(end[order])) + 1):
        sums = best[base[unit[step]] + start[step]] + score[step]
        heads = np.flatnonzero(np.diff(unit[step], prepend=-1))
        most = np.maximum.reduceat(sums, heads)
        hits = np.flatnonzero(sums == np.repeat(most, np.diff(heads, append=len(step))))
        hits = hits[np.flatnonzero(np.diff(unit[step[hits]], prepend=-1))]
        at = (base[unit[step]] + end[step])[hits]
        best[at], way[at] = sums[hits], step[hits]
    taken = np.zeros(len(unit), dtype=bool)
    here, at = np.arange(len(sizes)), sizes.copy()
    while len(here):
        last = way[base[here] + at]
        taken[last] = True
        at = start[last]
        here, at = here[at > 0], at[at > 0]
    return taken


@dataclass
class _Tables:
    """By id: how many characters a piece has, its rank (0 is the best score), its score. By code point: the id of the piece of one character, or -1. What a character without a piece scores."""

    lengths: np.ndarray
    ranks: np.ndarray
    scores: np.ndarray
    single: np.ndarray
    unknown: float

    @classmethod
    def of(cls, v: Vocabulary) -> _Tables:
        lengths, ranks, scores = (np.zeros(len(v.data), dtype=kind) for kind in (np.int64, np.int64, np.float64))
        single = np.full(0x110000, -1, dtype=np.int32)
        for rank, (piece, n, score) in enumerate(sorted(v.pieces, key=lambda p: (-p[2], p[1]))):
            lengths[n], ranks[n], scores[n] = len(piece), rank, score
            if len(piece) == 1:
                single[ord(piece)] = n
        return cls(lengths, ranks, scores, single, min(score for _, _, score in v.pieces) - UNKNOWN_PENALTY)


def folded(edges: np.ndarray, first: int, sizes: np.ndarray, chars: np.ndarray, v: Vocabulary, t: _Tables) -> tuple[np.ndarray, np.ndarray]:
    """Of units from number `first` on, with their sizes and code points and their edges: how many ids each has, and the ids one after the other."""
    base = np.cumsum(sizes) - sizes
    unit, start, ids = (edges >> (_START + 6)) - first, (edges >> _START) & 63, edges & _ID
    length, code = t.lengths[ids], t.single[chars].astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    if v.kind == BYTE_PAIR:
        used = np.flatnonzero(_merges(unit, start, start + length, t.ranks[ids], sizes))
    else:
        place = np.arange(len(chars)) - base[owner]
        scores = np.where(code < 0, t.unknown, t.scores[code])
        used = np.flatnonzero(_best(*map(np.concatenate, ((owner, unit), (place, start), (place + 1, start + length), (scores, t.scores[ids]))), sizes)) - len(chars)
        used = used[used >= 0]
    at = base[unit[used]] + start[used]
    covered = np.zeros(len(chars) + 1, dtype=np.int8)
    covered[at + 1] += 1  # parts share neither starts nor ends
    covered[at + length[used]] -= 1
    begins = np.cumsum(covered, dtype=np.int8)[:-1] == 0
    code[at] = ids[used]
    owner, code, chars = owner[begins], code[begins], chars[begins]
    odd = code < 0
    if odd.any():
        data = [chr(c).encode() for c in chars[odd].tolist()]
        many = np.ones(len(code), dtype=np.int64)
        many[odd] = [*map(len, data)]
        owner, code, odd = np.repeat(owner, many), np.repeat(code, many), np.repeat(odd, many)
        code[odd] = v.first_byte + np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.int64)
    return np.bincount(owner, minlength=len(sizes)), code.astype(np.uint32)


def long_unit(text: str, ranks: dict[str, tuple[int, int]], first_byte: int) -> list[int]:
    """The byte-pair rule for a unit of any length: neighbours merge by rank, then by place, from a heap."""
    parts, right, left = list(text), [*range(1, len(text) + 1)], [*range(-1, len(text) - 1)]
    alive = [True] * len(parts)
    heap: list[tuple[int, int, str]] = []

    def offer(a: int) -> None:
        b = right[a]
        if b < len(parts) and (hit := ranks.get(parts[a] + parts[b])):
            heapq.heappush(heap, (hit[0], a, parts[a] + parts[b]))

    for a in range(len(parts) - 1):
        offer(a)
    while heap:
        _, a, joined = heapq.heappop(heap)
        b = right[a]
        if not alive[a] or b >= len(parts) or parts[a] + parts[b] != joined:
            continue
        parts[a], alive[b], right[a] = joined, False, right[b]
        if right[b] < len(parts):
            left[right[b]] = a
        if left[a] >= 0:
            offer(left[a])
        offer(a)
    out: list[int] = []
    for part, lives in zip(parts, alive):
        if lives:
            out += [ranks[part][1]] if part in ranks else [first_byte + x for x in part.encode()]
    return out


def long_unit_of_scores(text: str, scores: dict[str, tuple[float, int]], longest: int, unknown: float, first_byte: int) -> list[int]:
    """The rule of scores for a unit of any length: the best way to each place, then the ways back."""
    best, way = [0.0], [0]
    for end in range(1, len(text) + 1):
        top, back = best[end - 1] + unknown, end - 1
        for start in range(max(0, end - longest), end):
            if (hit := scores.get(text[start:end])) and (best[start] + hit[0], -start) > (top, -back):
                top, back = best[start] + hit[0], start
        best.append(top)
        way.append(back)
    parts, end = [], len(text)
    while end:
        parts.append(text[way[end] : end])
        end = way[end]
    return [n for part in reversed(parts) for n in ([scores[part][1]] if part in scores else [first_byte + x for x in part.encode()])]


def encode(df: DataFrame, id: str = "doc_id", text: str = "text", model: str | None = None, back: bool = False) -> DataFrame:
    """One row for each row of `df`: doc_id, ids (32-bit little-endian) of its pieces, as the library gives them; with `back` also the text that `decode` makes of the ids.

    A null or empty text has no ids. A null id is kept, repeated rows are encoded alike. No rows give none. Units of over LONGEST
    characters are not in the lattice but take the same rule in a function. With `back`, ids are decoded where they are made and do not go to Python again.
    """
    v = vocabulary(model)
    order = {p: n for n, (p, _, _) in enumerate(sorted(v.pieces, key=lambda p: (-p[2], p[1])))}
    # As large as the vocabulary file.
    shared = df.sparkSession.sparkContext.broadcast((v, {p: (order[p] if v.kind == BYTE_PAIR else s, n) for p, n, s in v.pieces}))

    def gather(batches):
        v, pieces = shared.value
        tables, longest, text_of = _Tables.of(v), v.longest, _decoding(v.data, v.prefix)
        held, short, done = [], None, []  # edges since the last note; its first number, sizes and code points; sizes and ids of the chunk's units before them
        sizes, flat, starts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint32), None  # of all units remembered

        def fold() -> None:
            nonlocal held, short
            if short is not None:
                edges = np.concatenate([np.empty(0, dtype=np.int64), *held])
                number, first, until = edges >> (_START + 6), short[0], short[0] + len(short[1])
                if len(edges) and (number[0] < first or number[-1] >= until or (np.diff(number) < 0).any()):
                    raise RuntimeError("edges came in another order than they were made in")
                done.append(folded(edges, *short, v, tables))
            held, short = [], None

        def long(unit: str) -> np.ndarray:
            return np.array(
                long_unit(unit, pieces, v.first_byte) if v.kind == BYTE_PAIR else long_unit_of_scores(unit, pieces, longest, tables.unknown, v.first_byte), dtype=np.uint32
            )

        def result(docs, out):
            columns = [pa.array(docs, pa.int64()), pa.array(out, pa.binary())]
            return pa.RecordBatch.from_arrays([*columns, pa.array(map(text_of, out), pa.string())] if back else columns, names=names)

        def results(docs, parts):
            found, out, size = [], [], 0
            for doc, mine in zip(docs, parts):
                each = sizes[mine]
                ends = np.cumsum(each)
                total = int(ends[-1]) if len(ends) else 0
                found.append(doc)
                out.append(flat[np.repeat(starts[mine] - (ends - each), each) + np.arange(total)].astype("<u4").tobytes())
                size += 4 * total
                if size >= BATCH_BYTES:
                    yield result(found, out)
                    found, out, size = [], [], 0
            if found:
                yield result(found, out)

        for batch in batches:
            edges, notes, begin = batch.column(0), batch.column(1), 0
            for at in [*np.flatnonzero(notes.is_valid().to_numpy(zero_copy_only=False)).tolist(), len(batch)]:
                if at > begin:
                    held.append(edges.slice(begin, at - begin).to_numpy(zero_copy_only=False).copy())
                begin = at + 1
                if at == len(batch):
                    break
                kind, *note = pickle.loads(notes[at].as_buffer())
                if kind == ROWS:
                    yield from results(*note)
                    continue
                fold()
                if kind == SHORT:
                    short = note
                else:
                    known, longer = note
                    done = [(sizes, flat)] * (known > 0) + done + [(np.array([len(ids)]), ids) for ids in map(long, longer)]
                    if done:  # else all texts are empty
                        sizes, flat = map(np.concatenate, zip(*done))
                    starts, done = np.cumsum(sizes) - sizes, []
            batch = edges = notes = note = None  # else two batches are held while the next one is read

    names = ["doc_id", "ids", *["text"] * back]
    return lattice(_units(df, id, text, v), v).mapInArrow(gather, "doc_id long, ids binary" + ", text string" * back)


def _decoding(data: tuple[bytes, ...], prefix: bool):
    """The function that turns ids (32-bit little-endian) into text; ids of no text give nothing, broken bytes a replacement sign."""

    def text_of(ids: bytes) -> str:
        text = b"".join(map(data.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return (text[1:] if prefix and text[:1] == b" " else text).decode(errors="replace")

    return text_of


def decoder(model: str | None = None):
    """The function that turns a column of ids (32-bit little-endian) into text; ids of no text give nothing, broken bytes a replacement sign."""
    v = vocabulary(model)
    data, prefix = v.data, v.prefix

    def decode(column):
        text_of = _decoding(data, prefix)
        return pa.array((text_of(value.as_py()) if value.is_valid else None for value in column), pa.string())

    return F.arrow_udf(decode, T.StringType())


def decode(ids: Column, model: str | None = None) -> Column:
    """The text of a column of ids; null for null."""
    return decoder(model)(ids)
