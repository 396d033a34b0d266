"""Phrases of two and three words that occur together more often than their parts suggest, for each language.

Counts are streams in sorted order, never tables of hashes. Every task sorts the word triples of its texts (a phrase end counts
as an empty word) and cuts the sorted run at common bounds; one task for each range merges its runs. In that prefix order all
that begins alike stands together, so one walk gives the counts of words, pairs and triples, the left parts of every phrase, and
the best extension of a pair to its right. What is frequent enough goes on in suffix order, in which one lockstep walk over
words, pairs and triples gives the right parts and the best extension to the left.

A word or pair whose triples lie on both sides of a bound is counted in parts; these, at most four for each range, are summed
by themselves. So a word that begins a third of all phrases is spread over as many ranges as its triples fill.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weir.llm.text import need
from weir.session import cut_lineage

#: Occurrences that a phrase needs.
LEAST = 10
#: A phrase goes if a longer one has this share of its occurrences.
COVERED_PERCENT = 50
#: Phrases reported for each language.
TOP = 2000
#: Shares that a language's phrases are ranked in first.
SHARES = 64
#: Text bytes of one sorted range, and words of one sorted run: the memory of a task, not what is counted.
RANGE_BYTES = 8 << 20
RUN_WORDS = 1_000_000
#: Text bytes looked at for the bounds of one range, and the distance of the words taken from them; the sample moves bounds, not counts.
BOUND_BYTES = 64 << 10
BOUND_STEP = 97
LEAST_KEYS = 20
#: Texts are taken apart in slices of about so many bytes.
SLICE = 4 << 20

#: Pieces end at these characters, words at space and tab; the byte 255 is in no text.
_MARK = b"\xff"
_TABLE = bytes(255 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))

RUNS = "range int, lang string, words binary, triples binary, counts binary"
COUNTS = "lang string, level int, x string, y string, z string, a long, lx long, lxy long, longer long, split boolean, split_x boolean, split_xy boolean"


def slices(text: str):
    """The words of a text in lower case (A-Z only), with a mark at each end of a piece, as lists of bounded size."""
    raw = text.encode().lower().translate(_TABLE)
    at = 0
    while at < len(raw):
        end = at + SLICE
        if end < len(raw):  # cut behind a space or mark; a word without end is taken whole
            cut = max(raw.rfind(b" ", at, end), raw.rfind(_MARK, at, end))
            if cut <= at:
                cut = min((c for c in (raw.find(b" ", end), raw.find(_MARK, end)) if c >= 0), default=len(raw) - 1)
            end = cut + 1
        yield raw[at:end].replace(_MARK, b" \xff ").split()
        at = end
    yield [_MARK]


class _Words(dict):
    """Numbers of words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


class Run:
    """The word numbers of some texts by language, and their sorted, counted triples."""

    def __init__(self):
        self.words, self.parts, self.size = _Words({_MARK: 0}), {}, 0

    def add(self, lang: str, text: str) -> None:
        for words in slices(text):
            ids = np.fromiter(map(self.words.__getitem__, words), dtype=np.int64, count=len(words))
            self.parts.setdefault(lang, []).append(ids)
            self.size += len(words)

    def triples(self):
        """For each language: the sorted words, and the sorted distinct triples as places in these from 1 (0: end) with their counts."""
        names = sorted(w for w in self.words if w != _MARK)
        place = np.zeros(len(self.words), dtype=np.int64)
        place[[self.words[w] for w in names]] = np.arange(1, len(names) + 1)
        for lang, parts in self.parts.items():
            a = np.concatenate([*(place[p] for p in parts), [0, 0]])
            x, y, z = a[:-2], a[1:-1], a[2:]
            keep = x > 0
            x, y, z = x[keep], y[keep], np.where(y == 0, 0, z)[keep]
            if len(x):
                yield lang, names, *merged(x, y, z, np.ones(len(x), dtype=np.int64), len(names) + 1)


def merged(x, y, z, n, base):
    """Triples in order, equal ones added up."""
    if base**3 < 1 << 63:
        code = (x * base + y) * base + z
        order = np.argsort(code, kind="stable")  # sorted runs are merged, not sorted anew
        code = code[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    else:
        pair = x * base + y
        order = np.lexsort((z, pair))
        pair, last = pair[order], z[order]
        first = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (last[1:] != last[:-1])])
    pick = order[first]
    return x[pick], y[pick], z[pick], np.add.reduceat(n[order], first)


def _place(names, x, y, z, bound) -> int:
    """The first triple that is not below the bound."""
    lo, hi = 0, len(x)
    for column, word in zip((x, y, z), bound):
        code = bisect_left(names, word) + 1 if word else 0
        found = code == 0 or (code <= len(names) and names[code - 1] == word)
        lo, hi = lo + np.searchsorted(column[lo:hi], code), lo + np.searchsorted(column[lo:hi], code, "right") if found else hi
        if not found or lo == hi:
            return int(lo)
    return int(lo)


def _pack(array) -> bytes:
    return zstandard.compress(np.ascontiguousarray(array).tobytes(), 1)


def _blocks(run: Run, bounds: list[tuple]):
    """The run cut at the bounds: range, language, words, triples, counts."""
    for lang, names, x, y, z, n in run.triples():
        first = bisect_left(bounds, (lang,))
        last = bisect_left(bounds, (lang + "\0",))
        cuts = [0, *(_place(names, x, y, z, b[1:]) for b in bounds[first:last]), len(x)]
        for number, (a, b) in enumerate(pairwise(cuts), first):
            if a < b:
                used, codes = np.unique(np.concatenate((x[a:b], y[a:b], z[a:b], [0])), return_inverse=True)
                yield number, lang, zstandard.compress(b"\t".join(names[c - 1] for c in used[1:].tolist()), 1), _pack(codes[:-1].astype(np.int32)), _pack(n[a:b])


def _texts(df: DataFrame, text: str, lang: str) -> DataFrame:
    source = need(df, text, lang).toDF("text", "lang").select(F.col("text").cast("string"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    return source.where("text is not null and text != ''")


def _bounds(texts: DataFrame, range_bytes: int) -> list[tuple]:
    """Sorted triples that cut all triples into ranges of about `range_bytes` of text, found from a sample."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = total // range_bytes + 1
    if ranges == 1:
        return []

    def taken(rows: DataFrame, distance: int) -> list[tuple]:
        def take(batches):
            skip = 0  # short texts count too: the distance runs on from one text to the next
            for batch in batches:
                found = []
                for text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                    words = [w for part in slices(text) for w in part] + [_MARK, _MARK]
                    for k in range(skip, len(words) - 2, distance):
                        if words[k] != _MARK:
                            x, y, z = words[k : k + 3]
                            found.append((lang, x, y if y != _MARK else b"", z if y != _MARK and z != _MARK else b""))
                    skip = (skip - len(words) + 2) % distance
                columns = zip(*found) if found else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.binary()] * 3))], names=["lang", "x", "y", "z"])

        seen = rows.mapInArrow(take, "lang string, x binary, y binary, z binary")
        return sorted((r["lang"], bytes(r["x"]), bytes(r["y"]), bytes(r["z"])) for r in seen.collect())  # about a hundred for each range

    share = min(1.0, ranges * BOUND_BYTES / total)
    keys = taken(texts.sample(share, 7), BOUND_STEP)
    if len(keys) < LEAST_KEYS * ranges:  # few and long texts: some words of each
        keys = taken(texts, max(1, int(BOUND_STEP / share)))
    return sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []


def counts(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, range_bytes: int = RANGE_BYTES, run_words: int = RUN_WORDS) -> DataFrame:
    """All words, pairs and triples with at least `least` occurrences, and for each language the number of words (level 0).

    lang, level, x, y, z, a (occurrences), lx and lxy (those of the first word and of the first two), longer (of the most
    frequent triple that begins with the pair, if that has `least`).
    """
    texts = _texts(df, text, lang)
    bounds = _bounds(texts, range_bytes)

    def runs(batches):
        run = Run()

        def rows():
            made = list(zip(*_blocks(run, bounds)))
            if made:
                types = (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, types)], names=["range", "lang", "words", "triples", "counts"])

        for batch in batches:
            for body, name in zip(batch.column(0), batch.column(1)):
                run.add(name.as_py(), body.as_py())
                if run.size >= run_words:
                    yield from rows()
                    run = Run()
        yield from rows()

    def merge(batches):
        by_lang: dict[str, list] = {}
        for batch in batches:
            for block in zip(*(c.to_pylist() for c in batch.columns)):
                by_lang.setdefault(block[1], []).append(block[2:])
        for name, blocks in by_lang.items():
            yield from _walk(name, *_union(blocks), least)

    dealt = texts.mapInArrow(runs, RUNS).repartitionById(len(bounds) + 1, F.col("range"))
    walked = cut_lineage(dealt.mapInArrow(merge, COUNTS), "counts")
    parts = walked.where("split").groupBy("lang", "level", "x", "y").agg(F.sum("a").alias("a"), F.max("longer").alias("longer"))
    parts = cut_lineage(parts, "parts")
    one = parts.where("level = 1").select("lang", "x", F.col("a").alias("sum_x"))
    two = parts.where("level = 2").select("lang", "x", "y", F.col("a").alias("sum_xy"))
    again = parts.select("lang", "level", "x", "y", F.lit(None).cast("string").alias("z"), "a", *[F.lit(0).cast("long").alias(c) for c in ("lx", "lxy")], "longer",
                         F.lit(False).alias("split"), (F.col("level") > 1).alias("split_x"), F.lit(False).alias("split_xy"))
    rows = walked.where("not split").unionByName(again).where((F.col("a") >= least) | (F.col("level") == 0))
    whole = rows.where("not split_x")
    mended = (
        rows.where("split_x").join(one, ["lang", "x"]).join(two, ["lang", "x", "y"], "left")
        .withColumns({"lx": F.col("sum_x"), "lxy": F.when(F.col("split_xy"), F.col("sum_xy")).otherwise(F.col("lxy"))})
    )
    return whole.unionByName(mended.select(*whole.columns)).drop("split", "split_x", "split_xy")


def _union(blocks: list[tuple]):
    """The sorted words of all blocks, and all their triples in order."""
    told = [zstandard.decompress(w).split(b"\t") for w, _, _ in blocks]
    names = sorted(set().union(*told))
    place = {w: k for k, w in enumerate(names, 1)}
    columns: list[list] = [[], [], [], []]
    for words, (_, triples, many) in zip(told, blocks):
        codes = np.fromiter((0, *map(place.__getitem__, words)), dtype=np.int64, count=len(words) + 1)
        for column, part in zip(columns, codes[np.frombuffer(zstandard.decompress(triples), dtype=np.int32)].reshape(3, -1)):
            column.append(part)
        columns[3].append(np.frombuffer(zstandard.decompress(many), dtype=np.int64))
    return names, *merged(*map(np.concatenate, columns), len(names) + 1)


def _walk(lang: str, names: list[bytes], x, y, z, n, least: int):
    """Counts of one sorted range: rows of COUNTS."""
    new_x = np.r_[True, x[1:] != x[:-1]]
    new_xy = new_x | np.r_[True, y[1:] != y[:-1]]
    at_x, at_xy = np.flatnonzero(new_x), np.flatnonzero(new_xy)
    in_x, in_xy = np.cumsum(new_x) - 1, np.cumsum(new_xy) - 1
    f_x, f_xy = np.add.reduceat(n, at_x), np.add.reduceat(n, at_xy)
    longer = np.maximum.reduceat(np.where((z > 0) & (n >= least), n, 0), at_xy)
    edge_x, edge_xy = np.zeros(len(at_x), bool), np.zeros(len(at_xy), bool)
    edge_x[[0, -1]] = edge_xy[[0, -1]] = True
    word = np.array([None, *names], dtype=object)

    def rows(level, places, a, lx, lxy, ext, split, split_x, split_xy):
        ids = [word[c[places]] if k < level else np.full(len(places), None) for k, c in enumerate((x, y, z))]
        words = [pa.array(w, pa.binary()).cast(pa.string()) for w in ids]
        longs = [pa.array(np.broadcast_to(v, len(places)), pa.int64()) for v in (a, lx, lxy, ext)]
        flags = [pa.array(np.broadcast_to(v, len(places)), pa.bool_()) for v in (split, split_x, split_xy)]
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(places), pa.string()), pa.array([level] * len(places), pa.int32()), *words, *longs, *flags],
            names=["lang", "level", "x", "y", "z", "a", "lx", "lxy", "longer", "split", "split_x", "split_xy"],
        )

    yield rows(0, np.array([0]), n.sum(), 0, 0, 0, False, False, False)
    pick = np.flatnonzero((f_x >= least) | edge_x)
    yield rows(1, at_x[pick], f_x[pick], 0, 0, 0, edge_x[pick], False, False)
    pick = np.flatnonzero((y[at_xy] > 0) & ((f_xy >= least) | edge_xy))
    of_x = in_x[at_xy[pick]]
    yield rows(2, at_xy[pick], f_xy[pick], f_x[of_x], 0, longer[pick], edge_xy[pick], edge_x[of_x], False)
    pick = np.flatnonzero((z > 0) & (n >= least))
    of_x, of_xy = in_x[pick], in_xy[pick]
    yield rows(3, pick, n[pick], f_x[of_x], f_xy[of_xy], 0, False, edge_x[of_x], edge_xy[of_xy])


SUFFIXED = "lang string, level int, first string, previous string, last string, a long, lx long, lxy long, ryz long, rz long, longer long"


def _suffixes(counted: DataFrame) -> DataFrame:
    """Pairs and triples in suffix order with the counts of their right parts: ryz (the last two words) and rz (the last).

    A range can begin behind the row of its first last word; rz is null there.
    """
    last = F.col("z"), F.col("y"), F.col("x")
    turned = counted.where("level > 0").select(
        "lang", "level", F.when(F.col("level") == 3, F.col("x")).alias("first"),
        F.when(F.col("level") == 3, F.col("y")).when(F.col("level") == 2, F.col("x")).alias("previous"), F.coalesce(*last).alias("last"), "a", "lx", "lxy", "longer",
    )
    ordered = turned.repartitionByRange("lang", "last", "previous").sortWithinPartitions("lang", "last", "previous", "first")

    def walk(batches):
        word = pair = (None, None)  # the key and its count
        held = None  # the pair whose longer phrases are being read

        def give(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

        for batch in batches:
            rows = []
            for lang, level, first, previous, final, a, lx, lxy, longer in zip(*(c.to_pylist() for c in batch.columns)):
                if level < 3 and held:
                    rows.append(tuple(held))
                    held = None
                if level == 1:
                    word = (lang, final), a
                    continue
                rz = word[1] if word[0] == (lang, final) else None
                if level == 2:
                    pair = (lang, final, previous), a
                    held = [lang, 2, None, previous, final, a, lx, None, None, rz, longer]
                else:
                    assert pair[0] == (lang, final, previous)  # a pair is as frequent as any triple with it
                    held[-1] = max(held[-1], a)
                    rows.append((lang, 3, first, previous, final, a, lx, lxy, pair[1], rz, 0))
            if rows:
                yield give(rows)
        if held:
            yield give([tuple(held)])

    return ordered.mapInArrow(walk, SUFFIXED)


_NAMES = [c.split()[0] for c in SUFFIXED.split(", ")]
_TYPES = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[c.split()[1]] for c in SUFFIXED.split(", ")]


def exact_score(left: str, right: str) -> str:
    """SQL of floor(1000000 * a * a / (left * right)), in decimals of 38 digits."""
    a, left, right = (f"cast({c} as decimal(14, 0))" for c in ("a", left, right))
    return f"((cast(1000000 as decimal(7, 0)) * ({a} * {a})) div ({left} * {right}))"


def collocations(
    df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, covered_percent: int = COVERED_PERCENT, top: int | None = TOP,
    range_bytes: int = RANGE_BYTES, run_words: int = RUN_WORDS,
) -> DataFrame:
    """The best phrases of each language: lang, rank (from 1), phrase (words joined by a space), a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at `.,;:!?` and line ends and these into words at space and tab; a null language
    is `und`. `a` is the phrase's count, `l` and `r` those of its two parts at the cut with the lowest score (ties: the first
    cut), `n` all words of the language; the score is floor(1000000 * a * a / (l * r)), in exact decimals up to counts of 10^14.
    A pair that lies within a triple of at least `least` occurrences and `covered_percent` of its own is left out. Order: score,
    a (both falling), phrase in byte order; `top` limits the report (None: all).

    Null and empty texts count nothing; repeated rows count as often as they occur; no input gives no rows.
    """
    counted = cut_lineage(counts(df, text, lang, least, range_bytes, run_words), "counted")
    sided = cut_lineage(_suffixes(counted), "sided")
    ends = counted.where("level = 1").select("lang", F.col("x").alias("last"), F.col("a").alias("end"))
    found = sided.where("rz is not null").unionByName(sided.where("rz is null").drop("rz").join(ends, ["lang", "last"]).withColumnRenamed("end", "rz"))
    near, far = (F.struct(F.expr(exact_score(l, r)).alias("score"), F.expr(l).alias("l"), F.expr(r).alias("r")) for l, r in (("lx", "ryz"), ("lxy", "rz")))
    cut = F.when(F.col("level") == 2, F.struct(F.expr(exact_score("lx", "rz")).alias("score"), F.col("lx").alias("l"), F.col("rz").alias("r"))).otherwise(
        F.when(near["score"] <= far["score"], near).otherwise(far)
    )
    kept = found.where((F.col("level") == 3) | (F.col("longer") * 100 < F.col("a") * covered_percent)).select(
        "lang", F.concat_ws(" ", "first", "previous", "last").alias("phrase"), "a", cut.alias("cut")
    ).select("lang", "phrase", "a", "cut.*")
    best_first = [F.desc("score"), F.desc("a"), F.col("phrase")]
    if top is not None:  # the best of each share of a language's phrases, so that the last ranking sees at most SHARES * top
        share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
        kept = kept.withColumn("place", F.row_number().over(Window.partitionBy("lang", share).orderBy(*best_first))).where(F.col("place") <= top).drop("place")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best_first)).cast("long"))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    words = counted.where("level = 0").groupBy("lang").agg(F.sum("a").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
