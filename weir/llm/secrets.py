"""Secret scans: fixed patterns, and strings that look random to a pair of character Markov models.

One model stands for random strings, the other for ordinary identifiers; a run of identifier characters is a secret if the first
explains it better, by a margin that grows with its length. Both learn from the corpus: the values that the fixed patterns find are the samples
labelled secret, all other runs are labelled ordinary. Both are chains over letters without case, where a change of case or between
letters and digits starts anew, and over the kinds of characters, so that camelCase and numbered names are ordinary however seldom one pair
of characters is. The model of random strings is half its samples and half fair draws from the smallest alphabet that holds the run.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.llm.text import need
from weir.session import small_batches

#: The patterns (fixed values); a match of `assign` counts if its second group has 8 characters.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
HINTS = ("password", "passwd", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "markov")
LEAST_VALUE = 8

#: Kinds of characters of a run; 0 is any byte outside of runs. `/`, `-` and `.` stand between runs.
OUTSIDE, LOWER, UPPER, DIGIT, OTHER = range(5)
_SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789+_"
LETTERS, SHAPES = len(_SYMBOLS) + 1, 5
_FOLD, _SHAPE = np.zeros(256, dtype=np.int16), np.zeros(256, dtype=np.int16)
for _n, _c in enumerate(_SYMBOLS, 1):
    _FOLD[ord(_c)] = _FOLD[ord(_c.upper())] = _n
    _SHAPE[ord(_c)] = LOWER if _c.isalpha() else DIGIT if _c.isdigit() else OTHER
    _SHAPE[ord(_c.upper())] = UPPER if _c.isalpha() else _SHAPE[ord(_c)]
_JOINED = (_SHAPE > 0) | (np.arange(256) == ord("/"))
_BEYOND_HEX = np.zeros(256, dtype=bool)
_BEYOND_HEX[[*b"ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ"]] = True
#: Signs that may lie within one secret, between two runs that are both judged to be one.
JOINTS = b"/-+=."
#: Identifiers of 32 hexadecimal digits in this form are names, not secrets.
UUID = re.compile(rb"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")

#: The models judge runs of so many characters and learn from runs of so many.
LEAST_RUN, LEAST_LEARNT = 12, 5
#: A run is a secret from this natural logarithm of the likelihood ratio on: one part for its being a secret at all, one for each character.
PRIOR, RATE = 6.0, 0.45
#: Observations that the frequency of a character alone stands for beside those of the pair, and the share of a fair draw in both models.
BACK_OFF, FAIR = 20.0, 0.05
#: What both models know before they have seen anything: a kind of character tends to last.
STAYING = 200
#: Bytes of text handled at once.
CHUNK = 2_000_000

SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.LongType()),
]))
Span = tuple[int, int, int, int]


def base_spans(text: str) -> list[Span]:
    """(kind's number, start, end, start of the secret itself) of the fixed patterns, in code points, by start and kind."""
    found: list[Span] = []
    lower = text.lower()
    if any(hint in lower for hint in HINTS):
        found += [(0, m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m.start()) for m in ACCESS.finditer(text)]
    found += [(2, m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def _within(starts: np.ndarray, ends: np.ndarray, chosen: np.ndarray, size: int) -> np.ndarray:
    """Whether each byte lies in one of the chosen ranges, which do not overlap."""
    change = np.zeros(size + 1, dtype=np.int8)
    change[starts[chosen]] += 1
    change[ends[chosen]] -= 1
    return np.cumsum(change[:-1], dtype=np.int8) > 0


def steps(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each byte: the letter before it (0 where a word starts), its letter, the kind before it, its kind. Runs without small letters count as small ones."""
    raw = np.frombuffer(data, dtype=np.uint8)
    fold, shape = _FOLD[raw], _SHAPE[raw]
    starts, ends = runs(shape, 1)
    small = np.concatenate(([0], np.cumsum(shape == LOWER, dtype=np.int32)))
    shape[_within(starts, ends, small[starts] == small[ends], len(shape)) & (shape == UPPER)] = LOWER
    before, kind = np.zeros_like(fold), np.zeros_like(shape)
    before[1:], kind[1:] = fold[:-1], shape[:-1]
    fresh = (shape != kind) & ~((kind == UPPER) & (shape == LOWER))
    before[fresh] = 0
    return before, fold, kind, shape


def runs(shape: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of at least so many characters."""
    inside = np.concatenate(([False], shape > 0, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    wide = ends - starts >= least
    return starts[wide], ends[wide]


def step_counts(data: bytes, least: int = LEAST_LEARNT) -> np.ndarray:
    """How often each letter follows each other one in runs, and then the same of the kinds of characters."""
    before, letter, kind, shape = steps(data)
    starts, ends = runs(shape, least)
    used = _within(starts, ends, np.ones(len(starts), dtype=bool), len(data))
    letters = np.bincount(before[used] * LETTERS + letter[used], minlength=LETTERS**2)
    return np.concatenate([letters, np.bincount(kind[used] * SHAPES + shape[used], minlength=SHAPES**2)])


def chances(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the chance of each letter after each other one, within its kind of character, and of each kind after each other one."""

    def smooth(table: np.ndarray, groups: list[slice]) -> np.ndarray:
        out = np.zeros(table.shape)
        for group in groups:
            part = table[:, group].astype(float)
            alone = (part.sum(axis=0) + 0.5) / (part.sum() + 0.5 * part.shape[1])
            part = part + BACK_OFF * alone
            out[:, group] = np.log((1 - FAIR) * part / part.sum(axis=1, keepdims=True) + FAIR / part.shape[1])
        return out

    letters = counts[: LETTERS**2].reshape(LETTERS, LETTERS)
    shapes = counts[LETTERS**2 :].reshape(SHAPES, SHAPES) + STAYING * np.eye(SHAPES, dtype=np.int64)
    return smooth(letters, [slice(1, 27), slice(27, 37), slice(37, LETTERS)]), smooth(shapes, [slice(1, SHAPES)])


class Judge:
    """The two models: one learnt from ordinary runs, one from secrets, both given as step counts."""

    def __init__(self, ordinary: np.ndarray, secret: np.ndarray):
        self.ordinary, self.secret = chances(ordinary), chances(secret)

    def ratios(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the runs that are long enough, then of those with `/` within, and the log-likelihood ratio of each."""
        raw = np.frombuffer(data, dtype=np.uint8)
        wide = runs(_JOINED[raw], LEAST_RUN)
        if not len(wide[0]):
            return *wide, np.empty(0)
        places = np.flatnonzero(_within(wide[0], np.minimum(wide[1] + 1, len(raw)), np.ones(len(wide[0]), dtype=bool), len(raw)))
        starts, ends, ratios = self._of_runs(raw[places])  # the wide runs alone, each with the byte behind it
        return places[starts], places[ends - 1] + 1, ratios

    def _of_runs(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slash = raw == 47
        starts, ends = runs(_SHAPE[raw], LEAST_RUN)
        wide = runs(_JOINED[raw], LEAST_RUN)
        slashes = np.concatenate(([0], np.cumsum(slash)))
        joined = slashes[wide[1]] > slashes[wide[0]]
        starts, ends = np.concatenate((starts, wide[0][joined])), np.concatenate((ends, wide[1][joined]))
        before, letter, kind, shape = steps(raw.tobytes())

        def total(of: np.ndarray) -> np.ndarray:
            sums = np.concatenate(([0], np.cumsum(of)))
            return sums[ends] - sums[starts]

        plain, drawn = (total(letters[before, letter] + shapes[kind, shape]) for letters, shapes in (self.ordinary, self.secret))
        has = {k: total(_SHAPE[raw] == k) > 0 for k in (LOWER, UPPER, DIGIT, OTHER)}
        beyond = total(_BEYOND_HEX[raw]) > 0
        letters = np.where(beyond, 26, 6) * (has[LOWER].astype(int) + has[UPPER])
        size = np.maximum(letters + 10 * (has[DIGIT] | has[OTHER]) + 2 * has[OTHER], 10)
        fair = -(ends - starts) * np.log(size)
        return starts, ends, np.logaddexp(drawn, fair) - np.log(2) - plain


def model_spans(text: str, taken: list[Span], judge: Judge) -> list[Span]:
    """Runs that the models call secret and that no fixed pattern touches; those with one joint between them are one.

    Runs with `/` within are secrets only where none of their parts is one, so a random part of a path does not take the path with it.
    """
    data = text.encode()
    starts, ends, ratios = judge.ratios(data)
    parts: list[list[int]] = []
    wide: list[list[int]] = []
    for n in np.flatnonzero(ratios >= PRIOR + RATE * (ends - starts)):
        start, end = int(starts[n]), int(ends[n])
        if end - start == 12 and UUID.fullmatch(data, max(0, start - 24), end):
            continue
        if b"/" in data[start:end]:
            wide.append([start, end])
        elif parts and start == parts[-1][1] + 1 and data[start - 1] in JOINTS:
            parts[-1][1] = end
        else:
            parts.append([start, end])
    apart = {start for start, _ in parts}
    parts = sorted(parts + [[a, b] for a, b in wide if not any(a <= x < b for x in apart)])
    found = []
    for start, end in parts:
        at = len(data[:start].decode())
        if not any(a < at + end - start and at < b for _, a, b, _ in taken):
            found.append((3, at, at + end - start, at))
    return found


def _learn(texts: DataFrame) -> Judge:
    """Both models from the steps of all texts; the driver gets one row for each pair of letters or kinds."""

    def count(batches):
        size = LETTERS**2 + SHAPES**2
        ordinary, secret = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        for batch in batches:
            waiting, held = [], 0
            for value in batch.column(0):
                text = value.as_py() or ""
                for _, _, end, start in base_spans(text):
                    secret += step_counts(text[start:end].encode(), 1)
                    text = text[:start] + "\0" * (end - start) + text[end:]
                waiting.append(text.encode())
                held += len(waiting[-1])
                if held >= CHUNK:
                    ordinary += step_counts(b"\0".join(waiting))
                    waiting, held = [], 0
            ordinary += step_counts(b"\0".join(waiting))
        used = np.flatnonzero(ordinary + secret)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (used, ordinary[used], secret[used])], names=["step", "ordinary", "secret"])

    rows = texts.select("text").mapInArrow(count, "step long, ordinary long, secret long").groupBy("step").agg(F.sum("ordinary"), F.sum("secret")).collect()
    counts = np.zeros((2, LETTERS**2 + SHAPES**2), dtype=np.int64)
    for step, plain, drawn in rows:
        counts[:, step] = plain, drawn
    return Judge(*counts)


def finder(df: DataFrame, text: str = "text") -> Callable[[Column], Column]:
    """The function that gives the spans of a text column, with models of all texts of `df`; it can be used beside any other columns."""
    small_batches(df.sparkSession)
    texts = need(df, text).toDF("text").select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(_learn(texts))

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        judge = shared.value
        for texts in batches:
            rows = []
            for text in texts:
                spans = base_spans(text or "")
                spans = sorted(spans + model_spans(text or "", spans, judge), key=lambda s: (s[1], s[0]))
                rows.append([{"kind": KINDS[k], "start": a, "end": b, "value": v} for k, a, b, v in spans])
            yield pd.Series(rows, dtype=object)

    return F.pandas_udf(scan, SPANS)


def find_secrets(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `df`: doc_id, text, spans (kind, start, end, value: where the secret itself starts).

    Spans are in code points, end exclusive, by start and then in the order of KINDS. UUIDs and runs of decimal digits are not called secret by the models. A null text is an empty one and has no spans;
    repeated rows have equal spans; a null id is kept. No rows give none.
    """
    texts = need(df, id, text).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.withColumn("spans", finder(df, text)(F.col("text")))


def joined_spans(spans, *kinds: str):
    """The column `spans` as kind:start:end, comma-joined; only of `kinds` if any are named."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.concat_ws(",", F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def redacted(text, spans, mark: str = "<secret>"):
    """The column `text` with the secret of each span replaced; spans that overlap become one mark."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(state, span):
        fresh = span["value"] >= state["at"]
        piece = F.substring(text, (state["at"] + 1).cast("int"), (span["value"] - state["at"]).cast("int"))
        out = F.when(fresh, F.concat(state["out"], piece, F.lit(mark))).otherwise(state["out"])
        return F.struct(out.alias("out"), F.greatest(state["at"], span["end"]).alias("at"))

    ordered = F.array_sort(spans, lambda a, b: F.when(a["value"] < b["value"], -1).when(a["value"] > b["value"], 1).otherwise(0))
    done = F.aggregate(ordered, start, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
