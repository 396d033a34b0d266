"""Personal data: fixed patterns, and identifiers found by the company they keep.

The matches of the fixed patterns are the seeds, whole and with the words that stand before and after them. Every other
identifier-like string of the corpus is a candidate. Seeds and candidates are instances; the word to the left or right of an instance, with its
shape or with no more than whether it has letters, is one of its patterns. Instances and patterns are the two sides of a graph with counts on its edges. In each round a pattern's confidence is
the share of its occurrences that are trusted, and an instance is trusted as far as the confident patterns around it say so. Patterns that
end up confident, and were seen with several seeds, mark the unseen identifiers beside their words.

All of it is column functions, joins and aggregations; a text is looked at where it is read, and only spans, words and counts move on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.text import need
from weir.session import cut_lineage

KINDS = ("email", "ip", "card", "phone", "context")
#: Signs that stand around matches while a text is cut; the first is replaced in texts, which no pattern contains.
_EDGE, _SPARE = "\u0001", "\u0002"
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


@dataclass(frozen=True)
class Pattern:
    """A kind's pattern, a test that texts with a match pass, and what a match must fulfil.

    The patterns are those of the contract, made to start only where a match can begin and never to step back, which
    changes no match and keeps long runs of one class of characters linear.
    """

    regex: str
    hint: str

    def valid(self, kind: str, match: Column) -> Column:
        if kind == "ip":
            return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
        if kind == "card":
            digits = F.regexp_replace(match, "[^0-9]", "")
            return F.when(F.length(digits).between(12, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False))
        if kind == "phone":
            return F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)
        return F.lit(True)


PATTERNS = {
    "email": Pattern(r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@[A-Za-z0-9-]"),
    "ip": Pattern(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": Pattern(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]"),
    "phone": Pattern(r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
#: What may be an identifier: letters, digits and signs between them, with a digit, of any length from LEAST_LENGTH on.
INSTANCE = Pattern(r"(?<![A-Za-z0-9@._/-])[A-Za-z@._/-]*+[0-9][A-Za-z0-9]*+(?:[@._/-]++[A-Za-z0-9]++)*+", "[0-9]")
LEAST_LENGTH = 6
#: White space, for the ends of words.
_BLANKS = "\t\n\x0b\f\r"

ROUNDS = 3
LEAST_CONFIDENCE = 0.8
LEAST_SEEDS = 3


def _cut(text: Column, pattern: Pattern) -> Column:
    """The text cut at a pattern's matches: gap, match, gap and so on; null where there is none."""
    marked = F.regexp_replace(F.translate(text, _EDGE, _SPARE), f"({pattern.regex})", f"{_EDGE}$1{_EDGE}")
    return F.when(text.rlike(pattern.hint), F.split(marked, _EDGE))


def _spans(parts: Column) -> Column:
    """(start, end, value, word before, word after) of the matches in cut parts, in code points; empty for null."""
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(state: Column, i: Column) -> Column:
        gap, value = F.get(parts, i), F.get(parts, i + 1)
        start = state["at"] + F.length(gap)
        end = start + F.length(value)
        before, after = (F.translate(g, _BLANKS, " " * len(_BLANKS)) for g in (gap, F.get(parts, i + 2)))
        span = F.struct(
            start.alias("start"), end.alias("end"), value.alias("value"),
            F.substring_index(F.rtrim(before), " ", -1).alias("before"), F.substring_index(F.ltrim(after), " ", 1).alias("after"),
        )
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(span)).alias("found"))

    found = F.aggregate(F.sequence(F.lit(0), F.size(parts) - 3, F.lit(2)), zero, step, lambda s: s["found"])
    return F.when(F.size(parts) > 1, found).otherwise(none)


def _base(cuts: dict[str, Column]) -> Column:
    """The valid spans of the fixed patterns by start, then by kind as listed: (start, order, end, value, before, after)."""
    arrays = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        arrays.append(F.transform(_valid(_spans(cuts[kind]), kind, pattern), _placed(order)))
    return F.array_sort(F.concat(*arrays))


def _valid(spans: Column, kind: str, pattern: Pattern) -> Column:
    return F.filter(spans, lambda s: pattern.valid(kind, s["value"]))


def _placed(order: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), *[s[c].alias(c) for c in ("end", "value", "before", "after")])


def _beside(word: Column) -> Column:
    """A word beside an instance, in lower case without signs at its ends; `^` where there are no letters, as at the ends of a text."""
    word = F.lower(F.regexp_replace(word, r"^[^\p{L}]++|[^\p{L}]++$", ""))
    return F.when(word == "", "^").otherwise(word)


def _shape(value: Column) -> Column:
    """The value with letters and digits made alike: runs of letters as a, each digit as 9."""
    return F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), "[A-Za-z]+", "a")


def _with_spans(df: DataFrame, id: str, text: str) -> DataFrame:
    """row, doc_id, base spans and instances of each row, written so that row numbers stay."""
    rows = need(df, id, text).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = rows.select("doc_id", *[_cut(F.col("text"), p).alias(k) for k, p in PATTERNS.items()], _cut(F.col("text"), INSTANCE).alias("instance"))
    long = F.filter(_spans(F.col("instance")), lambda s: F.length(s["value"]) >= LEAST_LENGTH)
    spans = cuts.select("doc_id", _base({k: F.col(k) for k in PATTERNS}).alias("base"), long.alias("seen"))
    return cut_lineage(spans.select(F.monotonically_increasing_id().alias("row"), "*"), "spans")


def bootstrap(instances: DataFrame, rounds: int = ROUNDS, confidence: float = LEAST_CONFIDENCE, seeds: int = LEAST_SEEDS) -> DataFrame:
    """The patterns to believe in, from occurrences (pattern, value, seed): one row for each pattern, with its confidence."""
    edges = cut_lineage(instances.groupBy("pattern", "value").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "edges")
    trusted = edges.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("trust"))
    for _ in range(rounds):
        # two doubtful occurrences more, so that rare patterns are not believed
        sure = edges.join(trusted, "value").groupBy("pattern").agg(
            (F.sum(F.col("n") * F.col("trust")) / (F.sum("n") + 2)).alias("confidence"), F.sum(F.col("seed").cast("long")).alias("seeds")
        )
        sure = cut_lineage(sure, "patterns")
        doubt = F.sum(F.when(F.col("confidence") >= confidence, F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))).otherwise(F.lit(0.0)))
        trusted = edges.join(sure, "pattern").groupBy("value").agg(F.greatest(F.max(F.col("seed").cast("double")), 1 - F.exp(doubt)).alias("trust"))
        trusted = cut_lineage(trusted, "instances")
    return sure.where((F.col("confidence") >= confidence) & (F.col("seeds") >= seeds)).select("pattern", "confidence")


def find_personal(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `df`: doc_id, spans (start, end, kind), by start and then in the order of KINDS.

    Spans are in code points, end exclusive. A null text is an empty one and has no spans. Repeated rows have equal spans; what they
    say counts as often as they occur. A null id is kept. No rows give none.
    """
    rows = _with_spans(df, id, text)
    free = F.filter("seen", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))

    def occurrences(spans: Column, seed: bool) -> DataFrame:
        one = rows.select("row", F.explode(spans).alias("s")).select("row", "s.start", "s.end", "s.value", "s.before", "s.after")
        words = [F.concat(F.lit(f"{side} "), _beside(F.col(c))) for side, c in (("left", "before"), ("right", "after"))]
        forms = [_shape(F.col("value")), F.when(F.col("value").rlike("[A-Za-z]"), "letters").otherwise("digits")]
        return one.select("row", "start", "end", "value", F.lit(seed).alias("seed"), F.array(*[F.concat_ws(" ", w, f) for w in words for f in forms]).alias("patterns"))

    both = occurrences(F.col("base"), True).unionAll(occurrences(free, False))
    linked = both.select("row", "start", "end", "value", "seed", F.explode("patterns").alias("pattern"))
    linked = cut_lineage(linked, "occurrences")
    believed = bootstrap(linked.select("pattern", "value", "seed"))
    fresh = linked.where("not seed").join(believed.select("pattern"), "pattern", "left_semi").select("row", "start", "end").distinct()
    order = F.lit(len(PATTERNS)).alias("order")
    found = fresh.groupBy("row").agg(F.collect_list(F.struct("start", order, "end")).alias("more"))
    plain = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["order"].alias("order"), b["end"].alias("end")))
    merged = F.array_sort(F.concat(plain, F.coalesce("more", F.array().cast("array<struct<start:int,order:int,end:int>>"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    named = F.transform(merged, lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"), F.get(names, s["order"]).alias("kind")))
    return rows.join(found, "row", "left").select("doc_id", named.alias("spans"))


def joined(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """The spans of some kinds as kind:start:end, comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.concat_ws(",", F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
