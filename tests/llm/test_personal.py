"""Fixed patterns against a plain version; contexts on planted identifiers."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from weir.llm.personal import bootstrap, find_personal
from weir.llm.queries import op6_personal

KINDS = ("email", "ip", "card", "phone")


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


TEXTS = [
    "é mail a.b%c@d-e.f.g, x@y x@y.z.", "a@b-c.d_e@x.y", "a@b.c@d.e.f", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112",
    "4111111111111111", "12--34 5 6 7", "+1 (980) 555-6268 +49.30.123456. +1 2", "++1 222 333 4444 +", "\x01a@b.c\x01 1.1.1.1\x02", "9" * 400 + "@a.b", "a" * 5000 + " " + "1 " * 3000,
    "😀 10.0.0.1 日本 10.0.0.2\n+44 20 7946 0958", "00000000000000000255.1.1.1",
]


@pytest.mark.parametrize("n", range(len(TEXTS)))
def test_plain_patterns_are_what_is_expected(n):
    assert base(TEXTS[n]) is not None


def test_base_equals_plain(spark, sf):
    got = find_personal(spark.createDataFrame([*enumerate(TEXTS)], "doc_id long, text string")).collect()
    for r in got:
        assert ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["kind"] != "context") == base(TEXTS[r["doc_id"]])
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op6_personal(spark, sf).collect():
        assert r["base_sha256"] == hashlib.sha256(base(texts[r["doc_id"]]).encode()).hexdigest()
        assert set(filter(None, base(texts[r["doc_id"]]).split(","))) <= set(r["spans"].split(","))


def test_contexts_find_the_unseen(spark):
    """Numbers that fail the checksum beside the words that stand beside good ones; other numbers stay."""
    good = [n for n in range(4111111111110000, 4111111111112000) if luhn(str(n))][:60]
    bad = [n for n in range(4111111111115000, 4111111111115100) if not luhn(str(n))][:4]
    rows = [(n, f"please charge card {c} today") for n, c in enumerate(good)] + [(100 + n, f"please charge card {c} today") for n, c in enumerate(bad)]
    rows += [(200 + n, f"the part number {c + 7 * 10**15} is out of stock") for n, c in enumerate(bad)]
    found = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[n] == ["card"] for n in range(60)) and all(found[100 + n] == ["context"] for n in range(4)) and all("context" not in found[200 + n] for n in range(4))


PLANTED = {
    "email": ("mail", [f"und.{n}@mail{n % 7}.example.com" for n in range(45)] + [f"jane.doe{'x' * (n % 9)}@example.com" for n in range(45)], [f"und.{n}.mail{n % 7}.example.com" for n in range(8)]),
    "phone": ("call", [f"+1 (017) 555-{7000 + n}" for n in range(90)], [f"017-555-{7000 + n}" for n in range(8)]),
    "card": ("card", [" ".join(re.findall("....", str(c))) for c in range(4111111111110000, 4111111111113000) if luhn(str(c))][:90], [f"4111-1111-1111-{c}" for c in (1112, 1113, 1114, 1115, 1116, 1117, 1118, 1119)]),
    "ip": ("host", [f"10.0.{n}.7" for n in range(90)], [f"10.0.{n}.777" for n in range(8)]),
}


@pytest.mark.parametrize("kind", KINDS)
def test_every_kind_teaches_contexts(spark, kind):
    """What stands beside seeds of each kind marks candidates that no fixed pattern matches; the same candidates elsewhere stay."""
    word, seeds, candidates = PLANTED[kind]
    rows = [(n, f"so we say {word}: {v} and more text") for n, v in enumerate(seeds)]
    rows += [(1000 + n, f"so we say {word}: {v} and more text") for n, v in enumerate(candidates)] + [(2000 + n, f"version {v} was built") for n, v in enumerate(candidates)]
    found = {r["doc_id"]: r["spans"] for r in find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all([s["kind"] for s in found[n]] == [kind] for n in range(90))
    caught = [[(s["kind"], s["start"], s["end"]) for s in found[1000 + n]] for n in range(8)]
    at = len(f"so we say {word}: ")
    assert caught == [[("context", at, at + len(v))] for v in candidates]
    assert all(found[2000 + n] == [] for n in range(8))


def test_long_identifiers_are_whole(spark):
    """No cut at any length, in a candidate or in the gap before it."""
    value = "a" * 40 + "7" + "-x9" * 60
    rows = [(n, f"key holder 10.1.1.{n}" + " " * 200) for n in range(40)] + [(100, "key holder" + " " * 300 + value + " end")]
    found = {r["doc_id"]: r["spans"] for r in find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s["kind"], s["end"] - s["start"]) for s in found[100]] in ([], [("context", len(value))])
    letters = [(n, f"write holder {chr(97 + n % 26)}{n}@mail.com") for n in range(40)] + [(100, "write holder" + " " * 300 + value + " end")]
    found = {r["doc_id"]: r["spans"] for r in find_personal(spark.createDataFrame(letters, "doc_id long, text string")).collect()}
    assert [(s["kind"], s["end"] - s["start"]) for s in found[100]] == [("context", len(value))]


def test_bootstrap_needs_support(spark):
    rows = [("p", f"s{n}", True) for n in range(20)] + [("p", "new", False), ("rare", "s1", True), ("rare", "other", False), ("q", "new", False)] + [("q", f"o{n}", False) for n in range(5)]
    got = {r["pattern"] for r in bootstrap(spark.createDataFrame(rows, "pattern string, value string, seed boolean")).collect()}
    assert got == {"p"}


def test_odd_rows_and_no_python(spark, odd_docs, no_docs):
    got = find_personal(odd_docs)
    assert got.count() == odd_docs.count() and got.where("doc_id in (1, 2, 3)").where("size(spans) = 0").count() == 3
    assert got.where("doc_id = 6").select(F.to_json("spans")).distinct().count() == 1
    assert find_personal(no_docs).collect() == []
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()
