"""JSON arrays, newline-delimited JSON, and records found at a path inside larger documents."""

from __future__ import annotations

import re
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weir.errors import ValidationError
from weir.operators.project import flatten_once
from weir.session import cut_lineage
from weir.sources.splits import by_split, cut_alike, joined_fragments, read_lines


def read_ndjson(spark: SparkSession, path: str, schema: str | None = None, flatten: bool = True) -> DataFrame:
    """One object per line, splittable; a bad line fails the read."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    # FAILFAST applies to the read; lines that are blank are skipped by Spark itself.
    rows = reader.json(path, mode="FAILFAST")
    return flatten_once(rows) if flatten else rows


def variant_path(path: str | None) -> str:
    return "$" + "".join(f"['{s}']" for s in (path or "").split(".") if s)


def records_of(bodies: DataFrame, body: str, path: str | None = None, strict: bool = True) -> DataFrame:
    """Explodes the array at `path` of each JSON text into one `record` variant per element.

    `strict` fails on text that is not JSON and on a path that is not an array; otherwise both give no rows.
    """
    document = F.parse_json(F.col(body)) if strict else F.try_parse_json(F.col(body))
    found = F.try_variant_get(document, variant_path(path), "array<variant>")
    if strict:
        what = f'Path "{path}" did not resolve to an array' if path else "Expected a JSON array of records"
        found = F.when(found.isNull(), F.raise_error(F.lit(what)).cast("array<variant>")).otherwise(found)
    return bodies.withColumn("record", F.explode(found)).drop(body)


def _struct_ddl(schema: str) -> str:
    """The schema text of a variant as a DDL type; columns that were only ever null become text."""
    return re.sub(r"\bVOID\b", "STRING", schema.replace("OBJECT<", "STRUCT<"))


def typed_records(records: DataFrame, column: str = "record", schema: str | None = None, flatten: bool = True) -> DataFrame:
    """Gives variant records columns. The schema is aggregated over all records unless it is given.

    Objects become columns, one level flattened; anything else becomes a `value` column.
    """
    record = F.col(column)
    others = [c for c in records.columns if c != column]
    if schema is None:
        # One row with one short text: the merged shape of all records.
        is_object = F.schema_of_variant(record).startswith("OBJECT")
        shape = records.agg(
            F.schema_of_variant_agg(F.when(is_object, record)).alias("objects"),
            F.schema_of_variant_agg(F.when(~is_object, record)).alias("values"),
        ).head()
        parts: list[Column] = []
        if shape.objects and shape.objects != "VOID" and "<>" not in shape.objects:
            parts.append(F.try_variant_get(record, "$", _struct_ddl(shape.objects)).alias("object"))
        if shape["values"] and shape["values"] != "VOID":
            parts.append(F.when(~is_object, F.try_variant_get(record, "$", _struct_ddl(shape["values"]))).alias("value"))
        elif not parts:
            parts.append(record.cast("string").alias("value"))
        typed = records.select(*others, *parts)
    else:
        typed = records.select(*others, F.try_variant_get(record, "$", schema).alias("object"))
    if "object" not in typed.columns:
        return typed
    opened = typed.select(*others, "object.*", *[c for c in ("value",) if c in typed.columns and c not in others])
    return flatten_once(opened) if flatten else opened


def read_json(spark: SparkSession, path: str, record_path: str | None = None, schema: str | None = None) -> DataFrame:
    """Documents that are arrays, or hold one at `record_path`.

    A file that is one array and larger than a split is read by many tasks (see `array_elements`). Other documents are parsed
    whole, each in one task; large data with a record path belong in NDJSON.
    """
    large: list[str] = []
    documents = spark.read.text(path, wholetext=True)
    if record_path is None:
        split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
        size = F.col("_metadata.file_size")
        # only names and sizes: the pieces of a file are counted, not its content
        listed = spark.read.format("binaryFile").load(path).where(F.col("length") > split).select("path").collect()
        large = sorted(r["path"] for r in listed)
        documents = documents.where(size <= split)
    records = records_of(documents.withColumnRenamed("value", "body"), "body", record_path)
    if large:
        elements = array_elements(spark, [unquote(f) for f in large]).select(F.parse_json("text").alias("record"))
        whole_files = sorted(spark.read.text(path, wholetext=True).inputFiles())
        records = elements if len(whole_files) == len(large) else records.select("record").unionByName(elements)
    return typed_records(records, schema=schema)


# ---- arrays read by many tasks

_STRING = re.compile(r'"(?:[^"\\]++|\\.)*+"', re.S)
_STRING_END = re.compile(r'(?:[^"\\]++|\\.)*+"', re.S)
_MARK = re.compile(r'"(?:[^"\\]++|\\.)*+"|["\[\]{},]', re.S)


def _moved(text: str, within: bool) -> tuple[bool, int]:
    """Whether the text ends within a string, and how much deeper it ends, if it begins within a string or outside."""
    if within:
        end = _STRING_END.match(text)
        if end is None:
            return True, 0
        text = text[end.end() :]
    bare, quote, _ = _STRING.sub("", text).partition('"')
    return bool(quote), bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]")


def array_elements(spark: SparkSession, files: list[str]) -> DataFrame:
    """The elements (text, file) of files that are one JSON array each, however few lines they have.

    The files are cut behind closing braces. Whether a split begins within a string, and how deep, follows from all splits before
    it: each is summed up for both ways it can begin, and the sums, one row for each split, are combined in order. Then every task
    finds the borders of the elements in its splits; elements over a border are put together from fragments.
    """
    pieces = read_lines(spark, files, "}")

    def sum_up(batches):
        for (file, split), values in by_split(batches):
            (a, low), (b, high) = (False, 0), (True, 0)
            for value in values:
                a, down = _moved(value + "}", a)
                b, up = _moved(value + "}", b)
                low, high = low + down, high + up
            yield pa.RecordBatch.from_pydict({
                "file": [file], "split": pa.array([split], pa.int64()), "a": [a], "low": pa.array([low], pa.int64()), "b": [b], "high": pa.array([high], pa.int64()),
            })

    sums = pieces.mapInArrow(sum_up, "file string, split long, a boolean, low long, b boolean, high long")
    starts: dict[tuple[str, int], tuple[bool, int]] = {}
    state: dict[str, tuple[bool, int]] = {}

    def cut(batches):
        for (file, split), values in by_split(batches):
            cutter = _Elements(*starts[file, split], split == 0)
            rows = []
            for value in values:
                rows += cutter.add(value + "}")
                if len(rows) >= 4096:
                    yield _batch(file, split, rows)
                    rows = []
            rows += cutter.rest()
            if rows:
                yield _batch(file, split, rows)

    with cut_alike(spark):
        for row in sums.orderBy("file", "split").toLocalIterator():  # a few numbers for each split
            within, depth = starts[row["file"], row["split"]] = state.get(row["file"], (False, 0))
            state[row["file"]] = (row["b"], depth + row["high"]) if within else (row["a"], depth + row["low"])
        staged = cut_lineage(pieces.mapInArrow(cut, "text string, file string, split long, place int, first boolean"), "elements")
    joined = joined_fragments(staged.where("place <> 1"), "").where("trim(text) <> ''")
    return staged.where("place = 1").select("text", "file").unionByName(joined.select("text", "file"))


class _Elements:
    """Finds elements, which lie between commas at depth 1, in pieces of one split."""

    def __init__(self, within: bool, depth: int, begins: bool):
        self.within, self.depth, self.begins = within, depth, begins
        self.held: list[str] = []
        self.head = not begins  # what is held began in an earlier split

    def add(self, text: str) -> list[tuple[str, int, bool]]:
        if self.begins and text.strip():
            if not text.lstrip("\ufeff \t\r\n").startswith("["):
                raise ValueError("Expected a JSON array of records")
            self.begins = False
        out, at, left = [], 0, 0
        if self.within:
            end = _STRING_END.match(text)
            if end is None:
                self.held.append(text)
                return out
            at, self.within = end.end(), False
        for found in _MARK.finditer(text, at):
            mark = found.group()
            if mark == '"':
                self.within = True  # a string that ends in another piece
                break
            if mark in "[{":
                self.depth += 1
                if self.depth == 1:
                    left = found.end()
            elif mark in "]}":
                self.depth -= 1
                if self.depth == 0:
                    out += self._element(text[left : found.start()])
                    left = len(text)
            elif mark == "," and self.depth == 1:
                out += self._element(text[left : found.start()])
                left = found.end()
        if self.depth > 0 or self.within:
            self.held.append(text[left:])
        return out

    def _element(self, last: str) -> list[tuple[str, int, bool]]:
        text, head = "".join(self.held) + last, self.head
        self.held, self.head = [], False
        return [(text, 0 if head else 1, False)] if head or text.strip() else []

    def rest(self) -> list[tuple[str, int, bool]]:
        text = "".join(self.held)
        return [(text, 0 if self.head else 2, False)] if self.held else []


def _batch(file: str, split: int, rows: list[tuple]) -> pa.RecordBatch:
    text, place, first = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(text, pa.string()), pa.array([file] * len(rows)), pa.array([split] * len(rows), pa.int64()), pa.array(place, pa.int32()), pa.array(first)],
        names=["text", "file", "split", "place", "first"],
    )


def write_ndjson(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object per line; NULL fields are written, so every line has every field."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def require_objects(df: DataFrame) -> DataFrame:
    if df.columns == ["value"]:
        raise ValidationError("records must be objects")
    return df
