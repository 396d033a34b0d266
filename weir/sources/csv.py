"""CSV through Spark's reader, with the stricter rules the dialect asks for."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from weir.contracts.infer import ColumnSpec, coerce, infer_columns
from weir.errors import ConfigError, ValidationError
from weir.functions.types import is_nested
from weir.session import cut_lineage
from weir.sources.splits import by_split, cut_alike, joined_fragments, read_lines, starting_inside

# Texts read as NULL.
NULL_VALUES = ("", "NULL", "null", "\\N")

_RAW = "__raw_record"

#: What Spark's reader is told to take as NULL where quotes decide: fields without any character become this text.
_NOTHING = "\ufdd0nothing\ufdd0"

#: Characters of the records that a task gives on at once.
BATCH_CHARACTERS = 1 << 20


def unique_header(names: Sequence[str | None]) -> list[str]:
    """Blank names become `column_N`, repeats get `_2`, `_3`, ..., the first that no column has."""
    given = [(raw or "").strip() or f"column_{number}" for number, raw in enumerate(names, start=1)]
    header: list[str] = []
    for base in given:
        name, number = base, 1
        while name in header or (number > 1 and name in given):
            number += 1
            name = f"{base}_{number}"
        header.append(name)
    return header


def _options(delimiter: str, multi_line: bool, null_values: Sequence[str] | None) -> dict:
    quotes_decide = {"nullValue": _NOTHING, "emptyValue": ""} if null_values is None else {}
    return {"sep": delimiter, "quote": '"', "escape": '"', "multiLine": multi_line, "encoding": "UTF-8", **quotes_decide}


def line_ends(delimiter: str):
    """For a line, whether it ends inside a quoted field: if it begins at a field, and if it begins inside one.

    A quote opens a field only where the field begins, doubled quotes stand for one, and what follows a closing quote belongs to the field.
    """
    opening = delimiter + '"'

    def open_at_end(line: str, at: int) -> bool:
        """The state at the end, if a quoted field began just before `at`."""
        while True:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('""', at):
                at += 2
                continue
            at = line.find(opening, at + 1)
            if at < 0:
                return False
            at += 2

    def ends(line: str) -> tuple[bool, bool]:
        if '"' not in line:
            return False, True
        if line.startswith('"'):
            outside = open_at_end(line, 1)
        else:
            at = line.find(opening)
            outside = at >= 0 and open_at_end(line, at + 2)
        return outside, open_at_end(line, 0)

    return ends


def _files(spark: SparkSession, path: str, delimiter: str) -> tuple[list, list[str]]:
    """One row for each file (file, first line, whether a line end may lie inside quotes, partition values), and the partition columns.

    One scan of the text. Without a line end inside quotes, be it a carriage return, every line is a record, so the file can be split anywhere.
    """
    text = spark.read.text(path, lineSep="\n")
    partitions = [c for c in text.columns if c != "value"]
    value = F.rtrim(F.col("value"), F.lit("\r"))
    # pairs of quotes change nothing; of the others the last one opens a field that does not end
    may_span = F.replace("value", F.lit('""'), F.lit("")).rlike(f'(^|[{_in_class(delimiter)}])"[^"]*(\\r|$)')
    lines = text.select(
        F.col("_metadata.file_path").alias("file"), *partitions, F.when((F.col("_metadata.file_block_start") == 0) & (value != ""), value).alias("line"),
        F.monotonically_increasing_id().alias("at"), may_span.alias("spans"),
    )
    first = F.min_by("line", F.when(F.col("line").isNotNull(), F.col("at")))
    return lines.groupBy("file", *partitions).agg(first.alias("line"), F.max("spans").alias("spans")).orderBy("file").collect(), partitions


def _in_class(character: str) -> str:
    return "\\" + character if character in "\\^]-[&" else character


def read_csv(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    has_header: bool = True,
    null_values: Sequence[str] | None = NULL_VALUES,
    infer_types: bool = True,
    limit: int | None = None,
    columns: Sequence[ColumnSpec] | None = None,
) -> DataFrame:
    """Reads RFC 4180 text. Short rows are padded with NULL; a row longer than its header is an error.

    Every file has its own header; columns are brought together by name, those that a file lacks are NULL. A first scan
    finds the headers and the files with quoted fields that span lines. All files are split over tasks: those without such fields
    by Spark's reader, the others at line feeds, with the state of the quotes at each split worked out before. Records of the latter are
    written to the shared folder once. With `columns` given the types are taken from there and the inference scan is skipped.
    Values of partition folders are columns at the end. With `null_values` None only a field without any character is NULL:
    a quoted empty field is empty text, and no text stands for NULL (see `write_csv` with `quote_empty`).
    """
    if len(delimiter) != 1:
        raise ConfigError(f'CSV delimiter must be a single character, got "{delimiter}"')
    files, partitions = _files(spark, path, delimiter)
    spanning = [f for f in files if f["spans"]]
    simple = [f for f in files if not f["spans"] and f["line"] is not None]
    parts: list[DataFrame] = []
    base = {} if any(c in path for c in "*?[{") or not partitions else {"basePath": path}
    if simple:
        for names, members in _by_header(simple, delimiter, has_header):
            schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _RAW]])
            rows = spark.read.schema(schema).options(**base).csv(
                [unquote(f["file"]) for f in members], header=has_header, mode="PERMISSIVE", columnNameOfCorruptRecord=_RAW, enforceSchema=True,
                **_options(delimiter, False, null_values),
            )
            parts.append(_cleaned(rows, names, partitions, delimiter, null_values))
    if spanning:
        records, headers = _records(spark, [unquote(f["file"]) for f in spanning], delimiter)
        known = {f["file"]: f for f in spanning}
        for names, members in _by_header([{"file": h["file"], "line": h["text"]} for h in headers], delimiter, has_header):
            rows = records.where("not first") if has_header else records
            if partitions or len(members) < len(known):  # one row for each file
                table = [(m["file"], *[known[m["file"]][p] for p in partitions]) for m in members]
                types = spark.read.text(path).schema
                place = T.StructType([T.StructField("file", T.StringType()), *[types[p] for p in partitions]])
                rows = rows.join(F.broadcast(spark.createDataFrame(table, place)), "file")
            # a field before the others, as the parser takes a byte order mark off the first text that it sees
            lead = f"0{delimiter}"
            ddl = f"lead STRING, {', '.join(f'c{i} STRING' for i in range(len(names)))}, {_RAW} STRING"
            options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in _options(delimiter, True, null_values).items()}
            opened = F.from_csv(F.concat(F.lit(lead), "text"), ddl, {**options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RAW})
            rows = rows.select(opened.alias("r"), *partitions).select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)], F.expr(f"substring(r.{_RAW}, {len(lead) + 1})").alias(_RAW), *partitions)
            parts.append(_cleaned(rows, names, partitions, delimiter, null_values))
    if not parts:
        return spark.createDataFrame([], T.StructType([]))
    text = parts[0]
    for part in parts[1:]:
        text = text.unionByName(part, allowMissingColumns=True)
    order = list(dict.fromkeys(c for part in parts for c in part.columns if c not in partitions))
    text = text.select(*[F.col(f"`{c}`") for c in [*order, *partitions]])
    if limit is not None:
        text = text.limit(limit)
    if columns is not None:
        return coerce(text, columns)
    return coerce(text, infer_columns(text)) if infer_types else text


def _by_header(files: Sequence, delimiter: str, has_header: bool) -> list[tuple[list[str], list]]:
    """Files with equal headers together: column names and files."""
    groups: dict[tuple, list] = {}
    for file in files:
        names = next(csv.reader([file["line"].removeprefix("﻿")], delimiter=delimiter), [""])
        groups.setdefault(tuple(unique_header(names) if has_header else ()), []).append(file)
    if not has_header:  # the first file tells how many columns there are
        width = len(next(csv.reader([files[0]["line"].removeprefix("﻿")], delimiter=delimiter), [""]))
        return [([f"column_{i + 1}" for i in range(width)], list(files))]
    return [(list(names), members) for names, members in groups.items()]


def _records(spark: SparkSession, paths: list[str], delimiter: str) -> tuple[DataFrame, list]:
    """Records (text, file, first) of files whose quoted fields may span lines, and the first record of each file."""
    ends, lines = line_ends(delimiter), read_lines(spark, paths)
    begun: set = set()

    def cut(batches):
        for (file, split), values in by_split(batches):
            rows, held, fresh, size = [], [], split == 0, 0
            state = within = (file, split) in begun  # `within`: the held lines began in an earlier split
            for value in values:
                if fresh and not state:
                    value = value.removeprefix("﻿")
                if not state and value.strip("\r") == "":
                    continue
                held.append(value)
                state = ends(value)[1 if state else 0]
                if not state:
                    text = "\n".join(held)
                    rows.append((text.removesuffix("\r"), 0 if within else 1, fresh and not within))
                    held, within, fresh, size = [], False, False, size + len(text)
                    if len(rows) == 4096 or size >= BATCH_CHARACTERS:
                        yield _batch(file, split, rows)
                        rows, size = [], 0
            if held:
                rows.append(("\n".join(held), 0 if within else 2, fresh and not within))
            if rows:
                yield _batch(file, split, rows)

    with cut_alike(spark):
        inside, broken = starting_inside(lines, ends)
        if broken:
            raise ValidationError(f"CSV ended inside a quoted field: {broken[0]}")
        begun.update(inside)
        staged = cut_lineage(lines.mapInArrow(cut, "text string, file string, split long, place int, first boolean"), "records")
    joined = joined_fragments(staged.where("place <> 1")).withColumn("text", F.rtrim("text", F.lit("\r")))
    records = staged.where("place = 1").select("text", "file", "first").unionByName(joined)
    return records, records.where("first").select("file", "text").orderBy("file").collect()


def _batch(file: str, split: int, rows: list[tuple]) -> pa.RecordBatch:
    text, place, first = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(text, pa.string()), pa.array([file] * len(rows)), pa.array([split] * len(rows), pa.int64()), pa.array(place, pa.int32()), pa.array(first)],
        names=["text", "file", "split", "place", "first"],
    )


def _cleaned(rows: DataFrame, header: Sequence[str], partitions: Sequence[str], delimiter: str, null_values: Sequence[str] | None) -> DataFrame:
    checked = _reject_long_rows(rows, header, delimiter, partitions)
    if null_values is None:
        return checked.select(*[F.col(f"`{name}`") for name in header], *partitions)
    empty_is_null = "" in null_values
    projected = []
    for name in header:
        column = F.col(f"`{name}`")
        if not empty_is_null:
            # The reader turns empty fields into NULL; only padded rows really lack the value.
            column = F.when(F.col(_RAW).isNull(), F.coalesce(column, F.lit(""))).otherwise(column)
        others = [v for v in null_values if v != ""]
        if others:
            column = F.when(~column.isin(*others), column)
        projected.append(column.alias(name))
    return checked.select(*projected, *partitions)


def _reject_long_rows(rows: DataFrame, header: Sequence[str], delimiter: str, partitions: Sequence[str] = ()) -> DataFrame:
    raw = F.col(_RAW)
    field = f'[{_in_class(delimiter)}]'
    unquoted = F.regexp_replace(raw, f'(^|{field})"(?:[^"]|"")*"', "$1")
    fields = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(delimiter), F.lit(""))) + 1
    failure = F.raise_error(
        F.concat(
            F.lit("CSV row has "), fields.cast("string"),
            F.lit(f" fields but the header declares {len(header)}: "), F.substring(raw, 1, 200),
        )
    ).cast("string")
    # The check rides on the first column, which every reader of the row needs to produce.
    first = F.when(raw.isNotNull() & (fields > len(header)), failure).otherwise(F.col(f"`{header[0]}`"))
    others = [F.col(f"`{n}`") for n in header[1:]]
    return rows.select(first.alias(header[0]), *others, _RAW, *partitions)


def write_csv(
    df: DataFrame, path: str, delimiter: str = ",", header: bool = True, mode: str = "overwrite", partition_by: Sequence[str] = (), quote_empty: bool = False
) -> None:
    """Quotes only where needed; NULL and empty text are both empty fields, unless `quote_empty` has empty text in quotes; nested values are JSON.

    With `partition_by` an overwrite replaces only the partitions that the data has.
    """
    flat = df.select(
        *[(F.to_json(F.col(f"`{f.name}`")) if is_nested(f.dataType) else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields]
    )
    writer = flat.write.mode(mode).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.csv(
        path, sep=delimiter, header=header, quote='"', escape='"', nullValue="", emptyValue='""' if quote_empty else "",
        timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSXXX", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
