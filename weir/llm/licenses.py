"""License texts in documents: an exact set-similarity join of text blocks with templates.

A template of m words is held against every block of its level: 2^k words, the least power of two that is 2m or more, from each
half of such a block on, so that m words in a row lie whole in some block. A block meets a template that has `percent` of its
distinct words in the block. All words are in one order, rarest first in the whole corpus (words of no template before all
others, which takes them out of every count). A block and a template that meet share one of the template's first
m - ceil(m * percent / 100) + 1 words (prefix filter), the block has at least ceil(m * percent / 100) template words (length), and
enough words lie behind the first common one in both (position). What passes is compared whole. No filter can lose a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.text import need
from weir.session import cut_lineage

#: Share of a template's distinct words that a block must hold.
PERCENT = 80
SMALLEST_BLOCK = 16

#: Phrases that give a label wherever their words stand in a row (fixed values).
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Wording of public licenses (fixed values): label, text.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc", "Licensed under CC BY-NC 4.0"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
]

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SCANNED = (
    "task int, row long, n_words long, places array<struct<label: string, start: long>>, "
    "blocks array<struct<level: int, start: long, codes: array<int>>>"
)


def words_of(text: str | None) -> list[bytes]:
    """The runs of letters, digits and characters beyond ASCII, A-Z in lower case (null: none)."""
    return text.encode().translate(_TABLE).split() if text else []


class Codes(dict):
    """Places of template words in the global order, from 1; other words are 0."""

    def __missing__(self, word: bytes) -> int:
        return 0

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))


def level_of(words: int) -> int:
    """The words of the blocks that a template of so many words is compared with."""
    return max(SMALLEST_BLOCK, 1 << (2 * words - 1).bit_length())


def block_starts(n: int, level: int) -> range:
    """Where the blocks of a text of n words begin; the last one reaches its end."""
    half = level // 2
    return range(0, max(n - level, 0) + half, half)


def word_order(texts: DataFrame, words: set[bytes]) -> list[bytes]:
    """The template words by the number of texts with them, rarest first, over all texts."""
    known = Codes({w: k for k, w in enumerate(sorted(words), 1)})

    def count(batches):
        total = np.zeros(len(known) + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                total[np.unique(known.of(words_of(text.as_py())))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(1, len(total)), pa.int32()), pa.array(total[1:], pa.int64())], names=["code", "many"])

    counted = texts.mapInArrow(count, "code int, many long").groupBy("code").agg(F.sum("many").alias("many")).collect()  # one row for each template word
    many = {r["code"]: r["many"] for r in counted}
    return sorted(known, key=lambda w: (many.get(known[w], 0), w))


def find_licenses(
    df: DataFrame, id: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, percent: int = PERCENT
) -> DataFrame:
    """One row for each row of the input: doc_id, n_words, places, blocks.

    `places` are the phrases found: label, start (words from 0), in order of start, overlaps included. `blocks` are all pairs of
    a block and a template that meet: label, template (its number), start and end (words, end exclusive), share (of the
    template's distinct words). Texts are cut into words at all ASCII characters but letters and digits, A-Z in lower case.

    A null or empty text has no words, places or blocks; a text shorter than a block is one block. Repeated rows are given as
    often as they occur, a null id stays null, no input gives no rows. A template without words is an error.
    """
    sets = []
    for label, body in templates:
        words = words_of(body)
        if not words:
            raise ValueError(f"the template {label!r} has no words")
        sets.append((label, level_of(len(words)), set(words)))
    rules = [(label, words_of(body)) for body, label in phrases]
    source = need(df, id, text).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    vocabulary = set().union(*(s for _, _, s in sets), *(set(w) for _, w in rules))
    codes = Codes({w: k for k, w in enumerate(word_order(source.select("text"), vocabulary), 1)})
    known = []
    for number, (label, level, words) in enumerate(sets):
        ordered, least = sorted(codes[w] for w in words), -(-len(words) * percent // 100)
        known.append((number, label, level, ordered, least))
    levels = {}
    for _, _, level, ordered, least in known:
        rare, fewest = levels.get(level, (np.zeros(len(codes) + 1, bool), least))
        rare[ordered[: len(ordered) - least + 1]] = True
        levels[level] = rare, min(fewest, least)
    sought = [(label, [codes[w] for w in words]) for label, words in rules]

    def scan(batches):
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = [[], [], [], []]
            for body in batch.column(1):
                place = codes.of(words_of(body.as_py()))
                for column, value in zip(out, (row, len(place), _places(place, sought), _blocks(place, levels))):
                    column.append(value)
                row += 1
            places = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
            blocks = pa.list_(pa.struct([("level", pa.int32()), ("start", pa.int64()), ("codes", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([task] * len(out[0]), pa.int32()), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), places, blocks)))],
                names=["doc_id", "task", "row", "n_words", "places", "blocks"],
            )

    scanned = cut_lineage(source.mapInArrow(scan, "doc_id long, " + SCANNED), "licenses")
    met = _met(scanned, known).groupBy("task", "row").agg(F.sort_array(F.collect_list("met")).alias("met"))  # the blocks of one text
    rows = scanned.join(met, ["task", "row"], "left")
    none = F.array().cast("array<struct<start: long, end: long, label: string, template: int, share: double>>")
    return rows.select("doc_id", "n_words", "places", F.coalesce("met", none).alias("blocks"))


def _places(place: np.ndarray, sought) -> list[dict]:
    found = []
    for label, words in sought:
        if len(words) <= len(place):
            ends = len(place) - len(words) + 1
            here = np.logical_and.reduce([place[k : k + ends] == code for k, code in enumerate(words)])
            found += [(int(at), label) for at in np.flatnonzero(here)]
    return [{"label": label, "start": at} for at, label in sorted(found)]


def _blocks(place: np.ndarray, levels: dict) -> list[dict]:
    """The blocks with a prefix word of some template of their level and enough template words; their codes in order."""
    out = []
    for level, (rare, fewest) in levels.items():
        half, starts = level // 2, block_starts(len(place), level)
        hits = np.flatnonzero(rare[place]) // half
        for number in np.unique(np.r_[hits - 1, hits]) if len(hits) else ():
            if 0 <= number < len(starts):
                start = int(number) * half
                codes = np.unique(place[start : start + level])
                codes = codes[codes > 0]
                if len(codes) >= fewest:
                    out.append({"level": level, "start": start, "codes": codes})
    return out


def _met(scanned: DataFrame, known: list[tuple]) -> DataFrame:
    """The confirmed pairs: task, row, met."""
    spark = scanned.sparkSession
    postings = [
        (level, code, at, number, label, ordered, least)
        for number, label, level, ordered, least in known for at, code in enumerate(ordered[: len(ordered) - least + 1])
    ]
    index = spark.createDataFrame(postings, "level int, code int, at int, template int, label string, words array<int>, least int")
    one = scanned.select("task", "row", "n_words", F.explode("blocks").alias("block")).select("task", "row", "n_words", "block.*")
    each = one.select("task", "row", "n_words", "level", "start", "codes", F.posexplode("codes").alias("place", "code"))
    behind = F.least(F.size("words") - F.col("at"), F.size("codes") - F.col("place"))
    pairs = each.join(F.broadcast(index), ["level", "code"]).where((F.size("codes") >= F.col("least")) & (behind >= F.col("least")))  # as large as the template list
    common = F.array_intersect("codes", "words")
    checked = pairs.withColumn("common", common).where((F.col("common")[0] == F.col("code")) & (F.size("common") >= F.col("least")))
    share = F.size("common") / F.size("words")
    end = F.least(F.col("start") + F.col("level"), F.col("n_words"))
    return checked.select("task", "row", F.struct("start", end.alias("end"), "label", "template", share.alias("share")).alias("met"))
