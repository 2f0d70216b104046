"""License scan (operator 3): patience alignment of documents with license texts.

Words that are unique in both a stretch of a document and a template are anchors; the longest increasing run of them
aligns the two, and the gaps between are aligned in the same way. Coverage is the share of the template that is aligned.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least share of a template's words that an occurrence aligns.
COVERAGE = 0.8
#: Words that an occurrence may have beyond its template, as a share of the template, and at least this many.
SLACK, LEAST_SLACK = 0.25, 1
#: Bits of the table by which a gap without anchors is aligned at once; larger gaps are halved first.
MOST_BITS = 1 << 28

# Wording of public licenses and of the notices that refer to them.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version.""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software.""",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-notice": "Released under the MIT License.",
}

_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def words_in(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lower-case runs of letters and digits (numbers with their dots), and where each stands."""
    found = list(_WORD.finditer(text))
    return [m[0].lower() for m in found], [m.span() for m in found]


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by their first, whose second rises too (by piles of patience)."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        back.append(ends[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(b)
            ends.append(i)
        else:
            tops[pile], ends[pile] = b, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _rows(a: list[str], b: list[str]) -> Iterator[int]:
    """After each word of a, the row of the table of longest common subsequences with b, as an integer.

    Bit j is 0 where the length grows from b[:j] to b[:j + 1]. A whole row is one addition and a few bit operations.
    """
    places: dict[str, int] = defaultdict(int)
    for j, w in enumerate(b):
        places[w] |= 1 << j
    full = (1 << len(b)) - 1
    row = full
    for w in a:
        here = row & places.get(w, 0)
        row = ((row + here) | (row - here)) & full
        yield row


def _lengths(a: list[str], b: list[str]) -> list[int]:
    """Length of the longest common subsequence of a and each beginning of b."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):  # noqa: B007
        pass
    out, bits = [0], bin(row)[2:].zfill(len(b))[::-1]
    for bit in bits[: len(b)]:
        out.append(out[-1] + (bit == "0"))
    return out


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence: in a table of one bit a cell, or by halves where that would be large."""
    if len(a) > 1 and len(a) * len(b) > MOST_BITS:
        half = len(a) // 2
        before, after = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])
        cut = max(range(len(b) + 1), key=lambda j: before[j] + after[len(b) - j])
        return _common(a[:half], b[:cut]) + [(i + half, j + cut) for i, j in _common(a[half:], b[cut:])]
    rows = list(_rows(a, b))
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:  # b's last word adds nothing
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:  # it does so without a's last word too
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of positions of equal words of a and b, rising in both, by patience alignment."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = _rising([(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in where])
        if not anchors:
            out += [(i + a0, j + b0) for i, j in _common(a[a0:a1], b[b0:b1])]
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


@dataclass(frozen=True)
class Template:
    """A license's words; keys are its rarest words, one of which any occurrence of the coverage asked for has."""

    name: str
    words: tuple[str, ...]
    keys: tuple[str, ...]


def least_words(n: int, coverage: float) -> int:
    """Words of a template of n that an occurrence aligns at least; a product that errs in its last bits counts as whole."""
    return math.ceil(coverage * n - 1e-9)


@cache
def compiled(texts: tuple[tuple[str, str], ...], coverage: float) -> tuple[Template, ...]:
    """Templates, longest first. Keys are words of four letters or more, if they suffice, that few templates have.

    An occurrence may lack at most (1 - coverage) of the words; so of a set of words that stand for more places
    than that, it has at least one.
    """
    split = {name: tuple(words_in(text)[0]) for name, text in texts}
    spread = Counter(w for words in split.values() for w in set(words))
    out = []
    for name, words in split.items():
        if not words:
            continue
        own, keys, places = Counter(words), [], 0
        for w in sorted(own, key=lambda w: (len(w) < 4, spread[w], -len(w), w)):
            if places > len(words) - least_words(len(words), coverage):
                break
            keys.append(w)
            places += own[w]
        out.append(Template(name, words, tuple(keys)))
    return tuple(sorted(out, key=lambda t: (-len(t.words), t.name)))


def occurrences(words: list[str], templates: tuple[Template, ...], coverage: float = COVERAGE) -> list[tuple[int, int, str, float]]:
    """(first word, end, license, coverage) of all licenses in a text's words, longest templates first; they don't overlap."""
    have = set(words)
    places: dict[str, list[int]] | None = None
    found: list[tuple[int, int, str, float]] = []
    for t in templates:
        keys = [k for k in t.keys if k in have]
        need = least_words(len(t.words), coverage)
        # Each different word that is missing lacks a place at least.
        if not keys or len(set(t.words)) - len(have.intersection(t.words)) > len(t.words) - need:
            continue
        if places is None:
            places = defaultdict(list)
            for i, w in enumerate(words):
                places[w].append(i)
        slack = max(LEAST_SLACK, int(SLACK * len(t.words)))
        # Where the first word of an occurrence may stand, by each key word found.
        begins = sorted({max(0, i - j) for k in keys for i in places[k] for j, w in enumerate(t.words) if w == k})
        best: list[tuple[float, int, int]] = []
        last = -1
        for begin in begins:
            if begin <= last:
                continue
            last = begin  # of equal ones the first will do
            low, high = max(0, begin - slack), min(len(words), begin + len(t.words) + slack)
            pairs = align(words[low:high], list(t.words))
            if len(pairs) >= need and pairs[-1][0] - pairs[0][0] < len(t.words) + slack:
                best.append((len(pairs) / len(t.words), low + pairs[0][0], low + pairs[-1][0] + 1))
        for share, s, e in sorted(best, key=lambda x: (-x[0], x[1])):
            if not any(s < f[1] and f[0] < e for f in found):
                found.append((s, e, t.name, share))
    return sorted(found)


def _scan(texts: tuple[tuple[str, str], ...], coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = compiled(texts, coverage)
        keys = sorted({k for t in templates for k in t.keys})
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out = []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                text = raw.decode("utf-8", "replace") if raw else ""
                low = text.lower()
                if not any(k in low for k in keys):
                    out.append([])
                    continue
                words, spans = words_in(text)
                out.append([{"license": name, "coverage": share, "start": spans[s][0], "end": spans[e - 1][1]} for s, e, name, share in occurrences(words, templates, coverage)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "licenses"])

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row per document: doc_id, licenses (array of license, coverage, start, end in code points, end exclusive).

    An occurrence aligns at least `coverage` of a template's words with a stretch of the text that is longer than the
    template by a bounded share. Where templates overlap, the longer one stays; of one template's, the better
    covered. Whole texts are scanned where they are, without a shuffle; a text is aligned only around the
    places of words that any occurrence must share.

    Null and empty texts have no licenses; repeated rows are scanned alike; extra columns are ignored; an empty
    table gives an empty result.
    """
    texts = tuple((TEMPLATES if templates is None else templates).items())
    schema = "doc_id bigint, licenses array<struct<license:string,coverage:double,start:bigint,end:bigint>>"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_scan(texts, coverage), schema)


def op3_query(spark, sf_dir: str) -> DataFrame:
    """op3: licenses of every document, as a count, the first one with its coverage, and a list of spans."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    listed = F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    first = F.get("licenses", F.lit(0))
    return found.select("doc_id", F.size("licenses").cast("bigint").alias("n_licenses"), first["license"].alias("license"), first["coverage"].alias("coverage"), listed.alias("spans"))
