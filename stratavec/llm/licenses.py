"""License scan: exact phrases, and an exact set-similarity join with templates.

Text blocks are windows of a paragraph (a run of lines that have words): so many
consecutive words as the template has, and a quarter more, from one of its words on.  A
block meets a template if it contains at least ``THRESHOLD`` of the template's distinct
words, among them all that tell this license from others, and none that tells another.  The join is exact and works with these filters, on
paragraphs first, since what a window contains its paragraph contains too:

* the words of all templates are ordered by how many lines of the whole corpus
  have them, rarest first;
* prefix: a block that meets a template of n words with required overlap o has one
  of the template's n - o + 1 rarest words;
* length and position: with the first common word at places i and j, no more than
  what follows in either can still be common.

What passes is verified by a window that slides over the template's words.  The
templates are a fixed, small set and travel with the tasks; the corpus is read twice, for
the frequencies and for the join, and only word counts are shuffled.

Defined cases: a null text is the empty text, without words, blocks or labels; texts of
any length are read whole; repeated rows are documents of their own, as are rows without
an id; a template that is met twice counts once, with its best block; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.llm.common import text_struct

THRESHOLD = 0.8
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
# fixed values: notices and identifying paragraphs of licenses in common use, by label,
# with the words that tell them from each other: those a block must have and, where there
# are any, those it must not have
TEMPLATES = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the Software), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions",
        "permission granted sublicense",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with "
        "or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies",
        "fee permission purpose",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0", "apache"),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at",
        "apache compliance",
    ),
    (
        "apache",
        "Unless required by applicable law or agreed to in writing, software distributed under "
        "the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License",
        "basis governing writing",
    ),
    (
        "gpl",
        "This work is licensed under the GNU General Public License, version 3",
        "general gnu public",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version",
        "general gnu public redistribute",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version",
        "gnu lesser redistribute",
    ),
    (
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version",
        "affero gnu redistribute",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If "
        "a copy of the MPL was not distributed with this file, You can obtain one at",
        "mozilla mpl",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
        "binary redistribution source",
    ),
    (
        "bsd",
        "Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written "
        "permission",
        "contributors endorse neither",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to "
        "copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by "
        "any means",
        "domain unencumbered",
    ),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event "
        "will the authors be held liable for any damages arising from the use of this software",
        "authors held liable",
    ),
    (
        "boost",
        "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE "
        "or copy at",
        "boost license",
    ),
    ("cc-by", "Licensed under CC BY 4.0", "by cc licensed", "nc nd sa"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", "by cc sa"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "by cc nc"),
    (
        "cc-by",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "attribution commons creative",
        "noncommercial sharealike noderivatives",
    ),
    (
        "cc-by-sa",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
        "License",
        "commons creative sharealike",
    ),
    (
        "cc-by-nc",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License",
        "commons creative noncommercial",
    ),
)

# bytes of words stay, A-Z become a-z, newlines stay, all else becomes a space
_WORDS = bytes(
    b + 32
    if 65 <= b <= 90
    else b
    if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 or b == 10
    else 32
    for b in range(256)
)


def _plain(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS)


def paragraphs(plain: bytes) -> Iterator[list[bytes]]:
    """Words of every run of lines that have some."""
    lines = (line.split() for line in plain.split(b"\n"))
    for filled, run in groupby(lines, key=bool):
        if filled:
            yield [word for line in run for word in line]


def template_words(text: str) -> list[bytes]:
    return _plain(text).split()


def window_of(n_words: int) -> int:
    """Words of a block that may meet a template of so many."""
    return n_words + n_words // 4 + 1


def vocabulary(templates) -> frozenset[bytes]:
    return frozenset(w for _, text, *_ in templates for w in template_words(text))


def word_frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """How many lines of the corpus have each word of the templates."""
    known = vocabulary(templates)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                for line in _plain(text or "").split(b"\n"):
                    counts.update(known.intersection(line.split()))
        yield pa.RecordBatch.from_pydict(
            {
                "word": pa.array([w.decode() for w in counts], pa.string()),
                "n": pa.array(list(counts.values()), pa.int64()),
            }
        )

    rows = (
        docs.select("text")
        .mapInArrow(partial, "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .collect()  # at most one row per word of the templates
    )
    found = {r["word"].encode(): r["n"] for r in rows}
    return {w: found.get(w, 0) for w in known}


@dataclass(frozen=True)
class Template:
    label: str
    words: frozenset[bytes]
    required: frozenset[bytes]
    barred: frozenset[bytes]
    need: int
    window: int


class TemplateIndex:
    """Templates by the words of their prefixes, in the order of the corpus."""

    def __init__(self, frequencies: dict[bytes, int], templates=TEMPLATES, threshold=THRESHOLD):
        order = sorted(frequencies, key=lambda w: (frequencies[w], w))
        self.place = {w: i for i, w in enumerate(order)}
        self.templates: list[Template] = []
        self.prefix: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for number, (label, text, required, *barred) in enumerate(templates):
            spelled = template_words(text)
            words = sorted(set(spelled), key=self.place.__getitem__)
            need = math.ceil(threshold * len(words) - 1e-9)
            must = frozenset(template_words(required))
            never = frozenset(w for text in barred for w in template_words(text))
            self.templates.append(
                Template(label, frozenset(words), must, never, need, window_of(len(spelled)))
            )
            for i, word in enumerate(words[: len(words) - need + 1]):
                self.prefix[word].append((number, i))
        self.rare = frozenset(self.prefix)

    def candidates(self, block: frozenset[bytes]) -> Iterator[Template]:
        """Templates that a block with these words may meet."""
        if self.rare.isdisjoint(block):
            return
        known = sorted(block & self.place.keys(), key=self.place.__getitem__)
        seen: set[int] = set()
        for j, word in enumerate(known):
            for number, i in self.prefix.get(word, ()):
                template = self.templates[number]
                if number in seen or len(block) < template.need:
                    continue
                seen.add(number)  # its first common word
                left = min(len(template.words) - i - 1, len(known) - j - 1)
                if 1 + left >= template.need and template.required <= block:
                    yield template

    def matches(self, words: list[bytes]) -> Iterator[tuple[str, float]]:
        """Label and best containment of every template that a window of a paragraph meets."""
        for template in self.candidates(frozenset(words)):
            common = best_window(words, template)
            if common >= template.need:
                yield template.label, common / len(template.words)


def best_window(words: list[bytes], template: Template) -> int:
    """Most distinct words of a template in a window that has all required and no barred
    ones, else 0."""
    places = [(k, w) for k, w in enumerate(words) if w in template.words or w in template.barred]
    inside: Counter[bytes] = Counter()
    best = end = 0
    for k, word in places:
        # the window from this word on
        while end < len(places) and places[end][0] < k + template.window:
            inside[places[end][1]] += 1
            end += 1
        if len(inside) > best and template.required <= inside.keys() and template.barred.isdisjoint(inside):
            best = len(inside)
        inside[word] -= 1
        if not inside[word]:
            del inside[word]
    return best


def _phrase_places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase starts, in words joined by single spaces
    with one more at either end."""
    out, at, counted, words = [], joined.find(phrase), 0, 0
    while at >= 0:
        words += joined.count(b" ", counted, at)
        counted = at
        out.append(words)
        at = joined.find(phrase, at + 1)
    return out


_SCAN = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
    ]
)


def scan_text(text: str, index: TemplateIndex) -> tuple:
    plain = _plain(text)
    words = plain.split()
    joined = b" " + b" ".join(words) + b" "
    starts: list[int] = []
    labels: set[str] = set()
    if b" license " in joined:
        for phrase, label in PHRASES:
            found = _phrase_places(joined, b" " + phrase.encode() + b" ")
            starts.extend(found)
            labels.update([label] if found else [])
    base, score = sorted(labels), 0.0
    if not index.rare.isdisjoint(words):
        for paragraph in paragraphs(plain):
            for label, containment in index.matches(paragraph):
                labels.add(label)
                score = max(score, containment)
    return (
        len(words),
        len(starts),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(base),
        ",".join(sorted(labels)),
        score,
    )


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Phrases, labels and the best containment of every document."""
    index = TemplateIndex(word_frequencies(docs, templates), templates, threshold)
    scan = text_struct(lambda text: scan_text(text, index), _SCAN)
    return docs.select("doc_id", scan(F.col("text")).alias("s")).select("doc_id", "s.*")


def _template_row(number: int, label: str, text: str, required: str, barred: str = "") -> str:
    words, must, never = map(template_words, (text, required, barred))
    spelled = lambda ws: str(sorted({w.decode() for w in ws})) + "::VARCHAR[]"
    need = math.ceil(THRESHOLD * len(set(words)) - 1e-9)
    return f"({number}, '{label}', {spelled(words)}, {spelled(must)}, {spelled(never)}, {need}, {window_of(len(words))})"


_TEMPLATE_ROWS = ",\n  ".join(_template_row(n, *t) for n, t in enumerate(TEMPLATES))
ORACLE = f"""
WITH template AS (
  SELECT * FROM (VALUES
  {_TEMPLATE_ROWS}) AS x(number, label, t, must, never, need, reach)
), doc AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), worded AS (
  SELECT *, regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM doc
), placed AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS k FROM worded
), following AS (
  SELECT *, lead(word) OVER d AS second, lead(word, 2) OVER d AS third FROM placed
  WINDOW d AS (PARTITION BY doc_id ORDER BY k)
), base AS (
  SELECT doc_id, k, CASE WHEN word = 'mit' AND second = 'license' THEN 'mit'
                         WHEN word = 'apache' AND second = 'license' THEN 'apache'
                         WHEN word = 'general' AND second = 'public' AND third = 'license' THEN 'gpl'
                    END AS label
  FROM following
), found AS (
  SELECT doc_id, count(*) AS n, min(k) AS a, max(k) AS z, list(DISTINCT label) AS labels
  FROM base WHERE label IS NOT NULL GROUP BY doc_id
), line AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS k
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM doc)
), worded_line AS (
  SELECT doc_id, k, regexp_extract_all(line, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM line
), run AS (
  SELECT *, sum((len(w) = 0)::INT) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM worded_line
), paragraph AS (
  SELECT doc_id, run, flatten(list(w ORDER BY k)) AS w FROM run WHERE len(w) > 0
  GROUP BY doc_id, run
), candidate AS (
  SELECT doc_id, run, w, number, label, t, must, never, need, reach FROM paragraph, template
  WHERE list_has_all(w, must) AND len(list_intersect(list_distinct(w), t)) >= need
), hit AS (
  SELECT doc_id, run, number, word, pos FROM (
    SELECT doc_id, run, number, t || never AS t, unnest(w) AS word, unnest(range(len(w))) AS pos
    FROM candidate)
  WHERE list_contains(t, word)
), start AS (
  SELECT a.doc_id, a.run, a.number, a.pos, list(DISTINCT b.word) AS inside
  FROM hit a JOIN template x USING (number) JOIN hit b ON a.doc_id = b.doc_id AND a.run = b.run
    AND a.number = b.number AND b.pos BETWEEN a.pos AND a.pos + x.reach - 1
  GROUP BY a.doc_id, a.run, a.number, a.pos
), alike AS (
  SELECT doc_id, max(len(inside) / len(t)) AS score, list(DISTINCT label) AS labels
  FROM start JOIN template USING (number)
  WHERE len(inside) >= need AND list_has_all(inside, must) AND NOT list_has_any(inside, never)
  GROUP BY doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(f.n, 0)::BIGINT AS n_base,
       f.a::BIGINT AS first_word, f.z::BIGINT AS last_word,
       coalesce(list_aggregate(list_sort(f.labels), 'string_agg', ','), '') AS base_labels,
       coalesce(list_aggregate(list_sort(list_distinct(
         coalesce(f.labels, []) || coalesce(s.labels, []))), 'string_agg', ','), '') AS labels,
       coalesce(s.score, 0)::DOUBLE AS score
FROM worded w LEFT JOIN found f USING (doc_id) LEFT JOIN alike s USING (doc_id)
"""
