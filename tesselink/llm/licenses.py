"""License scans: phrases, and an exact containment join of text blocks with license templates.

Blocks are runs of ``BLOCK`` words that overlap by half, so that every passage of a template's length lies whole in
one.  Templates have at most half as many words; a license that is longer stands in the list in several passages.  A
block meets a template when at least a ``threshold`` share of the template's distinct words is in it.

The join is exact and takes these filters.  The words of all templates are ordered by how many documents of the whole
table have them, rarest first; of a block only those words are kept, in that order.  Prefix: a block that meets a
template of m words has one of its m - need + 1 rarest ones (need = ceil(threshold * m)), so a document with none of
those is left at once.  Length: a block of fewer than need kept words is left.  Position: the words of a template
before the first that the block has are missing, and the kept words of the block before that one are not the
template's, so no more can meet than what follows there in either; if that is under need, the pair is left.  The
same bound ends the count of the others as soon as what was met and what is left cannot reach need.

The templates are a fixed list, their words bound what is gathered from the corpus and sent to the executors.

Defined cases: null text is empty; texts are read whole; a document has the labels of its phrases and templates,
each once; repeated rows are scanned alike; ids are not looked at and may be null; an empty table gives an empty
result; further columns pass through, whatever their names, except those added.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import others

#: Phrase and label.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Passages of well-known licenses, label and text; the MIT and the two-clause BSD license are there as a whole.
TEMPLATES = (
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-text", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit-notice", "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit-warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-warranty", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("bsd-liability", "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE"),
    ("isc-warranty", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS"),
    ("zlib-text", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("cc-by-text", "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"),
)
THRESHOLD = 0.8
BLOCK = 160
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case: runs of letters and digits, and of all beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def _template_words(templates) -> list[tuple[str, frozenset[bytes]]]:
    return [(label, frozenset(words_of(text))) for label, text in templates]


def word_frequency(docs: DataFrame, templates=TEMPLATES, *, text_col: str = "text") -> dict[bytes, int]:
    """For each word of the templates, the number of documents that have it, over all of ``docs``."""
    wanted = frozenset().union(*(w for _, w in _template_words(templates)))

    def count(batches):
        found = dict.fromkeys(wanted, 0)
        for b in batches:
            for text in b.column(0).to_pylist():
                for w in wanted.intersection(words_of(text)):
                    found[w] += 1
        yield pa.RecordBatch.from_pydict({"word": list(found), "n": pa.array(found.values(), pa.int64())})

    counts = docs.select(text_col).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return dict.fromkeys(wanted, 0) | {bytes(r["word"]): r["n"] for r in counts.collect()}  # a row for each template word


@dataclass(frozen=True)
class Index:
    """What executors need: the rank of each template word, templates as ranks in order, and the templates of each prefix rank."""

    labels: tuple[str, ...]
    rank: dict[bytes, int]
    ordered: tuple[tuple[int, ...], ...]
    need: tuple[int, ...]
    prefix: dict[int, tuple[int, ...]]

    @classmethod
    def build(cls, frequency: dict[bytes, int], templates=TEMPLATES, threshold: float = THRESHOLD) -> Index:
        sets = _template_words(templates)
        every = sorted(frozenset().union(*(w for _, w in sets)), key=lambda x: (frequency.get(x, 0), x))
        rank = {w: k for k, w in enumerate(every)}
        ordered = tuple(tuple(sorted(rank[x] for x in w)) for _, w in sets)
        need = tuple(math.ceil(threshold * len(w) - 1e-9) for w in ordered)
        prefix: dict[int, list] = {}
        for t, w in enumerate(ordered):
            for x in w[: len(w) - need[t] + 1]:
                prefix.setdefault(x, []).append(t)
        return cls(tuple(label for label, _ in sets), rank, ordered, need, {w: tuple(x) for w, x in prefix.items()})

    def met(self, t: int, kept: list[int], there: frozenset[int]) -> int:
        """Words of template ``t`` in a block whose template words have the ranks ``kept``, in order; 0 if fewer than needed."""
        own, need = self.ordered[t], self.need[t]
        if len(kept) < need:  # length
            return 0
        first = next((i for i, x in enumerate(own) if x in there), len(own))
        if first == len(own) or min(len(own) - first, len(kept) - bisect_left(kept, own[first])) < need:  # position
            return 0
        found = 0
        for i in range(first, len(own)):
            found += own[i] in there
            if found + len(own) - 1 - i < need:
                return 0
        return found

    def matches(self, words: list[bytes]) -> dict[str, float]:
        """Label and best containment of every template that some block meets."""
        found: dict[str, float] = {}
        ranks = [self.rank.get(w, -1) for w in words]
        rare = self.prefix.keys() & set(ranks)
        if not rare:
            return found
        for at in range(0, max(1, len(words) - BLOCK // 2), BLOCK // 2):
            there = frozenset(ranks[at : at + BLOCK]) - {-1}
            kept = sorted(there)
            for t in {t for x in rare & there for t in self.prefix[x]}:
                n = self.met(t, kept, there)
                if n:
                    found[self.labels[t]] = max(n / len(self.ordered[t]), found.get(self.labels[t], 0.0))
        return found


def phrase_places(words: list[bytes], phrases=PHRASES) -> list[tuple[int, str]]:
    """(place, label) of every phrase, in order."""
    joined = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in phrases:
        wanted = b" " + phrase.encode() + b" "
        at, place, seen = joined.find(wanted), 0, 0
        while at >= 0:
            place += joined.count(b" ", seen, at)
            seen = at
            out.append((place, label))
            at = joined.find(wanted, at + 1)
    return sorted(out)


def scan(docs: DataFrame, *, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with n_words, n_base, first_word, last_word, base_labels, labels and score."""
    index = docs.sparkSession.sparkContext.broadcast(Index.build(word_frequency(docs, templates, text_col=text_col), templates, threshold))
    added = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double"}
    own = others(docs, text_col, *added)
    rows = docs.select(*own, text_col)
    schema = rows.select(*own, *[F.lit(None).cast(kind).alias(c) for c, kind in added.items()]).schema

    def run(batches):
        for b in batches:
            out = []
            for text in b.column(text_col).to_pylist():
                words = words_of(text)
                base = phrase_places(words, phrases)
                more = index.value.matches(words)
                labels = {x for _, x in base}
                out.append((len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)),
                            ",".join(sorted(labels | more.keys())), 1.0 if base else max(more.values(), default=0.0)))
            made = zip(*out) if out else ([] for _ in added)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), *(pa.array(list(x), k) for x, k in zip(made, kinds))], names=[*own, *added])

    return rows.mapInArrow(run, schema)
