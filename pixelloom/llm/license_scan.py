"""Licences: stated phrases, and licence texts found by a positional rare-token index.

Phrases such as "mit license" give labels wherever their words stand together.
Licence texts that don't name themselves that way are found by position: the
index has the postings (template, position) of every template word. Of each
template's words that a document holds, those with the highest inverse
document frequency are looked up first, ``RAREST`` at a time; each of their places votes for the offset at which the
template would begin, and an offset with ``AGREE`` different words in agreement
(within ``SLACK`` words) is a candidate. It becomes a label if one of the
template's mandatory key phrases stands inside the stretch it would cover. While
none does, the next rarest words are looked up until all have been; so the labels are those
of an exhaustive alignment, and rare words elsewhere in a text hide nothing. Templates none of whose
key phrases stands in the text can't be verified and aren't looked up.

At scale: document frequencies are counted over all documents, as sums per
batch and word that Spark adds up; there are no more of them than template
words, so they are broadcast. A second pass scans the texts in Arrow batches.
No text is shuffled.

Defined results
* null or empty text: no words, no places, first_word and last_word null, no labels, score 0.
* very long text: searched whole, in linear time. Repeated rows: alike. Empty table: empty result.
* null doc_id: passed through. Extra columns: ``find`` keeps them; an own name that the input has, too, gets an underscore behind it.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, for_python, row_of, table
from .decontaminate import folded_words

RAREST, AGREE, SLACK = 12, 4, 6

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public licences, short ones whole, of others the notices by which they ask to be applied, and phrases
# without which a stretch isn't one.
_NO_WARRANTY = "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        f"The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, {_NO_WARRANTY}.",
        ("permission is hereby granted free of charge to any person obtaining a copy of this software",),
    ),
    "apache": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        ("apache org licenses license 2 0", "except in compliance with the license"),
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
        ("terms of the gnu general public license",),
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
        ("gnu lesser general public license",),
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
        ("gnu affero general public license",),
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        ("mozilla public license",),
    ),
    "cc-by": (
        "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA",
        ("creative commons attribution", "creativecommons org licenses by"),
    ),
    "bsd": (_BSD, ("redistribution and use in source and binary forms", "redistributions of source code must retain")),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        ("for any purpose with or without fee is hereby granted",),
    ),
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "This notice may not be removed or altered from any source distribution.",
        ("the origin of this software must not be misrepresented", "altered source versions must be plainly marked"),
    ),
    "boost": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
        ("any person or organization obtaining a copy of the software and accompanying documentation",),
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ("free and unencumbered software released into the public domain",),
    ),
}


class Index:
    """Postings of template words, and the key phrases of each template."""

    def __init__(self, templates: dict[str, tuple[str, tuple[str, ...]]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.phrases = [(b" %b " % p.encode(), label) for p, label in phrases.items()]
        self.words = {label: folded_words(text) for label, (text, _) in templates.items()}
        self.keys = {label: [b" %b " % b" ".join(folded_words(k)) for k in keys] for label, (_, keys) in templates.items()}
        self.postings: dict[bytes, list[tuple[str, int]]] = defaultdict(list)
        for label, words in self.words.items():
            for at, word in enumerate(words):
                self.postings[word].append((label, at))
        self.vocabulary = frozenset(self.postings)
        self.needs = {label: [self.vocabulary.intersection(folded_words(k)) for k in keys] for label, (_, keys) in templates.items()}


def places(joined: bytes, phrase: bytes) -> tuple[int, int, int]:
    """How often ``phrase`` stands in ``joined`` (both with a space at either end), and its first and last byte offset (-1: none)."""
    n, first, last, at = 0, -1, -1, joined.find(phrase)
    while at >= 0:
        n, first, last = n + 1, at if first < 0 else first, at
        at = joined.find(phrase, at + 1)
    return n, first, last


def scan(text: str | None, index: Index, idf: dict[bytes, float]) -> tuple[int, int, int | None, int | None, list[str], list[str], float]:
    """n_words, n_base, first_word, last_word, base_labels, labels and score of a text."""
    words = folded_words(text)
    joined = b" %b " % b" ".join(words)
    n_base, firsts, lasts, base = 0, [], [], set()
    for phrase, label in index.phrases:
        n, first, last = places(joined, phrase)
        if n:
            n_base += n
            firsts.append(first)
            lasts.append(last)
            base.add(label)
    labels, score = set(base), 1.0 if base else 0.0
    for label, share in aligned(words, index, idf).items():
        labels.add(label)
        score = max(score, share)
    word_at = lambda byte: joined.count(b" ", 0, byte)
    first, last = (word_at(min(firsts)), word_at(max(lasts))) if n_base else (None, None)
    return len(words), n_base, first, last, sorted(base), sorted(labels), score


def aligned(words: list[bytes], index: Index, idf: dict[bytes, float]) -> dict[str, float]:
    """Labels of templates that align with ``words``, with the share of the template's weight found in the stretch."""
    held = index.vocabulary.intersection(words)
    # No key phrase stands where one of its words is missing, so the template can't be verified.
    likely = [label for label in index.words if any(need <= held for need in index.needs[label])]
    if not likely:
        return {}
    joined = b" %b " % b" ".join(words)
    where: dict[bytes, list[int]] | None = None
    best: dict[str, float] = {}
    for label in likely:
        if not any(key in joined for key in index.keys[label]):
            continue
        if where is None:
            where = defaultdict(list)
            for at, word in enumerate(words):
                if word in held:
                    where[word].append(at)
        template, verified = index.words[label], None
        ranked = sorted(held.intersection(template), key=lambda w: (-idf.get(w, 0.0), w))
        votes: dict[int, set[bytes]] = defaultdict(set)
        refused: set[int] = set()
        for at in range(0, len(ranked), RAREST):
            for word in ranked[at : at + RAREST]:
                for _, place in (posting for posting in index.postings[word] if posting[0] == label):
                    for k in where[word]:
                        cell = (k - place) // SLACK
                        votes[cell].add(word)
                        votes[cell + 1].add(word)
            for cell in [c for c, agreeing in votes.items() if len(agreeing) >= AGREE and c not in refused]:
                start = max(0, (cell - 2) * SLACK)
                stretch = words[start : max(0, (cell + 2) * SLACK) + len(template)]
                inside = b" %b " % b" ".join(stretch)
                if any(key in inside for key in index.keys[label]):
                    # Floor weights above zero, so that words which every document has still count a little.
                    weight = {w: 0.01 + idf.get(w, 0.0) for w in template}
                    share = sum(weight[w] for w in set(template) & set(stretch)) / sum(weight.values())
                    verified = max(verified or 0.0, share)
                else:
                    refused.add(cell)
            if verified is not None:
                best[label] = verified
                break
    return best


def word_idf(docs: DataFrame, text_col: str, index: Index) -> dict[bytes, float]:
    """Inverse document frequency of every template word over all documents.

    The driver gets one number per template word, however many documents there are.
    """
    vocabulary = index.vocabulary

    def run(batches):
        for batch in batches:
            counts: Counter[bytes] = Counter()
            for text in batch.column(0).to_pylist():
                counts.update(vocabulary.intersection(folded_words(text)))
            counts[b""] += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    found = docs.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {bytes(r["word"]): r["n"] for r in found}
    every = df.get(b"", 0)
    return {w: math.log((1 + every) / (1 + df.get(w, 0))) for w in vocabulary}


def find(docs: DataFrame, text_col: str = "text", templates: dict | None = None, phrases: dict | None = None) -> DataFrame:
    """``docs`` with the text replaced by n_words, n_base, first_word, last_word, base_labels, labels (arrays) and score."""
    spark = docs.sparkSession
    for_python(spark)
    index = Index(templates or TEMPLATES, phrases or PHRASES)
    shared = spark.sparkContext.broadcast((index, word_idf(docs, text_col, index)))
    lean = docs.select(row_of(docs, text_col).alias("row"), F.col(text_col).alias("text"))
    types = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches):
        for batch in batches:
            index, idf = shared.value
            rows = [scan(t, index, idf) for t in batch.column(1).to_pylist()]
            arrays = [pa.array([r[k] for r in rows], types[k]) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["row", *names])

    from pyspark.sql.types import StructType, _parse_datatype_string

    more = _parse_datatype_string("n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double")
    return beside(lean.mapInArrow(run, StructType([lean.schema["row"], *more.fields])), [c for c in docs.columns if c != text_col], names)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumns({"base_labels": F.array_join("base_labels", ","), "labels": F.array_join("labels", ",")})
