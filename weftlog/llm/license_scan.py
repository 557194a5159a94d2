"""License scans by an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import bisect
import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlog.llm.common import map_texts
from weftlog.llm.vector_text import PLAIN

TABLE = bytes(PLAIN)
CONTAINMENT = 0.8

#: Phrases whose places are counted, and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Templates of the method: label, and the sentence whose words a block must hold.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The software is provided as is, without warranty of any kind, express or implied"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 you may not use this file except in compliance with the License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2", "You can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation version 2"),
    ("lgpl", "This library is free software licensed under the GNU Lesser General Public License"),
    ("agpl-3", "You should have received a copy of the GNU Affero General Public License along with this program"),
    ("bsd-3", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("isc", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted"),
]
#: Whole notices and license texts, as templates of their own.
TEMPLATES += [
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("bsd-2", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("bsl-1", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
]


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of a-z, 0-9 and bytes from 0x80, after A-Z are lower-cased."""
    return (text or b"").translate(TABLE).split()


def frequencies(docs: DataFrame, vocabulary: list[bytes], text: str = "text") -> dict[bytes, int]:
    """In how many texts of the corpus each template word stands: every task sends one row a word, and they are summed."""
    place = {w: i for i, w in enumerate(vocabulary)}

    def count(batches):
        import pyarrow as pa

        found = np.zeros(len(place), np.int64)
        for batch in batches:
            for t in batch.column(0).cast(pa.large_binary()):
                for w in place.keys() & set(words_of(t.as_py())):
                    found[place[w]] += 1
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(found[some], pa.int64())], names=["i", "n"])

    parts = docs.select(F.col(text).alias("text")).mapInArrow(count, T.StructType([T.StructField("i", T.LongType()), T.StructField("n", T.LongType())]))
    return {vocabulary[r["i"]]: r["n"] for r in parts.groupBy("i").agg(F.sum("n").alias("n")).collect()}


@dataclass
class Template:
    label: str
    need: int  # common words for the containment
    size: int
    length: int  # words of a block: of the sentence, repeats counted, and as many more as the containment leaves room for
    rank: dict  # word: its place, the rarest of the corpus first
    head: frozenset  # the prefix: a block with enough of the words has one of these


def prepare(templates: list[tuple[str, str]], often: dict[bytes, int], containment: float) -> list[Template]:
    out = []
    for label, sentence in templates:
        own = sorted(set(words_of(sentence.encode())), key=lambda w: (often.get(w, 0), w))
        need = math.ceil(containment * len(own) - 1e-9)
        out.append(Template(label, need, len(own), math.ceil(len(words_of(sentence.encode())) / containment - 1e-9), {w: i for i, w in enumerate(own)}, frozenset(own[: len(own) - need + 1])))
    return out


def match(block: list[bytes], index: dict[bytes, list[int]], templates: list[Template]) -> dict[int, float]:
    """Templates of which the block holds enough words: number and containment.

    Prefix filter: a common word among the template's rarest. Length filter: enough distinct words. Positional
    filter: the first common word at place p leaves size - p words, which must suffice.
    """
    own = set(block)
    found: dict[int, float] = {}
    for i in {i for w in index.keys() & own for i in index[w]}:
        t = templates[i]
        if len(own) < t.need or t.size - min(t.rank[w] for w in t.head & own) < t.need:
            continue
        common = len(t.rank.keys() & own)
        if common >= t.need:
            found[i] = common / t.size
    return found


def runs(words: list[bytes], index: dict[bytes, list[int]], templates: list[Template]) -> list[tuple[int, int, int, float]]:
    """(start, end, template, containment) of blocks, runs of a template's length whatever their lines, that hold enough of its words.

    The text as a whole goes through the filters of `match` first. A block must then hold a word of the template's prefix, so
    only the places within a block's length of one are looked at. Of blocks of one template that overlap, the one that holds
    most stays, cut to the words that it shares.
    """
    some = match(words, index, templates)
    if not some:
        return []
    places: dict[bytes, list[int]] = {w: [] for i in some for w in templates[i].rank}
    for k, w in enumerate(words):
        if w in places:
            places[w].append(k)
    out = []
    for i in some:
        t = templates[i]
        rare = sorted(k for w in t.head for k in places[w])
        at = sorted((k, r) for w, r in t.rank.items() for k in places[w])
        if len(at) > 4 * t.length:
            at = [(k, r) for k, r in at if (j := bisect.bisect_left(rare, k - t.length + 1)) < len(rare) and rare[j] < k + t.length]
        held, common, end, fits = [0] * t.size, 0, 0, []
        for j, (k, r) in enumerate(at):  # a block may as well begin with a word of the template
            while end < len(at) and at[end][0] < k + t.length:
                common += held[at[end][1]] == 0
                held[at[end][1]] += 1
                end += 1
            if common >= t.need:
                own: set[int] = set()
                while len(own) < common:  # as far as it holds a word more
                    own.add(at[j][1])
                    j += 1
                fits.append((-common, at[j - 1][0] + 1 - k, k))
            held[r] -= 1
            common -= held[r] == 0
        taken: list[int] = []  # starts and ends by turns, in order
        for less, n, k in sorted(fits):
            j = bisect.bisect_right(taken, k)
            if j % 2 == 0 and (j == len(taken) or taken[j] >= k + n):
                taken[j:j] = [k, k + n]
                out.append((k, k + n, i, -less / t.size))
    return sorted(out)


def places_of(joined: bytes, phrase: bytes) -> list[int]:
    """The words (from 0) with which the phrase begins; words are counted from one place to the next."""
    out, at, n, last = [], joined.find(phrase), -1, 0
    while at >= 0:
        n += joined.count(b" ", last, at + 1)
        out.append(n)
        last = at + 1
        at = joined.find(phrase, at + 1)
    return out


def stretches(spans: list[tuple]) -> int:
    """Into how many stretches of words spans fall, those that overlap being one."""
    n, end = 0, -1
    for a, b, *_ in spans:
        n += a >= end
        end = max(end, b)
    return n


SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("label", T.StringType()), T.StructField("containment", T.DoubleType())]))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Licenses of every whole text: fixed phrases, and blocks that hold enough of a template's words.

    Returns doc_id, n_words, n_base (places of all phrases), first_word and last_word (smallest and
    largest start of one, from 0; null without), base_labels and labels (distinct, sorted, joined by commas; labels
    holds the base ones and the method's), score (1 for a phrase, else the highest containment of at
    least the threshold, else 0), n_blocks (stretches of words that a template matched), main_label (of the template that has most
    words in common with a block; null without), spans (the blocks: first and last word, label, containment). A block is any run of
    as many words as a template has divided by the threshold, whatever its lines, or the whole text if it is shorter: every template with
    |block and template| >= containment * |template| in some block gives its label, so a notice whose words
    another's include gives both labels. A null or empty text has no words and empty
    labels; an empty table gives no rows. Repeated rows are scanned each; other columns are not read.
    """
    vocabulary = sorted({w for _, s in templates for w in words_of(s.encode())})
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ready = prepare(templates, frequencies(d, vocabulary), containment)
    index: dict[bytes, list[int]] = {}
    for i, t in enumerate(ready):
        for w in t.head:
            index.setdefault(w, []).append(i)
    phrase = [(b" " + p.encode() + b" ", label) for p, label in PHRASES]
    anchor = re.compile(b"|".join(re.escape(p.encode().split()[-1]) for p, _ in PHRASES))

    def make(texts: list) -> list:
        out: list[list] = [[] for _ in range(10)]
        for t in texts:
            words = words_of(t)
            starts, base = [], set()
            if t and anchor.search(joined := b" " + b" ".join(words) + b" "):
                for p, label in phrase:
                    if at := places_of(joined, p):
                        starts += at
                        base.add(label)
            spans = [] if index.keys().isdisjoint(words) else runs(words, index, ready)
            labels = base | {ready[i].label for _, _, i, _ in spans}
            score = 1.0 if starts else max((c for *_, c in spans), default=0.0)
            best = max(spans, key=lambda x: (x[3] * ready[x[2]].size, x[3], -x[0]), default=None)
            found = [{"first": a, "last": b - 1, "label": ready[i].label, "containment": c} for a, b, i, c in spans]
            row = (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, stretches(spans), best and ready[best[2]].label, found)
            for column, x in zip(out, row, strict=True):
                column.append(x)
        return out

    long, string = T.LongType(), T.StringType()
    kinds = [("n_words", long), ("n_base", long), ("first_word", long), ("last_word", long), ("base_labels", string), ("labels", string), ("score", T.DoubleType()), ("n_blocks", long), ("main_label", string), ("spans", SPANS)]
    return map_texts(d, ["doc_id"], "text", [T.StructField(n, k) for n, k in kinds], make)
