"""Licence scan by a positional index of rare tokens.

Document frequencies of the templates' words are counted over all documents. The index posts, for each
template, its words of highest inverse document frequency with their positions: ``POSTED``, or as many more as
it takes that no place agrees by ``MIN_AGREED`` without ``MIN_VOTES`` posted positions. A file looks up every
posted word that it holds; equal differences between its own and the posted positions are votes for a template
at an offset. There the template is laid over the file: the share of its weight that agrees word by word is the
score, and a label needs ``MIN_AGREED`` of it as well as the template's mandatory key phrases inside the covered
words. So every place that earns a label is found, however long the file and however many licences it holds.

Base phrases are found in any place and always give their label.

Templates are a parameter. ``of_texts`` makes them of whole licences (label, text): a text is cut into its paragraphs,
and each paragraph that is long enough and has words of its own label's alone becomes a template, whose key phrase is
cut from those words; ``scan(documents, TEMPLATES + of_texts(texts))`` then labels files that hold a licence itself. The
repository carries the notices and short licences of ``TEMPLATES``, no bodies of long ones.

Cases
- null or empty text: no words, no labels, score 0. Very long texts are scanned whole. Repeated rows: each is scanned alone.
- equal frequencies: words in alphabetical order.
- several places of one template, of equal agreement or not: the best of those that earn the label, else the best of all. A score under
  ``MIN_AGREED`` is that of the best place with enough votes.
- a word of a template that alone weighs ``MIN_AGREED``: one vote is enough there.
- a template at the very start or end of a file may be cut off; what is missing does not agree.
- a null doc_id keeps its row. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

POSTED, MIN_VOTES, MIN_AGREED = 8, 2, 0.6

# Phrases of the base scan and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label, a notice or one paragraph of a licence's text, mandatory key phrases. A licence of several
# paragraphs has one template for each that is its own.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0", ["apache license", "version 2 0"]),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ["apache license", "in compliance with the license"]),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ["as is basis without warranties or conditions of any kind"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", ["redistributions of source code must retain the above copyright notice"]),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ["redistributions in binary form must reproduce the above copyright notice"]),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.", ["procurement of substitute goods or services"]),
    ("bsl", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:", ["any person or organization obtaining a copy", "covered by this license"]),
    ("cc-by", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version", ["general public license", "free software foundation"]),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see", ["gnu general public license along with this program"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ["for any purpose with or without fee is hereby granted"]),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.", ["the author disclaims all warranties with regard to this software"]),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["lesser general public license"]),
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", ["permission is hereby granted free of charge", "without restriction"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ["permission is hereby granted free of charge", "without restriction"]),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ["shall be included in all copies or substantial portions of the software"]),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ["mozilla public license"]),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ["free and unencumbered software"]),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ["anyone is free to copy", "as a compiled binary"]),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", ["in no event will the authors be held liable"]),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", ["to alter it and redistribute it freely"]),
]


#: Words of a paragraph that can be a template, and of its key phrase.
LEAST, KEY = 12, 5


def of_texts(texts: list[tuple[str, str]], least: int = LEAST, key: int = KEY) -> list[tuple[str, str, list[str]]]:
    """Templates of whole licences (label, text; several texts of a label are its versions).

    A phrase of ``key`` words is a label's own if no text of another label holds it. A paragraph (separated by empty
    lines) without such a phrase, or of fewer than ``least`` words, says nothing about its label and is left out; of its own
    phrases the one whose words fewest texts hold, the first of equals, is mandatory. Texts and templates are held by
    the driver, so they are a table of licences, not of files.
    """
    words = [(label, shared.alnum_words(text)) for label, text in texts]
    holders: dict[tuple[bytes, ...], set[str]] = {}
    spread = Counter(w for _, ws in words for w in set(ws))
    for label, ws in words:
        for i in range(len(ws) - key + 1):
            holders.setdefault(tuple(ws[i : i + key]), set()).add(label)
    out, seen = [], set()
    for label, text in texts:
        for paragraph in re.split(r"\n[ \t\r]*\n", text):
            ws = shared.alnum_words(paragraph)
            own = [p for i in range(len(ws) - key + 1) if holders[p := tuple(ws[i : i + key])] == {label}]
            if len(ws) < least or not own or (label, tuple(ws)) in seen:
                continue
            seen.add((label, tuple(ws)))
            rarest = min(own, key=lambda p: sum(spread[w] for w in p))
            out.append((label, b" ".join(ws).decode(), [b" ".join(rarest).decode()]))
    return out


def _vocabulary(templates: list[tuple[str, str, list[str]]]) -> set[bytes]:
    return {w for _, text, _ in templates for w in shared.alnum_words(text)}


def _document_counts(vocabulary: set[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = Counter(), 0
        for b in batches:
            for text in b.column("text"):
                df.update(vocabulary.intersection(shared.alnum_words(text.as_py())))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([None, *(w.decode() for w in df)], pa.string()), pa.array([n, *df.values()], pa.int64())], ["word", "n"])

    return run


def idf(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, float]:
    """Of the vocabulary's words over all documents; one row for each word reaches the driver."""
    rows = shared.in_batches(docs.select("text"), _document_counts(vocabulary), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {r.word: r.n for r in rows}
    return {w: float(np.log1p((1 + df.get(None, 0)) / (1 + df.get(w.decode(), 0)))) for w in vocabulary}


def _starts(ws: list[bytes], phrase: list[bytes], first: int = 0, stop: int | None = None) -> list[int]:
    """Where the phrase's words stand consecutively in ws[first:stop]."""
    stop, found, n = len(ws) if stop is None else stop, [], len(phrase)
    try:
        at = ws.index(phrase[0], first, stop)
        while at + n <= stop:
            if ws[at : at + n] == phrase:
                found.append(at)
            at = ws.index(phrase[0], at + 1, stop)
    except ValueError:
        pass
    return found


class Index:
    def __init__(self, templates: list[tuple[str, str, list[str]]], weights: dict[bytes, float]):
        self.weights = weights
        self.templates = [(label, shared.alnum_words(text), [shared.alnum_words(p) for p in phrases]) for label, text, phrases in templates]
        self.total = [sum(weights[w] for w in ws) for _, ws, _ in self.templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.needed: list[int] = []
        for k, (_, ws, _) in enumerate(self.templates):
            rarest = sorted(set(ws), key=lambda w: (-weights[w], w))
            n = next((n for n in range(min(POSTED, len(rarest)), len(rarest) + 1) if self._sure(k, rarest[:n])), None)
            self.needed.append(MIN_VOTES if n is not None else 1)
            for w in rarest[:n]:
                self.postings.setdefault(w, []).extend((k, i) for i, x in enumerate(ws) if x == w)
        self.base = [(shared.alnum_words(p), label) for p, label in BASE.items()]

    def _sure(self, k: int, posted: list[bytes]) -> bool:
        """Whether MIN_AGREED of template k cannot be reached with fewer than MIN_VOTES positions of these words."""
        agree = sorted((self.weights[w] for w in self.templates[k][1] if w in posted), reverse=True)[: MIN_VOTES - 1]
        rest = sum(self.weights[w] for w in self.templates[k][1] if w not in posted)
        return rest + sum(agree) < (MIN_AGREED - 1e-9) * self.total[k]

    def base_places(self, ws: list[bytes], there: set[bytes]) -> list[tuple[int, str]]:
        return [(i, label) for phrase, label in self.base if there.issuperset(phrase) for i in _starts(ws, phrase)]

    def matches(self, ws: list[bytes]) -> list[tuple[str, float]]:
        """(label or '', agreement) of each template at its best offset; no label where a check fails at all of them."""
        votes: dict[tuple[int, int], int] = Counter((k, p - i) for p, w in enumerate(ws) if w in self.postings for k, i in self.postings[w])
        found: dict[int, tuple[bool, float]] = {}
        for (k, offset), n in votes.items():
            _, template, phrases = self.templates[k]
            if n < self.needed[k]:
                continue
            laid = ws[max(offset, 0) : max(offset + len(template), 0)]
            shift = max(-offset, 0)
            agreed = sum(self.weights[t] for t, w in zip(template[shift:], laid, strict=False) if t == w) / self.total[k]
            last = min(len(ws), offset + len(template) + 2)
            fine = agreed >= MIN_AGREED and all(_starts(ws, p, max(offset - 2, 0), last) for p in phrases)
            found[k] = max(found.get(k, (False, 0.0)), (fine, agreed))
        return [(self.templates[k][0] if fine else "", agreed) for k, (fine, agreed) in found.items()]


def _scan(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        for b in batches:
            rows = []
            for text in b.column("text"):
                ws = shared.alnum_words(text.as_py())
                there = set(ws)
                places = ix.base_places(ws, there)
                matched = ix.matches(ws)
                base = {label for _, label in places}
                starts = [i for i, _ in places]
                rows.append((
                    len(ws), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                    ",".join(sorted(base | {label for label, _ in matched if label})), min(1.0, max((a for _, a in matched), default=0.0)),
                ))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return run


def scan(documents: DataFrame, templates: list[tuple[str, str, list[str]]] = TEMPLATES) -> DataFrame:
    """The templates are a fixed list, so the broadcast index has a fixed size."""
    docs = shared.pick(documents, doc_id="bigint", text="string")
    index = Index(templates, idf(docs, _vocabulary(templates)))
    schema = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return shared.in_batches(docs, _scan(documents.sparkSession.sparkContext.broadcast(index)), schema)


def op7_rare_token_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(shared.table(spark, sf_dir, "documents"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op7_rare_token_licenses that SQL can express: the base phrases."""
    return op7_rare_token_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


BASE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
), phrase(ws, label) AS (
  VALUES (['mit', 'license'], 'mit'), (['apache', 'license'], 'apache'), (['general', 'public', 'license'], 'gpl')
), place AS (
  SELECT rid, label, p - 1 AS p FROM (SELECT rid, d.ws, phrase.ws AS ph, label, unnest(range(1, len(d.ws) + 1)) AS p FROM d, phrase) WHERE ws[p:p + len(ph) - 1] = ph
), found AS (
  SELECT rid, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels
FROM d LEFT JOIN found USING (rid)
"""
