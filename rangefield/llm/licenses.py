"""Licence scan: normalised texts against licence templates by Dice coefficient over word bigrams.

Texts are lower-cased (A-Z) and cut into words of `[a-z0-9]`.  Compared are the
whole text, its blocks (between empty lines) and its lines, each as the set of
its word bigrams.  A template with b bigrams can reach the threshold t only for
units of b * t / (2 - t) to b * (2 - t) / t bigrams; all others are pruned
before any comparison.  Units with fewer than two words have no bigrams and
match nothing.  Documents in which fewer template bigrams occur than the
smallest template needs are dropped by a vectorised test first.

The result has a row per document and licence with the highest coefficient of
its units and the number of lines that match.

Defined cases: null, empty and very short texts match nothing; texts of any
length are read whole; repeated rows give repeated results; an empty table
gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import LOWER, Words, map_text, mix, span_sums

THRESHOLD = 0.8

#: Notices and texts of widely used licences.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

_WORD = re.compile(rb"[a-z0-9]+")
KEEP = np.zeros(256, bool)
KEEP[[*range(48, 58), *range(97, 123)]] = True


def bigrams(text: bytes) -> set[tuple[bytes, bytes]]:
    """The word bigrams of a text in lower case."""
    words = _WORD.findall(text)
    return set(zip(words, words[1:], strict=False))


def _lower(text: str) -> bytes:
    return LOWER[np.frombuffer(text.encode(), np.uint8)].tobytes()


class Scanner:
    """Templates by their bigrams, ready to compare."""

    def __init__(self, templates: dict[str, list[str]], threshold: float):
        self.threshold = threshold
        self.templates = [(name, own) for name, texts in templates.items() for text in texts if (own := bigrams(_lower(text)))]
        two = pa.array([" ".join(x.decode() for x in pair) for pair in sorted(set().union(*[own for _, own in self.templates]))], pa.string())
        words = Words(two, lower=True, keep=KEEP)
        self.hashes = np.sort(self.pairs(words)[1][words.range[:-1]]) if len(two) else np.zeros(0, np.uint64)
        self.least = min((self.needed(len(own)) for _, own in self.templates), default=1)

    def needed(self, size: int) -> int:
        """Bigrams that a unit must share with a template of `size` at least."""
        return max(1, int(np.ceil(self.threshold * (size + size * self.threshold / (2 - self.threshold)) / 2 - 1e-9)))

    @staticmethod
    def pairs(words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(document, hash) of each word with the next one of its document, the last with itself alone."""
        hashes = words.hashes()
        after = np.append(hashes[1:], np.uint64(0))
        after[words.range[1:][words.count > 0] - 1] = 0
        return words.doc, mix(hashes * np.uint64(31) + after)

    def unit(self, text: bytes, found: dict[str, float]) -> set[str]:
        """The licences that a unit matches; keeps the highest coefficients in `found`."""
        own = bigrams(text)
        names: set[str] = set()
        t = self.threshold
        for name, template in self.templates:
            if own and len(template) * t <= len(own) * (2 - t) + 1e-9 and len(own) * t <= len(template) * (2 - t) + 1e-9:
                dice = 2 * len(own & template) / (len(own) + len(template))
                if dice >= t:
                    names.add(name)
                    found[name] = max(found.get(name, 0.0), dice)
        return names

    def scan(self, column: pa.Array) -> list[tuple[int, str, float, int]]:
        """(row, licence, coefficient, matching lines) of a slice of texts."""
        words = Words(column, lower=True, keep=KEEP)
        _, pairs = self.pairs(words)
        if not len(pairs) or not len(self.hashes):
            return []
        at = np.minimum(np.searchsorted(self.hashes, pairs), len(self.hashes) - 1)
        hits = span_sums(self.hashes[at] == pairs, words.range)
        out = []
        for i in np.flatnonzero(hits >= self.least):
            text = words.buf[words.off[i] : words.off[i + 1]].tobytes()
            best: dict[str, float] = {}
            lines: dict[str, int] = {}
            self.unit(text, best)
            for block in re.split(rb"\n\n+", text):
                self.unit(block, best)
            for line in text.split(b"\n"):
                for name in self.unit(line, best):
                    lines[name] = lines.get(name, 0) + 1
            out += [(int(i), name, dice, lines.get(name, 0)) for name, dice in sorted(best.items())]
        return out


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice and n_lines for every document and licence that match."""
    own = templates if templates is not None else TEMPLATES
    cache: dict = {}

    def kernel(batch: pa.RecordBatch) -> dict | None:
        if "scanner" not in cache:
            cache["scanner"] = Scanner(own, threshold)
        rows = cache["scanner"].scan(batch.column("text"))
        if not rows:
            return None
        at, names, dice, lines = zip(*rows, strict=True)
        return {"doc_id": batch.column("doc_id").take(pa.array(at)), "license": list(names), "dice": np.array(dice), "n_lines": np.array(lines)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_text(docs.select("doc_id", "text"), kernel, f"doc_id {kind}, license string, dice double, n_lines long")


def op6(docs: DataFrame) -> DataFrame:
    """All documents against all templates."""
    return scan(docs).withColumn("dice", F.round("dice", 6))


def _oracle() -> str:
    rows = ", ".join(f"('{n}', {i}, '{t.replace(chr(39), chr(39) * 2)}')" for i, (n, t) in enumerate((n, t) for n, ts in TEMPLATES.items() for t in ts))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"list_filter(string_split_regex(translate({{}}, '{upper}', '{lower}'), '[^a-z0-9]+'), lambda x: x <> '')"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH templates AS (SELECT name, id, {pairs} AS b FROM (SELECT name, id, {words.format("t")} AS w FROM (VALUES {rows}) AS v(name, id, t))),
units AS (
  SELECT doc_id, 0 AS line, text AS u FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, 0, unnest(string_split_regex(text, '\\n\\n+')) FROM documents
  UNION ALL SELECT doc_id, 1, unnest(string_split(text, chr(10))) FROM documents),
sets AS (SELECT doc_id, line, {pairs} AS b FROM (SELECT doc_id, line, {words.format("u")} AS w FROM units) WHERE len(w) > 1),
pairs AS (
  SELECT s.doc_id, s.line, t.name, t.id, 2.0::DOUBLE * len(list_intersect(s.b, t.b)) / (len(s.b) + len(t.b)) AS dice
  FROM sets s JOIN templates t ON len(t.b) * {THRESHOLD} <= len(s.b) * {2 - THRESHOLD} AND len(s.b) * {THRESHOLD} <= len(t.b) * {2 - THRESHOLD}),
best AS (SELECT doc_id, name, max(dice) AS dice FROM pairs WHERE dice >= {THRESHOLD} GROUP BY doc_id, name),
numbered AS (SELECT doc_id, line, b, row_number() OVER () AS r FROM sets WHERE line = 1),
counts AS (
  SELECT n.doc_id, t.name, count(DISTINCT n.r) AS n_lines FROM numbered n JOIN templates t
    ON len(t.b) * {THRESHOLD} <= len(n.b) * {2 - THRESHOLD} AND len(n.b) * {THRESHOLD} <= len(t.b) * {2 - THRESHOLD}
  WHERE 2.0::DOUBLE * len(list_intersect(n.b, t.b)) / (len(n.b) + len(t.b)) >= {THRESHOLD} GROUP BY n.doc_id, t.name)
SELECT b.doc_id, b.name AS license, round(b.dice, 6) AS dice, CAST(coalesce(c.n_lines, 0) AS BIGINT) AS n_lines
FROM best b LEFT JOIN counts c ON b.doc_id = c.doc_id AND b.name = c.name
"""


ORACLE = _oracle()
