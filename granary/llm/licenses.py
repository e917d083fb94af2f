"""Operator 8: licence scan by Dice coefficient over word bigrams.

Text is normalised to its runs of ASCII letters and digits, in lower case.  A
template is compared with windows that begin at the first and end at the last word of
a bigram that the template has, wherever on a line these stand; other windows could
only be worse.  The score is 2 * common / (bigrams of the window +
bigrams of the template), counted with repeats.

Size bounds prune templates first: at a threshold t a window of n bigrams can only
match templates of between t / (2 - t) * n and (2 - t) / t * n bigrams, so most texts
and starts are left out by their shared bigrams, and no window is longer than the
largest template allows.  OP8_SQL compares all such windows of all templates.

Each document is scanned by itself in one pass, without a shuffle; a line that a
third of all documents share costs no more than others.  The templates are a
parameter (name -> text) that goes along with the task.

Null and empty texts have no match and come out with nulls; repeated rows give
repeated results; an empty table gives an empty result.  Ties go to the smaller
first line, then to fewer lines, then to the template's name.
"""

from __future__ import annotations

import functools
import pkgutil
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_slices, table

THRESHOLD = 0.8
_WORD = re.compile(r"[A-Za-z0-9]+")

#: Short notices and headers of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
}


#: Notices of further licences, and whole texts that are not in the folder license_texts.
FURTHER = {
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD": "Released under the BSD License.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "ISC": "Released under the ISC License.",
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD "
        "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT-text": (
        TEMPLATES["MIT-permission"] + " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
        "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES "
        "OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-short": "Licensed under the Mozilla Public License, version 2.0.",
}
#: Notices that differ in a word or a version only: where their windows overlap, the best one is the licence.
ALIKE = {"GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0"}
_TEXTS = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause"}


@functools.lru_cache(maxsize=1)
def all_templates() -> dict[str, str]:
    """Notices, and the whole texts of the package's folder; read on the driver."""
    return TEMPLATES | FURTHER | {f"{name}-text": pkgutil.get_data(__package__, f"license_texts/{file}.txt").decode() for file, name in _TEXTS.items()}


class Scanner:
    """Templates as bigram counts, with the size bounds of a threshold."""

    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold = threshold
        self.grams = {name: Counter(self._bigrams(_words(text))) for name, text in templates.items()}
        self.grams = {name: grams for name, grams in self.grams.items() if grams}
        self.sizes = {name: grams.total() for name, grams in self.grams.items()}
        self.owners: dict[tuple[str, str], list[tuple[str, int]]] = {}
        for name in sorted(self.grams):
            for gram, n in self.grams[name].items():
                self.owners.setdefault(gram, []).append((name, n))

    @staticmethod
    def _bigrams(words: list[str]) -> list[tuple[str, str]]:
        return list(zip(words, words[1:], strict=False))

    def most(self, size: int) -> float:
        return (2 - self.threshold) / self.threshold * size

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, dice, first line, lines) of the best window of each template that matches."""
        words, line_of = [], []
        for i, line in enumerate(text.split("\n")):
            own = _words(line)
            words += own
            line_of += [i] * len(own)
        hits: dict[tuple[str, str], list[int]] = {}
        for p, gram in enumerate(zip(words, words[1:], strict=False)):
            if gram in self.owners:
                hits.setdefault(gram, []).append(p)
        shared: Counter[str] = Counter()
        for gram, at in hits.items():
            for name, n in self.owners[gram]:
                shared[name] += min(n, len(at))
        found = []
        for name, common in shared.items():
            if 2 * common < self.threshold * (common + self.sizes[name]):
                continue  # too few shared bigrams in the whole text
            if (best := self._best(name, line_of, hits)) is not None:
                found.append((name, *best))
        kept, taken = [], []
        for name, dice, first, n, a, b in sorted(found, key=lambda m: (-m[1], m[2], m[3], m[0])):
            if name in ALIKE:
                if any(a <= y and x <= b for x, y in taken):
                    continue
                taken.append((a, b))
            kept.append((name, dice, first, n))
        return kept

    def _best(self, name: str, line_of: list[int], hits: dict[tuple[str, str], list[int]]) -> tuple[float, int, int, int, int] | None:
        """(dice, first line, lines, first word, last word) of the best window."""
        size, best = self.sizes[name], None
        # each shared bigram's place, and the place from which on a start still leaves it within the template's count
        places = sorted((p, at[k - n] if k >= n else -1) for gram, n in self.grams[name].items() for at in (hits.get(gram, ()),) for k, p in enumerate(at))
        at, barred = np.array(places, np.int64).T
        ends = np.searchsorted(at, at + int(self.most(size) + 1e-9), side="left")
        fewest = self.threshold / (2 - self.threshold) * size - 1e-9
        for i in np.flatnonzero(ends - np.arange(len(at)) >= fewest):
            p, j = at[i], ends[i]
            common = np.cumsum(barred[i:j] < p)
            if common[-1] < fewest:
                continue
            dice = 2 * common / (at[i:j] - p + 1 + size)
            k = int(np.argmax(dice))
            if dice[k] >= self.threshold:
                first, last = line_of[p], line_of[at[i + k] + 1]
                if best is None or (-dice[k], first, last - first + 1) < (-best[0], best[1], best[2]):
                    best = (float(dice[k]), first, last - first + 1, int(p), int(at[i + k] + 1))
        return best


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def _scan(batches, templates: dict[str, str], threshold: float):
    scanner = Scanner(templates, threshold)
    kind = pa.list_(pa.struct([pa.field("license", pa.string()), pa.field("dice", pa.float64()), pa.field("first_line", pa.int64()), pa.field("n_lines", pa.int64())]))
    for batch in batches:
        for a, b in row_slices(batch.column(1)):
            part = batch.slice(a, b - a)
            found = [[dict(zip(("license", "dice", "first_line", "n_lines"), m, strict=True)) for m in scanner.scan(t or "")] for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], names=["id", "matches"])


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, matches): for every row the best window of each template that matches, best first."""
    templates = all_templates() if templates is None else templates
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, matches array<struct<license string, dice double, first_line long, n_lines long>>"
    return rows.mapInArrow(lambda it: _scan(it, templates, threshold), schema).select(F.col("id").alias(id_col), "matches")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.get("matches", F.lit(0))
    return scanned(table(spark, sf_dir, "documents")).select(
        "doc_id", F.size("matches").cast("long").alias("n_matches"), best["license"].alias("license"), best["dice"].alias("dice"), best["first_line"].alias("first_line"), best["n_lines"].alias("n_lines")
    )


def _template_rows() -> str:
    return ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in all_templates().items())


OP8_SQL = f"""
WITH RECURSIVE t AS (SELECT name, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: lower(w)) AS ws FROM (VALUES {_template_rows()}) AS v(name, text)),
tg AS (SELECT name, a, b, count(*) AS c FROM (SELECT name, ws[i] AS a, ws[i + 1] AS b FROM (SELECT name, ws, unnest(range(1, len(ws))) AS i FROM t)) GROUP BY ALL),
ts AS (SELECT name, sum(c)::BIGINT AS m FROM tg GROUP BY name),
ln AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS ln FROM documents),
wd AS (
  SELECT doc_id, ln, w, row_number() OVER (PARTITION BY doc_id ORDER BY ln, i) AS p
  FROM (SELECT doc_id, ln, unnest(list_transform(regexp_extract_all(line, '[A-Za-z0-9]+'), lambda w: lower(w))) AS w,
               unnest(range(0, len(regexp_extract_all(line, '[A-Za-z0-9]+')))) AS i FROM ln)),
bg AS (SELECT doc_id, p, ln AS la, w AS a, lead(w) OVER o AS b, lead(ln) OVER o AS lb FROM wd WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
hit AS (SELECT doc_id, name, p, la, lb, bg.a, bg.b, c, m FROM bg JOIN tg ON bg.a = tg.a AND bg.b = tg.b JOIN ts USING (name)),
can AS (
  SELECT doc_id, name FROM (SELECT doc_id, name, a, b, least(count(*), any_value(c)) AS k, any_value(m) AS m FROM hit GROUP BY ALL)
  GROUP BY doc_id, name HAVING 2 * sum(k) >= {THRESHOLD} * (sum(k) + any_value(m))),
h AS (SELECT hit.* FROM hit JOIN can USING (doc_id, name)),
win AS (
  SELECT s.doc_id, s.name, s.m, s.p AS p0, e.p AS p1, s.la AS l0, e.lb AS l1 FROM h s JOIN h e ON e.doc_id = s.doc_id AND e.name = s.name AND e.p >= s.p
  WHERE 2 * least(e.p - s.p + 1, s.m) >= {THRESHOLD} * (e.p - s.p + 1 + s.m)),
cm AS (
  SELECT w.doc_id, w.name, p0, p1, l0, l1, w.m, h.a, h.b, least(count(*), any_value(c)) AS k
  FROM win w JOIN h ON h.doc_id = w.doc_id AND h.name = w.name AND h.p BETWEEN p0 AND p1 GROUP BY ALL),
sc AS (SELECT doc_id, name, p0, p1, l0, l1 - l0 + 1 AS n, 2 * sum(k)::DOUBLE / any_value(p1 - p0 + 1 + m) AS dice FROM cm GROUP BY doc_id, name, p0, p1, l0, l1),
ok AS (SELECT * FROM sc WHERE dice >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY dice DESC, l0, n, p0, p1) = 1),
alike AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, l0, n, name) AS k FROM ok WHERE name IN ({", ".join(f"'{x}'" for x in sorted(ALIKE))})),
free AS (
  SELECT doc_id, k, [p0] AS starts, [p1] AS ends, true AS taken FROM alike WHERE k = 1
  UNION ALL
  SELECT doc_id, k, CASE WHEN fits THEN list_append(starts, p0) ELSE starts END, CASE WHEN fits THEN list_append(ends, p1) ELSE ends END, fits
  FROM (SELECT a.doc_id, a.k, a.p0, a.p1, starts, ends, len(list_filter(range(1, len(starts) + 1), lambda i: a.p0 <= ends[i] + 1 AND starts[i] <= a.p1 + 1)) = 0 AS fits
        FROM free f JOIN alike a ON a.doc_id = f.doc_id AND a.k = f.k + 1)),
kept AS (SELECT * FROM ok WHERE name NOT IN ({", ".join(f"'{x}'" for x in sorted(ALIKE))}) UNION ALL SELECT a.* EXCLUDE (k) FROM alike a JOIN free f ON f.doc_id = a.doc_id AND f.k = a.k AND f.taken),
best AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS k FROM kept QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, l0, n, name) = 1)
SELECT d.doc_id, coalesce(k, 0)::BIGINT AS n_matches, name AS license, dice, l0::BIGINT AS first_line, n::BIGINT AS n_lines
FROM documents d LEFT JOIN best USING (doc_id)
"""
