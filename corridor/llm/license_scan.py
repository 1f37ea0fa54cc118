"""Operator 3: licence notices by patience alignment.

A text's words (runs of letters and digits, in lower case) are aligned with
each template's: equal ends are trimmed, words that occur once on either side
anchor the alignment along their longest increasing subsequence, and the gaps
between anchors are aligned in the same way.  Coverage is the share of the
template's words that the alignment finds; a place counts if it covers
``min_coverage`` (all words, for templates under ``short`` words) within
twice the template's length.

Whole texts are searched.  A text is set aside only by exact bounds: it must
hold enough of a template's words at all, and a place that covers the template
must contain one of any (words it may miss + 1) template words, so the
rarest such words in the text say where to align.  Everything is local to a
row: no shuffle, and templates travel with the tasks.

Defined results: a null or empty text has no licences; where places overlap,
the longer template wins, then the better coverage, the shorter place and the first; repeated
rows get the same result; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes as B
from ._store import table

# Public notices, as their licences word them.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."),
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "mit": "Released under the MIT License.",
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction, including without limitation the rights to "
        "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."),
}


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, first word of each text)."""
    low = B.lowered(data)
    letter = ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)) | (low >= 128)
    start, end, first = B.spans(low, offs, letter)
    return B.hashes(low, start, end), start, end, first


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places of equal words in ``a`` and ``b``, increasing in both."""
    pairs, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            pairs.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            pairs.append((j, m))
        if i == j or k == m:
            continue
        once_a, once_b = Counter(a[i:j]), Counter(b[k:m])
        place = {w: p for p, w in enumerate(b[k:m], k) if once_b[w] == 1}
        anchors = [(p, place[w]) for p, w in enumerate(a[i:j], i) if once_a[w] == 1 and w in place]
        # the longest subsequence that increases in b: piles with links back
        tops: list[int] = []
        at: list[int] = []
        back: list[int] = []
        for n, (_, q) in enumerate(anchors):
            pile = bisect_left(tops, q)
            back.append(at[pile - 1] if pile else -1)
            tops[pile:pile + 1] = [q]
            at[pile:pile + 1] = [n]
        if not at:
            continue
        chain, n = [], at[-1]
        while n >= 0:
            chain.append(anchors[n])
            n = back[n]
        chain.reverse()
        pairs += chain
        for (p, q), (p2, q2) in zip([(i - 1, k - 1), *chain], [*chain, (j, m)]):
            todo.append((p + 1, p2, q + 1, q2))
    return sorted(pairs)


class Templates:
    def __init__(self, texts: dict[str, str], min_coverage: float, short: int):
        self.names = sorted(texts)
        data, offs = B.flat(pa.array([texts[n] for n in self.names]))
        h, _, _, first = words_of(data, offs)
        self.vocabulary, ids = np.unique(h, return_inverse=True)
        self.words = [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
        self.need = [len(w) if len(w) < short else int(np.ceil(min_coverage * len(w))) for w in self.words]
        self.has = np.stack([np.bincount(w, minlength=len(self.vocabulary)) for w in self.words], axis=1)

    def places(self, t: int, ids: np.ndarray) -> list[tuple[float, int, int]]:
        """(coverage, first word, last word) wherever template ``t`` is met in a
        text's words (``ids``: places in the vocabulary, or -1)."""
        words, need = self.words[t], self.need[t]
        n = len(words)
        seen = Counter(ids[ids >= 0].tolist())
        rare = sorted(set(words), key=lambda w: (seen[w], w))[:n - need + 1]
        found, done = [], set()
        for w in rare:
            for p in np.flatnonzero(ids == w).tolist():
                # just the template's length first, which keeps neighbouring copies out
                for begin, slack in ((p - o, s) for o, x in enumerate(words) if x == w for s in (0, n // 4 + 2)):
                    low, high = max(0, begin - slack), min(len(ids), begin + n + slack)
                    if (low, high) in done:
                        continue
                    done.add((low, high))
                    pairs = patience(ids[low:high].tolist(), words)
                    if len(pairs) >= need and pairs[-1][0] - pairs[0][0] < 2 * n:
                        found.append((len(pairs) / n, low + pairs[0][0], low + pairs[-1][0]))
        return found


def scan(df: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text: str = "text",
         min_coverage: float = 0.8, short: int = 16) -> DataFrame:
    """(id, licenses) with licenses as structs (license, start, end, coverage), in code points."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates(templates, min_coverage, short)
        for batch in batches:
            data, offs = B.flat(batch.column(1))
            for i, j in B.pieces(offs):
                d, o = data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
                h, start, end, first = words_of(d, o)
                at = np.minimum(np.searchsorted(t.vocabulary, h), len(t.vocabulary) - 1)
                ids = np.where(t.vocabulary[at] == h, at, -1)
                known = np.flatnonzero(ids >= 0)
                holds = np.zeros((j - i, len(t.vocabulary)), np.int32)
                holds[np.searchsorted(first, known, side="right") - 1, ids[known]] = 1
                out: list[list] = [[] for _ in range(j - i)]
                for k, n in zip(*np.nonzero(holds @ t.has >= np.array(t.need))):
                    for coverage, a, b in t.places(n, ids[first[k]:first[k + 1]]):
                        out[k].append((-len(t.words[n]), -coverage, b - a, a, b, int(n)))
                rows = []
                for k, places in enumerate(out):
                    taken: list[tuple] = []
                    for p in sorted(places):
                        if all(p[4] < q[3] or p[3] > q[4] for q in taken):
                            taken.append(p)
                    row = []
                    if taken:
                        points = np.r_[0, np.cumsum((d[o[k]:o[k + 1]] & 0xC0) != 0x80)]
                        for _, coverage, _, a, b, n in sorted(taken, key=lambda p: p[3]):
                            s, e = start[first[k] + a] - o[k], end[first[k] + b] - o[k]
                            row.append({"license": t.names[n], "start": int(points[s]), "end": int(points[e]), "coverage": -coverage})
                    rows.append(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(rows, _PLACES)], [id_col, "licenses"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text).mapInArrow(run, f"{id_col} {kind}, licenses array<struct<license: string, start: long, end: long, coverage: double>>")


_PLACES = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return s.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"),
                    F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"),
                    F.coalesce(F.array_max(F.transform("licenses", lambda x: x["coverage"])), F.lit(0.0)).alias("best_coverage"))
