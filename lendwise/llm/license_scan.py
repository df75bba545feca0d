"""License texts and notices in documents.

Templates are winnowed into fingerprints (hashes of word triples, the smallest of every few neighbours), which form an
inverted index from fingerprint to template and position. A document's fingerprints look up candidate templates and
the diagonals on which they lie; each candidate region is aligned with its template in a band around the diagonal, and
the share of matched template words and the matched span are reported.

Notices of fewer than ``SHORT_WORDS`` words differ in a name, variant or version only. They are looked up by every pair
of words that holds such a word. A match of these, and of notices of up to ``NOTICE_WORDS`` words, as files begin with,
must show their distinguishing phrases (``PHRASES``) word for word: one wrong word in a hundred names another license. Of
matches that overlap, the one that explains most stays: matched template words less the missing ones.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendwise.llm.common import small_batches

GRAM = 3
WINNOW = 3
BAND = 8
MIN_COVERAGE = 0.8
SHORT_WORDS = 20
NOTICE_WORDS = 150
MIN_HITS = 0.1
MAX_TEMPLATE_BYTES = 16 << 20
WORDS = re.compile(r"[a-z0-9]+")
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed"}

#: Public license texts and notices: fixed values.
TEMPLATES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS "
        "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MIT-notice": "Released under the MIT License.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE "
        "SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
        "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution."
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/"
        "LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License "
        "is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}

#: The notice that files under a license of the GNU family begin with, and who uses it how: fixed values.
GNU_NOTICE = (
    "This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License "
    "as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later "
    "version. This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
    "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details."
)
GNU_FAMILY = {
    "GPL-2.0": ("program", "General", "2"),
    "GPL-3.0": ("program", "General", "3"),
    "LGPL-2.0": ("library", "Library General", "2"),
    "LGPL-2.1": ("library", "Lesser General", "2.1"),
    "LGPL-3.0": ("program", "Lesser General", "3"),
    "AGPL-3.0": ("program", "Affero General", "3"),
}
TEMPLATES |= {name: GNU_NOTICE.format(work=work, kind=kind, version=version) for name, (work, kind, version) in GNU_FAMILY.items()}

#: What a short notice says of its license, as opposed to how it says so: fixed values. A template takes all that it holds.
PHRASES = tuple(
    "mit license;mit licensed;isc license;bsd license;2 clause;3 clause;simplified bsd;new bsd;apache license;apache 2 0;version 1;"
    "version 2;version 2 0;version 2 1;version 3;version 3 0;gnu general public license;gnu lesser general public license;"
    "gnu library general public license;gnu affero general public license;gplv2;gplv3;lgplv2;lgplv3;agplv3;mozilla public license;"
    "v 2 0;mpl 2 0;creative commons attribution;creative commons zero;cc0;cc0 1 0;public domain;attribution 4 0;"
    "attribution 3 0;sharealike 4 0;sharealike 3 0;attribution sharealike;attribution noncommercial;noncommercial 4 0;"
    "noncommercial 3 0;noncommercial sharealike;noncommercial noderivatives;noderivatives 4 0;noderivatives 3 0;"
    "attribution noderivatives;cc by;cc by 4 0;cc by 3 0;cc by sa 4 0;cc by sa 3 0;cc by nc 4 0;cc by nc 3 0;cc by nd 4 0;"
    "cc by nd 3 0;cc by nc sa 4 0;cc by nc sa 3 0;cc by nc nd 4 0;cc by nc nd 3 0;sil open font license;version 1 1;unlicense".split(";")
)


#: Usual one-line notices by license: fixed values.
NOTICES = {
    "MIT": ("Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "Distributed under the MIT License.",
            "This software is MIT licensed."),
    "ISC": ("Licensed under the ISC License.", "Released under the ISC License."),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", "Released under the Simplified BSD License."),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Released under the New BSD License."),
    "Apache-2.0": ("Licensed under the Apache 2.0 License.", "Released under the Apache License 2.0.",
                   "This work is licensed under the Apache License, Version 2.0."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "Licensed under the GPLv2.",
                "Released under the GNU General Public License v2.0."),
    "GPL-3.0": ("Licensed under the GPLv3.", "Released under the GNU General Public License v3.0."),
    "LGPL-2.1": ("This work is licensed under the GNU Lesser General Public License, version 2.1.",),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "Licensed under the LGPLv3."),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPLv3."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "Licensed under the Mozilla Public License 2.0.", "Licensed under the MPL 2.0."),
    "OFL-1.1": ("This Font Software is licensed under the SIL Open Font License, Version 1.1.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense."),
    "CC0-1.0": ("Licensed under CC0 1.0.", "This work is dedicated to the public domain under Creative Commons Zero.", "Released under CC0."),
}
CREATIVE_COMMONS = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}


def catalogue() -> dict[str, str]:
    """All templates: ``TEMPLATES``, the full texts of the folder ``licenses`` (their terms, without preamble and
    appendix; read by the driver only) and the usual notices (``-notice-2`` and so on)."""
    found = dict(TEMPLATES)
    for path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        found[path.stem] = path.read_text(encoding="utf-8")
    notices = [(name, text) for name, texts in NOTICES.items() for text in texts]
    for kind, title in CREATIVE_COMMONS.items():
        for version, port in (("4.0", "International"), ("3.0", "Unported")):
            name = f"CC-{kind}-{version}"
            notices += [(name, f"Licensed under CC {kind} {version}."), (name, f"Licensed under a Creative Commons {title} {version} {port} License."),
                        (name, f"This work is licensed under a Creative Commons {title} {version} {port} License.")]
    for name, text in notices:
        at = 1
        while (key := f"{name}-notice" + (f"-{at}" if at > 1 else "")) in found:
            at += 1
        if text not in found.values():
            found[key] = text
    return found


def _words(lower: str) -> list[str]:
    return [SPELLINGS.get(w, w) for w in WORDS.findall(lower)]


def _places(ids: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where ``phrase`` stands in ``ids``."""
    if len(phrase) > len(ids):
        return np.zeros(0, np.int64)
    return np.nonzero((np.lib.stride_tricks.sliding_window_view(ids, len(phrase)) == phrase).all(axis=1))[0]


def _pairs(ids: np.ndarray) -> np.ndarray:
    """A value for every two neighbouring words; -1 where one is no template word."""
    return np.where((ids[:-1] > 0) & (ids[1:] > 0), (ids[:-1] << 32) | ids[1:], -1)


def _grams(ids: np.ndarray) -> np.ndarray:
    """Hash of every word triple; the largest value where a word is no template word (no template holds it)."""
    n = len(ids) - GRAM + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    value, known = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    for k in range(GRAM):
        part = ids[k : k + n]
        known &= part > 0
        value = (value ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(31)
    return np.where(known, value >> np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))


def winnow(hashes: np.ndarray, window: int = WINNOW) -> np.ndarray:
    """Positions of each window's smallest hash (the last one of equals); all of a text shorter than a window."""
    if len(hashes) <= window:
        return np.nonzero(hashes == hashes.min())[0][-1:] if len(hashes) else np.zeros(0, dtype=np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(axis=1))


@dataclass
class Index:
    """Inverted index of the templates' fingerprints."""

    names: list[str]
    tokens: list[np.ndarray]
    words: dict[str, int]
    hashes: np.ndarray
    postings: dict[int, list[tuple[int, int]]]
    pairs: np.ndarray
    pair_postings: dict[int, list[tuple[int, int]]]
    phrases: dict[int, list[np.ndarray]]
    needed: list[int]

    @classmethod
    def build(cls, templates: dict[str, str]) -> Index:
        if sum(len(t) for t in templates.values()) > MAX_TEMPLATE_BYTES:
            raise ValueError(f"templates are sent to every executor: at most {MAX_TEMPLATE_BYTES} characters in all")
        words: dict[str, int] = {}
        names, tokens, postings, pair_postings, phrases, needed = sorted(templates), [], defaultdict(list), defaultdict(list), {}, []
        for t, name in enumerate(names):
            own = np.array([words.setdefault(w, len(words) + 1) for w in _words(templates[name].lower())], np.int64)
            tokens.append(own)
            marked = np.zeros(len(own), bool)
            if GRAM <= len(own) < NOTICE_WORDS:
                told = [np.array([words.get(w, 0) for w in phrase.split()], np.int64) for phrase in PHRASES]
                told = [ids for ids in told if len(_places(own, ids))]
                for ids in told:
                    for k in _places(own, ids):
                        marked[k : k + len(ids)] = True
                if told or len(own) < SHORT_WORDS:
                    phrases[t] = told
            if GRAM <= len(own) < SHORT_WORDS:
                if not marked.any():  # a template of a caller's, without a known phrase
                    marked[:] = True
                for at, pair in enumerate(_pairs(own).tolist()):
                    if marked[at] or marked[at + 1]:
                        pair_postings[pair].append((t, at))
                needed.append(1)
                continue
            grams = _grams(own)
            chosen = winnow(grams).tolist()
            needed.append(max(1, int(MIN_HITS * len(chosen))))
            for at in chosen:
                postings[int(grams[at])].append((t, at))
        return cls(names, tokens, words, np.array(sorted(postings), dtype=np.uint64), dict(postings),
                   np.array(sorted(pair_postings), dtype=np.int64), dict(pair_postings), phrases, needed)

    def regions(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """Candidates (template, lowest and highest diagonal) with hits close together: of a long template, at least
        ``MIN_HITS`` of its fingerprints."""
        diagonals = defaultdict(set)
        for values, places, postings in self._looked_up(ids):
            for value, at in zip(values, places):
                for t, pos in postings[value]:
                    diagonals[t].add((at - pos, pos))
        out = []
        for t, found in diagonals.items():
            reach, need = max(BAND, len(self.tokens[t]) // 100), self.needed[t]
            found = sorted(found)
            start = 0
            for k in range(1, len(found) + 1):
                if k == len(found) or found[k][0] - found[start][0] > reach:
                    if len({pos for _, pos in found[start:k]}) >= need:
                        out.append((t, found[start][0], found[k - 1][0]))
                    start = k
        return out

    def _looked_up(self, ids: np.ndarray) -> Iterator[tuple[list[int], list[int], dict]]:
        grams = _grams(ids)
        for values, places, known, postings in (
            (grams, winnow(grams), self.hashes, self.postings),
            (_pairs(ids), np.arange(max(len(ids) - 1, 0)), self.pairs, self.pair_postings),
        ):
            if len(places) and len(known):
                found = values[places]
                hit = known[np.minimum(np.searchsorted(known, found), len(known) - 1)] == found
                yield found[hit].tolist(), places[hit].tolist(), postings

    def core(self, t: int, ids: np.ndarray, first: int, last: int) -> tuple[int, int] | None:
        """From the first to the last word of a match that tell its license: a short template's phrases; all of a long
        one. None if a phrase of the template is not there."""
        if t not in self.phrases:
            return first, last
        found = [(_places(ids[first : last + 1], p), len(p)) for p in self.phrases[t]]
        if not all(len(at) for at, _ in found):
            return None
        if len(self.tokens[t]) >= SHORT_WORDS:
            return first, last
        return (first + min(int(at[0]) for at, _ in found), first + max(int(at[0]) + n - 1 for at, n in found)) if found else (first, last)


def align(template: np.ndarray, ids: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Most template words matched in order within a band around the diagonals: (matched, first word, last word).

    Rows are template words; the band holds the document words that lie up to ``BAND`` off the diagonals."""
    width = high - low + 2 * BAND + 1
    base = low - BAND
    score = np.zeros(width + 1, dtype=np.int64)
    first = np.full(width + 1, -1, dtype=np.int64)  # where the alignment begins
    last = np.full(width + 1, -1, dtype=np.int64)
    for i, word in enumerate(template.tolist()):
        at = base + i + np.arange(width)
        inside = (at >= 0) & (at < len(ids))
        same = inside & (ids[np.clip(at, 0, max(len(ids) - 1, 0))] == word)
        # by column, the cell above on the same diagonal is score[c] and the template word left out is score[c + 1]
        up_score, up_first, up_last = score[1:], first[1:], last[1:]
        take = score[:-1] + same
        better = take >= up_score
        new_score = np.where(better, take, up_score)
        new_first = np.where(better, np.where(same & (first[:-1] < 0), at, first[:-1]), up_first)
        new_last = np.where(better, np.where(same, at, last[:-1]), up_last)
        # document words left out: the best cell so far to the left (ties to the nearest, which gives the shorter span)
        rank = new_score * width + np.arange(width)
        reach = np.maximum.accumulate(rank) % width
        score[:-1], first[:-1], last[:-1] = new_score[reach], new_first[reach], new_last[reach]
        score[-1], first[-1], last[-1] = 0, -1, -1
    best = int(score[:-1].argmax())
    return int(score[best]), int(first[best]), int(last[best])


def scan_text(index: Index, text: str | None, min_coverage: float = MIN_COVERAGE) -> list[tuple[str, float, int, int]]:
    """Matches (license, coverage, start, end in code points), by place; of matches whose telling words overlap the one
    that explains most stays, so a text that holds another one's words is reported alone."""
    if not text:
        return []
    lower = text.lower()
    if len(lower) != len(text):  # a few characters grow in lower case: offsets stay those of the text itself
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    ids = np.fromiter((index.words.get(w, 0) for w in _words(lower)), dtype=np.int64)
    found = []
    for t, low, high in index.regions(ids):
        template = index.tokens[t]
        matched, first, last = align(template, ids, low, high)
        if matched >= min_coverage * len(template) and (core := index.core(t, ids, first, last)):
            found.append((matched / len(template), t, first, last, core))
    kept: list[tuple[float, int, int, int, tuple[int, int]]] = []
    for match in sorted(set(found), key=lambda m: ((1 - 2 * m[0]) * len(index.tokens[m[1]]), m[3] - m[2], m[1], m[2])):
        if not any(k[4][0] <= match[4][1] and match[4][0] <= k[4][1] for k in kept):
            kept.append(match)
    if not kept:
        return []
    places = [m.span() for m in WORDS.finditer(lower)]
    spans = [(index.names[t], c, places[a][0], places[b][1]) for c, t, a, b, _ in kept if b < len(places)]
    return sorted(spans, key=lambda m: (m[2], m[3], m[0]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per match in ``docs(doc_id, text)``: ``doc_id, license, coverage, start, end``.

    ``coverage`` is the share of the template's words matched in order; ``start`` and ``end`` are code points of the
    text. Null and empty texts have no match; repeated rows are scanned alike; null ids are kept; other columns are not
    read; an empty table gives an empty result. Templates of fewer than three words are never found.
    """
    spark = docs.sparkSession
    small_batches(spark)
    index = spark.sparkContext.broadcast(Index.build(catalogue() if templates is None else templates))
    match = "struct<license:string, coverage:double, start:int, end:int>"

    @F.pandas_udf(f"array<{match}>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([
                [{"license": n, "coverage": c, "start": s, "end": e} for n, c, s, e in scan_text(index.value, t, min_coverage)]
                for t in batch
            ], dtype=object)

    found = docs.select("doc_id", F.explode(scan("text")).alias("m"))
    return found.select("doc_id", "m.license", "m.coverage", "m.start", "m.end")
