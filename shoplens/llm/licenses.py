"""License texts in documents.

Templates are cut into words (runs of letters, digits and non-ASCII bytes,
lower case). Their k-word shingles are hashed and winnowed: of every ``window``
neighbouring shingles the smallest is kept. The kept hashes form an inverted
index from hash to (template, place). All shingles of a document are looked up
in it, so every common passage of ``k + window - 1`` words meets at least one
entry. Hits are extended to exact stretches; stretches of one template that
follow each other in it and in the document are chained, and the words between
and beside them aligned: matched words, coverage of the template, and the span
they take in the document. A stretch that starts the template anew starts
another chain, so every occurrence is a match of its own.

The template set is a parameter and small (its index is sent with the task);
documents are scanned whole and where they are.

Defined cases: null or empty text has no matches; a template of fewer words
than a shingle is looked up as a whole; a template without words never
matches; repeated rows give repeated matches; an empty table gives an empty
result; extra columns are ignored. Of overlapping candidates of one license
the one with more matched words is reported, the earlier of equal ones; where
half of a match is in better ones of other licenses (by matched words less a
tenth of the missing and half of the foreign ones), only those are.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import LOWER, char_starts, doc_chunks, mix64, prefix_hash, range_hash, word_bounds

# Notices as their licenses word them.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "mit-line": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:"),
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:"),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "all-rights-reserved": "All rights reserved.",
}
_BSD = ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. ", "Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. ", "Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission.")
TEMPLATES |= {
    "mit-text": TEMPLATES["mit-grant"] + (
        " The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "bsd-line": "Released under the BSD License.",
    "isc-line": "Released under the ISC License.",
    "bsd-2-clause-conditions": f"{TEMPLATES['bsd-2-clause']} 1. {_BSD[0]}2. {_BSD[1]}",
    "bsd-3-clause-conditions": f"{TEMPLATES['bsd-2-clause']} 1. {_BSD[0]}2. {_BSD[1]}3. {_BSD[2]}",
    "mpl-2.0-line": "This work is licensed under the Mozilla Public License, version 2.0.",
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means."),
    "apache-2.0-title": "Apache License Version 2.0, January 2004",
    "gpl-2.0-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl-3.0-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl-2.1-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl-3.0-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl-3.0-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
}
# Words that the span of a match must hold: they tell a notice from its neighbours.
REQUIRED = {"apache-2.0-line": "apache 2", "mit-line": "mit", "bsd-line": "bsd", "isc-line": "isc",
            "mpl-2.0-line": "mozilla 2", "mpl-2.0-header": "mozilla 2", "apache-2.0-title": "apache 2",
            "all-rights-reserved": "all rights reserved"}
for _name, _kind, _versions in (("gpl", "General", ("2.0", "3.0")), ("lgpl", "Lesser General", ("2.1", "3.0")),
                                ("agpl", "Affero General", ("3.0",))):
    for _v in _versions:
        _short, _id = _v.removesuffix(".0"), f"{_name}-{_v}"
        TEMPLATES[f"{_id}-line"] = f"This work is licensed under the GNU {_kind} Public License, version {_short}."
        _to = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
               f"{_kind} Public License ")
        TEMPLATES[f"{_id}-header"] = (f"{_to}as published by the Free Software Foundation, either version {_short} of "
                                      "the License, or (at your option) any later version.")
        TEMPLATES[f"{_id}-only-header"] = f"{_to}version {_short} as published by the Free Software Foundation."
        for _form in ("line", "header", "only-header", "title"):
            REQUIRED[f"{_id}-{_form}"] = f"{_kind} {_short}"
for _kind, _words in (("by", ""), ("by-sa", "ShareAlike"), ("by-nd", "NoDerivatives"), ("by-nc", "NonCommercial"),
                      ("by-nc-sa", "NonCommercial-ShareAlike"), ("by-nc-nd", "NonCommercial-NoDerivatives")):
    for _v, _where in (("4.0", "International"), ("3.0", "Unported")):
        _id, _full = f"cc-{_kind}-{_v}", "-".join(filter(None, ("Attribution", _words)))
        _texts = {"short": f"Licensed under CC {_kind.upper()} {_v}.",
                  "line": f"This work is licensed under a Creative Commons {_full} {_v} {_where} License."}
        for _form, _text in _texts.items():
            _as = next((n for n, x in TEMPLATES.items() if x == _text), f"{_id}-{_form}")
            if _as in TEMPLATES and TEMPLATES[_as] != _text:     # cc-by-nc-4.0-line is the short form
                _as = f"{_id}-long"
            TEMPLATES[_as] = _text
            REQUIRED[_as] = f"{_kind if _form == 'short' else _full} {_v[0]}"
# Words from which a part of a notice is reported, whatever its coverage.
LEAST_WORDS = 24
MATCHES = "doc_id long, license string, matched_words long, coverage double, start long, end long"
# Every ASCII byte that is neither letter nor digit separates words.
_CLEAN = LOWER.copy()
_CLEAN[[b for b in range(128) if not chr(b).isalnum()]] = 32


def license_words(data: np.ndarray, off: np.ndarray):
    """(hash, start, end, document) of every word."""
    clean = _CLEAN[data]
    start, end, doc = word_bounds(clean, off)
    return range_hash(prefix_hash(clean), start, end), start, end, doc


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    acc = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + words[i:i + len(acc)]
    return mix64(acc + np.uint64(k))


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest (rightmost of equal) hash of every window; of a
    shorter sequence its smallest."""
    if len(h) <= window:
        return np.array([len(h) - 1 - int(h[::-1].argmin())]) if len(h) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, window)[:, ::-1]
    return np.unique(np.arange(len(view)) + window - 1 - view.argmin(1))


class TemplateIndex:
    """Inverted index from winnowed fingerprints to (template, place)."""

    def __init__(self, templates: Mapping[str, str], k: int = 3, window: int = 2,
                 required: Mapping[str, str] | None = None):
        self.k, self.names, self.words, self.required = k, [], [], []
        entries: list[tuple[int, int, int, int]] = []        # shingle length, hash, template, place
        for name in sorted(templates):
            raw = np.frombuffer(templates[name].encode(), np.uint8)
            w = license_words(raw, np.array([0, len(raw)]))[0]
            if not len(w):
                continue
            size = min(k, len(w))
            h = shingles(w, size)
            entries += [(size, int(h[p]), len(self.names), int(p)) for p in winnow(h, window)]
            self.names.append(name)
            self.words.append(w)
            raw = np.frombuffer((required or {}).get(name, "").encode(), np.uint8)
            self.required.append(license_words(raw, np.array([0, len(raw)]))[0])
        self.by_size = {}
        for size in sorted({e[0] for e in entries}):
            mine = sorted(e[1:] for e in entries if e[0] == size)
            self.by_size[size] = tuple(np.array(c, t) for c, t in zip(zip(*mine, strict=True),
                                                                      (np.uint64, np.int64, np.int64), strict=True))

    def hits(self, words: np.ndarray, doc: np.ndarray):
        """(document, template, document place, template place) of every fingerprint found."""
        out = []
        for size, (h, template, place) in self.by_size.items():
            if len(words) < size:
                continue
            s = shingles(words, size)
            inside = doc[:len(s)] == doc[size - 1:]
            a, b = np.searchsorted(h, s, "left"), np.searchsorted(h, s, "right")
            count = np.where(inside, b - a, 0)
            at = np.repeat(np.arange(len(s)), count)
            e = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)
            out += list(zip(doc[at].tolist(), template[e].tolist(), at.tolist(), place[e].tolist(), strict=True))
        return sorted(set(out))


def align(t: np.ndarray, d: np.ndarray, band: int, whole: bool = False) -> tuple[int, int]:
    """Banded alignment of ``t`` with ``d`` from the start of both: (matched
    words, place after the last one in d). Match +2, other steps -1; the best
    end counts, or with ``whole`` the end of both."""
    t, d = t.tolist(), d.tolist()
    band += abs(len(t) - len(d)) if whole else 0
    best, where = 0, (0, 0)
    row = {j: (-j, 0, 0) for j in range(min(band, len(d)) + 1)}        # score, matched, end, by place in d
    for i, word in enumerate(t, 1):
        new: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i - band), min(len(d), i + band) + 1):
            steps = []
            if j in row:
                steps.append((row[j][0] - 1, *row[j][1:]))
            if j - 1 in new:
                steps.append((new[j - 1][0] - 1, *new[j - 1][1:]))
            if j - 1 in row:
                s, m, e = row[j - 1]
                steps.append((s + 2, m + 1, j) if word == d[j - 1] else (s - 1, m, e))
            new[j] = max(steps, key=lambda c: c[0])
            if new[j][0] > best:
                best, where = new[j][0], new[j][1:]
        row = new
    return row[len(d)][1:] if whole else where


def stretches(t: np.ndarray, words: np.ndarray, lo: int, hi: int, found) -> list[tuple[int, int, int]]:
    """Maximal exact common stretches (first document place, first template
    place, words) around the (document place, template place) hits."""
    out, reached = [], {}
    for j, i in sorted(found):
        if reached.get(j - i, -1) > j:
            continue
        a = 0
        while i - a > 0 and j - a > lo and t[i - a - 1] == words[j - a - 1]:
            a += 1
        b = 0
        while i + b < len(t) and j + b < hi and t[i + b] == words[j + b]:
            b += 1
        reached[j - i] = j + b
        if b:
            out.append((j - a, i - a, a + b))
    return sorted(out)


def chains(found: list[tuple[int, int, int]], gap: int) -> list[list[tuple[int, int, int]]]:
    """Collinear chains of stretches, each stretch in one; between neighbours
    the document has at most ``gap`` words more than the template. Stretches
    that overlap are cut."""
    score, back = [], []
    near = 0
    reach = max((x[1] + x[2] for x in found), default=0) + gap
    for n, (j, i, size) in enumerate(found):
        top, link = float(size), -1
        while found[near][0] + reach < j:
            near += 1
        for p in range(near, n):
            pj, pi, ps = found[p]
            if pi >= i or pj >= j or j - pj - (i - pi) > gap:
                continue
            over = max(0, pi + ps - i, pj + ps - j)
            if over >= size or over >= ps:
                continue
            s = score[p] + size - over - abs(j - pj - (i - pi)) / (1 + gap) - 0.2 * max(0, j - pj - ps)
            if s > top:
                top, link = s, p
        score.append(top)
        back.append(link)
    out, used = [], [False] * len(found)
    for n in sorted(range(len(found)), key=lambda x: (-score[x], found[x])):
        chain = []
        while n >= 0 and not used[n]:
            used[n] = True
            chain.append(found[n])
            n = back[n]
        if chain:
            out.append(chain[::-1])
    return out


def _occurrences(t: np.ndarray, words: np.ndarray, lo: int, hi: int, found, band: int):
    """(matched words, first, end) of every chain of a template in a document's words lo to hi."""
    made = sorted(chains(stretches(t, words, lo, hi, found), max(band, min(64, len(t) // 2))))
    main = sorted(x[1:] for x in _apart([(sum(y[2] for y in c), c[0][0], c[-1][0] + c[-1][2]) for c in made]))
    starts, ends = [x[0] for x in main], [x[1] for x in main]
    for c in made:                               # words beside a chain belong to it up to the next main chain
        j, i, size = c[0]
        n = bisect_right(ends, j)
        left = max(lo, ends[n - 1] if n else lo, j - i - band)
        m, used = align(t[:i][::-1], words[left:j][::-1], band)
        start, total = j - used, m + size
        je, ie = j + size, i + size
        for j, i, size in c[1:]:
            over = max(0, ie - i, je - j)
            j, i, size = j + over, i + over, size - over
            if i > ie and j > je:
                total += align(t[ie:i], words[je:j], band, True)[0]
            total += size
            je, ie = j + size, i + size
        n = bisect_left(starts, je)
        right = min(hi, starts[n] if n < len(starts) else hi, je + len(t) - ie + band)
        m, used = align(t[ie:], words[je:right], band)
        yield total + m, start, je + used


def scan_words(index: TemplateIndex, words: np.ndarray, doc: np.ndarray, band: int, coverage: float,
               least_words: int = LEAST_WORDS):
    """(document, template, matched words, first word, end word) of every match
    of a chunk, word places counted through the chunk. A match has the share
    ``coverage`` of its template or ``least_words`` of its words."""
    groups: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for d, t, j, i in index.hits(words, doc):
        groups.setdefault((d, t), []).append((j, i))
    out = []
    for (d, t), found in sorted(groups.items()):
        template = index.words[t]
        lo, hi = np.searchsorted(doc, d, "left"), np.searchsorted(doc, d, "right")
        matches = [x for x in _occurrences(template, words, int(lo), int(hi), found, band)
                   if x[0] >= min(coverage * len(template), least_words) and np.isin(index.required[t], words[x[1]:x[2]]).all()]
        out += [(d, t, m, first, end) for m, first, end in _apart(matches)]
    covered, best = np.zeros(len(words), bool), []
    for x in sorted(out, key=lambda x: (
            (len(index.words[x[1]]) - x[2]) / 10 + (x[4] - x[3] - x[2]) / 2 - x[2], x[3], x[1])):
        if 2 * covered[x[3]:x[4]].sum() < x[4] - x[3]:
            covered[x[3]:x[4]] = True
            best.append(x)
    return sorted(best, key=lambda x: (x[0], x[3], x[1]))


def _apart(matches):
    """Of overlapping (rank, first, end) the one of higher rank, the earlier of equal ones."""
    starts: list[int] = []
    ends: list[int] = []
    for x in sorted(matches, key=lambda x: (-x[0], x[1])):
        n = bisect_left(ends, x[1] + 1)
        if n == len(starts) or starts[n] >= x[2]:
            starts.insert(n, x[1])
            ends.insert(n, x[2])
            yield x


def find_licenses(docs: DataFrame, templates: Mapping[str, str] | None = None, k: int = 3, window: int = 2,
                  band: int = 6, coverage: float = 0.8, least_words: int = LEAST_WORDS, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per license passage: its words matched, the share of the
    template they cover, and its code-point span (end exclusive). Passages with
    less than ``coverage`` count from ``least_words`` matched words."""
    required = REQUIRED if templates is None else {}
    templates = dict(TEMPLATES if templates is None else templates)

    def run(batches):
        import pyarrow as pa
        schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("matched_words", pa.int64()),
                            ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])
        index = TemplateIndex(templates, k, window, required)
        for b in batches:
            ids, rows = b.column(0), []
            for i, _, data, off in doc_chunks(None, b.column(1)):
                words, start, end, doc = license_words(data, off)
                found = scan_words(index, words, doc, band, coverage, least_words)
                if not found:
                    continue
                chars = char_starts(data)
                for d, t, m, first, last in found:
                    base = chars[off[d]]
                    rows.append({"doc_id": ids[i + d].as_py(), "license": index.names[t], "matched_words": m,
                                 "coverage": m / len(index.words[t]), "start": int(chars[start[first]] - base),
                                 "end": int(chars[end[last - 1]] - base)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, MATCHES)
