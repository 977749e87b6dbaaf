"""Licence scan: sparse TF-IDF cosine of files' lines and paragraphs to templates, inherited by directory.

Terms are lower-cased words; a term's weight is tf * (1 + ln((1 + N) / (1 + df))) with N and df counted over all
files; a word that is in no template weighs like one that no file has, so that a segment with other words in it is
less alike. Segments of a file are its lines, its paragraphs, and the whole of it. The best segment's template is
the file's own licence if the cosine reaches ``threshold``. A licence file (by its name) passes its licence on to
all files in its directory and below, unless a directory further down has one: the nearest ancestor wins.

Nulls: a null text or one without words has no own licence; a null path is in no directory and inherits nothing.
Ties go to the template first by name; of several licence files in a directory, to that with the higher score, then
the path first by order. Repeated rows each give a row. Extra columns are not read. An empty table gives no rows. Very
long texts are matched whole, one in memory at a time, their segments in bounded portions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._bytes import ALNUM, LOWER, buffer, hashes, mixed, pieces, words
from quern.llm.license_texts import PASSAGES
from quern.sources.staging import staged

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_COPIES = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."

#: Public identifiers, and texts by which well-known licences are stated: notices in file headers, whole
#: texts of the short licences, and of the long ones title, opening and passages. What GPL-3.0 and AGPL-3.0 share is neither's.
TEMPLATES = {
    "AGPL-3.0": [_FREE.format("Affero General Public License", "3"), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "Licensed under the GNU Affero General Public License, version 3."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "BSD-2-Clause": [" ".join([_BSD, "1.", _BSD_SOURCE, "2.", _BSD_BINARY, _BSD_AS_IS]), " ".join([_BSD, _BSD_SOURCE, _BSD_BINARY]), "BSD 2-Clause License"],
    "BSD-3-Clause": [" ".join([_BSD, "1.", _BSD_SOURCE, "2.", _BSD_BINARY, "3.", _BSD_NAME, _BSD_AS_IS]), " ".join([_BSD, _BSD_SOURCE, _BSD_BINARY, _BSD_NAME]), "BSD 3-Clause License", "Released under the BSD License."],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Creative Commons Attribution-ShareAlike 4.0 International Public License"],
    "CC0-1.0": ["Creative Commons Legal Code CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": [_FREE.replace("software:", "software;").format("General Public License", "2"), f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 {_COPIES}", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", _FREE.format("General Public License", "3"), f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 {_COPIES}", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "ISC": [f"{_ISC} THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.", _ISC, "ISC License"],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "LGPL-3.0": [_FREE.format("Lesser General Public License", "3"), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "The MIT License (MIT)", "MIT License", _GRANT, f"{_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
}
# Passages that stand all over the long licences, so that a file is told without its title, or a part of it, or in one
# column of lines; and the one line that names a licence by its identifier.
TEMPLATES = {name: [*texts, *PASSAGES.get(name, []), f"SPDX-License-Identifier: {name}"] for name, texts in TEMPLATES.items()}
THRESHOLD = 0.8
#: Products of a segment's and a template's weight that are held at once.
_PRODUCTS = 1 << 20
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"


class Templates:
    """Terms of the templates as sorted hashes, and after ``weigh`` the templates' unit vectors over them."""

    def __init__(self, templates: dict[str, list[str]]):
        texts = [(name, t) for name in sorted(templates) for t in templates[name]]
        self.names = [n for n, _ in texts]
        data, offsets = buffer(pa.array([t for _, t in texts], pa.large_string()))
        data = LOWER[data]
        starts, ends, owner = words(data, offsets, ALNUM)
        h = hashes(data, starts, ends)
        self.terms = np.unique(h)
        self.tf = np.zeros((len(texts), self.terms.size))
        np.add.at(self.tf, (owner, np.searchsorted(self.terms, h)), 1)

    def weigh(self, files: int, df: np.ndarray) -> None:
        self.idf = 1 + np.log((1 + files) / (1 + df))
        self.rarest = 1 + np.log(1 + files)
        w = self.tf * self.idf
        unit = w / np.linalg.norm(w, axis=1, keepdims=True)
        #: Of each term, the templates that have it and their weights: end to end, and where a term begins.
        term, self.of = np.nonzero(unit.T)
        self.weight = unit.T[term, self.of]
        self.first = np.searchsorted(term, np.arange(self.terms.size + 1))

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Number of each term, or -1."""
        at = np.searchsorted(self.terms, h).clip(max=self.terms.size - 1)
        return np.where(self.terms[at] == h, at, -1)

    def best(self, segment: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Best template and cosine of each of ``n`` segments; segment (ascending) and h: parallel, one for each word.

        Only terms that a segment has are multiplied, with the templates that have them, a bounded number at a time.
        """
        term = self.numbers(h)
        known = term >= 0
        score, which = np.zeros(n), np.zeros(n, np.int64)
        if not known.any():
            return which, score
        pair, tf = np.unique(segment[known] * self.terms.size + term[known], return_counts=True)
        of, t = pair // self.terms.size, pair % self.terms.size
        w = tf * self.idf[t]
        norm = np.bincount(of, w * w, n)
        live = np.zeros(n, bool)
        live[of] = True
        other = np.flatnonzero(~known & live[segment])
        if other.size:
            owner = segment[other]
            _, first, count = np.unique(mixed(h[other] + np.uint64(0x9E3779B97F4A7C15) * (owner + 1).astype(np.uint64)), return_index=True, return_counts=True)
            norm += np.bincount(owner[first], (count * self.rarest) ** 2.0, n)
        each = self.first[t + 1] - self.first[t]
        total, lo = np.cumsum(each), 0
        while lo < of.size:
            # As many whole segments as fit, or one.
            hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _PRODUCTS, side="right"))
            hi = max(int(np.searchsorted(of, of[min(hi, of.size - 1)])) if hi < of.size else of.size, int(np.searchsorted(of, of[lo], side="right")))
            row, begin = np.unique(of[lo:hi], return_index=True)
            dense = np.repeat(np.arange(row.size), np.diff(np.append(begin, hi - lo)))
            k = each[lo:hi]
            place = np.arange(int(k.sum())) + np.repeat(self.first[t[lo:hi]] - (np.cumsum(k) - k), k)
            dot = np.bincount(np.repeat(dense, k) * len(self.names) + self.of[place], np.repeat(w[lo:hi], k) * self.weight[place], row.size * len(self.names)).reshape(row.size, -1)
            cosine = np.round(dot / np.sqrt(norm[row])[:, None], 12)
            which[row] = cosine.argmax(axis=1)
            score[row] = cosine[np.arange(row.size), which[row]]
            lo = hi
        return which, score


def _segments(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the line and of the paragraph of each word, unique over all texts."""
    newline = data == 10
    line = np.cumsum(newline)
    blank = np.zeros(data.size, bool)
    places = np.flatnonzero(newline)
    blank[places[1:][np.diff(places) == 1]] = True
    paragraph = np.cumsum(blank)
    a = line[starts] + owner
    b = paragraph[starts] + owner
    return a - a.min(initial=0), b - b.min(initial=0)


def _matched(texts: pa.Array, templates: Templates) -> tuple[list[str | None], np.ndarray]:
    data, offsets = buffer(texts)
    data, n = LOWER[data], len(texts)
    starts, ends, owner = words(data, offsets, ALNUM)
    if not starts.size:
        return [None] * n, np.zeros(n)
    h = hashes(data, starts, ends)
    files, found, scores = [], [], []
    for segment in (*_segments(data, offsets, starts, owner), owner):
        number, dense = np.unique(segment, return_inverse=True)
        of = np.zeros(number.size, np.int64)
        of[dense] = owner
        which, score = templates.best(dense, h, number.size)
        some = score > 0
        files, found, scores = [*files, of[some]], [*found, which[some]], [*scores, score[some]]
    file, which, score = np.concatenate(files), np.concatenate(found), np.concatenate(scores)
    order = np.lexsort((which, -score, file))
    first = order[np.unique(file[order], return_index=True)[1]]
    names, best = [templates.names[0]] * n, np.zeros(n)
    best[file[first]] = score[first]
    for k, w in zip(file[first].tolist(), which[first].tolist(), strict=True):
        names[k] = templates.names[w]
    return names, best


def document_frequencies(files: DataFrame, templates: Templates) -> tuple[int, np.ndarray]:
    """Number of files, and in how many of them each template term occurs: sums of the tasks' counts."""
    shared = files.sparkSession.sparkContext.broadcast(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = shared.value, 0
        total = np.zeros(known.terms.size, np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                data, offsets = buffer(part.column("text"))
                data = LOWER[data]
                starts, ends, owner = words(data, offsets, ALNUM)
                term = known.numbers(hashes(data, starts, ends))
                some = term >= 0
                each = np.unique(owner[some] * known.terms.size + term[some])
                total += np.bincount(each % known.terms.size, minlength=total.size)
                n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(total.size), -1)), pa.array(np.append(total, n))], ["term", "n"])

    rows = files.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r.term: r.n for r in rows}
    return found.get(-1, 0), np.array([found.get(k, 0) for k in range(templates.terms.size)])


def own_licenses(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """``doc_id``, ``path``, ``template``, ``score`` of every file: the best template of any segment, however alike."""
    known = Templates(templates)
    known.weigh(*document_frequencies(files, known))
    shared = files.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                name, score = _matched(part.column("text"), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("path"), pa.array([x if s > 0 else None for x, s in zip(name, score, strict=True)], pa.string()), pa.array(np.round(score, 9))], ["doc_id", "path", "template", "score"])

    rows = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, path string, template string, score double")


def directory(path: Column) -> Column:
    """The directory of a path, without its last part; '' at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``path``, ``own_license``, ``own_score``, ``inherited_license``, ``inherited_from``, ``license``.

    files: doc_id, path, text. Matches are staged without texts. Directories, not files, are matched with their
    ancestors: each distinct one is repeated for its levels and joined to the directories that have a licence file.
    The last join gives files their directory's answer; both its sides are staged, so AQE can split a directory
    that holds very many files.
    """
    matched = staged(own_licenses(files, templates).withColumn("dir", directory(F.col("path"))), "matched")
    ok = F.col("score") >= threshold
    better = Window.partitionBy("dir").orderBy(F.col("score").desc(), "path", "template")
    granting = matched.where(ok & F.rlike("path", F.lit(LICENSE_FILE))).withColumn("n", F.row_number().over(better)).where("n = 1").select(F.col("dir").alias("ancestor"), F.col("template").alias("inherited_license"), F.col("path").alias("inherited_from"))
    dirs = matched.where("dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    levels = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts)))).alias("depth"))
    levels = levels.withColumn("ancestor", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    nearest = levels.join(granting, "ancestor").groupBy("dir").agg(F.max_by(F.struct("inherited_license", "inherited_from"), "depth").alias("x"))
    answers = staged(nearest.select("dir", "x.inherited_license", "x.inherited_from"), "answers")
    own = F.when(ok, F.col("template"))
    return matched.join(answers, "dir", "left").select("doc_id", "path", own.alias("own_license"), F.col("score").alias("own_score"), "inherited_license", "inherited_from", F.coalesce(own, "inherited_license").alias("license"))
