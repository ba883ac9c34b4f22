"""Licence scans: sparse TF-IDF cosine of headers and licence texts to templates, then inheritance from the nearest ancestor directory.

A template is a notice or a whole licence text. It is compared with every stretch of its own number of words in a text, wherever
lines end, and with every line by itself, so a notice may be wrapped, stand inside a longer line, or differ in a few words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sized, stored

#: Least cosine for a match, and least share of a file's words in matching lines for it to stand for its directory.
THRESHOLD, FILE_SHARE = 0.6, 0.5
_WORD = re.compile(r"[a-z0-9]+")
_LICENCE_FILE = re.compile(r"(?:^|/)(?:licen[cs]e|copying|unlicense|notice)(?:[.-][^/]*)?$", re.I)

# Notices by which works name their licences, by SPDX identifier.
NOTICES = {
    "0BSD": ("SPDX-License-Identifier: 0BSD",),
    "AGPL-3.0": ("This program is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", "SPDX-License-Identifier: Apache-2.0"),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC0-1.0": ("Released under CC0 1.0, dedicated to the public domain.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "SPDX-License-Identifier: GPL-2.0-only"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: GPL-3.0-only"),
    "ISC": ("Released under the ISC License.", "SPDX-License-Identifier: ISC"),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: LGPL-3.0-only"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
    "Zlib": ("Released under the zlib License.", "SPDX-License-Identifier: Zlib"),
}
# Whole licence texts without the lines that name their owners.
_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE '
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
TEXTS = {
    "BSD-2-Clause": f"{_BSD} {_AS_IS}",
    "BSD-3-Clause": f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_AS_IS}",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, '
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights '
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
        'permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
        "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as "
        "being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
}
#: All templates: notices, then the whole text if there is one.
TEMPLATES = {name: (*texts, *([TEXTS[name]] if name in TEXTS else [])) for name, texts in NOTICES.items()}


def terms(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def vocabulary() -> list[str]:
    return sorted({t for texts in TEMPLATES.values() for text in texts for t in terms(text)})


class Index:
    """Template vectors under given document frequencies; words outside of the templates weigh as words of no document."""

    def __init__(self, df: dict[str, int], n: int, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.unknown = math.log(1 + n) + 1
        self.idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in vocabulary()}
        self.by_term: dict[str, list[tuple[int, float]]] = {}
        self.names: list[str] = []
        self.sizes: list[int] = []
        self.vectors = vectors = []
        for name, texts in sorted(TEMPLATES.items()):
            for text in texts:
                vector = {t: c * self.idf[t] for t, c in Counter(terms(text)).items()}
                norm = math.sqrt(sum(w * w for w in vector.values()))
                vectors.append({t: w / norm for t, w in vector.items()})
                self.sizes.append(len(terms(text)))
                for t, w in vectors[-1].items():
                    self.by_term.setdefault(t, []).append((len(self.names), w))
                self.names.append(name)
        # the commonest terms can't lift any template to the threshold by themselves: a line without another term is no match
        weak: set[str] = set()
        for t in sorted(self.idf, key=lambda t: (self.idf[t], t)):
            if any(sum(v.get(x, 0) ** 2 for x in weak | {t}) >= threshold**2 for v in vectors):
                break
            weak.add(t)
        self.strong = frozenset(self.idf) - weak
        # the same for each template by itself: a stretch that matches holds one of its rarest terms
        self.rare = [self._rare(v) for v in vectors]

    def _rare(self, vector: dict[str, float]) -> frozenset[str]:
        """The terms of a template without which no stretch reaches the threshold."""
        common, weight = set(), 0.0
        for t in sorted(vector, key=lambda t: (vector[t], t)):
            weight += vector[t] ** 2
            if weight >= self.threshold**2:
                break
            common.add(t)
        return frozenset(vector) - common

    def line(self, words: list[str]) -> tuple[float, str] | None:
        """Best (cosine, licence) of a line, or None below the threshold; ties go to the first name."""
        if self.strong.isdisjoint(words):
            return None
        norm, dots = 0.0, {}
        for t, c in Counter(words).items():
            w = c * self.idf.get(t, self.unknown)
            norm += w * w
            for k, x in self.by_term.get(t, ()):
                dots[k] = dots.get(k, 0.0) + w * x
        best = max(((round(d / math.sqrt(norm), 6), -k) for k, d in dots.items()), default=(0.0, 0))
        return (best[0], self.names[-best[1]]) if best[0] >= self.threshold else None

    def stretches(self, words: list[str]) -> Iterator[tuple[float, str, int, int]]:
        """(cosine, licence, start, end) of the best stretch of each template's own length that reaches the threshold, or of all
        words if they are fewer. Only stretches that hold a rare term of the template are looked at: no other can reach it."""
        weight = [self.idf.get(t, self.unknown) for t in words]
        where: dict[str, list[int]] = {}
        for i, t in enumerate(words):
            if t in self.idf:
                where.setdefault(t, []).append(i)
        for k, (vector, rare, size) in enumerate(zip(self.vectors, self.rare, self.sizes, strict=True)):
            hits = sorted(i for t in rare for i in where.get(t, ()))
            size = min(size, len(words))
            best, done, at = None, -1, 0
            while at < len(hits):
                first = max(0, hits[at] - size + 1, done + 1)
                while at + 1 < len(hits) and hits[at + 1] - size + 1 <= hits[at] + 1:
                    at += 1
                last = min(len(words) - size, hits[at])
                at += 1
                if first > last:
                    continue
                done = last
                counts = Counter(words[first : first + size])
                norm = sum((c * self.idf.get(t, self.unknown)) ** 2 for t, c in counts.items())
                dot = sum(c * self.idf[t] * vector[t] for t, c in counts.items() if t in vector)
                for start in range(first, last + 1):
                    cosine = round(dot / math.sqrt(norm), 6)
                    if cosine >= self.threshold and (best is None or cosine > best[0]):
                        best = (cosine, self.names[k], start, start + size)
                    if start < last:
                        gone, new = start, start + size
                        for i, sign in ((gone, -1), (new, 1)):
                            c, w = counts[words[i]], weight[i]
                            norm += ((c + sign) ** 2 - c * c) * w * w
                            counts[words[i]] = c + sign
                            dot += sign * w * vector.get(words[i], 0.0)
            if best:
                yield best

    def file(self, text: str) -> tuple[str | None, float | None, bool]:
        """(licence, cosine, whether matching lines and stretches hold FILE_SHARE of the words) of a whole text."""
        if self.strong.isdisjoint(words := terms(text)):
            return None, None, False
        best, inside, at = None, bytearray(len(words)), 0
        better = lambda found: best is None or (-found[0], found[1]) < (-best[0], best[1])
        for line in text.split("\n"):
            own = terms(line)
            if found := self.line(own):
                inside[at : at + len(own)] = b"\x01" * len(own)
                best = found if better(found) else best
            at += len(own)
        for cosine, name, start, end in self.stretches(words):
            inside[start:end] = b"\x01" * (end - start)
            best = (cosine, name) if better((cosine, name)) else best
        return (best[1], best[0], sum(inside) >= FILE_SHARE * len(words)) if best else (None, None, False)


def document_frequencies(files: DataFrame) -> tuple[dict[str, int], int]:
    """In how many of all files each template term occurs (a bounded list), and the number of files.

    Null texts have no terms; repeated rows count each; without files all counts are missing and the number is 0.
    """
    known = frozenset(vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column("text").to_pylist():
                seen.update(known.intersection(terms(text or "")))
        yield pa.RecordBatch.from_arrays([pa.array([*seen, ""]), pa.array([*seen.values(), rows], pa.int64())], names=["term", "df"])

    got = {r["term"]: r["df"] for r in files.select("text").mapInArrow(run, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    return got, got.pop("", 0)


def scan(files: DataFrame) -> DataFrame:
    """(path, id, licence, score, licence_file) for files (path, id, text): the licence that a file's own text names.

    A null or empty text has none; a null path is that of no licence file. Repeated rows get equal results, a very long text is
    scanned whole, no rows give no rows; other columns are not read.
    """
    df, n = document_frequencies(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(df, n)
        for batch in batches:
            rows = [index.file(t or "") for t in batch.column("text").to_pylist()]
            paths = batch.column("path").to_pylist()
            whole = [r[0] is not None and (r[2] or bool(_LICENCE_FILE.search(p or ""))) for r, p in zip(rows, paths, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("id"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array(whole, pa.bool_())], names=["path", "id", "licence", "score", "licence_file"])

    return files.select("path", "id", "text").mapInArrow(run, "path string, id bigint, licence string, score double, licence_file boolean")


def licences(files: DataFrame, path_col: str = "path", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `files`: id, path, licence, score, via ('own', 'inherited' or null), from_path.

    Every line of every whole text, and every stretch of a template's own length, is compared with every template that shares a
    term with it; the best match at THRESHOLD or more is the file's own licence (of equal ones the first by name). A file is a
    licence file if matches hold half of its words or its name says so. A
    file without a licence of its own takes that of the best licence file (highest score, then first path) in its directory,
    or else in the nearest directory above. Directories are resolved first, so files join once, on their own directory.

    A null or empty text has no licence of its own; a null path is in the root directory. Repeated rows get equal results. No
    rows give no rows. Other columns are not read.
    """
    path = F.coalesce(F.col(path_col), F.lit(""))
    found = stored(scan(files.select(path.alias("path"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))), "scanned")
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    found = found.withColumn("dir", parent)
    given = stored(found.where("licence_file").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "licence")).alias("g")).select(F.col("dir").alias("up"), F.col("g.licence").alias("up_licence"), F.col("g.path").alias("up_path"), (-F.col("g.s")).alias("up_score")), "given")
    parts = F.split("dir", "/")
    ups = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    dirs = found.select("dir").distinct().select("dir", F.explode(F.array_distinct(ups)).alias("up"))
    nearest = dirs.join(sized(given), "up").groupBy("dir").agg(F.max(F.struct(F.length("up").alias("depth"), "up_licence", "up_path", "up_score")).alias("n")).select("dir", "n.*")
    out = found.join(sized(stored(nearest, "nearest")), "dir", "left")
    own = F.col("licence").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        "path",
        F.coalesce("licence", "up_licence").alias("licence"),
        F.when(own, F.col("score")).otherwise(F.col("up_score")).alias("score"),
        F.when(own, F.lit("own")).when(F.col("up_licence").isNotNull(), F.lit("inherited")).alias("via"),
        F.when(own, F.col("path")).otherwise(F.col("up_path")).alias("from_path"),
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    return licences(docs.select("doc_id", "text", path.alias("path")))
