"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

Templates are notices as they stand in headers and whole licence texts. Every place in a file where a licence word
stands is compared with each template, laid so that their licence words meet; the sparse TF-IDF cosine of the words
under the template decides, and of several matches the one that explains most words (words of the template times
cosine) wins. A file is a licence file where it is named like one and has a match, or where the TF-IDF cosine of all its
words to a whole licence text reaches least; other matches are headers, which no other file inherits. Files without a
match take the licence of the nearest ancestor directory that has a licence file: distinct directories are joined with
their ancestors by path, and files with their directory on salted keys, as a directory may hold a third of all files.

Nulls: a null or empty text has no header and may inherit; a null path has no directory. Ties go by the licence's name.
Repeated rows are reported each. Very long texts are read whole; their cost is that of their licence words. Columns
other than those named aren't read. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Notices by which files name their licence.
NOTICES = {
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "SPDX-License-Identifier: Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    ],
    "GPL-2.0": [
        "Licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    ],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0"],
    "BSD-3-Clause": ["Released under the BSD License", "Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "ISC": ["Licensed under the ISC License", "SPDX-License-Identifier: ISC"],
    "MPL-2.0": [
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "Licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC0-1.0": ["Licensed under CC0 1.0", "SPDX-License-Identifier: CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "Proprietary": ["All rights reserved"],
}
#: Whole texts of licences that are short enough to stand in files of their own.
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": f"{_BSD_HEAD} {_BSD_TAIL}",
    "BSD-3-Clause": f"{_BSD_HEAD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_TAIL}",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}
TEMPLATES = {name: [*NOTICES.get(name, []), *([TEXTS[name]] if name in TEXTS else [])] for name in dict.fromkeys([*NOTICES, *TEXTS])}
_WORDS = re.compile(r"[a-z]+|[0-9]+")
_TRIGGER = {"license", "licensed", "licenced", "copyright", "permission", "redistribution", "released", "rights"}
#: Every text with a trigger word, in either spelling, matches.
PREFILTER = r"(?i)licen[cs]e|copyright|permission|redistribution|released|rights"
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"


def _words(text: str) -> list[str]:
    return _WORDS.findall(text.lower().replace("licence", "license"))


class Matcher:
    """TF-IDF vectors of all templates, by the words that occur in them."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, texts: dict[str, str] = TEXTS):
        self.rows = [(name, _words(t)) for name, listed in templates.items() for t in listed]
        df = Counter(w for _, words in self.rows for w in set(words))
        self.idf = {w: np.log(1 + len(self.rows) / n) for w, n in df.items()}
        self.other = np.log(1 + len(self.rows))  # of words that no template has
        made = [(name, len(words), self._vector(words), words) for name, words in self.rows]
        self.at: dict[str, list] = {}  # trigger word -> templates and the places at which they have it
        for name, n, vector, words in made:
            for i, w in enumerate(words):
                if w in _TRIGGER:
                    self.at.setdefault(w, []).append((name, n, vector, i))
        self.whole = [(name, self._vector(_words(t))) for name, t in texts.items()]

    def _vector(self, words: list[str]) -> dict[str, float]:
        v = {w: n * self.idf.get(w, self.other) for w, n in Counter(words).items()}
        norm = np.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / norm for w, x in v.items()}

    @staticmethod
    def _cosine(a: dict, b: dict) -> float:
        return float(sum(x * b.get(w, 0.0) for w, x in a.items()))

    def best(self, text: str, least: float) -> tuple[str | None, float, bool]:
        """Licence, cosine, and whether the text as a whole is that of a licence."""
        words = _words(text)
        mine = self._vector(words)
        whole = max(((self._cosine(v, mine), name) for name, v in self.whole), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
        if whole[0] >= least:
            return whole[1], whole[0], True
        found: tuple = (0.0, None, 0.0)
        for at, w in enumerate(words):
            for name, n, vector, i in self.at.get(w, ()):
                cosine = self._cosine(vector, self._vector(words[max(0, at - i) : at - i + n]))
                if cosine >= least and (-cosine * n, name) < (-found[0], found[1] or ""):
                    found = (cosine * n, name, cosine)
        return found[1], found[2], False


def headers(files: DataFrame, least: float = 0.75) -> DataFrame:
    """files(id, path, text) -> id, path, licence, score, whole: rows with a match only."""

    def work(batches):
        import pyarrow as pa

        matcher = Matcher()
        for b in batches:
            out = [(i, p, *matcher.best(t, least)) for i, p, t in zip(*(b.column(c).to_pylist() for c in ("id", "path", "text")), strict=True)]
            out = [x for x in out if x[2]]
            types = (b.schema.field("id").type, pa.string(), pa.string(), pa.float64(), pa.bool_())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, types, strict=True)], names=["id", "path", "licence", "score", "whole"])

    kind = dict(files.dtypes)["id"]
    return files.filter(F.col("text").rlike(PREFILTER)).select("id", "path", "text").mapInArrow(work, f"id {kind}, path string, licence string, score double, whole boolean")


def _directory(path):
    return F.regexp_replace(path, "/?[^/]*$", "")


def licences(files: DataFrame, least: float = 0.75, salts: int = 8) -> DataFrame:
    """files(id, path, text) -> id, path, licence, method (file, header, inherited or null), score, source_path."""
    own = materialize(headers(files, least), "licence-headers")
    own = own.withColumn("is_file", F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False)) | F.col("whole"))
    order = F.struct("whole", "score", "licence", "path")
    by_dir = own.filter("is_file and path is not null").groupBy(_directory(F.col("path")).alias("up")).agg(F.max(order).alias("x")).select("up", F.col("x.licence").alias("dir_licence"), F.col("x.path").alias("dir_path"))
    names = files.select("id", "path")
    dirs = names.filter("path is not null").select(_directory(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    climbed = dirs.select("dir", F.explode(F.array_distinct(ups)).alias("up")).join(by_dir, "up")
    nearest = climbed.groupBy("dir").agg(F.max(F.struct(F.length("up").alias("n"), "dir_licence", "dir_path")).alias("y")).select("dir", "y.dir_licence", "y.dir_path")
    nearest = nearest.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    own = own.groupBy("id", "path").agg(F.max(F.struct("score", "licence", "is_file")).alias("o")).withColumnsRenamed({"id": "_id", "path": "_path"})
    rows = names.withColumn("_salt", F.pmod(F.hash("id", "path"), F.lit(salts))).withColumn("dir", _directory(F.col("path")))
    rows = rows.join(own, rows.id.eqNullSafe(own._id) & rows.path.eqNullSafe(own._path), "left").join(nearest, ["dir", "_salt"], "left")
    method = F.when(F.col("o.licence").isNotNull(), F.when(F.col("o.is_file"), "file").otherwise("header")).when(F.col("dir_licence").isNotNull(), "inherited")
    return rows.select("id", "path", F.coalesce("o.licence", "dir_licence").alias("licence"), method.alias("method"), F.col("o.score").alias("score"), F.when(F.col("o.licence").isNotNull(), F.col("path")).otherwise(F.col("dir_path")).alias("source_path"))


def op10_licence_scan(spark, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/doc_id.txt."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text")
    return licences(files).withColumnRenamed("id", "doc_id")
