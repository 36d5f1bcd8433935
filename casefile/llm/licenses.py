"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Templates are dealt into length classes. A class of length L looks at windows of 2 L words that start at every multiple
of L, so any passage of up to L words lies whole in one window. A window that holds the asked share of a template's
shingles has a known least Jaccard similarity with it; the class gets as many bands (of one hash each) as make a miss
rarer than ``miss``. Windows without any template shingle can hold no template and are not signed.

DataFrame operations only.
"""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.llm.common import cut, stored
from casefile.llm.decontaminate import words

SHINGLE = 5
BROADCAST_ROWS = 2_000_000

# fixed values: notices and opening passages of well-known licences
NOTICES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT notice": "Released under the MIT License.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}


_GPL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation; either version {1} of the License, or (at your option) any later version."
_NO_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
# standard notices and short licences, as their stewards recommend them
NOTICES |= {
    "GPL-2.0 notice": _GPL.format("General Public License", "2"),
    "LGPL-2.1 notice": _GPL.format("Lesser General Public License", "2.1"),
    "LGPL-3.0 notice": _GPL.format("Lesser General Public License", "3"),
    "AGPL-3.0 notice": _GPL.format("Affero General Public License", "3"),
    "MIT disclaimer": _NO_WARRANTY + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. " + _BSD,
    "BSD disclaimer": _BSD,
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "EPL-2.0 notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "CC0-1.0 notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
} | {
    f"CC-{code.upper()}-{version} notice": f"This work is licensed under a Creative Commons {name} {version} {'Unported' if version == '3.0' else 'International'} License."
    for version in ("3.0", "4.0")
    for code, name in {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivs" if version == "3.0" else "Attribution-NoDerivatives", "by-nc": "Attribution-NonCommercial", "by-nc-sa": "Attribution-NonCommercial-ShareAlike"}.items()
    if (code, version) != ("by", "4.0")  # above
} | {
    f"SPDX {x}": f"SPDX-License-Identifier: {x}"
    for x in ("Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "EPL-2.0")
}
# whole texts, see README for their origin
NOTICES |= {f"{path.stem} text": path.read_text() for path in sorted((Path(__file__).parent / "spdx").glob("*.txt"))}


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NOTICES.items()), "template string, text string")


def length_class(size: int) -> int:
    """Smallest class that holds ``size`` words: each length up to 16, then steps of a quarter."""
    length = min(max(size, SHINGLE), 16)
    while length < size:
        length = math.ceil(length * 1.25)
    return length


def bands(length: int, containment: float, miss: float) -> int:
    """Bands after which a window that holds a template of the class is missed with a probability below ``miss``."""
    smallest = max(SHINGLE, next(n for n in range(1, length + 1) if length_class(n) == length))
    own, window = smallest - SHINGLE + 1, 2 * length - SHINGLE + 1
    shared = math.ceil(containment * own - 1e-9)
    similarity = shared / (window + own - shared)
    return math.ceil(math.log(miss) / math.log(1 - similarity))


def shingles(words_: str) -> Column:
    """XXH64 of every ``SHINGLE`` words in a row; none for fewer words."""
    n = F.size(words_)
    one = lambda i: F.xxhash64(*[F.get(words_, i + k) for k in range(SHINGLE)])
    return F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(0), n - SHINGLE), one)).otherwise(F.array().cast("array<bigint>"))


def signed(rows: DataFrame, hashes: str, counts: dict[int, int]) -> DataFrame:
    """Adds ``band`` and ``value``, a row per band (as many as ``counts`` gives the row's class): the least of the row's
    hashes under the band's own hash function."""
    count = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])[F.col("length")]
    each = rows.withColumn("band", F.explode(F.sequence(F.lit(0), count - 1)))
    return each.withColumn("value", F.array_min(F.transform(hashes, lambda h: F.xxhash64(F.col("band"), h))))


def scan(docs: DataFrame, known: DataFrame, containment: float = 0.8, miss: float = 1e-6) -> DataFrame:
    """Rows (doc_id, text_hash, template, start, stop, containment): passages of ``docs``, in words, that hold at least
    ``containment`` of a template's distinct five-word shingles within a window of its class.

    ``start`` and ``stop`` enclose the shared shingles. ``known`` has (template, text), a table that fits the driver
    as a list of lengths only; templates of fewer than five words have no shingle and match nothing, and neither do null
    or short texts. Templates repeated in full count once. Documents repeated in full give their passages once.
    """
    df = known.select("template", words(F.col("text")).alias("_w")).distinct()
    df = df.select("template", F.size("_w").alias("size"), F.array_distinct(shingles("_w")).alias("have")).filter(F.size("have") > 0)
    sizes = [r.size for r in cut(df.select("size").distinct()).collect()]  # distinct lengths, not templates
    if not sizes:
        return docs.select("doc_id", F.hash("text").alias("text_hash")).filter("false").selectExpr("*", "'' AS template", "0 AS start", "0 AS stop", "0D AS containment")
    by = {n: length_class(n) for n in sizes}
    length = F.create_map(*[F.lit(x) for pair in by.items() for x in pair])[F.col("size")]
    df = stored(df.withColumn("length", length), "templates")
    wanted = df.select("length", F.explode("have").alias("_x")).distinct()
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    hashed = docs.select("doc_id", F.hash("text").alias("text_hash"), words(F.col("text")).alias("_w")).withColumn("_h", shingles("_w"))
    # outer: a filter on the array's size, which a plain explode brings along, would hash every text twice
    at = hashed.select("doc_id", "text_hash", F.posexplode_outer("_h").alias("pos", "_x")).join(wanted, "_x")
    k = F.expr("pos div length")
    spots = at.select("doc_id", "text_hash", "length", F.explode(F.array(k, k - 1)).alias("k")).filter("k >= 0").distinct()
    spots = stored(spots, "windows").groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).agg(F.collect_list(F.struct("length", "k")).alias("_s"))
    spots = stored(spots, "spots")
    if spots.count() <= BROADCAST_ROWS:
        spots = F.broadcast(spots)
    cases = docs.select("doc_id", "text").join(spots, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.hash("text") == F.col("_t"))).select("doc_id", F.col("_t").alias("text_hash"), "_s", words(F.col("text")).alias("_w"))
    cases = cases.withColumn("_h", shingles("_w")).select("doc_id", "text_hash", "_h", F.explode("_s").alias("_s"))
    begin = (F.col("_s.k") * F.col("_s.length")).cast("int")
    cases = cases.select("doc_id", "text_hash", F.col("_s.length").alias("length"), begin.alias("begin"), F.slice("_h", begin + 1, F.col("_s.length") * 2 - SHINGLE + 1).alias("held"))
    cases = stored(cases.distinct(), "cases")
    counts = {n: bands(n, containment, miss) for n in by.values()}
    left = signed(cases, "held", counts).select("doc_id", "text_hash", "length", "begin", "band", "value")
    right = signed(df, "have", counts).select("template", "length", "band", "value")
    pairs = left.join(right, ["length", "band", "value"]).select("doc_id", "text_hash", "length", "begin", "template").distinct()
    a, b = pairs.alias("a"), cases.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    for c in ("text_hash", "length", "begin"):
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    df2 = a.join(b, same).select("b.doc_id", "b.text_hash", "b.begin", "b.held", "a.template").join(df.select("template", "have"), "template")
    shared = F.size(F.array_intersect("held", "have"))
    places = F.filter(F.transform("held", lambda h, i: F.when(F.array_contains("have", h), i)), lambda i: i.isNotNull())
    out = df2.withColumn("containment", shared / F.size("have")).filter(F.col("containment") >= containment - 1e-9).withColumn("_p", places)
    start = (F.col("begin") + F.array_min("_p")).cast("int")
    return out.select("doc_id", "text_hash", "template", start.alias("start"), (F.col("begin") + F.array_max("_p") + SHINGLE).cast("int").alias("stop"), "containment").distinct()
