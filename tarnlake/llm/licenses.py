"""License scans: MinHash bands over overlapping windows of words retrieve templates, shingle containment verifies them."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.common import documents, stored

# Public license notices and permission texts, by SPDX-like name.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("all-rights-reserved", "All rights reserved."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]

SHINGLE = 5
#: Classes of windows: shingles in a window, step from one window of a text to the next, bands (minima) of a window.
#: A template is in the largest class whose windows surely fit into it wherever a text's grid of windows lies.
CLASSES = [(1, 1, 1), (4, 2, 2), (16, 8, 8)]
#: A band says where a template begins but for so many words.
SPAN = CLASSES[-1][0]
#: Band values of templates that may be broadcast (24 bytes each); more are joined by a shuffle.
BROADCAST_BANDS = 1_000_000
#: Rows of a table of bits, of 64 bits each: it is broadcast, and takes 8 MB at most.
FILTER_WORDS = 1 << 19
#: The value that stands for a document itself among its band values.
SELF = -1


def collision(jaccard: float, bands: int = CLASSES[-1][2]) -> float:
    """The chance that two windows of this Jaccard similarity share a band."""
    return 1 - (1 - jaccard) ** bands


def class_of(shingles: int) -> int:
    """The class of a template with so many shingles."""
    return max(i for i, (width, step, _) in enumerate(CLASSES) if i == 0 or shingles >= width + step - 1)


def mask(*of: int) -> int:
    """The 64 bits that a band's hash is xored with, which puts hashes into an order of its own."""
    return int.from_bytes(hashlib.sha256(repr(of).encode()).digest()[:8], "big", signed=True)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _runs(hashes: Column, size: int) -> Column:
    """Hashes of each run of `size` words, from the words' hashes; none of shorter texts."""
    n = F.size(hashes)
    run = lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(size)])
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), run)).otherwise(F.array().cast("array<bigint>"))


def _ordered(hashes: Column, m: int) -> Column:
    return F.transform(hashes, lambda x: x.bitwiseXOR(F.lit(m)))


def _minimum(values: list[Column], m: int) -> Column:
    xored = [v.bitwiseXOR(F.lit(m)) for v in values]
    return F.least(*xored) if len(xored) > 1 else xored[0]


def _banded(s: Column, number: int) -> list[tuple[str, Column]]:
    """Columns, each from the one before, the last of which has the bands of a text's windows of a class: of all shingles
    of a window the smallest by each band's order, window after window. Blocks of a step's shingles are reduced first."""
    width, step, bands = CLASSES[number]
    masks = [mask(number, j) for j in range(bands)]
    none = F.array().cast("array<bigint>")
    if width == 1:
        return [(f"b{number}", _ordered(s, masks[0]))]
    per, blocks, parts = width // step, f"k{number}", F.floor(F.size(s) / step).cast("int")

    def block(i):
        values = F.array(*[F.get(s, i * step + j) for j in range(step)])
        if step <= 2:
            return F.array(*[_minimum([F.get(s, i * step + j) for j in range(step)], m) for m in masks])
        return F.transform(F.array(values), lambda v: F.array(*[F.array_min(_ordered(v, m)) for m in masks]))[0]

    reduced = F.when(parts >= per, F.transform(F.sequence(F.lit(0), parts - 1), block))
    at = F.col(blocks)
    merged = F.transform(F.sequence(F.lit(0), F.size(at) - per), lambda i: F.array(*[F.least(*[F.get(F.get(at, i + p), j) for p in range(per)]) for j in range(bands)]))
    return [(blocks, reduced), (f"b{number}", F.when(at.isNotNull(), F.flatten(merged)).otherwise(none))]


def prepared(templates: DataFrame) -> DataFrame:
    """name, template (its number), n (words), size (words in a shingle: SHINGLE, or all of a shorter template's), shingles, and
    bands: an array of (band, offset) for the windows at every start, by the functions that documents meet."""
    rows = templates.withColumn("h", F.transform(_words(F.coalesce("text", F.lit(""))), lambda w: F.xxhash64(w))).withColumn("n", F.size("h")).filter("n > 0")
    rows = rows.withColumn("s", _runs(F.col("h"), SHINGLE))
    small = F.coalesce(*[F.when(F.col("n") == m, F.array(F.xxhash64(*[F.get("h", j) for j in range(m)]).bitwiseXOR(F.lit(mask(-1, m))))) for m in range(1, SHINGLE)])

    def windows(number):
        width, _, bands = CLASSES[number]
        one = lambda i, j: F.array_min(_ordered(F.slice("s", i + 1, width), mask(number, j)))
        every = F.transform(F.sequence(F.lit(0), F.size("s") - width), lambda i: F.array(*[F.struct(one(i, j).alias("band"), i.alias("offset")) for j in range(bands)]))
        return F.flatten(every)

    least = [max(1, width + step - 1) for width, step, _ in CLASSES]
    found = F.when(F.col("n") < SHINGLE, F.transform(small, lambda b: F.struct(b.alias("band"), F.lit(0).alias("offset"))))
    for number in reversed(range(len(CLASSES))):
        found = found.when(F.size("s") >= least[number], windows(number))
    return rows.select("name", "template", "n", F.least("n", F.lit(SHINGLE)).alias("size"), F.array_distinct("s").alias("shingles"), found.alias("bands"))


def _match() -> Column:
    return F.struct("template", "name", (-F.col("m.late")).alias("start"), F.col("m.containment").alias("containment"))


def license_matches(docs: DataFrame, templates: list[tuple[str, str]] | DataFrame | None = None, text_col: str = "text", id_col: str = "doc_id", least: float = 0.8) -> DataFrame:
    """One row per row of docs: doc_id and matches, a sorted array of (template, name, start, containment).

    A match is a place in a text that has at least `least` of a template's word shingles within the template's length
    and a quarter of it and SPAN words on both sides; start is the word at which the first of them stands. Words are lower-cased runs of
    a-z and 0-9. templates: pairs of name and text, or a table with these columns.
    1. Texts are laid out in overlapping windows of each class in CLASSES, and the minima of each window's shingles by
       some random orders are its bands. Templates have the bands of their windows at every start. A passage without
       edits has windows that are equal to a template's and share all bands; see `collision` for others.
    2. Bands of texts are joined with the table of template bands. A hit says where in the text the template would begin.
    3. There the shingles are compared exactly. Of a template's hits in a stretch of its length the best one stays.
    Templates are rows, so the plan is the same for any number of them. Their bands are broadcast up to BROADCAST_BANDS;
    no text is shuffled then: hits and one short row per document are. More bands are joined by a shuffle, see _beyond.

    Null texts count as empty; rows are told apart by id and text, and equal rows each get their matches; null ids
    are ids like others. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    if not isinstance(templates, DataFrame):
        given = TEMPLATES if templates is None else templates
        templates = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(given)], "template int, name string, text string")
    elif "template" not in templates.columns:
        templates = templates.select("name", "text", F.xxhash64("name", "text").alias("template"))
    table = stored(prepared(templates), "license-templates")
    number = templates.schema["template"].dataType
    # the outer forms of inline and posexplode, as Spark would push a test of the others' arrays below all steps that make them
    bands = table.select("template", F.inline_outer("bands")).filter("band is not null").groupBy("band", "template", F.floor(F.col("offset") / SPAN)).agg(F.min("offset").alias("offset"))
    bands = bands.select("band", "template", "offset")
    few = bands.count() <= BROADCAST_BANDS
    sizes = sorted(r["n"] for r in table.filter(F.col("n") < SHINGLE).select("n").distinct().collect())

    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.select("doc_id", F.xxhash64("text").alias("uid"), F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)).alias("h")).withColumn("s", _runs(F.col("h"), SHINGLE))
    for m in sizes:
        d = d.withColumn(f"small{m}", _ordered(_runs(F.col("h"), m), mask(-1, m)))
    for i in range(len(CLASSES)):
        for name, value in _banded(F.col("s"), i):
            d = d.withColumn(name, value)
    lists = [*[f"b{i}" for i in range(len(CLASSES))], *[f"small{m}" for m in sizes]]
    flat = F.array(*[F.size(c) for c in lists]).alias("sizes"), F.concat(*lists, F.array(F.lit(SELF).cast("bigint")))
    # the window's first word, from the value's place in the list of its class
    before, at = F.lit(0), F.lit(0)
    for i, (_, step, count) in reversed([*enumerate([*CLASSES, *[(1, 1, 1)] * len(sizes)])]):
        before = sum((F.get("sizes", j) for j in range(i)), F.lit(0))
        place = F.floor((F.col("pos") - before) / count).cast("int") * step
        at = F.when(F.col("pos") >= before, place) if i == len(lists) - 1 else at.when(F.col("pos") >= before, place)
    begin = F.greatest(at - F.col("offset"), F.lit(0)).alias("start")
    facts = table.select(F.col("template").alias("_t"), "name", "n", "shingles")
    if not few:
        return _beyond(d, flat, at, bands, facts, least)

    own = spark.createDataFrame([(SELF, None, 0)], f"band bigint, template {number.simpleString()}, offset int")
    rows = d.select("doc_id", "uid", "s", flat[0], flat[1].alias("flat"))
    hits = rows.select("doc_id", "uid", "s", "sizes", F.posexplode_outer("flat").alias("pos", "band")).join(F.broadcast(bands.unionByName(own)), "band")
    met = _compared(_regions(hits.select("doc_id", "uid", "s", "template", begin).join(F.broadcast(facts), F.col("template") == F.col("_t"), "left"), "shingles"))
    best = _best(met.filter(F.col("template").isNull() | (F.col("containment") >= least)))
    match = F.when(F.col("template").isNotNull(), _match())
    out = best.groupBy("doc_id", "uid").agg(F.array_sort(F.collect_list(match)).alias("matches"), F.max(F.when(F.col("template").isNull(), F.col("copies"))).alias("copies"))
    return out.select("doc_id", "matches", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy")).drop("copy")


def _regions(hits: DataFrame, *more: str) -> DataFrame:
    """The shingles of each hit's surroundings in its text, in place of all of them (s)."""
    pad = F.ceil(F.col("n") / 4).cast("int") + SPAN
    low = F.greatest(F.col("start") - pad, F.lit(0))
    region = F.when(F.col("n") >= SHINGLE, F.slice("s", low + 1, F.col("start") + F.col("n") - SHINGLE + 1 + pad - low))
    return hits.select("doc_id", "uid", "template", "name", "n", *more, "start", low.alias("low"), region.alias("region"))


def _compared(regions: DataFrame) -> DataFrame:
    """doc_id, uid, template, name, n, start and containment of each hit with its region and its template's shingles."""
    met = regions.withColumn("common", F.array_intersect("region", "shingles"))
    share = F.when(F.col("n") < SHINGLE, 1.0).otherwise(F.size("common") / F.size("shingles"))
    start = F.when(F.col("n") < SHINGLE, F.col("start")).when(F.size("common") > 0, F.col("low") + F.array_position("region", F.get("common", 0)).cast("int") - 1)
    return met.select("doc_id", "uid", "template", "name", "n", start.alias("start"), share.alias("containment"))


def _best(met: DataFrame) -> DataFrame:
    """Of a template's hits in a stretch of its length, the best."""
    stretch = F.floor(F.col("start") / F.col("n")).alias("stretch")
    return met.groupBy("doc_id", "uid", "template", stretch).agg(F.max(F.struct("containment", (-F.col("start")).alias("late"))).alias("m"), F.first("name").alias("name"), F.count("*").alias("copies"))


def _beyond(d: DataFrame, flat: tuple[Column, Column], at: Column, bands: DataFrame, facts: DataFrame, least: float) -> DataFrame:
    """The matches where bands are too many for a broadcast.

    Only values that template bands may have leave the texts: a table of bits, of FILTER_WORDS rows at most, is broadcast
    and tells the others. What is left is shuffled as short rows (document, place, band), and only texts with a hit bring
    their shingles to the comparison, picked by another table of bits. Overfull bits let more rows pass and change nothing.
    """
    d, bands = d.withColumns({"sizes": flat[0], "flat": flat[1]}), stored(bands, "license-bands")
    rows = d.select("doc_id", "uid", "sizes", F.posexplode_outer("flat").alias("pos", "band")).select("doc_id", "uid", "band", at.alias("at"))
    hits = _passing(rows, "band", bands).join(bands.hint("shuffle_merge"), "band")
    hits = hits.select("doc_id", "uid", "template", F.greatest(F.col("at") - F.col("offset"), F.lit(0)).alias("start")).distinct()
    hits = stored(hits.join(facts.select("_t", "name", "n"), F.col("template") == F.col("_t")).drop("_t"), "license-hits")
    texts = _passing(d.select("doc_id", "uid", "s"), "uid", hits).withColumnRenamed("doc_id", "_d").withColumnRenamed("uid", "_u")
    met = _regions(hits.join(texts, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("uid") == F.col("_u"))))
    met = met.join(facts.select("_t", "shingles"), F.col("template") == F.col("_t"))
    best = _best(_compared(met).filter(F.col("containment") >= least))
    found = best.groupBy(F.col("doc_id").alias("_d"), F.col("uid").alias("_u")).agg(F.array_sort(F.collect_list(_match())).alias("matches"))
    out = d.select("doc_id", "uid").join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("uid") == F.col("_u")), "left")
    return out.select("doc_id", F.coalesce("matches", F.array().cast(found.schema["matches"].dataType)).alias("matches"))


def _passing(rows: DataFrame, column: str, of: DataFrame) -> DataFrame:
    """The rows whose value may be among those of `of`: their bits are in a table that is broadcast."""
    word = lambda c: F.shiftright(c, 6).bitwiseAND(F.lit(FILTER_WORDS - 1))
    bit = lambda c: F.expr(f"shiftleft(1L, cast(`{c}` & 63 as int))")
    bits = of.select(word(F.col(column)).alias("_word"), bit(column).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    met = rows.join(F.broadcast(bits), word(F.col(column)) == F.col("_word"))
    return met.filter(F.col("_bits").bitwiseAND(bit(column)) != 0).select(rows.columns)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_templates (distinct templates found), licenses (their names, sorted, joined by commas) and best (the largest containment, 0 if none)."""
    m = license_matches(documents(spark, sf_dir))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda x: x["name"])))
    return m.select(
        "doc_id",
        F.size(F.array_distinct(F.transform("matches", lambda x: x["template"]))).cast("long").alias("n_templates"),
        F.array_join(names, ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("matches", lambda x: x["containment"])), F.lit(0.0)).alias("best"),
    )
