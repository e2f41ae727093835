"""License scans: Dice coefficient over word bigrams between normalised text and licence templates.

The document as a whole, each line, and each paragraph of several lines (lines without a letter or digit part them, so that
comments count as the text in them) is a text to compare: notices wrapped over lines and the parts of licence files are
paragraphs. A text of n different bigrams can reach the
threshold t with a template of m only if n lies between m * t / (2 - t) and m * (2 - t) / t, so that each size has few
candidate templates; the sizes are an equality join with a small table. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence notices and short licences, by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-2-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
)
#: What parts paragraphs: a line, or several, without letters and digits of ASCII.
BLANK = "\\n([^A-Za-z0-9\\n]*\\n)+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words (a-z and 0-9) of the text, lower-cased."""
    return F.split(F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " ")), " ")


def bigrams(words: Column) -> Column:
    """The different pairs of neighbouring words; words must be a column, as it is used twice."""
    return F.array_distinct(F.array_compact(F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))))


def _bigrams(text: str) -> list[str]:
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def templates_by_size(templates, threshold: float) -> list[tuple[int, int, str, list[str]]]:
    """(size, template, licence, bigrams) for each size of text that can reach the threshold."""
    out = []
    for i, (licence, text) in enumerate(templates):
        own = _bigrams(text)
        low, high = math.ceil(len(own) * threshold / (2 - threshold) - 1e-9), math.floor(len(own) * (2 - threshold) / threshold + 1e-9)
        out += [(n, i, licence, own) for n in range(max(1, low), high + 1)]
    return out


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """A row per document of docs (doc_id, text): license, dice and template of the best match of any of its texts, and n_matches, its texts that match.

    Of equal matches the first template counts. Without a match, as for null and empty texts, license, dice and template are
    null and n_matches is 0. A paragraph of one line, or that is the whole text, is not a text of its own. Repeated rows have a row each. An empty table gives no rows.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame(templates_by_size(templates, threshold), "size int, template int, license string, own array<string>")
    row = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    sizes = [size for size, *_ in templates_by_size(templates, threshold)]
    paragraphs = F.filter(F.transform(F.split("text", BLANK), lambda p: F.btrim(p, F.lit("\n"))), lambda p: p.contains("\n") & (p != F.col("text")))
    units = F.transform(F.concat(F.array("text"), F.split("text", "\n"), paragraphs), words)
    split = row.select("doc_id", "key", F.posexplode(units).alias("place", "words"))
    # n words have at most n - 1 pairs, and d different words at least d - 1 different pairs
    near = (F.size("words") > min(sizes)) & (F.when(F.size("words") <= max(sizes) + 1, True).otherwise(F.size(F.array_distinct("words")) <= max(sizes) + 1))
    sized = split.where(near).select("doc_id", "key", "place", bigrams(F.col("words")).alias("found")).withColumn("size", F.size("found"))
    shared = F.size(F.array_intersect("found", "own"))
    compared = sized.join(F.broadcast(known), "size").withColumn("dice", F.lit(2.0) * shared / (F.col("size") + F.size("own"))).where(F.col("dice") >= threshold)
    best = F.max(F.struct("dice", (-F.col("template")).alias("order"), "license")).alias("best")
    matched = compared.groupBy("doc_id", "key").agg(best, F.size(F.collect_set("place")).cast("long").alias("n_matches"))
    matched = matched.withColumnsRenamed({"doc_id": "_doc", "key": "_key"})
    joined = row.drop("text").join(matched, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left")
    return joined.select(
        "doc_id", F.col("best.license").alias("license"), F.col("best.dice").alias("dice"), (-F.col("best.order")).alias("template"), F.coalesce("n_matches", F.lit(0).cast("long")).alias("n_matches")
    )


def oracle_sql(templates=TEMPLATES, threshold: float = 0.8) -> str:
    """The same over the table documents, in DuckDB's SQL."""
    quoted = ", ".join("({}, '{}', '{}')".format(i, licence, text.replace("'", "''")) for i, (licence, text) in enumerate(templates))
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    words = lambda text: f"string_split(trim(regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ')"
    return f"""
        WITH known AS (SELECT i, licence, {pairs} AS own FROM (SELECT i, licence, {words("t")} AS w FROM (VALUES {quoted}) v(i, licence, t))),
        units AS (SELECT doc_id, 0 AS place, text AS unit FROM documents
                  UNION ALL SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)), unnest(string_split(text, chr(10))) FROM documents
                  UNION ALL SELECT doc_id, -place, unit FROM (
                      SELECT doc_id, text, unnest(range(1, len(p) + 1)) AS place, trim(unnest(p), chr(10)) AS unit FROM (SELECT doc_id, text, string_split_regex(text, '{BLANK}') AS p FROM documents))
                  WHERE contains(unit, chr(10)) AND unit != text),
        found AS (SELECT doc_id, place, {pairs} AS f FROM (SELECT doc_id, place, {words("unit")} AS w FROM units)),
        dices AS (SELECT doc_id, place, i, licence, 2.0::DOUBLE * len(list_intersect(f, own)) / (len(f) + len(own)) AS dice FROM found, known
                  WHERE len(f) * (2 - {threshold}) >= len(own) * {threshold} - 1e-6 AND len(f) * {threshold} <= len(own) * (2 - {threshold}) + 1e-6),
        best AS (SELECT doc_id, arg_max(licence, (dice, -i)) AS license, max(dice) AS dice, arg_max(i::INTEGER, (dice, -i)) AS template, count(DISTINCT place) AS n_matches
                 FROM dices WHERE dice >= {threshold} GROUP BY doc_id)
        SELECT d.doc_id, license, dice, template, coalesce(n_matches, 0) AS n_matches FROM documents d LEFT JOIN best USING (doc_id)"""
