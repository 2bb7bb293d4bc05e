"""Licence scans, by DataFrame expressions only.

Three kinds of units are compared with templates by the cosine of sparse TF-IDF vectors: sentences with a licence cue, a
machine-readable tag being the identifier that it names; paragraphs with a cue, whose lines are one text without comment
signs, so that wrapped headers are whole; and the whole text of files that are named as licence files are.  Templates are one-line
notices, identifiers, the usual headers, and the texts of the short licences and the openings of the long ones.  Equal units are
compared once, however often they occur; document frequencies are over all units, repeats counted.  A document's licence is
that of its best unit.  Files named as licence files, and documents of which ``FILE_SHARE`` is notice, state the licence of
their directory; documents without a notice of their own inherit from their nearest ancestor directory that has one, found by
joining directories, not documents, on their ancestors.

The templates are a fixed table of the size that ``TEMPLATES`` has, which bounds what is broadcast.

Defined results: null and empty texts have no notice and inherit; a null path inherits nothing.  Equal scores go to the
first template name.  Several licence files in one directory: the best score states its licence, ties to the first
name.  Repeated rows are rows of their own.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import checkpointed

# Names of licences and the words of their usual notices.
NOTICES = {
    "AGPL-3.0": "licensed under the gnu affero general public license version 3",
    "Apache-2.0": "licensed under the apache license version 2.0",
    "BSD-2-Clause": "released under the bsd 2-clause license simplified",
    "BSD-3-Clause": "released under the bsd 3-clause license",
    "CC-BY-4.0": "licensed under cc by 4.0",
    "CC-BY-NC-4.0": "licensed under cc by-nc 4.0",
    "CC-BY-SA-4.0": "licensed under cc by-sa 4.0",
    "CC0-1.0": "dedicated to the public domain under cc0 1.0 universal",
    "EPL-2.0": "available under the terms of the eclipse public license 2.0",
    "GPL-2.0": "this work is licensed under the gnu general public license version 2",
    "GPL-3.0": "this work is licensed under the gnu general public license version 3",
    "ISC": "released under the isc license",
    "LGPL-3.0": "licensed under the gnu lesser general public license version 3",
    "MIT": "released under the mit license",
    "MPL-2.0": "subject to the terms of the mozilla public license version 2.0",
    "Proprietary": "all rights reserved",
    "Unlicense": "this is free and unencumbered software released into the public domain the unlicense",
    "Zlib": "released under the zlib license",
}
# The published texts of short licences and of the usual headers, and the openings of long licences.
_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions:"""
_MIT_END = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_FREE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the
Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the
hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program. If not, see
<https://www.gnu.org/licenses/>."""
_GNU = """GNU {0} Version {1}, {2} Copyright (C) {3} Free Software Foundation, Inc. Everyone is permitted to copy and distribute
verbatim copies of this license document, but changing it is not allowed."""
_GNU_PREAMBLE = """The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most
software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General
Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free
software for all its users. We, the Free Software Foundation, use the GNU General Public License for most of our software; it applies
also to any other work released this way by its authors. You can apply it to your programs, too."""
LONGER = {
    "AGPL-3.0": [_FREE.format("Affero General Public License", 3), _GNU.format("AFFERO GENERAL PUBLIC LICENSE", 3, "19 November 2007", 2007)],
    "Apache-2.0": [
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You
may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of
this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.""",
    ],
    "BSD-2-Clause": [_BSD, f"{_BSD} {_BSD_END}"],
    "BSD-3-Clause": [f"{_BSD} {_BSD_NAMES}", f"{_BSD} {_BSD_NAMES} {_BSD_END}"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": [_FREE.format("General Public License", 2), _GNU.format("GENERAL PUBLIC LICENSE", 2, "June 1991", "1989, 1991")],
    "GPL-3.0": [
        _FREE.format("General Public License", 3), _GNU.format("GENERAL PUBLIC LICENSE", 3, "29 June 2007", 2007),
        _GNU.format("GENERAL PUBLIC LICENSE", 3, "29 June 2007", 2007) + " Preamble " + _GNU_PREAMBLE,
    ],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS
ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR
BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "LGPL-3.0": [_FREE.format("Lesser General Public License", 3), _GNU.format("LESSER GENERAL PUBLIC LICENSE", 3, "29 June 2007", 2007)],
    "MIT": [_GRANT, f"{_GRANT} {_MIT_END}"],
    "MPL-2.0": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ],
    "Proprietary": ["Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited."],
    "Unlicense": [
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by
any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest
in the software to the public domain.""",
    ],
    "Zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not
be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such,
and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source
distribution.""",
    ],
}
#: (licence, form, text): a notice, an identifier and the longer forms of each.
TEMPLATES = [
    (name, form, " ".join(text.split()))
    for name, notice in NOTICES.items()
    for form, text in enumerate([notice, name.lower(), *LONGER.get(name, [])])
]
CUE = r"(licen[cs]e|public domain|all rights reserved|copyright|spdx|hereby granted|redistribution and use|free software)"
TAG = r".*spdx-license-identifier:[\x20\t]*"
LATER = r"-(only|or-later)"
#: Signs that begin a line of a comment.
COMMENT = r"(^|\n)[\x20\t]*(//+|/?\*+/?|#+|;+|--+|<!--|%+)"
SENTENCE = r"\n+|[.!?]+[\x20\t\n\r]"
PARAGRAPH = r"\n([\x20\t\r]*\n)+"
TOKEN = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
WORD = r"[^\x20\x09-\x0D]+"
#: Names of licence files, in lower case.
FILE_NAME = r"(^|/)(un)?(licen[cs]e|copying|copyright)[^/]*$"
#: Least cosine of a notice, and the share of a document's words from which it is a licence file by its content.
LEAST, FILE_SHARE = 0.5, 0.1


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "licence string, form int, notice string")


def _terms(df: DataFrame, text: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.explode(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def compared_units(df: DataFrame, text_col: str, path_col: str) -> DataFrame:
    """(the columns of ``df``, kind, unit): every sentence and paragraph with a cue of every whole text, and whole licence files."""
    plain = F.regexp_replace(F.lower(F.col(text_col)), COMMENT, "$1")
    named = F.coalesce(F.lower(F.col(path_col)).rlike(FILE_NAME), F.lit(False))

    def units(kind, parts):
        return F.transform(parts, lambda u: F.struct(F.lit(kind).alias("kind"), u.alias("unit")))

    sentences = F.filter(F.transform(F.split("plain", SENTENCE), lambda u: F.trim(u)), lambda u: u.rlike(CUE))
    sentences = F.transform(sentences, lambda u: F.when(u.contains("spdx-license-identifier"), F.regexp_replace(F.regexp_replace(u, TAG, ""), LATER, "")).otherwise(u))
    paragraphs = F.filter(F.split("plain", PARAGRAPH), lambda u: u.rlike(CUE))
    whole = F.when(F.col("named"), F.array("plain")).otherwise(F.array().cast("array<string>"))
    every = F.concat(units("sentence", sentences), units("paragraph", paragraphs), units("file", whole))
    some = df.filter(F.lower(F.col(text_col)).rlike(CUE) | named & F.col(text_col).isNotNull())
    rows = some.withColumn("plain", plain).withColumn("named", named).withColumn("found", F.explode(every))
    return rows.select(*df.columns, "found.kind", "found.unit")


def unit_licences(counted: DataFrame) -> DataFrame:
    """(key, licence, score) from (key, unit, occurs): the best template of each unit, where it reaches the least cosine."""
    spark = counted.sparkSession
    known = F.broadcast(_terms(templates(spark), "notice", "licence", "form"))
    terms = _terms(counted, "unit", "key", "occurs")
    frequency = terms.groupBy("term").agg(F.sum("occurs").alias("df"))
    # the number of units is a scalar subquery, not a value on the driver
    total = counted.agg(F.coalesce(F.sum("occurs"), F.lit(0)).alias("n")).scalar()
    wanted = frequency.withColumn("n", total).withColumn("idf", F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1.0)
    weighed = terms.join(wanted.select("term", "idf"), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    template_idf = known.join(frequency, "term", "left").withColumn("n", total).withColumn("idf", F.log((F.col("n") + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0)
    vectors = template_idf.select("licence", "form", "term", (F.col("tf") * F.col("idf")).alias("tw"))
    template_norms = vectors.groupBy("licence", "form").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("template_norm"))
    dots = weighed.join(F.broadcast(vectors), "term").groupBy("key", "licence", "form").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(norms, "key").join(F.broadcast(template_norms), ["licence", "form"]).withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("template_norm")), 6))
    best = scored.filter(F.col("score") >= LEAST).groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("minus"), F.col("licence"))).alias("b"))
    return best.select("key", F.col("b.licence").alias("licence"), (-F.col("b.minus")).alias("score"))


def detect(df: DataFrame, id_col: str, text_col: str, path_col: str) -> DataFrame:
    """(doc_id, path, n_words, notice_words, own, score), the last two null where no notice is found."""
    plain = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    found = compared_units(plain, "text", "path")
    words = F.regexp_count("unit", F.lit(WORD)).cast("long").alias("words")
    units = checkpointed(found.select("doc_id", "path", F.xxhash64("text").alias("mark"), "kind", "unit", F.xxhash64("unit").alias("key"), words))
    counted = units.groupBy("key").agg(F.min("unit").alias("unit"), F.count("*").alias("occurs"))
    named = unit_licences(counted)
    by_kind = (
        units.groupBy("doc_id", "path", "mark", "kind", "key").agg(F.min("words").alias("words"))
        .join(named, "key")
        .groupBy("doc_id", "path", "mark", "kind")
        .agg(F.min(F.struct((-F.col("score")).alias("minus"), F.col("licence"))).alias("b"), F.sum("words").alias("words"))
    )
    # kinds overlap: the one that covers most says how much of a text is notice
    per_doc = by_kind.groupBy("doc_id", "path", "mark").agg(F.min("b").alias("b"), F.max("words").alias("notice_words"))
    rows = plain.select("doc_id", "path", F.xxhash64("text").alias("mark"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    return _null_safe_left(rows, per_doc, ["doc_id", "path", "mark"]).select(
        "doc_id", "path", "n_words", F.coalesce("notice_words", F.lit(0)).cast("long").alias("notice_words"), F.col("b.licence").alias("own"), (-F.col("b.minus")).alias("score")
    )


def _null_safe_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"{k}_of" for k in keys})
    on = None
    for k in keys:
        same = left[k].eqNullSafe(renamed[f"{k}_of"])
        on = same if on is None else on & same
    return left.join(renamed, on, "left").drop(*(f"{k}_of" for k in keys))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path") -> DataFrame:
    """(doc_id, path, n_words, notice_words, licence, score, origin): own notices, then those of the nearest ancestor directory."""
    found = detect(df, id_col, text_col, path_col).withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    mostly = (F.col("notice_words") >= FILE_SHARE * F.col("n_words")) | F.lower("path").rlike(FILE_NAME)
    files = found.filter(F.col("own").isNotNull() & mostly & F.col("path").isNotNull())
    stated = files.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("minus"), F.col("own"))).alias("b")).select("dir", F.col("b.own").alias("stated"))
    dirs = found.filter("path IS NOT NULL").select("dir").distinct().withColumn("parts", F.split("dir", "/"))
    ancestors = dirs.select("dir", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"), "parts").select("dir", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("ancestor"))
    near = ancestors.join(stated.withColumnRenamed("dir", "ancestor"), "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "stated", "ancestor")).alias("n"))
    inherited = near.select("dir", F.col("n.stated").alias("stated"), F.col("n.ancestor").alias("ancestor"))
    return found.join(inherited, "dir", "left").select(
        "doc_id", "path", "n_words", "notice_words", F.coalesce("own", "stated").alias("licence"), "score",
        F.when(F.col("own").isNotNull(), "notice").when(F.col("stated").isNotNull(), F.concat(F.lit("directory:"), F.col("ancestor"))).otherwise("none").alias("origin"),
    )


def document_path(df: DataFrame) -> DataFrame:
    """``df`` with the path that a document has by its source, language and number."""
    place = F.format_string("/%s/%s/%d/%d", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.expr("doc_id div 100"), F.col("doc_id"))
    return df.withColumn("path", place)


def scan_sql(table: str = "documents") -> str:
    """DuckDB SQL for ``scan`` over documents under their paths."""
    values = ", ".join("('{}', {}, '{}')".format(name, form, text.replace("'", "''")) for name, form, text in TEMPLATES)
    token = TOKEN
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, text, printf('/%s/%s/%d/%d', coalesce(source, 'none'), coalesce(lang, 'none'), doc_id // 100, doc_id) AS path,
    CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS n_words FROM {table}),
templates(licence, form, notice) AS (VALUES {values}),
chosen AS (
  SELECT row, regexp_replace(lower(text), '{COMMENT}', '\\1', 'g') AS plain, regexp_matches(lower(path), '{FILE_NAME}') AS named FROM docs
  WHERE text IS NOT NULL AND (regexp_matches(lower(text), '{CUE}') OR regexp_matches(lower(path), '{FILE_NAME}'))),
units AS (
  SELECT row, 'sentence' AS kind, CASE WHEN contains(s, 'spdx-license-identifier') THEN regexp_replace(regexp_replace(s, '{TAG}', '', 'g'), '{LATER}', '', 'g') ELSE s END AS unit
  FROM (SELECT row, trim(unnest(regexp_split_to_array(plain, '{SENTENCE}'))) AS s FROM chosen) WHERE regexp_matches(s, '{CUE}')
  UNION ALL SELECT row, 'paragraph', p FROM (SELECT row, unnest(regexp_split_to_array(plain, '{PARAGRAPH}')) AS p FROM chosen) WHERE regexp_matches(p, '{CUE}')
  UNION ALL SELECT row, 'file', plain FROM chosen WHERE named),
counted AS (SELECT unit, count(*) AS occurs FROM units GROUP BY unit),
terms AS (
  SELECT unit, occurs, term, count(*) AS tf FROM (SELECT unit, occurs, unnest(regexp_extract_all(lower(unit), '{token}')) AS term FROM counted) GROUP BY ALL),
known AS (SELECT licence, form, term, count(*) AS tf FROM (SELECT licence, form, unnest(regexp_extract_all(lower(notice), '{token}')) AS term FROM templates) GROUP BY ALL),
frequency AS (SELECT term, sum(occurs) AS df FROM terms GROUP BY term),
total AS (SELECT coalesce(sum(occurs), 0) AS n FROM counted),
weighed AS (SELECT unit, t.term, t.tf * (ln((n + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1.0::DOUBLE) AS w FROM terms t JOIN frequency f ON t.term = f.term, total),
vectors AS (SELECT licence, form, k.term, k.tf * (ln((n + 1.0::DOUBLE) / (coalesce(df, 0) + 1.0::DOUBLE)) + 1.0::DOUBLE) AS tw FROM known k LEFT JOIN frequency f ON k.term = f.term, total),
norms AS (SELECT unit, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY unit),
template_norms AS (SELECT licence, form, sqrt(sum(tw * tw)) AS template_norm FROM vectors GROUP BY licence, form),
scored AS (
  SELECT d.unit, d.licence, round(dot / (norm * template_norm), 6) AS score
  FROM (SELECT unit, licence, form, sum(w * tw) AS dot FROM weighed JOIN vectors USING (term) GROUP BY ALL) d JOIN norms USING (unit) JOIN template_norms USING (licence, form)),
best AS (SELECT unit, licence, score FROM scored WHERE score >= {LEAST} QUALIFY row_number() OVER (PARTITION BY unit ORDER BY score DESC, licence) = 1),
by_kind AS (
  SELECT row, kind, arg_min(licence, (-score, licence)) AS own, max(score) AS score, CAST(sum(len(regexp_extract_all(unit, '{WORD}'))) AS BIGINT) AS words
  FROM (SELECT DISTINCT row, kind, unit FROM units) JOIN best USING (unit) GROUP BY row, kind),
own AS (SELECT row, arg_min(own, (-score, own)) AS own, max(score) AS score, max(words) AS notice_words FROM by_kind GROUP BY row),
found AS (
  SELECT d.row, doc_id, path, n_words, coalesce(notice_words, 0) AS notice_words, own, score, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM docs d LEFT JOIN own USING (row)),
stated AS (
  SELECT dir, arg_min(own, (-score, own)) AS stated FROM found
  WHERE own IS NOT NULL AND (notice_words >= {FILE_SHARE}::DOUBLE * n_words OR regexp_matches(lower(path), '{FILE_NAME}')) GROUP BY dir),
ancestors AS (
  SELECT dir, depth, array_to_string(string_split(dir, '/')[1:depth], '/') AS ancestor
  FROM (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS depth FROM (SELECT DISTINCT dir FROM found))),
near AS (SELECT a.dir, arg_max(stated, depth) AS stated, arg_max(ancestor, depth) AS ancestor FROM ancestors a JOIN stated s ON a.ancestor = s.dir GROUP BY a.dir)
SELECT doc_id, path, n_words, notice_words, coalesce(own, stated) AS licence, score,
  CASE WHEN own IS NOT NULL THEN 'notice' WHEN stated IS NOT NULL THEN 'directory:' || ancestor ELSE 'none' END AS origin
FROM found LEFT JOIN near USING (dir)
"""
