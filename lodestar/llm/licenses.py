r"""License scan by diagonal voting, in DataFrame operations only.

Every rolling ``K``-word hash of every document is joined with the template
positions of the same hash.  Hits vote for the diagonal (document position
minus template position); neighbouring diagonals, as an inserted or a lost
word makes them, are merged; a merged span is verified by the template words
that its hits cover, as a share of the template or of the span's own extent
in the document, whichever is longer, so that scattered words are no license.
Texts that differ in a word or two, as the GPL's relatives do, match each
other's templates as well: of verified spans with different labels over the
same words (``SAME`` of the longer one) only the best covered give labels.
The templates are a fixed table, so their side of the join is broadcast.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.  Defined
results: null or empty text has no words and score 0; texts are scanned
whole, however long; of equally good spans each counts once per label;
repeated rows get equal results; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3
#: Diagonals this near belong to one span, and no more than a quarter of the template apart.
SLACK = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of a template's words, and of its own extent, that a verified span covers.
COVERED = 0.75
#: Share of the longer of two spans that both have for them to be readings of one text.
SAME = 0.8

# fixed values: public license texts and notices
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("reserved", "All rights reserved"),
    # whole texts
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
)


def template_words() -> list[tuple[int, str, list[str]]]:
    return [(i, label, re.findall(WORD, text.lower())) for i, (label, text) in enumerate(TEMPLATES)]


def _templates(spark: SparkSession) -> DataFrame:
    """(template, label, n_template, template_at, gram): a row for every position."""
    rows = [(i, label, len(w), at, w[at : at + K]) for i, label, w in template_words() for at in range(len(w) - K + 1)]
    frame = spark.createDataFrame(rows, "template int, label string, n_template int, template_at int, words array<string>")
    return frame.withColumn("gram", F.xxhash64(*(F.col("words")[j] for j in range(K)))).drop("words")


def _words(docs: DataFrame) -> DataFrame:
    """``docs`` with the words; splitting is cheaper than matching and leaves empty ends to cut off."""
    split = docs.withColumn("scan_split", F.split(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER), BETWEEN))
    n = F.size("scan_split")
    head = (F.get("scan_split", F.lit(0)) == "").cast("int")
    tail = ((n > 1) & (F.get("scan_split", n - 1) == "")).cast("int")
    return split.withColumn("scan_words", F.slice("scan_split", 1 + head, n - head - tail)).drop("scan_split")


def _phrases(docs: DataFrame) -> DataFrame:
    """``docs`` with the places where a base phrase stands and the labels they give."""
    word = lambda i: F.get("scan_words", i)
    ends = F.filter(F.transform("scan_words", lambda w, i: F.when(w == "license", i)), lambda i: i.isNotNull())
    label = lambda i: (
        F.when(word(i - 1) == "mit", "mit").when(word(i - 1) == "apache", "apache").when((word(i - 1) == "public") & (word(i - 2) == "general"), "gpl")
    )
    found = docs.withColumn("scan_ends", ends)
    found = found.withColumn("scan_places", F.filter(F.transform("scan_ends", lambda i: F.struct(label(i).alias("label"), i.alias("end"))), lambda p: p["label"].isNotNull()))
    start = lambda p: p["end"] - F.when(p["label"] == "gpl", 2).otherwise(1)
    return found.withColumns(
        {
            "n_words": F.size("scan_words").cast("long"),
            "n_base": F.size("scan_places").cast("long"),
            "first_word": F.array_min(F.transform("scan_places", start)).cast("long"),
            "last_word": F.array_max(F.transform("scan_places", start)).cast("long"),
            "base_set": F.array_sort(F.array_distinct(F.transform("scan_places", lambda p: p["label"]))),
        }
    ).drop("scan_ends", "scan_places", "scan_words")


def _slack(n_template: Column) -> Column:
    return F.least(F.lit(SLACK), F.floor(n_template / 4))


def license_spans(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Merged diagonals: keys, template, label, first and last word, coverage."""
    # positions are exploded and hashed after, all in one stage of generated code
    n = F.size("scan_words")
    at = F.explode(F.when(n >= K, F.sequence(F.lit(0), n - K)))
    rolled = _words(docs).select(*keys, "scan_words", at.alias("at")).select(*keys, "at", F.xxhash64(*(F.get("scan_words", F.col("at") + j) for j in range(K))).alias("gram"))
    hits = rolled.join(F.broadcast(_templates(docs.sparkSession)), "gram").select(*keys, "template", "label", "n_template", "template_at", "at", (F.col("at") - F.col("template_at")).alias("diagonal"))
    by_diagonal = hits.groupBy(*keys, "template", "label", "n_template", "diagonal").agg(F.collect_set("template_at").alias("votes"), F.min("at").alias("first"), F.max("at").alias("last"))
    along = W.partitionBy(*keys, "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > _slack(F.col("n_template")), F.lit(False)).cast("int")
    grouped = by_diagonal.withColumn("apart", apart).withColumn("span", F.sum("apart").over(along))
    merged = grouped.groupBy(*keys, "template", "label", "n_template", "span").agg(F.flatten(F.collect_list("votes")).alias("votes"), F.min("first").alias("first_at"), (F.max("last") + K - 1).alias("last_at"))
    words = F.array_distinct(F.flatten(F.transform("votes", lambda p: F.sequence(p, p + (K - 1)))))
    extent = F.col("last_at") - F.col("first_at") + 1
    return merged.select(*keys, "template", "label", "first_at", "last_at", (F.size(words) / F.greatest("n_template", extent)).alias("coverage"))


def best_read(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, coverage, found): the best coverage of a document, and the labels of its verified spans that no better covered one of another label reads over the same words.

    Verified spans that overlap in a row are one cluster; a cluster ends where
    a span starts after all before it have ended.
    """
    along = W.partitionBy(*keys).orderBy("first_at", "last_at", "template")
    verified = F.col("coverage") >= COVERED
    until = F.max(F.when(verified, F.col("last_at"))).over(along.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.withColumn("apart", F.coalesce(verified & (F.col("first_at") > until), F.lit(False)).cast("int"))
    clustered = marked.withColumn("cluster", F.sum("apart").over(along))
    span = F.when(verified, F.struct("label", "first_at", "last_at", "coverage"))
    gathered = clustered.groupBy(*keys, "cluster").agg(F.max("coverage").alias("coverage"), F.collect_list(span).alias("spans"))
    size = lambda s: s["last_at"] - s["first_at"] + 1
    shared = lambda s, t: F.least(s["last_at"], t["last_at"]) - F.greatest(s["first_at"], t["first_at"]) + 1
    beaten = lambda s: F.exists("spans", lambda t: (t["label"] != s["label"]) & (t["coverage"] > s["coverage"]) & (shared(s, t) >= SAME * F.greatest(size(s), size(t))))
    labels = F.array_distinct(F.transform(F.filter("spans", lambda s: ~beaten(s)), lambda s: s["label"]))
    read = gathered.select(*keys, "coverage", labels.alias("labels"))
    return read.groupBy(*keys).agg(F.max("coverage").alias("coverage"), F.array_distinct(F.flatten(F.collect_set("labels"))).alias("found"))


def license_table(docs: DataFrame) -> DataFrame:
    """Each document's base phrases, its labels, and the score of its best span."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("scan_key", F.xxhash64("doc_id", "text"))
    keyed = keyed.withColumn("scan_id", F.coalesce("doc_id", F.lit(-1)))
    keys = ["scan_id", "scan_key"]
    spans = license_spans(keyed, keys)
    found = best_read(spans, keys)
    base = _phrases(_words(keyed)).drop("text")
    both = base.join(found, keys, "left")
    none = F.expr("cast(array() as array<string>)")
    return both.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_set", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_set", F.coalesce("found", none))), ",").alias("labels"),
        F.round(F.greatest(F.coalesce("coverage", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)), 6).alias("score"),
    )


def oracle_sql() -> str:
    grams = ", ".join(f"({i}, '{label}', {len(w)}, {at}, '{' '.join(w[at : at + K])}')" for i, label, w in template_words() for at in range(len(w) - K + 1))
    return rf"""
WITH templates(template, label, n_template, template_at, gram) AS (VALUES {grams}),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), seqs AS (
  SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d
), grams AS (
  SELECT rid, i, word, lead(word, 1) OVER o AS second, lead(word, 2) OVER o AS third FROM seqs WINDOW o AS (PARTITION BY rid ORDER BY i)
), places AS (
  SELECT rid, i, CASE WHEN word = 'general' AND second = 'public' AND third = 'license' THEN 'gpl' WHEN word IN ('mit', 'apache') AND second = 'license' THEN word END AS label FROM grams
), base AS (
  SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places WHERE label IS NOT NULL GROUP BY rid
), hits AS (
  SELECT rid, i, template, label, n_template, template_at, i - template_at AS diagonal FROM grams JOIN templates ON gram = word || ' ' || second || ' ' || third
), marked AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal, template_at) > least({SLACK}, n_template // 4) THEN 1 ELSE 0 END AS apart FROM hits
), spanned AS (
  SELECT *, sum(apart) OVER (PARTITION BY rid, template ORDER BY diagonal, template_at ROWS UNBOUNDED PRECEDING) AS span FROM marked
), covered AS (
  SELECT rid, template, label, span, min(i) AS a, max(i) + {K} AS b, count(DISTINCT template_at + j) / greatest(n_template, max(i) - min(i) + {K}) AS coverage FROM spanned, (SELECT unnest(range(0, {K})) AS j) GROUP BY rid, template, label, n_template, span
), found AS (
  SELECT rid, max(coverage) AS coverage FROM covered GROUP BY rid
), labelled AS (
  SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (
    SELECT rid, label FROM covered s WHERE coverage >= {COVERED} AND NOT EXISTS (SELECT 1 FROM covered t WHERE t.rid = s.rid AND t.label <> s.label AND t.coverage > s.coverage
      AND least(s.b, t.b) - greatest(s.a, t.a) >= {SAME}::DOUBLE * greatest(s.b - s.a, t.b - t.a)) UNION SELECT rid, label FROM places WHERE label IS NOT NULL) GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  round(greatest(coalesce(coverage, 0.0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END), 6) AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN found USING (rid) LEFT JOIN labelled USING (rid)
"""
