"""License scans: normalised lines and whole texts against licence templates by the Dice coefficient over word bigrams (DataFrame functions only).

A unit is a line of a document, a paragraph of it, or its whole text. Its set of word bigrams A matches a template with set B if
2 |A n B| / (|A| + |B|) >= t. Then |A n B| >= t / (2 - t) * |A|, so a unit of whose bigrams a smaller share is in the
vocabulary of all templates is dropped without loss before any join, and only templates with
t / (2 - t) * |A| <= |B| <= (2 - t) / t * |A| are candidates.

Normalising: lower case; everything but letters, digits and dots becomes a space; dots at a word's end go.

Defined cases: null, blank and one-word units have no bigrams and match nothing; ties of a unit go to the first template
id; rows that repeat a doc_id, or have none, are documents of their own, each with its units; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import let

#: Usual notices and short licence texts, by an identifier of the licence.
TEMPLATES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("All-Rights-Reserved", "All rights reserved."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
THRESHOLD = 0.8
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
)
#: Whole paragraphs and texts; the SQL has TEMPLATES only.
WHOLE = [("MIT", _MIT[0]), ("MIT", " ".join(_MIT)), ("Apache-2.0", _APACHE[1]), ("Apache-2.0", " ".join(_APACHE))]


def normal_words(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.]+", " ")
    return F.split(F.trim(F.regexp_replace(plain, r"\.+( |$)", " ")), " +")


def bigrams(w: str) -> Column:
    """Distinct bigrams of the words in column w."""
    return F.array_distinct(F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1))))


def template_bigrams(spark, templates: list[tuple[str, str]]) -> DataFrame:
    """template, license, grams (their number), bigram."""
    t = spark.createDataFrame([(i, k, x) for i, (k, x) in enumerate(templates)], "template int, license string, text string")
    t = let(let(t, "w", normal_words(F.col("text"))), "b", bigrams("w"))
    return t.select("template", "license", F.size("b").alias("grams"), F.explode("b").alias("bigram"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES + WHOLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, unit (line number from 1; 0: the whole text; -k: the paragraph k of several lines), template, license, dice: each matching unit's best template. templates is a short list and is broadcast."""
    ratio = threshold / (2 - threshold)
    known = template_bigrams(docs.sparkSession, templates)
    rows = known.collect()  # a parameter's bigrams, not the documents'
    vocabulary = F.array(*[F.lit(b) for b in sorted({r["bigram"] for r in rows})])
    most = max([r["grams"] for r in rows], default=0) / ratio
    text = F.coalesce("text", F.lit(""))
    # row tells rows apart; lines, texts and paragraphs may number them differently, as their units differ
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    lines = docs.select("row", "doc_id", F.posexplode(F.split(text, "\n")).alias("unit", "line")).select("row", "doc_id", (F.col("unit") + 1).alias("unit"), "line")
    # a whole text of one line is that line
    whole = docs.where(F.contains(text, F.lit("\n"))).select("row", "doc_id", F.lit(0).alias("unit"), text.alias("line"))
    # a unit within the size bound has few distinct words, but any number of repeated ones; so only sets are bounded
    # paragraphs end at lines without letters and digits; one of one line, or that is the whole text, is a unit already
    blocks = F.split(text, r"\n([^\p{L}\p{N}\n]*\n)+")
    blocks = docs.where(text.rlike(r"\n[^\p{L}\p{N}\n]*\n")).select("row", "doc_id", F.posexplode(blocks).alias("at", "line")).where(F.contains(F.trim("line", F.lit("\n")), F.lit("\n")))
    blocks = blocks.select("row", "doc_id", (-F.col("at") - 1).alias("unit"), "line")
    units = lines.unionByName(whole).unionByName(blocks).where(F.length("line") > 2)
    units = let(let(units, "w", normal_words(F.col("line"))), "b", bigrams("w")).select("row", "doc_id", "unit", "b")
    units = units.withColumn("n", F.size("b")).where((F.col("n") > 0) & (F.col("n") <= most)).where(F.size(F.array_intersect("b", vocabulary)) >= F.ceil(F.col("n") * ratio - 1e-9))
    pairs = units.select("row", "doc_id", "unit", "n", F.explode("b").alias("bigram")).join(F.broadcast(known), "bigram").where((F.col("grams") >= F.col("n") * ratio - 1e-9) & (F.col("grams") <= F.col("n") / ratio + 1e-9))
    both = pairs.groupBy("row", "doc_id", "unit", "n", "template", "license", "grams").agg(F.count("*").alias("both"))
    dice = both.withColumn("dice", 2.0 * F.col("both") / (F.col("n") + F.col("grams"))).where(F.col("dice") >= threshold)
    best = dice.groupBy("row", "doc_id", "unit").agg(F.max_by(F.struct("template", "license", "dice"), F.struct("dice", -F.col("template"))).alias("m"))
    return best.select("doc_id", "unit", "m.*")


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.groupBy("doc_id", "license").agg(F.count("*").alias("n_units"), F.round(F.max("dice"), 6).alias("dice"))


def _sql() -> str:
    values = ", ".join(f"({i}, '{k}', '{t.replace(chr(39), chr(39) * 2)}')" for i, (k, t) in enumerate(TEMPLATES))
    norm = lambda c: f"string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}.]+', ' ', 'g'), '\\.+( |$)', ' ', 'g'), ' +', ' ', 'g')), ' ')"
    grams = lambda w: f"list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    return f"""
with t0 as (select * from (values {values}) v(template, license, text)),
t as (select template, license, {grams('w')} b from (select *, {norm('text')} w from t0)),
u0 as (select row_number() over () r, doc_id, string_split(coalesce(text, ''), chr(10)) ls, text from documents),
u1 as (select r, doc_id, unnest(range(1, len(ls) + 1)) unit, unnest(ls) line from u0
  union all select r, doc_id, 0, text from u0 where contains(text, chr(10))),
u as (select r, doc_id, unit, {grams('w')} b from (select *, {norm('line')} w from u1)),
p as (select r, doc_id, unit, template, license, 2.0 * len(list_intersect(u.b, t.b)) / (len(u.b) + len(t.b)) dice from u join t on list_has_any(u.b, t.b)),
k as (select *, row_number() over (partition by r, unit order by dice desc, template) k from p where dice >= {THRESHOLD})
select doc_id, license, count(*) n_units, round(cast(max(dice) as double), 6) dice from k where k = 1 group by doc_id, license"""


ORACLE = _sql()
