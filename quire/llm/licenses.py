"""License scan over a positional rare-token index, with DataFrame functions alone.

The index is a table of postings (word, template, offset) for the RARE words of each template that the fewest
documents hold, by their IDF over all documents; of words in more than COMMON of the documents it has only a
template's LEAST rarest. A file's words are looked up in it; each posting says where the template would start (the
word's position minus its offset), and the postings are intersected by that start: what counts is the greatest IDF
of different words that agree on one. A template whose words agree for at least AGREED of the IDF that the file has
of it, LEAST words or all of them, gives its label if its mandatory key phrase also stands in the file: that is
verified at the phrase's rarest word, whose neighbours travel with it. A file in which no key phrase stands keeps
only its base words, as no template could give a label. The base phrases are found by the intersection of all their
words' positions, so every place counts.

Templates are rows, so more of them cost more postings and no more plan. Rows are told apart by a number written
beside them.

Defined results: null text counts as empty and has no words. Positions count words from 0. Repeated rows are
scanned as often as they come; an empty table gives none; extra columns are not read. Templates without their key
phrase in the file give nothing, whatever agrees.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import broadcast_if_small, stage

RARE, LEAST, AGREED, COMMON = 24, 3, 0.5, 0.05

# The phrases of the contract, with their labels.
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
# Public licence texts and notices (label, key phrase, text).
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge", """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache", "licensed under the apache license", """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""),
    ("gpl", "gnu general public license", """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details. You should have received a copy of the GNU General Public License along with this program."""),
    ("lgpl", "gnu lesser general public license", """
This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option)
any later version."""),
    ("agpl", "gnu affero general public license", """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version."""),
    ("bsd", "redistribution and use in source and binary forms", """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED."""),
    ("isc", "permission to use copy modify and or distribute this software", """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mpl", "mozilla public license", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("epl", "eclipse public license", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("zlib", "altered source versions must be plainly marked", """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the
original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."""),
    ("bsl", "boost software license", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("unlicense", "free and unencumbered software released into the public domain", """
This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means."""),
    ("cc", "creative commons attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0", "cc0 1 0 universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the CC0 1.0 Universal Public Domain Dedication."),
    ("spdx", "spdx license identifier", "SPDX-License-Identifier:"),
)

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words on either side of a key phrase's rarest word that travel with it.
BESIDE = 12


def split(text: str) -> list[str]:
    return [w for w in re.split(_BREAK, text.lower()) if w]


def _words() -> Column:
    # lower() may also fold other letters; none of them yields a letter of a licence word or a break
    return F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), _BREAK), lambda w: w != "")


def document_frequencies(docs: DataFrame, words: list[str]) -> tuple[int, dict[str, int]]:
    """How many documents there are, and how many hold each word; at most one row a word comes back."""
    held = docs.select(F.array_distinct(F.filter(_words(), lambda w: w.isin(words))).alias("held"))
    rows = held.select(F.explode(F.concat(F.array(F.lit("")), "held")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
    df = {r["w"]: r["n"] for r in rows}
    return df.pop("", 0), df


def postings(templates: tuple, n: int, df: dict[str, int], rare: int = RARE) -> list[tuple[str, int, int, float, bool]]:
    """(word, template, offset, idf, anchor) of each template's rarest words; the anchor is the key phrase's rarest word."""
    idf = lambda w: math.log1p((n + 1) / (1 + df.get(w, 0)))
    rows = []
    for k, (_, key, text) in enumerate(templates):
        words = split(text)
        anchor = max(split(key), key=lambda w: (idf(w), w))
        rarest = sorted(set(words), key=lambda w: (-idf(w), w))[:rare]
        chosen = {anchor, *rarest[:LEAST], *(w for w in rarest if df.get(w, 0) <= COMMON * n)}
        rows += [(w, k, at, idf(w), w == anchor) for at, w in enumerate(words) if w in chosen]
    return rows


def hits(docs: DataFrame, words: list[str], anchors: list[str], phrases: list[str]) -> DataFrame:
    """(row, doc_id, n_words, hits): the looked-up words of each text as (w, i), with their neighbours where they anchor a key phrase; without a key phrase only those of the base phrases."""
    split_ = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", _words().alias("words"))

    def hit(w: Column, i: Column) -> Column:
        low = F.greatest(i - BESIDE, F.lit(0))
        beside = F.when(w.isin(anchors), F.array_join(F.slice("words", low + 1, 2 * BESIDE + 1), " "))
        return F.when(w.isin(words), F.struct(w.alias("w"), i.cast("long").alias("i"), beside.alias("beside")))

    def stands(h: Column) -> Column:
        return h["beside"].isNotNull() & F.exists(F.lit([f" {p} " for p in phrases]), lambda p: F.contains(F.concat(F.lit(" "), h["beside"], F.lit(" ")), p))

    found = split_.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.filter(F.transform("words", hit), lambda x: x.isNotNull()).alias("hits"))
    base = sorted({w for p in BASE.values() for w in p.split()})
    return found.withColumn("hits", F.when(F.exists("hits", stands), F.col("hits")).otherwise(F.filter("hits", lambda h: h["w"].isin(base))))


def _starts(word: str, offset: int) -> Column:
    """Where a phrase would start for this word at this offset."""
    return F.transform(F.filter("hits", lambda h: h["w"] == word), lambda h: h["i"] - offset)


def places(phrase: str) -> Column:
    """All starts of a phrase whose words are all looked up."""
    first, *rest = [_starts(w, k) for k, w in enumerate(phrase.split())]
    for more in rest:
        first = F.array_intersect(first, more)
    return F.when(F.size("hits") > 0, first).otherwise(F.array().cast("array<bigint>"))


def matched(found: DataFrame, templates: tuple, index: list[tuple]) -> DataFrame:
    """(row, template, score) of the templates that a text holds."""
    spark = found.sparkSession
    table = broadcast_if_small(spark.createDataFrame(index, "w string, template int, offset int, idf double, anchor boolean"))
    keys = [(k, label, " ".join(split(key)), len({w for w, t, *_ in index if t == k})) for k, (label, key, _) in enumerate(templates)]
    named = broadcast_if_small(spark.createDataFrame(keys, "template int, label string, phrase string, words int"))
    asked = found.where(F.exists("hits", lambda h: h["beside"].isNotNull()))
    looked = asked.select("row", F.explode("hits").alias("h")).select("row", "h.w", "h.i", "h.beside").join(table, "w").join(named, "template")
    stands = F.col("anchor") & F.contains(F.concat(F.lit(" "), "beside", F.lit(" ")), F.concat(F.lit(" "), "phrase", F.lit(" ")))
    votes = looked.select("row", "template", "w", "idf", (F.col("i") - F.col("offset")).alias("start"), F.coalesce(stands, F.lit(False)).alias("key"))
    voted = votes.groupBy("row", "template", "start", "w").agg(F.max("idf").alias("idf"), F.max("key").alias("key"))
    by_start = voted.groupBy("row", "template", "start").agg(F.sum("idf").alias("idf"), F.count(F.lit(1)).alias("agree"), F.max("key").alias("key"))
    best = by_start.groupBy("row", "template").agg(F.max(F.struct("idf", "agree")).alias("best"), F.max("key").alias("key"))
    seen = voted.groupBy("row", "template", "w").agg(F.max("idf").alias("idf")).groupBy("row", "template").agg(F.sum("idf").alias("seen"))
    held = best.where("key").join(seen, ["row", "template"]).join(named, "template").withColumn("score", F.least(F.col("best.idf") / F.col("seen"), F.lit(1.0)))
    return held.where((F.col("score") >= AGREED) & (F.col("best.agree") >= F.least(F.lit(LEAST), "words"))).select("row", "label", "score")


def scan(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """The contract's columns for each row."""
    base_words = {w for p in BASE.values() for w in p.split()}
    every = sorted({w for _, key, text in templates for w in (*split(text), *split(key))})
    index = postings(templates, *document_frequencies(docs, every))
    found = stage(hits(docs, sorted(base_words | {w for w, *_ in index}), sorted({w for w, *_, anchor in index if anchor}), [" ".join(split(key)) for _, key, _ in templates]), "hits")
    label = matched(found, templates, index).groupBy("row").agg(F.array_sort(F.collect_set("label")).alias("more"), F.max("score").alias("best"))
    base = {x: places(phrase).alias(f"p_{x}") for x, phrase in BASE.items()}
    looked = found.select("row", "doc_id", "n_words", *base.values()).join(broadcast_if_small(stage(label, "labels")), "row", "left")
    places_ = F.concat(*[f"p_{x}" for x in BASE])
    base_labels = F.array_compact(F.array(*[F.when(F.size(f"p_{x}") > 0, F.lit(x)) for x in BASE]))
    more = F.coalesce("more", F.array().cast("array<string>"))
    return looked.select(
        "doc_id", "n_words", F.size(places_).cast("long").alias("n_base"), F.array_min(places_).alias("first_word"), F.array_max(places_).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base_labels, more)), ",").alias("labels"),
        F.when(F.size(places_) > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return scan(docs)
