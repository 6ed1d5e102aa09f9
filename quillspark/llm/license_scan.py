"""License scans by diagonal voting, in DataFrame functions only.

Every run of three words of a text is hashed and joined to the positions of the same run in license templates. A hit
of text position p and template position q votes for the diagonal p - q: words that are copied in order all vote for
one diagonal, and an inserted or lost word moves the rest of the copy to a neighbouring one. Votes are summed by
diagonal, diagonals within ``SHIFT`` of each other are merged, and a merged span is verified: the share of the
template's words that lie in its hits (words, not hashes, decide) must reach what the template asks for.

Scaling. The templates are a constant of the library, about a thousand positions, and are broadcast; texts are read
and cut into words where they lie, and only hits are shuffled, by document, template and diagonal, summed map-side.
Rows that are equal in id and text share their hits. A window holds the diagonals of one text and one template.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a run, and how far apart neighbouring diagonals of a text lie.
K, SHIFT = 3, 8
#: Share of a text's words that must be found; phrases and notices must be found whole.
LEAST = 0.8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The phrases of the contract and their labels.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
#: Names by which licenses are referred to.
NOTICES = [
    ("mit", "the mit license"),
    ("mit", "spdx license identifier mit"),
    ("apache-2", "spdx license identifier apache 2 0"),
    ("gpl-3", "gnu general public license version 3"),
    ("gpl-3", "gnu general public license as published by the free software foundation either version 3"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-2", "gnu general public license as published by the free software foundation either version 2"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl-2", "mozilla public license version 2 0"),
    ("epl", "eclipse public license"),
    ("bsl-1", "boost software license"),
    ("bsd-2", "bsd 2 clause license"),
    ("bsd-3", "bsd 3 clause license"),
    ("cc0", "cc0 1 0 universal"),
    ("cc-by", "creative commons attribution 4 0 international"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-nc", "creative commons attribution non commercial"),
]
#: Public license texts and headers without their copyright lines.
TEXTS = [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "apache-2",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        '"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
        "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
        "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "bsd-3",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH '
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You "
        "can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
]
#: (number, kind, label, text, least share, whether neighbouring diagonals are merged)
TEMPLATES = [
    (i, kind, label, text, 1.0 if kind != "text" else LEAST, kind == "text")
    for i, (kind, label, text) in enumerate([(kind, *x) for kind, group in (("phrase", PHRASES), ("notice", NOTICES), ("text", TEXTS)) for x in group])
]


def words(text: Column) -> Column:
    """Words of letters, digits and characters beyond ASCII, A to Z in lower case; null: none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda x: x != "")


def runs(rows: DataFrame, column: str, at: str, run: str) -> DataFrame:
    """rows, without the array ``column``, for each position ``at`` of its runs of K words; ``run`` is the words."""
    rest = [c for c in rows.columns if c != column]
    joined = lambda x, i: F.concat_ws(" ", x, *[F.get(column, i + j) for j in range(1, K)])
    starts = F.slice(column, 1, F.greatest(F.size(column) - (K - 1), F.lit(0)))
    return rows.select(*rest, F.posexplode(F.transform(starts, joined)).alias(at, run))


def templates(spark: SparkSession, rows: list[tuple] = TEMPLATES) -> DataFrame:
    """(t, kind, label, least, merge, ws): the templates as words."""
    kind = "array<struct<t: int, kind: string, label: string, text: string, least: double, merge: boolean>>"
    data = json.dumps([dict(zip(("t", "kind", "label", "text", "least", "merge"), r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(data), kind))).withColumn("ws", words(F.col("text"))).drop("text")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A key of id and text: rows that share it have the same result."""
    return F.md5(F.concat_ws("\x00", F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))))


def diagonals(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(key, t, d, qs): template positions hit on each diagonal; texts: (key, ws)."""
    there = runs(known.select("t", "ws"), "ws", "q", "known").select("t", "q", "known", F.xxhash64("known").alias("h"))
    asked = runs(texts.select("key", "ws"), "ws", "p", "run").withColumn("h", F.xxhash64("run"))
    hits = asked.join(F.broadcast(there), "h").where("run = known")  # the templates' positions: a constant of the library
    return hits.groupBy("key", "t", (F.col("p") - F.col("q")).alias("d")).agg(F.collect_set("q").alias("qs"))


def verified(found: DataFrame, known: DataFrame) -> DataFrame:
    """(key, t, kind, label, d, first_word, last_word, share, accepted): each diagonal with its neighbours merged.

    share: of the template's words, those that lie in a run that was hit. Of the diagonals that are merged with each
    other, the one with the largest share stands for all, ties to the smaller one; its span is that of its hits.
    """
    facts = F.broadcast(known.select("t", "kind", "label", "least", "merge", F.size("ws").alias("m")))  # a row for each template
    near = Window.partitionBy("key", "t").orderBy("d").rangeBetween(-SHIFT, SHIFT)
    around = found.join(facts, "t").withColumn("near", F.collect_list(F.struct("d", "qs")).over(near))
    merged = around.withColumn("near", F.when(F.col("merge"), F.col("near")).otherwise(F.array(F.struct("d", "qs"))))
    places = F.array_distinct(F.flatten(F.transform("near", lambda x: F.flatten(F.transform(x["qs"], lambda q: F.sequence(q, q + (K - 1)))))))
    spans = merged.withColumns(
        {
            "share": F.size(places) / F.col("m"),
            "first_word": F.array_min(F.transform("near", lambda x: x["d"] + F.array_min(x["qs"]))),
            "last_word": F.array_max(F.transform("near", lambda x: x["d"] + F.array_max(x["qs"]))) + (K - 1),
        }
    )
    best = spans.withColumn("best", F.max(F.struct("share", -F.col("d"))).over(near))
    one = best.where(~F.col("merge") | (F.struct("share", -F.col("d")) == F.col("best")))
    return one.select("key", "t", "kind", "label", "d", "first_word", "last_word", "share", (F.col("share") >= F.col("least")).alias("accepted"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: list[tuple] = TEMPLATES) -> DataFrame:
    """(id, template, kind, label, first_word, last_word, share) of every accepted span, words counted from 0. Rows
    equal in id and text give their spans once; null and empty texts none; a null id is kept."""
    known = templates(docs.sparkSession, rows)
    texts = docs.select(F.struct(F.col(id_col).alias("id"), keyed(docs, id_col, text_col).alias("same")).alias("key"), words(F.col(text_col)).alias("ws"))
    found = verified(diagonals(texts, known), known).where("accepted")
    return found.select(F.col("key.id").alias(id_col), F.col("t").alias("template"), "kind", "label", "first_word", "last_word", "share")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "__license", rows: list[tuple] = TEMPLATES) -> DataFrame:
    """docs with a struct: n_words, n_base (places of the base phrases), first_word and last_word (their smallest and
    largest start, else null), base_labels, labels (those of all templates too; sorted, joined by commas) and score, the
    largest verified share of any template (1 where one is whole, 0 without a hit).

    Null and empty texts: no words, no labels, score 0. Null ids, repeated ids and repeated rows keep a row each; only
    the text decides. Texts of any length are scanned whole. Other columns are carried along; empty table: no rows.
    """
    known = templates(docs.sparkSession, rows)
    own = docs.select("*", keyed(docs, id_col, text_col).alias("__key"))
    found = verified(diagonals(own.select(F.col("__key").alias("key"), words(F.col(text_col)).alias("ws")), known), known)
    base, start = F.col("accepted") & (F.col("kind") == "phrase"), F.col("d").cast("long")
    joined = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    each = found.groupBy(F.col("key").alias("__key")).agg(
        F.struct(
            F.count_if(base).alias("n_base"), F.min(F.when(base, start)).alias("first_word"), F.max(F.when(base, start)).alias("last_word"),
            joined(base).alias("base_labels"), joined(F.col("accepted")).alias("labels"), F.max("share").alias("score"),
        ).alias("__found")
    )
    all_ = own.withColumn("__n", F.size(words(F.col(text_col))).cast("long")).join(each, "__key", "left")
    or_ = lambda c, value: F.coalesce(F.col(f"__found.{c}"), F.lit(value)).alias(c)
    facts = F.struct(F.col("__n").alias("n_words"), F.coalesce("__found.n_base", F.lit(0).cast("long")).alias("n_base"), "__found.first_word", "__found.last_word", or_("base_labels", ""), or_("labels", ""), or_("score", 0.0))
    return all_.select(*docs.columns, facts.alias(out))
