"""License scan by diagonal voting, in DataFrame operations only.

1. Every text becomes words; every ``K`` words in a row are a gram. The rolling grams
   of all texts are joined with the grams of the templates, on hash and words.
2. A hit votes for a diagonal, the offset of the text's place from the template's.
3. Neighbouring diagonals of a document and template merge into a span, so a
   template still collects its votes where a few words were put in or left out.
4. Spans are verified: from each hit on, within the length of one copy (with room
   for the words put in), the template's distinct grams are counted. The best such
   window's share must reach the template's own threshold. A span may be of any
   length and a template of any number of words.

A base phrase stands where one diagonal holds all its grams; windows of the
templates add labels, and base labels stay. The templates are fixed texts, so
their grams are a small table whatever the corpus.

Defined results: a null text counts as empty, gives no words, null places, empty
labels and score 0. Rows that share an id are kept apart by their texts; rows that
repeat entirely get the same result each; equal labels count once. A null id is an
id like any other. Very long texts are scanned whole. An empty table gives no rows.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What separates words.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a gram.
K = 3
#: Diagonals up to this far apart merge: words put in or left out at one place.
NEAR = 3
#: A window is as long as a copy, one part in so many more, and ``NEAR``.
ROOM = 5


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False
    share: float = 1.0


# The base phrases, short names, and the public wordings of licenses and their notices.
TEMPLATES = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
    Template("mit", "the mit license"),
    Template("mit", "licensed under mit"),
    Template("cc-by-nc", "creative commons attribution noncommercial"),
    Template("cc-by-nc", "creative commons attribution non commercial"),
    Template("gpl", "gnu general public license"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl-2", "mozilla public license version 2"),
    Template(
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions:""",
        share=0.6,
    ),
    Template(
        "mit",
        """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
        TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
        OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        share=0.6,
    ),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", share=0.6),
    Template(
        "apache-2",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
        share=0.6,
    ),
    Template("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License""", share=0.6),
    Template(
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
        share=0.6,
    ),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", share=0.6),
    Template(
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
        share=0.7,
    ),
    Template(
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details.""",
        share=0.7,
    ),
    Template(
        "mpl-2",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        share=0.6,
    ),
    Template(
        "cc-by-nc",
        """This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy
        of this license, visit http://creativecommons.org/licenses/by-nc/4.0/""",
        share=0.8,
    ),
    Template(
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means.""",
        share=0.6,
    ),
    Template(
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions:""",
        share=0.6,
    ),
)


def words(text: Column) -> Column:
    """A-Z in lower case, split at everything in ASCII but letters and digits.

    ``lower`` also changes characters beyond ASCII; the two of them that it would
    turn into ASCII letters are replaced by another letter first.
    """
    for c in ("K", "İ"):
        text = F.replace(text, F.lit(c), F.lit("ß"))
    return F.array_remove(F.split(F.lower(text), BREAKS), "")


def template_words(text: str) -> list[str]:
    return re.findall("[0-9a-z]+", text.lower())


def _grams(rows: DataFrame) -> DataFrame:
    """(doc, th, pos, x, y, z): words in a row and the place of the first."""
    shifted = F.arrays_zip(F.col("w").alias("x"), F.expr("slice(w, 2, size(w))").alias("y"), F.expr("slice(w, 3, size(w))").alias("z"))
    return rows.select("doc", "th", F.posexplode(shifted).alias("pos", "g")).select("doc", "th", "pos", "g.*").filter("z is not null")


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    A template has ``K`` words at least.
    """
    spark = docs.sparkSession
    grams = []
    for t, x in enumerate(templates):
        w = template_words(x.text)
        if len(w) < K:
            raise ValueError(f"a template of fewer than {K} words: {x.text!r}")
        grams += [(t, k, *w[k : k + K], len(w) - K + 1) for k in range(len(w) - K + 1)]
    table = spark.createDataFrame(grams, "t int, k int, a string, b string, c string, grams int").withColumn("h", F.xxhash64("a", "b", "c"))
    about = spark.createDataFrame([(t, x.label, x.base, float(x.share)) for t, x in enumerate(templates)], "t int, label string, base boolean, share double")

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc", F.xxhash64("text").alias("th"), words(F.col("text")).alias("w"))
    rolled = _grams(rows).withColumn("h", F.xxhash64("x", "y", "z"))
    same = (rolled.h == table.h) & (rolled.x == table.a) & (rolled.y == table.b) & (rolled.z == table.c)
    hits = rolled.join(F.broadcast(table), same).select("doc", "th", "t", "grams", (F.col("pos") - F.col("k")).alias("diagonal"), "k", "pos").distinct()

    of = ["doc", "th", "t"]
    by, whole = Window.partitionBy(*of).orderBy("diagonal"), Window.partitionBy(*of, "diagonal")
    voted = hits.withColumn("votes", F.count(F.lit(1)).over(whole))
    opened = voted.withColumn("opens", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > NEAR, F.lit(True)).cast("int"))
    spans = opened.withColumn("span", F.sum("opens").over(by))
    room = max(x[-1] for x in grams) * (ROOM + 1) // ROOM + NEAR
    ahead = Window.partitionBy(*of, "span").orderBy("pos").rangeBetween(0, room)
    last = F.col("pos") + F.floor(F.col("grams") * (ROOM + 1) / ROOM) + NEAR
    seen = spans.withColumn("last", last).withColumn("near", F.collect_list(F.struct("pos", "k")).over(ahead))
    held = F.size(F.array_distinct(F.transform(F.filter("near", lambda x: x["pos"] <= F.col("last")), lambda x: x["k"])))
    windows = seen.withColumn("part", held / F.col("grams"))
    judged = windows.join(F.broadcast(about), "t")
    starts = F.col("base") & (F.col("votes") == F.col("grams")) & (F.col("k") == 0)
    fits = ~F.col("base") & (F.col("part") >= F.col("share"))
    found = judged.groupBy("doc", "th").agg(
        F.count(F.when(starts, 1)).alias("n_base"),
        F.min(F.when(starts, F.col("pos"))).cast("long").alias("first_word"),
        F.max(F.when(starts, F.col("pos"))).cast("long").alias("last_word"),
        F.collect_set(F.when(starts, F.col("label"))).alias("of_base"),
        F.collect_set(F.when(starts | fits, F.col("label"))).alias("of_all"),
        F.max("part").alias("score"),
    )
    left = rows.select(F.col("doc").alias("doc_id"), F.col("th").alias("own"), F.size("w").cast("long").alias("n_words"))
    both = left.join(found, left.doc_id.eqNullSafe(found.doc) & (left.own == found.th), "left")
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return both.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        joined("of_base").alias("base_labels"), joined("of_all").alias("labels"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"),
    )
