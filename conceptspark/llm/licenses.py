"""Licence scans with a positional rare-token index.

Templates are licence notices: short lines and whole headers, of any length.  Each has a
mandatory key phrase.  The index holds the words of a key phrase that are rarest in the
scanned table (their document frequency is counted over all rows), each posting with the
template and the word's place.  A file's rare words are looked up; a word at place i with a
posting at place p votes for "template t starts at i - p".  Where all rare words of a
template vote for one start, the key phrase is checked word by word from there, and the
share of the whole notice that stands in place is the score.

Everything is DataFrame functions, and texts are read once: a row's template words with
their places are stored, and document frequencies, base phrases, votes and checks are
worked out from those, row by row, without a shuffle of rows.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptspark.runtime import others, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases and labels of the base rules.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Label, mandatory key phrase (a stretch of the notice), and the standard wording of licence headers.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License."""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", """Permission is hereby granted, free of charge, to any person obtaining a copy of this
        software and associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list
        of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
        ARE DISCLAIMED."""),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", """Permission to use, copy, modify, and/or distribute this software for any purpose with or
        without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE."""),
    ("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation either version 2", """This program is free software; you can redistribute it and/or modify it
        under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the
        License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details."""),
    ("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation either version 3", """This program is free software: you can redistribute it and/or modify it
        under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the
        License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details."""),
    ("zlib", "altered source versions must be plainly marked as such", """This software is provided 'as-is', without any express or implied warranty. In no event will the
        authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
        following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the
        original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
        original software. This notice may not be removed or altered from any source distribution."""),
    ("unlicense", "free and unencumbered software released into the public domain", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means."""),
)
#: label, notice, mandatory key phrase (a stretch of the notice).
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license", "gnu affero general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("epl-2.0", "eclipse public license v 2 0", "eclipse public license v 2 0"),
    *((label, " ".join(re.findall(WORD, notice.lower())), key) for label, key, notice in NOTICES),
)
#: Rare words that a template is indexed by.
RARE_WORDS = 3
#: Share of a notice's words that must stand in place besides its key phrase.  None: the key
#: phrase decides, and the share is the score alone.
MIN_COVERAGE = 0.0
HIT = "struct<i:int,w:string>"


class Templates:
    """Notices as words, and where in each its key phrase begins."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        self.base = [(phrase.split(), label) for phrase, label in base]
        self.rows = []
        for label, notice, key in templates:
            notice, key = notice.split(), key.split()
            start = next(i for i in range(len(notice)) if notice[i : i + len(key)] == key)
            self.rows.append((label, notice, key, start))
        self.vocabulary = sorted({w for _, notice, _, _ in self.rows for w in notice} | {w for phrase, _ in self.base for w in phrase})

    def index(self, df: dict[str, int], rare_words=RARE_WORDS) -> tuple[dict[str, list[tuple[int, int]]], list[int]]:
        """Postings word -> (template, place in its key phrase) of the words with the highest IDF, and how many each template has."""
        postings: dict[str, list[tuple[int, int]]] = {}
        for t, (_, _, key, _) in enumerate(self.rows):
            for o in sorted(range(len(key)), key=lambda o: (df.get(key[o], 0), o))[:rare_words]:
                postings.setdefault(key[o], []).append((t, o))
        return postings, [min(rare_words, len(key)) for _, _, key, _ in self.rows]

    def constant(self, rows, ddl: str) -> Column:
        return F.from_json(F.lit(json.dumps(rows)), ddl)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def _starts(hits: Column, phrase: list[str]) -> Column:
    """Starts of the places where the words of ``phrase``, all of them vocabulary, stand consecutively.

    Hits are in order and hold every vocabulary word, so such a place is a stretch of hits.
    """

    def here(h, j):
        same = h["w"] == phrase[0]
        for k, w in enumerate(phrase[1:], 1):
            nxt = F.get(hits, j + k)
            same = same & F.coalesce((nxt["w"] == w) & (nxt["i"] == h["i"] + k), F.lit(False))
        return same

    return F.transform(F.filter(hits, here), lambda h: h["i"])


def with_hits(docs: DataFrame, vocabulary: list[str], text="text") -> DataFrame:
    """n_words and ``__hits``, the places of vocabulary words, in place of ``text``."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    found = lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("i"), w.alias("w")))
    both = _let(words, lambda ws: F.struct(F.size(ws).cast("long").alias("n"), F.array_compact(F.transform(ws, found)).alias("hits")))
    rows = docs.select(*others(docs, "n_words", "__hits", "__b", text), both.alias("__b"))
    return rows.select(*others(rows, "__b"), F.col("__b.n").alias("n_words"), F.col("__b.hits").alias("__hits"))


def scan(docs: DataFrame, text="text", templates: Templates | None = None, min_coverage=MIN_COVERAGE) -> DataFrame:
    """Licence labels of every text.

    Adds n_words, n_base (all places of base phrases), first_word, last_word (their
    smallest and largest start), base_labels, labels and score, and leaves out the text.  The
    score is the largest share of an accepted template's words found in place, 1 where a
    base phrase stands.  A null text counts as empty: no words, no labels, score 0.  One row
    comes back for each input row, so repeated rows agree; a very long text is a row like any
    other, worked through in linear time.  An empty table gives an empty one.  Columns of
    these names are replaced.
    """
    templates = templates or Templates()
    made = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    rows = stored(with_hits(docs.select(*others(docs, *(m for m in made if m != text))), templates.vocabulary, text), "licence-hits")
    counted = rows.select(F.explode(F.array_distinct(F.transform("__hits", lambda h: h["w"]))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    postings, needed = templates.index({r["w"]: r["n"] for r in counted.collect()})  # one row a vocabulary word

    hits = F.col("__hits")
    rare = templates.constant({w: [{"t": t, "o": o} for t, o in ps] for w, ps in sorted(postings.items())}, "map<string,array<struct<t:int,o:int>>>")
    need = F.array(*map(F.lit, needed))
    known = templates.constant([{"label": label, "notice": notice, "key": key, "start": start} for label, notice, key, start in templates.rows], "array<struct<label:string,notice:array<string>,key:array<string>,start:int>>")

    # Votes (template, place of the key phrase, its place among the hits) of every rare word.
    places = F.filter(F.transform(hits, lambda h, j: F.when(h["w"].isin(sorted(postings)), F.struct(h["i"].alias("i"), h["w"].alias("w"), j.alias("j")))), lambda x: x.isNotNull())
    votes = F.flatten(F.transform(places, lambda x: F.transform(F.element_at(rare, x["w"]), lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["o"]).alias("at"), (x["j"] - p["o"]).alias("j")))))

    def agreed(ordered):
        def all_there(v, k):
            last = F.get(ordered, k + F.get(need, v["t"]) - 1)
            return F.coalesce((last["t"] == v["t"]) & (last["at"] == v["at"]) & (last["j"] == v["j"]), F.lit(False))

        return F.filter(ordered, all_there)

    def key_stands(v):
        t = F.get(known, v["t"])
        right = F.filter(t["key"], lambda w, x: F.coalesce((F.get(hits, v["j"] + x)["w"] == w) & (F.get(hits, v["j"] + x)["i"] == v["at"] + x), F.lit(False)))
        return F.size(right) == F.size(t["key"])

    def scored(v):
        t = F.get(known, v["t"])
        n = F.size(t["notice"])
        near = F.slice(hits, F.greatest(F.lit(1), v["j"] + 1 - n), 2 * n)
        first = v["at"] - t["start"]
        same = F.filter(near, lambda h: F.coalesce(F.get(t["notice"], h["i"] - first) == h["w"], F.lit(False)))
        return F.struct(t["label"].alias("label"), (F.size(same) / n).alias("share"))

    accepted = F.transform(F.filter(_let(F.array_sort(votes), agreed), key_stands), scored)
    out = rows.withColumn("__more", F.filter(accepted, lambda x: x["share"] >= min_coverage))
    for b, (phrase, _) in enumerate(templates.base):
        out = out.withColumn(f"__p{b}", _starts(hits, phrase))
    places = F.concat(*[F.col(f"__p{b}") for b in range(len(templates.base))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"__p{b}") > 0, F.lit(label)) for b, (_, label) in enumerate(templates.base)]))
    out = out.select(*others(rows, "__hits"), "__more", places.alias("__places"), F.array_sort(F.array_distinct(labels)).alias("__labels"))
    both = F.array_sort(F.array_union("__labels", F.transform("__more", lambda x: x["label"])))
    best = F.coalesce(F.array_max(F.transform("__more", lambda x: x["share"])), F.lit(0.0))
    n = F.size("__places")
    return out.select(
        *others(rows, "__hits"), n.cast("long").alias("n_base"), F.array_min("__places").cast("long").alias("first_word"), F.array_max("__places").cast("long").alias("last_word"),
        F.array_join("__labels", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), F.when(n > 0, F.lit(1.0)).otherwise(best).alias("score"))


def op9_license_scan(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
