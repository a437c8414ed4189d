"""Licence scans: normalised text against licence templates by Dice coefficient over word bigrams.

Units are the whole text, its paragraphs (between blank lines) and its lines. A unit's words are lower-cased runs of
letters and digits. With A the bigrams of a unit, repeats included, and B the set of a template's bigrams, each of
which can be met once, Dice is 2 |A & B| / (|A| + |B|). It can reach the threshold t only if |A|, one less than the
number of words, lies between |B| t / (2 - t) and |B| (2 - t) / t: units outside the bounds of every template go
before any bigram is made, and the others meet only templates whose bounds they satisfy. The templates are constants
of the plan, so nothing is shuffled and a row stands alone.

A notice inside a longer unit, or wrapped over lines, is found by windows over the words of the whole text: those
that begin and end with a bigram of the template, within its size bounds. A text has such a window only if it holds
|B| t / (2 - t) of the template's bigrams, so others are not searched. Where windows of several licences overlap the
best stays. Windows add only licences that no unit matches, each as one more match.

The same bound prunes whole texts first: of each template's bigrams more than |B| - |B| t / (2 - t) hold one of a few
telling words (or are one of a few bigrams), so a text with none of these matches nothing, as a unit or in a window.

A null or empty text has no match. Null ids and repeated rows are kept. Ties go to the first licence in order.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence names and their texts or customary notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved."),
]


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[^0-9a-z]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Sizes of a set of bigrams that can reach the threshold with a template of ``size`` bigrams."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def telling(known: list[list[str]], limits: list[tuple[int, int]]) -> list[str]:
    """Words of six letters and more, long ones first, and bigrams where these do not do: fewer than the least number
    of each template's bigrams are without all of them."""
    chosen: list[str] = []

    def bare(grams: list[str]) -> list[str]:
        return [g for g in grams if g not in chosen and not set(g.split()) & set(chosen)]

    for grams, (least, _) in zip(known, limits, strict=True):
        words = sorted({w for g in grams for w in g.split() if len(w) >= 6}, key=lambda w: (-len(w), w))
        for word in [*words, *sorted(grams, key=lambda g: (-len(g), g))]:
            rest = bare(grams)
            if len(rest) < least:
                break
            if any(word == g or word in g.split() for g in rest):
                chosen.append(word)
    return chosen


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, n_units, n_matches, license, score, licenses): the best match and all licences found, in order."""
    known = [(name, template_bigrams(text)) for name, text in templates]
    limits = [bounds(len(grams), threshold) for _, grams in known]
    least, most = min(lo for lo, _ in limits), max(hi for _, hi in limits)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    folded = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")
    lines = F.split("folded", "\n", -1)
    paragraphs = F.when(F.col("folded").rlike(r"\n *\n"), F.split("folded", r"\n *\n[ \n]*", -1)).otherwise(F.array().cast("array<string>"))

    def one_line(u: Column) -> Column:
        return F.btrim(F.regexp_replace(u, r" *\n[ \n]*", " "), F.lit(" "))

    units = F.concat(F.array(one_line(F.col("folded"))), F.transform(paragraphs, one_line), F.transform(lines, lambda u: F.btrim(u, F.lit(" "))))
    units = F.filter(F.array_distinct(units), lambda u: u != "")
    bigrams = lambda u: F.char_length(u) - F.char_length(F.replace(u, F.lit(" "), F.lit("")))  # noqa: E731  one a blank
    likely = F.filter("units", lambda u: bigrams(u).between(least, most))

    def grams(words: Column) -> Column:
        return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))

    def score(found: Column, i: int) -> Column:
        (lo, hi), own = limits[i], known[i][1]
        shared = F.size(F.array_intersect(found, F.array(*[F.lit(g) for g in own])))
        return F.when(F.size(found).between(lo, hi), F.round(2.0 * shared / (F.size(found) + len(own)), 6)).otherwise(F.lit(0.0))

    def match(found: Column) -> Column:
        return F.array_max(F.array(*[F.struct(score(found, i).alias("score"), F.lit(-i).alias("i"), F.lit(name).alias("license")) for i, (name, _) in enumerate(known)]))

    words = telling([grams for _, grams in known], limits)
    may = F.col("folded").rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(words)})(?![\p{{L}}\p{{N}}])") if words else F.lit(True)

    # Each step binds its result to the next one's variable, so no bigrams are made twice.
    made = F.transform(F.transform(likely, lambda u: F.split(u, " ")), grams)
    found_type = "array<struct<score:double,i:int,license:string>>"
    matches = F.when(F.col("may"), F.filter(F.transform(made, match), lambda m: m["score"] >= threshold)).otherwise(F.array().cast(found_type))

    def search(found: Column, i: int) -> Column:
        (lo, hi), (name, own) = limits[i], known[i]
        hits = F.filter(F.transform(found, lambda g, p: F.struct(p.alias("p"), g.alias("g"))), lambda h: F.array_contains(F.array(*[F.lit(g) for g in own]), h["g"]))

        def ends(h: Column, a: Column, at: Column) -> Column:
            def window(b: Column, n: Column) -> Column:
                shared = F.size(F.array_distinct(F.transform(F.slice(h, at + 1, n + 1), lambda x: x["g"])))
                size = b["p"] - a["p"] + 1
                value = F.when(size.between(lo, hi), F.round(2.0 * shared / (size + len(own)), 6)).otherwise(F.lit(0.0))
                return F.struct(value.alias("score"), F.lit(-i).alias("i"), F.lit(name).alias("license"), a["p"].alias("start"), b["p"].alias("end"))

            return F.filter(F.transform(F.slice(h, at + 1, hi), window), lambda w: w["score"] >= threshold)

        return F.flatten(F.flatten(F.transform(F.array(hits), lambda h: F.transform(h, lambda a, at: ends(h, a, at)))))

    def windows(found: Column) -> Column:
        """Windows of all templates over the bigrams ``found``, without those that overlap a better one of another licence."""
        every = F.array(*[F.lit(g) for g in dict.fromkeys(g for _, own in known for g in own)])
        kind = "array<struct<score:double,i:int,license:string,start:int,end:int>>"

        def of(common: Column) -> Column:
            enough = lambda i: F.size(F.array_intersect(common, F.array(*[F.lit(g) for g in known[i][1]]))) >= limits[i][0]
            return F.flatten(F.array(*[F.when(enough(i), search(found, i).cast(kind)).otherwise(F.array().cast(kind)) for i in range(len(known))]))

        def beaten(w: Column, o: Column) -> Column:
            better = (o["score"] > w["score"]) | ((o["score"] == w["score"]) & (o["i"] > w["i"]))
            return (o["license"] != w["license"]) & (o["start"] <= w["end"]) & (o["end"] >= w["start"]) & better

        best = lambda ws: F.filter(ws, lambda w: ~F.exists(ws, lambda o: beaten(w, o)))
        return F.flatten(F.transform(F.transform(F.array(F.array_intersect(found, every)), of), best))

    window_type = "array<struct<score:double,i:int,license:string,start:int,end:int>>"
    inside = F.flatten(F.transform(F.transform(F.array(F.split(one_line(F.col("folded")), " ")), lambda w: F.when(F.size(w) > 1, grams(w)).otherwise(F.array().cast("array<string>"))), windows))
    other = F.filter("w", lambda w: ~F.array_contains(F.col("m.license"), w["license"]))
    added = F.transform(other, lambda w: F.struct(w["score"].alias("score"), w["i"].alias("i"), w["license"].alias("license")))
    return (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), folded.alias("folded"))
        .select("doc_id", "folded", may.alias("may"))
        .select("doc_id", "may", units.alias("units"), F.when(F.col("may"), inside).otherwise(F.array().cast(window_type)).alias("w"))
        .select("doc_id", F.size("units").cast("long").alias("n_units"), matches.alias("m"), "w")
        .select("doc_id", "n_units", F.size("m").alias("whole"), F.col("m.license").alias("own"), F.concat("m", added).alias("m"))
        .select("doc_id", "n_units", (F.col("whole") + F.size(F.array_except(F.col("m.license"), "own"))).cast("long").alias("n_matches"), F.array_max("m")["license"].alias("license"), F.array_max("m")["score"].alias("score"), F.array_join(F.array_sort(F.array_distinct(F.col("m.license"))), ",").alias("licenses"))
    )


def scan_sql(threshold: float = 0.8, templates: list[tuple[str, str]] = TEMPLATES) -> str:
    """The same in DuckDB SQL over the view ``documents``, comparing every unit with every template of fitting size."""
    rows = ", ".join(f"({i}, '{name}', [{', '.join(repr(g) for g in template_bigrams(text))}])" for i, (name, text) in enumerate(templates))
    return rf"""
WITH known(i, license, grams) AS (VALUES {rows}),
templates AS (SELECT *, len(grams) AS size, CAST(ceil(len(grams) * {threshold} / {2 - threshold} - 1e-9) AS BIGINT) AS lo, CAST(floor(len(grams) * {2 - threshold} / {threshold} + 1e-9) AS BIGINT) AS hi FROM known),
folded AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS f FROM documents),
split AS (SELECT r, doc_id, list_concat([f], string_split(regexp_replace(f, '\n *\n[ \n]*', chr(1), 'g'), chr(1)), string_split(f, chr(10))) AS parts FROM folded),
units AS (SELECT DISTINCT r, doc_id, u FROM (SELECT r, doc_id, trim(regexp_replace(unnest(parts), ' *\n[ \n]*', ' ', 'g'), ' ') AS u FROM split) WHERE u <> ''),
counted AS (SELECT r, count(*) AS n FROM units GROUP BY r),
words AS (SELECT r, u, string_split(u, ' ') AS w FROM units WHERE contains(u, ' ')),
grams AS (SELECT r, u, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) AS g FROM words),
scored AS (SELECT r, u, license, i, round(2.0 * len(list_intersect(list_distinct(grams.g), t.grams)) / (len(grams.g) + len(t.grams)), 6) AS score
  FROM grams JOIN templates t ON len(grams.g) BETWEEN lo AND hi),
best AS (SELECT r, license, i, score FROM scored WHERE score >= {threshold} QUALIFY row_number() OVER (PARTITION BY r, u ORDER BY score DESC, i) = 1),
listed AS (SELECT i, license, size, lo, hi, unnest(grams) AS gram FROM templates),
placed AS (SELECT r, unnest(g) AS gram, generate_subscripts(g, 1) AS p FROM (SELECT f.r, grams.g FROM folded f JOIN grams ON grams.r = f.r AND grams.u = trim(regexp_replace(f.f, ' *\n[ \n]*', ' ', 'g'), ' '))),
hits AS (SELECT r, p, gram, i, license, size, lo, hi FROM placed JOIN listed USING (gram) QUALIFY len(list(DISTINCT gram) OVER (PARTITION BY r, i)) >= lo),
windows AS (SELECT a.r, a.i, a.license, a.size, a.p AS p, b.p AS q FROM hits a JOIN hits b ON a.r = b.r AND a.i = b.i AND b.p - a.p + 1 BETWEEN a.lo AND a.hi),
rated AS (SELECT w.r, w.i, w.license, w.p, w.q, round(2.0 * count(DISTINCT h.gram) / (w.q - w.p + 1 + w.size), 6) AS score
  FROM windows w JOIN hits h ON h.r = w.r AND h.i = w.i AND h.p BETWEEN w.p AND w.q GROUP BY w.r, w.i, w.license, w.size, w.p, w.q),
good AS (SELECT * FROM rated WHERE score >= {threshold}),
inside AS (SELECT DISTINCT r, license, i, score FROM good g WHERE NOT EXISTS (SELECT 1 FROM good o WHERE o.r = g.r AND o.license <> g.license AND o.p <= g.q AND o.q >= g.p AND (o.score > g.score OR o.score = g.score AND o.i < g.i))),
added AS (SELECT * FROM inside n WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.r = n.r AND b.license = n.license)),
every AS (SELECT *, false AS extra FROM best UNION ALL SELECT r, license, i, score, true FROM added),
found AS (SELECT r, count(*) FILTER (NOT extra) + count(DISTINCT license) FILTER (extra) AS n, arg_max(license, score - i * 1e-9) AS license, max(score) AS score, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM every GROUP BY r)
SELECT doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_units, CAST(coalesce(f.n, 0) AS BIGINT) AS n_matches, f.license, f.score, coalesce(f.licenses, '') AS licenses
FROM folded LEFT JOIN counted c USING (r) LEFT JOIN found f USING (r)"""
