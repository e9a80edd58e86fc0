"""Licence scan in DataFrame operations only: windows of a text compared to templates by Dice coefficient over word bigrams.

Templates are notices of one sentence and whole licence texts. Texts and templates are normalised alike: lower case, runs of anything but
letters and digits become one space, line breaks among them, so that wrapping and markup do not matter. A template of n bigrams
(of which |B| are distinct) is compared to windows of n bigrams of the text, wherever in it they lie. Dice = 2 |A and B| / (|A| + |B|) can reach t
only if |A| lies in [|B| t / (2 - t), |B| (2 - t) / t], and only if A and B share at least |B| t / (2 - t) bigrams. From that follow, in this order:

1. a text has at least one of any |B| - ceil(|B| t / (2 - t)) + 1 bigrams of the template (its probes; those of the rarest-looking
   words are taken): texts with no word of a probe are dropped, before any bigram is built;
2. a text must have that many distinct bigrams of the template, in whatever order: templates beyond this bound are dropped for the text;
3. windows start where the bigrams that are shared say: each place of one, less its first place in the template, is a vote; starts
   that at least one in VOTES of the template's bigrams vote for are compared, if the size bound holds.

A match that overlaps a better one (higher Dice, then the longer template, then the one listed first, then the earlier place) is dropped.
"""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.functions.let import let

THRESHOLD = 0.8
VOTES = 20

#: Fixed values: (licence, notice). Notices as they stand in files, in the words that their stewards recommend.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Released under the ISC License."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Proprietary", "All rights reserved."),
)
#: Whole licence texts, without their title and copyright lines.
TEXTS = Path(__file__).parent / "license_texts"
TEMPLATES = (*NOTICES, *((p.stem, p.read_text(encoding="utf-8")) for p in sorted(TEXTS.glob("*.txt"))))


def normalised(text: Column) -> Column:
    """Words of letters and digits, in lower case, with one space between."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams(words: Column) -> Column:
    """Pairs of neighbouring words, in order; none for fewer than two words."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y))
    return F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0)))


def least_shared(n: int, threshold: float) -> int:
    """Of n distinct bigrams, how many a window must share to reach the threshold."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9)


def array_of(strings: list[str]) -> Column:
    """A constant array: one literal, however long."""
    return F.split(F.lit("|".join(strings)), r"\|") if strings else F.array().cast("array<string>")


def license_scan(docs: DataFrame, threshold: float = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id, license_id, dice (of its best match), n_matches (at or over the threshold), one row for each doc_id and licence found.

    Null and empty texts, and texts or templates of fewer than two words, match nothing. Ties between templates go to the one that is listed
    first. Each row is scanned by itself; repeated rows, and all rows of one doc_id, add up their matches, and rows without a doc_id count as one document.
    Other columns are not read. An empty table, or no templates, gives an empty table.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(templates)], "k int, name string, notice string")
    known = known.select("k", "name", bigrams(F.split(normalised(F.col("notice")), " ")).alias("seq")).where(F.size("seq") > 0)
    # The templates are a constant of some KB: read here so that they stand in the plan as literals.
    found = [(r["k"], r["name"], list(r["seq"])) for r in known.orderBy("k").collect()]
    if not found:
        return docs.where(F.lit(False)).select("doc_id", F.lit("").alias("license_id"), F.lit(0.0).alias("dice"), F.lit(0).cast("long").alias("n_matches"))
    words: set[str] = set()
    for *_, seq in found:
        own = sorted(set(seq))
        # The word that a probe is known by: the longer one. Probes with the longest such words look rarest.
        by = {pair: max(pair.split(" "), key=lambda w: (len(w), w)) for pair in own}
        own.sort(key=lambda pair: (-len(by[pair]), by[pair], pair))
        words.update(by[pair] for pair in own[: len(own) - least_shared(len(own), threshold) + 1])
    every = sorted({pair for *_, seq in found for pair in seq})
    distinct = [list(dict.fromkeys(seq)) for *_, seq in found]

    texts = docs.select("doc_id", F.explode(F.array(F.split(normalised(F.col("text")), " "))).alias("_w")).where(F.arrays_overlap("_w", array_of(sorted(words))))
    # Each step comes out of a generator, so that the optimizer has no cause to evaluate a step twice.
    texts = texts.select("doc_id", F.explode(F.array(bigrams(F.col("_w")))).alias("_g"))
    texts = texts.select("doc_id", "_g", F.explode(F.array(F.array_intersect("_g", array_of(every)))).alias("_hits"))
    able = [F.when(F.size("_hits") >= (need := least_shared(len(own), threshold)), F.when(F.size(F.array_intersect("_hits", array_of(own))) >= need, F.lit(i))) for i, own in enumerate(distinct)]
    texts = texts.select("doc_id", "_g", F.explode(F.array(F.array_compact(F.array(*able)))).alias("_able")).where(F.size("_able") > 0)

    def matches(i: int) -> Column:
        own, n = distinct[i], len(found[i][2])
        first = {pair: found[i][2].index(pair) for pair in own}
        places = array_of([str(first[pair]) for pair in own])
        need = max(1, -(-len(own) // VOTES))
        low, high = len(own) * threshold / (2 - threshold), len(own) * (2 - threshold) / threshold

        def start(pair: Column, at: Column) -> Column:
            place = F.array_position(array_of(own), pair)
            return F.when(place > 0, F.greatest(at - F.get(places, place.cast("int") - 1).cast("int"), F.lit(0)))

        def match(s: Column, a: Column) -> Column:
            size = F.size(a)
            dice = F.when(size.between(low, high), 2.0 * F.size(F.array_intersect(a, array_of(own))) / (size + len(own))).otherwise(F.lit(0.0))
            return F.struct(dice.alias("d"), F.lit(n).alias("n"), F.lit(-i).alias("k"), (-s).alias("s"))

        votes = lambda starts: F.array_distinct(F.filter(starts, lambda s, at: F.get(starts, at + need - 1) == s))
        chosen = let(F.array_sort(F.array_compact(F.transform("_g", start))), votes)
        return F.transform(chosen, lambda s: let(F.array_distinct(F.slice("_g", s + 1, n)), lambda a: match(s, a)))

    none = F.array().cast("array<struct<d:double,n:int,k:int,s:int>>")
    every_match = F.flatten(F.array(*(F.when(F.array_contains("_able", i), matches(i)).otherwise(none) for i in range(len(found)))))
    told = texts.select("doc_id", F.explode(F.array(F.filter(every_match, lambda m: m["d"] >= threshold))).alias("_m")).where(F.size("_m") > 0)
    # A match stays if it is the best at each of its places: places and matches are sorted, so that the time is that of a sort however many overlap.
    # There are at most VOTES times as many places as votes, hence as bigrams for each template.
    places = F.flatten(F.transform("_m", lambda m: F.transform(F.sequence(F.lit(0), m["n"] - 1), lambda j: F.struct((j - m["s"]).alias("p"), m.alias("m")))))
    told = told.select("doc_id", F.explode(F.array(F.sort_array(places))).alias("_p"))
    told = told.select("doc_id", F.explode(F.array(F.sort_array(F.transform(F.filter("_p", lambda x, i: ~F.coalesce(F.get("_p", i + 1)["p"] == x["p"], F.lit(False))), lambda x: x["m"])))).alias("_won"))
    best = F.filter("_won", lambda x, i: F.get("_won", i + x["n"] - 1).eqNullSafe(x) & ~F.get("_won", i - 1).eqNullSafe(x))
    name = F.element_at(F.split(F.lit("|".join(name for _, name, _ in found)), r"\|"), 1 - F.col("_x.k"))
    return told.select("doc_id", F.explode(best).alias("_x")).groupBy("doc_id", name.alias("license_id")).agg(F.max("_x.d").alias("dice"), F.count("*").alias("n_matches"))
