"""Licence notices in documents: Dice coefficient over word bigrams against templates.

Native on the main path: only DataFrame functions. Text is normalised to lower-case words of
letters and digits, joined by one space, and cut into pieces at line breaks and at sentence ends
(one of .!?;: before a blank). Candidates are all runs of neighbouring pieces whose size fits a
template, so a notice is found on a line of its own, inside a longer line, as a paragraph, or
wrapped over lines with others directly around it.

For the bags of bigrams A of a candidate and B of a template, Dice = 2 |A n B| / (|A| + |B|). As
|A n B| <= min(|A|, |B|), a candidate can reach t only if t/(2-t) |B| <= |A| <= (2-t)/t |B|, and
only with t/(2-t) |B| bigrams of the template at least. So three steps lose nothing:

1. Of any |B| - t/(2-t) |B| + 1 bigrams of a template, a candidate has one: a text that holds the
   two words of none of these, for no template, is left at once.
2. The others are cut into pieces; their bigrams look up those of the templates, a constant table.
   Only templates that meet enough bigrams in the whole text stay.
3. Runs of pieces that fit such a template in size, and in the number of bigrams met in their
   pieces, are compared exactly.

Of the runs that reach ``dice``, those are given that no run of the same start or the same end beats:
by Dice, then the smaller licence name, then the shorter run, then the earlier one. Null and empty
texts have no candidate. Repeated rows give repeated results. A very long text is more pieces,
each with the runs of at most the largest template's size.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmill.llm.joins import broadcast_if_small
from parchmill.session import cut_lineage

DICE = 0.75

# Notices by which public licences ask to be named.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
}


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def bigrams_of(text: str) -> dict[str, int]:
    """Word bigrams of a template and how often it has them."""
    words = re.findall("[a-z0-9]+", text.lower())
    return dict(Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def normalised(text: Column) -> Column:
    """Lower-case words of letters and digits, joined by one space."""
    return F.trim(F.regexp_replace(F.translate(text, _UPPER, _UPPER.lower()), "[^a-z0-9]+", " "))


def sizes_for(n: int, dice: float) -> tuple[int, int]:
    """Numbers of bigrams with which a candidate can reach ``dice`` against ``n``."""
    low = -(-int(n * dice * 10**9) // int((2 - dice) * 10**9))
    high = int(n * (2 - dice) * 10**9) // int(dice * 10**9)
    return low, high


def pieces(text: Column) -> Column:
    """The lines and sentences of a text that have words, normalised."""
    lowered = F.translate(text, _UPPER, _UPPER.lower())
    parts = F.split(F.regexp_replace(lowered, r"[\r\n]|[.!?;:][ \t]", "\n"), "\n", -1)
    return F.filter(F.transform(parts, normalised), lambda part: part != "")


def marks_of(grams: dict[str, int], dice: float) -> list[list[str]]:
    """Word pairs of which a text that reaches ``dice`` against a template holds one."""
    n = sum(grams.values())
    left, out = n - sizes_for(n, dice)[0] + 1, []
    # Long words first: they are rarer. The order changes the costs only.
    for gram in sorted(grams, key=lambda gram: (-max(map(len, gram.split())), -len(gram), gram)):
        if left > 0:
            out.append(sorted(gram.split(), key=lambda word: (-len(word), word)))
            left -= grams[gram]
    return out


def may_name(text: Column, marks: list[list[str]]) -> Column:
    """Whether a text holds both words of one of ``marks``: as parts of words too, but side by side if
    both are short, as most texts have them somewhere."""
    if not marks:
        return F.lit(False)
    of_word: dict[str, set[str]] = {}
    for rare, other in marks:
        of_word.setdefault(rare, set()).add(other)

    def beside(lowered: Column, rare: str, other: str) -> Column:
        if len(rare) > 3:
            return lowered.contains(other)
        ordered = "|".join(f"{a}[^a-zA-Z0-9]+{b}" for a, b in ((rare, other), (other, rare)))
        return lowered.contains(other) & text.rlike(f"(?i)(?<![a-zA-Z0-9])(?:{ordered})(?![a-zA-Z0-9])")

    def held(lowered: Column) -> Column:
        # Each rare word is looked for once, and what stands beside it only where it is found.
        tests = [
            lowered.contains(rare) & reduce(or_, [beside(lowered, rare, other) for other in sorted(others)])
            for rare, others in of_word.items()
        ]
        return reduce(or_, tests)

    # A lambda, so that a text is lower-cased once for all tests.
    return F.coalesce(F.exists(F.array(F.lower(text)), held), F.lit(False))


def naming(docs: DataFrame, id_column: str, text: str, marks: list[list[str]]) -> DataFrame:
    """(doc_id, pieces) of the texts that may name a licence."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    return rows.where(may_name(F.col("text"), marks)).select("doc_id", pieces(F.col("text")).alias("pieces"))


def pairs(words: Column) -> Column:
    """Bigrams of an array of words, joined by one space."""
    n = F.size(words) - 1
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def scan(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    templates: dict[str, list[str]] | None = None,
    dice: float = DICE,
) -> DataFrame:
    """(doc_id, first_word, n_words, license, dice) of every run of pieces that reaches ``dice``, as
    the module says. Words of a document are numbered from 0. Templates are given as text and
    broadcast: some hundreds at most.
    """
    spark = docs.sparkSession
    named = TEMPLATES if templates is None else templates
    rows, sizes, marks = [], [], []
    for name, texts in sorted(named.items()):
        for grams in filter(None, map(bigrams_of, texts)):
            n = sum(grams.values())
            rows += [(len(sizes), gram, often) for gram, often in grams.items()]
            sizes.append((len(sizes), name, n, *sizes_for(n, dice)))
            marks += marks_of(grams, dice)
    template = F.broadcast(spark.createDataFrame(rows, "template int, gram string, often long"))
    bounds = F.broadcast(spark.createDataFrame(sizes, "template int, license string, size int, low int, high int"))
    most = max((row[4] for row in sizes), default=0)

    # Written once, so that the row numbers are the same wherever they are read.
    kept = cut_lineage(naming(docs, id_column, text, marks).withColumn("row", F.monotonically_increasing_id()))
    # A piece's bigrams are those that begin in it: its words are followed by the first of the next.
    reach = F.zip_with(
        "pieces",
        F.slice("pieces", 2, F.size("pieces")),
        lambda part, following: F.concat_ws(" ", part, F.substring_index(following, " ", 1)),
    )
    words = kept.select("row", F.posexplode(reach).alias("number", "plain"))
    met = words.select("row", "number", F.explode(pairs(F.split("plain", " "))).alias("gram")).join(template, "gram")
    met = cut_lineage(met.groupBy("row", "template", "number").agg(F.count("*").alias("met")))
    enough = met.groupBy("row", "template").agg(F.sum("met").alias("all")).join(bounds, "template").where("all >= low")

    own = Window.partitionBy("row", "template").orderBy("number")
    lengths = kept.select("row", F.transform("pieces", lambda part: F.size(F.split(part, " "))).alias("lengths"))
    fitting = lengths.join(enough.drop("all"), "row").select(
        "row", "template", "license", "size", "low", "high", F.posexplode("lengths").alias("number", "n")
    )
    fitting = fitting.join(met, ["row", "template", "number"], "left").withColumn("met", F.coalesce("met", F.lit(0)))
    fitting = fitting.withColumn("upto", F.sum("met").over(own)).withColumn("end", F.sum("n").over(own))
    ahead = F.collect_list(F.struct("end", "upto")).over(own.rowsBetween(0, most))
    runs = fitting.withColumn("first", F.col("end") - F.col("n")).withColumn("before", F.col("upto") - F.col("met"))
    runs = runs.withColumn("ahead", ahead).select(
        "row", "template", "license", "size", "low", "high", "first", "before", F.explode("ahead").alias("last")
    )
    runs = runs.withColumn("n", F.col("last.end") - F.col("first") - 1)
    can = F.lit(2.0) * (F.col("last.upto") - F.col("before")) >= F.lit(dice) * (F.col("n") + F.col("size")) - 1e-9
    runs = cut_lineage(runs.where(F.col("n").between(F.col("low"), F.col("high")) & can).drop("last"))

    whole = kept.select("row", "doc_id", F.split(F.array_join("pieces", " "), " ").alias("words"))
    part = F.slice("words", F.col("first").cast("int") + 1, F.col("n").cast("int") + 1)
    key = ["row", "doc_id", "first", "n", "template", "license", "size"]
    grams = whole.join(broadcast_if_small(runs, 9), "row").select(*key, F.explode(pairs(part)).alias("gram"))
    counts = grams.groupBy(*key, "gram").count().join(template, ["template", "gram"])
    score = F.lit(2.0) * F.sum(F.least("count", "often")) / (F.col("n") + F.col("size"))
    scores = counts.groupBy(*key).agg(score.alias("dice")).where(F.col("dice") >= dice)
    scores = scores.groupBy("row", "doc_id", "first", "n", "license").agg(F.max("dice").alias("dice"))
    better = [F.desc("dice"), F.col("license"), F.col("n"), F.col("first")]
    of_start = Window.partitionBy("row", "first").orderBy(*better)
    of_end = Window.partitionBy("row", F.col("first") + F.col("n")).orderBy(*better)
    return (
        scores.withColumn("start_place", F.row_number().over(of_start))
        .withColumn("end_place", F.row_number().over(of_end))
        .where("start_place = 1 AND end_place = 1")
        .select("doc_id", F.col("first").alias("first_word"), (F.col("n") + 1).alias("n_words"), "license", "dice")
    )
