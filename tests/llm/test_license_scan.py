from __future__ import annotations

import itertools
import re
from collections import Counter

import pytest

from parchmill.llm import license_scan as scan


def dice(a, b):
    a, b = Counter(scan.bigrams_of(a)), Counter(scan.bigrams_of(b))
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


@pytest.mark.parametrize("n", [1, 2, 5, 8, 33, 100])
def test_size_bounds_lose_nothing(n):
    low, high = scan.sizes_for(n, 0.75)
    for size in range(1, 4 * n + 4):
        assert (2 * min(size, n) / (size + n) >= 0.75) == (low <= size <= high)


def brute(texts):
    """Every run of pieces against every template."""
    found = []
    for i, text in enumerate(texts):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        parts = [re.findall("[a-z0-9]+", part) for part in re.split(r"[\r\n]|[.!?;:][ \t]", lowered)]
        parts, runs = [part for part in parts if part], []
        ends = list(itertools.accumulate(map(len, parts), initial=0))
        for a, b in itertools.combinations(range(len(ends)), 2):
            if ends[b] - ends[a] <= 400:
                words = " ".join(sum(parts[a:b], []))
                score, name = min((-dice(words, t), name) for name, own in scan.TEMPLATES.items() for t in own)
                if -score >= scan.DICE:
                    runs.append((score, name, ends[b] - ends[a], ends[a]))
        for run in runs:
            rivals = [r for r in runs if r[3] == run[3]], [r for r in runs if r[2] + r[3] == run[2] + run[3]]
            if run == min(rivals[0]) == min(rivals[1]):
                found.append((i, run[3], run[2], run[1], round(-run[0], 9)))
    return sorted(found)


def test_every_run_of_pieces(spark):
    mit, gpl = scan.TEMPLATES["MIT"][2], scan.TEMPLATES["GPL-3.0"][1]
    texts = [
        "x\nLicensed under the apache license version 2.0\nLICENSED UNDER CC BY-NC 4.0!\nabout cats",
        "Intro line\n\n" + mit.replace(", ", ",\n") + "\n\nend",
        "import os\r\n# " + gpl.replace(" it ", " it\r\n# ") + "\r\nrun(os)",
        "This is a text about cats. Licensed under CC BY 4.0. More of cats follows on the very same line.",
        None, "", " \r\n", "Released under the MIT License.", "Released under the MIT License.", "word " * 20_000,
        "a license of mine\n" * 50, "\u00c9t\u00e9: licensed under \u212bpache\nlicensed\nunder\nthe\nMIT\nlicense",
    ]
    docs = spark.createDataFrame([(i, text, "k", i) for i, text in enumerate(texts)], "doc_id long, text string, pieces string, row int")
    got = sorted((r.doc_id, r.first_word, r.n_words, r.license, round(r.dice, 9)) for r in scan.scan(docs).collect())
    assert got == brute(texts)
    assert {(row[0], row[3]) for row in got} >= {(0, "Apache-2.0"), (1, "MIT"), (2, "GPL-3.0"), (3, "CC-BY-4.0"), (7, "MIT"), (8, "MIT")}
    assert scan.scan(docs.limit(0)).collect() == [] and scan.scan(docs, templates={}).collect() == []


def test_marks_lose_nothing():
    for texts in scan.TEMPLATES.values():
        for grams in map(scan.bigrams_of, texts):
            n = sum(grams.values())
            marked = {frozenset(pair) for pair in scan.marks_of(grams, scan.DICE)}
            rest = sum(often for gram, often in grams.items() if frozenset(gram.split()) not in marked)
            assert rest < scan.sizes_for(n, scan.DICE)[0]


def test_native(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marks = scan.marks_of(scan.bigrams_of("Released under the MIT License."), scan.DICE)
    first, rest = scan.naming(docs, "doc_id", "text", marks), scan.scan(docs)
    for df in (first, rest):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [word for word in ("Python", "Arrow", "Cartesian", "NestedLoop") if word in plan]
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan
