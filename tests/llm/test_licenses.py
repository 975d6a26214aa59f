import re

from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from shellac.llm import licenses, queries
from shellac.llm.license_rules import BASE, default_rules

RULES = default_rules()


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(text, rules=RULES):
    w = words_of(text)
    places, base = [], set()
    for phrase, label in BASE:
        p = phrase.split(" ")
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    found = []
    for i, x in enumerate(w):
        for r in rules:
            if x in r.keywords and (m := re.match(r.pattern, " ".join(w[i : i + licenses.REACH]))):
                found.append((i, i + len(m[0].split(" ")), r.label, r.rank, r.strength))
    kept = [d for d in found if not any(e[3] < d[3] and e[0] <= d[0] and e[1] >= d[1] for e in found)]
    return {
        "n_words": len(w), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | {d[2] for d in kept})), "score": max([d[4] for d in kept] + [0.7] * bool(base), default=0.0), "detections": sorted(d[:4] for d in kept),
    }


def scanned(spark, texts):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id long, text string, labels string")
    out = []
    for r in licenses.scan(df).orderBy("id").collect():
        d = r.asDict()
        out.append({k: d[k] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")} | {"detections": sorted((x["start"], x["end"], x["label"], x["rank"]) for x in r["detections"])})
    return out


TEXTS = [
    None, "", "  ...  ", "Licensed under the Apache License, Version 2.0.", "GNU General Public License v3 or later", "gnu general public LICENSE gnu general public license", "CC BY-NC 4.0; cc by cc by", "the MIT license",
    "mit licenses", "MIT\nLicense", "released under the terms of the GNU GPL version 2 only", "SPDX-License-Identifier: Apache-2.0", "permission is hereby granted, free of charge, to any person obtaining a copy",
    "ＭＩＴ license ÉMIT License", "copyright (c) 2020 all rights reserved", "word " * 30_000 + "apache license", "Licenced under BSD 3-clause licence", "\u212ait license mit\u00a0license", "apache license " * 400,
]


def test_scan_equals_brute_force(spark):
    assert scanned(spark, TEXTS) == [brute(t) for t in TEXTS]


PIECES = ["gnu", "general", "public", "license", "licence", "apache", "mit", "cc", "by", "sa", "licensed", "under", "the", "terms", "of", "version", "2", "0", "or", "later", "gpl", "x", "-", ".", "bsd", "3", "clause"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=30).map(" ".join), min_size=20, max_size=20))
def test_scan_equals_brute_force_on_any_words(spark, texts):
    assert scanned(spark, texts) == [brute(t) for t in texts]


def test_rules_are_ordered_and_start_with_their_keyword():
    assert len(RULES) > 200 and [r.rank for r in RULES] == list(range(len(RULES)))
    assert all(re.fullmatch("[a-z0-9]+", k) for r in RULES for k in r.keywords)


def test_query_equals_brute_force_and_runs_no_python(spark):
    df = queries.op6_license_scan(spark, SF)
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in df.collect():
        want = brute(texts[r["doc_id"]])
        del want["detections"]
        assert {k: r[k] for k in want} == want


def test_no_rows(spark):
    assert licenses.scan(spark.createDataFrame([], "text string")).count() == 0


def test_another_rule_list(spark):
    df = spark.createDataFrame([("licensed under the gnu gpl",)], "text string")
    assert licenses.scan(df, [r for r in RULES if r.label == "gpl"][:3]).first()["labels"] == "gpl"


def test_detections_end_where_the_whole_rest_ends_them(spark, monkeypatch):
    """Against a brute force without a reach; the longest rules take up to 35 words, and an identifier any number of them."""
    long = "licensed under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 or any later version"
    longest = "licensed under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 or at your option any later version"
    texts = [long, f"{longest} x", *[f"spdx license identifier gpl {'2 ' * n}or later gnu gpl" for n in (1, 9, 11, 12, 13, 14, 26, 27, 28, 29, 500)]]
    got = scanned(spark, texts)
    monkeypatch.setattr(licenses, "REACH", 1_000_000)
    assert got == [brute(t) for t in texts]
    assert max(d[1] for d in got[0]["detections"]) == 26 and max(d[1] for d in got[1]["detections"]) == 29


def longest_match(pattern):
    """Most words that a pattern without open repeats can match, by Python's own parse of it."""
    import re._parser as parser

    def most(tree):
        n = 0
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                n += arg == 32
            elif name == "SUBPATTERN":
                n += most(arg[3])
            elif name == "BRANCH":
                n += max(most(x) for x in arg[1])
            elif name == "MAX_REPEAT":
                n += arg[1] * most(arg[2]) if most(arg[2]) else 0
        return n

    return most(parser.parse(pattern)) + 1


def test_no_rule_reaches_beyond_its_window():
    """Whole matches, as the window is longer than any rule without open repeats; the others are matched against all the rest."""
    assert max(longest_match(r.pattern) for r in RULES if ")*" not in r.pattern) < licenses.REACH


def test_signatures_of_licence_texts(spark):
    texts = {
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED": "warranty",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License": "gpl",
        "Redistributions in binary form must reproduce the above copyright notice": "bsd",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl",
        "SPDX-License-Identifier: GPL-2.0-only WITH classpath exception": "spdx",
        "released into the public domain": "unlicense",
        "GPLv3": "gpl",
    }
    assert [r["labels"] for r in scanned(spark, list(texts))] == list(texts.values())
