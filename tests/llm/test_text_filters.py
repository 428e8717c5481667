"""Decontamination, language, quality and licences."""

import os
import random

import pytest
from pyspark.sql import functions as F

import brute
from stockmill.llm import decontaminate, language_id, license_scan, quality
from stockmill.llm.common import held_out, table

BIG = "/root/testdata/sf0.01"


def drawn(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "ß1"]
    items = [(i, drawn(rng, rng.choice([0, 4, 13, 20, 40]), vocabulary)) for i in range(30)]
    items += [(30, None), (31, ""), (7, "W1, w2 -- w3")]
    docs = []
    for d in range(60):
        text = drawn(rng, rng.randrange(60), vocabulary)
        if d % 3 == 0:
            text = f"{text}! {rng.choice(items)[1] or ''}? {drawn(rng, 20, vocabulary)}".upper()
        docs.append((d, text))
    return docs, items


@pytest.mark.parametrize("item_bytes", [1 << 20, 400])
def test_decontamination_equals_search(spark, make_docs, planted, item_bytes):
    docs, items = planted
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.scan(make_docs(docs), bench, item_bytes=item_bytes).collect()
    assert len(got) == len(docs)
    for r in got:
        n, hit, found = brute.contamination(r.row.text, items)
        assert (r.out.n_words, r.out.n_hit, set(r.out["items"])) == (n, len(hit), found)
        assert r.out.contaminated == (len(hit) > 0 and 20 * len(hit) >= n)
        shown = [w for a, b in r.out.spans for w in brute.words(r.row.text[a:b])]
        assert shown == [w for i, w in enumerate(brute.words(r.row.text)) if i in hit]


def test_decontamination_of_odd_rows(spark, make_docs, odd_rows, clashing):
    bench = spark.createDataFrame([(1, "the same short line here")], "item_id bigint, text string")
    got = decontaminate.scan(make_docs(odd_rows, clashing), bench).collect()
    assert len(got) == len(odd_rows)
    assert sum(r.out.contaminated for r in got) == 3
    assert all(r.out.n_words == 0 for r in got if not r.row.text)
    none = decontaminate.scan(make_docs(odd_rows), bench.limit(0)).where("out.n_hit > 0")
    assert none.count() == 0
    assert decontaminate.scan(make_docs([]), bench).count() == 0


def test_language_held_out_accuracy(spark):
    if not os.path.isdir(BIG):
        pytest.skip("test tables not found")
    docs = table(spark, BIG, "documents")
    got = language_id.predict(docs, language_id.fit(docs)).where(held_out("row.doc_id"))
    right = got.agg(F.avg((F.col("out.lang_pred") == F.col("row.lang")).cast("int"))).first()[0]
    assert right > 0.95
    assert got.where("out.score < 0 OR out.score > 1").count() == 0


def test_language_of_odd_rows(make_docs, odd_rows, clashing):
    rng = random.Random(1)
    train = [(i, drawn(rng, 30, w), lang) for i in range(100, 160)
             for lang, w in (("en", ["the", "of", "and", "with"]), ("de", ["der", "und", "mit"]),
                             ("fr", ["le", "de", "avec", "et"]), ("xx", ["qua", "zor"]))]
    model = language_id.fit(make_docs(train))
    got = language_id.predict(make_docs(odd_rows, clashing), model).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        letters = any(c.isalpha() for c in r.row.text or "")
        assert (r.out.lang_pred == "und") != letters
    assert model.families and all(f[1] for f in model.families)
    sure = language_id.predict(make_docs([(1, "und der mit und"), (2, "zor qua zor")]), model)
    assert {r.row.doc_id: r.out.lang_pred for r in sure.collect()} == {1: "de", 2: "xx"}
    untrained = language_id.fit(make_docs([]))
    assert {r.out.lang_pred for r in language_id.predict(make_docs(odd_rows), untrained).collect()
            } == {"und"}


def test_language_equals_text_by_text(spark, make_docs, odd_rows, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    odd = [(-i, text) for i, (_, text) in enumerate(odd_rows, 1)]
    rows = docs.limit(150).unionByName(make_docs(odd).select("doc_id", "text", "lang"))
    got = language_id.predict(rows, model).collect()
    assert len(got) == 150 + len(odd)
    for r in got:
        name, value = brute.language(r.row.text, model, language_id.features)
        assert r.out.lang_pred == name and r.out.score == pytest.approx(value, abs=1e-4)


def test_quality_equals_text_by_text(spark, make_docs, odd_rows, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    odd = [(-i, text) for i, (_, text) in enumerate(odd_rows, 1)]
    rows = docs.limit(150).unionByName(make_docs(odd).select("doc_id", "text"))
    got = quality.score(rows, model).collect()
    assert len(got) == 150 + len(odd)
    for r in got:
        assert r.out.score == pytest.approx(brute.quality(
            r.row.text, model, quality.LEVEL, quality.BLOCK_BYTES, quality._PRIOR_BYTES), abs=1e-9)


def test_quality_held_out_accuracy(spark):
    if not os.path.isdir(BIG):
        pytest.skip("test tables not found")
    docs, labels = table(spark, BIG, "documents"), table(spark, BIG, "labels")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).where(held_out("row.doc_id")).join(
        labels.withColumnRenamed("doc_id", "id"), F.col("row.doc_id") == F.col("id"))
    right = got.agg(F.avg(((F.col("out.score") >= quality.KEEP_FROM).cast("int")
                           == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.93


def test_quality_of_odd_rows(spark, make_docs, odd_rows, clashing):
    rng = random.Random(2)
    good = [(i, drawn(rng, 40, ["river", "house", "walks", "green"])) for i in range(200)]
    bad = [(i, drawn(rng, 40, ["$$$", "WIN!!", "###", "click"])) for i in range(200, 400)]
    labels = spark.createDataFrame([(i, int(i < 200), None) for i in range(400)] + [(None, 1, 0)],
                                   "doc_id bigint, quality int, toxic int")
    model = quality.fit(make_docs(good + bad + odd_rows), labels)
    got = quality.score(make_docs(odd_rows, clashing), model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.out.score <= 1 for r in got)
    scores = quality.score(make_docs(good + bad), model).groupBy(
        (F.col("row.doc_id") < 200).alias("good")).agg(F.avg("out.score").alias("s")).collect()
    scores = {r.good: r.s for r in scores}
    assert scores[True] > 0.9 and scores[False] < 0.1
    unlabelled = quality.fit(make_docs(good), labels.limit(0))
    assert quality.score(make_docs(good), unlabelled).where("out.score < 0.3").count() == 0
    assert quality.score(make_docs([]), unlabelled).count() == 0


def test_licences(make_docs, odd_rows, clashing):
    ordinary = [(i, "Plain words about rivers and houses.\nAnother line of words.")
                for i in range(100, 140)]
    rows = [
        (10, "text\nReleased under the MIT License.\nmore"),
        (11, "Licensed under the Apache License, Version 2.0."),
        (12, "this work is LICENSED under the gnu general public license, version 3"),
        (13, "You need a licence from the council to keep a horse here."),
        (14, "Licensed under CC BY-NC 4.0."),
    ]
    got = license_scan.scan(make_docs(ordinary + rows + odd_rows, clashing)).collect()
    assert {r.doc_id: r.license for r in got} == {
        10: "MIT", 11: "Apache", 12: "GPL", 13: "unknown", 14: "CC-BY-NC"}
    assert [r.paragraph for r in got if r.doc_id == 10] == [1]
    assert all(0 <= r.probability <= 1 and 0 <= r.similarity <= 1 for r in got)


def test_every_notice_has_a_cue(make_docs):
    rows = [(i, text) for i, text in enumerate(
        t for texts in license_scan.NOTICES.values() for t in texts)]
    assert license_scan.paragraphs(make_docs(rows)).count() == len(rows)


WRAPPED = {
    "GPL": "/* This program is free software: you can redistribute it and/or modify\n"
           " * it under the terms of the GNU General Public License as published by\n"
           " * the Free Software Foundation, either version 3 of the License, or\n"
           " * (at your option) any later version.\n */",
    "LGPL": "# This library is free software; you can redistribute it and/or\n"
            "# modify it under the terms of the GNU Lesser General Public\n"
            "# License as published by the Free Software Foundation.",
    "BSD": "// Redistribution and use in source and binary forms, with or without\n"
           "// modification, are permitted provided that the following conditions\n// are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any\n"
           "purpose with or without fee is hereby granted. The software is provided\n"
           "without warranty.",
    "MPL": "-- This Source Code Form is subject to the terms of the Mozilla\n"
           "-- Public License, v. 2.0. If a copy of the MPL was not distributed with this\n"
           "-- file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


@pytest.fixture(scope="module")
def licence_model(make_docs):
    return license_scan.Model(make_docs([
        (i, "Plain words about rivers and houses.\nAnother line of words.") for i in range(40)]))


def test_wrapped_notices(make_docs, licence_model):
    style = ("// Use of this source code is governed by a BSD-style license that\n"
             "// can be found in the LICENSE file.")
    rows = [(family, f"int x;\n\n{text}\n\nint y;") for family, text in WRAPPED.items()]
    rows += [("style", style), ("two", f"{WRAPPED['ISC']}\n{WRAPPED['GPL']}"),
             ("lines", "Released under the MIT License.\n"
                       "Licensed under the Apache License, Version 2.0.")]
    docs = make_docs(rows, "doc_id string, text string")
    found = {}
    for r in license_scan.scan(docs, model=licence_model).where("confirmed").collect():
        found.setdefault(r.doc_id, []).append((r.paragraph, r.license))
    assert {d: sorted(x) for d, x in found.items()} == {
        **{f: [(2, f)] for f in WRAPPED}, "style": [(0, "BSD")],
        "two": [(0, "ISC"), (3, "GPL")], "lines": [(0, "MIT"), (1, "Apache")]}


def test_notices_without_a_cue(make_docs, licence_model):
    rows = [(1, "This Source Code Form is subject to the terms of the Mozilla Public"),
            (2, "and use in source and binary forms, with or without modification, are"
                " permitted provided that the following conditions are met")]
    got = license_scan.scan(make_docs(rows), model=licence_model).collect()
    assert {r.doc_id: r.license for r in got} == {1: "MPL", 2: "BSD"}


NO_FAMILY = [
    "This program is free software: you can redistribute it and/or modify it under the terms of"
    " the GNU Affero General Public License as published by the Free Software Foundation, either"
    " version 3 of the License, or (at your option) any later version.",
    "Licensed under the GNU Affero General Public License, version 3.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International"
    " License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0"
    " International License.",
    "Licensed under CC BY-ND 4.0.",
    "Licensed under CC BY-NC-ND 4.0.",
    "Licensed under the Educational Community License, Version 2.0 (the License); you may not use"
    " this file except in compliance with the License.",
    "Distributed under the Boost Software License, Version 1.0. (See accompanying file"
    " LICENSE_1_0.txt)",
    "This software is provided 'as-is', without any express or implied warranty. In no event will"
    " the authors be held liable for any damages arising from the use of this software.",
    "This program and the accompanying materials are made available under the terms of the"
    " Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "Licensed under the EUPL, Version 1.2 or later.",
    "Licensed under the Artistic License 2.0.",
    "SPDX-License-Identifier: AGPL-3.0-or-later",
    "SPDX-License-Identifier: BSL-1.0",
    "SPDX-License-Identifier: EPL-2.0",
    "SPDX-License-Identifier: Zlib",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "The contents of this file are subject to the terms of the Common Development and Distribution"
    " License (the License).",
    "Licensed under the Elastic License 2.0.",
    "This project is released under the Server Side Public License, version 1.",
    "This work was never released under the MIT License.",
    "The code is not licensed under the Apache License, Version 2.0.",
    "The old files aren't available under the CC BY-SA 4.0 license.",
    "This library has not been released into the public domain.",
]
COPYRIGHT = "Copyright (c) 2010, The Authors. All rights reserved."
MIT_TEXT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""


def test_licences_of_no_family_are_unknown(make_docs, licence_model):
    got = license_scan.scan(make_docs(list(enumerate(NO_FAMILY))), model=licence_model).collect()
    assert [(r.body, r.license, r.objection) for r in got if r.license != "unknown"] == []


def test_every_notice_is_still_told(make_docs, licence_model):
    rows = [(f"{family} {i}", text) for family, texts in license_scan.NOTICES.items()
            for i, text in enumerate(texts)]
    got = license_scan.scan(make_docs(rows, "doc_id string, text string"),
                            model=licence_model).collect()
    assert [(r.doc_id, r.predicted, r.probability, r.objection) for r in got
            if r.license != r.doc_id.split()[0]] == []
    assert len({r.doc_id for r in got}) == len(rows)


def test_copyright_lines_and_whole_texts(make_docs, licence_model):
    rows = [(1, f"{COPYRIGHT}\n\n{WRAPPED['BSD']}"), (2, f"{COPYRIGHT}\nint x;"),
            (3, f"int x;\n{MIT_TEXT}\n\nint y;")]
    got = license_scan.scan(make_docs(rows), model=licence_model).collect()
    told = {d: sorted((r.paragraph, r.license) for r in got if r.doc_id == d) for d in (1, 2, 3)}
    assert told[1] == [(0, "unknown"), (2, "BSD")] and told[2] == [(0, "Proprietary")]
    assert [x for x in told[3] if x[1] != "unknown"] == [(3, "MIT"), (10, "MIT"), (13, "MIT")]
    assert len(told[3]) == 4  # the copyright line is the fourth


def test_item_ids_of_any_type_and_bounded_automaton(make_docs, spark):
    body = " ".join(f"w{i}" for i in range(40))
    bench = spark.createDataFrame([("q-1", body), ("q-2", "just three words"), (None, body)],
                                  "item_id string, text string")
    got = {r.row.doc_id: r.out for r in decontaminate.scan(
        make_docs([(1, f"Before. {body.upper()} after"), (2, "JUST, three (words)!"), (3, "just w1")]),
        bench).collect()}
    assert (got[1]["items"], got[1].n_hit, got[1].contaminated) == (["q-1", None], 40, True)
    assert (got[2]["items"], got[2].n_hit) == (["q-2"], 3)
    assert got[3].n_hit == 0
    windows = decontaminate.item_windows([(1, " ".join(f"w{i}" for i in range(5000)))], 13)
    tree, numbers = decontaminate.automaton(windows)
    assert len(numbers) == 5000 and tree.get_stats()["nodes_count"] <= 13 * 5000 + 1


def test_many_languages_are_all_learned(make_docs):
    """More languages than any list is long; each has letters of its own."""
    count, rows = 230, []
    for n in range(count):
        word = "".join(chr(0x4E00 + 37 * n + k) for k in range(3))
        rows += [(100 * n + k, f"{word} {word[::-1]} " * (5 + k), f"x{n:03}") for k in range(4)]
    docs = make_docs(rows)
    model = language_id.fit(docs)
    assert len({m for _, members in model.families for m in members}) == count
    told = language_id.predict(docs, model).select("row.lang", "out.lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in told) > 0.95 * len(told)
