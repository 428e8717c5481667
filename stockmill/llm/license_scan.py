"""Licence scan: a trained paragraph classifier whose answers templates must confirm.

A paragraph is a line of a text, or a run of adjacent lines over which a notice is wrapped: two
lines are one paragraph if together they hold more word triples of some notice than either
alone.  A line that holds a notice by itself begins a paragraph.  Only letters and digits count,
so comment marks do not part words, and a line without any ends a run.  Paragraphs with a cue word
("licence", "copyright", "rights reserved", "public domain", "warranty" ...) and those with a word
triple of any notice are classified by a multinomial logistic
regression on sparse counts of their words and word pairs.  It is trained on notices of each
family, on the notices with each word left out in turn, and, as the class ``unknown``, on
notices reduced to the words that families share and on a bounded sample of ordinary
paragraphs.  Notices of licences outside the families (``OTHERS``) train ``unknown`` too.  A second
regression, on notices the first has not seen, turns the margin over ``unknown`` into a
calibrated probability.

Templates confirm: a family stands only if the word triples of one of its notices occur in the
paragraph to a large part, and to a larger part than those of any other licence's notice, if no
word names another licence (``FOREIGN``: "affero", "noderivatives" ...), and if the paragraph does
not say that the licence does not hold ("never released under").  A copyright line ("All rights
reserved.") right before a notice of an open licence claims nothing of its own.  In all
these cases the licence is ``unknown``.

A paragraph with neither a cue word nor a triple of a notice could never be confirmed: leaving
it out changes nothing.

Only DataFrame and SQL functions and Spark's own DataFrame estimators run.  Null and empty
texts give no rows; repeated rows give their rows each; null ids and extra columns are fine;
equal similarities need no order, as only the greatest counts.
"""

import re

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

UNKNOWN = "unknown"
FEATURES = 4096
CONFIRM = 0.6
ACCEPT = 0.5
#: Documents whose paragraphs show what is no licence.
ORDINARY_DOCUMENTS = 200
CUE = (r"(?i)licen[sc]|copyright|\(c\)|all rights reserved|public domain|warrant|"
       r"permission is hereby|redistribut|spdx")

#: Notices by family: fixed values, the usual public wordings.
NOTICES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files (the Software), to deal in the Software"
        " without restriction, including without limitation the rights to use, copy, modify,"
        " merge, publish, distribute, sublicense, and/or sell copies of the Software, and to"
        " permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions:",
        "The above copyright notice and this permission notice shall be included in all copies"
        " or substantial portions of the Software.",
        "The Software is provided as is, without warranty of any kind, express or implied,"
        " including but not limited to the warranties of merchantability, fitness for a"
        " particular purpose and noninfringement. In no event shall the authors or copyright"
        " holders be liable for any claim, damages or other liability, whether in an action of"
        " contract, tort or otherwise, arising from, out of or in connection with the Software"
        " or the use or other dealings in the Software.",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this"
        " file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the"
        " terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the"
        " terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the"
        " LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of"
        " conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of"
        " conditions and the following disclaimer in the documentation and/or other materials"
        " provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used"
        " to endorse or promote products derived from this software without specific prior"
        " written permission.",
        "This software is provided by the copyright holders and contributors as is and any"
        " express or implied warranties, including, but not limited to, the implied warranties"
        " of merchantability and fitness for a particular purpose are disclaimed.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with"
        " or without fee is hereby granted. The software is provided without warranty.",
        "SPDX-License-Identifier: ISC",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Content is available under the CC BY-SA 4.0 license.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0"
        " International License.",
        "Available under the CC BY-NC-SA 4.0 license, for non-commercial use only.",
    ],
    "Public-Domain": [
        "This work has been released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related"
        " rights to this work under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "Proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved.",
        "All rights reserved. No part of this work may be reproduced without permission.",
        "Confidential and proprietary. Unauthorized copying of this file is prohibited under"
        " copyright law.",
    ],
}

#: Notices of licences that are no family here: fixed values, the usual public wordings.
OTHERS = [
    "This program is free software: you can redistribute it and/or modify it under the terms of"
    " the GNU Affero General Public License as published by the Free Software Foundation",
    "Licensed under the GNU Affero General Public License, version 3.",
    "SPDX-License-Identifier: AGPL-3.0-only",
    "Licensed under the Educational Community License, Version 2.0 (the License); you may not use"
    " this file except in compliance with the License.",
    "This program and the accompanying materials are made available under the terms of the"
    " Eclipse Public License 2.0 which is available at",
    "Distributed under the Boost Software License, Version 1.0.",
    "This software is provided as-is, without any express or implied warranty. In no event will"
    " the authors be held liable for any damages arising from the use of this software.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International"
    " License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0"
    " International License.",
    "Licensed under CC BY-ND 4.0.",
    "Licensed under CC BY-NC-ND 4.0.",
    "Licensed under the EUPL, Version 1.2 or later.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "Use of this software is governed by the Business Source License included in the file"
    " LICENSE.",
    "Licensed under the Artistic License 2.0.",
    "The contents of this file are subject to the terms of the Common Development and"
    " Distribution License.",
]

#: Words that name another licence when they stand in a family's notice: fixed values.
FOREIGN = ("affero agpl noderivatives noderivs nd educational ecl eclipse epl boost bsl zlib eupl"
           " sil ofl busl artistic cddl cecill wtfpl sspl elastic commons").split()
#: Words by which a paragraph says that a licence does not hold.
DENIED = (r"(?i)(?:\b(?:never|not|no longer|neither|nor)\b|n['\u2019]t\b)(?:\W+\w+){0,4}?\W+"
          r"(?:released|licen[sc]ed|available|distributed|published|offered|covered|governed|"
          r"placed|put)\W+(?:under|by|in|into)\b")
#: A copyright line claims nothing of its own if an open notice begins so many lines below.
NEAR_LINES = 2
RESERVED = "Proprietary"
SHARED_BY = 3


def words(text):
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def triples(tokens):
    """Runs of three words; shorter paragraphs are one run."""

    def of(held):
        n = F.size(held)
        return F.when(n < 3, F.array(F.array_join(held, " "))).otherwise(F.transform(
            F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))),
            lambda i: F.array_join(F.slice(held, i, 3), " ")))

    # a bound name, so that the words are not made again for each run
    return F.transform(F.array(tokens), of)[0]


def _triples_of(text):
    """``triples`` of a notice, as a Python list."""
    tokens = re.findall("[a-z0-9]+", text.lower())
    return sorted({" ".join(tokens[i:i + 3]) for i in range(max(1, len(tokens) - 2))})


def _listed(values):
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def notice_triples():
    """The triples of each notice."""
    return F.expr("array(" + ", ".join(
        _listed(_triples_of(text)) for texts in NOTICES.values() for text in texts) + ")")


def touched(runs, without=()):
    """Whether there is a triple of any notice among ``runs``."""
    known = {t for family, texts in NOTICES.items() if family not in without
             for text in texts for t in _triples_of(text)}
    return F.arrays_overlap(runs, F.expr(_listed(sorted(known))))


def foreign_to(family):
    """The words of ``FOREIGN`` that none of the family's own notices has."""
    own = set(re.findall("[a-z0-9]+", " ".join(NOTICES[family]).lower()))
    return sorted(set(FOREIGN) - own)


def notices(spark):
    rows = F.array(*[
        F.struct(F.lit(family).alias("family"), F.lit(i).alias("notice"), F.lit(text).alias("text"))
        for family, texts in NOTICES.items() for i, text in enumerate(texts)])
    return spark.range(1).select(F.inline(rows)).select(
        "family", "notice", words(F.col("text")).alias("words"))


def shared_words():
    """Words of so many families' notices that they say nothing about the family."""
    families = {}
    for family, texts in NOTICES.items():
        for word in re.findall("[a-z0-9]+", " ".join(texts).lower()):
            families.setdefault(word, set()).add(family)
    return sorted(w for w, held in families.items() if len(held) >= SHARED_BY)


def _examples(docs, text, doc_id):
    """Labelled word lists; ``fit`` is false for those that only calibrate."""
    known = notices(docs.sparkSession)
    left_out = known.select(
        "family", "words", F.explode(F.sequence(F.lit(0), F.size("words"))).alias("gone")).select(
        "family", F.filter("words", lambda w, i: i + 1 != F.col("gone")).alias("words"),
        (F.col("gone") % 3 != 1).alias("fit")).where(F.size("words") > 1)
    shared = F.array(*[F.lit(w) for w in shared_words()])
    bare = known.select(
        F.lit(UNKNOWN).alias("family"),
        F.filter("words", lambda w: F.array_contains(shared, w)).alias("words"),
        (F.col("notice") > 0).alias("fit"))
    ids = docs.select(F.col(f"`{doc_id}`").alias("id")).distinct().orderBy(
        F.xxhash64("id"), "id").limit(ORDINARY_DOCUMENTS)
    ordinary = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).join(
        F.broadcast(ids), "id").select(  # bounded by ORDINARY_DOCUMENTS
        "id", F.explode(F.split("text", "\n")).alias("line")).where(
        ~F.col("line").rlike(CUE) & ~touched(triples(words(F.col("line"))))).select(
        F.lit(UNKNOWN).alias("family"), F.slice(words(F.col("line")), 1, 60).alias("words"),
        (F.xxhash64("line") % 3 != 0).alias("fit")).limit(10 * ORDINARY_DOCUMENTS)
    texts = F.array(*[F.struct(F.lit(i).alias("notice"), F.lit(text).alias("text"))
                      for i, text in enumerate(OTHERS)])
    others = docs.sparkSession.range(1).select(F.inline(texts)).select(
        F.lit(UNKNOWN).alias("family"), words(F.col("text")).alias("words"),
        (F.col("notice") % 3 != 1).alias("fit"))
    return left_out.union(bare).union(others).union(ordinary)


class Model:
    """Word features, family regression and calibration."""

    def __init__(self, docs, text="text", doc_id="doc_id"):
        # a few thousand short rows at most: one partition, as each fitting step is a job
        examples = _examples(docs, text, doc_id).repartition(1).cache()
        self._families = StringIndexer(inputCol="family", outputCol="label",
                                       stringOrderType="alphabetAsc").fit(examples)
        labelled = self._families.transform(examples)
        pipeline = Pipeline(stages=[
            NGram(n=2, inputCol="words", outputCol="pairs"),
            HashingTF(numFeatures=FEATURES, inputCol="words", outputCol="word_counts"),
            HashingTF(numFeatures=FEATURES, inputCol="pairs", outputCol="pair_counts"),
            VectorAssembler(inputCols=["word_counts", "pair_counts"], outputCol="features"),
            LogisticRegression(regParam=0.002, maxIter=60, family="multinomial"),
        ])
        self._model = pipeline.fit(labelled.where("fit"))
        margins = self._margins(labelled.where(~F.col("fit")))
        right = (F.col("predicted") == F.col("family")) & (F.col("family") != UNKNOWN)
        margin = VectorAssembler(inputCols=["margin"], outputCol="x")
        self._curve = Pipeline(stages=[margin, LogisticRegression(
            featuresCol="x", labelCol="right", probabilityCol="chance", predictionCol="_p",
            rawPredictionCol="_r", regParam=0.001)]).fit(
            margins.withColumn("right", right.cast("double")))
        examples.unpersist()

    def _margins(self, rows):
        """Best family and its log-odds over ``unknown``."""
        labels = self._families.labels
        unknown = labels.index(UNKNOWN)
        scored = self._model.transform(rows).withColumn("p", vector_to_array("probability"))
        chances = F.array(*[F.struct(F.col("p")[i].alias("p"), F.lit(name).alias("name"))
                            for i, name in enumerate(labels) if i != unknown])
        best = F.array_max(chances)
        return scored.withColumn("predicted", best["name"]).withColumn(
            "margin", F.log((best["p"] + 1e-9) / (F.col("p")[unknown] + 1e-9)))

    def classify(self, rows):
        """Add predicted and probability to rows with ``words``."""
        scored = self._curve.transform(self._margins(rows))
        return scored.withColumn("chance", vector_to_array("chance")[1]).select(
            *rows.columns, "predicted", F.round("chance", 6).alias("probability"))


def _judged(pair, place):
    """A line with its triples and those of the line before: does it join that one?"""
    sets = notice_triples()

    def held(part):
        return lambda notice: F.size(F.array_intersect(notice, pair[part]))

    mine, last, both = held("mine"), held("last"), held("both")
    whole = F.exists(sets, lambda n: mine(n) >= CONFIRM * F.size(n))
    more = F.exists(sets, lambda n: both(n) > F.greatest(last(n), mine(n)))
    joins = F.when(pair["apart"] | ~touched(pair["both"]), False).when(whole, False).otherwise(more)
    return F.struct(place.alias("place"), pair["body"].alias("body"), joins.alias("joins"),
                    touched(pair["mine"]).alias("touched"),
                    touched(pair["mine"], [RESERVED]).alias("opens"))


def paragraphs(docs, text="text", doc_id="doc_id"):
    """Paragraphs with a cue word or a triple of a notice: doc_id, paragraph (number of its first
    line from 0), body, heads (an open licence's notice begins right below)."""
    body = F.col(f"`{text}`")
    lines = docs.where(body.rlike(CUE) | touched(triples(words(body)))).select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.transform(F.split(body, "\n", -1), lambda x: F.struct(
            x.alias("body"), words(x).alias("words"))).alias("lines"))
    none = F.struct(F.lit("").alias("body"), F.array().cast("array<string>").alias("words"))
    before = F.slice(F.concat(F.array(none), "lines"), 1, F.size("lines"))
    pairs = F.zip_with("lines", before, lambda x, y: F.struct(
        x["body"].alias("body"), triples(x["words"]).alias("mine"),
        triples(y["words"]).alias("last"),
        triples(F.concat(y["words"], x["words"])).alias("both"),
        ((F.size(x["words"]) == 0) | (F.size(y["words"]) == 0)).alias("apart")))
    judged = lines.select("doc_id", F.transform(pairs, _judged).alias("lines"))
    # one mark per line, 0 where a paragraph begins; the first line joins nothing
    marks = F.array_join(F.transform("lines", lambda x: x["joins"].cast("int").cast("string")), "")
    begins = F.arrays_zip(F.filter("lines", lambda x: ~x["joins"]).alias("first"),
                          F.regexp_extract_all(marks, F.lit("01*"), 0).alias("marks"))

    def run(x):
        inside = F.slice("lines", x["first"]["place"] + 1, F.length(x["marks"]))
        return F.struct(
            x["first"]["place"].alias("paragraph"),
            F.array_join(F.transform(inside, lambda y: y["body"]), "\n").alias("body"),
            ((F.length(x["marks"]) > 1) | x["first"]["touched"]).alias("touched"),
            F.exists(F.slice("lines", x["first"]["place"] + 1 + F.length(x["marks"]), NEAR_LINES),
                     lambda y: y["opens"]).alias("heads"))

    return judged.select("doc_id", F.inline(F.transform(begins, run))).where(
        F.col("touched") | F.col("body").rlike(CUE)).drop("touched")


def scan(docs, text="text", doc_id="doc_id", model=None):
    """doc_id, paragraph, body, predicted, probability, similarity, other_similarity, objection,
    confirmed, license.  ``objection`` tells why a likely notice is not confirmed: "other",
    "foreign word", "denied" or "copyright line"."""
    model = model or Model(docs, text, doc_id)
    texts = {family: [F.expr(_listed(_triples_of(line))) for line in lines]
             for family, lines in NOTICES.items()}
    others = [F.expr(_listed(_triples_of(line))) for line in OTHERS]
    found = model.classify(paragraphs(docs, text, doc_id).withColumn("words", words(F.col("body"))))
    mine = triples(F.col("words"))

    def held(sets):
        return F.greatest(*[F.size(F.array_intersect(s, F.col("mine"))) / F.size(s)
                            for s in sets])

    similarity, foreign = F.lit(0.0), F.lit(False)
    for family, sets in texts.items():
        told = F.col("predicted") == family
        similarity = F.when(told, held(sets)).otherwise(similarity)
        foreign = F.when(told, F.arrays_overlap(
            "words", F.expr(_listed(foreign_to(family))))).otherwise(foreign)
    likely = (F.col("similarity") >= CONFIRM) & (F.col("probability") >= ACCEPT)
    objection = (
        F.when(~likely, None)
        .when(F.col("other_similarity") >= F.col("similarity"), "other")
        .when(foreign, "foreign word")
        .when(F.col("body").rlike(DENIED), "denied")
        .when((F.col("predicted") == RESERVED) & F.col("heads"), "copyright line"))
    return found.withColumn("mine", mine).select(
        "doc_id", "paragraph", "body", "heads", "words", "predicted", "probability",
        F.round(similarity, 6).alias("similarity"),
        F.round(held(others), 6).alias("other_similarity")).withColumn(
        "objection", objection).withColumn(
        "confirmed", likely & F.col("objection").isNull()).withColumn(
        "license", F.when(F.col("confirmed"), F.col("predicted")).otherwise(UNKNOWN)).drop(
        "heads", "words")
