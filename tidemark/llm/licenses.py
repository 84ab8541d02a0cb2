"""Licence scans by a trained paragraph classifier, in DataFrame functions and JVM estimators alone.

A paragraph is a line, or a run of lines up to a blank one, where a line of comment marks alone is blank: notices that
are wrapped are read over the ends of their lines.  A run counts beside its lines: it is classed by the words and pairs
that templates hold, and gives a family that none of its lines gives.  Its place is that of its first line.  Features
are words and pairs of words; a multinomial logistic regression with an absolute penalty knows few of them.

The classes are the licence families and ``unknown``.  Unknown rows are paragraphs of the corpus that hold no word of
licensing, sentences that talk of licences, and templates whose naming words are replaced by words of the corpus, so the
names must carry a verdict.  Calibration holds out whole templates: a third of every family's templates, with the
unknown rows made from them, is scored by a model that never saw them.  Log loss over these rows picks the temperature,
and the lowest probability at which ``precision`` of the families named are right is the cut.  A family counts
when its probability reaches the cut and the comparison confirms it: at least ``overlap`` of the word pairs of one of
its templates are in the paragraph, and no template of another family has a larger share there.

Only confirmed paragraphs reach the result, so the scan compares before it classes.  A text without any of the words one of
which every confirmed paragraph holds (``anchors``, the rarest that will do) is passed over by substring searches, then
so are paragraphs; only paragraphs with the share of pairs are exploded into features.  Nothing that could be confirmed
is lost by it, whichever words are rare.

Training rows are the templates, alone and beside paragraphs of the corpus, and at most ``sample_paragraphs``
paragraphs, those with the smallest hashes among the lines of at most as many documents.  The known features are a
table bounded by ``vocabulary`` and the templates; it is broadcast.  Whole texts of all documents are read once.

Defined cases: a null or empty text has no licence; null ids and repeated rows get a row each; of equally good
paragraphs the first counts, then the family first in order; an empty table gives an empty result; other columns play
no part.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored

UNKNOWN = "unknown"
#: Usual notices of public licences.
TEMPLATES: dict[str, list[str]] = {
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "This project is licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-NC-ND": [
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-ND-4.0",
    ],
    "CC-BY-NC-SA": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-SA-4.0",
    ],
    "CC-BY-ND": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0.",
        "Licensed under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "EPL": [
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Eclipse Public License - v 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "GNU GENERAL PUBLIC LICENSE Version 3",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "This project is licensed under the terms of the ISC license.",
        "SPDX-License-Identifier: ISC",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The MIT License (MIT)",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "Mozilla Public License Version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
        "For more information, please refer to https://unlicense.org",
        "SPDX-License-Identifier: Unlicense",
    ],
    "proprietary": [
        "Copyright, all rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "This software is proprietary and confidential. All rights reserved.",
    ],
}
CLASSES = [*sorted(TEMPLATES), UNKNOWN]
#: Words that speak of licensing.
LICENSING = "license licence licensed licenses licensing copyright copyrighted spdx redistribution permission gnu apache mit bsd mozilla cc0".split()
#: Words that name a licence.
NAMING = (
    "affero agpl apache attribution bsd cc cc0 clause commons creative eclipse epl general gnu gpl isc lesser lgpl mit mozilla mpl nc nd "
    "noderivatives noncommercial sa sharealike unencumbered unlicense"
).split()
#: Sentences that talk of licences and grant none.
TALK = [
    "You may not use this material without the permission of the publisher.", "The driver is licensed and the general public was under it.",
    "The license was revoked by the public authority.", "Copyright belongs to the authors.", "All rights to the name are reserved by its owner.",
    "Licensed premises are open until midnight.", "This document is licensed under the terms of the agreement between the parties.",
    "Permission is hereby asked of any person with a copy of this software.", "The work was released under the supervision of the general manager.",
    "She was licensed to practise under the laws of the state.", "Use of the source is governed by local law.", "The program is free and open to the public.",
]


#: Lines of white space and marks alone; words that begin a comment line.
BLANK, COMMENT_WORDS = r"^[\s\p{Punct}]*$", ["dnl", "rem"]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def _unmarked(w: Column) -> Column:
    return F.when(F.get(w, F.lit(0)).isin(COMMENT_WORDS), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0)))).otherwise(w)


def pairs(w: Column) -> Column:
    rest = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, rest), F.slice(w, 2, rest), lambda a, b: F.concat(a, F.lit(" "), b))


def with_grams(df: DataFrame, text: str) -> DataFrame:
    """``grams``: the distinct words and pairs of neighbouring words of a column.  Words are worked out once a row."""
    return df.withColumn("words", words(F.col(text))).withColumn("grams", F.array_distinct(F.concat("words", pairs(F.col("words"))))).drop("words")


def template_table(spark: SparkSession) -> DataFrame:
    """(text, family, third): every template, and the third of its family's templates that it belongs to."""
    return spark.createDataFrame([(t, f, k % 3) for f, texts in TEMPLATES.items() for k, t in enumerate(texts)], "text string, family string, third int")


def needed_pairs() -> list[tuple[str, str, list[tuple[str, str]]]]:
    """(family, template, its distinct pairs of words), family by family."""
    out = []
    for family in sorted(TEMPLATES):
        for k, text in enumerate(TEMPLATES[family]):
            out.append((family, f"{family}/{k}", list(dict.fromkeys(pairwise(re.findall("[a-z0-9]+", text.lower()))))))
    return out


def anchors(overlap: float, rarest: list[str]) -> list[str]:
    """Words one of which is in every paragraph that holds ``overlap`` of a template's pairs, whatever their order.

    Where at most ``spare`` pairs may be missing, some word of any set that has more pairs than that between them is there.
    The sets are filled from ``rarest``, a list of all words of the templates.
    """
    chosen: list[str] = []
    for _, _, needed in needed_pairs():
        spare = len(needed) - math.ceil(overlap * len(needed) - 1e-9)
        rest = set(needed)
        for w in rarest:
            if len(needed) - len(rest) > spare:
                break
            if any(w in pair for pair in rest):
                rest = {pair for pair in rest if w not in pair}
                chosen.append(w)
    return list(dict.fromkeys(chosen))


def _holds_any(text: Column, some: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in some))


@dataclass(frozen=True)
class LicenceModel:
    """Features with a weight for each class, the classes' constants, the temperature, the least probability that counts,
    and the words of the templates, the rarest in the sampled documents first."""

    features: DataFrame
    constants: list[float]
    temperature: float
    cut: float
    rarest: list[str]


def _sampled(docs: DataFrame, sample_paragraphs: int) -> DataFrame:
    """(doc_id, text) of the documents whose ids have the ``sample_paragraphs`` smallest hashes."""
    # hashes below a bound that all but surely holds enough ids: tasks then hand over few rows, not sample_paragraphs each
    n = docs.where("text is not null and doc_id is not null").count()
    bound = 2**32 if n <= 4 * sample_paragraphs else 4 * sample_paragraphs * 2**32 // n
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(2**32))
    ids = docs.where("text is not null and doc_id is not null").where(mark < bound).select("doc_id").orderBy(mark, "doc_id").limit(sample_paragraphs).distinct()
    return stored(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "licences")  # at most sample_paragraphs ids


def _rarest_first(some: DataFrame) -> list[str]:
    """The words of the templates by the number of sampled documents that they are in, long words first among equals."""
    names = sorted({w for _, _, needed in needed_pairs() for pair in needed for w in pair}, key=lambda w: (-len(w), w))
    within = F.filter(F.array(*map(F.lit, names)), lambda w: F.contains(F.lower("text"), w))
    counts = {r["word"]: r["count"] for r in some.select(F.explode(within).alias("word")).groupBy("word").count().collect()}  # words of the templates
    return sorted(names, key=lambda w: counts.get(w, 0))


def _training_rows(some: DataFrame, sample_paragraphs: int) -> DataFrame:
    """(text, label, third): templates, templates beside paragraphs or without their names, talk, paragraphs."""
    spark = some.sparkSession
    lines = some.select(F.explode(F.split("text", "\n")).alias("text"))
    lines = lines.where(~F.arrays_overlap(words(F.col("text")), F.array(*map(F.lit, LICENSING)))).where("text <> ''").distinct()
    lines = stored(lines.orderBy(F.xxhash64("text"), "text").limit(sample_paragraphs).withColumn("part", F.pmod(F.xxhash64("text"), F.lit(12)).cast("int")), "licences")
    beside = F.broadcast(lines.groupBy("part").agg(F.min("text").alias("line")))  # 12 lines
    copies = template_table(spark).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(11)))).join(beside, "part", "left")
    line = F.coalesce("line", F.lit(""))
    joined = F.when(F.col("part") % 4 == 1, F.concat_ws(" ", line, "text")).when(F.col("part") % 4 == 2, F.concat_ws(" ", "text", line)).otherwise(F.col("text"))
    label = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("family")) - 1
    unknown = F.lit(float(len(CLASSES) - 1)).alias("label")
    named = r"(?i)\b(" + "|".join(NAMING) + r")\b"
    word = F.coalesce(F.get(words(line), F.col("part") % F.greatest(F.size(words(line)), F.lit(1))), F.lit("some"))
    unnamed = copies.where(F.col("text").rlike(named)).select(F.regexp_replace("text", F.lit(named), word).alias("text"), unknown, "third")
    talk = spark.createDataFrame([(t, k % 3) for k, t in enumerate(TALK)], "text string, third int")
    talk = talk.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("text", unknown, "third")
    plain = lines.select("text", unknown, F.pmod(F.xxhash64("text"), F.lit(3)).cast("int").alias("third"))
    return copies.select(joined.alias("text"), label.cast("double").alias("label"), "third").unionByName(unnamed).unionByName(talk).unionByName(plain)


def _partition(logits: Column, top: Column, temperature: Column | float) -> Column:
    """The sum of the exponentials of scaled logits, the largest of which is ``top``: one over the largest probability."""
    return F.aggregate(logits, F.lit(0.0), lambda total, z: total + F.exp((z - top) / temperature))


def fit_licences(docs: DataFrame, sample_paragraphs: int = 2_000, vocabulary: int = 4_096, precision: float = 0.98) -> LicenceModel:
    spark = docs.sparkSession
    some = _sampled(docs, sample_paragraphs)
    rows = stored(with_grams(_training_rows(some, sample_paragraphs), "text").select("grams", "label", "third"), "licences")
    counter = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=vocabulary, minDF=2, binary=True).fit(rows)
    rows = stored(counter.transform(rows).select("features", "label", "third").coalesce(4), "licences")  # a few thousand rows
    regression = LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=2e-4, maxIter=25, standardization=False)
    model = regression.fit(rows)
    matrix, constants = model.coefficientMatrix.toArray(), model.interceptVector.toArray()  # at most vocabulary x classes
    known = {g: list(map(float, matrix[:, k])) for k, g in enumerate(counter.vocabulary) if abs(matrix[:, k]).max() > 1e-6}
    for _, _, needed in needed_pairs():
        for pair in needed:
            known.setdefault(" ".join(pair), [0.0] * len(CLASSES))
    known[""] = [0.0] * len(CLASSES)  # every document has this one, so none is lost in the join
    features = spark.createDataFrame(list(known.items()), "gram string, weights array<double>")

    held = regression.fit(rows.where("third <> 2")).transform(rows.where("third = 2"))  # every family has a template there and others elsewhere
    held = held.select("label", vector_to_array("rawPrediction").alias("logits"))
    held = stored(held, "licences").withColumn("top", F.array_max("logits"))
    tried = held.withColumn("t", F.explode(F.array(*map(F.lit, [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0, 5.6, 8.0]))))
    right = F.get("logits", F.col("label").cast("int"))
    loss = tried.groupBy("t").agg(F.avg(F.log(_partition(F.col("logits"), F.col("top"), F.col("t"))) - (right - F.col("top")) / F.col("t")).alias("loss"))
    temperature = loss.orderBy("loss", "t").first()["t"]
    said = held.select("label", (1 / _partition(F.col("logits"), F.col("top"), temperature)).alias("p"), (F.array_position("logits", F.col("top")) - 1).alias("said"))
    said = said.where(F.col("said") < len(CLASSES) - 1)
    cuts = said.withColumn("cut", F.explode(F.array(*(F.lit(k / 50) for k in range(1, 50))))).where("p >= cut")
    best = cuts.groupBy("cut").agg(F.avg((F.col("said") == F.col("label")).cast("double")).alias("right")).where(F.col("right") >= precision).orderBy("cut").first()
    return LicenceModel(features, list(map(float, constants)), temperature, best["cut"] if best else 0.98, _rarest_first(some))


def licence_scan(docs: DataFrame, model: LicenceModel, overlap: float = 0.7) -> DataFrame:
    """(doc_id, licences, n_paragraphs, family, probability, template, template_share, paragraph): a row for each row of ``docs``.

    ``licences`` are the confirmed families; the rest describes the confirmed paragraph of highest probability.
    """
    templates = [(family, template, [" ".join(pair) for pair in needed]) for family, template, needed in needed_pairs()]
    fewest = min(math.ceil(overlap * len(needed) - 1e-9) for _, _, needed in templates)
    all_pairs = F.array(*map(F.lit, sorted({pair for _, _, needed in templates for pair in needed})))
    parts = F.array(*map(F.lit, sorted({g for _, _, needed in templates for pair in needed for g in (pair, *pair.split())})))
    template = F.array(*(F.struct(F.array(*map(F.lit, n)).alias("needed"), F.lit(f).alias("family"), F.lit(t).alias("template")) for f, t, n in templates))
    some = anchors(overlap, model.rarest)

    rows = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"), F.monotonically_increasing_id().alias("row"))  # numbered before lines are made
    texts = rows.select("doc_id", "row", F.when(_holds_any(F.col("text"), some), F.split("text", "\n")).alias("all"))
    # a line of marks alone ends a run; lines with an anchor are found first, as only their runs are read
    texts = texts.withColumn("blank", F.transform("all", lambda x: x.rlike(BLANK))).withColumn("held", F.transform("all", lambda x: _holds_any(x, some)))
    ends = lambda step: F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda i: ~F.get("blank", i) & F.coalesce(F.get("blank", i + step), F.lit(True)))
    runs = F.zip_with(ends(-1), ends(1), lambda a, b: F.struct(a.alias("block"), F.slice("all", a + 1, b - a + 1).alias("lines"), F.slice("held", a + 1, b - a + 1).alias("held")))
    runs = F.when(F.col("all").isNotNull(), F.filter(runs, lambda r: F.array_contains(r["held"], True)))
    none = F.array(F.struct(F.lit(-1).alias("block"), F.array(F.lit("")).alias("lines"), F.array(F.lit(False)).alias("held")))  # every document has this one, so none is lost
    # outer explodes: from others the optimizer infers filters that repeat all that went before
    runs = texts.select("doc_id", "row", F.explode_outer(F.concat(none, F.coalesce(runs, F.slice(none, 1, 0)))).alias("run"))
    runs = runs.select("doc_id", "row", "run.block", "run.held", F.transform("run.lines", lambda x: _unmarked(words(x))).alias("tokens"))
    # lines with an anchor, and the whole run where it has several lines
    lines = F.transform("tokens", lambda w, i: F.struct((F.col("block") + i).alias("paragraph"), F.lit(False).alias("whole"), w.alias("words"), F.get("held", i).alias("held")))
    lines = F.filter(lines, lambda x: x["held"] | (F.col("block") < 0))
    whole = F.array(F.struct(F.col("block").alias("paragraph"), F.lit(True).alias("whole"), F.flatten("tokens").alias("words"), F.lit(True).alias("held")))
    runs = runs.select("doc_id", "row", "block", F.explode_outer(F.when(F.size("tokens") > 1, F.concat(lines, whole)).otherwise(lines)).alias("p"))
    runs = runs.select("doc_id", "row", "block", "p.paragraph", "p.whole", "p.words").withColumn("pairs", F.array_distinct(pairs(F.col("words"))))
    runs = runs.withColumn("known", F.when(F.col("block") >= 0, F.array_intersect("pairs", all_pairs)))
    share = F.transform(template, lambda t: F.struct((F.size(F.array_intersect(t["needed"], F.col("known"))) / F.size(t["needed"])).alias("share"), t["family"].alias("family"), t["template"].alias("template")))
    runs = runs.withColumn("matches", F.when(F.size("known") >= fewest, F.filter(share, lambda m: m["share"] >= overlap)))
    grams = F.array_distinct(F.concat("words", "pairs"))
    grams = F.when(F.col("block") < 0, F.array(F.lit(""))).when(F.size("matches") > 0, F.when(F.col("whole"), F.array_intersect(grams, parts)).otherwise(grams))
    seen = runs.select("doc_id", "row", "block", "paragraph", "whole", "matches", F.explode_outer(grams).alias("gram")).where("gram is not null")
    hits = seen.join(F.broadcast(model.features), "gram")  # bounded by the vocabulary and the templates
    scored = hits.groupBy("row", "doc_id", "block", "paragraph", "whole").agg(
        F.first("matches").alias("matches"), F.array(*(F.sum(F.col("weights")[k]) + c for k, c in enumerate(model.constants))).alias("logits")
    )
    scored = scored.withColumn("z", F.array_max("logits")).withColumn("probability", 1 / _partition(F.col("logits"), F.col("z"), model.temperature))
    scored = scored.withColumn("family", F.get(F.array(*map(F.lit, CLASSES)), (F.array_position("logits", F.col("z")) - 1).cast("int")))
    # the template of the family with the largest share, and the largest share of any family
    own = F.array_max(F.filter("matches", lambda m: m["family"] == F.col("family")))
    scored = scored.withColumn("own", own).withColumn("top", F.array_max(F.transform("matches", lambda m: m["share"])))
    place = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("family"))
    confirmed = F.when(
        (F.col("probability") >= model.cut) & (F.col("own.share") >= F.col("top")),
        F.struct("probability", F.col("own.share").alias("share"), (-F.col("paragraph")).alias("back"), (-place).alias("place"), "family", F.col("own.template").alias("template")),
    )
    per_doc = scored.groupBy("row", "doc_id").agg(
        F.collect_list(F.when(~F.col("whole"), F.struct("block", confirmed.alias("found")))).alias("lines"), F.collect_list(F.when(F.col("whole"), F.struct("block", confirmed.alias("found")))).alias("wholes"),
    )
    kept = lambda some: F.filter(some, lambda x: x["found"].isNotNull())
    per_doc = per_doc.select("row", "doc_id", kept("lines").alias("lines"), kept("wholes").alias("wholes"))
    # a family that one of the lines of a run gives is not given by the run again
    more = F.filter("wholes", lambda r: ~F.exists("lines", lambda x: (x["block"] == r["block"]) & (x["found"]["family"] == r["found"]["family"])))
    per_doc = per_doc.select("doc_id", F.transform(F.concat("lines", more), lambda x: x["found"]).alias("lines"))
    per_doc = per_doc.select("doc_id", F.array_sort(F.array_distinct(F.transform("lines", lambda x: x["family"]))).alias("licences"), F.size("lines").cast("long").alias("n_paragraphs"), F.array_max("lines").alias("best"))
    return per_doc.select(
        "doc_id", "licences", "n_paragraphs", F.coalesce("best.family", F.lit(UNKNOWN)).alias("family"), F.col("best.probability").alias("probability"),
        F.col("best.template").alias("template"), F.col("best.share").alias("template_share"), (-F.col("best.back")).alias("paragraph"),
    )
