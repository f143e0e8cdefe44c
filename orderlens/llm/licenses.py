"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a line of at most ``WHOLE`` words; of a longer line each window of ``WINDOW`` words, half a
window apart, so that a notice is found at any place of it; and the words around each line break, so
that it is found where it is wrapped. Words of the templates and confusers, and neighbouring
pairs of them, are the sparse features of a multinomial logistic regression (``pyspark.ml``) over the licence
families of ``TEMPLATES`` and the class ``unknown``. It is trained on the template paragraphs, on cut versions
of them, on sentences that only speak about licences, and on at most ``negatives`` paragraphs of the corpus
itself that share under ``FEW`` of their word pairs with every template: first those that would be scored.
The unknown class is calibrated on a quarter of these rows that the fit never saw: the threshold that a
family's probability must reach is set so that at most ``false_rate`` of the negatives reach it.

A prediction is confirmed by one template of the family: the paragraph shares ``least`` of the pairs of the
shorter of the two, and some of the template's key pairs. Those hold a word that tells its family from most
others, such as a licence's name; without one, wording that many licences share proves nothing.

Only paragraphs with a key pair of a template or one of the ``ANCHORS`` are scored: no other can be
confirmed. Equal texts are scored once.

Everything is DataFrame functions and ``pyspark.ml``. Edge cases: null and empty texts have no
paragraphs. Repeated rows get repeated results. Rows without id are scanned. An empty table gives an
empty result. Very long texts and lines are read whole. Of families of equal chance the last by name is taken.
Other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm.common import pick, share
from orderlens.llm.pii import digest
from orderlens.session import cut_lineage

UNKNOWN = "unknown"
FEATURES, NEGATIVES, FALSE_RATE, LEAST, FEW = 1 << 13, 3000, 0.01, 0.6, 0.3
#: Words of a line that is taken whole, and of the windows of a longer one.
WHOLE, WINDOW = 32, 24

#: Opening and key sentences of well-known licences and usual notices, by family. Fixed values.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "The MIT License (MIT)",
        "SPDX-License-Identifier: MIT",
        "MIT License",
        "This project is distributed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache-2.0",
        "Released under the Apache License 2.0.",
        "Apache License Version 2.0, January 2004",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License version 2.",
        "Released under the GPL v3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Licensed under the 2-clause BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "mpl": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at the Mozilla site.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Released under the Creative Commons Attribution license.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Free for non-commercial use under the Creative Commons license.",
    ),
    "public-domain": (
        "This work is dedicated to the public domain.",
        "Released into the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This is free and unencumbered software released into the public domain.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright (c) the authors. All rights reserved.",
        "This document is proprietary and confidential; no part of it may be reproduced without written permission.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ),
}
#: Sentences that use the same words and grant nothing. Fixed values.
CONFUSERS = (
    "He renewed his driver license at the office last week.",
    "The pilot lost her license after the accident.",
    "A fishing license is required in this state.",
    "They asked for permission to leave the room.",
    "The warranty on the car expired in June.",
    "Copyright law was discussed in class on Monday.",
    "The Apache helicopter landed near the river.",
    "She studied at MIT before moving to Paris.",
    "The public domain debate went on for hours.",
    "Poetic license allows the writer to bend the rules.",
    "All seats are reserved for members of the club.",
    "The software was distributed on floppy disks.",
    "Human rights groups reserved judgement on the report.",
    "The company was licensed to sell alcohol.",
)
#: In lower case; every template paragraph has one of them. Fixed values.
ANCHORS = (
    "licen", "copyright", "warrant", "permission", "redistribut", "rights reserved", "public domain",
    "creative commons", "mozilla", "gpl", "proprietary", "prohibited", "obtain one at", "apache", "bsd",
)
LETTERS = r"[^\p{L}\p{N}]+"


def plain_words(text: str) -> list[str]:
    return [word for word in re.split(r"[\W_]+", text.lower()) if word]


def template_rows() -> list[tuple[int, str, list[str], list[str], list[str]]]:
    """(number, family, pairs, key pairs, key words) of each template.

    Its key words are those, numbers apart, that the fewest families use; a key pair holds one of them.
    """
    families = defaultdict(set)
    for family, texts in TEMPLATES.items():
        for text in texts:
            for word in plain_words(text):
                families[word].add(family)
    rows = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = plain_words(text)
            fewest = min(len(families[word]) for word in words if not word.isdigit())
            key = {word for word in words if not word.isdigit() and len(families[word]) == fewest}
            pairs = sorted(set(zip(words, words[1:])))
            keys = [" ".join(pair) for pair in pairs if key & set(pair)]
            rows.append((len(rows), family, [" ".join(pair) for pair in pairs], keys, sorted(key)))
    return rows


TEMPLATE_ROWS = template_rows()
KEY_PAIRS = sorted({pair for *_, keys, _ in TEMPLATE_ROWS for pair in keys})
KEY_WORDS = sorted({word for *_, words in TEMPLATE_ROWS for word in words})
VOCABULARY = sorted({word for texts in (*TEMPLATES.values(), CONFUSERS) for text in texts for word in plain_words(text)})
TEMPLATE_TYPE = "number int, family string, pairs array<string>, keys array<string>, words array<string>"


def tokens_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), LETTERS, -1), lambda word: word != "")


def pairs_of(tokens: Column) -> Column:
    """Pairs of neighbouring words; the word itself where there is one only."""
    following = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), following, lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(tokens) > 1, pairs).otherwise(tokens)


def with_grams(rows: DataFrame, text_col: str = "paragraph") -> DataFrame:
    """``rows`` with ``pairs_``, all distinct pairs of a paragraph, and ``grams_``, its features."""
    known = lambda gram: F.forall(F.split(gram, " "), lambda word: word.isin(VOCABULARY))
    split = rows.withColumn("tokens_", tokens_of(F.col(text_col)))
    paired = split.withColumn("pairs_", F.array_distinct(pairs_of(F.col("tokens_"))))
    return paired.withColumn("grams_", F.filter(F.concat("tokens_", "pairs_"), known)).drop("tokens_")


def compared(own: Column, pairs: Column) -> Column:
    """The number of pairs of the shorter one: of a paragraph, three at least, or of a template."""
    return F.least(F.size(pairs), F.greatest(F.size(own), F.lit(3)))


def confirmed_by(own: Column, template: Column, least: float) -> Column:
    both = F.size(F.array_intersect(own, template["pairs"]))
    keys = F.size(F.array_intersect(own, template["keys"]))
    enough = F.when(F.size(template["keys"]) > 3, 2).otherwise(1)
    return (both >= least * compared(own, template["pairs"])) & (keys >= enough)


def far_from_templates(pieces: DataFrame, few: float = FEW) -> DataFrame:
    """``pieces`` (paragraph, pairs_) that share less than ``few`` of their pairs with every template."""
    templates = pieces.sparkSession.createDataFrame(TEMPLATE_ROWS, TEMPLATE_TYPE)
    known = templates.select("number", "pairs", F.explode("pairs").alias("pair"))
    met = pieces.select("paragraph", "pairs_", F.explode("pairs_").alias("pair")).join(F.broadcast(known), "pair")
    size = F.first(compared(F.col("pairs_"), F.col("pairs")))
    near = met.groupBy("paragraph", "number").agg((F.count(F.lit(1)) / size).alias("shared")).where(F.col("shared") >= few)
    return pieces.join(near.select("paragraph").distinct(), "paragraph", "left_anti")


def units(rows: DataFrame, candidates: bool = False) -> DataFrame:
    """(the other columns, line, whole, paragraph) of ``rows`` with ``text``: the paragraphs of each text.

    ``whole`` tells the windows of a line from the words around the break after it. ``candidates`` leaves out
    all but the candidates, before a window becomes a row or a text.
    """
    others = [c for c in rows.columns if c != "text"]
    held = rows.select(*others, F.split(F.lower("text"), "\n", -1).alias("lines_"))
    held = held.select(*others, F.posexplode(F.arrays_zip(F.col("lines_").alias("now"), F.slice("lines_", 2, F.size("lines_")).alias("next"))).alias("line", "both_"))
    split = held.select(*others, "line", tokens_of(F.col("both_.now")).alias("now_"), tokens_of(F.substring(F.coalesce("both_.next", F.lit("")), 1, 40 * WINDOW)).alias("next_"))
    half = WINDOW // 2
    windows = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("now_") - half, F.lit(1)), F.lit(half)), lambda i: F.struct(F.lit(True).alias("whole"), F.slice("now_", i, WINDOW).alias("words"))
    )
    single = F.array(F.struct(F.lit(True).alias("whole"), F.col("now_").alias("words")))
    end = F.slice("now_", F.greatest(F.size("now_") - half + 1, F.lit(1)), half)
    around = F.struct(F.lit(False).alias("whole"), F.concat(end, F.slice("next_", 1, half)).alias("words"))
    wrapped = F.when((F.size("now_") > 0) & (F.size("next_") > 0), F.array(around)).otherwise(F.array().cast("array<struct<whole:boolean,words:array<string>>>"))
    parts = F.concat(F.when(F.size("now_") > WHOLE, windows).otherwise(single), wrapped)
    kept = F.filter(parts, lambda part: candidate(part["words"])) if candidates else parts
    each = split.select(*others, "line", F.explode(kept).alias("part_"))
    return each.select(*others, "line", "part_.whole", F.array_join("part_.words", " ").alias("paragraph")).where("paragraph != ''")


def candidate(told: Column) -> Column:
    """Whether the words of a paragraph have a key pair of a template or an anchor."""
    keyed = F.exists(told, lambda word: word.isin(KEY_WORDS)) & F.exists(pairs_of(told), lambda pair: pair.isin(KEY_PAIRS))
    return keyed | F.array_join(told, " ").rlike("|".join(ANCHORS))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Candidate paragraphs (h1_, h2_, line, whole, paragraph) of distinct texts; and all rows (doc_id, h1_, h2_)."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    found = units(rows.select(*digest(F.col("text")), "text"), candidates=True)
    return found.distinct(), rows.select("doc_id", *digest(F.col("text")))


def training_rows(spark: SparkSession, docs: DataFrame, negatives: int, id_col: str, text_col: str) -> DataFrame:
    """(family, paragraph, copy): templates and confusers whole and cut, paragraphs of the corpus.

    Of a cut version about a tenth of the words are missing; which ones follows from a hash. The
    paragraphs of the corpus are at most ``negatives``, from about as many texts drawn by hash.
    """
    known = [(family, text) for family, texts in TEMPLATES.items() for text in texts]
    rows = spark.createDataFrame(known + [(UNKNOWN, text) for text in CONFUSERS], "family string, paragraph string")
    copies = rows.select("family", "paragraph", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("copy"))
    stays = lambda word, i: (F.col("copy") < 4) | (share(F.col("paragraph"), F.col("copy"), i) >= 0.1)
    cut = copies.withColumn("paragraph", F.array_join(F.filter(F.split("paragraph", " "), stays), " "))
    texts = pick(docs, doc_id=id_col, text=text_col).where("text is not null")
    total = texts.count()
    sampled = texts.where(share(F.col("doc_id"), F.lit(10)) * total < negatives).select("text")
    pieces = with_grams(units(sampled).select("paragraph").distinct()).withColumn("candidate_", candidate(F.split("paragraph", " ")))
    far = far_from_templates(cut_lineage(pieces))
    drawn = far.orderBy(F.desc("candidate_"), F.xxhash64("paragraph"), "paragraph").limit(negatives)
    ordinary = drawn.select(F.lit(UNKNOWN).alias("family"), "paragraph", (F.crc32("paragraph") % 16).cast("int").alias("copy"))
    return cut.unionByName(ordinary)


def learn(docs: DataFrame, negatives: int = NEGATIVES, false_rate: float = FALSE_RATE, id_col: str = "doc_id", text_col: str = "text") -> tuple[PipelineModel, float]:
    """The fitted classifier and the probability that a family must reach.

    Copies 12 to 15 are held out from the fit and set the threshold.
    """
    rows = with_grams(cut_lineage(training_rows(docs.sparkSession, docs, negatives, id_col, text_col)))
    stages = [
        StringIndexer(inputCol="family", outputCol="label_", stringOrderType="alphabetAsc", handleInvalid="keep"),
        HashingTF(inputCol="grams_", outputCol="features_", numFeatures=FEATURES, binary=True),
        LogisticRegression(featuresCol="features_", labelCol="label_", probabilityCol="chances_", regParam=1e-3, maxIter=60, family="multinomial"),
    ]
    model = Pipeline(stages=stages).fit(rows.where("copy < 12"))
    held = predicted(rows.where(F.col("copy") >= 12).withColumn("truth_", F.col("family")).drop("family"), model)
    level = held.where(F.col("truth_") == UNKNOWN).agg(F.percentile("chance", 1 - false_rate)).first()[0]
    return model, max(0.5, min(0.95, level or 0.0))


def predicted(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """``rows`` (with grams) with ``family``, the likeliest licence, and its ``chance``."""
    names = model.stages[0].labels
    chances = model.stages[2].transform(model.stages[1].transform(rows)).withColumn("all_", vector_to_array("chances_"))
    known = [F.struct(F.get("all_", F.lit(i)).alias("chance"), F.lit(name).alias("family")) for i, name in enumerate(names) if name != UNKNOWN]
    best = chances.withColumn("best_", F.array_max(F.array(*known)))
    return best.select(*rows.columns, F.col("best_.family").alias("family"), F.col("best_.chance").alias("chance"))


def scanned(docs: DataFrame, model: PipelineModel, threshold: float, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, families (sorted, comma-joined), n_confirmed, n_unknown, chance.

    ``n_confirmed`` counts the lines in which, or from which on, a family is confirmed; ``n_unknown`` those with
    candidates and none confirmed.
    """
    spark = docs.sparkSession
    found, rows = paragraphs(docs, id_col, text_col)
    templates = spark.createDataFrame(TEMPLATE_ROWS, TEMPLATE_TYPE).groupBy("family").agg(F.collect_list(F.struct("pairs", "keys")).alias("known_"))
    scored = predicted(with_grams(found), model).join(F.broadcast(templates), "family")  # a row for each family
    proven = F.exists("known_", lambda template: confirmed_by(F.col("pairs_"), template, least))
    judged = scored.withColumn("confirmed", (F.col("chance") >= threshold) & proven)
    lines = judged.groupBy("h1_", "h2_", "line").agg(
        F.collect_set(F.when(F.col("confirmed"), F.col("family"))).alias("families"),
        F.max("whole").alias("whole"),
        F.max("chance").alias("chance"),
    )
    each = lines.groupBy("h1_", "h2_").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("families")))).alias("families"),
        F.sum((F.size("families") > 0).cast("long")).alias("n_confirmed"),
        F.sum(((F.size("families") == 0) & F.col("whole")).cast("long")).alias("n_unknown"),
        F.max("chance").alias("chance"),
    )
    return rows.join(each, ["h1_", "h2_"], "left").select(
        "doc_id",
        F.coalesce(F.array_join("families", ","), F.lit("")).alias("families"),
        F.coalesce("n_confirmed", F.lit(0).cast("long")).alias("n_confirmed"),
        F.coalesce("n_unknown", F.lit(0).cast("long")).alias("n_unknown"),
        F.coalesce("chance", F.lit(0.0)).alias("chance"),
    )


def op10_licenses(spark, folder: str) -> DataFrame:
    """Licence families of all documents."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return scanned(docs, *learn(docs))
