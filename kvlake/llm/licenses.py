"""License scan: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are lines, after lines that a sentence was wrapped over are joined again. Those with a
license term are classified by a sparse softmax regression over distinct word n-grams (one to three
words), trained here on template paragraphs, shortened and thinned variants of them, general license
statements (the unknown class) and plain sentences. Temperature and least probability are calibrated
on whole families that models trained without them judge: such texts belong to the unknown class, and
below `least` a family is unknown. A family is confirmed when enough of the paragraph's n-grams stand
in one of its templates, one of them in no other family's; what isn't confirmed is unknown as well.
Besides the whole line, the stretches of its sentences that templates have words in common with are
classified, so that a statement isn't lost in a long line; a stretch counts only when it is confirmed
and holds enough of the template. Scoring and comparison are joins and sums of Spark SQL against two
tables whose size the templates fix; only training runs on the driver.

Null and empty texts, and texts without a license term, have license `none`. Of several families the
one with the greatest probability is the license, ties go to the greater share and name; all are
listed. Very long texts and lines are read whole. Repeated rows are each judged. Columns besides
doc_id and text are not read, those of the result may clash with them. An empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_table

# Terms that a paragraph must hold to be looked at, as one pattern.
TERMS = r"(?i)licen[sc]|copyright|copyleft|redistribut|warrant|permission|public domain|rights reserved|creative commons|\bgnu\b|\bcc[ -](?:by|0)"

# Template paragraphs of each family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License. See LICENSE in the project root for license information.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "Released under the GNU GPL, version 2 or later.",
        "Licensed under the GNU General Public License v2.0.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Released under the GNU AGPL, version 3 or later.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Released under the zlib License.",
        "SPDX-License-Identifier: Zlib",
    ],
    "Artistic-2.0": [
        "Licensed under the Artistic License 2.0.",
        "This program is free software; you can redistribute it and/or modify it under the same terms as Perl itself.",
        "SPDX-License-Identifier: Artistic-2.0",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-ND": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "CC-BY-NC-SA": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC-ND": [
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ],
    "public-domain": [
        "This work is dedicated to the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
        "Copyright 2021 The Authors. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form without prior written permission of the publisher.",
    ],
}

# Statements of no known family, and sentences that only use the words.
UNKNOWN = [
    "Licensed under the terms of the Acme Software Agreement.",
    "Released under a custom license.",
    "See the license file for terms of use.",
    "This work is licensed under the terms stated by its author.",
    "Use of this text is subject to a separate license agreement.",
    "Distributed under the Foo Public License, version 1.",
    "The copyright holder grants a limited license to readers of this page.",
    "Copyright by the author.",
    "Provided without warranty under the license of the vendor.",
    "Licensed to subscribers under contract.",
    "This work is licensed under the GNU Free Documentation License, version 1.3.",
    "Licensed under the Microsoft Public License.",
    "Licensed under the European Union Public License, version 1.2.",
    "Released under the SIL Open Font License.",
    "Licensed under the terms of the vendor's commercial license, version 3.",
]
PLAIN = [
    "The driver lost his license after the accident.",
    "A fishing license costs twelve dollars a year.",
    "Copyright law was discussed at length in the meeting.",
    "She gave permission for the trip and went home.",
    "The police had a warrant to search the house.",
    "The state may redistribute the land among farmers.",
    "He asked for permission to leave the room.",
    "The new version of the program was released in May.",
    "There is no warranty on the used car he sold.",
    "The pub got its licence to sell beer in the spring.",
    "Students need the permission of both parents.",
    "A gnu is a large animal of the plains.",
    "The song fell into the public domain and everybody played it.",
    "The general of the army spoke in public about the law.",
    "The work of the foundation is free and open to the public.",
]

#: A line end within a sentence: after a small letter or comma, before a letter, bracket or quote.
WRAPPED = r"(?<=[a-z,])[ \t]*\r?\n[ \t]*(?:[#*]|//)?[ \t]*(?=[A-Za-z(\"'])"

_WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
NONE, OTHER = "none", "unknown"
#: Words between two known word pairs of one stretch: none, and as many as a name has.
GAPS = (0, 3)
#: n-grams of a template that are asked for in a stretch at most before the share of them is taken: long templates may be cut.
MOST_ASKED = 24


def ngrams(text: str) -> set[str]:
    w = re.findall(_WORD, text.lower())
    return {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}


def _variants(text: str, rng: np.random.Generator, n: int) -> list[str]:
    """The paragraph's beginnings and thinned forms, with strange words around some."""
    w, out = text.split(), [text]
    for i in range(n):
        part = w[: max(min(len(w), 4), int(len(w) * rng.uniform(0.6, 1.0)))]
        part = [x for x in part if rng.random() > 0.08] or w
        if i % 3 == 0:
            part = [f"x{k}" for k in rng.integers(0, 99, rng.integers(1, 4))] + part
        out.append(" ".join(part))
    return out


class Model:
    def __init__(self, classes, vocabulary, weights, bias, temperature):
        self.classes, self.vocabulary, self.weights, self.bias, self.temperature = classes, vocabulary, weights, bias, temperature

    def logits(self, text: str) -> np.ndarray:
        return self.weights[[self.vocabulary[g] for g in ngrams(text) if g in self.vocabulary]].sum(0) + self.bias

    def probabilities(self, text: str) -> np.ndarray:
        return _soft(self.logits(text)[None] / self.temperature)[0]


def _soft(logit: np.ndarray) -> np.ndarray:
    e = np.exp(logit - logit.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(families: tuple[str, ...], rounds: int, seed: int = 11, rate: float = 0.5, decay: float = 1e-3):
    """A model of these families at temperature 1, with logits and classes of variants that trained nothing."""
    rng = np.random.default_rng(seed)
    classes = [NONE, OTHER, *families]
    rows = [(v, classes.index(f)) for f in families for t in TEMPLATES[f] for v in _variants(t, rng, 8)]
    rows += [(v, 1) for t in UNKNOWN for v in _variants(t, rng, 8)] + [(v, 0) for t in PLAIN for v in _variants(t, rng, 4)]
    held = rng.random(len(rows)) < 0.2
    vocabulary: dict[str, int] = {}
    for (t, _), h in zip(rows, held):
        if not h:
            for g in sorted(ngrams(t)):
                vocabulary.setdefault(g, len(vocabulary))
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, (t, _) in enumerate(rows):
        x[i, [vocabulary[g] for g in ngrams(t) if g in vocabulary]] = 1
    y = np.eye(len(classes), dtype=np.float32)[[c for _, c in rows]]
    w, b = np.zeros((x.shape[1], len(classes)), np.float32), np.zeros(len(classes), np.float32)
    a, z = x[~held], y[~held]
    weigh = (len(a) / (len(classes) * np.maximum(1, z.sum(0))))[z.argmax(1)][:, None]
    scale = 1 / np.sqrt(a.sum(1, keepdims=True))  # long paragraphs don't drown short ones
    for _ in range(rounds):
        g = (_soft(a @ w + b) - z) * weigh * scale / len(a) * 20
        w -= rate * (a.T @ g + decay * w)
        b -= rate * g.sum(0)
    return Model(classes, vocabulary, w, b, 1.0), x[held] @ w + b, y[held].argmax(1)


def sole_grams(families) -> dict[str, set[str]]:
    """Of each family the n-grams that no other family, unknown statement or plain sentence holds."""
    grams = {f: set().union(*map(ngrams, TEMPLATES[f])) for f in families}
    counts = Counter(g for gs in [*grams.values(), set().union(*map(ngrams, UNKNOWN)), set().union(*map(ngrams, PLAIN))] for g in gs)
    return {f: {g for g in gs if counts[g] == 1} for f, gs in grams.items()}


def confirmable(text: str, family: str, sole: dict, overlap: float) -> bool:
    """Whether comparison with the family's templates would confirm it for a whole line."""
    own = ngrams(text)
    return bool(own & sole[family]) and max(len(own & ngrams(t)) for t in TEMPLATES[family]) >= overlap * len(own)


@lru_cache
def calibration(folds: int = 4, rounds: int = 120, overlap: float = 0.5, wrong: float = 0.01) -> tuple[float, float]:
    """(temperature, least probability), by families that the judging model never saw.

    The temperature gives the least loss over such texts (class unknown) and held-out variants of
    known ones; at the least probability no more than `wrong` of the unseen are confirmed.
    """
    families = list(TEMPLATES)
    logits, truth, unseen = [], [], []
    for k in range(folds):
        known = tuple(f for i, f in enumerate(families) if i % folds != k)
        model, held, classes = fit(known, rounds)
        sole = sole_grams(known)
        texts = [t for f in families[k::folds] for t in TEMPLATES[f]]
        z = np.stack([model.logits(t) for t in texts])
        unseen += [(z[i], confirmable(t, model.classes[j], sole, overlap) if (j := int(z[i].argmax())) > 1 else False) for i, t in enumerate(texts)]
        logits += [*held, *z]
        truth += [*classes, *[1] * len(texts)]
    grid = np.linspace(0.3, 8, 78)
    loss = [-np.mean([np.log(_soft(z[None] / t)[0, c] + 1e-9) for z, c in zip(logits, truth)]) for t in grid]
    heat = float(grid[int(np.argmin(loss))])
    sure = sorted((_soft(z[None] / heat)[0].max() for z, ok in unseen if ok), reverse=True)
    allowed = int(wrong * len(unseen))
    return heat, max(0.5, min(0.9, float(sure[allowed]) + 1e-6)) if len(sure) > allowed else 0.5


@lru_cache
def train(rounds: int = 300) -> Model:
    model, _, _ = fit(tuple(TEMPLATES), rounds)
    model.temperature = calibration()[0]
    return model


def _grams(words):
    """Distinct n-grams of one to three words of an array column, as SQL."""
    return F.expr(
        f"array_distinct(concat({words}, "
        f"case when size({words}) > 1 then transform(sequence(1, size({words}) - 1), i -> concat_ws(' ', slice({words}, i, 2))) else array() end, "
        f"case when size({words}) > 2 then transform(sequence(1, size({words}) - 2), i -> concat_ws(' ', slice({words}, i, 3))) else array() end))"
    )


def _stretches(words: str, hits: str) -> str:
    """The runs of an array of words in which known pairs begin at the sorted places `hits`, as SQL."""

    def cut(gap: int) -> str:
        first = f"filter({hits}, (x, i) -> coalesce(x - get({hits}, i - 1) > {gap + 2}, true))"
        last = f"filter({hits}, (x, i) -> coalesce(get({hits}, i + 1) - x > {gap + 2}, true))"
        return f"zip_with({first}, {last}, (a, b) -> slice({words}, a + 1, b - a + 2))"

    return f"array_distinct(concat({', '.join(map(cut, GAPS))}))"


def scan(docs: DataFrame, least: float | None = None, overlap: float = 0.5) -> DataFrame:
    """doc_id, license, probability, template_overlap, n_paragraphs, families: one row per row of docs.

    license is the surest confirmed family, else unknown if a paragraph states a license, else none.
    least: the calibrated one unless given.
    """
    least = calibration()[1] if least is None else least
    spark = docs.sparkSession
    scratch = Scratch(spark, "licenses")
    model = train()
    names = [f"w{i}" for i in range(len(model.classes))]
    weights = F.broadcast(spark.createDataFrame([(g, *map(float, model.weights[i] / model.temperature)) for g, i in model.vocabulary.items()], "gram string, " + ", ".join(f"{n} double" for n in names)))
    texts = [(f, f"{f}/{k}", ngrams(t)) for f, ts in [*TEMPLATES.items(), (OTHER, UNKNOWN)] for k, t in enumerate(ts)]
    sole = sole_grams(TEMPLATES)
    templates = F.broadcast(spark.createDataFrame([(f, k, len(grams), g, g in sole.get(f, ())) for f, k, grams in texts for g in sorted(grams)], "family string, template string, size int, gram string, sole boolean"))
    pairs = F.broadcast(spark.createDataFrame([(g,) for g in sorted({g for *_, grams in texts for g in grams if g.count(" ") == 1})], "pair string"))

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    has = F.coalesce(F.col("text").rlike(TERMS), F.lit(False))
    lines = slim.where(has).select("doc_id", F.monotonically_increasing_id().alias("row"), F.split(F.regexp_replace("text", WRAPPED, " "), "\n").alias("lines"))
    lines = lines.select("doc_id", "row", F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("par"), x.alias("line"))), lambda s: s["line"].rlike(TERMS)).alias("found"))
    held = scratch.write(lines, "lines")
    found = held.select("row", F.explode("found").alias("f")).select("row", F.col("f.par").alias("par"), F.col("f.line").alias("line"))
    split = lambda c: F.regexp_extract_all(F.lower(c), F.lit(f"({_WORD})"), F.lit(1)).alias("words")
    whole = found.select("row", "par", F.lit("").alias("piece"), split("line"))
    sentences = found.select("row", "par", F.posexplode(F.split("line", r"(?<=[.!?;])\s+")).alias("sentence", "said")).select("row", "par", "sentence", split("said"))
    sentences = scratch.write(sentences.where(F.size("words") > 1), "sentences")
    following = F.expr("transform(sequence(1, size(words) - 1), i -> concat_ws(' ', slice(words, i, 2)))")
    hits = sentences.select("row", "par", "sentence", F.posexplode(following).alias("at", "pair")).join(pairs, "pair").groupBy("row", "par", "sentence").agg(F.sort_array(F.collect_set("at")).alias("hits"))
    pieces = sentences.join(hits, ["row", "par", "sentence"]).select("row", "par", "sentence", F.posexplode(F.expr(_stretches("words", "hits"))).alias("k", "words"))
    pieces = pieces.where(F.array_join("words", " ").rlike(TERMS)).select("row", "par", F.concat_ws("/", "sentence", "k").alias("piece"), "words")
    grams = scratch.write(whole.unionByName(pieces).select("row", "par", "piece", _grams("words").alias("grams")), "grams")

    each = grams.select("row", "par", "piece", F.explode("grams").alias("gram"))
    sums = each.join(weights, "gram").groupBy("row", "par", "piece").agg(*[F.sum(n).alias(n) for n in names])
    logits = F.array(*[F.coalesce(n, F.lit(0.0)) + float(b) / model.temperature for n, b in zip(names, model.bias)])
    scored = grams.select("row", "par", "piece", F.size("grams").alias("n")).join(sums, ["row", "par", "piece"], "left").select("row", "par", "piece", "n", logits.alias("z"))
    scored = scored.withColumn("e", F.transform("z", lambda v: F.exp(v - F.array_max("z"))))
    scored = scored.withColumn("p", F.array_max("e") / F.aggregate("e", F.lit(0.0), lambda s, v: s + v))
    classes = F.array(*map(F.lit, model.classes))
    scored = scored.withColumn("family", F.element_at(classes, F.array_position("e", F.array_max("e")).cast("int"))).select("row", "par", "piece", "n", "p", "family")
    asked = F.col("same") >= overlap * F.least("size", F.lit(MOST_ASKED))
    like = each.join(templates, "gram").groupBy("row", "par", "piece", "family", "template", "size").agg(F.count("*").alias("same"), F.bool_or("sole").alias("sole"))
    like = like.groupBy("row", "par", "piece", "family").agg(F.max("same").alias("same"), F.bool_or("sole").alias("sole"), F.bool_or(asked & F.col("sole")).alias("enough"))
    judged = scored.where(F.col("family") != NONE).join(like, ["row", "par", "piece", "family"], "left")
    alone = F.col("piece") == ""
    share = F.coalesce(F.col("same"), F.lit(0)) / F.col("n")
    likely = (F.col("p") >= least) & (share >= overlap)
    sure = (F.col("family") != OTHER) & likely & F.coalesce(F.col("sole"), F.lit(False))
    judged = judged.where(alone | (likely & F.col("enough"))).select("row", "par", F.when(sure, F.col("family")).otherwise(OTHER).alias("family"), sure.alias("sure"), "p", F.when(F.col("family") != OTHER, share).otherwise(0.0).alias("share"))
    lines = judged.groupBy("row", "par").agg(F.max(F.struct("sure", "p", "share", "family")).alias("top"), F.collect_set(F.when(F.col("sure"), F.col("family"))).alias("stated"))
    stated = F.when(F.size("stated") > 0, F.col("stated")).otherwise(F.array(F.lit(OTHER)))
    best = lines.groupBy("row").agg(
        F.max("top").alias("top"),
        F.count("*").alias("n_paragraphs"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(stated)))), ",").alias("families"),
    )
    found = held.select("doc_id", "row").join(best, "row", "left").select(
        "doc_id",
        F.coalesce(F.col("top.family"), F.lit(NONE)).alias("license"),
        F.col("top.p").alias("probability"),
        F.col("top.share").alias("template_overlap"),
        F.coalesce("n_paragraphs", F.lit(0)).cast("long").alias("n_paragraphs"),
        F.coalesce("families", F.lit("")).alias("families"),
    )
    empty = [F.lit(NONE), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(0).cast("long"), F.lit("")]
    rest = slim.where(~has).select("doc_id", *[c.alias(n) for c, n in zip(empty, found.columns[1:])])
    return found.unionByName(rest)


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))
