"""License scans by a trained paragraph classifier, in DataFrame functions only.

A paragraph is a stretch of lines without an empty one between them.  A notice may be a
line of it or be wrapped over several, so its lines are scored one by one and, where a
family's notice may be in the paragraph but in no line alone, in windows of lines joined.
The features are distinct word 1- and 2-grams; a multinomial logistic regression over
them says which license family is granted, or none.  It is trained on the driver from the
notices below, from usual sentences that name a license, and from sentences that only
sound alike (the unknown class); a fifth of the sentences is held out to
measure it, and trained on in the end.  Its temperature is
calibrated by cross-validation, so that the probability of a family can be held against
a threshold.  A prediction counts once the text holds enough of one of the family's
notices.

Lines without a word of a feature go no further.  N-grams of the others meet the features
(a table of bounded size) in a broadcast join, and what is exchanged is the features'
numbers and sums, a row a line.  A text that holds enough of a notice has one of its
anchors, the rarest features, so paragraphs without an anchor need no windows.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.scratch import materialize

UNKNOWN = "unknown"

# Notices of public licenses, by family, as files and headers have them.
NOTICES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "mit": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "You should have received a copy of the GNU General Public License along with this program",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    ),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "eupl": ("Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL (the Licence)",),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    ),
    "cc-by-sa": (
        "Text is available under the Creative Commons Attribution-ShareAlike 4.0 License",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "This article is distributed under the terms of the Creative Commons Attribution License, which permits unrestricted use, distribution and reproduction in any medium",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal",
        "This work is dedicated to the public domain under CC0",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary",
    ),
    "proprietary": (
        "All rights reserved",
        "All rights reserved. No part of this publication may be reproduced without prior written permission",
        "Copyright reserved by the publisher. Unauthorized copying is strictly prohibited",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited",
    ),
}
# How sentences name the licenses of a family.
NAMES = {
    "apache": ("the Apache License, Version 2.0", "the Apache 2.0 license", "Apache License 2.0", "Apache-2.0"),
    "mit": ("the MIT License", "the MIT software license", "the Expat license", "MIT"),
    "bsd": ("the BSD 3-Clause License", "the BSD 2-Clause License", "the BSD license", "BSD-3-Clause"),
    "isc": ("the ISC License", "ISC"),
    "gpl": ("the GNU General Public License, version 3", "the GNU General Public License version 2", "GNU GPL v2", "the GPL v3", "GPL-3.0-or-later", "GPL-2.0-only"),
    "lgpl": ("the GNU Lesser General Public License, version 3", "the GNU LGPL", "the LGPL v3", "LGPL-2.1-only"),
    "agpl": ("the GNU Affero General Public License, version 3", "the GNU AGPL", "the AGPL v3", "AGPL-3.0-only"),
    "mpl": ("the Mozilla Public License 2.0", "the MPL 2.0", "MPL-2.0"),
    "epl": ("the Eclipse Public License 2.0", "the EPL", "EPL-2.0"),
    "eupl": ("the European Union Public Licence", "the EUPL", "EUPL-1.2"),
    "cc-by-nc": ("CC BY-NC 4.0", "CC BY-NC-SA 4.0", "the Creative Commons Attribution-NonCommercial license", "CC-BY-NC-4.0"),
    "cc-by-sa": ("CC BY-SA 4.0", "CC BY-SA 3.0", "the Creative Commons Attribution-ShareAlike license", "CC-BY-SA-4.0"),
    "cc-by": ("CC BY 4.0", "CC BY 3.0", "the Creative Commons Attribution license", "CC-BY-4.0"),
    "cc0": ("CC0 1.0", "the CC0 public domain dedication", "CC0-1.0"),
    "unlicense": ("the Unlicense", "Unlicense"),
}
# The sentences.
FRAMES = (
    "Licensed under {}",
    "Released under {}",
    "Distributed under {}",
    "Available under {}",
    "Published under {}",
    "This project is licensed under the terms of {}",
    "This work is licensed under {}",
    "The code is provided under {}",
    "SPDX-License-Identifier: {}",
    "License: {}",
)
# Sentences that share words with the notices but grant nothing.
ALIKE = (
    "He renewed his driver license at the office",
    "The apache tribe lived in the south",
    "She studied at MIT and wrote software",
    "Version 2.0 of the program was slower than version 3",
    "The general public was not permitted to enter",
    "The work is done and the source of the river was found",
    "Creative people use common tools in their work",
    "The license plate of the car was copied",
    "A fishing license is free of charge in this state",
    "The library is open to the public on Mondays",
    "The foundation published a general report on software",
    "You may use the file to cut the metal",
    "The new version was released under pressure",
    "The domain of the function is the real line",
    "The following conditions are met in most cases",
    "The gnu is a large antelope of the African plains",
    "Attribution of the painting to the master is doubtful",
    "Mozilla released a new version of the browser",
    "Permission to enter was granted to the visitors",
    "The copyright office opened a new branch",
    "Rights and duties of the citizens are public",
    "The source code was lost and the binary did not run",
    "Apache helicopters were released in the second version",
    "The people distributed food under the bridge",
    "This project is available in the terms that we agreed",
    "The driver was licensed in June and published a book",
    "His work is provided with a copy of the notice",
    "Conditions in the binary star are not known",
    "The code of the building was modified without restriction by the mayor",
    "All seats are reserved and the rights of guests are kept",
    "A version of the law was published in the European press",
    "The eclipse was seen by the general public",
    "The author waived the fee for this publication",
    "Free software is used in schools",
    "You can buy a copy of the book and sell it",
    "The person to whom the letter was sent is gone",
    "Permission to use the road was granted with fee",
    "The notice appeared in all papers",
    "The union has common rules for a licence to fish",
)
# Words that make no feature by themselves or in pairs.
STOP = frozenset(
    "a all along and any are as at be been but by can did for found free from has have he her his i in into is it its may most "
    "new no not of on or part person she should than that the their this to under use was were which with without you your".split()
)

WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
STEPS, RATE, RIDGE, FOLDS = 250, 0.3, 0.003, 4
#: One sentence in so many is held out.
HELD_OUT = 5
#: A family is predicted from this probability on, and confirmed from this share of a notice's features on.
LEAST_CHANCE, LEAST_SHARE = 0.5, 0.6


def words_of(line: str) -> list[str]:
    """The words of a line, as the queries take them."""
    return re.findall(WORD, line.lower())


def features_of(words: list[str]) -> set[str]:
    """Distinct 1- and 2-grams with a word outside STOP."""
    pairs = {f"{a} {b}" for a, b in zip(words, words[1:]) if a not in STOP or b not in STOP}
    return pairs | {w for w in words if w not in STOP}


def sentences() -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(text, family) to train on, and held out."""
    named = [(frame.format(name), family) for family, names in NAMES.items() for name in names for frame in FRAMES]
    out: tuple[list, list] = ([(t, family) for family, texts in NOTICES.items() for t in texts], [])
    for t, family in [*named, *((t, UNKNOWN) for t in ALIKE)]:
        out[crc32(t.encode()) % HELD_OUT == 0].append((t, family))
    return out


def _train(rows: list[list[int]], labels: list[int], features: int, classes: int) -> np.ndarray:
    """Weights (features and the bias, classes) of a ridge softmax regression, by AdaGrad over all rows."""
    owner = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])
    flat = np.array([g for r in rows for g in [*r, features]])
    by_feature = np.argsort(flat, kind="stable")
    known, starts = np.unique(flat[by_feature], return_index=True)
    ends = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    truth, own = np.eye(classes)[labels], owner[by_feature]
    weights, squares = np.zeros((features + 1, classes)), np.full((features + 1, classes), 1e-8)
    for _ in range(STEPS):
        scores = np.add.reduceat(weights[flat], ends)
        chances = np.exp(scores - scores.max(axis=1, keepdims=True))
        error = chances / chances.sum(axis=1, keepdims=True) - truth
        gradient = RIDGE * weights
        gradient[known] += np.add.reduceat(error[own], starts)
        squares += gradient**2
        weights -= RATE * gradient / np.sqrt(squares)
    return weights


@dataclass(frozen=True)
class Classifier:
    """Weights over features per class (in billionths), biases, the temperature, and the notices by features."""

    classes: tuple[str, ...]
    weights: dict[str, list[int]]
    bias: list[int]
    heat: float
    #: Of each family the sets of features of its notices, and of each feature the families as bits whose anchor it is.
    notices: dict[str, list[list[int]]]
    anchors: dict[str, int]
    numbers: dict[str, int] = field(repr=False)

    def chances(self, own: set[str]) -> dict[str, float]:
        """Probability of every class for a set of features."""
        sums = [(sum(w) / 1e9 + b / 1e9) / self.heat for w, b in zip(zip(*([0] * len(self.classes), *(self.weights[f] for f in own if f in self.weights))), self.bias)]
        top = max(sums)
        total = sum(math.exp(s - top) for s in sums)
        return {c: math.exp(s - top) / total for c, s in zip(self.classes, sums)}

    def share(self, family: str, own: set[str]) -> float:
        """Of the family's notices, the largest share of features among some."""
        ids = {self.numbers[f] for f in own if f in self.numbers}
        return max(len(ids.intersection(n)) / len(n) for n in self.notices[family])


def fit(texts: list[tuple[str, str]]) -> Classifier:
    """A classifier trained on (text, family), with all notices and sentences to compare with."""
    classes = (*NOTICES, UNKNOWN)
    known = [(features_of(words_of(t)), family) for part in sentences() for t, family in part]
    sets = [features_of(words_of(t)) for t, _ in texts]
    numbers = {f: i for i, f in enumerate(sorted(set().union(*sets, *(own for own, _ in known))))}
    rows, labels = [sorted(numbers[f] for f in own) for own in sets] + [[]] * 4, [classes.index(k) for _, k in texts] + [len(NOTICES)] * 4
    held, order = [], np.random.default_rng(7).permutation(len(rows))
    for fold in range(FOLDS):
        left, out = [i for i in order if i % FOLDS != fold], [i for i in order if i % FOLDS == fold]
        weights = _train([rows[i] for i in left], [labels[i] for i in left], len(numbers), len(classes))
        held += [(weights[[*rows[i], len(numbers)]].sum(axis=0), labels[i]) for i in out]
    scores, truth = np.array([s for s, _ in held]), np.array([y for _, y in held])

    def loss(heat: float) -> float:
        raised = np.exp((scores - scores.max(axis=1, keepdims=True)) / heat)
        return -float(np.log(np.maximum(1e-12, raised[np.arange(len(truth)), truth] / raised.sum(axis=1))).sum())

    weights = np.round(_train(rows, labels, len(numbers), len(classes)) * 1e9).astype(np.int64)
    often = Counter(f for own, _ in known for f in own)
    notices: dict[str, list[list[int]]] = {family: [] for family in NOTICES}
    anchors: Counter = Counter()
    for own, family in known:
        if family == UNKNOWN:
            continue
        notices[family].append(sorted(numbers[f] for f in own))
        # A text that lacks all of these has too little of the notice.
        for f in sorted(own, key=lambda f: (often[f], f))[: len(own) - math.ceil(LEAST_SHARE * len(own)) + 1]:
            anchors[f] |= 1 << classes.index(family)
    heat = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8), key=loss)
    return Classifier(classes, {f: weights[i].tolist() for f, i in numbers.items()}, weights[-1].tolist(), heat, notices, dict(anchors), numbers)


@lru_cache(maxsize=1)
def classifier() -> Classifier:
    """The classifier, trained once a process, on the held-out sentences too: the tests measure it without them."""
    learned, held_out = sentences()
    return fit(learned + held_out)


def _table(like: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    """A small table to be broadcast."""
    return F.broadcast(like.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>"))))


def _grams(words: Column) -> Column:
    """features_of as an array."""
    stop = F.array(*[F.lit(w) for w in sorted(STOP)])
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    kept = F.filter(pairs, lambda p: ~F.array_contains(stop, p["a"]) | ~F.array_contains(stop, p["b"]))
    joined = F.transform(kept, lambda p: F.concat_ws(" ", p["a"], p["b"]))
    return F.array_distinct(F.concat(F.filter(words, lambda w: ~F.array_contains(stop, w)), joined))


def _sums(model: Classifier) -> list[Column]:
    """Aggregates of the weights of all classes; whole numbers, so their order doesn't matter."""
    return [F.sum(F.col("weights")[i]).alias(f"s{i}") for i in range(len(model.classes))]


def _families(scored: DataFrame, keep: list[str], model: Classifier) -> DataFrame:
    """(keep, family, bit, chance, share) of rows with sums and ``gids`` that have a family; share: the largest of its notices'."""
    scores = F.array(*[(F.coalesce(F.col(f"s{i}"), F.lit(0)) + F.lit(model.bias[i])) / F.lit(1e9 * model.heat) for i in range(len(model.classes))])
    scored = scored.select(*keep, "gids", scores.alias("scores")).withColumn("top", F.array_max("scores"))
    chance = F.lit(1.0) / F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp(s - F.col("top")))
    found = scored.select(*keep, "gids", (F.array_position("scores", F.col("top")) - 1).cast("int").alias("number"), chance.alias("chance"))
    found = found.where((F.col("number") < len(model.classes) - 1) & (F.col("chance") >= LEAST_CHANCE))
    notices = _table(scored, [{"number": i, "family": c, "bit": 1 << i, "notices": model.notices[c]} for i, c in enumerate(model.classes[:-1])], "number:int,family:string,bit:bigint,notices:array<array<int>>")
    share = F.array_max(F.transform("notices", lambda n: F.size(F.array_intersect(n, "gids")) / F.size(n)))
    return found.join(notices, "number").select(*keep, "family", "bit", "chance", share.alias("share"))


def wrapped_notices(paragraphs: DataFrame, features: DataFrame, model: Classifier) -> DataFrame:
    """(__row, part, lines) -> (__row, part, family, chance): families that neighbouring lines confirm together.

    lines: (line, n, gids, crossing) with features, in order; n is its number of words and
    crossing the feature of the last word before it with its first.  A notice lies in a
    window of lines of which all but the first and last belong to it, so those have no
    more words than the longest notice, and few lines without features are among them.
    """
    most = max(len(words_of(t)) for texts in NOTICES.values() for t in texts)
    n = F.size("lines")
    first = paragraphs.select("*", F.explode(F.sequence(F.lit(1), n - 1)).alias("a"))
    windows = first.select("*", F.explode(F.sequence(F.col("a") + 1, F.least(n, F.col("a") + most + 1))).alias("b"))
    windows = windows.select("__row", "part", "a", "b", F.slice("lines", F.col("a"), F.col("b") - F.col("a") + 1).alias("lines"))
    inner = F.aggregate(F.slice("lines", 2, F.size("lines") - 2), F.lit(0), lambda s, x: s + x["n"])
    windows = windows.where((inner <= most) & (F.element_at("lines", -1)["line"] - F.col("lines")[0]["line"] <= 2 * F.size("lines")))
    crossing = F.transform(F.slice("lines", 2, F.size("lines") - 1), lambda x: x["crossing"])
    gids = F.array_compact(F.array_distinct(F.concat(F.flatten(F.transform("lines", lambda x: x["gids"])), crossing)))
    windows = windows.select("__row", "part", "a", "b", gids.alias("gids"))
    keys = ["__row", "part", "a", "b"]
    sums = windows.withColumn("gid", F.explode("gids")).join(features.select("gid", "weights"), "gid").groupBy(*keys).agg(*_sums(model), F.collect_set("gid").alias("gids"))
    sure = _families(sums, keys, model).where(F.col("share") >= LEAST_SHARE)
    return sure.groupBy("__row", "part", "family").agg(F.max("chance").alias("chance"))


def license_paragraphs(docs: DataFrame, model: Classifier | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with ``__row`` and n_paragraphs; (__row, part, family, chance, confirmed): a row per paragraph and family)."""
    model = model or classifier()
    content = F.array(*[F.lit(w) for w in sorted({w for f in model.weights for w in f.split(" ") if w not in STOP})])
    spelled = F.transform(
        F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), r"\n(?:[ \t\f\r\x0B]*\n)+", -1),
        lambda p: F.transform(F.split(p, "\n", -1), lambda line: F.regexp_extract_all(line, F.lit(WORD), F.lit(0))),
    )
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), F.col("doc_id").cast("bigint").alias("doc_id"), spelled.alias("parts"))
    none = F.array(F.array().cast("array<string>"))

    def lines_of(part: Column, nth: Column) -> Column:
        # A line with the one before it.
        pairs = F.zip_with(part, F.concat(none, F.slice(part, 1, F.greatest(F.size(part) - 1, F.lit(0)))), lambda x, before: F.struct(x.alias("words"), before.alias("before")))
        numbered = F.transform(pairs, lambda x, i: F.struct(nth.alias("part"), i.alias("line"), x["words"].alias("words"), F.try_element_at(x["before"], F.lit(-1)).alias("last")))
        return F.filter(numbered, lambda x: F.arrays_overlap(x["words"], content))

    some = F.flatten(F.transform("parts", lines_of))
    full = F.filter("parts", lambda p: F.exists(p, lambda x: F.size(x) > 0))
    rows = materialize(rows.select("__row", "doc_id", F.size(full).cast("bigint").alias("n_paragraphs"), some.alias("lines")), "license-lines")
    features = _table(
        docs, [{"gram": f, "gid": i, "weights": model.weights[f], "bits": model.anchors.get(f, 0)} for f, i in model.numbers.items()], "gram:string,gid:int,weights:array<bigint>,bits:bigint"
    )
    each = rows.select("__row", F.explode("lines").alias("x")).select("__row", "x.part", "x.line", "x.last", "x.words")
    across = F.when(F.col("last").isNotNull() & (F.size("words") > 0), F.concat_ws(" ", "last", F.get("words", F.lit(0))))
    grams = F.concat(
        F.transform(_grams(F.col("words")), lambda g: F.struct(g.alias("gram"), F.lit(False).alias("across"))),
        F.when(across.isNotNull(), F.array(F.struct(across.alias("gram"), F.lit(True).alias("across")))).otherwise(F.array().cast("array<struct<gram:string,across:boolean>>")),
    )
    each = each.select("__row", "part", "line", F.size("words").alias("n"), F.explode(grams).alias("g")).select("__row", "part", "line", "n", "g.gram", "g.across")
    own = F.when(~F.col("across"), F.col("weights"))
    hits = each.join(features, "gram").withColumn("weights", own)
    keys = ["__row", "part", "line"]
    scored = hits.groupBy(*keys).agg(
        *_sums(model),
        F.collect_set(F.when(~F.col("across"), F.col("gid"))).alias("gids"),
        F.max(F.when(F.col("across"), F.col("gid"))).alias("crossing"),
        F.bit_or("bits").alias("bits"),
        F.max("n").alias("n"),
    )
    scored = materialize(scored, "scored-lines")
    alone = materialize(_families(scored, keys, model).withColumn("confirmed", F.col("share") >= LEAST_SHARE), "line-families")
    # Paragraphs with an anchor of a family that no line confirms.
    held = scored.groupBy("__row", "part").agg(F.count("*").alias("lines"), F.bit_or("bits").alias("bits")).where("lines > 1 AND bits <> 0")
    sure = alone.where("confirmed").groupBy("__row", "part").agg(F.bit_or("bit").alias("sure"))
    rest = held.join(sure, ["__row", "part"], "left").where(F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("sure", F.lit(0)))) != 0)
    lines = scored.join(rest.select("__row", "part"), ["__row", "part"]).groupBy("__row", "part").agg(F.array_sort(F.collect_list(F.struct("line", "n", "gids", "crossing"))).alias("lines"))
    wrapped = wrapped_notices(lines, features, model).withColumn("confirmed", F.lit(True))
    every = alone.select("__row", "part", "family", "chance", "confirmed").unionByName(wrapped)
    # A family counts once a paragraph.
    return rows.drop("lines"), every.groupBy("__row", "part", "family").agg(F.max(F.when(F.col("confirmed"), F.col("chance"))).alias("sure"), F.max("chance").alias("chance")).select(
        "__row", "part", "family", F.coalesce("sure", "chance").alias("chance"), F.col("sure").isNotNull().alias("confirmed")
    )


def license_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_paragraphs, n_predicted, n_confirmed, families, chance): a row per document.

    n_paragraphs: those with a word; n_predicted, n_confirmed: pairs of a paragraph and a
    family.  families: the confirmed families, sorted and comma-joined; chance: the highest
    probability among them, 0 if there is none.  A null or empty text has no paragraphs.
    Repeated rows are returned as often as they come; a null doc_id is kept; other
    columns are ignored.  An empty table gives an empty one.
    """
    rows, found = license_paragraphs(docs)
    sure = F.col("confirmed")
    by_doc = found.groupBy("__row").agg(
        F.count("*").alias("n_predicted"),
        F.count(F.when(sure, 1)).alias("n_confirmed"),
        F.array_join(F.array_sort(F.collect_set(F.when(sure, F.col("family")))), ",").alias("families"),
        F.max(F.when(sure, F.col("chance"))).alias("chance"),
    )
    none = F.lit(0).cast("bigint")
    return rows.join(by_doc, "__row", "left").select(
        "doc_id",
        "n_paragraphs",
        F.coalesce("n_predicted", none).alias("n_predicted"),
        F.coalesce("n_confirmed", none).alias("n_confirmed"),
        F.coalesce("families", F.lit("")).alias("families"),
        F.coalesce("chance", F.lit(0.0)).alias("chance"),
    )
