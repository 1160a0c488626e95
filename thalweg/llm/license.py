r"""Licence scans by a trained paragraph classifier, with DataFrame functions only.

Paragraphs are what blank lines separate; the lines of one are joined, so a wrapped
notice is whole, and its words are read in windows of ``WINDOW`` words, each half a
window after the one before. A multinomial logistic regression on word n-grams (one to
three words) gives every window a licence family or none. It is trained here on notices
with words dropped and other text around them, against plain windows of the corpus and
windows with telling words that no template confirms (at most ``bound`` of each, picked
by hash). Notices and negatives left out of the training, in three folds, calibrate
the temperature of the probabilities and the probability below which a window is
unknown. A prediction counts when a template of its family confirms it: four of five of
the template's words and three of five of its pairs of neighbouring words stand in the window.

Only windows with a telling word are scored. Telling words are those of each template
that are rarest in the corpus, more than a fifth of its words, so that a window without
one cannot be confirmed by any template: nothing is lost.

Defined cases: a null or empty text has no window; texts and words of any length are
read whole; repeated rows and null ids get their own result; ties between families go
to the first by name; an empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.llm.common import hashed_sample, materialise

# Notices of each family, as they stand in source files and on pages.
TEMPLATES = {
    "agpl": [
        "licensed under the GNU Affero General Public License, version 3", "released under the AGPL v3 license", "AGPL-3.0", "AGPLv3",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0", "released under the Apache 2.0 license", "Apache-2.0", "Apache License 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "bsd": [
        "released under the BSD 3-Clause License", "licensed under the BSD license", "BSD-3-Clause", "BSD-2-Clause", "distributed under a BSD-style license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    ],
    "cc-by": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License", "CC BY 3.0", "CC BY 4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License", "licensed under a Creative Commons Attribution Non Commercial License", "CC BY-NC 4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License", "licensed under a Creative Commons Attribution Share Alike License", "CC BY-SA 4.0"],
    "cc0": ["dedicated to the public domain under CC0 1.0", "released under the CC0 1.0 Universal public domain dedication", "CC0-1.0", "waived all copyright and related rights under CC0"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3", "released under the GPL version 2 license", "GPL v3", "GPLv3", "GPL-3.0", "GPL-2.0", "GPLv2",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program",
    ],
    "lgpl": [
        "licensed under the GNU Lesser General Public License, version 3", "released under the LGPL license", "LGPL-2.1", "LGPL-3.0", "LGPLv3",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "mit": [
        "Released under the MIT License", "licensed under the MIT license", "The MIT License (MIT)", "license: MIT", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ],
    "mpl": [
        "subject to the terms of the Mozilla Public License, v. 2.0", "released under the MPL 2.0 license", "MPL-2.0", "Mozilla Public License Version 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    ],
}
# Sentences that use the words of licences otherwise.
NEGATIVES = [
    "the driver lost a license last year", "a licensed electrician came to the house", "the license plate was hard to read", "poetic licence is allowed here",
    "the restaurant needs a liquor license", "all rights reserved", "the public was invited to the park", "version 3 of the report is out", "the copyright office opens at nine",
    "she studied at MIT before she moved", "the Apache helicopter landed at 2.0 miles", "the Mozilla office is on the second floor", "permission is needed to enter the building",
    "software version 2.0 was released under budget", "the terms of the general public offer", "creative people share their commons", "free of charge to any person under ten",
    "the binary star and its source", "the gnu is an antelope of the plains", "redistribution of income is a public matter", "the attribution of the painting is wrong",
]
UNKNOWN = "unknown"
WINDOW = 60
#: Shares of a template's words, and of its pairs of words, that confirm it.
WORDS_SHARE, PAIRS_SHARE = 0.8, 0.6
_WORD = r"[a-z0-9]++(?:\.[a-z0-9]++)*+"


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+(?:\.[a-z0-9]+)*", text.lower())


def grams(tokens: list[str]) -> set[str]:
    return {" ".join(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1)}


def confirmed(tokens: list[str], family: str) -> float:
    """Share of words of the template of ``family`` that the words confirm best; zero if they confirm none."""
    own, pairs, best = set(tokens), set(zip(tokens, tokens[1:])), 0.0
    for t in map(words, TEMPLATES[family]):
        two = set(zip(t, t[1:]))
        share = len(own & set(t)) / len(set(t))
        if share >= WORDS_SHARE and len(pairs & two) >= PAIRS_SHARE * len(two):
            best = max(best, share)
    return best


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]  # the last is UNKNOWN
    weights: dict[str, list[float]]  # n-gram -> one weight a family
    bias: list[float]
    threshold: float
    tells: tuple[str, ...]  # a window without one is not scored

    def predict(self, tokens: list[str]) -> tuple[str, float]:
        z = np.array(self.bias) + sum((np.array(self.weights[g]) for g in grams(tokens) if g in self.weights), np.zeros(len(self.families)))
        p = np.exp(z - z.max())
        return self.families[int(z.argmax())], float(p.max() / p.sum())


def telling(plain: Sequence[list[str]]) -> list[str]:
    """Of each template the words that are rarest in ``plain``, more than a fifth of them."""
    seen = Counter(w for p in plain for w in set(p))
    out: set[str] = set()
    for family in TEMPLATES.values():
        for own in map(set, map(words, family)):
            need = int(len(own) * (1 - WORDS_SHARE)) + 1
            out |= set(sorted(own, key=lambda w: (seen[w], -len(w), w))[:need])
    return sorted(out)


def _augmented(rng: np.random.Generator, filler: list[list[str]], copies: int, fold: int | None = None, held: bool = False) -> list[tuple[list[str], str]]:
    """Notices in their surroundings; of the templates in (``held``) or outside one fold of three."""
    out = []
    shared = Counter(w for ts in TEMPLATES.values() for w in set().union(*map(set, map(words, ts))))
    tells = {"public", "general", "gnu", "nc", "sa", "affero", "lesser"}
    for family, notices in TEMPLATES.items():
        for i, notice in enumerate(notices):
            if fold is not None and (i % 3 == fold) != held:
                continue
            for k in range(copies):
                w = words(notice)
                if k:
                    # words that several families share may go missing; what tells a family stays
                    w = [x for x in w if len(w) < 5 or shared[x] < 2 or x in tells or rng.random() > 0.1]
                    near = filler[rng.integers(len(filler))] if filler else []
                    at, room = int(rng.integers(0, len(near) + 1)), max(0, WINDOW - len(w))
                    before = near[max(0, at - int(rng.integers(0, room + 1))) : at]
                    w = before + w + near[at : at + int(rng.integers(0, room - len(before) + 1))]
                out.append((w, family))
    return out


def _descend(x: np.ndarray, y: np.ndarray, steps: int, ridge: float = 1e-5) -> np.ndarray:
    """Weights of the softmax regression, by accelerated gradient steps."""
    beta = last = np.zeros((x.shape[1], y.shape[1]), np.float32)
    for k in range(steps):
        ahead = beta + (k / (k + 3)) * (beta - last)
        last = beta
        beta = ahead - 2.0 * (x.T @ (_softmax(x @ ahead) - y) / len(x) + ridge * ahead)
    return beta


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def train(plain: Sequence[list[str]], evident: Sequence[list[str]] = (), copies: int = 8, seed: int = 4, steps: int = 250) -> Model:
    """The classifier, from the templates, plain windows and windows with telling words.

    ``evident`` windows that a template confirms are left out, the others are negatives.
    """
    rng = np.random.default_rng(seed)
    negatives = [[*map(words, NEGATIVES)], [w for w in evident if not any(confirmed(w, f) for f in TEMPLATES)], list(plain)]
    families = (*sorted(TEMPLATES), UNKNOWN)
    vocabulary = sorted(set().union(*(grams(words(t)) for ts in TEMPLATES.values() for t in ts), *(grams(w) for w in negatives[0])))
    column = {g: i for i, g in enumerate(vocabulary)}

    def matrix(rows: list[tuple[list[str], str]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(vocabulary) + 1), np.float32)
        for i, (w, _) in enumerate(rows):
            x[i, [column[g] for g in grams(w) if g in column]] = 1
        x[:, -1] = 1
        return x, np.eye(len(families), dtype=np.float32)[[families.index(f) for _, f in rows]]

    def others(fold: int | None, held: bool) -> list[tuple[list[str], str]]:
        rows = [[w for i, w in enumerate(kind) if fold is None or (i % 3 == fold) == held] for kind in negatives]
        few = [w if not k else [x for x in w if rng.random() > 0.1] for w in rows[0] for k in range(copies)]
        return [(w, UNKNOWN) for w in few + rows[1] + rows[2]]

    z, y = [], []
    for fold in range(3):
        beta = _descend(*matrix(_augmented(rng, plain, copies, fold) + others(fold, False)), steps)
        x, own = matrix(_augmented(rng, plain, copies, fold, held=True) + others(fold, True))
        z.append(x @ beta)
        y.append(own)
    z, y = np.concatenate(z), np.concatenate(y)
    known, truth = y[:, -1] == 0, y.argmax(1)
    heat = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=lambda t: -np.log((_softmax(z / t) * y).sum(1) + 1e-12).mean())
    p = _softmax(z / heat)
    best, top = p.argmax(1), p.max(1)
    # above what any negative left out reaches, but never above what nine of ten right answers reach
    wrong, right = (best != len(families) - 1) & ~known, (best == truth) & known
    threshold = min(max([0.4, *(top[wrong] + 1e-6)]), float(np.quantile(top[right], 0.1)) if right.any() else 0.4)
    beta = _descend(*matrix(_augmented(rng, plain, copies) + others(None, False)), steps) / heat
    weights = {g: [round(float(v), 5) for v in beta[i]] for g, i in column.items() if np.abs(beta[i]).max() > 1e-3}
    return Model(families, weights, [round(float(v), 5) for v in beta[-1]], round(float(threshold), 5), tuple(telling(plain)))


def windows(text: Column) -> Column:
    """The windows of a text: arrays of its paragraphs' words (those of more than 40 characters are in no template)."""

    def cut(paragraph: Column) -> Column:
        own = F.filter(F.regexp_extract_all(paragraph, F.lit(_WORD), F.lit(0)), lambda w: F.length(w) <= 40)

        def of(w: Column) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - WINDOW // 2), F.lit(WINDOW // 2))
            return F.transform(starts, lambda i: F.slice(w, i, F.lit(WINDOW)))

        return F.flatten(F.transform(F.array(own), of))

    return F.filter(F.flatten(F.transform(F.split(F.lower(text), r"\n[ \t\r]*\n"), cut)), lambda w: F.size(w) > 0)


def evident(docs: DataFrame, tells: Sequence[str]) -> DataFrame:
    """row, doc_id, and the windows of the text with a telling word; one row a document, written once."""
    low = F.lower(F.col("text"))
    guard = low.rlike("(?<![a-z0-9])(?:" + "|".join(map(re.escape, tells)) + ")(?![a-z0-9])")
    found = F.filter(windows(F.col("text")), lambda w: F.arrays_overlap(w, F.array(*map(F.lit, tells))))
    none = F.array().cast("array<array<string>>")
    out = docs.select("doc_id", F.when(guard, found).otherwise(none).alias("windows"))
    return materialise(out.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("windows", none).alias("windows")), "licence-windows")


def plain_windows(docs: DataFrame, bound: int) -> list[list[str]]:
    """At most ``bound`` windows of the documents, by hash."""
    rows = docs.where("text is not null").select(F.col("text"), F.xxhash64("text").alias("h"))
    total = docs.count()
    if total > 4 * bound:
        rows = rows.where(F.pmod(F.col("h"), F.lit(1 << 40)) < int((1 << 40) * 4 * bound / total))
    cut = rows.select(F.explode(windows(F.col("text"))).alias("w")).withColumn("k", F.xxhash64("w"))
    return [r["w"] for r in hashed_sample(cut, "k", bound, cut.count()).collect()]


def fit(docs: DataFrame, bound: int = 1000) -> tuple[Model, DataFrame]:
    """The model, and the ``evident`` windows of the documents.

    At most ``bound`` plain windows and ``bound`` windows with telling words reach the
    driver.
    """
    plain = plain_windows(docs, bound)
    rows = evident(docs, telling(plain))
    tell = rows.select(F.explode("windows").alias("w")).withColumn("k", F.xxhash64("w")).distinct()
    return train(plain, [r["w"] for r in hashed_sample(tell, "k", bound, tell.count()).collect()]), rows


def scan(rows: DataFrame, model: Model) -> DataFrame:
    """row, doc_id, window (number), family, probability, overlap, confirmed of each of the ``evident`` windows."""
    spark = rows.sparkSession
    each = rows.select("row", "doc_id", F.posexplode("windows").alias("window", "w"))

    def run(n: int) -> Column:
        """The runs of ``n`` words (a lambda's further parameters would be Spark's)."""
        starts = F.sequence(F.lit(1), F.size("w") - (n - 1))
        return F.when(F.size("w") >= n, F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))

    runs = [run(2), run(3)]
    each = each.withColumn("pairs", runs[0])
    grams_ = each.select("row", "doc_id", "window", F.explode(F.array_distinct(F.concat("w", "pairs", runs[1]))).alias("gram"))
    # the model's own size: the n-grams of the templates
    weights = spark.createDataFrame(sorted(model.weights.items()), "gram string, weight array<double>")
    n = len(model.families)
    summed = grams_.join(F.broadcast(weights), "gram").groupBy("row", "window").agg(*(F.sum(F.get("weight", F.lit(i))).alias(f"z{i}") for i in range(n)))
    z = F.array(*(F.col(f"z{i}") + model.bias[i] for i in range(n)))
    e = F.transform("z", lambda v: F.exp(v - F.array_max("z")))
    scored = summed.select("row", "window", z.alias("z")).select("row", "window", e.alias("p"))
    best = F.element_at(F.array(*map(F.lit, model.families)), F.array_position("p", F.array_max("p")).cast("int"))
    scored = scored.select("row", "window", best.alias("best"), (F.array_max("p") / F.aggregate("p", F.lit(0.0), lambda a, v: a + v)).alias("top"))
    # a window without any weighted n-gram has the bias alone
    z0 = np.array(model.bias)
    p0 = np.exp(z0 - z0.max())
    out = each.join(scored, ["row", "window"], "left").fillna({"best": model.families[int(z0.argmax())], "top": float(p0.max() / p0.sum())})
    overlap = F.lit(0.0)
    for family, notices in TEMPLATES.items():
        for own in map(words, notices):
            two = [" ".join(p) for p in sorted(set(zip(own, own[1:])))]
            share = F.size(F.array_intersect("w", F.array(*map(F.lit, sorted(set(own)))))) / len(set(own))
            met = F.size(F.array_intersect("pairs", F.array(*map(F.lit, two)))) >= PAIRS_SHARE * len(two) if two else F.lit(True)
            overlap = F.greatest(overlap, F.when((F.col("best") == family) & (share >= WORDS_SHARE) & met, share).otherwise(0.0))
    sure = (F.col("best") != UNKNOWN) & (F.col("top") >= model.threshold)
    out = out.withColumn("overlap", overlap)
    return out.select(
        "row", "doc_id", "window", F.when(sure, F.col("best")).otherwise(UNKNOWN).alias("family"), F.col("top").alias("probability"),
        "overlap", (sure & (F.col("overlap") > 0)).alias("confirmed"),
    )


def licences(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, families (confirmed, sorted, comma-joined), n_evident, n_confirmed (windows) for every document."""
    if model is None:
        model, rows = fit(docs)
    else:
        rows = evident(docs, model.tells)
    long = lambda v: F.lit(v).cast("long")
    without = rows.where(F.size("windows") == 0).select("doc_id", F.lit("").alias("families"), long(0).alias("n_evident"), long(0).alias("n_confirmed"))
    found = scan(rows, model).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
        F.count(F.lit(1)).alias("n_evident"), F.count_if("confirmed").alias("n_confirmed"),
    )
    return without.unionAll(found.drop("row"))
