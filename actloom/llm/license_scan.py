"""License scan: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are runs of lines without a blank one between. As a notice may stand among other lines and is often
hard-wrapped, every line with a licence word is read alone, and joined with the lines after it in its paragraph.

Features are word 1- to 3-grams of the templates; a multinomial logistic regression over that sparse vocabulary tells
licence families from ordinary text. It is trained on the driver on the templates, altered by a seeded generator,
against ordinary and misleading text. "Unknown" is calibrated on licences that the classifier has not seen: the families
are dealt into FOLDS, each fold is scored by a classifier trained on the others, and from these scores come
the temperature (least log loss over known families) and the probability from which a prediction counts as sure: no
more than LEAK of the unseen families' notices may be named with it. A prediction is confirmed if a template's word pairs are found close together with
little in between, and no negation stands before them. Training reads no rows, so it is the same for
every corpus; scoring reads every paragraph of every text in one scan without a shuffle.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, small_batches

#: Licence families: names, short identifiers, and the wording of their notices. Fixed values.
FAMILIES = {
    "AGPL": (("GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPL"), ("AGPL-3.0-only", "AGPL-3.0-or-later", "AGPL-3.0"), (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",)),
    "Apache-2.0": (("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license"), ("Apache-2.0",), (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.")),
    "BSD": (("BSD 3-Clause License", "BSD 2-Clause License", "BSD License", "Simplified BSD License", "New BSD License", "BSD"), ("BSD-3-Clause", "BSD-2-Clause"), (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",)),
    "BSL-1.0": (("Boost Software License, Version 1.0", "Boost Software License"), ("BSL-1.0",), (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at",)),
    "CC-BY": (("CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License"), ("CC-BY-4.0",), ()),
    "CC-BY-NC": (("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"), ("CC-BY-NC-4.0",), ()),
    "CC-BY-NC-ND": (("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"), ("CC-BY-NC-ND-4.0",), ()),
    "CC-BY-NC-SA": (("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"), ("CC-BY-NC-SA-4.0",), ()),
    "CC-BY-ND": (("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"), ("CC-BY-ND-4.0",), ()),
    "CC-BY-SA": (("CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License"), ("CC-BY-SA-4.0",), ()),
    "CC0": (("CC0 1.0", "CC0 1.0 Universal Public Domain Dedication"), ("CC0-1.0",), (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
        "Released into the public domain under CC0 1.0.")),
    "EPL-2.0": (("Eclipse Public License 2.0", "Eclipse Public License v2.0"), ("EPL-2.0",), (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",)),
    "GPL": (("GNU General Public License", "GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL", "GPL"), ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0"), (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",)),
    "ISC": (("ISC License",), ("ISC",), (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",)),
    "LGPL": (("GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License, version 3", "LGPL"), ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-2.1", "LGPL-3.0-only", "LGPL-3.0-or-later", "LGPL-3.0"), (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",)),
    "MIT": (("MIT License", "MIT licence", "The MIT License (MIT)", "MIT"), ("MIT",), (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",)),
    "MPL-2.0": (("Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"), ("MPL-2.0",), (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",)),
    "Proprietary": ((), (), (
        "All rights reserved.",
        "Copyright the authors. All rights reserved. No part of this publication may be reproduced without permission.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.")),
    "Unlicense": (("Unlicense", "The Unlicense"), ("Unlicense",), (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose")),
    "Zlib": (("zlib License", "zlib/libpng License"), ("Zlib",), (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions")),
}
#: How names and identifiers are put into notices.
NAMED = ("Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under a {}.", "License: {}", "distributed under the terms of the {}", "Released under {}.", "is under {}.", "{} licensed")
IDENTIFIED = ("SPDX-License-Identifier: {}", "License: {}")
#: A line without one of these words, or of a family's own words, holds no notice. Fixed values.
GATE = ("license", "licence", "licensed", "licenced", "spdx", "permission", "permitted", "redistribution", "redistribute", "rights", "copyright", "proprietary", "unencumbered", "unlicense", "waived", "dedication", "warranties", "liable", "anyone", "released", "distributed")
#: Negations and how many words before a notice they reach. Fixed values.
NEGATIONS = ("not", "never", "no", "neither", "nor", "isn", "aren", "wasn", "cannot", "without")
NEGATED_WITHIN = 4
#: Sentences with licence words that grant nothing. Fixed values.
MISLEADING = (
    "his driving license was renewed last week", "the public was permitted to visit the gallery", "general election results were published by the commission",
    "the apache helicopter landed near the village", "mit students won the international robotics contest", "the foundation waived the fee for young artists",
    "she released a new album under another name", "the court reserved its judgment on human rights", "attribution of the painting to the master is disputed",
    "a mozilla developer gave a talk about browsers", "creative writing and common sense", "permission to build was refused by the council",
    "commercial rights to the match were sold", "the licence fee for television rose again", "copyright law is taught in the second year",
    "a fishing license can be bought at the counter", "anyone can join the club free of charge", "the free software movement began in the eighties",
)
NONE, UNKNOWN = "none", "unknown"
FOLDS = 4
LEAK = 0.05
COVER, CLOSE = 0.6, 0.8  # of a template's word pairs that are found; of the pairs in their span that are the template's
BACK = 8
LONG = 8  # word pairs of a template that is looked for over more than two lines
EXACT = 0.5  # probability that is enough where a template stands there word for word
SEED = 5
_KEEP = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def words_of(paragraph: bytes) -> list[bytes]:
    return paragraph.translate(_KEEP).split()


def templates(families=None) -> dict[str, list[str]]:
    """Every wording of each family."""
    families = FAMILIES if families is None else families
    return {k: [f.format(n) for n in names for f in NAMED] + [f.format(i) for i in ids for f in IDENTIFIED] + list(grants) for k, (names, ids, grants) in families.items()}


def grams_of(words):
    for n in (1, 2, 3):
        for i in range(len(words) - n + 1):
            yield b" ".join(words[i : i + n])


def draw(rng, made: dict, name: str, noise: list[bytes]) -> list[bytes]:
    """One altered text of a family, or of none: words lost, other text around them, single licence words."""
    pick = lambda pool, n: [pool[i] for i in rng.integers(0, len(pool), n)]
    if name != NONE:
        own = made[name]
        words = [w for w in own[rng.integers(0, len(own))] if rng.random() > 0.05]
        return pick(noise, rng.integers(0, 8)) + words + pick(noise, rng.integers(0, 8))
    words, kind = pick(noise, rng.integers(3, 40)), rng.integers(0, 4)
    if kind == 1:  # single licence words
        every = [w for ts in made.values() for t in ts for w in t]
        for w in pick(every, rng.integers(1, 4)):
            words.insert(int(rng.integers(0, len(words))), w)
    elif kind == 2:
        words += words_of(MISLEADING[rng.integers(0, len(MISLEADING))].encode())
    return words


NOISE = [f"w{i}".encode() for i in range(200)] + b"a all and any are as at be but by can do each for from had has have he her his how if in into is it its may more most no not of on one or other our out over part people said she so some such than that the their them then there these they this time to two under up use used was we were what when which who will with work would year you your".split()


class Regression:
    """Weights over a vocabulary of n-grams for none and the given families."""

    def __init__(self, made: dict, seed: int = SEED, each: int = 120, steps: int = 250):
        self.classes = [NONE, *sorted(made)]
        self.grams: dict[bytes, int] = {}
        for ts in made.values():
            for t in ts:
                for g in grams_of(t):
                    self.grams.setdefault(g, len(self.grams))
        rng = np.random.default_rng(seed)
        rows, ys = [], []
        for c, name in enumerate(self.classes):
            for t in made.get(name, ()):  # each wording as it is, and altered ones
                rows.append(self.features(t))
                ys.append(c)
            for _ in range(each * (10 if name == NONE else 1)):
                rows.append(self.features(draw(rng, made, name, NOISE)))
                ys.append(c)
        v = len(self.grams)
        x = np.zeros((len(rows), v + 1), np.float32)
        for r, f in enumerate(rows):
            x[r, f] = 1
        x[:, v] = 1  # bias
        want = np.eye(len(self.classes), dtype=np.float32)[ys]
        w, grown = np.zeros((v + 1, len(self.classes)), np.float32), np.zeros((v + 1, len(self.classes)), np.float32)
        for _ in range(steps):
            z = x @ w
            z = np.exp(z - z.max(axis=1, keepdims=True))
            g = x.T @ (z / z.sum(axis=1, keepdims=True) - want) / len(rows) + 1e-4 * w
            grown += g * g
            w -= 0.5 * g / (np.sqrt(grown) + 1e-8)
        self.weights = w.astype(np.float64)

    def features(self, words) -> list[int]:
        return sorted({self.grams[g] for g in grams_of(words) if g in self.grams})

    def logits(self, words) -> np.ndarray:
        return self.weights[[*self.features(words), -1]].sum(axis=0)


def _soft(z):
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


#: Words that stand between the licences of one notice, and the last words of what comes before the first. Fixed values.
BETWEEN = frozenset((b"or", b"and"))
LEADS = frozenset((b"under", b"identifier", b"license", b"licence", b"terms", b"the", b"either", b"both"))


def alternatives(words) -> list[list[bytes]]:
    """The notices of words that name several licences: what leads to the first one, before each of them."""
    first = next((i for i, w in enumerate(words) if w in _OWN), None)
    if first is None or BETWEEN.isdisjoint(words[first:]):
        return []
    lead = words[:first]
    while lead and lead[-1] in (b"either", b"both"):
        lead = lead[:-1]
    parts, part = [], []
    for w in [*words[first:], b"or"]:
        if w not in BETWEEN:
            part.append(w)
        elif part:
            parts.append(part)
            part = []
    tail = len(lead) and lead[-1] in LEADS
    return [lead + (p[1:] if p[0] == b"the" and lead[-1] == b"the" else p) for p in parts] if tail and len(parts) > 1 else []


def _pairs(made: dict) -> dict:
    """(words, word pairs) of each template."""
    return {k: [(len(t), frozenset(zip(t, t[1:], strict=False))) for t in ts] for k, ts in made.items()}


def compare(templates_of, words) -> tuple[float, bool]:
    """(similarity, confirmed): the best template's share of word pairs found close together, and whether that is enough."""
    best, sure = 0.0, False
    pairs = list(zip(words, words[1:], strict=False))
    for size, own in templates_of:
        hits = [i for i, p in enumerate(pairs) if p in own]
        first = 0
        for last, at in enumerate(hits):  # the fullest stretch of about the template's length
            while at - hits[first] > 1.5 * size:
                first += 1
            held = hits[first : last + 1]
            cover = len({pairs[i] for i in held}) / len(own)
            close = len(held) / (held[-1] - held[0] + 1)
            denied = any(w in _NEGATIONS for w in words[max(0, held[0] - NEGATED_WITHIN) : held[0]])
            good = cover >= COVER and close >= CLOSE and not denied
            if (good, cover) > (sure, best):
                best, sure = cover, good
    return best, sure


def calibrate(made: dict, seed: int = SEED) -> tuple[float, float]:
    """(temperature, least sure probability) from families that their classifier has not seen."""
    rng = np.random.default_rng(seed + 1)
    names, pairs = sorted(made), _pairs(made)
    rng.shuffle(names)
    known, want, unseen = [], [], []
    for k in range(FOLDS):
        out = set(names[k::FOLDS])
        model = Regression({n: t for n, t in made.items() if n not in out}, seed + 2 + k, each=40, steps=150)
        at = {n: i for i, n in enumerate(model.classes)}
        for name in [NONE, *sorted(made)]:
            for _ in range(25):
                words = draw(rng, made, name, NOISE)
                z = model.logits(words)
                if name in out:
                    best = model.classes[int(z.argmax())]
                    unseen.append((z, best != NONE and compare(pairs[best], words)[1]))
                else:
                    known.append(z - z.max())
                    want.append(z[at[name]] - z.max())
    losses = {}
    for t in np.geomspace(0.25, 8, 41):
        losses[float(t)] = float(np.mean([np.log(np.exp(z / t).sum()) - w / t for z, w in zip(known, want, strict=True)]))
    temperature = min(losses, key=losses.get)
    named = sorted(_soft(z / temperature).max() for z, confirmed in unseen if confirmed)
    over = int(LEAK * len(unseen))
    return temperature, float(max(0.5, np.nextafter(named[-over - 1], 1))) if len(named) > over else 0.5


class Classifier:
    """Vocabulary, weights, temperature and threshold, and the templates' word pairs."""

    def __init__(self, families=None, seed: int = SEED):
        made = {k: [words_of(t.encode()) for t in ts] for k, ts in templates(families).items()}
        self.temperature, self.sure = calibrate(made, seed)
        self.model = Regression(made, seed)
        self.classes = self.model.classes
        self.gate = frozenset(w.encode() for w in GATE) | {w for ts in made.values() for t in ts for w in t if w in _OWN}
        self.pairs = _pairs(made)
        self.known = frozenset(p for ts in self.pairs.values() for _, own in ts for p in own)
        self.reach = 2 * max(len(t) for ts in made.values() for t in ts)

    def predict(self, words):
        """(family, probability, similarity, confirmed) of some words; (none, ...) without licence words."""
        if self.gate.isdisjoint(words):
            return NONE, 1.0, 0.0, False
        p = _soft(self.model.logits(words) / self.temperature)
        best = int(p.argmax())
        name, sure = self.classes[best], float(p[best])
        if name == NONE:
            return NONE, sure, 0.0, False
        like, confirmed = compare(self.pairs[name], words)
        if confirmed and sure >= (EXACT if like == 1 else self.sure):
            return name, sure, like, True
        if self._denied(words):
            return NONE, sure, like, False
        return UNKNOWN, sure, like, False

    def predict_all(self, words):
        """The prediction, or of a notice of several licences one for each, if all but later words are confirmed."""
        several = [x for x in map(self.predict, alternatives(words)) if x[3]]
        if len({x[0] for x in several}) > 1:
            best = {}
            for x in several:
                if x[0] not in best or x[1] > best[x[0]][1]:
                    best[x[0]] = x
            return [best[k] for k in sorted(best)]
        return [self.predict(words)]

    def _denied(self, words) -> bool:
        """Whether a licence word comes soon after a negation."""
        at = [i for i, w in enumerate(words) if w in self.gate]
        return bool(at) and any(w in _NEGATIONS for w in words[max(0, at[0] - NEGATED_WITHIN) : at[0]])


_NEGATIONS = frozenset(w.encode() for w in NEGATIONS)
#: Words that name a family by themselves. Fixed values.
_OWN = frozenset(b"affero agpl apache boost bsd cc cc0 eclipse gnu gpl isc lgpl mit mozilla mpl noncommercial noderivatives sharealike zlib".split())


@lru_cache(maxsize=1)
def standard_classifier() -> Classifier:
    """The classifier of FAMILIES, trained once a driver."""
    return Classifier()


def scan_text(model: Classifier, body: bytes) -> tuple[int, list[dict]]:
    """Paragraphs of a text, and its findings in order, each with the number of its first line and its paragraph.

    Lines are joined, from up to BACK lines before a licence word on, up to ``model.reach`` words after the first line
    and never over a blank line; joins are judged at lines that add word pairs of some template. The join that is most
    similar to a template is one finding at its first line, if it is confirmed, in place of those of its lines.
    Confirmed lines stand for themselves and are never joined; one that names several licences is a finding for each.
    """
    words = [words_of(line) for line in body.split(b"\n")]
    number, paragraphs = [], 0
    for i, w in enumerate(words):
        paragraphs += bool(w) and (i == 0 or not words[i - 1])
        number.append(paragraphs - 1)
    signs = {i for i, w in enumerate(words) if w and not model.gate.isdisjoint(w)}
    every = {i: model.predict_all(words[i]) for i in sorted(signs)}
    found = {i: xs[0] for i, xs in every.items()}
    sure = {i for i, x in found.items() if x[3]}
    near = sorted({k for s in signs for k in range(max(0, s - BACK), s + 1) if number[k] == number[s] and words[k]})
    tells = lambda i: any(p in model.known for p in zip(words[i], words[i][1:], strict=False))
    used = -1
    for i in near:
        if i <= used or i in sure or not tells(i):
            continue
        joined, best, j = list(words[i]), None, i + 1
        held = {p for p in zip(joined, joined[1:], strict=False) if p in model.known}
        while j < len(words) and words[j] and j not in sure and len(joined) - len(words[i]) < model.reach:
            new = {p for p in zip([joined[-1], *words[j]], words[j], strict=False) if p in model.known}
            joined += words[j]
            held |= new
            # more than two lines hold a long template or none, and most of its word pairs
            if new and (j == i + 1 or len(held) >= COVER * LONG) and (x := model.predict(joined))[3] and (best is None or x[2] > best[0][2]):
                best = x, j
            j += 1
        if best:
            for k in range(i, best[1] + 1):
                found.pop(k, None)
                every.pop(k, None)
            found[i], used = best
            every[i] = [found[i]]
    names = ("family", "probability", "similarity", "confirmed")
    hits = [{"line": i, "paragraph": number[i]} | dict(zip(names, (x[0], round(x[1], 6), round(x[2], 6), x[3]), strict=True)) for i, xs in sorted(every.items()) for x in xs if x[0] != NONE]
    return paragraphs, hits


_FOUND = "array<struct<line:int,paragraph:int,family:string,probability:double,similarity:double,confirmed:boolean>>"


def _scan(shared):
    def run(batches):
        import pyarrow as pa

        model = shared.value
        found = pa.list_(pa.struct([("line", pa.int32()), ("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())]))
        for batch in batches:
            counts, out = [], []
            for body in batch.column(1).to_pylist():
                n, hits = scan_text(model, body)
                counts.append(n)
                out.append(hits)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(out, found)], names=["id", "n_paragraphs", "found"])

    return run


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Classifier | None = None) -> DataFrame:
    """One row per input row: id, n_paragraphs, found (line, paragraph, family, probability, similarity, confirmed).

    A finding that is not confirmed, or not sure, is of the family "unknown". Null and empty texts have no paragraphs
    and nothing is found. Null and repeated ids are rows of their own; a very long text is read line by line; extra
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model or standard_classifier())  # of the templates' size, whatever the corpus
    src = docs.select(F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("body"))
    kind = docs.schema[id_col].dataType.simpleString()
    return src.mapInArrow(_scan(shared), f"id {kind}, n_paragraphs long, found {_FOUND}").withColumnRenamed("id", id_col)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_paragraphs, n_found, families (confirmed ones, sorted, by comma), license, probability, similarity.

    ``license`` is the confirmed family of the highest probability, "unknown" if a paragraph only looks like
    a licence, or "none".
    """
    out = license_scan(load(spark, sf_dir, "documents"))
    sure = F.filter("found", lambda x: x["confirmed"])
    best = lambda c: F.element_at(F.array_sort(c, lambda a, b: F.when(a["probability"] > b["probability"], -1).when(a["probability"] < b["probability"], 1).otherwise(a["line"] - b["line"])), 1)
    top = F.when(F.size(sure) > 0, best(sure)).when(F.size("found") > 0, best(F.col("found")))
    return out.withColumn("top", top).select(
        "doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_found"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.when(F.size("found") == 0, F.lit(NONE)).when(F.size(sure) > 0, F.col("top.family")).otherwise(F.lit(UNKNOWN)).alias("license"),
        F.col("top.probability").alias("probability"), F.col("top.similarity").alias("similarity"),
    )
