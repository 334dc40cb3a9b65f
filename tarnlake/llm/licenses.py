"""Licence scans: a trained paragraph classifier, in DataFrame functions only.

Units are the lines of a text and its paragraphs of several lines (up to a blank one), as notices are
written in one line or wrapped. The word unigrams and bigrams of a unit meet the weights of a
multinomial logistic regression, trained here on variants of the notices below; a softmax with a
calibrated temperature gives the family, one class is other licences, one is no licence. A family is
confirmed if the unit also has most of one of its templates, and no template of another family fits
better; a version that isn't the family's rules it out beforehand. What reads like a licence and
isn't confirmed is unknown.

Features have a word that isn't a stop word, so a unit without such a word has none and gets the
class of the bias, no licence: it needn't be scored. That is no list of anchors but a property of the
model, whichever it is trained to be.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.core.session import table
from tarnlake.core.shared import materialize

#: How notices of each family read.
NOTICES = {
    "mit": [
        "Released under the MIT License.", "This project is licensed under the MIT License.", "Licensed under the terms of the MIT license", "SPDX-License-Identifier: MIT", "Distributed under the MIT license", "MIT licensed",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software",
    ],
    "isc": [
        "Licensed under the ISC License.", "SPDX-License-Identifier: ISC", "Released under the terms of the ISC license",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "This file is licensed under the Apache License 2.0", "SPDX-License-Identifier: Apache-2.0", "Distributed under the Apache 2.0 license", "Released under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 3.", "GNU General Public License version 3", "SPDX-License-Identifier: GPL-3.0-only", "Licensed under version 3 of the GNU GPL", "Distributed under the GPL version 3", "Released under the GNU GPL v3", "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under GPLv3", "Licensed under the GPL", "Distributed under the terms of the GNU General Public License v3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "gpl-2.0": [
        "Released under the GNU General Public License, version 2.", "Released under the GNU GPL v2", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later", "Licensed under GPLv2", "Licensed under version 2 of the GNU GPL", "GNU General Public License version 2", "Distributed under the GPL version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    ],
    "agpl-3.0": ["Licensed under the GNU Affero General Public License v3", "SPDX-License-Identifier: AGPL-3.0", "Released under the AGPL", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "Licensed under AGPLv3"],
    "lgpl": ["Licensed under the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1", "Released under the terms of the GNU LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "Licensed under LGPLv3"],
    "bsd": [
        "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Released under the BSD license", "Distributed under the 2-clause BSD license", "Use of this source code is governed by a BSD-style license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed.",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License 2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at", "Released under the MPL 2.0"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0", "SPDX-License-Identifier: EPL-2.0", "Released under the Eclipse Public License 2.0", "Licensed under the Eclipse Public License v1.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Available under the Creative Commons Attribution license", "Published under CC-BY 3.0", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0", "Available under the Creative Commons Attribution-NonCommercial-ShareAlike license", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "public-domain": ["This work is in the public domain.", "Released under CC0 1.0 Universal public domain dedication", "SPDX-License-Identifier: CC0-1.0", "Released into the public domain under the Unlicense", "This is free and unencumbered software released into the public domain.", "The author has dedicated the work to the public domain by waiving all rights to the work worldwide"],
    "proprietary": [
        "All rights reserved.", "Todos los derechos reservados.", "Tous droits réservés.", "Alle Rechte vorbehalten.", "Tutti i diritti riservati.", "Todos os direitos reservados.", "Copyright 2020. All rights reserved.", "Proprietary and confidential. Unauthorized copying is prohibited.", "Copyright (c) Example Corporation. All rights reserved.", "This software is the confidential and proprietary information of the company",
        "No part of this publication may be reproduced, stored or transmitted without the prior written permission of the copyright holder", "Unauthorized copying of this file, via any medium, is strictly prohibited",
    ],
}
#: Notices of licences that are no family of their own.
OTHER_LICENCES = [
    "Licensed under the Apache License, Version 1.1", "Distributed under the Apache Software License 1.1", "SPDX-License-Identifier: Apache-1.1", "Licensed under the BSD Zero Clause License", "SPDX-License-Identifier: 0BSD", "Released under the WTFPL", "Do what the fuck you want to public license", "Licensed under the CeCILL free software license",
    "SPDX-License-Identifier: CECILL-2.1", "This library is free software; you can redistribute it under the same terms as Perl itself", "Available under the same conditions as Perl itself", "Licensed under the GNU General Public License version 1", "Licensed under the Mozilla Public License 1.1", "Licensed under the GNU Free Documentation License 1.3",
    "Licensed under the Academic Free License version 3.0", "Licensed under the Artistic License 2.0", "Licensed under the European Union Public Licence 1.2", "Licensed under the Common Development and Distribution License", "Licensed under the Microsoft Public License", "Released under the Boost Software License",
    "Released under the zlib license", "Released under the Open Software License", "Distributed under the SIL Open Font License", "Distributed under the terms of the Python Software Foundation License", "Licensed under the Business Source License 1.1", "Do what the fuck you want to public license", "This code is licensed under its own terms",
    "Licensed under the terms of the agreement that comes with this product", "This model is licensed under a community license agreement", "Use is permitted for evaluation only under the trial license", "You are granted a limited, revocable, non-exclusive license to use the material", "By using this software you agree to the terms of the end user license agreement",
    "Steht unter einer freien Lizenz", "Disponible sous licence libre", "Publicado bajo una licencia libre", "Lizenziert unter den Bedingungen der Lizenz", "Distribué sous licence", "Dieses Werk steht unter einer Lizenz", "Freigegeben unter der Lizenz", "Alle Rechte nach der Lizenz", "Cette oeuvre est sous licence", "Esta obra está bajo una licencia", "The licensee may not sublicense or assign this licence",
]
#: Text with the same words that is no notice.
OTHERS = [
    "his driver license expired last year", "a licensed physician must sign the form", "the pub lost its licence to sell beer", "copyright law is a difficult subject", "students of mit built a robot", "apache helicopters flew over the town", "the general public was not admitted", "the right to vote is reserved for adults",
    "she took poetic license with the story", "the source of the river", "a table was reserved under the name", "he was granted permission to leave", "the public likes the work of the artist", "version 2.0 of the story", "the terms of the treaty", "free of charge for children", "you may use the file",
    "creative people share the commons", "all of the work is on the table", "the license plate of the car", "marriage licenses are issued here", "the total eclipse was seen from the island", "the eclipse of the moon", "a public library in the city", "software is used in all schools", "the software was written in a week",
    "the program was free for students", "the lawyers had a discussion about liability and damages", "the warranty of the car has expired", "the authors of the book were not present", "this work was done in the garden", "the notice on the door", "conditions in the camp were bad", "the list of the people who met",
    "the rights of workers", "the committee met to modify the plan", "newspapers publish and distribute the news", "the foundation gave money to the university", "binary stars in the sky", "the form must be signed in the presence of a witness", "a copy of the letter was sent", "with or without sugar", "any person who enters the building",
    "the domain of the king", "the international airport", "attribution of the painting is disputed", "no one may enter without permission", "in no event should you open the door", "for a particular purpose", "to the fullest extent", "as far as the law goes", "the name of the holder", "made available to the press", "the materials were brought by ship",
    "the price includes all taxes", "the original document was lost in the fire", "the company was founded in 1990", "please read the terms before you sign", "they reserved all seats", "the document is confidential between us", "the right to remain silent", "distribution of food", "the implied meaning", "written in latin",
]
#: Talk about licences; {} is a licence's name.
TALK = ["The {} was discussed by the committee", "a talk about the {} and its history", "we compare the {} with others", "what does the {} say", "the court had to interpret the {}", "the {} is popular among developers", "why I don't like the {}"]
NAMES = ["MIT License", "Apache License", "GNU General Public License", "GPL", "BSD license", "Mozilla Public License", "Eclipse Public License", "Creative Commons Attribution license", "ISC license", "public domain"]
STOP = frozenset(("a an and any are as at be been by for from has have if in into is it its may no not of on or our shall that the their they this to under was we were will with you your about all do does don here he her his i only other out own she so t up what why "
                 "bajo de den der des die ein eine einer la le les sous su un una und unter 0 1 2 3 4 5").split())
UNKNOWN, NONE = "unknown", "none"
#: The logit of a family that is refuted.
REFUTED = -1e6
#: The versions that are a family's own; another one in a unit, without any of these, refutes it.
VERSIONS = {"apache-2.0": ["2"], "gpl-2.0": ["2"], "gpl-3.0": ["3"], "agpl-3.0": ["3"], "mpl-2.0": ["2"]}
#: An n-gram that names a version, and what is left of the number without zeros at its end.
VERSION = r"^(?:(?:version|v|license|licence|gpl|agpl|lgpl|apache|mpl) |(?:gpl|agpl|lgpl|mpl)?v)([0-9]+(?:[.][0-9]+)*)$"
ZEROS = r"(?:[.]0)+$"
WORDS = r"[a-z0-9]+(?:[.][0-9]+)*"
#: A family is named from this calibrated probability on, and confirmed from this share of a
#: template's features on; below UNLIKELY for no licence a unit reads like one.
SURE, CONFIRMED, UNLIKELY = 0.6, 0.7, 0.5


@dataclass(frozen=True)
class Settings:
    """variants of each notice; steps, rate and decay of the fit; the share of words left out; and the
    share of ordinary text among units with features, to which the bias is set after the fit."""

    variants: int = 30
    steps: int = 250
    rate: float = 0.5
    decay: float = 2e-4
    dropped: float = 0.1
    ordinary: float = 0.8
    seed: int = 5


def words(text: str) -> list[str]:
    return re.findall(WORDS, text.lower())


def grams(ws: list[str]) -> set[str]:
    return set(ws) | {f"{a} {b}" for a, b in zip(ws, ws[1:])}  # noqa: B905


def features(ws: list[str]) -> set[str]:
    """The n-grams with a word that is no stop word."""
    return {g for g in grams(ws) if not STOP.issuperset(g.split())}


@dataclass
class Model:
    classes: list[str]
    vocabulary: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: list[tuple[str, list[str]]] = field(default_factory=list)

    def telling(self) -> list[str]:
        """The words of features that are no stop words."""
        return sorted({w for g in self.vocabulary for w in g.split()} - STOP)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _fit(x: np.ndarray, y: np.ndarray, k: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    one = np.eye(k)[y]
    w, b = np.zeros((x.shape[1], k)), np.zeros(k)
    gw, gb = np.full(w.shape, 1e-8), np.full(b.shape, 1e-8)
    for _ in range(s.steps):
        d = (softmax(x @ w + b) - one) / len(x)
        dw, db = x.T @ d + s.decay * w, d.sum(0)
        gw += dw**2
        gb += db**2
        w -= s.rate * dw / np.sqrt(gw)
        b -= s.rate * db / np.sqrt(gb)
    return w, b


def train(s: Settings = Settings()) -> Model:
    """Softmax regression on notices and other text, with words left out and other text around them.

    Every fourth text is held out whole, with all its variants, while a first fit sees the others;
    the temperature is that under which the first fit gives the held-out texts the highest
    likelihood. The last fit sees all. It takes seconds and no corpus."""
    rng = np.random.default_rng(s.seed)
    classes = [*NOTICES, UNKNOWN, NONE]
    none = OTHERS + [t.format(n) for t in TALK for n in NAMES]
    texts = [(c, t) for c, ts in enumerate([*NOTICES.values(), OTHER_LICENCES, none]) for t in ts]
    vocabulary = sorted(set().union(*(features(words(t)) for _, t in texts)))
    index = {g: i for i, g in enumerate(vocabulary)}
    rest = [words(t) for t in OTHERS]
    rows, labels, held = [], [], []

    def add(ws: list[str], label: int, out: bool) -> None:
        row = np.zeros(len(vocabulary))
        row[[index[g] for g in features(ws) if g in index]] = 1
        rows.append(row), labels.append(label), held.append(out)

    for k, (c, t) in enumerate(texts):
        ws = words(t)
        for v in range(s.variants if classes[c] != NONE else max(1, s.variants // 3)):
            kept = [w for w in ws if v == 0 or rng.random() > s.dropped]
            around = [rest[i] for i in rng.integers(len(rest), size=v % 3)]
            add(sum(around[:1], []) + kept + sum(around[1:], []), c, k % 4 == 3)
    for k in range(6 * s.variants):  # long ordinary text, and text with few or no features
        few = [w for i in rng.integers(len(rest), size=(0, 1, 3, 12)[k % 4]) for w in rest[i]]
        add(few, len(classes) - 1, k % 8 == 7)
    x, y, out = np.asarray(rows), np.asarray(labels), np.asarray(held)
    w, b = _fit(x[~out], y[~out], len(classes), s)
    z = x[out] @ w + b
    grid = np.geomspace(0.5, 8, 33)
    loss = [-np.log(softmax(z / t)[np.arange(len(z)), y[out]] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    w, b = _fit(x, y, len(classes), s)
    seen = float((y == len(classes) - 1).mean())
    b[-1] += temperature * np.log(s.ordinary / (1 - s.ordinary) * (1 - seen) / seen)
    kinds = [(f, sorted(features(words(t)))) for f, ts in [*NOTICES.items(), (UNKNOWN, OTHER_LICENCES)] for t in ts]
    return Model(classes, vocabulary, w, b, temperature, kinds)


@cache
def trained(s: Settings) -> Model:
    """The model of these settings, trained once."""
    return train(s)


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORDS})"), F.lit(1))


def word_grams(ws: Column) -> Column:
    n = F.greatest(F.size(ws) - 1, F.lit(0))
    return F.array_distinct(F.concat(ws, F.zip_with(F.slice(ws, 1, n), F.slice(ws, 2, n), lambda a, b: F.concat_ws(" ", a, b))))


def described(docs: DataFrame, model: Model) -> DataFrame:
    """row, doc_id and, for rows with a telling word, their lines in order: length, blank, first and
    last word, and all words of lines with a telling one."""
    telling = F.array(*[F.lit(w) for w in model.telling()])
    some = F.coalesce(F.arrays_overlap(word_list(F.col("text")), telling), F.lit(False))
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.length(x).alias("length"), (~x.rlike(r"[^\x20\x09-\x0D]")).alias("blank"), word_list(x).alias("ws")))
    lines = F.transform(lines, lambda x: F.struct(x["length"].alias("length"), x["blank"].alias("blank"), F.get(x["ws"], F.lit(0)).alias("head"), F.get(x["ws"], F.size(x["ws"]) - 1).alias("tail"), F.when(F.arrays_overlap(x["ws"], telling), x["ws"]).alias("ws")))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.when(some, lines).alias("lines"))


def units(rows: DataFrame, model: Model) -> DataFrame:
    """row, kind (0 line, 1 paragraph), id (place of the line, number of the paragraph), paragraph,
    start, end, family, probability, template_share and status (confirmed, unknown or none) of each
    unit with a feature; rows: see described()."""
    spark, k = rows.sparkSession, len(model.classes)
    of = {}
    for i, (_, t) in enumerate(model.templates):
        for g in t:
            of.setdefault(g, []).append(i)
    table_ = [(g, [float(v) for v in w], of.get(g, [])) for g, w in zip(model.vocabulary, model.weights / model.temperature, strict=True)]
    vocabulary = F.broadcast(spark.createDataFrame(table_, "gram string, w array<double>, templates array<int>"))  # as large as the model
    order = Window.partitionBy("row").orderBy("i")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    lines = rows.where("lines is not null").select("row", F.posexplode("lines").alias("i", "l")).select("row", "i", "l.*")
    lines = lines.select(
        "row", "i", (F.sum(F.col("length") + 1).over(run) - F.col("length") - 1).alias("start"), "length", "blank", F.sum(F.col("blank").cast("int")).over(run).alias("paragraph"),
        F.array(F.lag("tail").over(order), "head").alias("ends"), "ws",
    ).where("not blank")
    telling = F.array(*[F.lit(w) for w in model.telling()])
    across = F.when(F.arrays_overlap("ends", telling) & ~F.array_contains(F.transform("ends", F.isnull), True), F.array_join("ends", " "))
    lines = lines.withColumn("across", across).drop("ends", "blank")
    lines = materialize(lines)
    spans = lines.groupBy("row", "paragraph").agg(F.min("start").alias("p_start"), F.max(F.col("start") + F.col("length")).alias("p_end"), F.count("*").alias("n"))
    version = F.regexp_replace(F.nullif(F.regexp_extract("gram", VERSION, 1), F.lit("")), ZEROS, "").alias("version")
    weigh = lambda df: df.select("*", version).join(vocabulary, "gram", "left").where("w is not null or version is not null")
    own = weigh(lines.where("ws is not null").select("row", "i", "paragraph", F.explode(word_grams(F.col("ws"))).alias("gram")))
    joint = weigh(lines.where("across is not null").select("row", "paragraph", F.col("across").alias("gram")))
    both = own.select("row", "paragraph", "gram", "w", "templates", "version").unionByName(joint.select("row", "paragraph", "gram", "w", "templates", "version")).dropDuplicates(["row", "paragraph", "gram"])
    several = both.join(spans.where("n > 1").select("row", "paragraph"), ["row", "paragraph"], "left_semi")
    hits = own.select("row", F.lit(0).alias("kind"), F.col("i").alias("id"), "paragraph", "w", "templates", "version").unionByName(several.select("row", F.lit(1).alias("kind"), F.col("paragraph").cast("int").alias("id"), "paragraph", "w", "templates", "version"))
    unit = ["row", "kind", "id", "paragraph"]
    shared = [F.count_if(F.array_contains("templates", i)) / len(t) for i, (_, t) in enumerate(model.templates)]
    shares = F.array(*[F.greatest(F.lit(0.0), *[shared[i] for i, (f, _) in enumerate(model.templates) if f == c]) if c != NONE else F.lit(0.0) for c in model.classes])
    z = F.array(*[F.coalesce(F.sum(F.col("w")[i]), F.lit(0.0)) + float(model.bias[i] / model.temperature) for i in range(k)])
    scored = hits.groupBy(*unit).agg(z.alias("z"), shares.alias("shares"), F.collect_set("version").alias("versions"))
    own_versions = F.array(*[F.array(*[F.lit(v) for v in VERSIONS.get(c, [])]).cast("array<string>") for c in model.classes])
    refuted = lambda own: (F.size(own) > 0) & (F.size("versions") > 0) & ~F.arrays_overlap(own, F.col("versions"))
    scored = scored.withColumn("z", F.zip_with("z", own_versions, lambda v, own: F.when(refuted(own), F.lit(REFUTED)).otherwise(v))).withColumn("top", F.array_max("z"))
    total = F.aggregate(F.transform("z", lambda v: F.exp(v - F.col("top"))), F.lit(0.0), lambda a, v: a + v)
    names = F.array(*[F.lit(c) for c in model.classes])
    at = F.array_position("z", F.col("top")).cast("int")
    none = F.exp(F.col("z")[k - 1] - F.col("top")) / total
    scored = scored.select(*unit, F.element_at(names, at).alias("named"), (1 / total).alias("probability"), none.alias("none"), F.element_at("shares", at).alias("template_share"), F.array_max("shares").alias("best_share"))
    sure = (F.col("probability") >= SURE) & ~F.col("named").isin(UNKNOWN, NONE) & (F.col("template_share") >= CONFIRMED) & (F.col("template_share") >= F.col("best_share"))
    status = F.when(F.col("none") >= UNLIKELY, NONE).when(sure, "confirmed").otherwise(UNKNOWN)
    scored = scored.withColumn("status", status).withColumn("family", F.when(F.col("status") == "confirmed", F.col("named")).otherwise(F.col("status")))
    at_line = lines.select("row", F.col("i").alias("id"), F.lit(0).alias("kind"), "start", (F.col("start") + F.col("length")).alias("end"))
    at_par = spans.select("row", F.col("paragraph").cast("int").alias("id"), F.lit(1).alias("kind"), F.col("p_start").alias("start"), F.col("p_end").alias("end"))
    return scored.join(at_line.unionByName(at_par), ["row", "kind", "id"]).select(*unit, "start", "end", "family", "probability", "template_share", "status")


def found(scored: DataFrame) -> DataFrame:
    """The units that tell: confirmed lines; confirmed paragraphs without one; unknown lines of
    paragraphs that aren't confirmed; unknown paragraphs in which no line is found."""
    w = Window.partitionBy("row", "paragraph")
    has = lambda kind, *status: F.bool_or((F.col("kind") == kind) & F.col("status").isin(*status)).over(w)
    s = scored.where(F.col("status") != NONE).withColumns({"_line": has(0, "confirmed"), "_whole": has(1, "confirmed"), "_any": has(0, "confirmed", UNKNOWN)})
    line = (F.col("kind") == 0) & ((F.col("status") == "confirmed") | F.col("_line") | ~F.col("_whole"))
    whole = (F.col("kind") == 1) & F.when(F.col("status") == "confirmed", ~F.col("_line")).otherwise(~F.col("_any"))
    return s.where(line | whole).drop("_line", "_whole", "_any")


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """A row per row of docs (doc_id, text): families found (sorted, unknown among them), numbers of
    confirmed and unknown units, the highest probability, and spans as family:start:end in order.

    A null or empty text and a table without notices have empty results; repeated rows and null ids
    are scanned each. Other columns are ignored. No row is left out by its length."""
    model = model or trained(Settings())
    rows = materialize(described(docs, model))
    per = found(units(rows, model)).groupBy("row").agg(
        F.array_sort(F.collect_set("family")).alias("families"), F.count_if(F.col("status") == "confirmed").alias("n_confirmed"), F.count_if(F.col("status") == UNKNOWN).alias("n_unknown"), F.max("probability").alias("probability"),
        F.array_sort(F.collect_list(F.struct("start", "end", "family"))).alias("s"),
    )
    out = rows.select("row", "doc_id").join(per, "row", "left")
    return out.select(
        "doc_id", F.coalesce("families", F.expr("cast(array() as array<string>)")).alias("families"), F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"), F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"), F.round("probability", 6).alias("probability"),
        F.coalesce(F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["family"], x["start"], x["end"])), ","), F.lit("")).alias("spans"),
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
