"""Licence scans: a trained paragraph classifier with a calibrated unknown class, confirmed by templates.

A paragraph is a run of lines between blank lines; a line that ends a sentence or is short
or long ends one too, so that hard-wrapped licence texts are put together again and lists
of statements are not.  Distinct word 1- and 2-grams of a paragraph are the features of a
multinomial logistic regression over licence families and the class ``unknown``, which
knows the licences next to the families too (other versions, variants and denials).  The
model is fitted once, on the driver, on the labelled paragraphs below: statements made
from licence names and phrases, clauses of licence texts, statements of licences that are
no known family, and ordinary prose.  Whole phrases and whole foreign licences are held out; on them the temperature
and the threshold of ``unknown`` are fitted.  Weights are relative to ``unknown``, and
grams that speak for no family by MARGIN at least are left out.

Scoring is DataFrame functions only: grams are joined with the weight table, summed by
paragraph, and turned into probabilities.  A paragraph without any gram that speaks for a
family cannot be told to be of one, so only paragraphs with a word of such a gram are
looked at; these words come from the model.  A prediction is confirmed if the paragraph
covers enough words of one of the family's templates, which the model has not learnt from.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Texts that a family's paragraphs are compared with.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache 2.0 license.",
        "Distributed under the terms of the Apache License 2.0.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "This project is licensed under the MIT license.",
        "Distributed under the terms of the MIT License.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-only",
        "Released under the GPL version 3.",
        "This project is licensed under the GNU GPLv3.",
    ),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "Content is available under CC BY-NC 4.0 for noncommercial use.",
    ),
    "cc-by-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "Text is available under the Creative Commons Attribution 4.0 licence.",
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License 2.0.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright the authors. All rights reserved. No part of this publication may be reproduced without written permission.",
        "This document is confidential and proprietary.",
    ),
}
#: Names of licences; those of ``unknown`` are of no family that is known here.
NAMES: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("Apache License 2.0", "Apache-2.0", "Apache Software License", "ASL 2.0", "Apache licence version 2.0"),
    "mit": ("MIT License", "MIT licence", "MIT", "Expat License", "MIT/X11 license"),
    "gpl-3.0": ("GNU General Public License v3.0", "GPLv3", "GPL-3.0-or-later", "GPL-3.0-only", "GNU GPL version 3", "General Public License, version 3", "GNU General Public License"),
    "cc-by-nc-4.0": ("CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0", "Creative Commons BY-NC license", "CC BY-NC"),
    "cc-by-4.0": ("CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International", "Creative Commons BY license", "CC BY"),
    "bsd-3-clause": ("BSD 3-Clause License", "BSD-3-Clause", "3-clause BSD license", "modified BSD license", "New BSD License", "BSD-style license"),
    "mpl-2.0": ("Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0", "Mozilla Public License, version 2.0"),
    "proprietary": (),
    UNKNOWN: (
        "Foobar Public License", "open data terms of the city", "community licence", "Sunrise Source License 1.0", "custom agreement", "terms that have not been stated", "house rules",
        "Example License, Version 3.0", "Northwind 4.0 International terms", "licence of the museum",
        # licences that are next to a family, but none of it
        "GNU General Public License v2.0", "GPLv2", "GPL-2.0-only", "GPL-2.0-or-later", "GNU GPL version 2", "GNU Lesser General Public License v2.1", "LGPL-2.1", "LGPL-3.0", "GNU Lesser General Public License, version 3",
        "GNU Affero General Public License v3.0", "AGPL-3.0", "BSD 2-Clause License", "BSD-2-Clause", "Simplified BSD License", "ISC License", "ISC", "Eclipse Public License 2.0", "EPL-2.0", "CC BY-SA 4.0",
        "Creative Commons Attribution-ShareAlike 4.0 International", "CC-BY-SA-4.0", "CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0", "CC BY-NC-ND 4.0", "CC BY-NC-SA 4.0",
        "Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "CC0 1.0", "CC BY 3.0", "Apache License, Version 1.1", "Mozilla Public License 1.1", "MPL-1.1", "zlib License", "Boost Software License 1.0", "The Unlicense", "Artistic License 2.0", "European Union Public Licence 1.2",
    ),
}
#: Phrases that state a licence, around its name.
PHRASES = (
    "Licensed under the {}.", "Released under {}.", "This project is available under the terms of the {}.", "Available under {}.",
    "This work is licensed under the {}.", "Distributed under the {}; see the file for details.", "SPDX-License-Identifier: {}", "License: {}",
    "The source code in this repository may be used under {}.", "Copyright 2020 the authors. Provided under the {} license terms.", "All content on this site is published under {}.",
    "You may use, copy and share this document under the {}.",
)
#: Clauses of licence texts, and prose in which the words of licences stand.
CLAUSES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "See the License for the specific language governing permissions and limitations under the License.",
        "You may not use this file except in compliance with the License.",
    ),
    "mit": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "Permission is granted, free of charge, to any person who obtains a copy of this software and its associated documentation, to deal in it without restriction.",
        "hereby granted, free of charge, to any person obtaining a copy",
    ),
    "gpl-3.0": (
        "either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "cc-by-nc-4.0": (
        "You may share and adapt the material for noncommercial purposes, with attribution, under a Creative Commons Attribution-NonCommercial licence.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
        "Attribution-NonCommercial 4.0 International",
    ),
    "cc-by-4.0": (
        "You may share and adapt the material for any purpose, even commercially, with attribution, under a Creative Commons Attribution licence.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
        "Attribution 4.0 International", "The license at http://creativecommons.org/licenses/by/4.0/ applies to this page.",
    ),
    "bsd-3-clause": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistribution and use, with or without modification, are permitted if the conditions below are met.",
        "Redistribution in source or binary forms, with or without modification, is permitted provided that the conditions in this list are met.",
    ),
    "mpl-2.0": (
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "This Source Code Form is subject to the Mozilla Public License.",
        "Covered by the terms of the Mozilla Public License.",
    ),
    "proprietary": (
        "All rights are reserved.", "Copyright 2021 Example Ltd. All rights reserved worldwide.", "(c) 2019 by the publisher, all rights reserved",
        "No part of this book may be reproduced or transmitted in any form without the written permission of the publisher.",
        "This text is confidential and proprietary to the company.", "Proprietary and confidential. Unauthorised copying of this file is strictly prohibited.",
        "Reproduction without prior written permission of the owner is prohibited.", "Confidential: for internal use only, do not distribute.",
    ),
    UNKNOWN: (
        "", "The driver was fined because his license had expired.", "She asked for permission to leave the room.", "The warranty covers parts and labour for two years.",
        "He wrote a long article about copyright and the history of printing.", "A fishing licence can be bought at the lake.", "The version of the story that we know is the third one.",
        "The students of the institute published their work under a different name.", "The restaurant is licensed to sell wine.", "Public transport is free of charge on Sunday.",
        "The general public may use the source of the river.", "This project is funded by the state.", "The rights of the workers were not respected at the time.",
        "Seats are reserved for the members of the club.", "All tables were reserved.", "The book was written by a student of mathematics at MIT.", "Apache helicopters were seen over the valley.",
        "She studied the commons and the creative arts.", "The document was kept confidential for thirty years.", "A later version of the program will be shown in May.", "Free software was given to schools.",
        "The attribution of the painting is not certain.", "Commercial and noncommercial flights share the runway.", "Any person can obtain a copy of the map at the desk.", "The conditions were met and the contract was signed.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "This project is not licensed under the MIT License.", "The code is not released under the Apache License.", "It was never available under the GNU General Public License.",
        "The binary star was found in 2020.", "The foundation published its list of conditions.", "Distribution of food began in the morning.", "The name of the holder of the ticket must be given.",
    ),
}
_TOKEN = r"[\p{L}\p{N}]+(?:[.+-][\p{L}\p{N}]+)*"
_PY_TOKEN = re.compile(r"[^\W_]+(?:[.+-][^\W_]+)*")
CONFIRM = 0.8
#: Versions of the families that have them; a statement that names only others is of no family here.
VERSIONS: dict[str, tuple[str, ...]] = {"apache-2.0": ("2", "2.0"), "gpl-3.0": ("3", "3.0"), "cc-by-nc-4.0": ("4", "4.0"), "cc-by-4.0": ("4", "4.0"), "mpl-2.0": ("2", "2.0")}
#: Marks of licences that are next to a family but none of it, in lower case.
FOREIGN = (
    r"lesser|library general|affero|[la]gpl|share-?alike|by-(?:nc-)?sa\b|no-?deriv|by-(?:nc-)?nd\b|(?:[012]|zero|two)-clause|simplified bsd|\bisc\b|\bepl\b|eclipse public|zlib|\bcc0|unlicense|artistic licen|boost software|\beupl\b|european union public"
)
#: Marks of the non-commercial family, which cc-by-4.0 must not have.
NONCOMMERCIAL = r"non-?commercial|by-nc"
#: A number that tells a licence's version.
_VERSION = r"(?:versions?|\bv|licen[cs]es?|gpl|mpl|apache|asl|epl|eupl|\bby|\bnc|\bsa|\bnd|attribution|commercial|alike|derivatives|derivs)(?:\.|,? ?version| v\.?)?[ ,/-]{0,2}v?\.? ?(\d+(?:\.\d+)*)"
#: A statement that a licence does not hold.
DENIED = r"\b(?:not|never|no longer|isn't|neither|nor)(?: \w+){0,2} (?:licen[cs]ed|released|distributed|available|published|provided|covered|under)\b"
#: What a gram must add to a family's score against unknown's to be a feature.
MARGIN = 0.1
#: Words too common to be features alone.
PLAIN = (
    "a", "all", "an", "and", "any", "are", "as", "at", "be", "but", "by", "can", "do", "either", "even", "for", "from", "if", "in", "is", "it", "its", "later", "may", "must", "name",
    "new", "no", "nor", "not", "of", "on", "one", "only", "or", "other", "see", "shall", "so", "that", "the", "this", "to", "under", "use", "used", "was", "will", "with", "work", "you", "your",
)
#: Lengths of a line that can be one of a wrapped text.
WRAPPED = (40, 100)


def labelled_paragraphs() -> list[tuple[str, str]]:
    """(family, text) of all labelled paragraphs, none of which is a template."""
    made = [(f, p.format(n)) for f, names in NAMES.items() for n in names for p in PHRASES]
    made += [(f, t) for f, texts in CLAUSES.items() for t in texts]
    known = {t for texts in TEMPLATES.values() for t in texts}
    return [(f, t) for f, t in made if t not in known]


def _drawn(text: str) -> bool:
    return sha256(text.encode()).digest()[0] < 64


@lru_cache
def _held_statements() -> frozenset[str]:
    """Statements with a phrase that is held out (every fourth), or with a licence of no known family that is: calibration sees phrases and neighbours that the model has not."""
    return frozenset(p.format(n) for f, names in NAMES.items() for n in names for p in PHRASES if p in PHRASES[3::4] or (f == UNKNOWN and _drawn(n)))


def held_out(text: str) -> bool:
    """Whether a labelled paragraph is kept for calibration: whole phrases, whole licences of no family and clauses, a quarter of these by hash."""
    return text in _held_statements() or (text in _clauses() and _drawn(text))


@lru_cache
def _clauses() -> frozenset[str]:
    return frozenset(t for texts in CLAUSES.values() for t in texts)


def _grams(text: str) -> list[str]:
    w = _PY_TOKEN.findall(text.lower())
    return sorted({*(x for x in w if x not in PLAIN), *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False) if a not in PLAIN or b not in PLAIN)})


@dataclass(frozen=True)
class Classifier:
    """Weights of grams for each family against unknown (whose own are 0), at the calibrated temperature."""

    families: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    threshold: float

    def triggers(self) -> list[str]:
        """Words of which a paragraph must have one to be of a known family."""
        words = set()
        for gram, w in self.weights.items():
            if max(w) > 0:
                words.add(max(gram.split(" "), key=lambda x: (x not in PLAIN, len(x), x)))
        return sorted(words)


def _fit(x: np.ndarray, y: np.ndarray, share: np.ndarray, rounds: int, rate: float, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights (grams x families) and biases by gradient descent; the last family is unknown."""
    families = int(y.max()) + 1
    weights, bias, target = np.zeros((x.shape[1], families)), np.zeros(families), np.eye(families)[y]
    for _ in range(rounds):
        z = x @ weights + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        error = share[:, None] * (p / p.sum(axis=1, keepdims=True) - target)
        weights -= rate * (x.T @ error + decay * weights)
        bias -= rate * error.sum(axis=0)
    return weights - weights[:, -1:], bias - bias[-1]


@lru_cache
def train(rounds: int = 600, rate: float = 1.0, decay: float = 2e-4) -> Classifier:
    """The classifier, fitted on three quarters of the labelled paragraphs and calibrated on the rest.

    Every family weighs the same.  The temperature minimises the held-out log loss; the
    threshold is the probability of a family under which a held-out paragraph is more
    often wrong than right, and no lower than what any held-out unknown paragraph reaches.
    """
    families = [*TEMPLATES, UNKNOWN]
    rows = [(_grams(t), families.index(f), held_out(t)) for f, t in labelled_paragraphs()]
    grams = sorted({g for found, _, out in rows if not out for g in found})
    y, out = np.array([k for _, k, _ in rows]), np.array([o for _, _, o in rows])
    for keep in (None, MARGIN):
        place = {g: i for i, g in enumerate(grams)}
        x = np.zeros((len(rows), len(grams)))
        for r, (found, _, _) in enumerate(rows):
            at = [place[g] for g in found if g in place]
            x[r, at] = 1 / np.sqrt(len(found) or 1)
        share = 1 / np.bincount(y[~out])[y[~out]]
        weights, bias = _fit(x[~out], y[~out], share, rounds, rate, decay)
        if keep is None:
            # negative weights alone cannot name a family, but they keep others from it
            grams = [g for g, w in zip(grams, weights, strict=True) if np.abs(w).max() >= MARGIN]
    z = x[out] @ weights + bias

    def chances(t: float) -> np.ndarray:
        p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return p / p.sum(axis=1, keepdims=True)

    each = 1 / np.bincount(y[out], minlength=len(families)).clip(1)[y[out]]
    steps = [0.1 * 1.1**k for k in range(48)]
    best = min(steps, key=lambda t: -(each * np.log(chances(t)[np.arange(len(z)), y[out]])).sum())
    p = chances(best)[:, :-1]
    top, right = p.max(axis=1), p.argmax(axis=1) == y[out]
    # what contradicts itself is unknown at any probability
    held = [t for f, t in labelled_paragraphs() if held_out(t)]
    top = np.where([contradicts(families[k], t) for k, t in zip(p.argmax(axis=1), held, strict=True)], 0.0, top)
    wrong = y[out] == len(families) - 1
    cuts = [c / 100 for c in range(30, 96)]
    threshold = min(cuts, key=lambda c: (((top >= c) & ~right).sum() + ((top < c) & ~wrong).sum(), c))
    threshold = max(threshold, min(0.95, float(top[wrong].max(initial=0.0)) + 1e-6))
    table = {g: tuple((w / best).tolist()) for g, w in zip(grams, weights, strict=True)}
    return Classifier(tuple(families), table, tuple((bias / best).tolist()), threshold)


def _weight_table(spark: SparkSession, weights: dict[str, tuple[float, ...]]) -> DataFrame:
    """One row for each gram of the model: a fixed, small table."""
    return spark.createDataFrame([(g, list(w)) for g, w in sorted(weights.items())], "gram string, weight array<double>")


def _any_word(words: list[str]) -> str:
    """A pattern of any of the words, tried by first letter."""
    by_letter: dict[str, list[str]] = {}
    for w in words:
        by_letter.setdefault(w[0], []).append(re.escape(w[1:]))
    return r"(?i)(?<![\p{L}\p{N}])(?:" + "|".join(f"{re.escape(a)}(?:{'|'.join(sorted(rest, reverse=True))})" for a, rest in sorted(by_letter.items())) + r")(?![\p{L}\p{N}])"


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text, in order; each line of it is in one."""
    lines = F.split(text, r"\r?\n")
    low, high = WRAPPED
    goes_on = lambda x: F.length(x).between(low, high) & ~x.rlike(r"[.!?:;]\s*$")
    return F.split(F.array_join(F.transform(lines, lambda x: F.concat(x, F.when(goes_on(x), F.lit(" ")).otherwise(F.lit("\n")))), ""), r"\s*\n\s*")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def contradicts(family: str, text: str) -> bool:
    """_contradicted() of one text, for calibration."""
    low = text.lower()
    versions = set(re.findall(_VERSION, low))
    other = bool(versions) and family in VERSIONS and not versions & set(VERSIONS[family])
    foreign = family != "proprietary" and (re.search(FOREIGN, low) or re.search(DENIED, low))
    return bool(other or foreign or (family == "cc-by-4.0" and re.search(NONCOMMERCIAL, low)))


def _signs(text: Column) -> Column:
    """What tells variants apart: versions, marks of other licences, and whether the statement is denied."""
    low = F.lower(text)
    return F.struct(
        F.array_distinct(F.regexp_extract_all(low, F.lit(_VERSION), F.lit(1))).alias("versions"), low.rlike(FOREIGN).alias("foreign"),
        low.rlike(NONCOMMERCIAL).alias("noncommercial"), low.rlike(DENIED).alias("denied"),
    )


def _contradicted(family: Column) -> Column:
    """Whether a paragraph says itself that it is of another version or variant than the family, or that the licence does not hold."""
    found = (F.col("signs.foreign") | F.col("signs.denied")) & (family != "proprietary")
    found = found | ((family == "cc-by-4.0") & F.col("signs.noncommercial"))
    for name, own in VERSIONS.items():
        found = found | ((family == name) & (F.size("signs.versions") > 0) & ~F.arrays_overlap("signs.versions", F.array(*[F.lit(v) for v in own])))
    return found


def scan(docs: DataFrame, *, unknown_below: float | None = None, confirm: float = CONFIRM) -> DataFrame:
    """One row for each paragraph of docs with a word that speaks for a licence, with its family.

    Columns: doc_id, paragraph (its number from 0), family, probability (calibrated),
    similarity (largest share of a family template's words that the paragraph holds) and
    confirmed.  A family of less than `unknown_below` probability (by default the
    calibrated threshold), or one whose version or variant the paragraph contradicts
    itself, becomes ``unknown``, which has similarity 0 and is never confirmed; where a
    family has versions and the paragraph tells none, similarity is halved.  Null and empty texts have no rows; repeated rows of docs give repeated
    rows; of equal scores the family named first counts; long texts are more paragraphs; no
    documents give no rows.  Other columns of docs are ignored.
    """
    spark, model = docs.sparkSession, train()
    least = model.threshold if unknown_below is None else unknown_below
    speaks = _any_word(model.triggers())
    words = _words(F.col("each"))
    candidates = (
        docs.where(F.col("text").rlike(speaks))
        .select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("paragraph", "each"))
        .where(F.col("each").rlike(speaks))
        # a number for each paragraph, as doc_id may repeat; words are all that is carried on
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", "paragraph", F.array_distinct(words).alias("words"), words.alias("w"), _signs(F.col("each")).alias("signs"))
    )
    both = lambda a, b: F.when(~(a.isin(*PLAIN) & b.isin(*PLAIN)), F.concat_ws(" ", a, b))
    pairs = F.when(F.size("w") > 1, F.array_compact(F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), both)))
    single = F.filter("words", lambda x: ~x.isin(*PLAIN))
    candidates = candidates.withColumn("grams", F.array_union(single, F.coalesce(pairs, F.array().cast("array<string>")))).drop("w")
    known = model.families[:-1]
    scores = [F.sum(F.col("weight")[k]).alias(f"z{k}") for k in range(len(known))]
    found = candidates.select("row", F.explode("grams").alias("gram")).join(F.broadcast(_weight_table(spark, model.weights)), "gram").groupBy("row").agg(*scores)
    z = F.array(*[F.lit(b) + F.coalesce(F.col(f"z{k}"), F.lit(0.0)) / F.sqrt(F.greatest(F.size("grams"), F.lit(1))) for k, b in enumerate(model.bias[:-1])])
    scored = candidates.join(found, "row", "left").select("doc_id", "paragraph", "words", "signs", z.alias("z")).withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.exp(-F.col("top")), lambda t, v: t + F.exp(v - F.col("top")))
    named = F.element_at(F.array(*[F.lit(f) for f in known]), F.array_position("z", F.col("top")).cast("int"))
    judged = scored.withColumn("probability", F.lit(1.0) / total)
    judged = judged.withColumn("family", F.when((F.col("probability") < least) | _contradicted(named), F.lit(UNKNOWN)).otherwise(named))
    return _confirmed(judged, confirm).select("doc_id", "paragraph", "family", "probability", "similarity", "confirmed")


def _confirmed(judged: DataFrame, confirm: float) -> DataFrame:
    """Compare with the family's templates; each is a literal, so no join is needed."""
    share = F.lit(0.0)
    for family, texts in TEMPLATES.items():
        words = [sorted(set(_PY_TOKEN.findall(t.lower()))) for t in texts]
        of = [F.size(F.array_intersect("words", F.array(*[F.lit(w) for w in ws]))) / F.lit(len(ws)) for ws in words]
        share = F.when(F.col("family") == family, F.greatest(*of) if len(of) > 1 else of[0]).otherwise(share)
    # a template's words say little of a family with versions unless its version is told
    untold = F.lit(False)
    for family, own in VERSIONS.items():
        untold = untold | ((F.col("family") == family) & ~F.arrays_overlap("signs.versions", F.array(*[F.lit(v) for v in own])))
    share = F.when(untold, share / 2).otherwise(share)
    return judged.withColumn("similarity", share.cast("double")).withColumn("confirmed", F.col("similarity") >= confirm)
