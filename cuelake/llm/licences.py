"""Licence scan: a trained paragraph classifier, confirmed by template comparison.

Every non-empty line of a text is a paragraph.  A multinomial logistic regression
over hashed word 1- and 2-grams gives each paragraph a licence family or
``unknown``; a paragraph whose calibrated probability of being of any family stays under the
threshold is unknown.  A prediction counts only when a template of that family is
contained in the paragraph, or the paragraph in the template, by word pairs, and no
other family's template fits better.

The classifier is trained when first used: from the published texts below, whole,
by sentence, in lines and cut at random (seeded), alone and amid plain words, and
from identifiers made by rule; against plain sentences, licence words in no order and at most
``MAX_PLAIN`` short paragraphs of the scanned corpus that hold no licence word.
Temperature and threshold come from a first training that has not seen one whole
template in four.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm import ngrams

BINS = 1 << 13
MAX_PLAIN, MAX_PLAIN_CHARS = 500, 400
CONFIRM, COMMON = 0.6, 5  # least likeness; families from which on a word pair says nothing
UNKNOWN = "unknown"

# Licence names, notices and paragraphs as their authors publish them.
#: Lines of licences that are none of the families.
STRANGERS = [
    "Eclipse Public License - v 2.0", "Eclipse Public License, Version 1.0",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "European Union Public Licence v. 1.2", "Licensed under the EUPL, Version 1.2", "The Artistic License 2.0", "SIL Open Font License, Version 1.1",
    "Boost Software License - Version 1.0", "Common Development and Distribution License (CDDL) Version 1.0", "Microsoft Public License (Ms-PL)",
    "Academic Free License v3.0", "Open Software License 3.0", "Python Software Foundation License Version 2", "IBM Public License Version 1.0",
    "Business Source License 1.1", "Server Side Public License v1", "Elastic License 2.0", "Sun Public License Version 1.0", "PostgreSQL License",
]
#: Short lines in four languages, by code and version.
SHORT_CC = (
    "This work is licensed under {code} {v}", "Dieses Werk steht unter der Lizenz {code} {v}", "Cette œuvre est mise à disposition sous licence {code} {v}",
    "Esta obra está bajo una licencia {code} {v}", "{code} {v}",
)
GNU_VERSIONS = {"gpl": (2, 3), "lgpl": (2, 3), "agpl": (3,)}
#: The standard notice of the GNU licences, by name and version.
GNU_NAMES = {"gpl": "GNU General", "lgpl": "GNU Lesser General", "agpl": "GNU Affero General"}
GNU_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {name} Public License as published by the Free "
    "Software Foundation, either version {v} of the License, or (at your option) any later version."
)
NOTICES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "The MIT License (MIT)",
        "MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "GNU GENERAL PUBLIC LICENSE",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "Licensed under the GPL, version 2 or later.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "Licensed under the LGPL, version 3 or later.",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the AGPL, version 3 or later.",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "BSD 3-Clause License",
        "BSD 2-Clause Simplified License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY.",
    ],
    "isc": [
        "Licensed under the ISC License.",
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Creative Commons Attribution 4.0 International Public License",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Creative Commons Attribution-ShareAlike 4.0 International Public License",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Creative Commons Attribution-NonCommercial 4.0 International Public License",
    ],
    "cc-by-nc-sa": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International Public License",
    ],
    "cc-by-nd": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Creative Commons Attribution-NoDerivatives 4.0 International Public License",
    ],
    "cc-by-nc-nd": [
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the author has waived all copyright; CC0 1.0 Universal.",
        "CC0 1.0 Universal Public Domain Dedication",
        "This work has been placed in the public domain.",
    ],
    "proprietary": [
        "All rights reserved. No part of this work may be reproduced without written permission.",
        "This document is proprietary and confidential; unauthorized copying is prohibited.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
    ],
}
# Registered identifiers are a family's name, a version, and for some a way to go on.
IDENTIFIERS: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] = {
    "apache-2.0": ("Apache", ("2.0",), ("",)), "mit": ("MIT", ("",), ("",)), "isc": ("ISC", ("",), ("",)), "mpl-2.0": ("MPL", ("2.0",), ("",)),
    "gpl": ("GPL", ("1.0", "2.0", "3.0"), ("-only", "-or-later", "+", "")), "lgpl": ("LGPL", ("2.0", "2.1", "3.0"), ("-only", "-or-later", "+", "")),
    "agpl": ("AGPL", ("3.0",), ("-only", "-or-later", "")), "bsd": ("BSD", ("2-Clause", "3-Clause", "4-Clause"), ("",)),
    "cc-by": ("CC-BY", ("3.0", "4.0"), ("",)), "cc-by-sa": ("CC-BY-SA", ("3.0", "4.0"), ("",)), "cc-by-nc": ("CC-BY-NC", ("3.0", "4.0"), ("",)),
    "cc-by-nc-sa": ("CC-BY-NC-SA", ("3.0", "4.0"), ("",)), "cc-by-nd": ("CC-BY-ND", ("3.0", "4.0"), ("",)),
    "cc-by-nc-nd": ("CC-BY-NC-ND", ("3.0", "4.0"), ("",)), "public-domain": ("CC0", ("1.0",), ("",)),
}
#: Sentences with licence words that grant nothing.
PLAIN = [
    "You need a driving license to rent a car here.",
    "The apache tribe lived in the south west.",
    "The general public was not permitted to enter.",
    "She studied at MIT and released her second album last year.",
    "The version of the story in this work is new.",
    "Creative people share their work in common rooms.",
    "No copyright was mentioned in the letter.",
    "The patent was licensed to a company under an agreement.",
    "He gave permission and the copy was free of charge.",
    "The conditions are met and the source is open.",
    "The license of the pub was not renewed after version two of the law.",
    "A free copy of the programme was given to any person at the door.",
    "Public works in general are licensed by the town.",
    "The lesser of the two foundations published the terms.",
    "SPDX-License-Identifier:",
    "This file is distributed under the Sunshine Data Licence 1.0.",
    "Use of the service is governed by the terms of the agreement between the parties.",
]
LICENCE_WORD = "(?i)licen[sc]|copyright|spdx|rights reserved|public domain|creative commons|redistribut|warrant"


def templates() -> dict[str, list[str]]:
    """Every family's texts: what is published, and its identifiers."""
    out = {f: list(n) for f, n in NOTICES.items()}
    for family, (name, versions, more) in IDENTIFIERS.items():
        for v in versions:
            out[family] += [f"SPDX-License-Identifier: {name}{'-' * bool(v)}{v}{m}" for m in more]
        if family.startswith("cc-"):
            code = name.replace("CC-", "CC ")
            out[family] += [line.format(code=code, v=v) for v in versions for line in SHORT_CC]
    for family, versions in GNU_VERSIONS.items():
        out[family] += [GNU_NOTICE.format(name=GNU_NAMES[family], v=v) for v in versions]
    return out


@dataclass(frozen=True)
class Classifier:
    """Weights by bin and class (class 0: unknown), a temperature, a threshold on the probability, and templates."""

    families: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    pairs: dict[str, list[frozenset]]
    common: frozenset

    def logits(self, lines: list[np.ndarray]) -> np.ndarray:
        """One row per paragraph of bins: the sum of their weights over the root of their number."""
        sizes = np.array([len(x) for x in lines])
        out = np.tile(self.bias, (len(lines), 1))
        full = np.flatnonzero(sizes)
        if full.size:
            starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
            sums = np.add.reduceat(self.weights[np.concatenate([lines[i] for i in full])], starts, axis=0)
            out[full] += sums / np.sqrt(sizes[full])[:, None]
        return out

    def predict(self, lines: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(class, probability) of every paragraph: the likeliest family, or class 0 when being of any is under the threshold."""
        p = self.probabilities(lines)
        best = p[:, 1:].argmax(axis=1) + 1
        return np.where(1 - p[:, 0] >= self.threshold, best, 0), p[np.arange(len(p)), best]

    def probabilities(self, lines: list[np.ndarray]) -> np.ndarray:
        """One row per paragraph, one column per family, the unknown one first."""
        return softmax(self.logits(lines) / self.temperature)

    def likeness(self, family: str, own: frozenset) -> float:
        """Share of word pairs of the family's closest template, or of the paragraph, that the other has."""
        return max((len(own & t) / max(1, min(len(own), len(t))) for t in self.pairs[family]), default=0.0)

    def settled(self, family: str, paragraph: str) -> tuple[str, float]:
        """(family, likeness): the predicted family if none has a closer template, else the one that has.

        (unknown, 0) when no template comes close enough, or one of a licence outside
        the families comes as close; pairs that many families use do not count.
        """
        own = _pairs(paragraph) - self.common
        fits = {f: self.likeness(f, own) for f in self.pairs}
        best = max(fits, key=lambda f: (fits[f], f == UNKNOWN, f == family))
        return (best, fits[best]) if best != UNKNOWN and fits[best] >= CONFIRM else (UNKNOWN, 0.0)

    def confirmed(self, family: str, paragraph: str) -> float:
        """The likeness, or 0 when another family's template fits better."""
        found, fits = self.settled(family, paragraph)
        return fits if found == family else 0.0


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sentences(notice: str) -> list[str]:
    """The notice, and each of its sentences if it has more than one."""
    parts = re.split(r"(?<=[.;])\s+(?=[A-Z])", notice)
    return [notice, *parts] if len(parts) > 1 else parts


def _variants(text: str, words: list[str], rng: np.random.Generator) -> Iterator[str]:
    """A template whole and cut, its sentences, its lines as a page wraps them, alone and amid plain words."""
    for part in dict.fromkeys(sentences(text)):
        own = part.split()
        for n in range(6):
            cut = own[: len(own) - int(rng.integers(0, len(own) // 4))] if n and len(own) > 6 else own
            around = [words[i] for i in rng.integers(0, len(words), int(rng.integers(0, 12)) * (n > 1))]
            at = int(rng.integers(0, len(around) + 1))
            yield " ".join(around[:at] + cut + around[at:])
        for at in range(0, len(own) - 9, 5) if len(own) > 16 else ():
            yield " ".join(own[at : at + int(rng.integers(9, 15))])


def _examples(known: dict[str, list[str]], plain: list[str], rng: np.random.Generator) -> tuple[list[str], list[str]]:
    """Texts and their families: variants of the templates, licence words in no order, plain paragraphs."""
    words = [w for p in plain + PLAIN for w in p.split()]
    found = [(v, family) for family, texts in known.items() for t in texts for v in _variants(t, words, rng)]
    vocabulary = sorted({w for texts in known.values() for t in texts for w in t.split()})
    found += [(" ".join(rng.choice(vocabulary, int(rng.integers(2, 9)))), UNKNOWN) for _ in range(400)]
    found += [(p, UNKNOWN) for p in plain + PLAIN * 20]
    return [t for t, _ in found], [f for _, f in found]


def _bins(texts: list[str]) -> list[np.ndarray]:
    return [ngrams.bins(ngrams.token_hashes(t), BINS) for t in texts]


def _fit(texts: list[str], labels: list[str], families: list[str], rounds: int, rate: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) by full-batch gradient descent with momentum; only bins that occur have weights."""
    lines = _bins(texts)
    used, where = np.unique(np.concatenate(lines), return_inverse=True)
    x = np.zeros((len(lines), len(used)), np.float32)
    np.add.at(x, (np.repeat(np.arange(len(lines)), [len(z) for z in lines]), where), 1.0)
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    y = np.array([families.index(f) for f in labels])
    # Every family weighs the same as any other, unknown as much as all of them.
    share = np.where(y == 0, 0.5, 0.5 / max(1, len(families) - 1)) / np.bincount(y, minlength=len(families))[y]
    w, b = np.zeros((len(used), len(families)), np.float32), np.zeros(len(families), np.float32)
    dw, db, onehot = np.zeros_like(w), np.zeros_like(b), np.eye(len(families), dtype=np.float32)[y]
    for _ in range(rounds):
        g = ((softmax(x @ w + b) - onehot) * share[:, None]).astype(np.float32)
        dw, db = 0.9 * dw + x.T @ g + l2 * w, 0.9 * db + g.sum(axis=0)
        w, b = w - rate * dw, b - rate * db
    weights = np.zeros((BINS, len(families)), np.float32)
    weights[used] = w
    return weights, b


def train(
    plain: list[str], seed: int = 0, rounds: int = 120, rate: float = 4.0, l2: float = 1e-5, known: dict[str, list[str]] | None = None
) -> Classifier:
    """The classifier of the families of ``known`` (default: ``templates()``).

    A first training leaves out every fourth template of a family and every fourth
    plain paragraph; what it says of their variants sets temperature and threshold.
    """
    known = templates() if known is None else known
    families = [UNKNOWN, *known]
    rng = np.random.default_rng(seed)
    fit = {f: [t for i, t in enumerate(texts) if i % 4 != 3] for f, texts in known.items()}
    weights, bias = _fit(*_examples(fit, [p for i, p in enumerate(plain) if i % 4], rng), families, rounds, rate, l2)
    first = Classifier(families, weights, bias, 1.0, 0.0, *_closest(fit))
    held = {f: texts[3::4] for f, texts in known.items()}
    texts, labels = _examples(held, plain[::4], rng)
    z, y = first.logits(_bins(texts)), np.array([families.index(f) for f in labels])

    def loss(t: float) -> float:
        return float(-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean())

    temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
    p = softmax(z / temperature)
    stray = 1 - p[y == 0, 0]
    threshold = float(np.clip(np.quantile(stray, 0.95) if stray.size else 0.5, 0.5, 0.7))
    weights, bias = _fit(*_examples(known, plain, rng), families, rounds, rate, l2)
    return Classifier(families, weights, bias, temperature, threshold, *_closest(known))


def _closest(known: dict[str, list[str]]) -> tuple[dict[str, list[frozenset]], frozenset]:
    """Word pairs of every family's templates, those of strangers under unknown, and the pairs that many families use."""
    pairs = {f: [_pairs(s) for n in texts for s in sentences(n)] for f, texts in known.items()}
    users = Counter(p for sets in pairs.values() for p in frozenset().union(*sets))
    common = frozenset(p for p, n in users.items() if n >= COMMON)
    pairs = {f: [t - common for t in sets if t - common] for f, sets in pairs.items()}
    return {**pairs, UNKNOWN: [_pairs(s) - common for s in STRANGERS]}, common


def _pairs(text: str) -> frozenset[tuple[str, str]]:
    words = re.findall(r"\w+", text.lower())
    return frozenset(zip(words, words[1:], strict=False)) or frozenset((w, "") for w in words)


def scan_text(model: Classifier, text: str | None) -> list[tuple[int, str, float, float]]:
    """(line, family, probability, likeness) of every confirmed paragraph of a text."""
    lines = [(i, x) for i, x in enumerate((text or "").split("\n")) if x.strip()]
    out = []
    for at in range(0, len(lines), 4096):
        part = lines[at : at + 4096]
        p = model.probabilities([ngrams.bins(ngrams.token_hashes(x), BINS) for _, x in part])
        for k in np.flatnonzero(1 - p[:, 0] >= model.threshold):
            family, fits = model.settled(model.families[int(p[k, 1:].argmax()) + 1], part[k][1])
            if fits:
                out.append((part[k][0], family, round(float(p[k, model.families.index(family)]), 6), round(fits, 6)))
    return out


def plain_paragraphs(docs: DataFrame, text_col: str = "text", most: int = MAX_PLAIN) -> list[str]:
    """At most ``most`` paragraphs of at most ``MAX_PLAIN_CHARS`` characters without a licence word, in hash order.

    They are what the unknown class is fitted on; every paragraph is scanned, whatever its length.
    """
    lines = docs.select(F.explode(F.split(F.col(f"`{text_col}`"), "\n")).alias("line")).where(
        F.length("line").between(1, MAX_PLAIN_CHARS) & ~F.col("line").rlike(LICENCE_WORD)
    )
    return [r["line"] for r in lines.orderBy(F.xxhash64("line"), "line").limit(most).collect()]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """(id, families, n_found, found): the licences of every row.

    ``found`` lists (line, family, probability, likeness) by line, ``families``
    the distinct names in order.  Null, empty and licence-free texts give empty
    lists.  Repeated rows and null ids come out as they came; other columns are
    not read.
    """
    model = train(plain_paragraphs(docs, text_col), seed)
    kind = docs.schema[id_col].dataType.simpleString()
    item = pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("likeness", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [
                [dict(zip(("line", "family", "probability", "likeness"), x, strict=True)) for x in scan_text(model, t.as_py())]
                for t in b.column(1)
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(item))], ["id", "found"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        run, f"id {kind}, found array<struct<line int, family string, probability double, likeness double>>"
    )
    return rows.select(
        F.col("id").alias(id_col),
        F.array_sort(F.array_distinct(F.col("found.family"))).alias("families"),
        F.size("found").alias("n_found"),
        "found",
    )
