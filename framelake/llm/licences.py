"""Licence scan of paragraphs by a trained classifier. DataFrame functions only on the main path.

A paragraph is a line of a text, joined with the lines after it as long as it is wrapped: ``WRAPPED`` characters
long, with no end of a sentence, and the next line begins without a space. It is lower-cased and cut into
words ``[a-z0-9]+``. Its features are the distinct n-grams of one and two words that templates hold, but those
of common words alone. A multinomial logistic regression gives a probability to
each licence family and to the class ``unknown``. It is trained here, on windows of the templates below, whole
licence texts among them, and on texts that are no licence or one of no family here, and made sparse.

Its temperature and the probability that a family must reach are set on templates and other texts that the
training left out: in each of ``FOLDS`` folds a model is trained without a share of the templates and others and
scores those. The bar is the least at which no more than ``FALSE_RATE`` of the left-out others pass. A prediction is
confirmed where its pairs of words agree with a template of the family.

Scoring needs no shuffle. Words that alone can carry a score over the bar are anchors: by the model's weights,
no paragraph without one can reach it whatever else it holds, so only paragraphs with an anchor are scored.
That bound is computed, not assumed (``Model.anchors``), and tests hold results against scoring everything.

Defined cases: null and empty texts have no paragraph; repeated rows and paragraphs are each reported; paragraphs
of any length are scored whole; of classes with equal scores the first in order of the templates is named, and
unknown last; an empty table gives no rows; other columns, whatever their names, are ignored; a null id stays null.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

UNKNOWN = "unknown"
FALSE_RATE, SIMILARITY, FOLDS = 0.01, 0.5, 4
#: Weights are shrunk by this at each step, so that most are zero.
SHRINK = 2e-4
VARIANTS, STEPS, SEED = 12, 120, 11
#: Characters of a wrapped line.
WRAPPED = (40, 120)
# Words that alone tell nothing of a licence.
STOP = set("a above all an and any are as at be been by following for free from has if in is it its may no not obtain of on or other out part person point provided that the this to under use used was were will with without you your".split())

# How licences are named and begin, and their texts.
NO_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
GNU_NOTICE = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details. You should have received a copy of the {0} along with this program. If not, see <https://www.gnu.org/licenses/>."
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0", "This project is released under the Apache 2.0 license", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License", "The MIT License (MIT)", "SPDX-License-Identifier: MIT", "This software is distributed under the terms of the MIT license", "Licensed under the MIT License",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + NO_WARRANTY,
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause", "Released under the 2-clause BSD license", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "ISC": ["Licensed under the ISC License", "SPDX-License-Identifier: ISC", "Released under the ISC license", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Zlib": ["Released under the zlib license", "SPDX-License-Identifier: Zlib", "Licensed under the zlib/libpng License", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0", "SPDX-License-Identifier: BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003", "Use, modification and distribution are subject to the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"],
    "EPL-2.0": ["Licensed under the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0", "Eclipse Public License - v 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "Unlicense": ["SPDX-License-Identifier: Unlicense", "This is free and unencumbered software released into the public domain.", "Released under the Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. For more information, please refer to <https://unlicense.org/>"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GPLv3 license", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "Licensed under GPL 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        GNU_NOTICE.format("GNU General Public License"),
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only", "Released under the GPLv2 license", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "Licensed under GPL 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-or-later", "Released under the LGPL license", "GNU LESSER GENERAL PUBLIC LICENSE", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", GNU_NOTICE.format("GNU Lesser General Public License")],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only", "Released under the AGPL license", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", GNU_NOTICE.format("GNU Affero General Public License")],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0", "Released under the MPL 2.0 license", "Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "CC-BY": ["Licensed under CC BY 4.0", "SPDX-License-Identifier: CC-BY-4.0", "Released under CC BY", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Text is available under the Creative Commons Attribution License"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0", "SPDX-License-Identifier: CC-BY-SA-4.0", "Released under CC BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0", "SPDX-License-Identifier: CC-BY-NC-4.0", "Released under CC BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Text is available under the Creative Commons Attribution-NonCommercial License"],
    "CC0": ["Released under CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0", "Dedicated to the public domain under the CC0 license", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "CC0 1.0 Universal Public Domain Dedication"],
    "proprietary": ["All rights reserved", "Copyright 2021. All rights reserved", "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher", "Copyright (c) 2015 the publisher, all rights reserved worldwide", "This document is proprietary and confidential. Unauthorized copying is strictly prohibited", "Confidential and proprietary. Unauthorized copying of this file, via any medium is strictly prohibited", "No part of this book may be reproduced, stored in a retrieval system, or transmitted in any form or by any means without the prior written permission of the publisher"],
}
#: Texts of no family: ordinary ones, some with words that licences use, and terms of other licences.
OTHERS = [
    "You need a valid driver license to rent a car in this city", "The license plate of the car was blue and white", "Apache helicopters flew over the valley in the early morning", "Er kam mit der Bahn und ging mit dem Hund durch den Wald",
    "Die Firma arbeitet mit vielen Partnern in Europa mit", "She studied physics at MIT and later at Stanford", "The restaurant lost its liquor license after the inspection", "We went to the market and bought bread and cheese",
    "Der Hund ist mit dem Kind im Garten und die Katze schläft", "El perro corre por la calle con la gente de la ciudad", "La maison est dans la rue avec les enfants et le chien", "The version of the story told by the author differs in many details",
    "General practice and public health are the two themes of this volume", "The common goods of creative people are shared in the village", "The terms of the agreement were not published by the foundation", "Software engineers use source control and write documentation",
    "The committee granted permission to hold the event in the park", "The right to vote is granted to every person over eighteen", "This work is the best she has written in ten years", "Version 2 of the game was released under a new name in 2004",
    "The public was free to attend the meeting of the general council", "Use of the pool is permitted only with a ticket and a towel", "Distribution of food took place under the bridge at noon", "The library is open to the public from nine to five",
    "The project is funded by the city and by private donors", "The river is four miles long and flows to the north", "Copying machines are found on the second floor of the library", "The king reserved all rooms of the house for his guests",
    "A fishing license is sold at the shop next to the lake", "The identifier of the sample is printed on the label", "The work was attributed to a painter from the south", "Commercial use of the road began in the spring of 1990", "Please share this article with your friends and comment below",
    "He is licensed to practise medicine in three states", "The source of the river lies in the mountains", "They met at the university and have been friends since", "Free of charge for children under six", "No part of the house was left standing after the storm",
    "The eclipse of the sun was seen by the public in two states", "Boost your software sales with version 1.0 of our tool", "The GNU is a large antelope of the African plains", "Mozilla and Apache are names of projects that many people use", "An ISC meeting will be held at noon in hall 2.0",
    "All seats are reserved for members of the club", "Human rights are the rights of all people", "Tables are reserved on all evenings of the week", "The copyright law of 1976 was changed by the court", "A patent gives its owner rights for twenty years",
    "This End User License Agreement is a legal agreement between you and the company for the software product", "You may install and use one copy of the software on a single computer under this agreement", "By clicking accept you agree to the terms of service and the privacy policy", "Our terms of use and our cookie policy apply to all visitors of this site",
    "Licensed under the Open Software License 3.0", "This file is subject to the terms of the Artistic License", "Released under the WTFPL license", "Licensed under the European Union Public Licence", "The warranty covers parts and labor for two years from the date of purchase", "The seller is not liable for damages that arise from improper use of the device",
    "The license fee is paid once a year for each user", "Government license for resale of electricity was granted to the firm", "The software was updated and the files were copied to the new server", "Permission to build the bridge was granted by the council in May",
]


def words_of(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def grams_of(words: list[str]) -> list[str]:
    """Distinct words and pairs of neighbours."""
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]))


@dataclass(frozen=True)
class Model:
    classes: tuple[str, ...]
    vocabulary: tuple[str, ...]
    weights: np.ndarray  # by n-gram and class
    bias: np.ndarray
    temperature: float
    bar: float
    anchors: tuple[str, ...]

    def probabilities(self, words: list[str]) -> np.ndarray:
        index = {g: i for i, g in enumerate(self.vocabulary)}
        hits = [index[g] for g in grams_of(words) if g in index]
        z = (self.bias + self.weights[hits].sum(axis=0)) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


Row = tuple[list[str], str, int]


def samples(seed: int = SEED, variants: int = VARIANTS) -> list[Row]:
    """Training paragraphs (words, class, fold): windows of templates with words left out and other words around;
    others as they are, shuffled, or with words of licences strewn in. What comes of one text is of one fold."""
    rng = np.random.default_rng(seed)
    others = [words_of(x) for x in OTHERS]
    plain = [w for x in others for w in x]
    spoken = [w for ts in TEMPLATES.values() for t in ts for w in words_of(t)]

    def some(of: list[str], n: int) -> list[str]:
        return [of[i] for i in rng.integers(len(of), size=n)]

    out: list[Row] = []
    for family, templates in TEMPLATES.items():
        for fold, words in enumerate(map(words_of, templates)):
            fold %= FOLDS
            out.append((words, family, fold))
            for _ in range(variants):
                part = words
                if len(words) > 8:
                    n = max(8, int(len(words) * rng.uniform(0.5, 1)))
                    at = int(rng.integers(len(words) - n + 1))
                    part = [w for w in words[at : at + n] if rng.random() > 0.05]
                if len(part) < 5 or rng.random() < 0.6:
                    part = some(plain, int(rng.integers(0, 6))) + part + some(plain, int(rng.integers(0, 12)))
                out.append((part, family, fold))
    for fold, words in enumerate(others):
        fold %= FOLDS
        out.append((words, UNKNOWN, fold))
        for k in range(variants):
            made = words + some(plain, int(rng.integers(0, 10)))
            if k % 3 == 0:
                made += some(spoken, int(rng.integers(1, 8)))
            out.append(([made[i] for i in rng.permutation(len(made))] if k % 3 != 1 else made, UNKNOWN, fold))
    return out


def fitted(rows: list[Row], vocabulary: list[str], steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of the regression; classes count alike, and small weights are shrunk to zero."""
    classes = (*TEMPLATES, UNKNOWN)
    x = matrix(rows, vocabulary)
    y = np.eye(len(classes), dtype=np.float32)[[classes.index(c) for _, c, _ in rows]]
    share = (y / y.sum(axis=0)).sum(axis=1, keepdims=True) / len(classes) * (1 + 3 * y[:, -1:])
    w, b = np.zeros((len(vocabulary), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p = (p / p.sum(axis=1, keepdims=True) - y) * share
        vw = 0.9 * vw + x.T @ p
        vb = 0.9 * vb + p.sum(axis=0)
        w -= vw
        b -= vb
        w = np.sign(w) * np.maximum(np.abs(w) - SHRINK, 0)
    return w, b


def matrix(rows: list[Row], vocabulary: list[str]) -> np.ndarray:
    index = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, (words, _, _) in enumerate(rows):
        x[i, [index[g] for g in grams_of(words) if g in index]] = 1
    return x


def vocabulary_of(without: int | None = None) -> list[str]:
    """N-grams of the templates, but of those of one fold."""
    held = {g for ts in TEMPLATES.values() for k, t in enumerate(ts) if k % FOLDS != without for g in grams_of(words_of(t))}
    return sorted(g for g in held if not set(g.split()) <= STOP)


@lru_cache(maxsize=4)
def left_out(seed: int = SEED, variants: int = VARIANTS, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Scores and class of every sample, by the model of its fold, which saw no sample of its template or text."""
    rows, scores, want = samples(seed, variants), [], []
    classes = (*TEMPLATES, UNKNOWN)
    for fold in range(FOLDS):
        vocabulary = vocabulary_of(fold)
        w, b = fitted([r for r in rows if r[2] != fold], vocabulary, steps)
        held = [r for r in rows if r[2] == fold]
        scores.append(matrix(held, vocabulary) @ w + b)
        want += [classes.index(c) for _, c, _ in held]
    return np.concatenate(scores), np.array(want)


def chances(z: np.ndarray, temperature: float) -> np.ndarray:
    e = np.exp((z - z.max(axis=1, keepdims=True)) / temperature)
    return e / e.sum(axis=1, keepdims=True)


@lru_cache(maxsize=4)
def train(seed: int = SEED, variants: int = VARIANTS, steps: int = STEPS) -> Model:
    classes = (*TEMPLATES, UNKNOWN)
    vocabulary = vocabulary_of()
    w, b = fitted(samples(seed, variants), vocabulary, steps)
    used = np.flatnonzero(np.abs(w).sum(axis=1))
    z, want = left_out(seed, variants, steps)
    temperature = min((0.3, 0.4, 0.5, 0.6, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0), key=lambda t: -np.log(chances(z, t)[np.arange(len(want)), want] + 1e-12).mean())
    p = chances(z, temperature)
    false = np.sort(p[want == len(classes) - 1][:, :-1].max(axis=1))
    bar = float(max(0.5, false[int(np.ceil(len(false) * (1 - FALSE_RATE))) - 1] + 1e-6))
    weights, bias = np.round(w[used].astype(np.float64), 6), np.round(b.astype(np.float64), 6)
    names = tuple(vocabulary[i] for i in used)
    return Model(classes, names, weights, bias, temperature, bar, anchors(names, weights, bias, temperature, bar))


def anchors(vocabulary: tuple[str, ...], weights: np.ndarray, bias: np.ndarray, temperature: float, bar: float) -> tuple[str, ...]:
    """Words of which each paragraph that reaches the bar has one.

    A family's probability is at most 1 / (1 + exp(-m)), m its margin over the unknown class. What all n-grams
    without an anchor could add to a margin together must leave it below the bar's.
    """
    need = temperature * np.log(bar / (1 - bar))
    margin = np.maximum(weights[:, :-1] - weights[:, -1:], 0)
    words = sorted({w for g in vocabulary for w in g.split()} - STOP)
    by_word: dict[str, list[int]] = {w: [] for w in words}
    for i, g in enumerate(vocabulary):
        for w in set(g.split()) - STOP:
            by_word[w].append(i)
    rest = np.ones(len(vocabulary), bool)
    chosen: list[str] = []
    while True:
        open_ = (margin * rest[:, None]).sum(axis=0) + bias[:-1] - bias[-1]
        worst = int(open_.argmax())
        if open_[worst] < need or not rest.any():
            return tuple(sorted(chosen))
        gain = {w: margin[[i for i in by_word[w] if rest[i]], worst].sum() for w in words if w not in chosen}
        best = max(sorted(gain), key=gain.get)
        chosen.append(best)
        rest[by_word[best]] = False


def listed(values) -> Column:
    """A constant array of strings."""
    return F.split(F.lit("|".join(values)), "\\|")


def scan(docs: DataFrame, model: Model | None = None, similarity: float = SIMILARITY, prune: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each paragraph that the model gives to a family: id, paragraph (from 0), family, probability,
    similarity to the family's nearest template, confirmed, and the paragraph's text."""
    model = model or train()
    vocabulary, n = listed(model.vocabulary), len(model.classes)

    def once(df: DataFrame, value: Column, name: str) -> DataFrame:
        """Add a column that is computed once a row: filters and later columns aren't merged with a generator."""
        return df.select("*", F.explode(F.array(value)).alias(name))

    least, most = WRAPPED
    wrapped = rf"(?md)^([^\n]{{{least - 1},{most - 1}}}[^\n\r.!?:;])\r?\n(?=\S)"
    lines = docs.select(F.col(id_col), F.posexplode(F.split(F.regexp_replace(text_of(text_col), wrapped, "$1 "), "\n")).alias("paragraph", "text"))
    lines = once(lines, F.split(F.lower("text"), "[^a-z0-9]+"), "words")
    if prune:
        lines = lines.filter(F.arrays_overlap("words", listed(model.anchors)))
    lines = once(lines, F.filter("words", lambda w: w != ""), "own").filter("size(own) > 0")
    pairs = F.zip_with(F.slice("own", 1, F.size("own") - 1), F.slice("own", 2, F.size("own")), lambda a, b: F.concat_ws(" ", a, b))
    lines = once(lines, F.array_distinct(pairs), "pairs")
    # Of the n-grams that the model knows, the weights; a text of any length has no more than the vocabulary.
    table = F.from_json(F.lit(json.dumps([[float(v) for v in r] for r in model.weights])), "array<array<double>>")
    bias = F.from_json(F.lit(json.dumps([float(v) for v in model.bias])), "array<double>")
    hits = F.array_intersect(vocabulary, F.concat("own", "pairs"))
    z = F.aggregate(hits, bias, lambda acc, g: F.zip_with(acc, F.element_at(table, F.array_position(vocabulary, g).cast("int")), lambda a, b: a + b))
    lines = once(lines, z, "z")
    lines = once(lines, F.array_max("z"), "top")
    total = F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp((v - F.col("top")) / model.temperature))
    lines = once(lines, F.struct((1 / total).alias("chance"), F.array_position("z", F.col("top")).cast("int").alias("class")), "p")
    found = lines.filter((F.col("p.class") < n) & (F.col("p.chance") >= model.bar)).withColumn("family", F.element_at(listed(model.classes), F.col("p.class")))
    # Templates: a few for each family, as arrays of their pairs.
    held = F.create_map(*[x for f, ts in TEMPLATES.items() for x in (F.lit(f), F.from_json(F.lit(json.dumps([[g for g in grams_of(words_of(t)) if " " in g] for t in ts])), "array<array<string>>"))])
    agreed = F.transform(F.element_at(held, F.col("family")), lambda t: F.size(F.array_intersect("pairs", t)) / F.greatest(F.lit(1), F.least(F.size(t), F.size("pairs"))))
    found = once(found, F.round(F.array_max(agreed), 6), "similarity")
    return found.select(F.col(id_col), "paragraph", "family", F.round("p.chance", 6).alias("probability"), "similarity", (F.col("similarity") >= similarity).alias("confirmed"), "text")


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "paragraph", "family", "probability", "similarity", "confirmed")
