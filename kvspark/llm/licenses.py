"""Licence scan: a trained paragraph classifier, confirmed by template comparison.

Paragraphs are a text's \\n-split lines. A paragraph's features are its distinct
lower-case words (runs of ASCII letters and digits) and pairs of neighbouring words,
as far as they occur in the templates: notices and paragraphs of whole licences. A
multinomial logistic regression over them (classes: the licence families and
``unknown``) is trained on the templates and variants of these with words left out,
and, as ``unknown``, on the templates' words in random order, on prose that uses them,
and on paragraphs of a bounded sample of the corpus. A temperature calibrates the
probabilities on other rows: other variants, and licences of no family, which none of
the training rows come from.

A paragraph is a licence paragraph if the likeliest class is a family, with
``MIN_PROBABILITY`` at least, and a template of that family confirms it by its word
pairs: either a stretch about as long as the template holds ``MIN_SIMILARITY`` of the
template's pairs, or the paragraph (of ``MIN_PAIRS`` or more, as when a licence is
wrapped into lines) consists of the template's pairs to that part. Pairs keep the
order, and the stretch keeps words that are strewn over a longer paragraph from counting.

The scan uses DataFrame functions only: one pass, no shuffle, no Python. Every paragraph
is judged, whatever words it holds; the classifier is spared those with fewer of the
templates' pairs than any template could be confirmed by.

Defined cases: null and empty texts have no paragraphs; equal rows and equal
paragraphs give a row each; ties between families go to the first by name; an
empty table gives no rows; extra columns are ignored. A paragraph of over
``STRETCH`` characters is judged in stretches of that length and the ``OVERLAP``
characters after each, numbered in ``stretch``; each gives a row of its own.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .work import smallest_hashes

UNKNOWN = "unknown"
MIN_PROBABILITY, MIN_SIMILARITY, MIN_PAIRS = 0.5, 0.8, 8
STRETCH, OVERLAP = 8192, 2048
#: Paragraphs of the corpus that the unknown class is trained on, at most; of each its known features are sent.
SAMPLE_PARAGRAPHS = 400
#: Words of the pieces that long templates are also learnt in.
PIECE = 12
VARIANTS, LEFT_OUT, STEPS, RATE, SPARSITY, SMALLEST = 8, 0.12, 120, 0.5, 1e-3, 0.05

#: Public notices and licence paragraphs, by family.
TEMPLATES = {
    "agpl": [
        "under the GNU Affero General Public License",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache-2.0": [
        "under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "under the BSD License",
        "under the 3-Clause BSD License",
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "BSD 3-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "under CC BY",
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Creative Commons Attribution 4.0 International (CC BY 4.0)",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "under CC BY-NC",
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Creative Commons Attribution-NonCommercial 4.0 International (CC BY-NC 4.0)",
    ],
    "cc-by-nc-nd": [
        "under CC BY-NC-ND",
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International (CC BY-NC-ND 4.0)",
    ],
    "cc-by-nc-sa": [
        "under CC BY-NC-SA",
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International (CC BY-NC-SA 4.0)",
    ],
    "cc-by-nd": [
        "under CC BY-ND",
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Creative Commons Attribution-NoDerivatives 4.0 International (CC BY-ND 4.0)",
    ],
    "cc-by-sa": [
        "under CC BY-SA",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Creative Commons Attribution-ShareAlike 4.0 International (CC BY-SA 4.0)",
    ],
    "cc0": [
        "Released under CC0.",
        "This work has been dedicated to the public domain.",
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
        "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "epl": [
        "under the Eclipse Public License",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Eclipse Public License - v 2.0",
        "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "gpl": [
        "under the GNU General Public License",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "isc": [
        "under the ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "under the GNU Lesser General Public License",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, see <https://www.gnu.org/licenses/>.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute this library under the terms of the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        "under the MIT License",
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "The MIT License (MIT)",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "under the Mozilla Public License",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": ["All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}
#: Paragraphs of licences of no family; they only calibrate.
OTHER_LICENCES = [
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "The Font Software may be modified, altered, or added to, and in particular the designs of glyphs or characters in the Fonts may be modified only if the fonts are renamed.",
    "Licensed under the EUPL, Version 1.2 or later. You may not use this work except in compliance with the Licence.",
    "This package is free software; you can redistribute it under the terms of the Artistic License version 2.0.",
]
#: Ordinary prose that uses the templates' words.
PROSE = [
    "All seats are reserved and all passengers have rights.",
    "We respect all the human rights that were reserved to citizens under the treaty.",
    "The public library is free and open to any person who lives in the city.",
    "He was granted permission to use the file for a particular purpose, but the copy was lost.",
    "Her driving license was released without any restriction after version two of the form was signed.",
    "The work was dedicated to the memory of the public servants of our domain.",
    "The author shall be liable for any damages if the contract says so and the claim is upheld in court.",
    "The general public can obtain a copy of the notice at the office or see the page for more details.",
    "The software industry is subject to conditions that the law does not name in so many words.",
    "A creative life is common to those who work under no one and share alike what they have.",
    "The foundation published a free program of events, either in the source language or in a later version.",
    "You may distribute the leaflets provided that the conditions of the hall are met.",
    "The lawyer said that the warranty of the car was implied and that the profits were lost in the interruption of business.",
    "Attribution of the painting to the master is disputed by an international group of scholars.",
    "The Apache helicopter, version two, was licensed to be built under a contract with the foundation.",
    "He could redistribute the land under the terms of the new law, but he did not.",
    "The names of the contributors are used to promote the products of the company in the documentation.",
    "The license of this work is held by the publisher, and the rights have been sold.",
    "the license", "this work", "under the terms of the", "use of this file", "version 2.0", "the public", "rights", "reserved", "permission", "license",
]
#: Paragraphs of the corpus with one of these might be licences, so they aren't taken as examples of no licence.
HINTS = ["licen", "copyright", "reserved", "warrant", "permi", "redistribut", "liab", "public domain", "creative commons", "sublicens", "cc0", "cc by", "cc-by", "mpl", "derivative works", "proprietary", "free to copy", "damages"]


def words_of(line: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", line.lower())


#: A licence paragraph holds one of these, since it holds pairs of them.
STEMS = sorted({w for ts in TEMPLATES.values() for t in ts for w in words_of(t)})


def pairs_of(line: str) -> list[str]:
    w = words_of(line)
    return [f"{a} {b}" for a, b in zip(w, w[1:])]


def features_of(line: str) -> set[str]:
    return set(words_of(line)) | set(pairs_of(line))


def vocabulary_of(templates: dict[str, list[str]]) -> list[str]:
    return sorted(set().union(*(features_of(t) for ts in templates.values() for t in ts)))


@dataclass(frozen=True)
class LicenceModel:
    families: list[str]  # the last is UNKNOWN
    vocabulary: list[str]
    weights: np.ndarray  # a row a family
    bias: np.ndarray
    temperature: float
    templates: dict[str, list[str]]

    def probabilities(self, line: str) -> np.ndarray:
        """By family, in plain Python; for tests."""
        f = features_of(line)
        z = (self.bias + self.weights[:, [i for i, v in enumerate(self.vocabulary) if v in f]].sum(1)) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def similarity(line: str, template: str) -> float:
    """What confirms a paragraph, in plain Python; for tests."""
    own, have = set(pairs_of(template)), [p in set(pairs_of(template)) for p in pairs_of(line)]
    span = _span(template)
    best = max((sum(have[i : i + span]) for i in range(max(1, len(have) - span + 1))), default=0) / len(own)
    return max(min(1.0, best), sum(have) / len(have) if len(have) >= MIN_PAIRS else 0.0)


def _span(template: str) -> int:
    """Pairs of the stretch that is to hold a template: a fifth more words than it has."""
    n = len(words_of(template))
    return n - 1 + max(1, n // 5)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(unknown: list[list[str]], templates: dict[str, list[str]] = TEMPLATES) -> LicenceModel:
    """A model from the templates and the known features of paragraphs that are no licence."""
    families = [*sorted(templates), UNKNOWN]
    vocabulary = vocabulary_of(templates)
    index = {v: i for i, v in enumerate(vocabulary)}
    rng = np.random.default_rng(0)
    fit: list[tuple[set[str], int]] = []
    check: list[tuple[set[str], int]] = []
    none = len(families) - 1
    for k, name in enumerate(families[:-1]):
        others = {p for f, ts in templates.items() if f != name for t in ts for p in pairs_of(t)}
        for t in templates[name]:
            w = t.split()
            fit.append((features_of(t), k))
            for n in range(VARIANTS):
                (check if n % 4 == 3 else fit).append((features_of(" ".join(x for x in w if rng.random() > LEFT_OUT)), k))
            # a wrapped licence's lines, as far as they aren't as much another family's
            for piece in (" ".join(w[i : i + PIECE]) for i in range(0, len(w) - PIECE, PIECE) if len(w) > 2 * PIECE):
                if sum(p in others for p in pairs_of(piece)) * 2 < PIECE:
                    fit.append((features_of(piece), k))
            for n in range(2):
                (check if n else fit).append((features_of(" ".join(rng.permutation(w))), none))
    fit += [(features_of(x), none) for x in PROSE]
    check += [(features_of(x), none) for x in OTHER_LICENCES]
    for n, u in enumerate(unknown):
        (check if n % 4 == 3 else fit).append((set(u), none))

    def design(rows: list[tuple[set[str], int]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(vocabulary)), np.float32)
        for r, (features, _) in enumerate(rows):
            x[r, [index[f] for f in features if f in index]] = 1
        return x, np.array([k for _, k in rows])

    (x, y), (held_x, held_y) = design(fit), design(check)
    # families weigh alike, and unknown, against which each of them is held, a third of all
    share = 1 / np.bincount(y, minlength=len(families))[y]
    share = (np.where(y == none, share * none / 2, share) / (none * 1.5)).astype(np.float32)
    w, b = np.zeros((len(families), len(vocabulary)), np.float32), np.zeros(len(families), np.float32)
    # accelerated proximal gradient descent: the L1 penalty leaves few weights
    ahead_w, ahead_b = w, b
    for t in range(1, STEPS + 1):
        g = _softmax(x @ ahead_w.T + ahead_b)
        g[np.arange(len(y)), y] -= 1
        g *= share[:, None]
        old_w, old_b = w, b
        w = ahead_w - RATE * (g.T @ x)
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * SPARSITY / none, 0)
        b = ahead_b - RATE * g.sum(0)
        push = (t - 1) / (t + 2)
        ahead_w, ahead_b = w + push * (w - old_w), b + push * (b - old_b)
    w[np.abs(w) < SMALLEST] = 0
    z = held_x @ w.T + b
    grid = np.geomspace(0.1, 4, 60)
    loss = [-np.log(np.maximum(_softmax(z / c)[np.arange(len(held_y)), held_y], 1e-12)).mean() for c in grid]
    return LicenceModel(families, vocabulary, w.astype(float), b.astype(float), float(grid[int(np.argmin(loss))]), templates)


def fit(docs: DataFrame) -> LicenceModel:
    """Train with paragraphs of the corpus as ``unknown``: SAMPLE_PARAGRAPHS at most, chosen by hashes of document and
    place. Paragraphs that might be licences (with one of HINTS, or made of the templates' pairs) aren't among them."""
    some = smallest_hashes(docs.select("doc_id", "text"), docs.count(), SAMPLE_PARAGRAPHS, "doc_id")
    lines = some.select("doc_id", F.posexplode(F.split(F.lower("text"), "\n")).alias("at", "line")).filter((F.trim("line") != "") & ~_hinted(F.col("line")))
    words = lines.select("doc_id", "at", _once(_words(F.substring("line", 1, STRETCH))).alias("words"))
    m = F.size("words") - 1
    prose = words.filter((m < MIN_PAIRS) | (_pairs_held(F.col("words"), TEMPLATES) < MIN_SIMILARITY * m))
    known = prose.select("doc_id", "at", _known(F.col("words"), vocabulary_of(TEMPLATES)).alias("known"))
    few = known.orderBy(F.xxhash64("doc_id", "at"), "doc_id", "known").limit(SAMPLE_PARAGRAPHS)
    # as many features as the templates have, at most, from each
    return train([list(r.known) for r in few.collect()])


def _hinted(line: Column) -> Column:
    found = F.lit(False)
    for hint in HINTS:
        found = found | F.contains(line, F.lit(hint))
    return found


def _words(line: Column) -> Column:
    return F.filter(F.split(line, "[^a-z0-9]+"), lambda w: w != "")


def _pairs(words: Column) -> Column:
    return F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))


def _known(words: Column, vocabulary: list[str]) -> Column:
    return F.array_intersect(F.concat(words, _pairs(words)), _constant(vocabulary, "array<string>"))


def _pairs_held(words: Column, templates: dict[str, list[str]]) -> Column:
    """How many of the pairs are any template's."""
    own = sorted({p for ts in templates.values() for t in ts for p in pairs_of(t)})
    return F.size(F.filter(_pairs(words), lambda p: p.isin(own)))


def least_pairs(templates: dict[str, list[str]], min_similarity: float) -> int:
    """No paragraph with fewer of the templates' pairs is confirmed: by ``similarity``, a stretch needs that
    part of a template's pairs, and a paragraph made of them that part of MIN_PAIRS at least."""
    sizes = {MIN_PAIRS} | {len(set(pairs_of(t))) for ts in templates.values() for t in ts}
    return min(next((k for k in range(n + 1) if k / n >= min_similarity), n) for n in sizes if n)


def _constant(data: list, kind: str) -> Column:
    """A nested constant as one expression, which the optimizer folds to a literal."""
    return F.from_json(F.lit(json.dumps(data)), kind)


def _once(expression: Column) -> Column:
    """``expression`` as a generator of one row, which the optimizer doesn't copy into what uses it."""
    return F.explode(F.array(expression))


def _stretches(line: Column) -> Column:
    """A line, or its stretches with what follows each."""
    cut = F.regexp_extract_all(line, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))
    after = F.concat(F.slice(cut, F.lit(2), F.size(cut)), F.array(F.lit("")))
    return F.when(F.octet_length(line) <= STRETCH, F.array(line)).otherwise(F.zip_with(cut, after, lambda a, b: F.concat(a, F.substring(b, 1, OVERLAP))))


def scan(docs: DataFrame, model: LicenceModel, min_probability: float = MIN_PROBABILITY, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """doc_id, paragraph and stretch of it (from 0), family, probability, similarity: a row for each confirmed licence paragraph."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.lower("text"), "\n")).alias("paragraph", "line"))
    lines = lines.select("doc_id", "paragraph", F.posexplode(_stretches(F.col("line"))).alias("stretch", "line"))
    at = ["doc_id", "paragraph", "stretch"]
    words = lines.select(*at, _once(_words(F.col("line"))).alias("words")).filter("size(words) > 1")
    words = words.filter(_pairs_held(F.col("words"), model.templates) >= least_pairs(model.templates, min_similarity))
    known = words.select(*at, "words", _once(_known(F.col("words"), model.vocabulary)).alias("known"))
    vocabulary = _constant(model.vocabulary, "array<string>")
    placed = known.select(*at, "words", _once(F.transform("known", lambda f: F.array_position(vocabulary, f))).alias("at"))
    rows = [{"bias": float(b), "w": [float(x) for x in row]} for row, b in zip(model.weights, model.bias)]
    table = _constant(rows, "array<struct<bias: double, w: array<double>>>")
    z = F.transform(table, lambda c: F.aggregate("at", c["bias"], lambda s, i: s + F.element_at(c["w"], i.cast("int"))) / F.lit(model.temperature))
    scored = placed.select(*at, "words", _once(z).alias("z")).withColumn("best", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("best")))
    family = F.element_at(_constant(model.families, "array<string>"), F.array_position("z", F.col("best")).cast("int"))
    named = scored.select(*at, "words", family.alias("family"), (1 / total).alias("probability"))
    kept = named.filter((F.col("family") != UNKNOWN) & (F.col("probability") >= min_probability))

    own = [{"f": f, "ps": sorted(set(pairs_of(t))), "span": _span(t)} for f in model.families[:-1] for t in model.templates[f]]
    same = F.filter(_constant(own, "array<struct<f: string, ps: array<string>, span: int>>"), lambda t: t["f"] == F.col("family"))
    paired = kept.select(*at, "family", "probability", _once(_pairs(F.col("words"))).alias("pairs"), _once(same).alias("same"))
    flags = F.transform("same", lambda t: F.struct(F.size(t["ps"]).alias("n"), t["span"].alias("span"), F.transform("pairs", lambda p: F.array_contains(t["ps"], p).cast("int")).alias("have")))
    held = paired.select(*at, "family", "probability", F.size("pairs").alias("m"), _once(flags).alias("flags"))

    def total_of(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def alike(t: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("m") - t["span"] + 1))
        covered = F.array_max(F.transform(starts, lambda i: total_of(F.slice(t["have"], i, t["span"])))) / t["n"]
        return F.greatest(F.least(F.lit(1.0), covered), F.when(F.col("m") >= MIN_PAIRS, total_of(t["have"]) / F.col("m")).otherwise(0.0))

    alikeness = held.select(*at, "family", "probability", F.array_max(F.transform("flags", alike)).alias("similarity"))
    return alikeness.filter(F.col("similarity") >= min_similarity)
