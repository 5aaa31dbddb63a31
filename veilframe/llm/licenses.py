"""Licence scan with DataFrame functions only: a trained paragraph classifier with template confirmation.

A text falls into blocks at lines without a letter or digit; comment leaders are removed, wrapped lines joined, and the
block's sentences are its paragraphs (one over ``LONG`` characters is no notice, its lines are paragraphs instead). A multinomial logistic
regression over sparse word n-grams (one and two words) names the licence family of a paragraph, or ``unknown``. It is
fitted on the driver to the notices below and to grants under the licences' names, and for class unknown to notices of other
licences, of other versions and variants of these, to the frames of notices without their names and to look-alike sentences. A
paragraph that denies a licence ("not licensed under") is unknown. Its temperature is the one with the least log loss over notices that were
left out whole from the fit (``FOLDS`` folds). A family is predicted if its probability is the largest and at least
one half, and confirmed if one of its notices has ``CONFIRM`` of its n-grams in the paragraph, and all (of a long
notice ``CONFIRM``) of those n-grams that tell it from every other family and licence.

The corpus side is one projection: a text without a cue word is left at once; n-grams of the others are looked up in
an array by hash (a few thousand entries, fixed by the notices, a literal of the plan), and weights are summed inside the row. No
shuffle, no join. Weights are whole thousandths, so sums are exact.

Null and empty texts have no paragraph. Each row of the documents gives a row, repeated ids too; no rows give none; other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
import json
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONFIRM = 0.8
SURE = 0.5
LONG = 1000
FOLDS = 3
SLOTS = 4096
SHORT = 24  # n-grams of a notice that must have all that tell it apart
UNKNOWN = "unknown"

# Notices of licence families, one per line
NOTICES = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0.
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
SPDX-License-Identifier: Apache-2.0
Apache License Version 2.0, January 2004""",
    "MIT": """Released under the MIT License.
Licensed under the MIT license.
The MIT License (MIT)
SPDX-License-Identifier: MIT
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "BSD": """Licensed under the BSD 3-Clause License.
Licensed under the BSD 2-Clause License.
Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
SPDX-License-Identifier: BSD-3-Clause
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "GPL-2.0": """This work is licensed under the GNU General Public License, version 2.
Licensed under the GNU General Public License v2.0.
SPDX-License-Identifier: GPL-2.0-only
you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License""",
    "GPL-3.0": """This work is licensed under the GNU General Public License, version 3.
Licensed under the GNU General Public License v3.0.
Licensed under the GPLv3.
SPDX-License-Identifier: GPL-3.0-or-later
you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License""",
    "LGPL": """Licensed under the GNU Lesser General Public License.
This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
SPDX-License-Identifier: LGPL-3.0-or-later
Licensed under the LGPL.""",
    "AGPL-3.0": """Licensed under the GNU Affero General Public License, version 3.
you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation
SPDX-License-Identifier: AGPL-3.0-only""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
Licensed under the Mozilla Public License 2.0.
If a copy of the MPL was not distributed with this file, You can obtain one at
SPDX-License-Identifier: MPL-2.0""",
    "ISC": """Licensed under the ISC License.
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
SPDX-License-Identifier: ISC""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose
SPDX-License-Identifier: Unlicense""",
    "CC0-1.0": """Licensed under CC0 1.0 Universal.
To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.
Dedicated to the public domain under CC0.""",
    "CC-BY": """Licensed under CC BY 4.0.
This work is licensed under a Creative Commons Attribution 4.0 International License.
Available under the Creative Commons Attribution License.""",
    "CC-BY-SA": """Licensed under CC BY-SA 4.0.
This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.
Text is available under the Creative Commons Attribution-ShareAlike License""",
    "CC-BY-NC": """Licensed under CC BY-NC 4.0.
This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.
Available under the Creative Commons Attribution-NonCommercial License.""",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
Licensed under the Eclipse Public License.""",
    "BSL-1.0": """Distributed under the Boost Software License, Version 1.0.""",
    "Zlib": """Licensed under the zlib License.
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.""",
}
# Sentences that share words with notices but grant nothing
OTHERS = """The driver was asked for his license and registration.
The software was released in the spring and sold many copies.
She studied at MIT before she joined the public library.
Apache helicopters were seen over the general area.
Permission to enter the building is granted at the front desk.
The warranty of the machine is void without the original notice.
Copyright law differs between countries and works.
The commons were open to the public for free use.
A new version of the file was distributed to all contributors.
The terms of the contract were modified under the agreement.
The source of the code was found in the foundation of the house.
He published a copy of his international work.
Any person without a fishing license will be held liable for damages.
The author has sold the rights to a creative studio.
The zlib library was updated to version 3.
The license plate was made of metal; version 2 is lighter.
Clause 3 of the agreement lists the following conditions.
General conditions apply to every public event.
The Mozilla and Eclipse conferences are free of charge.
All rights reserved.
The boost in sales was provided by the holder of the property.
You may obtain a permit in writing from the office.
The notice was included in the documentation of the project.
Please contact the company for attribution and commercial use.
The domain name is registered in the form of a binary record."""
# Notices of licences that are no family here
OTHER_LICENCES = """Licensed under CC BY-ND 4.0.
Licensed under CC BY-NC-ND 4.0.
Licensed under CC BY-NC-SA 4.0.
This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.
This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.
This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.
Licensed under the Artistic License 2.0.
Licensed under the European Union Public Licence, version 1.2.
Licensed under the Microsoft Public License.
Licensed under the Common Development and Distribution License 1.0.
Licensed under the Academic Free License version 3.0.
Licensed under the Open Software License version 3.0.
Licensed under the Python Software Foundation License version 2.
Licensed under the SIL Open Font License, Version 1.1.
Licensed under the Business Source License 1.1.
Licensed under the Server Side Public License, version 1.
Licensed under the Elastic License 2.0.
Licensed under the PostgreSQL License.
Licensed under the Open Database License v1.0.
Licensed under the GNU Free Documentation License, version 1.3.
Licensed under the Beerware License.
Everyone is permitted to copy and distribute verbatim or modified copies of this license document.
This software is proprietary and confidential and may not be copied without permission.
Use of this software is governed by the terms of the commercial license agreement.
You may not copy, modify or distribute this software without prior written permission.
You may obtain a license for commercial use at the address below.
SPDX-License-Identifier: EUPL-1.2
SPDX-License-Identifier: CDDL-1.0
SPDX-License-Identifier: LicenseRef-Proprietary"""
# Versions and variants of the families that are no family here
OTHER_VERSIONS = """Licensed under the MIT No Attribution License.
MIT No Attribution
Licensed under the BSD 4-Clause License.
Licensed under the original BSD License with the advertising clause.
Licensed under the Mozilla Public License 1.1.
This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.
Licensed under the GNU General Public License, version 1.
Licensed under the GNU General Public License v1.0.
Licensed under the GNU Affero General Public License, version 1.
Licensed under the Apache License, Version 1.1.
Licensed under the Apache License, Version 1.0.
Licensed under the Eclipse Public License 1.0.
SPDX-License-Identifier: MIT-0
SPDX-License-Identifier: BSD-4-Clause
SPDX-License-Identifier: MPL-1.1
SPDX-License-Identifier: GPL-1.0-only
SPDX-License-Identifier: Apache-1.1
SPDX-License-Identifier: EPL-1.0"""
# Names of the families' licences; the classifier also learns from sentences that grant under them
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0", "ASL 2.0", "Apache Software License, Version 2.0"),
    "MIT": ("MIT License", "MIT", "Expat license", "MIT-style license", "X11/MIT license"),
    "BSD": ("BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "New BSD License", "Simplified BSD License", "modified BSD license", "BSD-style license"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2", "GNU GPL version 2", "GPLv2", "GPL-2.0", "GPL version 2 or later", "GPL-2.0-or-later"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPLv3", "GPL-3.0", "GPL version 3 or later", "GPL-3.0-only"),
    "LGPL": ("GNU Lesser General Public License", "GNU LGPL", "LGPLv3", "LGPL-2.1", "LGPL version 2.1", "GNU Lesser General Public License v3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPLv3", "AGPL-3.0", "Affero GPL version 3"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL 2.0", "MPL-2.0", "Mozilla Public License, v. 2.0"),
    "ISC": ("ISC License", "ISC", "ISC-style license"),
    "Unlicense": ("Unlicense", "The Unlicense"),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0", "Creative Commons Zero", "CC0 1.0 public domain dedication", "CC0-1.0"),
    "CC-BY": ("CC BY 4.0", "Creative Commons Attribution 4.0", "Creative Commons Attribution License", "CC-BY-4.0", "CC BY 3.0"),
    "CC-BY-SA": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0", "Creative Commons Attribution-ShareAlike License", "CC-BY-SA-4.0", "CC BY-SA 3.0"),
    "CC-BY-NC": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0", "Creative Commons Attribution-NonCommercial License", "CC-BY-NC-4.0", "CC BY-NC 3.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, version 2.0", "EPL 2.0", "EPL-2.0"),
    "BSL-1.0": ("Boost Software License 1.0", "Boost Software License, Version 1.0", "BSL-1.0", "Boost License"),
    "Zlib": ("zlib License", "zlib/libpng license", "Zlib"),
}
GRANTS = ("Licensed under the {}.", "This project is released under the terms of the {}.", "Distributed under {}, see LICENSE.", "The code is available under the {} license.")
# What says that a licence does not hold
DENIAL = r"(?i)(?:\b(?:not|never|longer|neither)|n't)\s+(?:[a-z]+\s+){0,2}(?:licen[cs]ed|released|published|available|dedicated|governed|covered|subject)\b"
# Words that make no feature alone or with each other
STOPWORDS = frozenset("a all an and any are as at be by can for from has in is it its may no not of on one or other shall such that the this to was which will with you your either if".split())
# Every notice has one of these words, or several
CUES = "licen[cs](?:e|es|ed|ing)|copyright|permission|permitted|redistribut(?:e|ion|ions|ed)|spdx|warranty|warranties|unencumbered|endorse|mpl|gpl(?:v[0-9])?|lgpl|cc0|cc|public domain|anyone is free|united states|damages"
_CUE = rf"(?i)\b(?:{CUES})\b"
_DENIAL_SQL = DENIAL.replace("'", "''")
_BEFORE = ("", "this project is", "note that the code here is", "see the readme for more and")
_AFTER = ("", "for details see the file", "in this repository")
_LEADER = r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|;+|--+|%+|<!--|rem|dnl|REM)(?:[ \t]+|$)"
_BLANK = r"\n[^\p{L}\p{N}]*\n"
_SENTENCE = r"([.!?])[ \t\r\n]+([A-Z\"(])"


def words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def ngrams(text: str) -> set[str]:
    w = words(text)
    grams = [(x,) for x in w] + list(zip(w, w[1:], strict=False))
    return {" ".join(g) for g in grams if not all(x in STOPWORDS for x in g)}


class Model:
    """classes (unknown last), weights[ngram] in thousandths, bias, temperature, and the notices' n-grams with those that tell them apart."""

    def __init__(self):
        self.classes = [*sorted(NOTICES), UNKNOWN]
        lines = [(c, line) for c in sorted(NOTICES) for line in NOTICES[c].split("\n")]
        rest = [(UNKNOWN, line) for line in (*OTHERS.split("\n"), *OTHER_LICENCES.split("\n"), *OTHER_VERSIONS.split("\n"))]
        shared = lambda c: {g for d, line in (*lines, *rest) if d != c for g in ngrams(line)}
        elsewhere = {c: shared(c) for c in self.classes}
        self.notices = [(self.classes.index(c), grams, grams - elsewhere[c]) for c, line in lines for grams in [ngrams(line)]]
        frames = {" ".join(w for w in words(line) if w in elsewhere[c]) for c, line in lines if len(words(line)) < SHORT}
        rest += [(UNKNOWN, f) for f in sorted(frames)]
        alone = [(UNKNOWN, w) for w in sorted({w for _, line in (*lines, *rest) for w in words(line)})]  # a word alone proves nothing
        texts = [(c, f"{b} {line} {a}", k % FOLDS) for source in (lines, rest) for k, (c, line) in enumerate(source) for b in _BEFORE for a in _AFTER]
        texts += [(c, w, -1) for c, w in alone]
        named = [(c, grant.format(name)) for c in sorted(NAMES) for name in NAMES[c] for grant in GRANTS]
        texts += [(c, line, k % FOLDS) for k, (c, line) in enumerate(sorted(named, key=lambda x: hashlib.sha256(x[1].encode()).digest()))]
        self.vocabulary = sorted({g for _, text, _ in texts for g in ngrams(text)})
        place = {g: i for i, g in enumerate(self.vocabulary)}
        x = np.zeros((len(texts), len(place)), np.float32)
        for i, (_, text, _) in enumerate(texts):
            x[i, [place[g] for g in ngrams(text)]] = 1
        y, fold = np.array([self.classes.index(c) for c, _, _ in texts]), np.array([k for _, _, k in texts])
        scores = np.zeros((len(texts), len(self.classes)))
        for k in range(FOLDS):
            w, b = self._fit(x[fold != k], y[fold != k], len(self.classes))
            scores[fold == k] = x[fold == k] @ w + b
        out = fold >= 0
        self.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0, 5.6), key=lambda t: self._loss(scores[out] / t, y[out]))
        self.held_out_accuracy = float((scores[out].argmax(axis=1) == y[out]).mean())
        w, b = self._fit(x, y, len(self.classes))
        self.weights, self.bias = np.rint(w * 1000).astype(int), np.rint(b * 1000).astype(int)

    @staticmethod
    def _loss(scores: np.ndarray, y: np.ndarray) -> float:
        scores = scores - scores.max(axis=1, keepdims=True)
        return float((np.log(np.exp(scores).sum(axis=1)) - scores[np.arange(len(y)), y]).mean())

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray, k: int, steps: int = 200, rate: float = 2.0, ridge: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
        """Full-batch gradient descent with momentum from zero; classes weigh the same."""
        weight = (1 / np.bincount(y, minlength=k).clip(1))[y]
        weight = (weight / weight.sum()).astype(np.float32)
        w, b = np.zeros((x.shape[1], k), np.float32), np.zeros(k, np.float32)
        vw, vb = np.zeros_like(w), np.zeros_like(b)
        for _ in range(steps):
            s = x @ w + b
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= weight[:, None]
            vw, vb = 0.9 * vw - rate * (x.T @ p + ridge * w), 0.9 * vb - rate * p.sum(axis=0)
            w, b = w + vw, b + vb
        return w, b

    def needed(self, t: int) -> tuple[int, int]:
        """How many n-grams of notice t, and how many that tell it apart, confirm it."""
        _, grams, own = self.notices[t]
        part = lambda n: -int(-CONFIRM * n // 1)
        return part(len(grams)), len(own) if len(grams) < SHORT else part(len(own))

    def slots(self) -> list[list[dict]]:
        """By hash, the n-grams with a weight for each class, the notices that hold them and those that they tell apart."""
        from xxhash import xxh64_intdigest

        out: list[list[dict]] = [[] for _ in range(SLOTS)]
        for g, row in zip(self.vocabulary, self.weights.tolist(), strict=True):
            entry = {"g": g, "w": row, "t": [t for t, n in enumerate(self.notices) if g in n[1]], "o": [t for t, n in enumerate(self.notices) if g in n[2]]}
            out[xxh64_intdigest(g, 42) % SLOTS].append(entry)
        return out


@cache
def model() -> Model:
    return Model()


def _once(value: str, name: str, body: str) -> str:
    """An expression over ``name``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def licence_paragraphs(text: str) -> str:
    """SQL of a text's paragraphs with a cue: array of (best class, probability, confirmed, words)."""
    m = model()
    quoted = lambda r: ('r"' + r + '"') if "'" in r else ("r'" + r + "'")
    pieces = f"split(regexp_replace(regexp_replace(regexp_replace({text}, {quoted(_LEADER)}, ''), {quoted(_BLANK)}, char(1)), {quoted(_SENTENCE)}, concat('$1', char(1), '$2')), char(1))"
    units = f"filter(flatten(transform(filter({pieces}, p -> p rlike {quoted(_CUE)}), p -> if(length(p) > {LONG}, split(p, '\n'), array(p)))), p -> p rlike {quoted(_CUE)})"
    stop = "array(" + ", ".join(f"'{x}'" for x in sorted(STOPWORDS)) + ")"
    tokens = "filter(split(translate(p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), x -> x <> '')"
    pairs = f"zip_with(w, slice(w, 2, greatest(size(w) - 1, 0)), (a, b) -> if(b is null or (array_contains({stop}, a) and array_contains({stop}, b)), null, concat(a, ' ', b)))"
    grams = _once(tokens, "w", f"array_distinct(concat(filter(w, x -> not array_contains({stop}, x)), filter({pairs}, x -> x is not null)))")
    table = json.dumps(m.slots()).replace("'", "\\'")
    slots = f"from_json('{table}', 'array<array<struct<g:string,w:array<int>,t:array<int>,o:array<int>>>>')"
    hits = f"flatten(transform({grams}, g -> filter({slots}[int(pmod(xxhash64(g), {SLOTS}))], e -> e.g = g)))"
    k = len(m.classes)
    bias = "array(" + ", ".join(map(str, m.bias.tolist())) + ")"
    notices = "array(" + ", ".join(f"named_struct('t', {t}, 'c', {c}, 'all', {m.needed(t)[0]}, 'own', {m.needed(t)[1]})" for t, (c, _, _) in enumerate(m.notices)) + ")"
    score = f"aggregate(hits, {bias}, (sum, e) -> zip_with(sum, e.w, (a, b) -> a + b))"
    many = lambda field, need: f"aggregate(hits, 0, (k, e) -> k + int(array_contains(e.{field}, n.t))) >= n.{need}"
    best = f"if(p rlike {quoted(DENIAL)}, {k - 1}, int(array_position(score, array_max(score)) - 1))"
    chance = f"1 / aggregate(score, 0D, (total, s) -> total + exp((s - array_max(score)) / {1000 * m.temperature}D))"
    confirmed = f"best < {k - 1} and probability >= {SURE} and exists({notices}, n -> n.c = best and {many('t', 'all')} and {many('o', 'own')})"
    row = _once(score, "score", _once(best, "best", _once(chance, "probability", f"named_struct('best', best, 'probability', probability, 'confirmed', {confirmed}, 'paragraph', p)")))
    return f"if({text} rlike {quoted(_CUE)}, transform({units}, p -> {_once(hits, 'hits', row)}), array())"


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_scored (paragraphs with a cue), n_confirmed, families (sorted, comma-joined), unconfirmed (families only predicted), paragraphs."""
    m = model()
    names = "array(" + ", ".join(f"'{c}'" for c in m.classes) + ")"
    family = lambda which: F.expr(f"array_join(array_sort(array_distinct(transform(filter(paragraphs, p -> {which}), p -> {names}[p.best]))), ',')")
    found = docs.select(F.col(id_col), F.expr(f"coalesce({licence_paragraphs('`' + text_col + '`')}, array())").alias("paragraphs"))
    sure = f"p.best < {len(m.classes) - 1} and p.probability >= {SURE} and not p.confirmed"
    counts = [F.size("paragraphs").cast("long").alias("n_scored"), F.expr("cast(size(filter(paragraphs, p -> p.confirmed)) as bigint)").alias("n_confirmed")]
    return found.select(id_col, *counts, family("p.confirmed").alias("families"), family(sure).alias("unconfirmed"), "paragraphs")


def duckdb_sql() -> str:
    """The same scan for DuckDB, over the same model: paragraphs, n-grams and weights as tables that are joined and summed."""
    m = model()
    k = len(m.classes)
    rows = [(g, c, int(v)) for g, row in zip(m.vocabulary, m.weights, strict=True) for c, v in enumerate(row) if v]
    values = ",".join(f"('{g}',{c},{v})" for g, c, v in rows)
    held = ",".join(f"('{g}',{t},{int(g in own)})" for t, (_, grams, own) in enumerate(m.notices) for g in sorted(grams))
    stop = ",".join(f"'{x}'" for x in sorted(STOPWORDS))
    bias = ",".join(f"({i},'{c}',{b})" for i, (c, b) in enumerate(zip(m.classes, m.bias.tolist(), strict=True)))
    notices = ",".join(f"({t},{c},{m.needed(t)[0]},{m.needed(t)[1]})" for t, (c, _, _) in enumerate(m.notices))
    return f"""
WITH model(gram, c, amount) AS (VALUES {values}),
held(gram, t, own) AS (VALUES {held}),
bias(c, family, b) AS (VALUES {bias}),
notice(t, c, need, need_own) AS (VALUES {notices}),
cut AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(text, '{_LEADER}', '', 'g'), '{_BLANK}', chr(1), 'g'), '{_SENTENCE}', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS ps FROM documents),
pieces AS (SELECT doc_id, unnest(range(len(ps))) AS a, unnest(ps) AS p FROM cut),
units AS (SELECT doc_id, a, unnest(range(len(l))) AS b, unnest(l) AS p
          FROM (SELECT doc_id, a, CASE WHEN length(p) > {LONG} THEN string_split(p, chr(10)) ELSE [p] END AS l FROM pieces WHERE regexp_matches(p, '{_CUE}'))),
cand AS (SELECT doc_id, a, b, regexp_matches(p, '{_DENIAL_SQL}') AS denied, list_filter(regexp_split_to_array(translate(p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM units WHERE regexp_matches(p, '{_CUE}')),
grams AS (SELECT DISTINCT doc_id, a, b, gram FROM (
    SELECT doc_id, a, b, unnest(w) AS gram FROM cand
    UNION ALL SELECT doc_id, a, b, unnest(list_transform(range(1, len(w)), lambda i: CASE WHEN w[i] IN ({stop}) AND w[i + 1] IN ({stop}) THEN '' ELSE w[i] || ' ' || w[i + 1] END)) FROM cand)
    WHERE gram NOT IN ('', {stop})),
sums AS (SELECT doc_id, a, b, c, sum(amount) AS amount FROM grams JOIN model USING (gram) GROUP BY ALL),
scores AS (SELECT u.doc_id, u.a, u.b, bias.c, family, bias.b + coalesce(amount, 0) AS s FROM cand u CROSS JOIN bias LEFT JOIN sums x ON x.doc_id = u.doc_id AND x.a = u.a AND x.b = u.b AND x.c = bias.c),
tops AS (SELECT doc_id, a, b, max(s) AS top, min_by(c, {{'s': -s, 'c': c}}) AS best, min_by(family, {{'s': -s, 'c': c}}) AS family FROM scores GROUP BY ALL),
parts AS (SELECT t.doc_id, t.a, t.b, best, t.family, sum(exp((s - top) / {1000 * m.temperature})) AS total FROM tops t JOIN scores x ON x.doc_id = t.doc_id AND x.a = t.a AND x.b = t.b GROUP BY ALL),
probs AS (SELECT parts.*, NOT denied AND best < {k - 1} AND 1 / total >= {SURE} AS sure FROM parts JOIN cand USING (doc_id, a, b)),
met AS (SELECT DISTINCT doc_id, a, b, c FROM (SELECT doc_id, a, b, t, count(*) AS n, sum(own) AS n_own FROM grams JOIN held USING (gram) GROUP BY ALL) JOIN notice USING (t) WHERE n >= need AND n_own >= need_own),
found AS (SELECT p.doc_id, p.family, sure, sure AND c IS NOT NULL AS confirmed FROM probs p LEFT JOIN met ON met.doc_id = p.doc_id AND met.a = p.a AND met.b = p.b AND met.c = p.best),
per AS (SELECT doc_id, count(*) AS n_scored, count_if(confirmed) AS n_confirmed,
        coalesce(string_agg(DISTINCT CASE WHEN confirmed THEN family END, ',' ORDER BY CASE WHEN confirmed THEN family END), '') AS families,
        coalesce(string_agg(DISTINCT CASE WHEN sure AND NOT confirmed THEN family END, ',' ORDER BY CASE WHEN sure AND NOT confirmed THEN family END), '') AS unconfirmed
        FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_scored, 0) AS BIGINT) AS n_scored, CAST(coalesce(n_confirmed, 0) AS BIGINT) AS n_confirmed, coalesce(families, '') AS families, coalesce(unconfirmed, '') AS unconfirmed
FROM documents d LEFT JOIN per USING (doc_id)
"""
