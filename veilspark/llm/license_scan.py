"""Licence scan, DataFrame functions only.

A passage is a line of a text, or a run of lines without a blank one between
them (a wrapped notice) whose inner lines have at most ``MOST`` words.  Its
features are the distinct words and word pairs of it that the trained
vocabulary knows; a logistic regression over them (fitted in numpy on the
labelled table: every name of ``NAMES`` in every one of ``WORDINGS``, and the
passages ``EXAMPLES``; one intercept and weight vector per family, families
against ``none``) gives each family's probability.  Licences beyond the
families are examples of ``none``.  The unknown class is calibrated: a
prediction must have the least probability down to which predictions on
wordings that the model hasn't seen are right in a share of ``PRECISION``;
where no probability reaches that, nothing is confirmed.  A prediction is then
confirmed by comparison with the family's templates (its names and its long
clauses, not the wordings): enough of the words of one must occur in the
passage.

Before anything is split, texts are passed over that have neither one of the
``CUES`` nor one of the ``guards``: words of which every passage that covers a
template well enough has at least one.  So no confirmed passage is lost.

Defined results: of the confirmed passages those of fewest lines count, then
those of the largest cover and probability, and those that overlap them do not.
One row per passage that counts, and an unknown one per line that has a cue and
lies in none of them; a row has the number of its first line, from 0 over all
lines of its text; null and empty texts have none; repeated rows give
their rows each; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUES = ("licen", "copyright", "public domain", "creative commons", "cc by", "cc0", "permission is hereby", "redistribution", "warrant")
PRECISION = 0.97
#: Share of a template's words that a confirmed paragraph has.
COVER = 0.75
EXAMPLES = (
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mit", "The MIT License (MIT)"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "Distributed under the MIT licence, see the file LICENSE."),
    ("mit", "Licensed under the MIT license."),
    ("mit", "This software is available under the MIT License."),
    ("mit", "License: MIT"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the Apache License"),
    ("apache-2.0", "This software is distributed under the Apache License 2.0."),
    ("apache-2.0", "Available under the terms of the Apache licence, version 2.0"),
    ("apache-2.0", "Released under the Apache License, Version 2.0."),
    ("apache-2.0", "This project is licensed under the terms of the Apache License 2.0."),
    ("apache-2.0", "License: Apache-2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("gpl-3.0", "Released under the GNU GPL license, version 3 or later."),
    ("gpl-3.0", "Licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "Distributed under the terms of the GNU General Public License, version 3."),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("gpl-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("gpl-3.0", "This program is released under the GNU GPL, version 3."),
    ("lgpl-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl-2.1", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("lgpl-2.1", "Released under the GNU Lesser General Public License, version 2.1."),
    ("lgpl-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("lgpl-2.1", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or any later version"),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", "Distributed under the simplified BSD license."),
    ("bsd", "Licensed under the BSD 2-Clause License."),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("bsd", "SPDX-License-Identifier: BSD-2-Clause"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("mpl-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("mpl-2.0", "Released under the Mozilla Public License, version 2.0."),
    ("mpl-2.0", "Available under the terms of the Mozilla Public License 2.0"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Text is available under the Creative Commons Attribution License."),
    ("cc-by", "Released under CC BY 4.0."),
    ("cc-by", "Content under CC BY 4.0 license"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Released under CC BY-SA 4.0."),
    ("cc-by-sa", "Content under CC BY-SA 4.0 license"),
    ("cc-by-sa", "Text is available under the Creative Commons Attribution-ShareAlike License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Content under CC BY-NC 4.0 license"),
    ("cc-by-nc", "Released under CC BY-NC 4.0."),
    ("cc-by-nc", "Text is available under the Creative Commons Attribution-NonCommercial License."),
    ("public-domain", "This work has been dedicated to the public domain under CC0 1.0 Universal."),
    ("public-domain", "SPDX-License-Identifier: CC0-1.0"),
    ("public-domain", "This is free and unencumbered software released into the public domain (The Unlicense)."),
    ("public-domain", "Dedicated to the public domain under CC0 1.0."),
    ("public-domain", "Released into the public domain under CC0 1.0 Universal."),
    ("public-domain", "This is free software released into the public domain."),
    ("public-domain", "This work is in the public domain."),
    ("public-domain", "The text is in the public domain."),
    ("public-domain", "These files belong to the public domain."),
    ("public-domain", "The author has placed this work in the public domain."),
    ("none", "She passed her driving licence test last week."),
    ("none", "The licence fee was raised by the government in spring."),
    ("none", "All rights reserved. Copyright 2020 by the publisher."),
    ("none", "The copyright holder sued the company for damages."),
    ("none", "The warranty covers parts and labour for two years."),
    ("none", "Police issued a warrant for the arrest."),
    ("none", "The restaurant lost its liquor license in May."),
    ("none", "A software license costs forty euros per seat and month."),
    ("none", "redistribution of wealth was the topic of the debate"),
    ("none", "Please read our license agreement and terms of use before you continue."),
    ("none", "Proprietary and confidential. No license is granted."),
    ("none", "A general public meeting about version 3 of the plan"),
    # licences beyond the families, and lines that leave the version open
    ("none", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("none", "Licensed under the GNU Affero General Public License, version 3."),
    ("none", "Released under the GNU Affero General Public License."),
    ("none", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("none", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("none", "Released under the GNU AGPL license, version 3 or later."),
    ("none", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("none", "This work is licensed under the GNU General Public License, version 2."),
    ("none", "Licensed under the GNU General Public License, version 2."),
    ("none", "Released under the GNU GPL license, version 2 or later."),
    ("none", "SPDX-License-Identifier: GPL-2.0-only"),
    ("none", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("none", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or any later version"),
    ("none", "it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("none", "You should have received a copy of the GNU General Public License along with this program."),
    ("none", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("none", "Licensed under the GNU Lesser General Public License, version 3."),
    ("none", "Released under the GNU Lesser General Public License, version 3."),
    ("none", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("none", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("none", "Licensed under the Eclipse Public License, version 2.0."),
    ("none", "Released under the Eclipse Public License 2.0."),
    ("none", "SPDX-License-Identifier: EPL-2.0"),
    ("none", "Available under the terms of the Eclipse Public License v. 2.0"),
    ("none", "Licensed under the Common Public License, version 1.0."),
    ("none", "Released under the ISC License."),
    ("none", "SPDX-License-Identifier: ISC"),
    ("none", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("none", "Licensed under the European Union Public Licence, version 1.2."),
    ("none", "Licensed under the Mozilla Public License, version 1.1."),
    ("none", "Released under the Mozilla Public License, version 1.1."),
    ("none", "SPDX-License-Identifier: MPL-1.1"),
    ("none", "Licensed under the Apache License, Version 1.1."),
    ("none", "Released under the Apache Software License, version 1.1."),
    ("none", "SPDX-License-Identifier: Apache-1.1"),
    ("none", "Released under the zlib License."),
    ("none", "SPDX-License-Identifier: Zlib"),
    ("none", "Distributed under the Boost Software License, Version 1.0."),
    ("none", "SPDX-License-Identifier: BSL-1.0"),
    ("none", "Released under the Artistic License 2.0."),
    ("none", "SPDX-License-Identifier: Artistic-2.0"),
    ("none", "Released under the PostgreSQL License."),
    ("none", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("none", "Licensed under the Business Source License 1.1."),
    ("none", "Licensed under the Server Side Public License, version 1."),
    ("none", "Licensed under the Elastic License 2.0."),
    ("none", "This project is licensed under the terms of the Python Software Foundation license."),
    ("none", "Licensed under CC BY-ND 4.0."),
    ("none", "Released under CC BY-ND 4.0."),
    ("none", "Content under CC BY-ND 4.0 license"),
    ("none", "Licensed under CC BY-NC-SA 4.0."),
    ("none", "Released under CC BY-NC-SA 4.0."),
    ("none", "Licensed under CC BY-NC-ND 4.0."),
    ("none", "Content under CC BY-NC-ND 4.0 license"),
    ("none", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("none", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("none", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("none", "This software is distributed under a commercial license."),
    ("none", "This project is licensed under a proprietary license."),
    ("none", "Released under a licence of our own."),
    ("none", "The work is not in the public domain."),
    ("none", "He studied at MIT and wrote about the Apache helicopter."),
    ("none", "Kommen Sie mit dem Auto, mit Ihrer licence und mit den Papieren."),
    ("none", "mit der licence und mit dem Vertrag"),
    ("none", "mit einer license für das Programm, mit Support"),
)
# How licences are called, families first and then licences beyond them.
NAMES = {
    "mit": ("MIT License", "MIT license (MIT)", "MIT", "Expat (MIT) license"),
    "apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache-2.0", "Apache licence v2"),
    "gpl-3.0": ("GNU General Public License, version 3", "GNU GPL version 3 or later", "GPL-3.0-only", "GPL-3.0-or-later", "GPLv3", "GNU GPL v3", "GPL 3.0"),
    "lgpl-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPLv2.1", "GNU LGPL version 2.1"),
    "bsd": ("BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "simplified BSD license", "new BSD license", "BSD license"),
    "mpl-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "MPL-2.0", "MPL 2.0", "Mozilla Public License 2.0"),
    "cc-by": ("CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"),
    "cc-by-sa": ("CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License"),
    "cc-by-nc": ("CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License"),
    "public-domain": ("CC0 1.0 Universal", "CC0-1.0", "CC0", "public domain under CC0", "Unlicense"),
    "none": (
        "GNU Affero General Public License, version 3", "AGPL-3.0-only", "AGPLv3", "GNU AGPL version 3", "GNU General Public License, version 2", "GPL-2.0-only", "GPL-2.0-or-later", "GPLv2", "GNU GPL version 2",
        "GNU Lesser General Public License, version 3", "LGPL-3.0-only", "LGPLv3", "Eclipse Public License, version 2.0", "EPL-2.0", "Common Public License, version 1.0", "ISC License", "ISC", "European Union Public Licence, version 1.2",
        "EUPL-1.2", "Mozilla Public License, version 1.1", "MPL-1.1", "MPL 1.1", "Apache License, Version 1.1", "Apache-1.1", "Apache 1.1", "zlib License", "Zlib", "Boost Software License, Version 1.0", "BSL-1.0", "Artistic License 2.0",
        "Artistic-2.0", "PostgreSQL License", "SIL Open Font License, Version 1.1", "OFL-1.1", "Business Source License 1.1", "Server Side Public License, version 1", "SSPL-1.0", "Elastic License 2.0", "Microsoft Public License", "Python Software Foundation License",
        "CC BY-ND 4.0", "CC-BY-ND-4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
        "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "commercial license", "proprietary license", "licence of our own", "license agreement",
    ),
}
#: Ways to say that a licence applies; every name is put into every one of them.
WORDINGS = (
    "Licensed under the {}.", "Released under the {}.", "This work is licensed under a {}.", "This project is licensed under the terms of the {}.", "SPDX-License-Identifier: {}", "License: {}", "Distributed under the {}, see the file LICENSE.",
    "This software is available under the {}.", "Available under the terms of the {}", "Content under {} license", "This program is free software licensed under {}.", "The code is {} licensed.", "Source code: {}", "Permission is given under the {}", "Copyright 2020 the authors, {}", "{}",
)
#: How much an example counts for, beside a name in a wording.
WEIGHT = 8.0
#: Groups of wordings of which each is kept out once.
FOLDS = 8
_SPLIT = r"[^a-z0-9.+-]+"
#: Spellings that are one word.
_SPELT = r"licen[cs](?:ed|es|e)\b"
#: Words of an example from which on it is a clause, and so a template.
CLAUSE = 12
#: Words that the inner lines of a run may have: twice the longest template's.
MOST = 2 * max(len(re.split(_SPLIT, t.lower())) for f, t in EXAMPLES if f != "none")


def tokens(text: str) -> list[str]:
    return [w.strip(".") for w in re.split(_SPLIT, re.sub(_SPELT, "license", text.lower())) if w.strip(".")]


def grams(words: list[str]) -> set[str]:
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}


def labelled() -> list[tuple[str, set[str], int, float]]:
    """(family, features, fold, weight) of the labelled table: every name in every wording, a wording in one fold, and the examples."""
    made = [(f, grams(tokens(w.format(n))), k % FOLDS, 1.0) for f, names in NAMES.items() for n in names for k, w in enumerate(WORDINGS)]
    return made + [(f, grams(tokens(t)), k % FOLDS, WEIGHT) for k, (f, t) in enumerate(EXAMPLES)]


@cache
def templates() -> dict[str, tuple[tuple[str, ...], ...]]:
    """Of each family the words that confirm it: its names (a plain word only together with the word license) and the long clauses of its licences."""
    out = {}
    for f in sorted(set(NAMES) - {"none"}):
        own = [tokens(n) for n in NAMES[f]]
        own = [w + ["license"] if len(w) == 1 and w[0].isalpha() and "licen" not in w[0] else w for w in own]
        own += [["public", "domain"]] if f == "public-domain" else []
        own += [w for w in (tokens(t) for g, t in EXAMPLES if g == f) if len(w) >= CLAUSE]
        out[f] = tuple(sorted({tuple(sorted(set(w))) for w in own}))
    return out


def _descent(gram: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 300, rate: float = 1.5, penalty: float = 0.0005) -> np.ndarray:
    """Multinomial logistic regression by gradient descent, as weights of the examples, of whose products ``gram`` consists."""
    own = np.zeros_like(y)
    for _ in range(steps):
        z = gram @ own
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        own -= rate * (weight * (p - y) / len(y) + penalty * own)
    return own


def _fit(rows: list[tuple[str, set[str], int, float]]) -> tuple[list[str], dict[str, int], np.ndarray, list[tuple[float, bool]]]:
    """Families, vocabulary, weights (a last row of intercepts), and (probability, right) of each prediction of a family by a model that has not seen its fold."""
    families = sorted({f for f, *_ in rows})
    vocabulary = {g: i for i, g in enumerate(sorted(set().union(*(g for _, g, *_ in rows))))}
    x = np.zeros((len(rows), len(vocabulary) + 1), dtype=np.float32)
    y = np.zeros((len(rows), len(families)), dtype=np.float32)
    fold, weight = np.array([k for *_, k, _ in rows]), np.array([[x] for *_, x in rows], dtype=np.float32)
    for k, (f, own, *_) in enumerate(rows):
        x[k, [vocabulary[g] for g in own]] = 1
        x[k, -1] = 1
        y[k, families.index(f)] = 1
    gram = x @ x.T
    w = (x.T @ _descent(gram, y, weight)).astype(float)
    w[np.abs(w) < 0.1] = 0.0  # sparse
    tried = []
    for k in sorted(set(fold.tolist())):
        out, rest = fold == k, fold != k
        z = gram[np.ix_(out, rest)] @ _descent(gram[np.ix_(rest, rest)], y[rest], weight[rest])
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for i, row in zip(np.flatnonzero(out).tolist(), p):
            named = families[int(row.argmax())]
            if named != "none":
                tried.append((float(row.max()), named == rows[i][0]))
    return families, vocabulary, w, tried


def least_probability(tried: list[tuple[float, bool]]) -> float:
    """The least probability down to which the predictions (probability, right) are right in a share of ``PRECISION``; above 1, and so never met, where none is."""
    least, right = 2.0, 0
    tried = sorted(tried, reverse=True)
    for n, (p, good) in enumerate(tried, 1):
        right += good
        if right >= PRECISION * n and (n == len(tried) or tried[n][0] < p):
            least = p
    return least


@cache
def model() -> tuple[list[str], dict[str, int], np.ndarray, float]:
    """Families, vocabulary, weights and the least probability of a known family."""
    families, vocabulary, w, tried = _fit(labelled())
    return families, vocabulary, w, least_probability(tried)


@cache
def guards() -> tuple[str, ...]:
    """Strings of which every text has one that has a cue or covers a template to ``COVER``: of each template one word more than may be missing."""
    found = set(CUES)
    rank = lambda w: (not any(c in w for c in CUES), w.isalpha() or len(w) < 3, -len(w), w)
    for own in (set(t) for ts in templates().values() for t in ts):
        missing = len(own) - math.ceil(COVER * len(own) - 1e-6)
        found |= set(sorted(own, key=rank)[: missing + 1])
    return tuple(sorted(w for w in found if not any(o in w for o in found if o != w)))


def _has(text: Column, strings: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for x in strings:
        out = out | F.contains(text, F.lit(x))
    return out


def _words(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, _SPLIT), lambda x: F.trim(x, F.lit("."))), lambda x: x != "")


def _passages(texts: DataFrame) -> DataFrame:
    """(_row, id, start, lines, _low, _cue) of the lines and runs of lines of (_row, id, _low) that have a guard."""
    keep = [c for c in texts.columns if c != "_low"]
    # lines with a guard are marked once; a line is looked at if one of them can lie in a run from it
    lines = texts.select(*keep, F.split("_low", "\n").alias("_l"))
    marked = F.filter(F.transform("_l", lambda x, i: F.when(_has(x, guards()), i)), lambda i: i.isNotNull())
    lines = lines.select(*keep, "_l", marked.alias("_f")).where(F.size("_f") > 0)
    blank = lambda x: x.rlike(r"^[\s#*/;>|%-]*$")
    begins = F.filter(F.transform("_l", lambda x, i: F.struct(i.alias("at"), x.alias("x"))), lambda s: F.exists("_f", lambda p: (p >= s["at"]) & (p <= s["at"] + MOST + 1)) & ~blank(s["x"]))
    # each with the lines that a run from it may have
    near = lines.select(*keep, F.explode(F.transform(begins, lambda s: F.struct(s["at"].alias("at"), s["x"].alias("x"), F.slice(F.col("_l"), s["at"] + 2, F.lit(MOST + 1)).alias("after")))).alias("_s"))
    near = near.select(*keep, F.col("_s.at").alias("start"), "_s")
    first = F.struct(F.col("_s.x").alias("text"), F.lit(0).alias("inner"), F.lit(0).alias("last"), F.lit(True).alias("open"), F.array(F.struct(F.lit(1).alias("lines"), F.col("_s.x").alias("_low"))).alias("runs"))

    def longer(s: Column, x: Column) -> Column:
        text, inner = F.concat(s["text"], F.lit(" "), x), s["inner"] + s["last"]
        more = F.struct(text.alias("text"), inner.alias("inner"), F.size(_words(x)).alias("last"), F.lit(True).alias("open"), F.concat(s["runs"], F.array(F.struct((F.size(s["runs"]) + 1).alias("lines"), text.alias("_low")))).alias("runs"))
        end = F.struct(s["text"].alias("text"), s["inner"].alias("inner"), s["last"].alias("last"), F.lit(False).alias("open"), s["runs"].alias("runs"))
        return F.when(s["open"] & ~blank(x) & (inner <= MOST), more).otherwise(end)

    runs = near.select(*keep, "start", F.explode(F.aggregate("_s.after", first, longer, lambda s: s["runs"])).alias("_r")).select(*keep, "start", "_r.*")
    return runs.withColumn("_cue", (F.col("lines") == 1) & _has(F.col("_low"), CUES)).where(F.col("_cue") | _has(F.col("_low"), guards()))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, paragraph, family, probability, cover, confirmed) of every confirmed passage and other line with a cue; family is unknown where not confirmed."""
    families, vocabulary, w, least = model()
    spark = docs.sparkSession
    known = [g for g, i in vocabulary.items() if np.abs(w[i]).max() > 0]
    weights = spark.createDataFrame([(g, [float(v) for v in w[vocabulary[g]]]) for g in known], "g string, w array<double>")
    table = weights.agg(F.map_from_entries(F.collect_list(F.struct("g", "w"))).alias("m")).scalar()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # the lower-cased text is bound to a variable: as a column it would be made anew for every guard
    some = docs.where(F.exists(F.array(F.lower(text)), lambda low: _has(low, guards())))
    whole = some.select(F.col(id_col).alias("_id"), F.regexp_replace(F.lower(text), _SPELT, "license").alias("_low"))
    rows = _passages(whole.withColumn("_row", F.monotonically_increasing_id()))
    rows = rows.select("_row", "_id", "start", "lines", "_cue", _words(F.col("_low")).alias("_w"))
    pairs = F.when(F.size("_w") > 1, F.zip_with(F.slice("_w", F.lit(1), F.size("_w") - 1), F.slice("_w", F.lit(2), F.size("_w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    vocab = F.array(*(F.lit(g) for g in known))
    rows = rows.withColumn("_g", F.array_intersect(F.concat("_w", pairs), vocab)).withColumn("_m", table)
    start = F.array(*(F.lit(float(v)) for v in w[-1]))
    rows = rows.withColumn("_z", F.aggregate("_g", start, lambda z, g: F.zip_with(z, F.element_at(F.col("_m"), g), lambda a, b: a + b))).drop("_m")
    rows = rows.withColumn("_top", F.array_max("_z"))
    rows = rows.withColumn("probability", F.lit(1.0) / F.aggregate("_z", F.lit(0.0), lambda s, z: s + F.exp(z - F.col("_top"))))
    names = F.array(*(F.lit(f) for f in families))
    rows = rows.withColumn("_f", F.get(names, (F.array_position("_z", F.col("_top")) - 1).cast("int")))
    cover: Column = F.lit(0.0)
    for f, own in templates().items():
        shares = [F.size(F.array_intersect(F.array(*(F.lit(x) for x in t)), F.col("_w"))) / F.lit(float(len(t))) for t in own]
        cover = F.when(F.col("_f") == f, F.greatest(*shares) if len(shares) > 1 else shares[0]).otherwise(cover)
    rows = rows.withColumn("cover", F.round(cover, 9))
    confirmed = (F.col("_f") != "none") & (F.col("probability") >= least) & (F.col("cover") >= COVER)
    rows = rows.withColumn("confirmed", confirmed).where("confirmed or _cue")
    # in the order in which passages are chosen
    passage = F.struct((~F.col("confirmed")).alias("no"), "lines", (-F.col("cover")).alias("c"), (-F.col("probability")).alias("p"), "start", "confirmed", "_f", "probability", "cover")
    texts = rows.groupBy("_row").agg(F.first("_id").alias("_id"), F.array_sort(F.collect_list(passage)).alias("_p"))
    apart = lambda a, b: (a["start"] >= b["start"] + b["lines"]) | (b["start"] >= a["start"] + a["lines"])
    chosen = F.aggregate("_p", F.slice("_p", 1, 0), lambda own, x: F.when(F.forall(own, lambda o: apart(o, x)), F.concat(own, F.array(x))).otherwise(own))
    out = texts.select(F.col("_id").alias(id_col), F.explode(chosen).alias("x"))
    return out.select(id_col, F.col("x.start").alias("paragraph"), F.when(F.col("x.confirmed"), F.col("x._f")).otherwise("unknown").alias("family"), F.round("x.probability", 6).alias("probability"), F.col("x.cover").alias("cover"), F.col("x.confirmed").alias("confirmed"))
