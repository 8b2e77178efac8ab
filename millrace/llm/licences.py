"""Licence statements in documents: a trained paragraph classifier, confirmed by comparison with templates.

DataFrame and SQL functions only, and the sparse multinomial logistic regression of pyspark.ml, which runs
in the JVM on a DataFrame; no Python runs on the executors.

Paragraphs are lines. The classifier sees the word n-grams (one to three words) that occur in the templates.
It is trained on every stretch of words of the templates that is long enough to tell something, and on
the corpus's own paragraphs as the class "unknown": all of them that hold no trigram of a template and name no
licence, but for the half, by a hash of the words, on which the probability is calibrated from which a paragraph
counts as a licence. Paragraphs with the same n-grams are one row with a weight, so none is left out. A prediction stands only
if the paragraph shares enough word trigrams with a template of its family, or if it names a licence: by its
full name, or by its short name beside a word of licensing. A name settles the family however the rest is
worded, and as it is evidence of its own, the classifier need only prefer a licence to the unknown class.
"""

from __future__ import annotations

import dataclasses
import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sinks.scratch import scratch_path

UNKNOWN = "unknown"
#: Notices as their licences or stewards publish them, and short forms in common use.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("LGPL", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Licensed under the BSD 3-Clause License."),
    ("BSD", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES'),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Released under the ISC License."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-2.0", "SPDX-License-Identifier: EPL-2.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("MIT", "MIT License"), ("MIT", "The MIT License (MIT)"), ("MIT", "License: MIT"), ("MIT", "Licensed under MIT"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"), ("Apache-2.0", "License: Apache-2.0"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("GPL-3.0", "Released under the GPLv3 license"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"), ("GPL-2.0", "Released under the GPLv2 license"),
    ("LGPL", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"), ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("BSD", "BSD 2-Clause License"), ("BSD", "Released under the BSD license"), ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"), ("ISC", "ISC License"), ("Unlicense", "The Unlicense"), ("CC0-1.0", "CC0 1.0 Universal"),
]
_GPL = "(?<!affero )(?<!lesser )(?<!library )general public licen[sc]e"
#: Family, names that stand for it anywhere, and short names that do so beside a word of licensing; first match wins.
NAMES: list[tuple[str, str, str]] = [
    ("AGPL-3.0", "affero general public licen[sc]e", "agpl ?v?3?"),
    ("LGPL", "(lesser|library) general public licen[sc]e", "lgpl ?v?[23]?"),
    ("GPL-2.0", f"{_GPL} ((?!version|v[0-9])[a-z0-9]+ ){{0,16}}?(version |v ?)2", "gpl (version )?v?2|gplv2"),
    ("GPL-3.0", _GPL, "gpl (version )?v?3|gplv3|gpl"),
    ("Apache-2.0", "apache (software )?licen[sc]e", "apache v?2|asl ?2|apache"),
    ("BSD", "bsd (style )?licen[sc]e|bsd [0234] clause|[0234] clause bsd", "bsd"),
    ("MPL-2.0", "mozilla public licen[sc]e", "mpl ?v?2?"),
    ("EPL-2.0", "eclipse public licen[sc]e", "epl ?v?[12]?"),
    ("CC0-1.0", "cc0 1 0|creative commons (zero|cc0)", "cc0"),
    ("CC-BY-NC", "creative commons attribution non ?commercial|cc by nc", "by nc"),
    ("CC-BY-SA", "creative commons attribution share ?alike|cc by sa", "by sa"),
    ("CC-BY", "creative commons attribution(?! non ?commercial| share ?alike| no ?deriv)|cc by [1-4] [0-9]", "cc by(?! nc| sa| nd)"),
    ("ISC", "isc licen[sc]e", "isc"),
    ("Unlicense", "the unlicense|unlicense org", "unlicense"),
    ("MIT", "(mit|expat|x11) licen[sc]e", "mit|expat"),
]
_LINK = "((under|by|with|of|the|a|an|terms|conditions|and|identifier|is|in|accordance|gnu|new|version|either|name|type) )*"
_LICENSED = f"(licen[sc](e|ed|es|ing) {_LINK}|(released|distributed|redistributed|available|published|provided|offered|covered|governed) (under|by) {_LINK})"
#: A training stretch has at least so many words.
STRETCH = 4
FALSE_RATE = 0.0005
OVERLAP = 0.6


def words_of(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def grams_of(words: Column, n: int) -> Column:
    """The distinct `n`-grams of an array of words."""
    starts = F.sequence(F.lit(0), F.size(words) - n)
    joined = F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    return F.when(F.size(words) >= n, F.array_distinct(joined)).otherwise(F.array().cast("array<string>"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (number of the line, from 0) and its words, for every line of every document.

    The words are made within the explode: as a column of its own before it, Spark would compute them anew
    wherever they are used, even for every gram.
    """
    lines = F.transform(F.split("text", "\n"), words_of)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(lines).alias("paragraph", "words"))


@dataclasses.dataclass(frozen=True)
class LicenceModel:
    families: list[str]
    vectorizer: CountVectorizerModel
    regression: LogisticRegressionModel
    threshold: float


def _templates(spark) -> DataFrame:
    """family, words and trigrams of the templates, built as rows of a literal."""
    rows = F.array(*(F.struct(F.lit(f).alias("family"), F.lit(t).alias("text")) for f, t in TEMPLATES))
    table = spark.range(1).select(F.inline(rows))
    return table.select("family", words_of(F.col("text")).alias("words"))


def named(words: Column) -> Column:
    """The family of the licence that a paragraph names, null without one."""
    pick = lambda t: F.coalesce(*(F.when(t.rlike(f" ({full}) | {_LICENSED}({short}) | ({short}) ([0-9] )*licen[sc]e[ds]? "), F.lit(f)) for f, full, short in NAMES))
    marks = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return F.transform(F.array(marks), lambda t: F.when(t.rlike("licen[sc]|public|creative|unlicense|cc|bsd| under | by "), pick(t)))[0]


def _template_grams() -> dict[int, list[str]]:
    """The distinct n-grams of all templates by n, from 1 to 3, ascending."""
    words = [re.findall("[a-z0-9]+", t.lower()) for _, t in TEMPLATES]
    return {n: sorted({" ".join(w[i : i + n]) for w in words for i in range(len(w) - n + 1)}) for n in (1, 2, 3)}


def _once(table: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once, within an explode: Spark would copy plain ones to wherever they are used."""
    kept = [F.col(c) for c in table.columns]
    made = table.select(*kept, F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("made"))
    return made.select(*kept, *(F.col(f"made.{n}").alias(n) for n in columns))


def _looked_at(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph, grams (those of the templates, ascending), trigrams (how many distinct ones it has), named,
    unknown (no trigram of a template and no name) and fit, for every paragraph with a word."""
    known = _template_grams()
    lines = paragraphs(docs).where("size(words) > 0")
    # Longer grams begin at a word of the templates, and few words of a text are one.
    lines = _once(lines, at=F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: F.element_at("words", i).isin(known[1])))
    joined = lambda n: F.transform(F.filter("at", lambda i: i <= F.size("words") - (n - 1)), lambda i: F.array_join(F.slice("words", i, n), " "))
    own = lambda n: F.filter(joined(n), lambda g: g.isin(known[n]))
    lines = _once(lines, one=F.transform("at", lambda i: F.element_at("words", i)), two=own(2), three=own(3))
    shared = F.size("three") > 0
    lines = _once(
        lines, grams=F.array_sort(F.array_distinct(F.concat("one", "two", "three"))), named=named(F.col("words")),
        trigrams=F.when(shared, F.size(grams_of(F.col("words"), 3))).otherwise(F.greatest(F.lit(0), F.size("words") - 2)),
        fit=F.pmod(F.xxhash64("words", F.lit(1)), F.lit(2)) == 0,
    )
    return lines.select("doc_id", "paragraph", "grams", "trigrams", "named", (~shared & F.col("named").isNull()).alias("unknown"), "fit")


def _saved(docs: DataFrame) -> DataFrame:
    place = scratch_path(docs.sparkSession, "licence_paragraphs")
    _looked_at(docs).write.parquet(place)
    return docs.sparkSession.read.parquet(place)


def fit_licences(docs: DataFrame, false_rate: float = FALSE_RATE) -> LicenceModel:
    """Train on the templates and on every paragraph of `docs` without part of one.

    At most the share `false_rate` of the paragraphs kept for calibration reaches the threshold, if that lies from
    0.5 to 0.99.
    """
    return _fit(_saved(docs), false_rate)


def _fit(lines: DataFrame, false_rate: float) -> LicenceModel:
    spark = lines.sparkSession
    size = F.size("words")
    stretches = _templates(spark).select("family", "words", F.explode(F.sequence(F.lit(STRETCH), F.greatest(F.lit(STRETCH), size))).alias("n"))
    stretches = stretches.select("family", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size - F.col("n") + 1)), lambda i: F.slice("words", i, F.col("n")))).alias("words"))
    positives = stretches.distinct().select("family", F.concat(*(grams_of(F.col("words"), n) for n in (1, 2, 3))).alias("grams"))

    # Paragraphs that hold part of a template or name a licence are no examples of the unknown class.
    place = scratch_path(spark, "licence_examples")
    lines.where("unknown").groupBy("fit", "grams").agg(F.count("*").cast("double").alias("weight")).write.parquet(place)
    unknown = spark.read.parquet(place)

    families = sorted({f for f, _ in TEMPLATES})
    number = F.element_at(F.create_map(*(x for i, f in enumerate(families) for x in (F.lit(f), F.lit(float(i + 1))))), F.col("family"))
    vectorizer = CountVectorizerModel.from_vocabulary([g for grams in _template_grams().values() for g in grams], "grams", "features").setBinary(True)
    # Both kinds weigh the same in all.
    weigh = (unknown.where("fit").agg(F.sum("weight")).first()[0] or 0.0) / positives.count()
    negatives = unknown.where("fit").select(F.lit(0.0).alias("label"), "grams", "weight")
    rows = positives.select(number.alias("label"), "grams", F.lit(max(1.0, weigh)).alias("weight")).union(negatives)
    learner = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=40, weightCol="weight")
    regression = learner.fit(vectorizer.transform(rows))
    model = LicenceModel([UNKNOWN, *families], vectorizer, regression, 0.5)
    # All paragraphs kept for calibration, counted by probability in steps of 0.0001, upwards.
    steps = F.ceil(F.col("probability") * 10_000).alias("step")
    counts = dict(_score(model, unknown.where("NOT fit")).groupBy(steps).agg(F.sum("weight")).collect())
    return dataclasses.replace(model, threshold=_threshold(counts, false_rate))


def _threshold(counts: dict[int, float], false_rate: float) -> float:
    """The least probability from 0.5 to 0.99 in steps of 0.0001 that at most the share `false_rate` lies above.

    `counts` has the paragraphs with a probability above (step - 1) / 10,000 and at most step / 10,000.
    """
    allowed, above, step = false_rate * sum(counts.values()), 0.0, 10_000
    while step > 5_000 and above + counts.get(step, 0.0) <= allowed:
        above += counts.get(step, 0.0)
        step -= 1
    return min(0.99, step / 10_000)


def _score(model: LicenceModel, rows: DataFrame) -> DataFrame:
    """Adds family (the likeliest but unknown) and its probability, all probabilities, and that of any licence."""
    scored = model.regression.transform(model.vectorizer.transform(rows))
    # Within an explode: Spark would move a filter on a probability below the classifier, and run it once per mention there.
    kept = [F.col(c) for c in rows.columns]
    scored = scored.select(*kept, F.explode(F.array(vector_to_array("probability"))).alias("every"))
    chances = F.slice("every", 2, len(model.families) - 1)
    best = F.array_max(chances)
    names = F.array(*(F.lit(f) for f in model.families[1:]))
    return scored.select(*kept, F.element_at(names, F.array_position(chances, best).cast("int")).alias("family"), best.alias("probability"), chances.alias("chances"), (1 - F.col("every")[0]).alias("any"))


def find_licences(docs: DataFrame, model: LicenceModel | None = None, overlap: float = OVERLAP) -> DataFrame:
    """One row per licence paragraph: doc_id, paragraph, family, probability, template_overlap.

    `docs` has `doc_id` and `text`; other columns are ignored. A paragraph is a line of the whole text, numbered
    from 0. It is reported if the classifier gives a family at least the calibrated probability, and if of
    its word trigrams, or of those of a template of that family, the share `overlap` is common to both. It is
    also reported if it names a licence (see `NAMES`) and the classifier prefers a licence to the unknown class;
    then family is the one named, and probability the classifier's for it.
    Null and empty texts have no paragraphs; a null doc_id stays null; repeated rows are scanned each;
    ties between families go to the first by name; an empty table gives no rows.
    """
    spark = docs.sparkSession
    if model is None:
        lines = _saved(docs)
        model = _fit(lines, FALSE_RATE)
    else:
        lines = _looked_at(docs)
    if overlap > 0:  # neither a trigram nor a name: it cannot be confirmed
        lines = lines.where("NOT unknown")
    scored = _score(model, lines)
    place = F.create_map(*(x for i, f in enumerate(model.families[1:]) for x in (F.lit(f), F.lit(i + 1))))
    own = scored.where((F.col("probability") >= model.threshold) | (F.col("named").isNotNull() & (F.col("any") >= 0.5))).select(
        "doc_id", "paragraph", F.coalesce("named", "family").alias("family"), "named", "grams", "trigrams",
        F.when(F.col("named").isNull(), F.col("probability")).otherwise(F.element_at("chances", F.element_at(place, F.col("named")))).alias("probability"),
    )
    forms = _templates(spark).select("family", grams_of(F.col("words"), 3).alias("form"))
    lists = forms.groupBy("family").agg(F.collect_list("form").alias("forms"))  # the fixed table above
    common = F.array_max(
        F.transform(
            "forms",
            lambda form: F.size(F.array_intersect(form, F.col("grams"))) / F.greatest(F.lit(1), F.least(F.size(form), F.col("trigrams"))),
        )
    )
    compared = own.join(F.broadcast(lists), "family").withColumn("template_overlap", common)
    return compared.where((F.col("template_overlap") >= overlap) | F.col("named").isNotNull()).select("doc_id", "paragraph", "family", "probability", "template_overlap")
