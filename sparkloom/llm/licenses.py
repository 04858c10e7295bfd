"""License scans by diagonal voting.

Every run of ``K`` words of a text is hashed and joined, in Spark, with the positions of the same runs in the
license templates; a template of fewer words is one run. A label has templates of the paragraphs of its text or
notice, and of the short lines that stand for it. A match votes for the diagonal (template, position in text less
position in template). Votes are gathered by diagonal before they are shuffled; neighbouring diagonals, as insertions
and deletions leave them, are merged into a span. A span is verified by aligning it with its template: the longest
chain of matches that rises in the text and in the template has to hold enough of the template's runs. The contract's
phrases are found beside it as they stand, word for word.

The templates' positions are broadcast: they are a parameter, ``MAX_TEMPLATE_WORDS`` words at most. Null and empty
texts have no words and no labels. Votes belong to a row's id and text, so rows that share an id, or have none, are
judged each by its own text; equal rows are each kept. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import ALNUM, gram_hashes, hash_of, slices, word_hashes, word_spans

K, NEAR, COVER, MAX_TEMPLATE_WORDS = 3, 6, 0.5, 1_000_000

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short lines by label. Those of K words count only as they stand, a longer one from COVER of its runs on.
LINES = {
    "mit": ["under the mit", "licensed under mit", "released under mit", "license identifier mit"],
    "apache": ["licensed under apache", "released under apache", "license identifier apache"],
    "gpl": ["licensed under gpl", "released under gpl", "under the gpl", "under gnu gpl", "the gnu gpl", "license identifier gpl"],
    "bsd": ["licensed under bsd", "released under bsd", "under the bsd", "bsd 2 clause", "bsd 3 clause", "2 clause bsd", "3 clause bsd", "license identifier bsd"],
    "isc": ["under the isc", "licensed under isc", "license identifier isc"],
    "mpl": ["mozilla public license", "licensed under mpl", "license identifier mpl"],
    "cc": ["licensed under cc", "released under cc", "under a cc", "creative commons license", "creative commons attribution", "licensed under creative commons", "license identifier cc"],
    "proprietary": ["all rights reserved", "license identifier proprietary", "identifier licenseref proprietary"],
}
#: Paragraphs of the texts and notices of well-known licenses, by label; words in lower case.
NOTICES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "apache": [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"],
    "cc": ["this work is licensed under a creative commons attribution 4 0 international license", "this work is licensed under the creative commons attribution share alike 4 0 international license to view a copy of this license visit"],
    "proprietary": ["all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher"],
}
#: (label, words) of all templates.
TEMPLATES = [(label, text) for label, notices in NOTICES.items() for text in (*notices, *LINES.get(label, ()))]


def positions(spark, templates: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame, list[int]]:
    """(gram, template, at) of all runs of the templates, (template, label, length), and the sizes of runs."""
    rows, sizes, runs = [], [], set()
    for name, (label, text) in enumerate(templates):
        words = text.split()
        k = min(K, len(words))
        if not k:
            continue
        runs.add(k)
        sizes.append((name, label, len(words) - k + 1))
        rows += [(int(g), name, at) for at, g in enumerate(gram_hashes(hash_of(words), k).view(np.int64))]
    if sum(n for _, _, n in sizes) > MAX_TEMPLATE_WORDS:
        raise ValueError("the templates are larger than what may be broadcast")
    return spark.createDataFrame(rows, "gram long, template int, at int"), spark.createDataFrame(sizes, "template int, label string, length int"), sorted(runs)


def _base(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word index, phrase) of all places of the phrases, in order of the words."""
    found = []
    for j, phrase in enumerate(PHRASES):
        parts = hash_of(phrase.split())
        n = len(words) - len(parts) + 1
        if n > 0:
            hit = words[:n] == parts[0]
            for i, p in enumerate(parts[1:], 1):
                hit &= (words[i : i + n] == p) & (text[i : i + n] == text[:n])
            found += [(int(w), j) for w in np.flatnonzero(hit)]
    found.sort()
    return np.array([w for w, _ in found], np.int64), np.array([j for _, j in found], np.int64)


def aligned(places: list[int], ats: list[int]) -> int:
    """Matches in the longest chain that rises both in the text and in the template."""
    tails: list[int] = []
    for _, at in sorted(zip(places, ats, strict=True), key=lambda m: (m[0], -m[1])):
        i = bisect_left(tails, at)
        tails[i : i + 1] = [at]
    return len(tails)


def _verified(spans: DataFrame) -> DataFrame:
    """(_id, _row, label, cover) of the spans (_id, _row, label, length, places, ats) that hold COVER of their template at least."""

    def run(batches):
        for batch in batches:
            cover = [aligned(*m) / n for *m, n in zip(*(batch.column(c).to_pylist() for c in ("places", "ats", "length")), strict=True)]
            out = batch.select(["_id", "_row", "label"]).append_column("cover", pa.array(cover, pa.float64()))
            yield out.filter(pa.array([c >= COVER for c in cover], pa.bool_()))

    return spans.mapInArrow(run, "_id long, _row long, label string, cover double")


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of ``docs``.

    score: 1 with a phrase, else the largest share of a template that a verified span covers, else 0."""
    templates = TEMPLATES if templates is None else templates
    names = list(PHRASES.values())
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    docs = docs.withColumn("_row", F.xxhash64("doc_id", "text"))

    def count(batches):
        for batch in batches:
            for row, end, data, offsets in slices(batch, "text"):
                starts, ends, first = word_spans(data, offsets, ALNUM)
                text = np.repeat(np.arange(end - row), np.diff(first))
                at, kind = _base(word_hashes(data, starts, ends), text)
                low = np.searchsorted(at, first)
                columns = [np.diff(first), np.diff(low)]
                edges = [(at[a] - first[i], at[b - 1] - first[i]) if b > a else (None, None) for i, (a, b) in enumerate(zip(low, low[1:], strict=False))]
                labels = [",".join(sorted({names[k] for k in kind[a:b]})) for a, b in zip(low, low[1:], strict=False)]
                own = [batch.column(c).slice(row, end - row) for c in ("doc_id", "_row")]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, pa.int64()) for c in columns), pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64()), pa.array(labels, pa.string())], ["doc_id", "_row", "n_words", "n_base", "first_word", "last_word", "base_labels"])

    def grams(batches):
        for batch in batches:
            for row, end, data, offsets in slices(batch, "text", 1 << 18):
                starts, ends, first = word_spans(data, offsets, ALNUM)
                words = word_hashes(data, starts, ends)
                text = np.repeat(np.arange(end - row), np.diff(first))
                for k in runs:
                    found = gram_hashes(words, k)
                    keep = np.flatnonzero(text[: len(found)] == text[k - 1 : k - 1 + len(found)])
                    own = [batch.column(c).slice(row, end - row).take(pa.array(text[keep])) for c in ("doc_id", "_row")]
                    yield pa.RecordBatch.from_arrays([*own, pa.array((keep - first[text[keep]]).astype(np.int32)), pa.array(found[keep].view(np.int64))], ["_id", "_row", "pos", "gram"])

    where, sizes, runs = positions(docs.sparkSession, templates)
    votes = docs.mapInArrow(grams, "_id long, _row long, pos int, gram long").join(F.broadcast(where), "gram")
    diagonals = votes.groupBy("_id", "_row", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"))
    along = Window.partitionBy("_id", "_row", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(along)
    chains = diagonals.withColumn("new", (F.coalesce(gap, F.lit(NEAR + 1)) > NEAR).cast("int")).withColumn("run", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    matches = F.collect_list(F.transform("ats", lambda a: F.struct((a + F.col("diagonal")).alias("place"), a.alias("at"))))
    spans = chains.groupBy("_id", "_row", "template", "run").agg(F.flatten(matches).alias("m")).join(F.broadcast(sizes), "template")
    spans = spans.filter(F.size("m") >= COVER * F.col("length"))  # fewer matches than the share asked for can't hold it
    verified = _verified(spans.select("_id", "_row", "label", "length", F.col("m.place").alias("places"), F.col("m.at").alias("ats")))
    added = verified.groupBy("_id", "_row").agg(F.collect_set("label").alias("added"), F.max("cover").alias("cover"))
    counted = docs.mapInArrow(count, "doc_id long, _row long, n_words long, n_base long, first_word long, last_word long, base_labels string")
    both = counted.join(added.withColumnRenamed("_row", "_of"), (F.col("_row") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    labels = F.array_join(F.array_sort(F.array_union(base, F.coalesce("added", F.array().cast("array<string>")))), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.cast("double").alias("score"))
