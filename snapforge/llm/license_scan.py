"""License scan by diagonal voting.

Every rolling ``K``-gram of words of every document is hashed and joined, in Spark, to the positions
of the same hashes in the templates (a small fixed table, broadcast). A match at word ``p`` of a
document and word ``t`` of a template votes for the diagonal ``p - t``. Votes are summed per document,
template and diagonal; diagonals at most ``SLIP`` apart (words were put in or left out) are merged;
each merged run is cut at its best spans, which are verified: a span's score is the template's words that matched k-grams cover, over the
template's words and the words that stand in the span beside those. It must be at least ``COVER``, for templates of any size: 8 words
stand one word left out or put in, 5 words none. A span is not longer than ``STRETCH`` times the template; a run that is, such as a
notice with parts of it repeated behind, gives all its spans that don't overlap, best first. A span more
than half in one of another label with a better score (or as good, and more words) is not reported: a licence whose
name holds another's.

Words are runs of 0-9, a-z and non-ASCII characters of the text with A-Z lower-cased. Beside the
method's labels there are base labels: a phrase's words standing consecutively. A null text
is empty and has no words.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapforge.llm.common import WordTable, runs, text_docs, window_hashes

K = 3
SLIP = 3
COVER = 0.86
STRETCH = 1.5

#: The phrases of the base labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices by which licenses are commonly granted, and their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("mit", "Licensed under the MIT License"),
    ("bsd", "Licensed under the BSD License"),
    ("gpl", "Licensed under the GNU General Public License"),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("agpl", "Licensed under the GNU Affero General Public License"),
    ("mpl", "Licensed under the Mozilla Public License"),
    *((label, f"SPDX-License-Identifier: {name}") for label, name in [
        ("mit", "MIT"), ("apache", "Apache-2.0"), ("gpl", "GPL"), ("lgpl", "LGPL"), ("agpl", "AGPL"), ("mpl", "MPL"), ("isc", "ISC"),
        ("bsd", "BSD"), ("epl", "EPL"), ("unlicense", "Unlicense"), ("cc0", "CC0"),
    ]),
    # of any version
    *(
        (f"cc-{kind}", f"{start} {kind}")
        for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
        for start in ("Licensed under CC", "SPDX-License-Identifier: CC")
    ),
    *(
        (label, notice.format(rest))
        for notice in ("under a Creative Commons Attribution{}", "This work is licensed under a Creative Commons Attribution{} 4.0 International License")
        for label, rest in [
            ("cc-by", ""), ("cc-by-sa", "-ShareAlike"), ("cc-by-sa", " Share Alike"), ("cc-by-nc", "-NonCommercial"), ("cc-by-nc", "-Non-Commercial"),
            ("cc-by-nd", "-NoDerivatives"), ("cc-by-nd", "-NoDerivs"), ("cc-by-nc-sa", "-NonCommercial-ShareAlike"),
            ("cc-by-nc-sa", "-Non-Commercial-Share-Alike"), ("cc-by-nc-nd", "-NonCommercial-NoDerivatives"), ("cc-by-nc-nd", "-NonCommercial-NoDerivs"),
        ]
    ),
]

_SEPARATORS = bytes(c for c in range(0x80) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_TABLE = bytes.maketrans(
    _SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123))
)
def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def rolling(texts: list[bytes], k: int = K) -> list[np.ndarray]:
    """For each text the hash of each k-gram of its words, as signed 64-bit numbers."""
    table = WordTable([t.translate(_TABLE) for t in texts])
    grams = window_hashes(table.hash, k).view(np.int64)
    cuts = table.words_before.tolist()
    return [grams[a : max(a, b - k + 1)] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _keyed_text(docs: DataFrame) -> DataFrame:
    """(id, 64-bit text hash) as key, and text."""
    return text_docs(docs).select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"), "text")


def phrase_places(docs: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base (labels): where the phrases stand."""
    wanted = [(p.encode().split(), label) for p, label in phrases.items()]
    # a quick look at the whole text; the places are counted on its words
    some = re.compile(b"|".join(re.escape(max(w, key=len)) for w, _ in wanted))

    def places(words: list[bytes], text: bytes) -> tuple[int, int | None, int | None, list[str]]:
        starts, labels = [], set()
        if some.search(text):
            for phrase, label in wanted:
                at = -1
                while True:
                    try:
                        at = words.index(phrase[0], at + 1)
                    except ValueError:
                        break
                    if words[at : at + len(phrase)] == phrase:
                        starts.append(at)
                        labels.add(label)
        return len(starts), min(starts, default=None), max(starts, default=None), sorted(labels)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for t in batch.column(1):
                raw = t.as_buffer().to_pybytes()
                words = words_of(raw)
                for c, v in zip(cols, (len(words), *places(words, raw.lower())), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                names=["key", "n_words", "n_base", "first_word", "last_word", "base"],
            )

    return _keyed_text(docs).mapInArrow(
        each,
        "key struct<doc_id: long, h: long>, n_words long, n_base long, first_word long, last_word long, base array<string>",
    )


def rolling_grams(docs: DataFrame, k: int = K) -> DataFrame:
    """key, grams: the hash of every word k-gram of a document, by place."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() for t in batch.column(1)]
            for first, some in runs(texts):
                grams = rolling(some, k)
                ends = np.cumsum([0, *map(len, grams)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(some)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(grams))),
                    ],
                    names=["key", "grams"],
                )

    return _keyed_text(docs).mapInArrow(each, "key struct<doc_id: long, h: long>, grams array<long>")


def best_spans(hits: list[tuple[int, int]], size: int, k: int) -> list[tuple[int, int, float, int]]:
    """(first word, last word, score, words of the template covered) of the spans of a run that don't overlap, best first chosen, by place.

    ``hits``: (word of the document, word of the template) of each matched k-gram, by place. For each hit the best end of a
    span that begins there is found; of the spans, the best are taken (more words, then the earlier one, if equal)."""
    reach, found = STRETCH * size, []
    for i, (first, _) in enumerate(hits):
        if i and hits[i - 1][0] == first:
            continue
        seen: set[int] = set()
        best = (0.0, 0, 0)
        for j in range(i, len(hits)):
            p, t = hits[j]
            if p - first + k > reach:
                break
            seen.update(range(t, t + k))
            if j + 1 < len(hits) and hits[j + 1][0] == p:
                continue
            score = len(seen) / (size + max(0, p - first + k - len(seen)))
            best = max(best, (score, len(seen), -(p + k - 1)))
        if best[0] >= COVER:
            found.append((-best[0], -best[1], first, -best[2]))
    out: list[tuple[int, int, float, int]] = []
    for score, words, first, last in sorted(found):
        at = bisect.bisect(out, (first,))
        if (at == 0 or out[at - 1][1] < first) and (at == len(out) or out[at][0] > last):
            out.insert(at, (first, last, -score, -words))
    return out


def spans(grams: DataFrame, templates: list[tuple[str, str]], k: int = K) -> DataFrame:
    """Verified spans: key, label, template, first_word, last_word, score; from rows (key, grams)."""
    spark = grams.sparkSession
    rows = []
    for number, (label, notice) in enumerate(templates):
        words = words_of(notice.encode())
        if len(words) < k:
            raise ValueError(f"a template has fewer than {k} words: {notice!r}")
        rows += [(g, number, label, i, len(words)) for i, g in enumerate(rolling([notice.encode()], k)[0].tolist())]
    known = spark.createDataFrame(rows, "gram long, template int, label string, t long, size long")
    votes = (
        grams.select("key", F.posexplode("grams").alias("p", "gram"))
        .join(F.broadcast(known), "gram")  # some hundred k-grams of fixed templates
        .groupBy("key", "template", "label", "size", (F.col("p") - F.col("t")).alias("diagonal"))
        .agg(F.collect_list("p").alias("ps"))  # of one document
    )
    by = Window.partitionBy("key", "template").orderBy("diagonal")
    merged = (
        votes.withColumn("apart", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > SLIP, F.lit(True)))
        .withColumn("run", F.sum(F.col("apart").cast("int")).over(by))
        .withColumn("hits", F.transform("ps", lambda p: F.struct(p.cast("long").alias("p"), (p - F.col("diagonal")).alias("t"))))
        .groupBy("key", "template", "label", "size", "run")
        .agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, (size, hits) in enumerate(zip(batch.column("size").to_pylist(), batch.column("hits").to_pylist(), strict=True)):
                for span in best_spans([(h["p"], h["t"]) for h in hits], size, k):
                    rows.append(i)
                    found.append(span)
            of = pa.array(rows, pa.int64())
            cols = list(zip(*found, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(of) for c in ("key", "template", "label")), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                names=["key", "template", "label", "first_word", "last_word", "score", "words"],
            )

    key = grams.schema["key"].dataType.simpleString()
    verified = merged.select("key", "template", "label", "size", "hits").mapInArrow(
        cut, f"key {key}, template int, label string, first_word long, last_word long, score double, words long"
    )
    length = F.col("last_word") - F.col("first_word") + 1
    # spans are no longer than this, so few begin near one
    reach = int(STRETCH * max(len(words_of(n.encode())) for _, n in templates)) + 1
    near = Window.partitionBy("key").orderBy("first_word").rangeBetween(-reach, reach)
    span = F.struct("label", "first_word", "last_word", F.struct("score", "words").alias("worth"))

    def beats(b: Column) -> Column:
        common = F.least(b["last_word"], F.col("last_word")) - F.greatest(b["first_word"], F.col("first_word")) + 1
        return (b["label"] != F.col("label")) & (b["worth"] > F.col("span")["worth"]) & (2 * common > length)

    return (
        verified.withColumn("span", span)
        .withColumn("others", F.collect_set("span").over(near))
        .where(~F.exists("others", beats))
        .select("key", "label", "template", "first_word", "last_word", "score")
    )


def license_labels(
    docs: DataFrame,
    phrases: dict[str, str] | None = None,
    templates: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the best span's, or 1 if there is a base label, or else 0. Rows alike in id and text are
    scanned each, with one result.
    """
    found = phrase_places(docs, PHRASES if phrases is None else phrases)
    per_key = (
        spans(rolling_grams(docs), TEMPLATES if templates is None else templates)
        .groupBy("key")
        .agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    )
    none = F.array().cast("array<string>")
    return found.join(per_key, "key", "left").select(
        "key.doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).cast("double").alias("score"),
    )
