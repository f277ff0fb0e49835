"""License scans by diagonal voting.

All rolling word k-grams of every text (k = 2 and 5, hashed to two lanes of 64 bits) are joined with the positions of
the same k-grams in license templates, a fixed table whose size is checked before it is broadcast.  A match of a text's word i and
a template's word j votes for the diagonal i - j; votes are aggregated by text, template and diagonal.  Diagonals of a
template that lie within GAP words of each other are merged (words left out or put in shift what follows), and merged spans are verified:
the words they cover must be at least COVER of the template's and of the span's own.  Short templates (under LONG words, k = 2)
are phrases; a phrase is found where all of its k-grams vote for one diagonal.

Both lanes of a k-gram must agree, 128 bits, so what is found has the template's words; no text is dealt, only votes are.

Defined results: null and empty texts have no words and no finding; only A-Z are lower-cased; repeated rows are answered each, with
equal results; null ids are kept; places of a phrase may overlap; other columns are left out; an empty table has no rows.
A row's place among others is not used: votes are collected by id and 128 bits of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_BYTES, arrow_batch, rows_by_bytes
from .words import runs, words

PHRASE_K, TEXT_K = 2, 5
#: Templates of at least so many words are texts, others phrases.
LONG = 10
GAP, COVER = 8, 0.8
#: k-grams in one row before it is exploded, and most k-grams of all templates (they are broadcast).
PIECE, MOST_GRAMS = 1 << 16, 100_000
KEY = ["_id", "_k1", "_k2"]


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False


#: Phrases and notices as their licenses state them (fixed values).
TEMPLATES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
    Template("lgpl", "lesser general public license"),
    Template("agpl", "affero general public license"),
    Template("mpl", "mozilla public license"),
    Template("bsd", "bsd license"),
    Template("isc", "isc license"),
    Template("cc-by", "cc by"),
    Template("cc-by", "creative commons attribution"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("rights-reserved", "all rights reserved"),
    Template("apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    Template("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    Template("no-warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    Template("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    Template("isc-notice", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("mpl-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)

#: Lower-cases A-Z, and turns what is no letter, digit or byte of a further character into a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(texts: list[str | None]):
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of lower-cased texts."""
    return words([(t or "").encode().translate(_LETTERS) for t in texts])


def template_words(t: Template) -> list[str]:
    w = words_of([t.text])
    return [w.text(k, k + 1).decode() for k in range(len(w.start))]


def template_grams(templates: tuple[Template, ...]) -> list[tuple[int, int, int, int, int]]:
    """(lane 1, lane 2, template, position, k) of every k-gram; a row without template stands for each text."""
    out = [(0, 0, -1, 0, 0)]
    for n, t in enumerate(templates):
        w = words_of([t.text])
        k = TEXT_K if len(w.start) >= LONG else PHRASE_K
        if len(w.start) < k:
            raise ValueError(f"a template needs at least {PHRASE_K} words: {t.text!r}")
        lanes = [runs(w.hashes(lane), w.first, k, lane)[0].view(np.int64).tolist() for lane in (0, 1)]
        out += [(a, b, n, j, k) for j, (a, b) in enumerate(zip(*lanes, strict=True))]
    if len(out) > MOST_GRAMS:
        raise ValueError(f"{len(out)} k-grams of templates are too many to broadcast")
    return out


def rolling_grams(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _k1, _k2, n_words, k, first, lane1, lane2): pieces of the rolling k-grams of each text, and one piece that stands for it."""

    def rows(ids: list[int | None], texts: list[str | None]) -> Iterator[pa.RecordBatch]:
        w = words_of(texts)
        lanes = {(k, lane): runs(w.hashes(lane), w.first, k, lane) for k in (PHRASE_K, TEXT_K) for lane in (0, 1)}
        keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest((t or "").encode()) for t in texts), dtype=np.int64).reshape(-1, 2)
        counts = np.diff(w.first)
        doc, k_of, first, bounds, parts = [], [], [], [], []
        for k in (PHRASE_K, TEXT_K):
            ends = np.cumsum(np.maximum(0, counts - k + 1))
            for d, (lo, hi) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
                for a in range(lo, hi, PIECE):
                    doc.append(d), k_of.append(k), first.append(a - lo), bounds.append(min(hi, a + PIECE) - a), parts.append((k, a, min(hi, a + PIECE)))
        n, m = len(doc), len(ids)
        offsets = np.concatenate(([0], np.cumsum([*bounds, *[1] * m]))).astype(np.int32)
        values = [np.concatenate([*(lanes[k, lane][0][a:b] for k, a, b in parts), np.zeros(m, dtype=np.uint64)]).view(np.int64) for lane in (0, 1)]
        at = np.array([*doc, *range(m)], dtype=np.int64)
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v)) for v in values]
        yield pa.RecordBatch.from_arrays(
            [pa.array([ids[i] for i in at.tolist()], type=pa.int64()), pa.array(keys[at, 0]), pa.array(keys[at, 1]), pa.array(counts[at].astype(np.int64)), pa.array([*k_of, *[0] * m], type=pa.int32()), pa.array([*first, *[0] * m], type=pa.int64()), *lists],
            names=["_id", "_k1", "_k2", "n_words", "k", "first", "lane1", "lane2"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in rows_by_bytes(batches, text_col, BATCH_BYTES // 4):
            yield from rows([i for i, _ in some], [t for _, t in some])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, "_id long, _k1 long, _k2 long, n_words long, k int, first long, lane1 array<long>, lane2 array<long>")


def votes(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n_words, template, diagonal, places array of the template, copies): votes by diagonal; template -1 stands for the text itself."""
    known = docs.sparkSession.createDataFrame(template_grams(templates), "lane1 long, lane2_ long, template int, at int, k_ int")
    grams = rolling_grams(docs, id_col, text_col).select(*KEY, "n_words", "k", "first", "lane2", F.posexplode("lane1").alias("_n", "lane1"))
    hits = grams.join(F.broadcast(known), "lane1").where((F.col("lane2")[F.col("_n")] == F.col("lane2_")) & (F.col("k") == F.col("k_")))
    hits = hits.withColumn("diagonal", F.col("first") + F.col("_n") - F.col("at"))
    return hits.groupBy(*KEY, "template", "diagonal").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("at")).alias("places"), F.count("*").alias("copies"))


def covered(places: Column, k: Column) -> Column:
    """Words that k-grams at ascending places cover."""
    step = lambda s, p: F.struct((s["n"] + k - F.greatest(F.lit(0), s["end"] - p)).alias("n"), (p + k).alias("end"))
    return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda s: s["n"])


def spans(found: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(key, template, label, base, start, end, cover, verified): phrases on one diagonal, and merged diagonals of texts."""
    sizes = [(n, t.label, t.base, len(template_words(t))) for n, t in enumerate(templates)]
    about = found.sparkSession.createDataFrame(sizes, "template int, label string, base boolean, length int")
    rows = found.join(F.broadcast(about), "template")
    k = F.when(F.col("length") >= LONG, TEXT_K).otherwise(PHRASE_K)
    phrases = rows.where(F.col("length") < LONG).withColumn("start", F.col("diagonal"))
    cover = covered(F.col("places"), k) / F.col("length")
    phrases = phrases.select(*KEY, "template", "label", "base", "start", (F.col("start") + F.col("length")).alias("end"), cover.alias("cover"), (F.size("places") == F.col("length") - PHRASE_K + 1).alias("verified"))
    order = Window.partitionBy(*KEY, "template").orderBy("diagonal")
    texts = rows.where(F.col("length") >= LONG)
    texts = texts.withColumn("_new", F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= GAP, 0).otherwise(1))
    texts = texts.withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = texts.groupBy(*KEY, "template", "label", "base", "length", "_group").agg(
        F.min(F.col("diagonal") + F.col("places")[0]).alias("start"), F.max(F.col("diagonal") + F.element_at("places", -1) + TEXT_K).alias("end"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"),
    )
    n = covered(F.col("places"), F.lit(TEXT_K))
    share = n / F.col("length")
    merged = merged.select(*KEY, "template", "label", "base", "start", "end", share.alias("cover"), ((share >= COVER) & (n >= COVER * (F.col("end") - F.col("start")))).alias("verified"))
    return phrases.unionByName(merged)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row; score is the largest share of a template that was found."""
    found = votes(docs, templates, id_col, text_col)
    found = found.withColumn("_copies", F.when(F.col("template") < 0, F.col("copies")))
    placed = spans(found.where(F.col("template") >= 0), templates)
    whole = found.where(F.col("template") < 0).select(*KEY, "n_words", "_copies")
    none = F.lit(None)
    rows = whole.select(*KEY, "n_words", "_copies", none.cast("long").alias("start"), none.cast("boolean").alias("base"), none.cast("string").alias("label"), F.lit(0.0).alias("cover"), F.lit(False).alias("verified"))
    rows = rows.unionByName(placed.select(*KEY, none.cast("long").alias("n_words"), none.cast("long").alias("_copies"), "start", "base", "label", "cover", "verified"))
    base = F.col("verified") & F.col("base")
    joined = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    out = rows.groupBy(*KEY).agg(
        F.max("n_words").alias("n_words"), F.max("_copies").alias("_copies"), F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("verified")).alias("labels"), F.round(F.max("cover"), 6).alias("score"),
    )
    out = out.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int"))))
    return out.select(F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
