"""License notices by diagonal voting.

Templates (phrases, notices and license paragraphs) are cut into word k-grams: k is 4, or 2 for
templates below ``SHORT`` words.  All rolling k-gram hashes of all documents are joined with the
template positions.  A hit of document word ``p`` with template word ``q`` votes for the diagonal
``p - q``, the place where the template would start.  Votes are counted by diagonal and
neighbouring diagonals (words put in or left out) are merged.  Each merged group is then
verified word by word: its hits, with the two words before and after each of them, are followed in
the order of the text.  A place ends when a template word comes again or the place is
longer than ``STRETCH`` allows, so that templates back to back are places of their own.  A
place counts if ``COVERAGE`` of the template's words are found in order, among them the words
that the template names as needed (so "licensed under the X license" is not taken for another
license).  Words are compared by their 64-bit hashes.

Base phrases must stand word for word: all their positions on one diagonal.

Template positions are broadcast up to ``MAX_POSITIONS`` of them; beyond that hits are found by a
shuffle join.  Texts are read once and never shuffled; one row per document and one per hit are.
A document with very many hits is spread by template and group of diagonals.

Defined cases: null or empty text has no words and no places; rows are told apart by a row
number that is written with the hits, so repeated rows give repeated rows; overlapping places
all count; a template without a word has no place; an empty table gives no rows.  That a word put
in changes the meaning of a notice is not understood.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathweave.llm.common import map_arrow, pick, shared_table
from pathweave.llm.textscan import ALNUM, Words, chunks, sequence_hash

K, K_SHORT, SHORT = 4, 2, 20   # words of a gram, also below SHORT words; shorter templates take all their words
SLACK = 3                    # diagonals that far apart belong together
COVERAGE = 0.8               # share of a template's words that must be found
STRETCH = 1.25               # a place may be that much longer than its template
AROUND = 2                   # words that are looked at on each side of a hit
MAX_POSITIONS = 200_000      # template positions that are broadcast, 40 bytes each

# The base phrases and their labels.
BASE_PHRASES = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]

# Public license notices and paragraphs, with SPDX-like labels and, for short ones, the words needed.
NOTICES = [
    ("Released under the MIT License", "mit", "mit"),
    ("Licensed under the MIT License", "mit", "mit"),
    ("Licensed under the Apache License, Version 2.0", "apache-2.0", "apache"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl-3.0", "general public 3"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc-4.0", "cc nc 4"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0",
     "creative commons attribution 4"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
     "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
     "to permit persons to whom the Software is furnished to do so", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met", "bsd"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
     "later version", "gpl-3.0"),
    ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
     "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", "apache-2.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2.0", "mozilla 2"),
]


def template_positions(templates: list[tuple], base: list[tuple[str, str]]) -> tuple[list, list]:
    """(gram, template, position) rows and (template, label, base, positions, k, words, needed positions) rows."""
    grams, about = [], []
    for t, (text, label, *needed) in enumerate([*base, *templates]):
        h = Words([text.encode()], ALNUM).hash
        k = min(K if t < len(base) or len(h) >= SHORT else K_SHORT, len(h))
        if not k:
            continue
        rows = [(sequence_hash(h[i:i + k]), t, i) for i in range(len(h) - k + 1)]
        grams += [(g - (1 << 64) if g >= 1 << 63 else g, t, i) for g, t, i in rows]
        must = set(Words([" ".join(needed).encode()], ALNUM).hash.tolist())
        about.append((t, label, t < len(base), len(rows), k, h.view(np.int64).tolist(), [i for i, x in enumerate(h.tolist()) if x in must]))
    return grams, about


def _grams(lengths: list[int]):
    """Texts -> all rolling grams (row, word, gram, words around), and one row with the number of words for each text."""
    def scan(batches):
        import pyarrow as pa

        names = ["row", "doc_id", "word", "gram", *(f"w{i}" for i in range(2 * AROUND))]
        none = [pa.nulls(0, pa.int64())] * (2 * AROUND)
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            for lo, hi in chunks(texts):
                words = Words(texts[lo:hi], ALNUM)
                empty = [pa.nulls(hi - lo, pa.int64())] * len(none)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(words.first)),
                     pa.nulls(hi - lo, pa.int64()), *empty], names=names)
                row = batch.column(0).to_numpy(zero_copy_only=False)[lo:hi]
                hashes = words.hash.view(np.int64)
                for k in lengths:
                    at, g = words.grams(k)
                    for a in range(0, len(at), 100_000):
                        i = at[a:a + 100_000]
                        doc = words.doc[i]
                        around = []
                        for step in [*range(-AROUND, 0), *range(k, k + AROUND)]:
                            j = np.clip(i + step, 0, len(hashes) - 1)
                            outside = (i + step != j) | (words.doc[j] != doc)
                            around.append(pa.array(hashes[j], mask=outside))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(row[doc]), pa.nulls(len(i), pa.int64()), pa.array(i - words.first[doc]),
                             pa.array(g[a:a + 100_000].view(np.int64)), *around], names=names)
    return scan


def _in_order(seen: dict[int, int]) -> dict[int, int]:
    """The most template words whose places in the text rise with them."""
    ends, rows, back = [], [], {}                                  # least last place of a run of each length, and its word
    for q in sorted(seen):
        i = bisect.bisect_left(ends, seen[q])
        ends[i:i + 1], rows[i:i + 1] = [seen[q]], [q]
        back[q] = rows[i - 1] if i else None
    out, q = {}, rows[-1]
    while q is not None:
        out[q], q = seen[q], back[q]
    return out


def places(hits: list[tuple], words: list[int], k: int, must: list[int]) -> list[tuple[int, int, float]]:
    """(start, stop, share of words found) of the places that hits (word, position, words around) of one template give."""
    longest, need = math.ceil(len(words) * STRETCH), COVERAGE * len(words) - 1e-9
    open_, done = [], []
    for word, at, *around in sorted(hits, key=lambda h: h[:2]):
        seen = {at + i: word + i for i in range(k)}
        for step, near in ((-1, around[AROUND - 1::-1]), (1, around[AROUND:])):
            q, p = (at, word) if step < 0 else (at + k - 1, word + k - 1)
            edge = q
            for far, h in enumerate(near, 1):                      # words of the text beside the hit, nearest first
                ahead = range(q + step, edge + step * (AROUND + 1), step)
                found = next((x for x in ahead if 0 <= x < len(words) and words[x] == h), None)
                if h is not None and found is not None:
                    q = found
                    seen[q] = p + step * far
        done += [o for o in open_ if o[2] + longest <= word]
        open_ = [o for o in open_ if o[2] + longest > word]
        fits = [o for o in open_ if at > o[0] and word > o[1] and abs(word - at - (o[1] - o[0])) <= SLACK and word + k - o[2] <= longest]
        if fits:
            best = min(reversed(fits), key=lambda o: abs(word - at - (o[1] - o[0])))
            best[0], best[1] = at, word
            best[3] = seen | best[3] | {at + i: word + i for i in range(k)}
        else:
            open_.append([at, word, word, seen])
    out = []
    for _, _, _, seen in done + open_:
        seen = _in_order(seen)
        start, stop = min(seen.values()), max(seen.values()) + 1
        if len(seen) >= need and stop - start <= longest and all(q in seen for q in must):
            out.append((start, stop, len(seen) / len(words)))
    return sorted(out)


def _verify(batches):
    """Groups of hits -> verified places."""
    import pyarrow as pa

    for batch in batches:
        out = []
        for g in batch.to_pylist():
            hits = [tuple(h.values()) for h in g["hits"]]
            out += [(g["row"], g["label"], False, a, b - a, s) for a, b, s in places(hits, g["words"], g["k"], g["must"])]
        types = [pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)],
                                         names=["row", "label", "base", "start", "n_span", "score"])


def license_spans(docs: DataFrame, templates=None, base=None) -> tuple[DataFrame, DataFrame]:
    """(one row per document: row, doc_id, n_words; verified spans: row, label, base, start, n_span, score)."""
    spark = docs.sparkSession
    grams, about = template_positions(NOTICES if templates is None else templates, BASE_PHRASES if base is None else base)
    positions = spark.createDataFrame(grams, "gram bigint, template int, at int")
    if len(grams) <= MAX_POSITIONS:
        positions = F.broadcast(positions)
    facts = spark.createDataFrame(about, "template int, label string, base boolean, n_at int, k int, words array<bigint>, must array<int>")
    lengths = sorted({a[4] for a in about})
    texts = pick(docs, doc_id="bigint", text="string").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    around = [f"w{i}" for i in range(2 * AROUND)]
    scanned = map_arrow(texts, _grams(lengths), "row bigint, doc_id bigint, word bigint, gram bigint, " + ", ".join(f"{w} bigint" for w in around))
    scanned = scanned.withColumn("key", F.coalesce("gram", F.xxhash64("row")))          # rows without a gram do not meet in one task
    same = (F.col("key") == F.col("p.gram")) & F.col("s.gram").isNotNull()
    found = (scanned.alias("s").join(positions.alias("p"), same, "left").filter("s.gram IS NULL OR p.template IS NOT NULL")
             .select("row", "doc_id", "word", "s.gram", *around, "template", F.col("at").cast("bigint").alias("at")))
    found = shared_table(found, "license-hits")

    rows = found.filter("gram IS NULL").select("row", "doc_id", F.col("word").alias("n_words"))
    hits = found.filter("gram IS NOT NULL").select("row", "template", "at", (F.col("word") - F.col("at")).alias("diagonal"),
                                                   F.struct("word", "at", *around).alias("hit"))
    is_base = F.col("template") < len(BASE_PHRASES if base is None else base)
    votes = hits.filter(is_base).groupBy("row", "template", "diagonal").agg(F.collect_set("at").alias("ats")).join(facts, "template")
    exact = votes.filter(F.size("ats") == F.col("n_at")).select(
        "row", "label", "base", F.col("diagonal").alias("start"), F.size("words").cast("bigint").alias("n_span"), F.lit(1.0).alias("score"))
    by_diagonal = Window.partitionBy("row", "template").orderBy("diagonal")
    far = (F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > SLACK).cast("int")
    votes = hits.filter(~is_base).groupBy("row", "template", "diagonal").agg(F.collect_list("hit").alias("hits"))
    merged = (votes.withColumn("far", F.coalesce(far, F.lit(0)))
              .withColumn("cluster", F.sum("far").over(by_diagonal.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy("row", "template", "cluster").agg(F.flatten(F.collect_list("hits")).alias("hits"))
              .join(facts, "template")
              .filter(F.size("hits") * (F.col("k") + 2 * AROUND) >= COVERAGE * F.size("words") - 1e-9))
    near = map_arrow(merged.select("row", "label", "k", "words", "must", "hits"), _verify,
                     "row bigint, label string, base boolean, start bigint, n_span bigint, score double")
    return rows, exact.unionByName(near)


def license_labels(docs: DataFrame, templates=None, base=None) -> DataFrame:
    """One row per document: n_words, the base places, all labels and the best score."""
    rows, spans = license_spans(docs, templates, base)
    starts = F.when(F.col("base"), F.col("start"))
    found = spans.groupBy("row").agg(
        F.count(starts).alias("n_base"), F.min(starts).alias("first_word"), F.max(starts).alias("last_word"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("base_labels"), F.collect_set("label").alias("labels"),
        F.max("score").alias("score"))
    joined = rows.join(found, "row", "left")

    def listed(name):
        return F.coalesce(F.array_join(F.array_sort(name), ","), F.lit("")).alias(name)

    return joined.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"), "first_word",
                         "last_word", listed("base_labels"), listed("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
