"""Licence scans by diagonal voting.

All rolling hashes of K words of every text are looked up among those of the templates, in the scan itself (the templates are fixed
text in this module, so their table has a bound), each hit's words are compared, and hits are joined in Spark to the template positions. A hit
votes for the diagonal template position - word position of its template; votes are summed by (document, template, diagonal).
Diagonals at most GAP apart (more for long templates) whose words lie near each other are merged into one span, which is how insertions and
deletions inside a notice are bridged. A span is verified by the share of its template's windows that it covers.

Base labels come from fixed phrases whose words stand consecutively, whatever the templates say.

Defined results: a null or empty text has no words, null first and last words, empty labels and score 0; offsets count words from 0;
repeated rows are separate documents with equal results; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .scratch import Scratch, map_batches

K, GAP, NEAR = 3, 3, 40
#: Longer templates allow for longer insertions: a diagonal apart for each so many windows
GAP_SHARE = 2
#: Share of a template's windows that a span must hold
COVER = 0.6
#: Score of a text with a base phrase but no verified template
BASE_SCORE = 0.5

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notices in common use and their labels.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "Copyright. All rights reserved"),
]


def _template_windows() -> list[tuple[int, int, int, bytes]]:
    """(template, position, hash as a signed number, words)."""
    out = []
    for w in tv.words(pa.array([t for _, t in TEMPLATES]), tv.ALNUM):
        i, h = tv.windows(w, K)
        out += [(int(w.row[a]) + w.first, int(a - w.at[w.row[a]]), int(x), w.text(a, K)) for a, x in zip(i, h.view(np.int64), strict=True)]
    return out


def _phrase_hashes() -> list[tuple[int, np.uint64, bytes, str]]:
    out = []
    for w in tv.words(pa.array(list(PHRASES)), tv.ALNUM):
        for r, label in enumerate(PHRASES.values()):
            n = int(w.at[r + 1] - w.at[r])
            out.append((n, tv.mix(tv.combine(w.hash, w.at[r : r + 1], n))[0], w.text(int(w.at[r]), n), label))
    return out


SCANNED = "_row long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, hits array<struct<pos:long,h:long>>"


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Base results, and the verified hits, of each document."""
    chosen = docs.select("_row", F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, known = _phrase_hashes(), {}
        for _, _, h, text in _template_windows():
            known.setdefault(h, set()).add(text)
        table = np.array(sorted(known), np.int64)
        for b in batches:
            n_words, n_base, first, last, labels, hits = [], [], [], [], [], []
            for w in tv.words(b.column(2), tv.ALNUM):
                rows = w.last - w.first
                places: list[list[int]] = [[] for _ in range(rows)]
                names: list[set[str]] = [set() for _ in range(rows)]
                found: list[list[dict]] = [[] for _ in range(rows)]
                by_size = {n: tv.windows(w, n) for n in {p[0] for p in phrases} | {K}}
                for n, h, text, label in phrases:
                    i, x = by_size[n]
                    for a in i[x == h].tolist():
                        if w.text(a, n) == text:
                            places[w.row[a]].append(int(a - w.at[w.row[a]]))
                            names[w.row[a]].add(label)
                i, x = by_size[K]
                x = x.view(np.int64)
                hit = np.flatnonzero(table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x)
                for a, h in zip(i[hit].tolist(), x[hit].tolist(), strict=True):
                    if w.text(a, K) in known[h]:
                        found[w.row[a]].append({"pos": int(a - w.at[w.row[a]]), "h": h})
                n_words += np.diff(w.at).tolist()
                n_base += map(len, places)
                first += [min(p, default=None) for p in places]
                last += [max(p, default=None) for p in places]
                labels += map(sorted, names)
                hits += found
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string()), pa.list_(pa.struct([("pos", pa.int64()), ("h", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), *(pa.array(v, t) for v, t in zip((n_words, n_base, first, last, labels, hits), kinds, strict=True))], names=["_id", "_row", "n_words", "n_base", "first_word", "last_word", "base_labels", "hits"])

    return map_batches(chosen, run, f"_id {chosen.schema['_id'].dataType.simpleString()}, {SCANNED}")


def spans(found: DataFrame) -> DataFrame:
    """_row, label, start, end (words), cover: verified spans."""
    spark = found.sparkSession
    windows = _template_windows()
    total = {t: sum(w[0] == t for w in windows) for t in range(len(TEMPLATES))}
    places = spark.createDataFrame([(h, t, p, total[t]) for t, p, h, _ in windows], "h long, template int, at int, total int")
    votes = found.where(F.size("hits") > 0).select("_row", F.explode("hits").alias("x")).select("_row", "x.pos", "x.h").join(F.broadcast(places), "h")
    votes = votes.withColumn("diagonal", F.col("at") - F.col("pos"))
    # a diagonal can be long where a notice is repeated: it is cut where its words are far apart
    line = Window.partitionBy("_row", "template", "diagonal").orderBy("pos")
    votes = votes.withColumn("part", F.sum(F.when(F.col("pos") - F.lag("pos").over(line) > NEAR, 1).otherwise(0)).over(line))
    runs = votes.groupBy("_row", "template", "diagonal", "part").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.collect_set("at").alias("at"), F.first("total").alias("total"))
    near = Window.partitionBy("_row", "template").orderBy("a", "diagonal")
    reach = F.max("b").over(near.rowsBetween(Window.unboundedPreceding, -1))  # a short run may lie inside a long one
    apart = (F.abs(F.col("diagonal") - F.lag("diagonal").over(near)) > F.greatest(F.lit(GAP), F.floor(F.col("total") / GAP_SHARE))) | (F.col("a") - reach > NEAR)
    merged = runs.withColumn("span", F.sum(F.when(apart, 1).otherwise(0)).over(near)).groupBy("_row", "template", "span").agg(F.min("a").alias("start"), (F.max("b") + K).alias("end"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.first("total").alias("total"))
    labels = F.element_at(F.array(*(F.lit(x) for x, _ in TEMPLATES)), F.col("template") + 1)
    return merged.select("_row", labels.alias("label"), "start", "end", (F.size("at") / F.col("total")).alias("cover")).where(F.col("cover") >= COVER)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.put("scanned", scanned(scratch.numbered_once(docs), id_col, text_col))
    extra = spans(found).groupBy("_row").agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"), F.count(F.lit(1)).alias("n_spans"))
    out = found.drop("hits").join(extra, "_row", "left")
    every = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    base = F.when(F.col("n_base") > 0, BASE_SCORE).otherwise(0.0)
    return out.select(
        F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.greatest(F.coalesce("cover", F.lit(0.0)), base).alias("score"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
    )
