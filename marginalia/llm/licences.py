"""Operator 3: licences of files by sparse TF-IDF cosine to templates, and of the rest by their directories."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import licence_texts, scratch
from .text import _SPACE, blocks, flat, mix, shingles, words

#: Short notices as authors put them at the head or the end of files, written for this table.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the software without restriction."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Licensed under the BSD 3-Clause License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and modify it under the terms of the GNU General Public License."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "MPL-2.0": ["This source code form is subject to the terms of the Mozilla Public License, version 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "Proprietary": ["Copyright, all rights reserved.", "All rights reserved. No part of this work may be copied without permission."],
}
LEAST = 0.6
#: Short notices that hold for whole lines as they stand; without case and punctuation they count only where they are wrapped.
AS_THEY_STAND = "Proprietary"
#: ASCII letters made small, and of other ASCII bytes only digits kept, so that the marks of comments fall away as well.
_PLAIN = np.array([b if b >= 128 or chr(b).isalnum() and not chr(b).isupper() else ord(chr(b).lower()) if chr(b).isupper() else 32 for b in range(256)], np.uint8)
_MARK = np.isin(np.arange(256), list(b"#/*;%!<-"))
#: Licences of directories that are broadcast.
BROADCAST_DIRECTORIES = 200_000


def weights(templates: dict[str, list[str]]) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Names by template; hashes of the words of all templates, sorted; a unit vector of each template over them; the weight of any other word.

    A word's inverse document frequency is ln((1 + T) / (1 + d)) + 1, where d of the T
    templates have it; a word of no template has d = 0.
    """
    names = [n for n in sorted(templates) for _ in templates[n]]
    texts = [t for n in sorted(templates) for t in templates[n]]
    at, raw = flat(pa.array(texts, pa.large_string()))
    starts, _, hashes = words(raw, at)
    row = np.searchsorted(at, starts, side="right") - 1
    known = np.unique(hashes)
    tf = np.zeros((len(texts), len(known)))
    np.add.at(tf, (row, np.searchsorted(known, hashes)), 1)
    idf = np.log((1 + len(texts)) / (1 + (tf > 0).sum(0))) + 1
    table = tf * idf
    return names, known, np.vstack([table / np.sqrt((table**2).sum(1))[:, None] * 1.0, idf[None, :]]), math.log(1 + len(texts)) + 1


def scores(at: np.ndarray, raw: np.ndarray, low: int, high: int, model: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each line with words of a template in rows low to high: its row, its best template, and the cosine."""
    _, known, table, other = model
    data, cuts = raw[at[low] : at[high]], at[low : high + 1] - at[low]
    starts, _, hashes = words(data, cuts)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    ends = np.flatnonzero(data == 10) + 1
    begins = np.union1d(cuts[:-1][np.diff(cuts) > 0], ends[ends < len(data)])
    line = np.searchsorted(begins, starts, side="right") - 1
    slot = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    hit = known[slot] == hashes
    idf = table[-1]
    # A line can reach a cosine only through words of templates: the share of its weight in them bounds it.
    order = np.lexsort((hashes, line))
    line, hashes, slot, hit = line[order], hashes[order], slot[order], hit[order]
    head = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (hashes[1:] != hashes[:-1])))
    tf = np.diff(np.append(head, len(line)))
    line, slot, hit = line[head], slot[head], hit[head]
    weight = tf * np.where(hit, idf[slot], other)
    norm = np.sqrt(np.bincount(line, weight**2, minlength=len(begins)))
    inside = np.sqrt(np.bincount(line[hit], weight[hit] ** 2, minlength=len(begins)))
    chosen = (inside >= 0.3 * norm) & (norm > 0)
    use = hit & chosen[line]
    lines, index = np.unique(line[use], return_inverse=True)
    dots = np.zeros((len(lines), len(table) - 1))
    np.add.at(dots, index, weight[use, None] * table[:-1, slot[use]].T)
    cosine = dots / norm[lines, None]
    best = cosine.argmax(1) if len(lines) else np.zeros(0, np.int64)
    return np.searchsorted(cuts, begins[lines], side="right") - 1 + low, best, cosine[np.arange(len(lines)), best]


def pairs_of_words(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every two words that follow each other in each part, and which part each is of."""
    terms, at = shingles(hashes, bounds, 2)
    return terms, np.repeat(np.arange(len(bounds) - 1), np.diff(at))


def text_weights(templates: dict[str, list[str]]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, float, np.ndarray]:
    """As weights, over pairs of words without case and punctuation; the frequencies apart, and which templates count only for several lines."""
    short = {n: TEMPLATES.get(n, []) + templates.get(n, []) for n in {*TEMPLATES, *templates}}
    names = [n for n in sorted(short) for _ in short[n]]
    at, raw = flat(pa.array([t for n in sorted(short) for t in short[n]], pa.large_string()))
    starts, _, hashes = words(_PLAIN[raw], at)
    terms, row = pairs_of_words(hashes, np.searchsorted(starts, at))
    known = np.unique(terms)
    tf = np.zeros((len(names), len(known)))
    np.add.at(tf, (row, np.searchsorted(known, terms)), 1)
    idf = np.log((1 + len(names)) / (1 + (tf > 0).sum(0))) + 1
    table = tf * idf
    return names, known, table / np.sqrt((table**2).sum(1))[:, None], idf, math.log(1 + len(names)) + 1, np.array([n == AS_THEY_STAND for n in names])


def part_scores(hashes: np.ndarray, bounds: np.ndarray, several: np.ndarray, model: tuple, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each part of the words that reaches `least`: which it is, its best template, and the cosine."""
    _, known, table, idf, other, wrapped = model
    terms, part = pairs_of_words(hashes, bounds)
    slot = np.minimum(np.searchsorted(known, terms), len(known) - 1)
    hit = known[slot] == terms
    pair, tf = np.unique(part[hit] * len(known) + slot[hit], return_counts=True)
    inside = np.bincount(pair // len(known), (tf * idf[pair % len(known)]) ** 2, minlength=len(several))
    outside = np.bincount(part[~hit], minlength=len(several)) * other**2  # each unknown term has this much of the norm at least
    live = (inside > 0) & (inside >= least**2 * (inside + outside) * (1 - 1e-9))
    lost = ~hit & live[part]
    order = np.lexsort((terms[lost], part[lost]))
    where, what = part[lost][order], terms[lost][order]
    head = np.flatnonzero(np.append(True, (where[1:] != where[:-1]) | (what[1:] != what[:-1]))) if len(where) else np.zeros(0, np.int64)
    outside = np.bincount(where[head], (np.diff(np.append(head, len(where))) * other) ** 2, minlength=len(several))
    own, tf = pair[live[pair // len(known)]], tf[live[pair // len(known)]]
    parts, index = np.unique(own // len(known), return_inverse=True)
    dots = np.zeros((len(parts), len(table)))
    np.add.at(dots, index, (tf * idf[own % len(known)])[:, None] * table[:, own % len(known)].T)
    cosine = dots / np.sqrt(inside + outside)[parts, None]
    cosine[np.ix_(~several[parts], wrapped)] = 0
    best = cosine.argmax(1) if len(parts) else np.zeros(0, np.int64)
    value = cosine[np.arange(len(parts)), best]
    good = value >= least
    return parts[good], best[good], np.minimum(value[good], 1.0)


def whole_scores(at: np.ndarray, raw: np.ndarray, low: int, high: int, model: tuple, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As scores, for paragraphs, for headers (lines with a comment's mark, one after the other) and for whole texts."""
    data, cuts = raw[at[low] : at[high]], at[low : high + 1] - at[low]
    starts, _, hashes = words(_PLAIN[data], cuts)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    ends = np.flatnonzero(data == 10) + 1
    begins = np.union1d(cuts[:-1][np.diff(cuts) > 0], ends[ends < len(data)])
    first = np.flatnonzero(~_SPACE[data])
    lead = first[np.minimum(np.searchsorted(first, begins), len(first) - 1)]
    marked = _MARK[data[lead]] & (lead >= begins) & (lead < np.append(begins[1:], len(data)))
    row = np.searchsorted(cuts, begins, side="right") - 1
    line = np.searchsorted(begins, starts, side="right") - 1
    worded = np.bincount(line, minlength=len(begins)) > 0
    found = []
    for inside, kind in ((worded, marked), (marked, marked), (np.ones(len(begins), bool), np.zeros(len(begins), bool))):
        # A part goes on where a line follows one of its row and its kind that are both inside.
        goes_on = np.append(False, inside[1:] & inside[:-1] & (kind[1:] == kind[:-1]) & (row[1:] == row[:-1]))
        part = np.cumsum(~goes_on) - 1
        of, used = part[line], inside[line]
        own, bounds = np.unique(of[used], return_index=True)
        if not len(own):
            continue
        several = np.bincount(part[worded], minlength=part[-1] + 1)[own] > 1
        got, best, value = part_scores(hashes[used], np.append(bounds, used.sum()), several, model, least)
        head = np.flatnonzero(~goes_on)
        found.append((row[head[own[got]]] + low, best, value))
    return tuple(np.concatenate(c) for c in zip(*found))


def own_licences(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """`files` (path, text, doc_id) with the licence that the text names, and its cosine; both null where nothing in it reaches `least`.

    Every line of every text is held against every template, word by word as it stands.
    Paragraphs, headers in comments and the whole text are held against these, headers and
    whole licences (licence_texts), by pairs of words without case and punctuation.  The
    greatest cosine counts; of equal ones a line's, then the first in the order of templates.
    """
    model = weights(templates)
    shared = files.sparkSession.sparkContext.broadcast(text_weights(licence_texts.texts()))
    if least < 0.3:
        raise ValueError("lines of which templates' words make less than 0.3 of the weight aren't compared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, raw = flat(batch.column("text"))
            best = np.full(batch.num_rows, -1)
            cosine = np.zeros(batch.num_rows)
            for low, high in blocks(at):
                row, template, value = scores(at, raw, low, high, model)
                order = np.lexsort((template, -np.round(value, 12), row))
                row, template, value = row[order], template[order], value[order]
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
                good = first[value[first] >= least]
                best[row[good]], cosine[row[good]] = template[good], value[good]
                row, template, value = whole_scores(at, raw, low, high, shared.value, least)
                order = np.lexsort((template, -np.round(value, 12), row))
                row, template, value = row[order], template[order], value[order]
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
                more = first[np.round(value[first], 12) > np.round(cosine[row[first]], 12)]
                best[row[more]], cosine[row[more]] = len(model[0]) + template[more], value[more]
            every = model[0] + shared.value[0]
            names = pa.array([every[b] if b >= 0 else None for b in best], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("path"), names, pa.array(cosine, mask=best < 0)], ["doc_id", "path", "licence", "cosine"])

    return files.select("doc_id", "path", "text").mapInArrow(run, "doc_id long, path string, licence string, cosine double")


def inherited(scanned: DataFrame, name: str = r"(?i)(^|/)(licen[cs]e|copying)([-._][^/]*)?$") -> DataFrame:
    """Adds `effective` and `from_dir`: a file's own licence, or else that of the licence file in its nearest ancestor directory.

    Licence files are those whose path matches `name` and that have a licence of their own;
    of several in one directory the greatest cosine counts, then the least path.  The root
    directory is the empty string.  Directories meet by joins on their paths, once for each
    directory, not for each file.
    """
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    files = scanned.withColumn("dir", F.coalesce(parent, F.lit("")))
    best = F.min_by("licence", F.struct(-F.round("cosine", 12), F.col("path")))
    owners = scratch.written(files.where(F.col("path").rlike(name) & F.col("licence").isNotNull()).groupBy("dir").agg(best.alias("found")), "owners").withColumnRenamed("dir", "owner")
    parts = F.split("dir", "/")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(parts))
    up = files.select("dir").distinct().withColumn("depth", F.explode(F.sequence(F.lit(0), depth))).withColumn("ancestor", F.concat_ws("/", F.slice(parts, 1, F.col("depth"))))
    small = owners.count() <= BROADCAST_DIRECTORIES
    near = up.join(F.broadcast(owners) if small else owners, F.col("ancestor") == F.col("owner")).groupBy("dir").agg(F.max_by(F.struct("found", "owner"), "depth").alias("near"))
    near = scratch.written(near, "near").withColumnRenamed("dir", "at")
    small = near.count() <= BROADCAST_DIRECTORIES
    joined = files.join(F.broadcast(near) if small else near, F.col("dir") == F.col("at"), "left")
    return joined.select("doc_id", "path", "licence", "cosine", F.coalesce("licence", "near.found").alias("effective"), F.when(F.col("licence").isNull(), F.col("near.owner")).alias("from_dir"))


def licences(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """The licence of every file: (doc_id, path, licence, cosine, effective, from_dir).

    files: (doc_id, path, text); other columns are ignored.  A null or empty text names no
    licence; a null path is in the root directory and is no licence file.  Repeated rows are
    judged alike and stay.  An empty table gives no rows.
    """
    return inherited(scratch.written(own_licences(files, templates, least), "scanned"))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree by source, language and ranges of 200 ids; of those with a notice, every other is a licence file: of its directory, or, every eighth, of its source."""
    folder = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 200).cast("string"))
    notice = F.col("text").rlike("licensed under|Licensed under|License")
    file = F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))
    path = (
        F.when(notice & (F.col("doc_id") % 8 == 0), F.concat_ws("/", "source", file))
        .when(notice & (F.col("doc_id") % 2 == 0), F.concat_ws("/", folder, file))
        .otherwise(F.concat_ws("/", folder, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    )
    return docs.select("doc_id", "text", path.alias("path"))


def sql() -> str:
    """The licences of document_files, in SQL; cosines rounded to 6 places."""
    values = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate((n, t) for n in sorted(TEMPLATES) for t in TEMPLATES[n]))
    count = sum(map(len, TEMPLATES.values()))
    split = "list_filter(regexp_split_to_array({}, '[ \\t\\r\\f\\x0b]+'), lambda x: x <> '')"
    return f"""
WITH t(id, name, text) AS (VALUES {values}
), tw AS (SELECT id, w, count(*) AS tf FROM (SELECT id, unnest({split.format("text")}) AS w FROM t) GROUP BY ALL
), idf AS (SELECT w, ln({1 + count} / (1.0 + count(*))) + 1 AS idf FROM tw GROUP BY w
), tv AS (SELECT id, w, tf * idf AS v FROM tw JOIN idf USING (w)
), tn AS (SELECT id, w, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM tv
), files AS (
  SELECT doc_id, text, source || '/' || lang || '/' || CAST(doc_id // 200 AS VARCHAR) AS folder, source,
    regexp_matches(text, 'licensed under|Licensed under|License') AS notice FROM documents
), paths AS (
  SELECT doc_id, text, CASE WHEN notice AND doc_id % 8 = 0 THEN source || '/LICENSE-' || doc_id WHEN notice AND doc_id % 2 = 0 THEN folder || '/LICENSE-' || doc_id
    ELSE folder || '/' || doc_id || '.txt' END AS path FROM files
), lines AS (SELECT doc_id, unnest(range(0, len(p))) AS k, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)
), lw AS (SELECT doc_id, k, w, count(*) AS tf FROM (SELECT doc_id, k, unnest({split.format("line")}) AS w FROM lines) GROUP BY ALL
), lv AS (SELECT doc_id, k, w, tf * coalesce(idf, ln({1 + count}.0) + 1) AS v FROM lw LEFT JOIN idf USING (w)
), norms AS (SELECT doc_id, k, sqrt(sum(v * v)) AS n FROM lv GROUP BY ALL
), dots AS (SELECT doc_id, k, id, sum(lv.v * tn.v) AS d FROM lv JOIN tn USING (w) GROUP BY ALL
), best AS (
  SELECT doc_id, id, d / n AS cosine FROM dots JOIN norms USING (doc_id, k) WHERE d / n >= {LEAST}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(d / n, 12) DESC, id) = 1
), scanned AS (
  SELECT p.doc_id, path, name AS licence, cosine, regexp_replace(path, '/[^/]*$', '') AS dir FROM paths p LEFT JOIN best USING (doc_id) LEFT JOIN t USING (id)
), owners AS (
  SELECT dir AS owner, licence AS found FROM scanned WHERE licence IS NOT NULL AND regexp_matches(path, '/LICENSE-')
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY round(cosine, 12) DESC, path) = 1
), near AS (
  SELECT dir, owner, found FROM (SELECT DISTINCT dir FROM scanned) JOIN owners ON dir = owner OR starts_with(dir, owner || '/')
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(owner) DESC) = 1
)
SELECT doc_id, path, licence, round(cosine, 6) AS cosine, coalesce(licence, found) AS effective, CASE WHEN licence IS NULL THEN owner END AS from_dir
FROM scanned LEFT JOIN near USING (dir)
"""
