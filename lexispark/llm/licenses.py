"""License scans: an exact set-similarity join of text blocks with license templates by containment.

A template is the set of its distinct words.  A text block belongs to it when at least `percent` % of the template's words
stand in the block.  Blocks follow from the template's length, so that a match is a passage and no chance gathering:
statements of up to 32 words are compared with lines, longer texts with paragraphs (runs of lines with words).  A block
of more than two steps of words is compared in windows of two steps that begin every step, and a step is no shorter than
the template; every passage as long as the template lies whole in some window.

The join.  `token_counts` counts the templates' words over all documents; words are ordered from rare to frequent.  If a
block has t of a template's n words, one of the n - t + 1 rarest is among them (prefix filter), so only these words open
a candidate.  A candidate needs a block of t words that any template has (length filter) and, from the opening word on, t
words left in the order on both sides (positional filter).  Each candidate's overlap is then counted.  All filters are
necessary conditions: the result is every block that meets the threshold.

The templates travel to the tasks in parts of at most `part_bytes` of text; the scan is narrow, documents are never
shuffled.

Defined results: null and empty texts have no words, no places, no blocks and score 0; each row gets one result, repeated
or null ids included; a template without words matches nothing, repeated templates count once; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import words as W
from lexispark.llm.storage import small_batches

PERCENT = 85
LINE_WORDS, PARAGRAPH_WORDS = 32, 256
PART_BYTES = 4 << 20
WORD_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Phrases whose consecutive words count, and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Statements and opening words of common licenses.
TEMPLATES = (
    ("gpl-statement", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("apache-statement", "Licensed under the Apache License, Version 2.0."),
    ("apache-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit-statement", "Released under the MIT License."),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense-text", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc-by-nc-statement", "Licensed under CC BY-NC 4.0."),
    ("cc-by-statement", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-statement", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced, distributed or transmitted in any form or by any means without the prior written permission of the publisher."),
)

PLACE = "struct<label:string,at:int>"
BLOCK = "struct<label:string,first:int,last:int,overlap:int,size:int>"


def split(text: str | None) -> list[str]:
    return re.findall(WORD_RE, (text or "").translate(LOWER))


def step_of(n_words: int) -> tuple[int, int]:
    """(blank lines that end a block, step) for a template of `n_words`: lines end at any line break, paragraphs at a
    line without words."""
    return (0, LINE_WORDS) if n_words <= LINE_WORDS else (1, max(PARAGRAPH_WORDS, 1 << (n_words - 1).bit_length()))


def needed(size: int, percent: int) -> int:
    return -(-percent * size // 100)


def hashes(words: list[str]) -> np.ndarray:
    """The words' hashes as `words.words` gives them; every word is a document of its own."""
    parts = [W.words(s, W.ALPHANUMERIC).hash for s in W.slices(pa.array(words, pa.string()))] if words else []
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


class Lookup:
    """Known words by hash."""

    def __init__(self, known: list[str]):
        h = hashes(known)
        self.rank = np.argsort(h)
        self.sorted = h[self.rank]

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices of known words, their ranks)."""
        if not len(self.sorted):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        k = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        at = np.flatnonzero(self.sorted[k] == h)
        return at, self.rank[k[at]]


def expand(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, place in the group) of each element of consecutive groups of these lengths."""
    group = np.repeat(np.arange(len(lengths)), lengths)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


class Join:
    """Templates of one kind of block, their words ranked from rare to frequent, and the index of their prefixes."""

    def __init__(self, templates: list[tuple[str, list[str]]], counts: dict[str, int], percent: int, gap: int, step: int):
        self.gap, self.step = gap, step
        vocabulary = sorted({w for _, words in templates for w in words}, key=lambda w: (counts.get(w, 0), w))
        rank = {w: k for k, w in enumerate(vocabulary)}
        self.lookup, self.width = Lookup(vocabulary), len(vocabulary)
        self.labels = [label for label, _ in templates]
        sets = [sorted({rank[w] for w in words}) for _, words in templates]
        self.size = np.array([len(s) for s in sets], np.int64)
        self.need = np.array([needed(len(s), percent) for s in sets], np.int64)
        self.members = np.array([t * self.width + r for t, s in enumerate(sets) for r in s], np.int64)  # ascending
        openings = []
        for t, s in enumerate(sets):
            openings += [(r, t, p) for p, r in enumerate(s[: len(s) - int(self.need[t]) + 1])]
        index = np.array(sorted(openings), np.int64).reshape(-1, 3)
        self.opens, self.place = index[:, 1], index[:, 2]
        self.first = np.searchsorted(index[:, 0], np.arange(self.width + 1))

    def has(self, template: np.ndarray, rank: np.ndarray) -> np.ndarray:
        code = template * self.width + rank
        return self.members[np.minimum(np.searchsorted(self.members, code), len(self.members) - 1)] == code

    def matches(self, w: W.Words, line: np.ndarray) -> tuple[np.ndarray, ...]:
        """Blocks that meet a template: arrays of document, template, first and last word (counted in the slice) of the
        template's words in the block, overlap."""
        none = tuple(np.empty(0, np.int64) for _ in range(5))
        known, rank = self.lookup(w.hash)
        if not len(known):
            return none
        fresh = np.ones(len(w.hash), bool)
        fresh[1:] = (w.doc[1:] != w.doc[:-1]) | (line[1:] - line[:-1] > self.gap)
        block = np.cumsum(fresh) - 1
        at = (np.arange(len(w.hash)) - np.flatnonzero(fresh)[block])[known] // self.step
        block = block[known]
        # a word is in the window that begins in its step, and in the one before
        again = np.flatnonzero(at > 0)
        many = int(at.max()) + 1
        key = np.concatenate((block * many + at, block[again] * many + at[again] - 1))
        word, rank = np.concatenate((known, known[again])), np.concatenate((rank, rank[again]))
        pairs = np.unique(key * self.width + rank)  # the sets, each from rare to frequent
        windows, begin, size = np.unique(pairs // self.width, return_index=True, return_counts=True)
        set_rank = pairs % self.width
        window, place = expand(size)
        # candidates: prefix, length and positional filter
        source, k = expand(self.first[set_rank + 1] - self.first[set_rank])
        k += self.first[set_rank[source]]
        template, window, place = self.opens[k], window[source], place[source]
        need = self.need[template]
        keep = (size[window] >= need) & (np.minimum(self.size[template] - self.place[k], size[window] - place) >= need)
        candidates = np.unique(window[keep] * len(self.labels) + template[keep])
        window, template = candidates // len(self.labels), candidates % len(self.labels)
        # verification
        if not len(window):
            return none
        pair, j = expand(size[window])
        both = self.has(template[pair], set_rank[begin[window][pair] + j])
        overlap = np.bincount(pair, both, len(window)).astype(np.int64)
        keep = overlap >= self.need[template]
        window, template, overlap = window[keep], template[keep], overlap[keep]
        if not len(window):
            return none
        # where the template's words stand
        order = np.argsort(key, kind="stable")
        key, word, rank = key[order], word[order], rank[order]
        low, high = np.searchsorted(key, windows[window]), np.searchsorted(key, windows[window], "right")
        pair, j = expand(high - low)
        j += low[pair]
        own = self.has(template[pair], rank[j])
        pair, j = pair[own], word[j[own]]
        edge = np.searchsorted(pair, np.arange(len(window)))
        return w.doc[np.minimum.reduceat(j, edge)], template, np.minimum.reduceat(j, edge), np.maximum.reduceat(j, edge), overlap


def joins(templates: list[tuple[str, str]], counts: dict[str, int], percent: int) -> list[Join]:
    by_kind: dict[tuple[int, int], list[tuple[str, list[str]]]] = {}
    for label, text in templates:
        if words := split(text):
            by_kind.setdefault(step_of(len(words)), []).append((label, words))
    return [Join(own, counts, percent, *kind) for kind, own in sorted(by_kind.items())]


def phrase_places(w: W.Words, phrases: list[tuple[np.ndarray, str]]) -> list[tuple[int, int, str]]:
    """(document, word in the slice, label) of every place where a phrase's words stand consecutively."""
    found = []
    for h, label in phrases:
        n = len(w.hash) - len(h) + 1
        if n <= 0:
            continue
        at = np.flatnonzero(w.hash[:n] == h[0])
        for j in range(1, len(h)):
            at = at[w.hash[at + j] == h[j]]
        at = at[w.doc[at] == w.doc[at + len(h) - 1]]
        found += [(int(w.doc[i]), int(i), label) for i in at]
    return sorted(found)


def _lists(docs: np.ndarray, n: int, values: pa.StructArray) -> pa.ListArray:
    """One list for each of `n` documents; the values come in the order of their documents."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(docs, np.arange(n + 1)), pa.int32()), values)


def _scan(tables: list[Join], phrases: tuple[tuple[str, str], ...], text_kept: bool):
    int32 = lambda a: pa.array(np.asarray(a, np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = [(hashes(split(phrase)), label) for phrase, label in phrases]
        labels = np.array([label for t in tables for label in t.labels] or [""], object)
        sizes = np.concatenate([np.empty(0, np.int64), *[t.size for t in tables]])
        base = np.cumsum([0, *[len(t.labels) for t in tables]])
        for batch in batches:
            for s in W.slices(batch.column(1)):
                w = W.words(s, W.ALPHANUMERIC)
                n, first = s.hi - s.lo, w.first
                line = np.searchsorted(np.flatnonzero(s.data == 10), w.start)
                places = phrase_places(w, sought)
                doc = np.array([p[0] for p in places], np.int64)
                here = [int32([p[1] - first[p[0]] for p in places])]
                place_lists = _lists(doc, n, pa.StructArray.from_arrays([pa.array([p[2] for p in places], pa.string()), *here], ["label", "at"]))
                found = [(m[0], m[1] + base[k], *m[2:]) for k, t in enumerate(tables) for m in [t.matches(w, line)]]
                doc, template, low, high, overlap = (np.concatenate([np.empty(0, np.int64), *[f[i] for f in found]]) for i in range(5))
                order = np.lexsort((high, low, template, doc))
                doc, template, low, high, overlap = doc[order], template[order], low[order], high[order], overlap[order]
                fields = [pa.array(labels[template], pa.string()), int32(low - first[doc]), int32(high - first[doc]), int32(overlap), int32(sizes[template])]
                block_lists = _lists(doc, n, pa.StructArray.from_arrays(fields, ["label", "first", "last", "overlap", "size"]))
                own = batch.slice(s.lo, n)
                if batch.num_columns > 2:  # what earlier parts of the templates gave
                    earlier = own.column("blocks").to_pylist()
                    block_lists = pa.array([a + b for a, b in zip(earlier, block_lists.to_pylist(), strict=True)], block_lists.type)
                    place_lists = own.column("places")
                kept = [own.column(0), *([own.column(1)] if text_kept else [])]
                names = ["doc_id", *(["text"] if text_kept else []), "n_words", "places", "blocks"]
                yield pa.record_batch([*kept, pa.array(w.per_doc, pa.int64()), place_lists, block_lists], names=names)

    return run


def token_counts(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """How often each of the given words stands in all documents.  As many rows as words reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, total = Lookup(vocabulary), np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for s in W.slices(batch.column(0)):
                total += np.bincount(lookup(W.words(s, W.ALPHANUMERIC).hash)[1], minlength=len(vocabulary))
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["word", "n"])

    counted = docs.select(text_col).mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {vocabulary[r["word"]]: r["n"] for r in counted.collect()}


def parts(templates: list[tuple[str, str]], part_bytes: int) -> list[list[tuple[str, str]]]:
    out: list[list[tuple[str, str]]] = [[]]
    size = 0
    for label, text in templates:
        if out[-1] and size + len(text.encode()) > part_bytes:
            out.append([])
            size = 0
        out[-1].append((label, text))
        size += len(text.encode())
    return out


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, places (label and first word of each phrase's place, in order), blocks (label,
    first and last of the template's words in the block, overlap, the template's size) of every block that has `percent` %
    of a template's words."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be over 0 and at most 100")
    small_batches(docs.sparkSession)
    templates = list(dict.fromkeys((label, text) for label, text in templates if split(text)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = token_counts(rows, sorted({w for _, text in templates for w in split(text)})) if templates else {}
    kind = rows.schema["doc_id"].dataType.simpleString()
    result = f"n_words long, places array<{PLACE}>, blocks array<{BLOCK}>"
    own = parts(templates, part_bytes)
    for k, part in enumerate(own):
        more = k + 1 < len(own)
        rows = rows.mapInArrow(_scan(joins(part, counts, percent), tuple(phrases), more), f"doc_id {kind}, " + ("text string, " if more else "") + result)
    return rows


def op12_license_scan(spark, sf_dir: str) -> DataFrame:
    found = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    share = F.array_max(F.transform("blocks", lambda b: b["overlap"] / b["size"]))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.at").cast("long").alias("first_word"), F.array_max("places.at").cast("long").alias("last_word"),
        joined(F.col("places.label")).alias("base_labels"), joined(F.concat("places.label", "blocks.label")).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(share, F.lit(0.0))).alias("score"),
    )


def _sql() -> str:
    """The same result by plain counting: all pairs of windows and templates that share a word."""
    values = ", ".join(
        f"('{label}', {step_of(len(split(text)))[0]}, {step_of(len(split(text)))[1]}, {len(set(split(text)))}, {needed(len(set(split(text))), PERCENT)}, '{w}')"
        for label, text in TEMPLATES for w in sorted(set(split(text)))
    )
    places = " UNION ALL ".join(
        f"SELECT r, g, '{label}' AS label FROM followed WHERE " + " AND ".join(f"{'w' if k == 0 else f'w{k}'} = '{w}'" for k, w in enumerate(split(phrase)))
        for phrase, label in PHRASES
    )
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)) AS lines FROM documents),
    lines AS (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS ln FROM d),
    split AS (SELECT r, ln, regexp_extract_all(line, '{WORD_RE}') AS ws FROM lines),
    filled AS (SELECT r, ln, ws, ln - row_number() OVER (PARTITION BY r ORDER BY ln) AS paragraph FROM split WHERE len(ws) > 0),
    words AS (SELECT r, ln, paragraph, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM filled),
    placed AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY ln, i) - 1 AS g, row_number() OVER (PARTITION BY r, paragraph ORDER BY ln, i) - 1 AS j FROM words),
    followed AS (SELECT r, g, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3 FROM placed WINDOW o AS (PARTITION BY r ORDER BY g)),
    places AS ({places}),
    template(label, kind, step, size, need, word) AS (VALUES {values}),
    met AS (SELECT p.r, t.label, t.kind, t.size, t.need, t.word, CASE WHEN t.kind = 0 THEN p.ln ELSE p.paragraph END AS block, (CASE WHEN t.kind = 0 THEN p.i ELSE p.j END) // t.step AS wn FROM placed p JOIN template t ON p.w = t.word),
    windows AS (SELECT * FROM met UNION ALL SELECT * REPLACE (wn - 1 AS wn) FROM met WHERE wn > 0),
    shared AS (SELECT r, label, size, count(DISTINCT word) AS overlap FROM windows GROUP BY r, label, kind, size, need, block, wn HAVING count(DISTINCT word) >= need),
    base AS (SELECT r, count(*) AS n_base, min(g) AS first_word, max(g) AS last_word FROM places GROUP BY r),
    base_names AS (SELECT r, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT r, label FROM places) GROUP BY r),
    names AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM places UNION SELECT r, label FROM shared) GROUP BY r),
    shares AS (SELECT r, max(overlap::DOUBLE / size) AS share FROM shared GROUP BY r),
    sizes AS (SELECT r, count(*) AS n_words FROM placed GROUP BY r)
    SELECT d.doc_id, coalesce(s.n_words, 0)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
        coalesce(m.base_labels, '') AS base_labels, coalesce(n.labels, '') AS labels, CASE WHEN b.n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(h.share, 0.0)::DOUBLE END AS score
    FROM d LEFT JOIN sizes s ON d.r = s.r LEFT JOIN base b ON d.r = b.r LEFT JOIN base_names m ON d.r = m.r LEFT JOIN names n ON d.r = n.r LEFT JOIN shares h ON d.r = h.r
    """


OP12_SQL = _sql()
