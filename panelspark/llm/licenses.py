"""License scan: exact set-similarity join of text blocks with license templates.

A template is found where a run of at most as many words as it has holds at least ``ceil(threshold * size)`` of its
distinct words, all of those that must occur and none of those that must not; a template of fewer than ``SHORT``
distinct words needs all of them.

Runs are found in two steps. A block is a longer run of words; neighbouring blocks overlap by one word less than the
longest template, so every run as long as a template lies whole in some block. Words are ordered by
their count over the whole corpus, rarest first. Of a template, only the prefix of
``size - needed + 1`` rarest words is indexed: a block that meets the threshold shares one of them
(prefix filter), has enough template words at all (length filter), and enough of them left behind
the shared word's place in both orders (positional filter). Only blocks that pass are compared, and only in those that
hold enough of the template is the run itself searched for.

Phrases are templates with threshold 1; the blocks that hold all words of a phrase are then searched for the
places where they stand consecutively.

The words are counted by one distributed aggregation over all documents; the index holds the
templates only, so the join needs no shuffle and keeps one row per document.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows give repeated
results; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases and labels (fixed values).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Sentences of common licenses, their labels, words that must occur and words that must not (fixed values).
TEMPLATES = [
    ("licensed under the gnu general public license", "gpl", "", ""),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation", "gpl", "gnu general", "lesser affero library"),
    ("licensed under the gnu lesser general public license", "lgpl", "", ""),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
     "public license as published by the free software foundation", "lgpl", "gnu lesser", "affero"),
    ("licensed under the gnu affero general public license", "agpl", "", ""),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general "
     "public license as published by the free software foundation", "agpl", "gnu affero", "lesser"),
    ("permission is granted to copy distribute and or modify this document under the terms of the gnu free "
     "documentation license", "gfdl", "gnu documentation", ""),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
     "apache", "apache", ""),
    ("licensed under the mit license", "mit", "", ""),
    ("released under the mit license", "mit", "", ""),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files to deal in the software without restriction", "mit", "permission granted charge", "organization"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and "
     "accompanying documentation covered by this license to use reproduce display distribute execute and transmit the "
     "software", "boost", "permission granted organization", ""),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted provided that the above copyright notice and this permission notice appear in all copies", "isc",
     "permission granted fee", ""),
    ("licensed under the bsd license", "bsd", "", ""),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met", "bsd", "redistribution permitted", ""),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
     "products derived from this software without specific prior written permission", "bsd", "neither endorse", ""),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held "
     "liable for any damages arising from the use of this software", "zlib", "software warranty authors", ""),
    ("licensed under the mozilla public license", "mpl", "", ""),
    ("this source code form is subject to the terms of the mozilla public license", "mpl", "mozilla", ""),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license",
     "epl", "eclipse", ""),
    ("this font software is licensed under the sil open font license version 1 1", "ofl", "sil font", ""),
    ("licensed under cc by 4 0", "cc-by", "", ""),
    ("licensed under a creative commons attribution license", "cc-by", "", "noncommercial sharealike noderivatives"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by", "creative commons attribution",
     "noncommercial sharealike noderivatives"),
    ("licensed under cc by nc 4 0", "cc-by-nc", "", ""),
    ("licensed under a creative commons attribution noncommercial license", "cc-by-nc", "", "sharealike noderivatives"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc",
     "creative commons noncommercial", "sharealike noderivatives"),
    ("licensed under cc by sa 4 0", "cc-by-sa", "", ""),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa",
     "creative commons sharealike", "noncommercial noderivatives"),
    ("licensed under cc by nd 4 0", "cc-by-nd", "", ""),
    ("licensed under a creative commons attribution noderivatives 4 0 international license", "cc-by-nd",
     "creative commons noderivatives", "noncommercial sharealike"),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa", "", ""),
    ("licensed under a creative commons attribution noncommercial sharealike 4 0 international license", "cc-by-nc-sa",
     "creative commons noncommercial sharealike", "noderivatives"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this "
     "work", "cc0", "waived copyright", ""),
    ("all rights reserved", "all-rights-reserved", "", ""),
    ("this is free and unencumbered software released into the public domain", "public-domain", "public domain", ""),
]

#: Templates of fewer distinct words than this need all of them.
SHORT = 10

RESULT = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


class TemplateIndex:
    """Templates in global word order, their prefixes by word, and the phrases."""

    def __init__(self, templates, phrases, threshold: float, counts: dict[str, int], stride: int = 64):
        sets = [(tuple(t.split()), label, must.split(), never.split(), False) for t, label, must, never in templates]
        sets += [(tuple(p.split()), label, (), (), True) for p, label in phrases.items()]
        vocabulary = {w for words, _, _, never, _ in sets for w in (*words, *never)}
        order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.sets, self.prefix, self.limits = [], {}, []
        for words, label, must, never, is_phrase in sets:
            ids = sorted({self.rank[w] for w in words})
            share = 1.0 if is_phrase or len(ids) < SHORT else threshold
            needed = math.ceil(share * len(ids) - 1e-9)
            at = len(self.sets)
            self.sets.append((ids, needed, label, is_phrase, [self.rank[w] for w in words]))
            self.limits.append(({self.rank[w] for w in must}, {self.rank[w] for w in never}))
            for place in range(len(ids) - needed + 1):
                self.prefix.setdefault(ids[place], []).append((at, place))
        self.stride = stride
        self.width = stride + max(len(words) for words, *_ in sets) - 1

    def blocks(self, ranked: list[int], places: list[int]) -> Iterator[tuple[int, list[int]]]:
        """(first word, distinct template words in order) of blocks that hold an indexed word."""
        stride, width, seen = self.stride, self.width, set()
        for rank, place in zip(ranked, places):
            if rank not in self.prefix:
                continue
            low = max(0, -(-(place - width + 1) // stride))
            for block in range(low, place // stride + 1):
                if block not in seen:
                    seen.add(block)
                    a, b = bisect_left(places, block * stride), bisect_left(places, block * stride + width)
                    yield block * stride, sorted(set(ranked[a:b]))

    def join(self, block: list[int]) -> list[int]:
        """Numbers of the templates of which a block holds enough words."""
        tried, found, members = set(), [], set(block)
        for place_b, rank in enumerate(block):
            for at, place_t in self.prefix.get(rank, ()):
                if at in tried:
                    continue
                tried.add(at)
                ids, needed = self.sets[at][:2]
                # Shared words all stand at or behind these places, the first indexed word the block has.
                if len(block) < needed or 1 + min(len(ids) - place_t, len(block) - place_b) - 1 < needed:
                    continue
                overlap = sum(i in members for i in ids)
                if overlap >= needed:
                    found.append(at)
        return found

    def best_run(self, at: int, ranked: list[int], places: list[int]) -> float:
        """Largest containment of a template in a run of a block's words, 0 where none meets the conditions."""
        ids, needed, _, _, sequence = self.sets[at]
        must, never = self.limits[at]
        members, best = set(ids), 0
        for first, rank in enumerate(ranked):
            if rank not in members:
                continue
            held, end = set(), places[first] + len(sequence)
            for k in range(first, len(ranked)):
                if places[k] >= end or ranked[k] in never:
                    break
                if ranked[k] in members:
                    held.add(ranked[k])
            if len(held) > best and must <= held:
                best = len(held)
            if best == len(ids):
                break
        return best / len(ids) if best >= needed else 0.0

    def scan(self, text: str | None) -> tuple:
        words = words_of(text)
        get = self.rank.get
        hits = [(i, r) for i, r in enumerate(map(get, words)) if r is not None]
        places, ranked = [i for i, _ in hits], [r for _, r in hits]
        starts, base, labels, score = set(), set(), set(), 0.0
        for begin, block in self.blocks(ranked, places):
            a, b = bisect_left(places, begin), bisect_left(places, begin + self.width)
            for at in self.join(block):
                _, _, label, is_phrase, sequence = self.sets[at]
                if not is_phrase:
                    share = self.best_run(at, ranked[a:b], places[a:b])
                    if share:
                        labels.add(label)
                        score = max(score, share)
                    continue
                span = len(sequence)
                for k in range(a, b - span + 1):
                    if ranked[k:k + span] == sequence and places[k + span - 1] - places[k] == span - 1:
                        starts.add((places[k], at))
                        base.add(label)
                        score = 1.0
        where = [p for p, _ in starts]
        return (len(words), len(starts), min(where, default=None), max(where, default=None),
                ",".join(sorted(base)), ",".join(sorted(base | labels)), score)


def count_words(docs: DataFrame, text_col: str, vocabulary: set[str]) -> dict[str, int]:
    """Counts over all documents of the template words; at most one number for each comes back."""
    def count(batches):
        for batch in batches:
            found: dict[str, int] = {}
            for text in batch["text"]:
                for w in words_of(text):
                    if w in vocabulary:
                        found[w] = found.get(w, 0) + 1
            yield pd.DataFrame({"word": list(found), "n": list(found.values())}).astype({"word": object, "n": "int64"})

    counted = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "word string, n long")
    return {r["word"]: r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES,
                  phrases=PHRASES, threshold: float = 0.8) -> DataFrame:
    """One row per document: doc_id and the columns of RESULT.

    ``score`` is the largest containment of a template found, 1 where a phrase stands, else 0.
    """
    vocabulary = {w for t, _, _, never in templates for w in (*t.split(), *never.split())} | {w for p in phrases for w in p.split()}
    index = TemplateIndex(templates, phrases, threshold, count_words(docs, text_col, vocabulary))

    @F.pandas_udf(RESULT)
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RESULT.split(", ")]
        for batch in texts:
            out = pd.DataFrame([index.scan(t) for t in batch], columns=names)
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select(F.col(id_col).alias("doc_id"), scan(F.col(text_col)).alias("found")).select("doc_id", "found.*")
