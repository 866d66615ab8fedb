"""Licence phrases and texts by a positional index of their rarest words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.store import map_texts, ship_package
from docloom.llm.words import blocks, word_hashes

# Phrases and their labels, as the contract names them.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Opening words of public licences and notices, label first, then the template (punctuation left out,
# lower case), then the key phrases that must stand in it word for word.
TEMPLATES = (
    ("gpl-2.0", "gnu general public license version 2", ("version 2",)),
    ("gpl-3.0", "gnu general public license version 3", ("version 3",)),
    ("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "gnu affero general public license", ("affero general public license",)),
    ("apache-2.0", "apache license version 2 0", ("version 2 0",)),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license", ("attribution sharealike",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "version 2")),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "version 3")),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license version 2 0", "except in compliance with the license")),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products",)),
    ("mit-notice", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", ("as is without warranty of any kind", "noninfringement")),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
)
RARE = 4  # words of a document that are looked up for a template
SLACK = 2  # words by which a word may stand aside from its place
LEAST_MATCH = 0.8  # words of a template that must stand at their places or so near


def _vocabulary() -> list[str]:
    return sorted({w for text in [*PHRASES, *(t for _, t, _ in TEMPLATES)] for w in text.split()})


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[dict[str, int], int]:
    """In how many of all documents each licence word occurs, and the number of documents. The vocabulary is fixed, so
    the result has at most as many rows as it has words."""
    ship_package(docs.sparkSession)
    words = _vocabulary()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = word_hashes(words)
        order = np.argsort(hashes)
        ranked, times, n = hashes[order], np.zeros(len(words), np.int64), 0
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b["text"]]
            n += len(texts)
            for _, _, _, _, first, _, _, found in blocks(texts):
                at = np.minimum(np.searchsorted(ranked, found), len(ranked) - 1)
                hit = np.flatnonzero(ranked[at] == found)
                owner = np.searchsorted(first, hit, "right")
                seen = np.unique(owner * len(words) + order[at[hit]])
                times += np.bincount(seen % len(words), minlength=len(words))
        yield pd.DataFrame({"word": [*words, None], "n": [*times.tolist(), n]})

    rows = docs.select(F.col(text).alias("text")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}
    return {w: found.get(w, 0) for w in words}, found.get(None, 0)


class RareTokenIndex:
    """Phrases and templates by their words: word -> places in each entry. Words are numbered from the rarest on."""

    def __init__(self, frequencies: dict[str, int], n_docs: int):
        idf = {w: math.log((n_docs + 1) / (n + 1)) for w, n in frequencies.items()}
        self.words = sorted(frequencies, key=lambda w: (-idf[w], w))
        number = {w: i for i, w in enumerate(self.words)}
        hashes = word_hashes(self.words)
        self.order = np.argsort(hashes)
        self.ranked = hashes[self.order]
        self.entries: list[tuple[str, np.ndarray, list[tuple[int, int]]]] = []
        self.times = np.zeros((len(number), len(TEMPLATES)), np.int64)  # places of a word in a template
        self.key = np.zeros((len(number), len(TEMPLATES)), np.int64)  # 1 for words of key phrases
        for k, (label, text, keys) in enumerate([(label, p, (p,)) for p, label in PHRASES.items()] + list(TEMPLATES)):
            words = text.split()
            spans = [next((i, i + len(key.split())) for i in range(len(words)) if words[i : i + len(key.split())] == key.split()) for key in keys]
            self.entries.append((label, np.array([number[w] for w in words]), spans))
            if k >= len(PHRASES):
                np.add.at(self.times[:, k - len(PHRASES)], self.entries[k][1], 1)
                for x, y in spans:
                    self.key[self.entries[k][1][x:y], k - len(PHRASES)] = 1

    def find(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each entry met: (entry, document of each place, first word of each place, share of its words that match)."""
        near = np.minimum(np.searchsorted(self.ranked, words), len(self.ranked) - 1)
        known = np.where(self.ranked[near] == words, self.order[near], -1)  # number of each word, -1 for others
        at = np.flatnonzero(known >= 0)
        word = known[at]
        # Of texts without words, which begin where the next one does, the search takes the last: the owner.
        doc = np.searchsorted(first, at, "right") - 1
        for k in range(len(PHRASES)):
            _, pattern, _ = self.entries[k]
            anchor = int(np.argmin(pattern))
            starts, owner = at[word == pattern[anchor]] - anchor, doc[word == pattern[anchor]]
            fits = (starts >= first[owner]) & (starts + len(pattern) <= first[owner + 1])
            starts, owner = starts[fits], owner[fits]
            whole = (known[starts[:, None] + np.arange(len(pattern))] == pattern).all(1)
            if whole.any():
                yield k, owner[whole], starts[whole], np.ones(int(whole.sum()))
        if not len(at):
            return
        pairs = np.unique(doc * len(self.words) + word)  # distinct licence words of each document, the rarest first
        owner, held = pairs // len(self.words), pairs % len(self.words)
        docs, begins = np.unique(owner, return_index=True)
        ends = np.append(begins[1:], len(owner))
        # A match needs most words of the template and all of its key phrases somewhere in the document.
        lengths = self.times.sum(0)
        may = np.add.reduceat(self.times[held], begins) >= LEAST_MATCH * lengths
        may &= np.add.reduceat(self.key[held], begins) == self.key.sum(0)
        for i, t in np.argwhere(may).tolist():
            mine = held[begins[i] : ends[i]]
            rare = mine[self.times[mine, t] > 0][:RARE]
            low, high = np.searchsorted(at, (first[docs[i]], first[docs[i] + 1]))
            starts, share = self._places(t, rare, at[low:high], word[low:high], known, first[docs[i]], first[docs[i] + 1])
            if len(starts):
                yield t + len(PHRASES), np.full(len(starts), docs[i]), starts, share

    def _places(self, t: int, rare: np.ndarray, at: np.ndarray, word: np.ndarray, known: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of one template in the words ``low`` to ``high`` of one document, whose licence words stand at ``at``."""
        _, pattern, spans = self.entries[t + len(PHRASES)]
        starts = np.sort(np.concatenate([at[word == w] - p for w in rare for p in np.flatnonzero(pattern == w)]))
        votes = np.searchsorted(starts, starts + SLACK, "right") - np.searchsorted(starts, starts - SLACK)
        starts = np.unique(starts[votes >= min(2, len(rare))])
        good, shares = [], []
        aside = np.arange(-SLACK, SLACK + 1)
        for i in range(0, len(starts), 1024):
            some = starts[i : i + 1024]
            index = some[:, None, None] + aside[:, None] + np.arange(len(pattern))
            inside = (index >= low) & (index < high)
            hit = inside & (known[np.where(inside, index, low)] == pattern)
            share = hit.any(1).mean(1)
            fits = share >= LEAST_MATCH
            for x, y in spans:
                fits &= hit[:, :, x:y].all(2).any(1)
            good.append(some[fits])
            shares.append(share[fits])
        starts, share = (np.concatenate(x) if x else np.zeros(0) for x in (good, shares))
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0)
        # Starts side by side are one place; the best of them stands for it.
        run = np.cumsum(np.diff(starts, prepend=starts[0]) > 2 * SLACK)
        best = np.lexsort((starts, -share, run))
        best = best[np.diff(run[best], prepend=-1) > 0]
        return np.maximum(starts[best], low).astype(np.int64), share[best]


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, n_words, n_base, first_word, last_word, base_labels, labels, score and places (label,
    first word, matching share of each place).

    Words are as in ``words``; a null text counts as empty. The rarity of licence words is counted over all documents.
    Every phrase is looked up by its rarest word and compared word for word, so all its places are found. For a template that a
    document can hold by its words, the document's own four rarest words of it are looked up; where at least two agree
    on its beginning, give or take two words, four fifths of its words must stand at their places or so near, and its key
    phrases word for word. score is the best share. Rows are independent, so repeated rows get
    equal results; an empty table gives none.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(document_frequencies(docs, text))  # one number per licence word
    built: list[RareTokenIndex] = []  # once for each worker

    def scan(texts: list[str | None]) -> dict[str, list]:
        if not built:
            built.append(RareTokenIndex(*shared.value))
        index, n = built[0], len(texts)
        n_words, places = np.zeros(n, np.int64), [[] for _ in range(n)]
        for i, j, _, _, first, _, _, words in blocks(texts):
            n_words[i:j] = np.diff(first)
            for k, doc, starts, share in index.find(words, first):
                for d, s, x in zip(doc.tolist(), (starts - first[doc]).tolist(), share.tolist(), strict=True):
                    places[i + d].append((k, s, x))
        base = [[p for p in ps if p[0] < len(PHRASES)] for ps in places]
        label = lambda ps: ",".join(sorted({index.entries[p[0]][0] for p in ps}))
        return {
            "n_words": n_words,
            "n_base": [len(x) for x in base],
            "first_word": [min((p[1] for p in x), default=None) for x in base],
            "last_word": [max((p[1] for p in x), default=None) for x in base],
            "base_labels": [label(x) for x in base],
            "labels": [label(x) for x in places],
            "score": [max((p[2] for p in x), default=0.0) for x in places],
            "places": [[{"label": index.entries[k][0], "word": s, "share": x} for k, s, x in sorted(ps)] for ps in places],
        }

    columns = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return map_texts(docs.select(key, text), scan, f"{columns}, places array<struct<label:string,word:long,share:double>>", [key], text)


def op4_license_scan(spark, sf):
    return scan_licenses(spark.read.parquet(f"{sf}/documents.parquet")).drop("places")


QUERIES = {"op4_license_scan": op4_license_scan}
ORACLES = {}
