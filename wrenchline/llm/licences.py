"""Licence notices by a positional index of rare words.

The index holds, for each word of the notices, the places at which notices have it. A file is looked up by few of its
words only, the notice's rarest ones by inverse document frequency over all documents. Each occurrence and each posting
give the place in the file at which the notice would begin; where enough of them agree, the notice is compared with the
file word by word, allowing small shifts, and its key phrases must be there in full. A plain phrase is a notice that
must agree in every word.

The index and the document frequencies are as large as the list of notices, whatever the number of documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchline.llm.textbytes import ALPHANUMERIC, Chunk, chunks, owners, words

#: Words of a notice by which a file is looked up, and how many places must agree.
ROOTS = 6
LEAST_VOTES = 3
#: Words by which a part of a notice may be shifted, and the share of its words that must be there.
SLACK = 4
LEAST_SHARE = 0.6
#: Candidates that are compared at once.
CANDIDATES = 2048


@dataclass(frozen=True)
class Notice:
    """A text, its label, and the phrases of it that must be there in full."""

    label: str
    text: str
    keys: tuple[str, ...]


# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Opening lines of public licences and customary references to them, with their key phrases.
NOTICES = (
    Notice("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
           "associated documentation files, to deal in the Software without restriction",
           ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    Notice("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Notice("gpl-3.0", "licensed under the GNU General Public License, version 3",
           ("gnu general public license version 3",)),
    Notice("gpl-2.0", "licensed under the GNU General Public License, version 2",
           ("gnu general public license version 2",)),
    Notice("gpl-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of "
           "the GNU General Public License as published by the Free Software Foundation, or (at your option) any later "
           "version", ("gnu general public license as published by the free software foundation", "any later version")),
    Notice("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software "
           "Foundation", ("gnu lesser general public license",)),
    Notice("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software "
           "Foundation", ("gnu affero general public license",)),
    Notice("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
           "provided that the following conditions are met",
           ("redistribution and use in source and binary forms", "with or without modification")),
    Notice("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
           "is hereby granted", ("for any purpose with or without fee is hereby granted",)),
    Notice("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
           ("mozilla public license v 2 0",)),
    Notice("epl-2.0", "made available under the terms of the Eclipse Public License 2.0",
           ("eclipse public license 2 0",)),
    Notice("unlicense", "This is free and unencumbered software released into the public domain",
           ("free and unencumbered software released into the public domain",)),
    Notice("cc-by-4.0", "licensed under CC BY 4.0", ("cc by 4 0",)),
    Notice("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Notice("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Notice("cc-by-nd-4.0", "licensed under CC BY-ND 4.0", ("cc by nd 4 0",)),
    Notice("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License",
           ("creative commons attribution 4 0 international",)),
)


def _words_of(text: str) -> list[int]:
    chunk = next(iter(chunks(pa.array([text or ""]))))
    return words(chunk, ALPHANUMERIC).hashes.view(np.int64).tolist()


class _Template:
    """A notice or phrase as word numbers, with its postings ordered by word."""

    def __init__(self, label: str, whole: bool, text: str, keys: Sequence[str], numbers: Mapping[int, int],
                 idf: np.ndarray):
        self.label, self.whole = label, whole
        self.words = np.array([numbers[h] for h in _words_of(text)], np.int64)
        distinct = list(dict.fromkeys(self.words.tolist()))
        self.rarest = np.array(sorted(distinct, key=lambda v: (-idf[v], distinct.index(v))), np.int64)
        self.places = np.argsort(self.words, kind="stable")
        ordered = self.words[self.places]
        self.first = np.searchsorted(ordered, np.arange(len(idf)), "left")
        self.last = np.searchsorted(ordered, np.arange(len(idf)), "right")
        self.keys = []
        for key in keys:
            key_words = np.array([numbers[h] for h in _words_of(key)], np.int64)
            at = [q for q in range(len(self.words) - len(key_words) + 1)
                  if (self.words[q:q + len(key_words)] == key_words).all()]
            if not at:
                raise ValueError(f"the notice of {label} has no phrase {key!r}")
            self.keys.append((at[0], key_words))
        if whole and len(distinct) > ROOTS:
            raise ValueError(f"a phrase has at most {ROOTS} different words: {text!r}")
        self.votes = len(self.words) if whole else min(LEAST_VOTES, len(self.words))


class _File:
    """The words of a chunk as numbers of the index, -1 for others."""

    def __init__(self, chunk: Chunk, hashes: np.ndarray):
        got = words(chunk, ALPHANUMERIC)
        self.firsts = got.firsts
        own = got.hashes.view(np.int64)
        at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        self.numbers = np.where(hashes[at] == own, at, -1)
        self.hit = np.flatnonzero(self.numbers >= 0)
        self.text = owners(got.firsts)[self.hit]

    def at(self, text: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Word numbers at places of texts, -1 outside of the text."""
        inside = (place >= 0) & (place < (self.firsts[text + 1] - self.firsts[text]))
        if not len(self.numbers):
            return np.full(place.shape, -1)
        return np.where(inside, self.numbers[np.where(inside, self.firsts[text] + place, 0)], -1)


def _aligned(file: _File, template: _Template, dense: np.ndarray, present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) pairs at which enough of the postings of a text's rarest words agree."""
    known = present[:, template.rarest]
    chosen = np.zeros_like(present)
    chosen[:, template.rarest] = known & (np.cumsum(known, axis=1) <= ROOTS)
    use = np.flatnonzero(chosen[dense, file.numbers[file.hit]])
    word, text = file.numbers[file.hit[use]], file.text[use]
    many = template.last[word] - template.first[word]
    occurrence = np.repeat(np.arange(len(use)), many)
    nth = np.arange(len(occurrence)) - np.repeat(np.cumsum(many) - many, many)
    place = template.places[template.first[word[occurrence]] + nth]
    text = text[occurrence]
    # Starts may lie before the text; texts are kept apart by more than the longest shift.
    start = file.hit[use][occurrence] - place + text * (len(template.words) + 1)
    found, first, votes = np.unique(start, return_index=True, return_counts=True)
    enough = votes >= template.votes
    text = text[first[enough]]
    return text, found[enough] - text * (len(template.words) + 1) - file.firsts[text]


def _verified(file: _File, template: _Template, text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Share of the notice's words that are at their place, give or take ``SLACK``; 0 without a key phrase."""
    slack = np.arange(-SLACK, SLACK + 1)
    out = np.zeros(len(text))
    for lo in range(0, len(text), CANDIDATES):
        t, s = text[lo:lo + CANDIDATES, None], start[lo:lo + CANDIDATES, None]
        good = np.ones(len(t), bool)
        for at, key in template.keys:
            here = np.ones((len(t), len(slack)), bool)
            for i, word in enumerate(key.tolist()):
                here &= file.at(t, s + at + i + slack) == word
            good &= here.any(axis=1)
        kept = np.flatnonzero(good)
        if len(kept):
            shifted = np.zeros((len(kept), len(template.words)), bool)
            for d in slack.tolist():
                shifted |= file.at(t[kept], s[kept] + np.arange(len(template.words)) + d) == template.words
            out[lo + kept] = shifted.mean(axis=1)
    return out


def _best(text: np.ndarray, start: np.ndarray, share: np.ndarray, length: int) -> np.ndarray:
    """Of accepted alignments that overlap in a text the best one, the first of equals."""
    if not len(text):
        return np.zeros(0, np.int64)
    new = np.append(True, (text[1:] != text[:-1]) | (start[1:] - start[:-1] >= length))
    group = np.cumsum(new)
    order = np.lexsort((start, -share, group))
    return order[np.append(True, group[order][1:] != group[order][:-1])]


_SPAN = pa.struct([("label", pa.string()), ("whole", pa.bool_()), ("start", pa.int64()), ("words", pa.int64()),
                   ("share", pa.float64())])
_FOUND = "doc_id long, n_words long, found array<struct<label string, whole boolean, start long, words long, share double>>"


def _scanned(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, templates = broadcast.value
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                file = _File(chunk, hashes)
                some, dense = np.unique(file.text, return_inverse=True)
                present = np.zeros((len(some), len(hashes)), bool)
                present[dense, file.numbers[file.hit]] = True
                parts = []
                for k, template in enumerate(templates):
                    text, start = _aligned(file, template, dense, present)
                    share = np.ones(len(text))
                    if not template.whole:
                        share = _verified(file, template, text, start)
                        ok = np.flatnonzero(share >= LEAST_SHARE)
                        ok = ok[_best(text[ok], start[ok], share[ok], len(template.words))]
                        text, start, share = text[ok], start[ok], share[ok]
                    parts.append((text, start, share, np.full(len(text), k)))
                text, start, share, kind = map(np.concatenate, zip(*parts, strict=True))
                order = np.lexsort((kind, start, text))
                text, start, share, kind = text[order], start[order], share[order], kind[order]
                n = chunk.last - chunk.first
                spans_ = pa.StructArray.from_arrays(
                    [pa.array([templates[k].label for k in kind], pa.string()),
                     pa.array([templates[k].whole for k in kind], pa.bool_()), pa.array(start.astype(np.int64)),
                     pa.array([len(templates[k].words) for k in kind], pa.int64()), pa.array(share)], fields=list(_SPAN))
                edges = pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(chunk.first, n), pa.array(np.diff(file.firsts)),
                     pa.ListArray.from_arrays(edges, spans_)], ["doc_id", "n_words", "found"])

    return run


def _frequencies(hashes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, counts = 0, np.zeros(len(hashes), np.int64)
        for batch in batches:
            docs += len(batch)
            for chunk in chunks(batch.column(0)):
                file = _File(chunk, hashes)
                pairs = np.unique(file.text * len(hashes) + file.numbers[file.hit])
                counts += np.bincount(pairs % len(hashes), minlength=len(hashes))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, len(hashes))), pa.array(np.append(docs, counts))], ["word", "n"])

    return run


def scan_licences(docs: DataFrame, notices: Sequence[Notice] = NOTICES,
                  phrases: Mapping[str, str] = PHRASES) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words`` and ``found``, the places of phrases and notices.

    A place has its ``label``, whether it is a ``whole`` phrase, the word ``start`` at which it begins (a notice that is
    cut off at the start of a text may begin before it), the ``words`` of the notice and the ``share`` of them that are
    there. Phrases are found at all places where their words follow each other. Notices are found where at least
    ``LEAST_VOTES`` postings of the file's ``ROOTS`` rarest words of the notice agree on the start, all key phrases are there
    in full and at least ``LEAST_SHARE`` of the words are within ``SLACK`` words of their place; of overlapping places
    of a notice the best counts.

    Null and empty texts have no words and no places; repeated rows and ids are rows of their own; an empty table gives
    no rows; other columns are ignored.
    """
    every = [*phrases, *(n.text for n in notices)]
    hashes = np.array(sorted({h for text in every for h in _words_of(text)}), np.int64)
    counted = docs.select("text").mapInArrow(_frequencies(hashes), "word long, n long").groupBy("word").agg(
        F.sum("n").alias("n")).toPandas()
    n = dict(zip(counted["word"].tolist(), counted["n"].tolist(), strict=True))
    idf = np.array([math.log((n.get(-1, 0) + 1) / (n.get(v, 0) + 1)) for v in range(len(hashes))])
    numbers = {h: v for v, h in enumerate(hashes.tolist())}
    templates = [_Template(label, True, phrase, (), numbers, idf) for phrase, label in phrases.items()]
    templates += [_Template(x.label, False, x.text, x.keys, numbers, idf) for x in notices]
    broadcast = docs.sparkSession.sparkContext.broadcast((hashes, templates))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scanned(broadcast), _FOUND)


def licence_digest(found: DataFrame) -> DataFrame:
    """Counts, labels and a score per document from the places of ``scan_licences``."""
    base = F.filter("found", lambda x: x["whole"])
    starts = F.transform(base, lambda x: x["start"])

    def labels(of):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda x: x["label"]))), ",")

    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)).alias("score"))
