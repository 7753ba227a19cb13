"""Licence scan by a positional index of licence texts, entered by a file's rarest licence words.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters from U+0080 on.

1. One pass counts, over all documents, how many hold each word of the licence texts: its IDF. The words are
   those of the texts below, so the table has a few hundred rows whatever the corpus.
2. In the second pass a file's words are looked up in the index, word -> postings (template, position). A
   template is a candidate if the file has words of a sufficient share of its IDF.
3. The template's highest-IDF words that the file has are located. Each place and posting give the
   relative position at which the template would start; starts where enough of these words
   agree, edits of some words allowed, are alignments.
4. An alignment is verified: every mandatory key phrase stands inside it, word by word, and the words
   found at their places carry the least share of the template's IDF. That share is its score.

Base phrases are templates of their own: all words mandatory, consecutive, so every place is found. Texts
are read whole; documents are never shuffled.

Edge cases: null, empty or wordless texts have no words, places or labels and score 0; labels are empty
strings where there are none; null doc_ids are kept; rows that repeat count and return one by one; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.codes import doc_of, runs, span_hash, text_slices
from fleetlens.llm.registry import query, table

# The phrases of the base scan and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Notices that the licences themselves ask to be put into files, with the phrases no copy may lack.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
     ["to deal in the software without restriction"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
     ["apache license version 2", "except in compliance with the license"]),
    ("apache-2", "licensed under the apache 2 0 license", ["apache 2 0 license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
     ["for any purpose with or without fee is hereby granted"]),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
     ["gnu general public license", "version 2"]),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
     ["gnu general public license", "version 3"]),
    ("gpl-3", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
     ["gnu lesser general public license"]),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
     ["gnu affero general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
     ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0 international"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["has waived all copyright and related or neighboring rights"]),
    ("mit", "spdx license identifier mit", ["spdx license identifier mit"]),
    ("apache-2", "spdx license identifier apache 2 0", ["spdx license identifier apache 2 0"]),
    ("bsd", "spdx license identifier bsd", ["spdx license identifier bsd"]),
    ("gpl-2", "spdx license identifier gpl 2 0", ["spdx license identifier gpl 2 0"]),
    ("gpl-3", "spdx license identifier gpl 3 0", ["spdx license identifier gpl 3 0"]),
    ("mpl-2", "spdx license identifier mpl 2 0", ["spdx license identifier mpl 2 0"]),
]

#: Of a template's words that a file has, so many of the highest IDF are located.
RARE = 8
#: Share of these that has to agree on a start, and share of the template's IDF that has to stand at its place.
AGREE, LEAST_SHARE = 0.5, 0.6
#: Words by which an edit may move the rest of a notice.
SLACK = 6
OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label:string,start:long,length:long,score:double>>"


@dataclass
class Template:
    label: str
    words: np.ndarray
    phrases: list[np.ndarray]
    base: bool
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def slack(self) -> int:
        return 0 if self.base else SLACK

    @property
    def share(self) -> float:
        return 1.0 if self.base else LEAST_SHARE


@dataclass
class Index:
    """Hashes of the vocabulary in ascending order, and templates as numbers of words there."""

    vocabulary: np.ndarray
    templates: list[Template]

    def weighted(self, idf: np.ndarray) -> Index:
        """The same with the IDF of every word put in: per template the weight of each of its places."""
        return Index(self.vocabulary, [Template(t.label, t.words, t.phrases, t.base, idf[t.words]) for t in self.templates])


def split_words(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, the text it lies in) of texts that stand end to end."""
    low = points + np.where((points >= 65) & (points <= 90), np.uint32(32), np.uint32(0))
    held = ((low >= 48) & (low <= 57)) | ((low >= 97) & (low <= 122)) | (low >= 128)
    starts, ends = runs(held, bounds)
    return span_hash(low, starts, ends), doc_of(starts, bounds)


def hashes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return split_words(points, np.array([0, len(points)]))[0]


@lru_cache(maxsize=None)
def index() -> Index:
    """The index of all templates, without weights."""
    texts = [(label, phrase, [phrase], True) for phrase, label in BASE.items()] + [(*n, False) for n in NOTICES]
    vocabulary = np.unique(np.concatenate([hashes_of(t[1]) for t in texts]))
    number = lambda text: np.searchsorted(vocabulary, hashes_of(text))
    return Index(vocabulary, [Template(label, number(text), [number(p) for p in phrases], base) for label, text, phrases, base in texts])


def looked_up(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Number of each word in the vocabulary, -1 for all others."""
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, -1)


def _counts(batches):
    """How many documents of the task there are (word -1) and how many hold each word."""
    vocabulary = index().vocabulary
    held, rows = np.zeros(len(vocabulary), np.int64), 0
    for batch in batches:
        for part, points, bounds in text_slices(batch, "text"):
            hashes, doc = split_words(points, bounds)
            word = looked_up(hashes, vocabulary)
            some = word >= 0
            both = np.unique(doc[some] * len(vocabulary) + word[some])
            held += np.bincount(both % len(vocabulary), minlength=len(vocabulary))
            rows += part.num_rows
    words = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *words.tolist()], pa.int32()), pa.array([rows, *held[words].tolist()], pa.int64())], names=["word", "n"])


def word_idf(docs: DataFrame) -> np.ndarray:
    """IDF of each word of the vocabulary, over all documents."""
    found = docs.select("text").mapInArrow(_counts, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in found}
    held = np.array([counts.get(i, 0) for i in range(len(index().vocabulary))], np.float64)
    return np.log((1.0 + counts.get(-1, 0)) / (1.0 + held)) + 1e-3


def phrase_starts(word: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """All places where the words of a phrase stand consecutively."""
    at = np.flatnonzero(word[: max(0, len(word) - len(phrase) + 1)] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[word[at + k] == phrase[k]]
    return at


def alignments(word: np.ndarray, by_word: dict[int, np.ndarray], t: Template) -> list[tuple[int, float]]:
    """(start, score) of the verified places of a template in one text. ``by_word``: places of each licence word."""
    kinds, first = np.unique(t.words, return_index=True)
    order = kinds[np.lexsort((kinds, -t.weights[first]))]
    rare = [w for w in order.tolist() if w in by_word][:RARE]
    need = len(rare) if t.base else max(1, int(np.ceil(AGREE * len(rare))))
    # Relative positions: where the template would start if a place were the one of a posting.
    shifts, owner = [], []
    for k, w in enumerate(rare):
        posting = np.flatnonzero(t.words == w)
        found = (by_word[w][:, None] - posting[None, :]).ravel()
        shifts.append(found)
        owner.append(np.full(len(found), k))
    shift, owner = np.concatenate(shifts), np.concatenate(owner)
    both = np.unique(np.stack([shift, owner], 1), axis=0)
    shift, owner = both[:, 0], both[:, 1]
    # Starts that enough of the rare words share within the slack, and how many of them exactly.
    heads, exact = np.unique(shift, return_counts=True)
    agree = np.zeros(len(heads), np.int64)
    for k in range(len(rare)):
        own = shift[owner == k]
        at = np.searchsorted(own, heads)
        agree += (at < len(own)) & (own[np.minimum(at, len(own) - 1)] <= heads + t.slack)
    heads, exact = heads[agree >= need], exact[agree >= need]
    if not len(heads):
        return []
    # Mandatory phrases lie inside the stretch that the template takes from there.
    last = heads + len(t.words) + t.slack
    for phrase in t.phrases:
        places = phrase_starts(word, phrase)
        at = np.searchsorted(places, heads)
        inside = at < len(places)
        inside[inside] = places[at[inside]] + len(phrase) <= last[inside]
        heads, last, exact = heads[inside], last[inside], exact[inside]
    if not len(heads):
        return []
    got = np.zeros(len(heads))
    for j, w in enumerate(t.words.tolist()):
        own = by_word.get(w)
        if own is not None:
            at = np.searchsorted(own, heads + j)
            got += t.weights[j] * ((at < len(own)) & (own[np.minimum(at, len(own) - 1)] <= heads + j + t.slack))
    score = got / t.weights.sum()
    good = np.flatnonzero(score >= t.share - 1e-9)
    # Of neighbouring starts of an edited notice the best one stands for all.
    group = np.cumsum(np.diff(heads[good], prepend=-1) > t.slack) if not t.base else np.arange(len(good))
    order = good[np.lexsort((-exact[good], -np.round(score[good], 9), group))]
    first = np.unique(np.sort(group), return_index=True)[1]
    return [(int(heads[i]), min(1.0, float(score[i]))) for i in order[first]]


def scan_text(word: np.ndarray, templates: list[Template], candidates) -> list[tuple[Template, int, float]]:
    """Verified places in one text, given as numbers of vocabulary words (-1: other words)."""
    places = np.flatnonzero(word >= 0)
    order = np.argsort(word[places], kind="stable")
    kinds, at = np.unique(word[places][order], return_index=True)
    by_word = dict(zip(kinds.tolist(), np.split(places[order], at[1:]), strict=True))
    return [(templates[i], start, score) for i in candidates for start, score in alignments(word, by_word, templates[i])]


def _row(doc_id, n_words: int, found: list[tuple[Template, int, float]]) -> tuple:
    base = [start for t, start, _ in found if t.base]
    names = lambda some: ",".join(sorted({t.label for t, _, _ in some}))
    places = [{"label": t.label, "start": start, "length": len(t.words), "score": score} for t, start, score in sorted(found, key=lambda f: (f[1], f[0].label))]
    return (doc_id, n_words, len(base), min(base, default=None), max(base, default=None), names(f for f in found if f[0].base), names(found),
            max((score for _, _, score in found), default=0.0), places)


def _scan(batches, known: Index):
    size = len(known.vocabulary)
    # Share of each template's weight that a word stands for, each word counted once.
    weight = np.zeros((size, len(known.templates)))
    for i, t in enumerate(known.templates):
        np.add.at(weight[:, i], t.words, t.weights / t.weights.sum())
    share = np.array([t.share for t in known.templates])
    place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), place]
    names = [c.split()[0] for c in OUT.split(", ")]
    for batch in batches:
        for part, points, bounds in text_slices(batch, "text"):
            hashes, doc = split_words(points, bounds)
            word = looked_up(hashes, known.vocabulary)
            n = part.num_rows
            cuts = np.searchsorted(doc, np.arange(n + 1))
            has = np.zeros((n, size), bool)
            some = word >= 0
            has[doc[some], word[some]] = True
            likely = has @ weight >= share - 1e-9
            rows = []
            for i, doc_id in enumerate(part.column(0).to_pylist()):
                candidates = np.flatnonzero(likely[i])
                found = scan_text(word[cuts[i] : cuts[i + 1]], known.templates, candidates) if len(candidates) else []
                rows.append(_row(doc_id, int(cuts[i + 1] - cuts[i]), found))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places (label, first
    word, length of the notice, score; by first word)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = index().weighted(word_idf(docs))
    return docs.mapInArrow(lambda it: _scan(it, known), OUT)


@query("op13_license_scans")
def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
