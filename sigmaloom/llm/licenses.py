"""Operator 7, license scans: exact set-similarity join of license templates with text blocks.

A block is any run of consecutive words of the whole text, across lines, as long as the template's words divided by
``containment``. A template is found in a block that holds at least ``containment`` of the template's distinct words: all
such blocks of all texts are found. The templates' words are ordered by how many lines of the corpus hold them, rarest
first. For an m-word template and an overlap of o words:
* prefix: a block that reaches o holds one of the template's first m-o+1 words
* length: at least o of the words around such a word are words of the template
* position: if the block's first shared word is the template's i-th, o of the template's words from the i-th on are around it
What passes is counted exactly, window by window. The base phrases are found as consecutive words.

A template gives way, in the blocks that they share, to one of a license whose notices hold its own wording and more
(GIVES_WAY): a notice of the LGPL is none of the GPL. It stays where it stands alone. Base labels always stay.

Defined results: a null or empty text has no words and no labels; repeated rows are judged alike; an empty
table gives no row; ties do not matter, as labels are sets.

Templates are fixed, so their word counts are a small table; the scan itself needs no shuffle.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, Rolling, slices, word_spans

#: Fixed values of the contract: phrase and label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Wording of common license notices, by label. Up to four words have to be there in full.
TEMPLATES = [
    ("apache", "apache license 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("mit", "under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-sa", "cc by sa"),
    ("cc0", "dedicated to the public domain under cc0"),
    ("agpl", "affero general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("boost", "boost software license"),
    ("epl", "eclipse public license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("cc-by-nd", "cc by nd"),
]
#: Labels whose wording is part of others' notices.
GIVES_WAY = {"gpl": {"lgpl", "agpl"}}
CONTAINMENT = 0.8
SEPARATOR = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Vocabulary:
    """Words by their hashes."""

    def __init__(self, words: list[str]):
        raw = [x.encode() for x in words]
        ends = np.cumsum([0, *map(len, raw)])
        hashes = Rolling(np.frombuffer(b"".join(raw), np.uint8)).of(ends[:-1], ends[1:]) if raw else np.zeros(0, np.uint64)
        self.place = np.argsort(hashes)
        self.known = hashes[self.place]

    def find(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words of a slice are known, and the number of each in the vocabulary."""
        if not len(starts) or not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = Rolling(LOWER[data]).of(starts, stops)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        hit = np.flatnonzero(self.known[at] == h)
        return hit, self.place[at[hit]]


def word_counts(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many lines of the corpus each word of the (fixed, short) vocabulary stands."""
    known = Vocabulary(vocabulary)

    def count(batches):
        seen = np.zeros(len(vocabulary), np.int64)
        for _, data, offsets in slices(batches, "text"):
            starts, stops, row = word_spans(data, offsets, ALNUM)
            hit, word = known.find(data, starts, stops)
            line = np.searchsorted(np.flatnonzero(data == 10), starts[hit]) + row[hit]
            seen += np.bincount(np.unique(line * len(vocabulary) + word) % max(1, len(vocabulary)), minlength=len(vocabulary))
        yield pa.record_batch({"word": pa.array(vocabulary, pa.string()), "n": pa.array(seen)})

    rows = docs.select("text").filter("text is not null").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return dict(rows)


def phrase(words: str) -> re.Pattern:
    """The words one after the other, with anything but letters and digits between and around them."""
    return re.compile(rb"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])" + SEPARATOR.join(w.encode() for w in words.split()) + rb"(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])")


class Template:
    """A template's words by their rank in the common order; how many a block needs, and the words of a block."""

    def __init__(self, label: str, text: str, rank: dict[str, int], containment: float):
        words = text.split()
        self.label, self.ranks = label, sorted({rank[w] for w in words})
        self.need = math.ceil(containment * len(self.ranks) - 1e-9)
        self.size = math.ceil(len(words) / containment - 1e-9)
        self.prefix = self.ranks[: len(self.ranks) - self.need + 1]

    def blocks(self, at: np.ndarray, rank: np.ndarray, row: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, first word, word after the last, shared words) of the blocks found, given the known words of a slice in order.

        A block is told from its first to its last word of the template; the blocks that start at one word count once.
        """
        own = np.isin(rank, self.ranks)
        at, rank, row = at[own], rank[own], row[own]
        first = np.flatnonzero(np.isin(rank, self.prefix))
        if not len(first):
            return []
        apart = at + row * self.size  # no block reaches over two texts
        low, high = np.searchsorted(apart, apart[first] - self.size + 1), np.searchsorted(apart, apart[first] + self.size - 1, "right")
        long = high - low >= self.need
        near = [(a, b) for a, b, i in zip(low[long].tolist(), high[long].tolist(), rank[first[long]].tolist(), strict=True) if len(set(rank[a:b][rank[a:b] >= i].tolist())) >= self.need]
        out, done = [], 0
        for a, b in near:
            # every block that holds a first word begins in its reach; reaches overlap, so each start is taken once
            for i in range(max(a, done), b):
                end = int(np.searchsorted(apart, apart[i] + self.size))
                shared = len(set(rank[i:end].tolist()))
                if shared >= self.need:
                    out.append((int(row[i]), int(at[i]), int(at[end - 1]) + 1, shared))
            done = max(done, b)
        return out


class Index:
    """The templates over one vocabulary, rarest word first."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[str, int], containment: float):
        words = sorted({w for _, t in templates for w in t.split()}, key=lambda x: (counts.get(x, 0), x))
        self.vocabulary = Vocabulary(words)
        rank = {w: i for i, w in enumerate(words)}
        self.templates = [Template(label, text, rank, containment) for label, text in templates]

    def found(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, row: np.ndarray, gives_way: dict[str, set[str]] = GIVES_WAY) -> dict[int, dict[str, float]]:
        """row -> label -> best containment, over all blocks of the texts of a slice."""
        at, rank = self.vocabulary.find(data, starts, stops)
        blocks = [(t, t.blocks(at, rank, row[at])) for t in self.templates] if len(at) else []
        spans: dict[tuple[int, str], list[tuple[int, int]]] = {}
        for t, some in blocks:
            for r, a, b, _ in some:
                spans.setdefault((r, t.label), []).append((a, b))
        out: dict[int, dict[str, float]] = {}
        for t, some in blocks:
            for r, a, b, shared in some:
                if any(x < b and a < y for other in gives_way.get(t.label, ()) for x, y in spans.get((r, other), ())):
                    continue
                best = out.setdefault(r, {})
                best[t.label] = max(best.get(t.label, 0.0), shared / len(t.ranks))
        return out


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    counts = word_counts(docs, sorted({w for _, t in templates for w in t.split()}))
    index = Index(templates, counts, containment)
    patterns = [(p.split()[0].encode(), phrase(p), label) for p, label in phrases.items()]

    def scan(batches):
        for rows, data, offsets in slices(batches, "text"):
            starts, stops, row = word_spans(data, offsets, ALNUM)
            n_words = np.bincount(row, minlength=len(rows)) if len(row) else np.zeros(len(rows), np.int64)
            first_of = np.concatenate([[0], np.cumsum(n_words)])
            low = data.tobytes().lower()
            out, every = [], index.found(data, starts, stops, row)
            for i in range(len(rows)):
                text = low[offsets[i] : offsets[i + 1]]
                places, base = [], set()
                for word, pattern, label in patterns:
                    if word in text:
                        hits = [m.start() for m in pattern.finditer(text)]
                        places += hits
                        if hits:
                            base.add(label)
                own = slice(first_of[i], first_of[i + 1])
                near = every.get(i, {})
                at = np.searchsorted(starts[own] - offsets[i], sorted(places)) if places else []
                labels = sorted(base | near.keys())
                out.append((len(places), int(at[0]) if places else None, int(at[-1]) if places else None, ",".join(sorted(base)), ",".join(labels), max(near.values(), default=1.0 if base else 0.0)))
            cols = list(zip(*out, strict=True))
            yield pa.record_batch({
                "doc_id": rows.column("doc_id"), "n_words": pa.array(n_words.astype("int64")), "n_base": pa.array(cols[0], pa.int64()), "first_word": pa.array(cols[1], pa.int64()), "last_word": pa.array(cols[2], pa.int64()),
                "base_labels": pa.array(cols[3], pa.string()), "labels": pa.array(cols[4], pa.string()), "score": pa.array(cols[5], pa.float64()),
            })

    d = docs.select("doc_id", "text")
    schema = d.select("doc_id").schema
    for name, kind in (("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double")):
        schema = schema.add(name, kind)
    return d.mapInArrow(scan, schema)
