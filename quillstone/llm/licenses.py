"""License scans by a positional index of rare licence words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import chunks
from quillstone.llm.tokens import hash_spans

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: A template is found where so much of the weight of its words stands in place.
SHARE = 0.6
#: A word may be off its place by a quarter of the template's length, and by so many words at most.
SLACK = 8


@dataclass(frozen=True)
class Template:
    """keys: phrases of the text that must all stand in place, word by word."""

    label: str
    text: str
    keys: tuple[str, ...]


#: Base phrases, each a template of its own.
PHRASES = (
    Template("mit", "mit license", ("mit license",)),
    Template("apache", "apache license", ("apache license",)),
    Template("gpl", "general public license", ("general public license",)),
)

#: Public licence texts and notices, and phrases without which they are not that licence.
TEMPLATES = (
    *PHRASES,
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
        ("permission is hereby granted", "without limitation the rights to use"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
        ("for any purpose with or without fee",),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
        ("redistribution and use in source and binary forms",),
    ),
    Template(
        "apache",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You '
        "may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ("in compliance with the license", "governing permissions and limitations"),
    ),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("gnu general public license", "free software foundation"),
    ),
    Template(
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        ("gnu lesser general public license", "free software foundation"),
    ),
    Template(
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        ("mozilla public license",),
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means.",
        ("unencumbered software released into the public domain",),
    ),
    Template("cc-by", "licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa", "licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc-by-nc", "licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-nd", "licensed under CC BY-ND 4.0", ("cc by nd",)),
)


def words_of(text: str) -> list[str]:
    """Words as the operator takes them: A-Z lower-cased; ASCII letters and digits, and everything beyond ASCII."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


class Index:
    """Licence words and where they stand in the templates."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES):
        self.templates = templates
        texts = [words_of(t.text) for t in templates]
        self.words = sorted({w for t in texts for w in t})
        number = {w: i for i, w in enumerate(self.words)}
        self.places = [np.array([number[w] for w in t]) for t in texts]  # word at each place
        self.slack = [min(SLACK, len(t) // 4) for t in texts]
        self.keys = []  # of each template: (words, place of the first one)
        for t, own in zip(templates, texts, strict=True):
            found = []
            for key in map(words_of, t.keys):
                at = next(i for i in range(len(own)) if own[i : i + len(key)] == key)
                found.append((np.array([number[w] for w in key]), at))
            self.keys.append(found)
        raw = [w.encode() for w in self.words]
        ends = np.cumsum([len(w) + 1 for w in raw]) - 1
        starts = ends - np.array([len(w) for w in raw])
        hashes = hash_spans(np.frombuffer(b" ".join(raw) + b" ", np.uint8), starts, ends)
        order = np.argsort(hashes)
        self.hashes, self.number = hashes[order], order.astype(np.int32)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, or -1."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.number[at], -1)


class Texts:
    """Words of many texts: number in the index, or -1; first[d] is where text d begins."""

    def __init__(self, texts: list[bytes], index: Index):
        buf = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        offsets = np.concatenate(([0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], _WORD[buf], [False])).astype(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(starts, offsets)
        self.word = index.lookup(hash_spans(buf, starts, ends))
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        hit = np.flatnonzero(self.word >= 0)
        pair = np.unique(self.doc[hit].astype(np.int64) * len(index.words) + self.word[hit])
        self.pairs = pair // len(index.words), pair % len(index.words)  # text and licence word, each pair once


class Scanner:
    """Finds templates, given the number of texts and of texts with each licence word."""

    def __init__(self, index: Index, n_texts: int, n_with: np.ndarray):
        self.index = index
        self.idf = np.log((n_texts + 1) / (n_with + 1)) + 1
        totals = [self.idf[p].sum() for p in index.places]
        self.weight = np.zeros((len(index.words), len(index.places)))  # of a word in each template
        for t, places in enumerate(index.places):
            np.add.at(self.weight[:, t], places, self.idf[places] / totals[t])

    def base(self, texts: Texts) -> list[np.ndarray]:
        """Where the phrases stand: word positions in texts, for each phrase."""
        found = []
        for t in range(len(PHRASES)):
            phrase = self.index.keys[t][0][0]
            size = len(texts.word) - len(phrase) + 1
            ok = np.ones(max(size, 0), bool)
            for j, w in enumerate(phrase):
                ok &= texts.word[j : j + len(ok)] == w
            at = np.flatnonzero(ok)
            found.append(at[texts.doc[at] == texts.doc[at + len(phrase) - 1]] if len(at) else at)
        return found

    def candidates(self, texts: Texts) -> list[tuple[int, int]]:
        """Texts and templates of which the words that the text has at all weigh SHARE or more."""
        doc, word = texts.pairs
        if not len(doc):
            return []
        at = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        sums = np.add.reduceat(self.weight[word], at)
        row, t = np.nonzero(sums >= SHARE - 1e-9)
        return list(zip(doc[at][row].tolist(), t.tolist(), strict=True))

    def share(self, words: np.ndarray, t: int) -> float:
        """Largest share of template t's weight that stands in place somewhere with all key phrases; 0 if below SHARE.

        words: numbers of a text's words. The text's words of highest IDF are looked up in the template, as many as it
        takes that the others could not reach SHARE; each pair of a place in the text and one in the template proposes a
        relative position, and every proposal is verified.
        """
        places, slack = self.index.places[t], self.index.slack[t]
        own = np.flatnonzero(self.weight[words, t] * (words >= 0) > 0)
        present = np.unique(words[own])
        present = present[np.lexsort([present, -self.idf[present]])]
        rest = self.weight[present, t].sum() - np.cumsum(self.weight[present, t])
        rare = present[: int(np.argmax(rest < SHARE - 1e-9)) + 1]
        shifts = [np.subtract.outer(own[words[own] == w], np.flatnonzero(places == w)).ravel() for w in rare]
        shifts = np.unique(np.concatenate(shifts)) if shifts else np.empty(0, np.int64)
        # keys of (word, position), ascending, to ask for the next one at or after a position
        span = len(words) + 2 * (len(places) + SLACK) + 2
        held = np.sort(words[own].astype(np.int64) * span + own + len(places) + SLACK)
        held = np.append(held, np.iinfo(np.int64).max)
        best = 0.0
        step = max(1, (1 << 22) // len(places))
        for lo in range(0, len(shifts), step):
            part = shifts[lo : lo + step]
            want = places * span + np.add.outer(part, np.arange(len(places))) + len(places) + SLACK
            there = held[np.searchsorted(held, want - slack)] <= want + slack
            shares = (there * self.idf[places]).sum(1) / self.idf[places].sum()
            for i in np.flatnonzero(shares >= max(SHARE - 1e-9, best)):
                if all(self._has(words, key, int(part[i]) + at, slack) for key, at in self.index.keys[t]):
                    best = max(best, float(shares[i]))
        return best

    @staticmethod
    def _has(words: np.ndarray, key: np.ndarray, at: int, slack: int) -> bool:
        lo, hi = max(0, at - slack), min(len(words) - len(key), at + slack)
        return any(np.array_equal(words[s : s + len(key)], key) for s in range(lo, hi + 1))

    def scan(self, raw: list[bytes]) -> list[list]:
        """Of each text: n_words, n_base, first_word, last_word, base_labels, labels, score."""
        texts = Texts(raw, self.index)
        n = len(raw)
        starts = self.base(texts)
        n_base, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        labels: list[set[str]] = [set() for _ in raw]
        for phrase, at in zip(PHRASES, starts, strict=True):
            doc = texts.doc[at]
            place = at - texts.first[doc]
            np.add.at(n_base, doc, 1)
            np.minimum.at(first, doc, place)
            np.maximum.at(last, doc, place)
            for d in np.unique(doc):
                labels[d].add(phrase.label)
        base = [",".join(sorted(x)) for x in labels]
        score = (n_base > 0).astype(float)  # a phrase stands wholly
        for d, t in self.candidates(texts):
            if t >= len(PHRASES) and (found := self.share(texts.word[texts.first[d] : texts.first[d + 1]], t)):
                labels[d].add(self.index.templates[t].label)
                score[d] = max(score[d], min(found, 1.0))
        some = n_base > 0
        ends = lambda x: pa.array(x.astype(np.int64), mask=~some)
        return [pa.array(np.diff(texts.first).astype(np.int64)), pa.array(n_base), ends(np.where(some, first, 0)), ends(last), pa.array(base), pa.array([",".join(sorted(x)) for x in labels]), pa.array(score)]


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that have each licence word, and all texts as word -1."""
    index = Index()
    found, rows = np.zeros(len(index.words), np.int64), 0
    for batch in batches:
        texts = _bytes(batch.column(0))
        rows += len(texts)
        for lo, hi in chunks(texts):
            found += np.bincount(Texts(texts[lo:hi], index).pairs[1], minlength=len(found))
    yield pa.record_batch([pa.array(np.arange(-1, len(found))), pa.array(np.concatenate(([rows], found)))], ["word", "n"])


def find_licenses(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Licences in the texts of docs (text and the kept columns; others are ignored).

    Returns one row per row of docs: the kept columns, n_words, n_base (places where a base phrase's words stand
    consecutively), first_word and last_word (their smallest and largest start, from 0; null without any), base_labels and
    labels (distinct, sorted, comma-joined; labels has base_labels and those of the templates found), score (largest share
    of a found template's weight; a base phrase counts as a template wholly there; 0 without any). Null and empty texts
    have no words. Repeated rows get a row each. An empty table gives no rows.

    Words are weighed by their IDF in all of docs. Texts are read twice: for the counts, of which one row for each licence
    word (some hundreds, bounded by the templates) comes to the driver, and for the scan.
    """
    counts = {r.word: r.n for r in docs.select("text").mapInArrow(_frequencies, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    n_with = np.array([counts.get(i, 0) for i in range(len(Index().words))])
    n_texts = counts.get(-1, 0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(Index(), n_texts, n_with)
        for batch in batches:
            texts = _bytes(batch.column(1))
            for lo, hi in chunks(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *scanner.scan(texts[lo:hi])], ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    fields = ", ".join(f"`{c}`: {t}" for c, t in docs.select(*keep).dtypes)
    found = docs.select(F.struct(*keep).alias("id"), "text").mapInArrow(scan, f"id struct<{fields}>, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    return found.select("id.*", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
