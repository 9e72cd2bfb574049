"""License scans by a positional index of rare tokens.

The index holds, for each template, its words of the highest IDF over the corpus at hand, with their places. A file's
occurrences of these words are looked up; each votes for the places at which the template would have to begin. Where
votes of enough different rare words agree, give or take SLACK words, the template is a candidate there, and counts as
found if all of its key phrases stand in that stretch of the file. Base phrases are found as consecutive words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, map_slices, slices
from .shingles import ALNUM, word_hashes

#: Rare words of a template in the index, words that may be missing or added on the way, share of rare words that must agree.
RARE, SLACK, SHARE = 8, 4, 0.6
#: A rare word has at least this IDF (it is in a twentieth of the documents at most), unless its template has fewer than LEAST of them.
FLOOR, LEAST = 3.0, 2


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]


# Phrases and labels of the base, then notices and openings of public licences with the phrases that each must have.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("distribute this software for any purpose with or without fee",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("use this file except in compliance with the license",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2.0", "this program is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0-or-later", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license as published by the free software foundation", "version 3 of the license or")),
    Template("gpl-2.0-or-later", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license as published by the free software foundation", "version 2 of the license or")),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl-3.0", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms with or without modification are permitted",)),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("may be used to endorse or promote products derived from this software",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
    Template("cc0-1.0", "to the extent possible under law the author has waived all copyright and related rights creative commons zero cc0 1 0", ("waived all copyright and related",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    Template("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ("cc by nc sa 4 0",)),
    Template("cc-by-nc-nd-4.0", "licensed under cc by nc nd 4 0", ("cc by nc nd 4 0",)),
)


def _hashes(phrase: str) -> np.ndarray:
    data = np.frombuffer(phrase.encode(), np.uint8)
    return word_hashes(data, np.array([0, len(data)]), ALNUM)[0]


class Index:
    """Postings of the rare words: word, template, place. idf: by word hash; a word that the corpus lacks is the rarest."""

    def __init__(self, templates: tuple[Template, ...], idf: dict[int, float]):
        self.templates = templates
        self.keys = [[_hashes(k) for k in t.keys] for t in templates]
        self.sizes = np.array([len(_hashes(t.text)) for t in templates])
        rows, self.rare = [], []
        for t, template in enumerate(templates):
            words = _hashes(template.text).tolist()
            ranked = sorted(set(words), key=lambda w: (-idf.get(w, np.inf), w))[:RARE]
            ranked = [w for k, w in enumerate(ranked) if k < LEAST or idf.get(w, np.inf) >= FLOOR]
            self.rare.append(len(ranked))
            rows += [(w, t, p) for p, w in enumerate(words) if w in ranked]
        rows.sort()
        self.word = np.array([r[0] for r in rows], np.uint64)
        self.template, self.place = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        self.rare = np.array(self.rare)
        self.known, self.first = np.unique(self.word, return_index=True)
        self.count = np.diff(np.append(self.first, len(self.word)))

    def candidates(self, words: np.ndarray, doc: np.ndarray) -> dict[tuple[int, int], list[tuple[int, float]]]:
        """{(document, template): [(where it begins, share of rare words that agree)]}, from all occurrences in a slice."""
        slot = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        at = np.flatnonzero(self.known[slot] == words)
        n = self.count[slot[at]]
        post = np.repeat(self.first[slot[at]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = np.repeat(at, n)
        t, begin, d, w = self.template[post], at - self.place[post], doc[at], slot[at]
        order = np.lexsort((w, begin, t, d))
        t, begin, d, w = t[order], begin[order], d[order], w[order]
        out: dict[tuple[int, int], list[tuple[int, float]]] = {}
        # windows of beginnings within SLACK; two pointers over runs of the same document and template
        lo, votes = 0, {}
        for hi in range(len(t)):
            if hi and (d[hi] != d[hi - 1] or t[hi] != t[hi - 1]):
                lo, votes = hi, {}
            while begin[hi] - begin[lo] > SLACK:
                votes[w[lo]] -= 1
                if not votes[w[lo]]:
                    del votes[w[lo]]
                lo += 1
            votes[w[hi]] = votes.get(w[hi], 0) + 1
            share = len(votes) / self.rare[t[hi]]
            if share >= SHARE and len(votes) > 1:
                out.setdefault((int(d[hi]), int(t[hi])), []).append((int(begin[lo]), share))
        return out

    def found(self, words: np.ndarray, of: np.ndarray) -> dict[int, dict[str, float]]:
        """{document: {label: share}} after the key phrases are verified."""
        doc = np.repeat(np.arange(len(of) - 1), np.diff(of))
        out: dict[int, dict[str, float]] = {}
        for (d, t), places in self.candidates(words, doc).items():
            label = self.templates[t].label
            for begin, share in sorted(places, key=lambda x: -x[1]):
                lo, hi = max(int(of[d]), begin - SLACK), min(int(of[d + 1]), begin + int(self.sizes[t]) + 2 * SLACK)
                if all(len(places_of(words[lo:hi], key)) for key in self.keys[t]):
                    own = out.setdefault(d, {})
                    own[label] = max(own.get(label, 0.0), share)
                    break
        return out


def places_of(words: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the words of a phrase stand consecutively."""
    n = len(words) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(words[:n] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[words[at + k] == phrase[k]]
    return at


def corpus_idf(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[int, float]:
    """IDF of the templates' words over all documents; a row for each of these words, whatever the corpus."""
    wanted = np.unique(np.concatenate([_hashes(t.text) for t in templates]))
    bound_batches(docs.sparkSession)

    def run(batches):
        seen, total = np.zeros(len(wanted), np.int64), 0
        for _, data, at in slices(batches):
            words, of, _ = word_hashes(data, at, ALNUM)
            slot = np.minimum(np.searchsorted(wanted, words), len(wanted) - 1)
            hit = np.flatnonzero(wanted[slot] == words)
            doc = np.searchsorted(of, hit, "right") - 1
            seen += np.bincount(np.unique(doc * len(wanted) + slot[hit]) % len(wanted), minlength=len(wanted))
            total += len(at) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.flatnonzero(seen), -1)), pa.array(np.append(seen[seen > 0], total))], names=["word", "n"])

    counts = {r.word: r.n for r in docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = counts.pop(-1, 0)
    return {int(wanted[w]): float(np.log((total + 1) / n)) for w, n in counts.items()}


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row for each row.

    Words are runs of ASCII letters, in lower case, ASCII digits and other scripts. A null or empty text has none, no
    places (first_word and last_word null), empty labels and score 0. score is the largest share of a template's rare words
    that agree, 1 where a base phrase stands. Repeated and null doc_ids don't matter; an empty table gives an empty one.
    """
    index = Index(templates, corpus_idf(docs, templates))
    base = [(_hashes(p), label) for p, label in BASE]
    kinds = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def kernel(batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        words, of, _ = word_hashes(data, at, ALNUM)
        n = len(at) - 1
        count, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        labels: dict[int, set[str]] = {}
        for phrase, label in base:
            places = places_of(words, phrase)
            doc = np.searchsorted(of, places, "right") - 1
            inside = places + len(phrase) <= of[doc + 1]
            places, doc = places[inside], doc[inside]
            count += np.bincount(doc, minlength=n)
            np.minimum.at(first, doc, places - of[doc])
            np.maximum.at(last, doc, places - of[doc])
            for d in np.unique(doc).tolist():
                labels.setdefault(d, set()).add(label)
        found = index.found(words, of) if len(words) else {}
        score = [1.0 if d in labels else max(found.get(d, {}).values(), default=0.0) for d in range(n)]
        own = [",".join(sorted(labels.get(d, ()))) for d in range(n)]
        every = [",".join(sorted(labels.get(d, set()) | set(found.get(d, ())))) for d in range(n)]
        none = count == 0
        columns = [batch.column(0), pa.array(np.diff(of)), pa.array(count), pa.array(first, mask=none), pa.array(last, mask=none), pa.array(own, pa.string()), pa.array(every, pa.string()), pa.array(score, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in kinds.split(", ")])

    return map_slices(docs.select("doc_id", "text"), kernel, kinds)
