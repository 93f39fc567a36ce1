"""Licence scan by a positional index of rare words.

Licence notices are templates of words. The index holds for every template word the templates and
places it has. Words are weighted by their inverse document frequency over all texts. In a text, the
licence words of highest weight are looked up, and their template postings are intersected by
relative position (place in text minus place in template). A template is reported when the weight of
its words found at one relative position reaches ``LEAST`` of its whole weight and each of its key
phrases stands there. Base phrases are reported wherever their words stand consecutively.

Defined results: null text reads as empty: no words, no labels (empty strings), null places, score 0.
Repeated rows are each reported; other columns are not read; a null doc_id stays null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.llm import kernels

WORD_BYTES = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
LEAST = 0.8
#: Rare words of a text that are looked up for each template word they could belong to.
SLACK = 1

#: Fixed values of the contract: phrase and label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Label, notice, key phrases that must stand in place.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("hereby granted free of charge",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license version 2",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa", ("cc by sa",)),
    ("cc-by-nd", "licensed under cc by nd", ("cc by nd",)),
    ("cc0", "released under cc0 public domain", ("cc0",)),
    ("creative-commons", "licensed under a creative commons attribution license", ("creative commons attribution",)),
    ("public-domain", "dedicated to the public domain", ("public domain",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
)


def word_hashes(words: list[str]) -> list[int]:
    hasher = kernels.WordHasher(WORD_BYTES)
    raw = " ".join(words).encode()
    _, _, hashes, _ = hasher(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return [int(h) for h in hashes]


class Notices:
    """Templates and base phrases as positional postings of word numbers."""

    def __init__(self, templates=TEMPLATES, base=BASE, idf: dict[str, float] | None = None):
        phrases = [p for _, t, keys in templates for p in (t, *keys)] + [p for p, _ in base]
        self.words = sorted({w for p in phrases for w in p.split()})
        number = {w: i for i, w in enumerate(self.words)}
        hashes = np.array(word_hashes(self.words), np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.base = [([number[w] for w in p.split()], label) for p, label in base]
        self.templates = [
            (label, [number[w] for w in t.split()], [[number[w] for w in k.split()] for k in keys])
            for label, t, keys in templates
        ]
        self.idf = np.array([(idf or {}).get(w, 1.0) for w in self.words])
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for t, (_, words, _) in enumerate(self.templates):
            for place, w in enumerate(words):
                self.postings.setdefault(w, []).append((t, place))
        self.weight = [float(self.idf[words].sum()) for _, words, _ in self.templates]
        # The rarest words of each template find it; the others only confirm.
        self.seeds = set()
        for _, words, _ in self.templates:
            ranked = sorted(set(words), key=lambda w: (-self.idf[w], w))
            reach, whole = 0.0, float(self.idf[words].sum())
            for w in ranked:
                self.seeds.add(w)
                reach += float(self.idf[w]) * words.count(w)
                if reach > (1 - LEAST) * whole:
                    break

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The licence word at every place of a text, or -1."""
        spot = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[spot] == hashes, self.order[spot], -1)

    def judge(self, places: np.ndarray, numbers: np.ndarray):
        """(base starts, base labels, template labels, score) from the licence words of one text."""
        at = dict(zip(places.tolist(), numbers.tolist()))
        starts, base = [], set()
        for phrase, label in self.base:
            found = [p for p, w in at.items() if w == phrase[0] and all(at.get(p + i) == x for i, x in enumerate(phrase))]
            if found:
                starts += found
                base.add(label)
        labels, score = set(base), 1.0 if base else 0.0
        tried = set()
        for p, w in sorted(at.items(), key=lambda x: (-self.idf[x[1]], x[0])):
            if w not in self.seeds:
                continue
            for t, place in self.postings.get(w, ()):
                if (t, p - place) in tried:
                    continue
                tried.add((t, p - place))
                label, words, keys = self.templates[t]
                here = [w2 for i, w2 in enumerate(words) if at.get(p - place + i) == w2]
                share = float(self.idf[here].sum()) / self.weight[t]
                near = range(p - place - SLACK, p - place + len(words) + SLACK)
                if share >= LEAST and all(any(all(at.get(s + i) == x for i, x in enumerate(k)) for s in near) for k in keys):
                    labels.add(label)
                    score = max(score, min(1.0, share))
                elif label not in labels:
                    score = max(score, min(0.49, share / 2))
        return starts, base, labels, score


def _counting(notices):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hasher = notices.value, kernels.WordHasher(WORD_BYTES)
        texts, counts = 0, np.zeros(len(own.words), np.int64)
        for batch in batches:
            for _, _, data, bounds in kernels.chunks(batch.column(0)):
                _, _, hashes, first = hasher(data, bounds)
                number = own.numbers(hashes)
                at = np.flatnonzero(number >= 0)
                text = np.searchsorted(first, at, side="right") - 1
                seen = np.unique(text * len(own.words) + number[at])
                counts += np.bincount(seen % len(own.words), minlength=len(own.words))
                texts += len(bounds) - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([*own.words, None], pa.string()), pa.array([*counts, texts], pa.int64())], ["word", "n"]
        )

    return run


def _scanning(notices):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hasher = notices.value, kernels.WordHasher(WORD_BYTES)
        for batch in batches:
            for row, last, data, bounds in kernels.chunks(batch.column(1)):
                _, _, hashes, first = hasher(data, bounds)
                number = own.numbers(hashes)
                at = np.flatnonzero(number >= 0)
                cut = np.searchsorted(at, first)
                out = []
                for i in range(len(bounds) - 1):
                    own_at = at[cut[i] : cut[i + 1]]
                    starts, base, labels, score = own.judge(own_at - first[i], number[own_at])
                    out.append((len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, last - row).cast(pa.int64()),
                        pa.array(np.diff(first), pa.int64()),
                        pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                        pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.float64()),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return run


def scan_licences(docs: DataFrame, templates=TEMPLATES, base=BASE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): base phrases, all labels and a score."""
    spark = docs.sparkSession
    plain = spark.sparkContext.broadcast(Notices(templates, base))
    # As many rows as the templates have words.
    rows = docs.select("text").mapInArrow(_counting(plain), "word string, n bigint").groupBy("word").agg(F.sum("n")).collect()
    counts = {r[0]: r[1] for r in rows}
    texts = counts.pop(None, 0) or 0
    idf = {w: math.log((texts + 1) / (n + 1)) + 1 for w, n in counts.items()}
    notices = spark.sparkContext.broadcast(Notices(templates, base, idf))
    return docs.select("doc_id", "text").mapInArrow(
        _scanning(notices),
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    )
