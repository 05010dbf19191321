"""Licence scan: a trained classifier of paragraphs, confirmed by templates.

A paragraph is a line, or a notice wrapped over neighbouring lines (see
below). Its features are hashed single words and pairs of
neighbouring words; a sparse softmax regression (AdaGrad with truncated L1)
gives the odds of each licence family, of `unknown` (a licence statement of no
known family) and of `none` (ordinary text). The odds are calibrated by a
temperature fitted on examples held out of training. A predicted family is
confirmed if the paragraph has at least CONFIRM of the word pairs of one of
its templates; if it isn't, the paragraph counts as `unknown`.

Wrapped notices: words of neighbouring lines (without an empty one, or one of
marks only, between) are read on. Where the word pairs of a template occur in
its order, with few words between, over several lines, and are at least
CONFIRM of it, these words are a paragraph if the odds agree that it is a
licence; its family is the likeliest one that a template confirms. Of
overlapping ones the one that has most of its template stays, and takes the
place of what its lines alone were. Its line is the first one.

SPDX tags: each identifier of a family in a tag's expression is found as such,
with the family's odds for a tag of that identifier alone; its template is the
identifier, so the similarity is 1.

Training: families from their templates and forms made from them (words
dropped, other openings, other text before or behind) and from SPDX tags; `unknown` from the same
openings with names that no family has; `none` from at most LINES lines of at
most SAMPLE documents, both chosen by hash: any line of a document may be, and
is taken whole. Lines that hold `licen` or half of a template are left out of
`none`, because they may be notices. Only those LINES lines go to the driver.

Scoring is one pass without a shuffle. Words whose features have no weight are
left out before weights of all classes are gathered.

Defined cases: null or empty text has no paragraph and the licence `none`;
lines of any length are scored whole; repeated rows are scored each.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelark.llm.common import pieces, with_batches
from pricelark.llm.hashing import _hashes, _mix

# Usual notices of public licences.
TEMPLATES: dict[str, list[str]] = {
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "Apache-2.0": ["Apache License, Version 2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License'],
    "BSD-2-Clause": ["BSD 2-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following two conditions are met"],
    "BSD-3-Clause": ["BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons Zero 1.0 Public Domain Dedication"],
    "GPL-2.0": ["GNU General Public License, version 2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "GPL-3.0": ["GNU General Public License, version 3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "ISC": ["ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "MIT": ["MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
}
OPENINGS = ["", "Licensed under the", "Licensed under", "Released under the", "This work is licensed under the", "This work is licensed under a", "Distributed under the", "This file is available under the terms of the", "SPDX-License-Identifier:", "Published under the", "This program is distributed under the"]

FAMILIES = sorted(TEMPLATES)
CLASSES = [*FAMILIES, "unknown", "none"]
UNKNOWN, NONE = len(FAMILIES), len(FAMILIES) + 1
BITS = 18
#: Documents whose lines are examples of `none`, and lines chosen of all their lines, at most.
SAMPLE, LINES = 400, 6_000
FORMS, EPOCHS, RATE, L1 = 40, 6, 0.5, 2e-4
THRESHOLD, CONFIRM = 0.5, 0.75
#: Words between two word pairs of a wrapped notice that its template hasn't, at most (prefixes of lines and the like).
BETWEEN = 8
SEED = 9

_LINE = 1
_TABLE = bytes(_LINE if c == 10 else c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BREAK = bytes([_LINE])


def words_of(data: bytes | None) -> list[bytes]:
    """Words (A-Z lower-cased), with a mark for each end of a line."""
    return (data or b"").translate(_TABLE).replace(_BREAK, b" " + _BREAK + b" ").split()


def _hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes().__getitem__, words), dtype=np.uint64, count=len(words)) & np.uint64(0xFFFFFFFF)


def _pair_features(hashes: np.ndarray) -> np.ndarray:
    return _mix(_mix(hashes[:-1]) + hashes[1:] * np.uint64(5)) >> np.uint64(64 - BITS)


def features(words: list[bytes], hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of words and pairs, the line each belongs to, and the number of words in each line."""
    hashes = _hashes_of(words) if hashes is None else hashes
    ends = np.fromiter((w == _BREAK for w in words), dtype=bool, count=len(words))
    line = np.cumsum(ends)
    word = ~ends
    one = _mix(hashes + np.uint64(1)) >> np.uint64(64 - BITS)
    both = word[:-1] & word[1:]
    two = _pair_features(hashes)
    made = np.concatenate((one[word], two[both])).astype(np.int64)
    lines = int(line[-1]) + 1 if len(words) else 0
    return made, np.concatenate((line[word], line[:-1][both])), np.bincount(line[word], minlength=lines)


def _pairs(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:], strict=False))


_TEMPLATE_PAIRS = {f: [_pairs(words_of(t.encode())) for t in ts] for f, ts in TEMPLATES.items()}


def similarity(words: list[bytes], family: str) -> float:
    """The share of a template's word pairs that the line has, for its best template."""
    have = _pairs(words)
    return max(len(have & t) / max(1, len(t)) for t in _TEMPLATE_PAIRS[family])


#: Family and number of distinct pairs of each template, and the places (template, place in it) of each pair.
_FLAT = [(f, len(p)) for f, ts in _TEMPLATE_PAIRS.items() for p in ts]
_PLACES: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}
for _t, _text in enumerate(t for ts in TEMPLATES.values() for t in ts):
    _w = words_of(_text.encode())
    for _j, _pair in enumerate(zip(_w, _w[1:], strict=False)):
        _PLACES.setdefault(_pair, []).append((_t, _j))


@lru_cache(maxsize=1)
def _template_slots() -> np.ndarray:
    """Whether a pair feature may be of a template."""
    out = np.zeros(1 << BITS, dtype=bool)
    for pair in _PLACES:
        out[_pair_features(_hashes_of(list(pair)))] = True
    return out


def wrapped(words: list[bytes], hashes: np.ndarray) -> list[tuple[int, int, str, list[bytes]]]:
    """Notices over several lines: first and last line, family, words."""
    ends = np.fromiter((w == _BREAK for w in words), dtype=bool, count=len(words))
    if not ends.any():
        return []
    line = np.cumsum(ends)[~ends]
    block = np.cumsum(np.concatenate(([0], np.diff(line) > 1)))
    at = np.flatnonzero(_template_slots()[_pair_features(hashes[~ends])] & (block[1:] == block[:-1])) if len(line) > 1 else line[:0]
    if not len(at):
        return []
    flat = [w for w in words if w != _BREAK]
    runs: dict[int, list[tuple[int, int, int, frozenset]]] = {}  # template -> last word, last place, first word, pairs had
    whole = []
    for p in at.tolist():
        pair = (flat[p], flat[p + 1])
        for t, j in _PLACES.get(pair, ()):
            live = [r for r in runs.get(t, ()) if block[r[0]] == block[p] and p - r[0] <= _FLAT[t][1] + BETWEEN]
            fit = [r for r in live if r[0] < p and r[1] < j and p - r[0] <= j - r[1] + BETWEEN]
            last = max(fit, key=lambda r: len(r[3]), default=None)
            new = (p, j, last[2] if last else p, (last[3] if last else frozenset()) | {pair})
            if last and last[1] == j - 1 and last[0] == p - 1:
                live.remove(last)  # it goes on without a gap, so nothing else can continue it
            runs[t] = [*live, new]
            share = len(new[3]) / _FLAT[t][1]
            if share >= CONFIRM and line[new[2]] < line[p + 1]:
                whole.append((-share, -len(new[3]), new[2], p + 1, t))
    out: list[tuple[int, int, str, list[bytes]]] = []
    free = np.ones(len(flat), dtype=bool)
    for _, _, a, b, t in sorted(whole):
        if free[a : b + 1].all():
            free[a : b + 1] = False
            out.append((int(line[a]), int(line[b]), _FLAT[t][0], flat[a : b + 1]))
    return out


_TAG = re.compile(rb"SPDX-License-Identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
_SPDX = {f.lower().encode(): f for f in FAMILIES} | {(f.lower() + x).encode(): f for f in FAMILIES if "GPL" in f for x in ("-only", "-or-later", "+")}


def tags(data: bytes) -> list[tuple[int, str, bytes]]:
    """Lines of SPDX tags, the families of their expressions, and the tag with that identifier alone; other identifiers are left to the classifier."""
    out, seen, line, at = [], set(), 0, 0
    for m in _TAG.finditer(data):
        parts = [x.strip(b".").lower() for x in re.findall(rb"[A-Za-z0-9.+-]+", m[1])]
        line, at = line + data.count(b"\n", at, m.start()), m.start()
        for i in range(0, len(parts), 2):
            if i and parts[i - 1] not in (b"and", b"or", b"with"):
                break
            family = _SPDX.get(parts[i])
            if family and not (i and parts[i - 1] == b"with") and (line, family) not in seen:
                seen.add((line, family))
                out.append((line, family, b"SPDX-License-Identifier: " + parts[i]))
    return out


class Model:
    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.at = np.flatnonzero((weights != 0).any(axis=1))
        self.weights, self.bias, self.temperature = weights[self.at], bias, temperature

    def slots(self) -> np.ndarray:
        """Row of the weights by coordinate; -1 for the others."""
        out = np.full(1 << BITS, -1, dtype=np.int32)
        out[self.at] = np.arange(len(self.at))
        return out

    def odds(self, made: np.ndarray, line: np.ndarray, sizes: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Calibrated odds of each class for each line."""
        slot = slots[made]
        some = slot >= 0
        slot, line = slot[some], line[some]
        order = np.argsort(line, kind="stable")
        slot, line = slot[order], line[order]
        margin = np.zeros((len(sizes), len(CLASSES)))
        if len(slot):
            starts = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
            margin[line[starts]] = np.add.reduceat(self.weights[slot], starts, axis=0)
        # Sums over a line's features are scaled by its length, as in training.
        margin = margin / np.sqrt(np.maximum(2 * sizes - 1, 1))[:, None] + self.bias
        odds = _softmax(margin / self.temperature)
        bare = np.ones(len(sizes), dtype=bool)
        bare[line] = False
        odds[bare] = 0.0  # nothing in the line speaks for a licence
        odds[bare, NONE] = 1.0
        return odds


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def _forms(background: list[list[bytes]]) -> list[tuple[int, list[bytes]]]:
    rng = np.random.default_rng(SEED)
    filler = background or [[b"text"]]

    def other(most: int) -> list[bytes]:
        line = filler[rng.integers(len(filler))]
        n = int(rng.integers(0, most + 1))
        at = int(rng.integers(0, max(1, len(line) - n + 1)))
        return line[at : at + n]

    out = []
    for k, family in enumerate(FAMILIES):
        for t in TEMPLATES[family]:
            body = words_of(t.encode())
            for j in range(FORMS):
                opening = words_of(OPENINGS[j % len(OPENINGS)].encode())
                kept = [w for w in body if j < len(OPENINGS) or len(body) < 8 or rng.random() > 0.05]
                out.append((k, other(6 if j % 3 == 0 else 0) + opening + kept + other(10 if j % 2 else 0)))
    for tag, family in _SPDX.items():
        for j in range(FORMS // 4):
            out.append((FAMILIES.index(family), (other(3) if j % 2 else []) + words_of(b"SPDX-License-Identifier: " + tag) + (other(3) if j % 3 == 2 else [])))
    for j in range(FORMS * 10):
        opening = words_of(OPENINGS[1 + j % (len(OPENINGS) - 1)].encode())
        tail = words_of((b"License", b"licence", b"Public License", b"terms", b"General License version 1")[j % 5])
        out.append((UNKNOWN, opening + other(4) + tail + other(6 if j % 2 else 0)))
    out += [(NONE, x) for x in background]
    order = rng.permutation(len(out))
    return [out[i] for i in order if out[i][1]]


def fit(background: list[list[bytes]]) -> Model:
    """Trains on forms of the templates and on background lines (lists of words)."""
    examples = [(y, features(x)) for y, x in _forms(background)]
    held, used = examples[::5], [x for k, x in enumerate(examples) if k % 5]
    w, g = np.zeros((1 << BITS, len(CLASSES)), dtype=np.float32), np.full((1 << BITS, len(CLASSES)), 1e-6, dtype=np.float32)
    bias = np.zeros(len(CLASSES))
    for _ in range(EPOCHS):
        for y, (made, _, sizes) in used:
            scale = 1 / np.sqrt(max(2 * int(sizes.sum()) - 1, 1))
            at = np.unique(made)
            p = _softmax(w[at].sum(axis=0) * scale + bias)
            p[y] -= 1
            bias -= 0.05 * p
            step = (p * scale).astype(np.float32)
            g[at] += step * step
            new = w[at] - RATE * step / np.sqrt(g[at])
            w[at] = np.sign(new) * np.maximum(np.abs(new) - L1 * RATE, 0)
    model = Model(w, bias, 1.0)
    slots = model.slots()
    margins = np.array([np.log(np.maximum(model.odds(m, line, n, slots)[0], 1e-30)) for _, (m, line, n) in held])
    truth = np.array([y for y, _ in held])
    grid = np.geomspace(0.25, 4, 33)
    loss = [-np.log(np.maximum(_softmax(margins / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def _map_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "data"):
        lines = []
        for x in b.column("data"):
            found = [y.split(b" ") for y in b" ".join(words_of(x.as_py())).split(_BREAK)]
            lines += [b" ".join(w for w in y if w) for y in found]
        lines = [x for x in lines if x and b"licen" not in x and max(similarity(x.split(), f) for f in FAMILIES) < 0.5]
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], names=["line"])


def learn(docs: DataFrame) -> Model:
    """Rows of one id and text count once, and so does a line however many of the chosen documents have it."""
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h")).where(F.col("doc_id").isNotNull()).distinct()
    chosen = keyed.orderBy("h", "doc_id").limit(SAMPLE).select(F.col("doc_id").alias("c"), "h")
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), (F.col("doc_id") == F.col("c")) & (F.xxhash64("doc_id", "text") == F.col("h")))
    rows = met.groupBy("c", "h").agg(F.first("text").alias("text")).select(F.col("text").cast("binary").alias("data"))  # copies go before the shuffle
    lines = with_batches(rows).mapInArrow(_map_lines, "line binary").distinct().orderBy(F.xxhash64("line"), "line").limit(LINES)
    return fit([x.split() for x in sorted(bytes(r["line"]) for r in lines.collect())])


_FOUND = pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())]))


def scan_text(data: bytes | None, model: Model, slots: np.ndarray) -> list[dict]:
    """Licence paragraphs of a text: line number, family or `unknown`, odds, similarity to its templates."""
    words = words_of(data)
    if not words:
        return []
    hashes = _hashes_of(words)
    made, line, sizes = features(words, hashes)
    odds = model.odds(made, line, sizes, slots)
    best = odds[:, :NONE].argmax(axis=1)
    licence = np.flatnonzero((1 - odds[:, NONE] >= THRESHOLD) & (sizes > 0))
    lines = [x.split() for x in b" ".join(words).split(_BREAK)] if len(licence) else []
    out = []
    for k in licence.tolist():
        family, alike = CLASSES[best[k]], 0.0
        if best[k] != UNKNOWN:
            alike = similarity(lines[k], family)
            if alike < CONFIRM:
                family = "unknown"
        out.append({"line": k, "family": family, "probability": float(1 - odds[k, NONE] if family == "unknown" else odds[k, best[k]]), "similarity": alike})
    more = []
    for first, last, _, notice in wrapped(words, hashes):
        p = model.odds(*features(notice), slots)[0]
        if 1 - p[NONE] >= THRESHOLD:
            # the classifier's order of families decides; a template must confirm, as that which was met does
            family = next(FAMILIES[k] for k in np.argsort(-p[:UNKNOWN], kind="stable") if similarity(notice, FAMILIES[k]) >= CONFIRM)
            more.append((first, last, {"line": first, "family": family, "probability": float(p[FAMILIES.index(family)]), "similarity": similarity(notice, family)}))
    for k, family, tag in tags(data):
        p = model.odds(*features(words_of(tag)), slots)[0]
        more.append((k, k, {"line": k, "family": family, "probability": float(p[FAMILIES.index(family)]), "similarity": 1.0}))
    if more:
        taken: dict[int, set[str]] = {}
        for first, last, x in more:
            for k in range(first, last + 1):
                taken.setdefault(k, {"unknown"}).add(x["family"])
        out = [y for y in out if y["family"] not in taken.get(y["line"], ())]
    return sorted(out + [x for _, _, x in more], key=lambda x: (x["line"], x["family"]))


def _scanner(held) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        slots = model.slots()
        for b in pieces(batches, "data"):
            found = [scan_text(x.as_py(), model, slots) for x in b.column("data")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, _FOUND)], names=["doc_id", "found"])

    return run


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, found (array of line, family, probability, similarity) for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data"))
    return with_batches(rows).mapInArrow(_scanner(held), "doc_id long, found array<struct<line:int,family:string,probability:double,similarity:double>>")
