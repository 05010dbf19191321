"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1 (drawn from a seeded generator by
its code, so every process has the same). The vector of an n-gram binds its
letters: the vector of the k-th letter is rotated k places, and they are
multiplied. A text's vector bundles (sums) the vectors of all its n-grams; a
language's prototype bundles the normalised vectors of its training
documents. A document is compared with each prototype by cosine after both
had the mean of the prototypes taken off, which removes what all languages
share.

Text is lower-cased; everything that isn't a letter counts as one blank, and
runs of blanks as one, so n-grams see word beginnings and ends. Letters are
folded into CODES codes: a to z have their own, others share the rest by code
point.

A bundle is linear, so a batch counts its n-grams once (documents by distinct
n-grams) and multiplies the counts with the n-gram vectors, a block of n-grams
at a time. Vectors are kept as bytes; only a block of them is floats, so a
worker's memory doesn't follow the number of n-grams that it meets.

Training: at most SAMPLE documents of each language, chosen by the hash of
their ids, of those that the caller marks; their vectors are summed by language
in each Arrow batch, and only the sums go to the driver (8 * D bytes each),
never texts or counts of the corpus. Every value of lang is a language.

Defined cases: null text or one without a letter is `und` with score 0; null
lang isn't learnt; without any training document every row is `und`; ties go
to the language that is first by name; repeated rows each get their result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelark.llm.common import materialise, pieces, small, with_batches, worker_table

#: Dimensions, letters of an n-gram, codes of letters (0 is the blank).
D = 1024
N = 3
CODES = 64
#: Training documents of a language, at most.
SAMPLE = 500
SEED = 20
#: The prediction for texts without a letter.
UND = "und"
#: Documents whose counts are held at once, the characters they have together (unless one has more), n-grams that are
#: multiplied at once, and characters of a text that are coded at once.
GROUP, GROUP_CHARS = 128, 1 << 20
BLOCK = 2048
PIECE = 1 << 20
#: A text of so many n-grams whose cosine with every language is less is rejected. Random letters have up to 0.15 with the test
#: tables' profiles, one word of a language over and over 0.22 or more.
LONG, LEAST = 200, 0.18
#: Sharpness of the score: the softmax of cosine differences times this.
SHARP = 12.0


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], dtype=np.int8), (CODES, D))


def _code(c: int) -> int:
    x = chr(c)
    if not x.isalpha():
        return 0
    low = x.lower()[0]
    return ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % (CODES - 27)


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """Code of each character of the first plane; 0 for what isn't a letter."""
    return np.fromiter(map(_code, range(0x10000)), dtype=np.uint8, count=0x10000)


def ngrams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text, one number each; none if it has no letter."""
    found = [np.zeros(1, dtype=np.uint8)]
    for k in range(0, len(text), PIECE):
        points = np.frombuffer(text[k : k + PIECE].encode("utf-32-le", "replace"), dtype="<u4")
        codes = _codes()[np.minimum(points, 0xFFFF)]
        beyond = points > 0xFFFF
        if beyond.any():
            which, at = np.unique(points[beyond], return_inverse=True)
            codes[beyond] = np.array([_code(c) for c in which.tolist()], dtype=np.uint8)[at]
        found.append(codes)
    codes = np.concatenate((*found, found[0]))
    if not codes.any():
        return np.zeros(0, dtype=np.int32)
    codes = codes[(codes != 0) | np.concatenate(([True], codes[:-1] != 0))]
    made = np.zeros(max(0, len(codes) - N + 1), dtype=np.int32)
    for j in range(N):
        made *= CODES
        made += codes[j : len(codes) - N + 1 + j]
    return made


def vectors_of(grams: np.ndarray) -> np.ndarray:
    """Bound vectors of n-grams, as int8."""
    out = np.ones((len(grams), D), dtype=np.int8)
    for j in range(N):
        letter = grams // CODES ** (N - 1 - j) % CODES
        out *= np.roll(_letters(), N - 1 - j, axis=1)[letter]
    return out


class Bundler:
    """Document vectors; vectors of n-grams seen before are kept (at most HELD)."""

    HELD = 12_000

    def __init__(self) -> None:
        self.slot = np.full(CODES**N, -1, dtype=np.int32)
        self.table = np.empty((self.HELD, D), dtype=np.int8)
        self.held = 0

    def _keep(self, grams: np.ndarray) -> bool:
        """Gives each n-gram a slot; False if they are more than may be kept."""
        new = np.unique(grams[self.slot[grams] < 0])
        if self.held + len(new) > self.HELD:
            self.slot[:], self.held = -1, 0
            new = np.unique(grams)
            if len(new) > self.HELD:
                return False
        for k in range(0, len(new), BLOCK):
            some = new[k : k + BLOCK]
            self.slot[some] = self.held + np.arange(len(some))
            self.table[self.held : self.held + len(some)] = vectors_of(some)
            self.held += len(some)
        return True

    def bundle(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Vectors (documents by D), and the number of n-grams of each."""
        each = [ngrams(t) if t else np.zeros(0, dtype=np.int32) for t in texts]
        sizes = np.array([len(x) for x in each])
        out = np.zeros((len(texts), D), dtype=np.float32)
        if not sizes.sum():
            return out, sizes
        grams = np.concatenate(each)
        if self._keep(grams):
            at, vectors, width = self.slot[grams], self.table, self.held
        else:
            kinds, at = np.unique(grams, return_inverse=True)
            vectors, width = None, len(kinds)
        docs = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        for k in range(0, width, BLOCK):
            end = min(k + BLOCK, width)
            here = (at >= k) & (at < end)
            cells = docs[here] * (end - k) + (at[here] - k)
            counts = np.bincount(cells, minlength=len(texts) * (end - k)).reshape(len(texts), end - k)
            out += counts.astype(np.float32) @ (vectors_of(kinds[k:end]) if vectors is None else vectors[k:end]).astype(np.float32)
        return out, sizes


def groups(texts: list[str | None]) -> Iterator[slice]:
    """Runs of at most GROUP texts, of GROUP_CHARS characters together unless one has more."""
    at = chars = 0
    for k, t in enumerate(texts):
        chars += len(t or "")
        if k > at and (k - at == GROUP or chars > GROUP_CHARS):
            yield slice(at, k)
            at, chars = k, len(t or "")
    if at < len(texts):
        yield slice(at, len(texts))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _bundler() -> Bundler:
    return worker_table("bundler", Bundler)


def _map_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text"):
        texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
        sums: dict[str, np.ndarray] = {}
        for some in groups(texts):
            vectors, sizes = _bundler().bundle(texts[some])
            unit = _unit(vectors)
            for i in np.flatnonzero(sizes > 0).tolist():
                of = langs[some.start + i]
                sums[of] = sums.get(of, 0) + unit[i].astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.astype("<f8").tobytes() for x in sums.values()], pa.binary())], names=["lang", "vector"])


class Profiles:
    """Prototypes of languages, centred and of unit length."""

    def __init__(self, languages: list[str], sums: np.ndarray):
        self.languages = languages
        units = _unit(sums)
        self.mean = units.mean(axis=0) if len(languages) > 1 else np.zeros(D)
        self.prototypes, self.units = _unit(units - self.mean).astype(np.float32), units.astype(np.float32)

    def predict(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best language, its score from 0 to 1, and the greatest cosine with what a language's documents sum to."""
        unit = _unit(vectors)
        cosine = _unit(unit - self.mean) @ self.prototypes.T
        odds = np.exp(SHARP * (cosine - cosine.max(axis=1, keepdims=True)))
        best = cosine.argmax(axis=1)
        return best, (odds / odds.sum(axis=1, keepdims=True))[np.arange(len(best)), best], (unit @ self.units.T).max(axis=1)


def learn(docs: DataFrame, usable: Column, sample: int = SAMPLE) -> Profiles | None:
    """Profiles from text and lang of the rows where `usable` holds, lang isn't null and text has letters.

    Rows of one lang, id and text count once, so that copies can neither crowd
    a language's other rows out nor all be learnt.
    """
    keyed = docs.where(usable & F.col("lang").isNotNull() & (F.col("text").rlike(r"\p{L}"))).select("lang", F.xxhash64("doc_id", "text").alias("h"))
    keyed = materialise(keyed.distinct(), "language-keys")
    common = materialise(keyed.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("n")), "languages")
    if small(common):
        common = F.broadcast(common)
    # The hash lets about 2 * sample keys of each language through, however frequent it is; the window ranks only these.
    place = F.pmod("h", F.lit(1 << 40))
    few = keyed.join(common, F.col("lang") == F.col("l")).where(place < F.lit(2.0 * sample * (1 << 40)) / F.col("n"))
    first = Window.partitionBy("lang").orderBy(place, "h")
    chosen = few.withColumn("k", F.row_number().over(first)).where(F.col("k") <= sample).select(F.col("lang").alias("of"), "h")
    rows = docs.where(usable & F.col("lang").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("key"))
    chosen = materialise(chosen, "language-sample")
    rows = rows.join(F.broadcast(chosen) if small(chosen) else chosen, (F.col("key") == F.col("h")) & (F.col("lang") == F.col("of")), "left_semi")
    rows = rows.groupBy("lang", "key").agg(F.first("text").alias("text")).select("lang", "text")  # copies go before the shuffle
    found = materialise(with_batches(rows).mapInArrow(_map_vectors, "lang string, vector binary"), "language-vectors")
    sums: dict[str, np.ndarray] = {}
    for r in found.toLocalIterator():
        sums[r["lang"]] = sums.get(r["lang"], 0) + np.frombuffer(r["vector"], dtype="<f8")
    names = sorted(sums)
    return Profiles(names, np.array([sums[x] for x in names])) if names else None


def _predict(model: Profiles | None, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
    """Language, score, and whether the text is rejected (see keep_identified)."""
    names: list[str] = []
    scores: list[float] = []
    rejected: list[bool] = []
    for some in groups(texts):
        vectors, sizes = _bundler().bundle(texts[some])
        if model is None:
            names += [UND] * len(sizes)
            scores += [0.0] * len(sizes)
            rejected += (sizes == 0).tolist()
            continue
        best, score, like = model.predict(vectors)
        names += [model.languages[i] if n else UND for i, n in zip(best, sizes, strict=True)]
        scores += np.where(sizes > 0, score, 0.0).tolist()
        rejected += ((sizes == 0) | (sizes >= LONG) & (like < LEAST)).tolist()
    return names, scores, rejected


def _predictor(held) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            names, scores, _ = _predict(held.value, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), b.column("marked"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "text_hash", "marked", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Profiles | None, marked: Column | None = None) -> DataFrame:
    """doc_id, text_hash, marked, lang_pred, score for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), (F.lit(None).cast("boolean") if marked is None else marked).alias("marked"), "text")
    return with_batches(rows).mapInArrow(_predictor(held), "doc_id long, text_hash long, marked boolean, lang_pred string, score double")


def _keeper(held) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            names, _, rejected = _predict(held.value, b.column("text").to_pylist())
            at = b.schema.get_field_index("lang")
            if held.value is not None and at >= 0:
                b = b.set_column(at, b.schema.field(at), pa.array(names, b.schema.field(at).type))
            yield b.filter(pa.array([not x for x in rejected], pa.bool_()))

    return run


def keep_identified(docs: DataFrame, model: Profiles | None) -> DataFrame:
    """docs, with all columns, without rejected rows; `lang`, if there, becomes the prediction.

    Rejected are texts without a letter, and texts of LONG n-grams or more
    that are less like every language than LEAST: codes, random letters, and
    languages or scripts that no profile is of. Shorter texts show too little
    to be rejected. Without a model only letters tell, and lang stays.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return with_batches(docs).mapInArrow(_keeper(held), docs.schema)
