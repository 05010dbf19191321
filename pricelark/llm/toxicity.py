"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

(McMahan et al., "Ad Click Prediction: a View from the Trenches", 2013.)
Features are the distinct hashed unigrams, bigrams, trigrams, pairs with one
or two words between them, and unigrams of word stems (so that forms of one
word that training didn't show still count), out of 2**BITS. Each coordinate has its own
learning rate; the L1 term keeps coordinates at zero until they have shown
enough, so the model is a short list of weights that is broadcast.

Training: at most SAMPLE labelled rows, chosen by the hash of their ids among
those the caller marks, and of these, in hash order, as many as have NUMBERS
distinct features between them (at least one). Only their feature numbers go
to the driver, 4 bytes each. Rows are taken in hash order, EPOCHS times.

Scoring is one pass over the documents without a shuffle; whole texts count,
piece by piece; a text takes 8 bytes a word.

Defined cases: null or empty text has no feature and gets the score of the
bias alone; a null label or a label without a document isn't learnt; repeated
rows are learnt and scored each; without labels every score is 0.5.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelark.llm.common import materialise, pieces, with_batches
from pricelark.llm.hashing import gram_features, word_hashes

BITS = 22
#: Labelled rows that are learnt, at most; a bound on what the driver holds.
SAMPLE = 8_000
#: Distinct features of all rows that are learnt, at most (256 MB on the driver).
NUMBERS = 64_000_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 0.0
THRESHOLD = 0.7
#: Words of a piece of a text when it is scored.
PIECE = 200_000


def features(data: bytes | None) -> np.ndarray:
    return np.unique(gram_features(word_hashes(data), BITS))


class FTRL:
    """Weights over 2**BITS coordinates and a bias (the last coordinate)."""

    def __init__(self, n: int = (1 << BITS) + 1):
        self.z, self.n, self.bias = np.zeros(n), np.zeros(n), n - 1

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == self.bias, 0.0, L1)
        w = -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, self.bias)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / ALPHA * w


class Model:
    """The weights that aren't zero, sorted by coordinate."""

    def __init__(self, trained: FTRL):
        at = np.flatnonzero(np.abs(trained.z[: trained.bias]) > L1)
        w = trained.weights(at)
        self.at, self.w = at[w != 0], w[w != 0].astype(np.float32)
        self.bias = float(trained.weights(np.array([trained.bias]))[0])

    def table(self) -> np.ndarray:
        """The weights by coordinate, zeros included (4 bytes each)."""
        dense = np.zeros(1 << BITS, dtype=np.float32)
        dense[self.at] = self.w
        return dense

    def score(self, data: bytes | None, dense: np.ndarray) -> float:
        words = word_hashes(data)
        hit = []
        for k in range(0, max(1, len(words)), PIECE):  # pieces overlap by the longest reach of a feature
            at = gram_features(words[max(0, k - 3) : k + PIECE], BITS)
            hit.append(np.unique(at[dense[at] != 0]))
        at = np.unique(np.concatenate(hit))
        margin = self.bias + float(dense[at].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(margin, -35, 35))))


def _map_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "data"):
        made = [features(x.as_py()).astype("<i4").tobytes() for x in b.column("data")]
        yield pa.RecordBatch.from_arrays([b.column("h"), b.column("label"), pa.array(made, pa.binary())], names=["h", "label", "at"])


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, usable: Column, sample: int) -> DataFrame:
    """h, label, data of at most `sample` labelled rows of docs; `usable` is over doc_id."""
    chosen = labels.where(usable & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    chosen = chosen.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "label").limit(sample).withColumnRenamed("doc_id", "label_id")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("h", "label", F.col("text").cast("binary").alias("data"))


def learn(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", sample: int = SAMPLE) -> Model:
    rows = materialise(with_batches(sample_labelled(docs, labels, label, usable, sample)).mapInArrow(_map_features, "h long, label int, at binary"), "toxic-features")
    # Which rows count is decided on a short list; equal entries of it are equal rows.
    key = ["h", "label", "n", "k"]
    named = rows.select("h", "label", (F.octet_length("at") / 4).cast("int").alias("n"), F.xxhash64("at").alias("k"), "at")
    wanted: Counter = Counter()
    numbers = 0
    for r in named.select(*key).orderBy(*key).limit(sample).collect():
        numbers += r["n"]
        if wanted and numbers > NUMBERS:
            break
        wanted[tuple(r)] += 1
    got = []
    for r in named.toLocalIterator():
        if wanted[tuple(r)[:4]] > 0:
            wanted[tuple(r)[:4]] -= 1
            got.append((*tuple(r)[:4], np.frombuffer(r["at"], dtype="<i4")))
    got.sort(key=lambda x: x[:4])
    trained = FTRL()
    for _ in range(EPOCHS):
        for _, y, _, _, at in got:
            trained.learn(at, y)
    return Model(trained)


def _scorer(held) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        dense = model.table()
        for b in pieces(batches, "data"):
            scores = pa.array([model.score(x.as_py(), dense) for x in b.column("data")], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("marked"), scores], names=["doc_id", "marked", "score"])

    return run


def score(docs: DataFrame, model: Model, marked: Column | None = None) -> DataFrame:
    """doc_id, marked, score for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), (F.lit(None).cast("boolean") if marked is None else marked).alias("marked"), F.col("text").cast("binary").alias("data"))
    return with_batches(rows).mapInArrow(_scorer(held), "doc_id long, marked boolean, score double")
