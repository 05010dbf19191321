"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text is counted over BINS hashed features: runs of two to four characters of
its shape (A for a capital, a for another letter, 0 for a digit, marks as they
are), its words, and how often a word repeats the one before. Counts are damped (log), weighted by inverse document
frequency and projected on the RANK leading right singular vectors of the
labelled sample, found by a randomised SVD with power iterations. The labelled
vectors are broadcast; every document is multiplied with all of them in
blocks (exact cosines, no index), and its NEIGHBOURS nearest vote with
similarity raised to POWER as their weight.

Training: at most SAMPLE labelled rows, chosen by the hash of their ids among
those the caller marks; their sparse counts go to the driver (at most BINS
numbers each). The broadcast has SAMPLE * RANK + BINS * (RANK + 1) numbers,
3 MB, whatever the size of the corpus.

Defined cases: a null or empty text, or one with no similar neighbour, gets
the share of label 1 in the sample; of neighbours that are equally near at the
edge, those that come first by hash, label and counts vote; null labels and labels without a document
aren't learnt; without labels every score is 0.5; repeated rows are learnt
once per distinct (id, label) and row, and scored each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelark.llm.common import materialise, pieces, with_batches
from pricelark.llm.hashing import word_hashes
from pricelark.llm.toxicity import sample_labelled

#: Half of the bins are for shapes, half for words.
BINS = 4096
RANK = 64
#: Bins of words that repeat the one before; several, to give it weight.
REPEATS = 8
#: Labelled rows that are held as neighbours, at most.
SAMPLE = 4_000
NEIGHBOURS = 25
POWER = 8
THRESHOLD = 0.7
#: Documents of a block of products, and bytes of a piece of a text.
BLOCK = 250
PIECE = 1 << 20
SEED = 10

_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else 32 if c in (9, 13, 32) else c for c in range(256))


def counts_of(data: bytes | None) -> np.ndarray:
    half = BINS // 2
    out = np.zeros(BINS, dtype=np.float32)
    if not data:
        return out
    shape = np.frombuffer(data.translate(_SHAPE), dtype=np.uint8)
    for k in range(0, len(shape), PIECE):  # overlaps by the longest run less one, counted once
        part = shape[max(0, k - 3) : k + PIECE].astype(np.uint32)
        skip = min(k, 3)
        code = part
        for n in (2, 3, 4):
            code = code[: len(part) - n + 1] * np.uint32(257) + part[n - 1 :]
            bins = (code[max(0, skip - n + 1) :] * np.uint32(2654435761)) >> np.uint32(21)
            out[:half] += np.bincount(bins, minlength=half)
    words = word_hashes(data) & np.uint64(0xFFFFFFFF)
    out[half - REPEATS : half] += np.count_nonzero(words[1:] == words[:-1])
    out[half:] += np.bincount(((words * np.uint64(2654435761)) >> np.uint64(13)).astype(np.int64) % half, minlength=half)
    return out


class Neighbours:
    """Labelled latent-semantic vectors and the projection that made them."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        half = BINS // 2
        self.labels = labels.astype(np.float32)
        self.base = float(labels.mean()) if len(labels) else 0.5
        self.idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 0.1).astype(np.float32)
        self.idf[half:] *= 0.5  # shapes tell more of quality than words do
        weighted = self._weigh(counts)
        self.projection = _right_vectors(weighted) if len(counts) else np.zeros((BINS, RANK), dtype=np.float32)
        self.vectors = _unit(weighted @ self.projection)

    def _weigh(self, counts: np.ndarray) -> np.ndarray:
        half = BINS // 2
        rate = counts.copy()
        for side in (slice(0, half), slice(half, BINS)):  # per thousand, so that length tells nothing
            rate[:, side] *= 1000 / np.maximum(counts[:, side].sum(axis=1, keepdims=True), 1)
        return _unit(np.log1p(rate) * self.idf)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        vectors = _unit(self._weigh(counts) @ self.projection)
        cosine = vectors @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = nearest(cosine, k)
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** POWER
        total = weight.sum(axis=1)
        vote = (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
        return np.clip(np.where(total > 1e-9, vote, self.base), 0.0, 1.0)


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest values of each row; of equal ones at the edge those that come first."""
    if k >= cosine.shape[1]:
        return np.broadcast_to(np.arange(cosine.shape[1]), cosine.shape)
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    edge = np.take_along_axis(cosine, near, axis=1).min(axis=1, keepdims=True)
    for r in np.flatnonzero((cosine >= edge).sum(axis=1) > k):
        above, level = np.flatnonzero(cosine[r] > edge[r]), np.flatnonzero(cosine[r] == edge[r])
        near[r] = np.concatenate((above, level[: k - len(above)]))
    return near


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _right_vectors(x: np.ndarray) -> np.ndarray:
    """The RANK leading right singular vectors (Halko, Martinsson, Tropp, 2011)."""
    draw = np.random.default_rng(SEED).standard_normal((x.shape[1], RANK + 16)).astype(np.float32)
    basis = x @ draw
    for _ in range(3):
        basis = np.linalg.qr(basis)[0]
        basis = x @ np.linalg.qr(x.T @ basis)[0]
    basis = np.linalg.qr(basis)[0]
    right = np.linalg.svd(basis.T @ x, full_matrices=False)[2][:RANK]
    out = np.zeros((x.shape[1], RANK), dtype=np.float32)
    out[:, : len(right)] = right.T
    return out


def _map_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "data"):
        at, values = [], []
        for x in b.column("data"):
            c = counts_of(x.as_py())
            some = np.flatnonzero(c)
            at.append(some.astype("<u2").tobytes())
            values.append(c[some].astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([b.column("h"), b.column("label"), pa.array(at, pa.binary()), pa.array(values, pa.binary())], names=["h", "label", "at", "counts"])


def learn(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", sample: int = SAMPLE) -> Neighbours:
    rows = materialise(with_batches(sample_labelled(docs, labels, label, usable, sample)).mapInArrow(_map_counts, "h long, label int, at binary, counts binary"), "quality-counts")
    # Equal rows are one with a number, and which rows count is decided on a short list, so that copies don't come to the driver.
    key = ["h", "label", "k"]
    named = rows.groupBy("h", "label", "at", "counts").agg(F.count("*").alias("n")).withColumn("k", F.xxhash64("at", "counts"))
    named = materialise(named, "quality-rows")
    listed = named.select(*key, "n").orderBy(*key).limit(sample).collect()
    wanted = rows.sparkSession.createDataFrame([tuple(r)[:3] for r in listed], "w_h long, w_label int, w_k long").distinct()
    met = named.join(F.broadcast(wanted), (F.col("h") == F.col("w_h")) & (F.col("label") == F.col("w_label")) & (F.col("k") == F.col("w_k")))
    several = sorted((r["h"], r["label"], bytes(r["at"]), bytes(r["counts"]), r["n"]) for r in met.toLocalIterator())
    got = list(islice((x[:4] for x in several for _ in range(min(x[4], sample))), sample))
    counts = np.zeros((len(got), BINS), dtype=np.float32)
    for k, (_, _, at, values) in enumerate(got):
        counts[k, np.frombuffer(at, dtype="<u2")] = np.frombuffer(values, dtype="<f4")
    return Neighbours(counts, np.array([y for _, y, _, _ in got], dtype=np.float32))


def _scorer(held) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in pieces(batches, "data"):
            column = b.column("data")
            scores = [model.score(np.array([counts_of(x.as_py()) for x in column.slice(k, BLOCK)])) for k in range(0, b.num_rows, BLOCK)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("marked"), pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], names=["doc_id", "marked", "score"])

    return run


def score(docs: DataFrame, model: Neighbours, marked: Column | None = None) -> DataFrame:
    """doc_id, marked, score for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), (F.lit(None).cast("boolean") if marked is None else marked).alias("marked"), F.col("text").cast("binary").alias("data"))
    return with_batches(rows).mapInArrow(_scorer(held), "doc_id long, marked boolean, score double")
