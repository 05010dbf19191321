"""Token-id output: Simple-8b word-aligned blocks, in ascending order of doc_id.

File format. A table is a folder of Parquet files without compression, used as
a container that any Hadoop file system can hold and that a lost executor's
task writes anew under Spark's commit protocol. A row is a block of
consecutive documents:

    part      int           range partition, in ascending order of doc_id
    block     int           number of the block in its part
    doc_ids   array<long>   ids of its documents (null stays null)
    counts    array<int>    ids (tokens) of each document
    offsets   array<int>    index of each document's first 64-bit word
    words     binary        little-endian 64-bit words

A word has its selector in the top four bits. Selectors 0 to 13 say that the
60 bits below hold SIZES[s] ids of WIDTHS[s] bits each, lowest first.
Selector 15 is an escape: the word after it is one id as it is, for ids that
need more than 60 bits. A document starts at a word of its own and no word is
padded, so a block is decoded either whole, all words of a selector at once,
or from any document's offset on.

Documents are encoded with the tokenizers library: what stands between white
space is normalised, split and handed to the library's model once and kept in
a bounded table; texts with added tokens, or chunks with characters on which
Unicode versions differ, are encoded by the library as they are.

Defined cases: null text = '' (only the end id); null doc_id sorts first;
repeated rows are written each; an empty table gives no blocks and no rows.
"""

from __future__ import annotations

import re
import string
import struct
import zlib
from collections.abc import Callable, Iterator
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelark.llm.bpe import _SETTLED, byte_alphabet
from pricelark.llm.common import materialise, pieces, shuffle_partitions, with_batches, worker_table

END_ID = 2
#: Entries of a worker's table of chunks; a full table starts anew.
TABLE = 1_000_000
#: Selector s: how many ids a word holds, and of how many bits.
SIZES = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15


def pack(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all documents' ids, one after the other, and the first word of each document."""
    n = len(ids)
    offsets = np.zeros(len(counts), dtype=np.int64)
    if not n:
        return np.zeros(0, dtype=np.uint64), offsets
    ids = ids.astype(np.uint64)
    ends = np.cumsum(counts)
    room = np.repeat(ends, counts) - np.arange(n)  # ids left in the document
    need = np.zeros(n, dtype=np.uint8)  # the least width that holds an id; len(WIDTHS) if none does
    short = ids.astype(np.uint32) if int(ids.max()) >> 32 == 0 else ids
    for w in WIDTHS:
        if w < 8 * short.itemsize:
            need += short >> short.dtype.type(w) != 0
    best = np.full(n, 13, dtype=np.int8)
    most, reach = need.copy(), 1  # the greatest need of this id and the next ones, `reach` in all
    for s in range(12, -1, -1):  # a selector that fits implies all those of fewer, wider ids
        while reach < SIZES[s] and reach < n:
            np.maximum(most[: n - reach], need[reach:], out=most[: n - reach])
            reach += 1
        fits = (most <= s) & (room >= SIZES[s])
        if not fits.any():
            break
        best[fits] = s
    best[need == len(WIDTHS)] = ESCAPE
    step = np.array((*SIZES, 0, 1))[best].tolist()
    starts, i = [], 0
    push = starts.append
    while i < n:
        push(i)
        i += step[i]
    begin = np.array(starts)
    which = best[begin]
    place = np.arange(len(begin)) + np.concatenate(([0], np.cumsum(which == ESCAPE)[:-1]))
    words = np.zeros(len(begin) + int((which == ESCAPE).sum()), dtype=np.uint64)
    for s in np.unique(which):
        rows = np.flatnonzero(which == s)
        if s == ESCAPE:
            words[place[rows]] = np.uint64(ESCAPE << 60)
            words[place[rows] + 1] = ids[begin[rows]]
            continue
        word = np.full(len(rows), int(s) << 60, dtype=np.uint64)
        for k in range(SIZES[s]):
            word |= ids[begin[rows] + k] << np.uint64(k * WIDTHS[s])
        words[place[rows]] = word
    first = np.searchsorted(begin, ends - counts)
    whole = np.append(place, len(words))
    return words, whole[first]


def unpack(words: np.ndarray) -> np.ndarray:
    """All ids of a run of words."""
    which = (words >> np.uint64(60)).astype(np.int64)
    if (which == ESCAPE).any():
        raw, k = np.zeros(len(words), dtype=bool), 0
        for k in np.flatnonzero(which == ESCAPE).tolist():
            if not raw[k]:  # a raw id may look like an escape
                raw[k + 1] = True
        which = np.where(raw, ESCAPE + 1, which)
    many = np.array((*SIZES, 0, 0, 1))[which]
    first = np.cumsum(many) - many
    ids = np.zeros(int(many.sum()), dtype=np.uint64)
    for s in np.unique(which):
        rows = np.flatnonzero(which == s)
        if s > ESCAPE:
            ids[first[rows]] = words[rows]
        elif s < ESCAPE:
            shifts = np.arange(SIZES[s], dtype=np.uint64) * np.uint64(WIDTHS[s])
            mask = np.uint64((1 << WIDTHS[s]) - 1)
            ids[first[rows][:, None] + np.arange(SIZES[s])] = words[rows][:, None] >> shifts & mask
    return ids


def _four_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordBPE(dict):
    """chunk -> its ids as little-endian 32-bit bytes, by way of the tokenizers library."""

    #: Controls that str.split() takes for white space and the library doesn't.
    odd = re.compile("[\x1c-\x1f]")

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.alphabet = byte_alphabet()
        self.find = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: What a mark that ends a chunk stands for, so that the word before it is shared with other chunks.
        self.marks = {c: _four_bytes(self._piece(c)) for c in string.punctuation}

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> list[int]:
        if not (piece.isascii() and piece.isprintable()):
            piece = "".join(map(self.alphabet.__getitem__, piece.encode()))
        return [t.id for t in self.model.tokenize(piece)]

    def __missing__(self, chunk: str) -> bytes:
        if not (chunk.isascii() or _SETTLED.fullmatch(chunk)):
            made = self._library(chunk)
        else:
            plain = chunk.lower() if chunk.isascii() else normalize("NFC", chunk).replace("Σ", "σ").lower()
            if plain[-1] in self.marks and (word := plain[:-1]).isalpha():
                made = self[word] + self.marks[plain[-1]]
            else:
                pieces = [plain] if plain.isalpha() else self.find(plain)
                made = _four_bytes([i for p in pieces for i in self._piece(p)])
        if len(chunk) <= 64:
            if len(self) >= TABLE:
                self.clear()
            self[chunk] = made
        return made

    def encode(self, text: str) -> np.ndarray:
        if self.odd.search(text) or any(t in text for t in self.added):
            made = self._library(text)
        else:
            made = b"".join(map(self.__getitem__, (text.lower() if text.isascii() else text).split()))
        return np.frombuffer(made, dtype="<u4")


def encoder(path: str) -> WordBPE:
    return worker_table(("word-bpe", path), lambda: WordBPE(path))


BLOCK_SCHEMA = "part int, block int, doc_ids array<long>, counts array<int>, offsets array<int>, words binary"


def _writer(path: str, end_id: int | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, block, part = encoder(path), 0, TaskContext.get().partitionId()
        end = np.array([] if end_id is None else [end_id], dtype="<u4")
        for b in pieces(batches, "text"):
            each = []
            for x in b.column("text"):
                each += [bpe.encode(x.as_py() or ""), end]
            counts = np.array([len(each[k]) + len(end) for k in range(0, len(each), 2)], dtype=np.int64)
            words, offsets = pack(np.concatenate(each), counts)
            ids = b.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([counts.tolist()], pa.list_(pa.int32())), pa.array([offsets.tolist()], pa.list_(pa.int32())), pa.array([words.astype("<u8").tobytes()], pa.binary())],
                names=["part", "block", "doc_ids", "counts", "offsets", "words"],
            )
            block += 1

    return run


def write_tokens(docs: DataFrame, tokenizer: str, to: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """Writes the token files of docs and returns the table of blocks, read from them.

    Texts are range-partitioned by doc_id (rows of one id by their hash), so
    the files are in order as a whole; nothing is sorted in one task.
    """
    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ranged = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id", "h").sortWithinPartitions("doc_id", "h")
    blocks = with_batches(ranged.select("doc_id", "text")).mapInArrow(_writer(tokenizer, end_id), BLOCK_SCHEMA)
    if to is None:
        return materialise(blocks, "token-files", compression="uncompressed")
    blocks.write.option("compression", "uncompressed").parquet(to)
    return read_blocks(docs.sparkSession, to)


def read_blocks(spark, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            counts = np.array(b.column("counts")[k].as_py(), dtype=np.int64)
            ids = unpack(np.frombuffer(b.column("words")[k].as_py(), dtype="<u8")).astype("<u4")
            begin = np.cumsum(counts) - counts
            crcs = [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(begin.tolist(), counts.tolist(), strict=True)]
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.column("doc_ids")[k].as_py(), pa.int64()), pa.array([b.column("part")[k].as_py()] * n, pa.int32()), pa.array([b.column("block")[k].as_py()] * n, pa.int32()), pa.array(begin), pa.array(counts), pa.array(crcs, pa.int64())],
                names=["doc_id", "part", "block", "inside", "n_tokens", "ids_crc32"],
            )


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            counts = b.column("counts")[k].as_py()
            ids = unpack(np.frombuffer(b.column("words")[k].as_py(), dtype="<u8")).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(b.column("doc_ids")[k].as_py(), pa.int64()), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])


def read_ids(blocks: DataFrame) -> DataFrame:
    """doc_id, ids of every document of the files."""
    return blocks.select("doc_ids", "counts", "words").mapInArrow(_ids, "doc_id long, ids array<long>")


def read_digests(blocks: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, from the files."""
    size = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    each = blocks.select("part", "block", size.alias("n"))
    # One row per part (bounded by the number of partitions), one per block inside a part.
    parts = each.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before_part"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = each.select("part", "block", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("before_block"))
    base = base.join(F.broadcast(parts), "part").select(F.col("part").alias("p"), F.col("block").alias("k"), (F.col("before_part") + F.col("before_block")).alias("base"))
    read = blocks.mapInArrow(_reader, "doc_id long, part int, block int, inside long, n_tokens long, ids_crc32 long")
    met = read.join(base, (read["part"] == base["p"]) & (read["block"] == base["k"]))
    return met.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
