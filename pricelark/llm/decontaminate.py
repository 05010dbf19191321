"""Benchmark decontamination with an FM-index per training shard.

Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased;
a window is WINDOW consecutive words of an item, or the whole item if it has
fewer (but not none). A document word inside any occurrence is hit.

A shard is a partition of documents, or as many of its documents in a row as
have SHARD_WORDS words to index; a text of more than LONG_BYTES is divided into
shards that overlap by a window less a word. Their words become ids of the benchmark's
vocabulary; a word that no item has is a break, because no window goes across
it, and so is a run of known words shorter than the shortest window. What is
left, with a break between runs, is indexed whole:

* suffix array by prefix doubling; Burrows-Wheeler transform of it;
* wavelet matrix of the transform, packed bits with a directory of popcounts for `rank`;
* backward search of all windows at once, last word first;
* suffix positions sampled every SAMPLE-th text position; occurrences are
  located by walking LF until a sampled row.

Spans of a document are merged; the span union gives the hit words.

Documents are neither shuffled nor joined. The benchmark's windows are read in
blocks of at most BLOCK_WINDOWS (an item with more is divided): one block is
broadcast (about 100 bytes a window), more are passed over one after the other
and their spans merged per document, whose row numbers are written before the
first pass.

Defined cases: a null or empty text has no words; a null item or one without
words has no window; items whose id is null are matched like any other, and
all of them together stand as one null at the end of the id list, which counts
but has no text;
repeated rows are told apart only by their position, each gets its own result;
no documents give no rows, no items give rows without hits.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelark.llm.common import forget_tables, materialise, pieces, with_batches
from pricelark.llm.fim import Bits

WINDOW = 10
SAMPLE = 8
#: Windows of the benchmark that are held on the driver and broadcast at once.
BLOCK_WINDOWS = 500_000
#: Words that an index holds, and rows and bytes that wait for it, at most.
SHARD_WORDS, SHARD_ROWS, SHARD_BYTES = 1 << 20, 50_000, 64 << 20
#: A longer text is a shard of its own for each so many of its bytes.
LONG_BYTES = 4 << 20

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


_NO_WORD = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def words_of(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(_KEEP).split()


class Wavelet:
    """Wavelet matrix over symbols below 2**bits: rank(symbol, position) for arrays. A level takes 1.4 bits a symbol."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.zeros, self.ones = bits, [], []
        now = symbols
        for k in range(bits - 1, -1, -1):
            bit = (now >> k & 1).astype(bool)
            self.ones.append(Bits.of(len(bit), lambda lo, hi, bit=bit: bit[lo:hi]))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate((now[~bit], now[bit]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(at), at.copy()
        for level, k in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            one = (symbol >> k & 1).astype(bool)
            lo1, hi1 = ones.rank(lo), ones.rank(hi)
            lo, hi = np.where(one, zeros + lo1, lo - lo1), np.where(one, zeros + hi1, hi - hi1)
        return hi - lo

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at positions, and their ranks there."""
        symbol, now, lo = np.zeros_like(at), at.copy(), np.zeros_like(at)
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            one = ones.at(now)
            symbol = symbol << 1 | one
            now1, lo1 = ones.rank(now), ones.rank(lo)
            now, lo = np.where(one, zeros + now1, now - now1), np.where(one, zeros + lo1, lo - lo1)
        return symbol, now - lo


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Prefix doubling; the last symbol is smaller than all others and occurs once."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    step = 1
    while True:
        key = rank * (max(n, int(rank.max()) + 2) + 1)
        key[: max(0, n - step)] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        if rank.max() == n - 1:
            return order
        step *= 2


class FMIndex:
    """Index of a text of symbols from 1 up; 0 is added as its end."""

    def __init__(self, text: np.ndarray, sigma: int):
        text = np.append(text.astype(np.int64), 0)
        order = suffix_array(text)
        bwt = text[order - 1]
        self.n = len(text)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.wavelet = Wavelet(bwt, max(1, int(sigma - 1).bit_length()))
        sampled = order % SAMPLE == 0
        self.sampled = Bits.of(self.n, lambda lo, hi: sampled[lo:hi])
        self.samples = order[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns, given padded on the left to a common width."""
        lo, hi = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        for back in range(1, patterns.shape[1] + 1):
            live = (lengths >= back) & (lo < hi)
            if not live.any():
                break
            symbol = patterns[live, -back]
            lo[live] = self.first[symbol] + self.wavelet.rank(symbol, lo[live])
            hi[live] = self.first[symbol] + self.wavelet.rank(symbol, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        found, now, steps = np.empty(len(rows), dtype=np.int64), rows.copy(), 0
        todo = np.arange(len(rows))
        while len(todo):
            done = self.sampled.at(now)
            found[todo[done]] = self.samples[self.sampled.rank(now[done])] + steps
            todo, now = todo[~done], now[~done]
            if len(todo):
                symbol, rank = self.wavelet.access(now)
                now = self.first[symbol] + rank
            steps += 1
        return found


class Benchmark:
    """Windows of a block of items, over a vocabulary of their words (ids from 2; 1 is a break)."""

    def __init__(self, items: list[tuple[int | str | None, bytes | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[str | None] = []
        rows, owners = [np.zeros((0, window), dtype=np.int32)], [np.zeros(0, dtype=np.int32)]
        for item_id, data in items:
            words = words_of(data)
            if not words:
                continue
            coded = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words], dtype=np.int32)
            if len(coded) < window:  # padded on the left with breaks
                coded = np.concatenate((np.ones(window - len(coded), dtype=np.int32), coded))
            rows.append(np.lib.stride_tricks.sliding_window_view(coded, window))
            owners.append(np.full(len(rows[-1]), len(self.ids), dtype=np.int32))
            self.ids.append(None if item_id is None else str(item_id))
        every, owner = np.concatenate(rows), np.concatenate(owners)
        order = np.lexsort((owner, *every.T))
        every, owner = every[order], owner[order]
        fresh = np.concatenate(([True], (every[1:] != every[:-1]).any(axis=1)))[: len(every)]
        self.patterns = every[fresh]
        self.lengths = (self.patterns > 1).sum(axis=1)
        self.shortest = int(self.lengths.min(initial=window))
        #: items of window w: owners[firsts[w] : firsts[w + 1]]
        self.owners, self.firsts = owner, np.append(np.flatnonzero(fresh), len(every))

    def scan(self, texts: list[bytes | None]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[int]]]:
        """Of each text: number of words, merged hit spans (in words), items with occurring windows."""
        shard = Shard(self)
        shard.add(texts)
        return shard.flush()


def merged(spans: list[tuple[int, int]], more: list[tuple[int, int]]) -> None:
    """Adds spans to a list of disjoint ones; all are in order, but the added ones may reach back over the last of the list."""
    back = []
    while more and spans and spans[-1][1] >= more[0][0]:
        back.append(spans.pop())
    for start, end in sorted([*back, *more]):
        if spans and start <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
        else:
            spans.append((start, end))


def chunks(data: bytes, size: int) -> Iterator[bytes]:
    """A text in pieces of about `size` bytes that end where a word ends."""
    at = 0
    while at < len(data):
        cut = _NO_WORD.search(data, at + size)
        end = cut.start() if cut else len(data)
        yield data[at:end]
        at = end


def scan_long(bench: Benchmark, data: bytes, size: int) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Benchmark.scan() of one long text, a chunk at a time; a chunk begins with the words before it that a window may still need."""
    width = bench.patterns.shape[1]
    n, tail, spans, items = 0, [], [], set()
    for chunk in chunks(data, size):
        whole = b" ".join([*tail, chunk])
        counts, found, held = bench.scan([whole])
        base = n - len(tail)
        merged(spans, [(base + start, base + end) for start, end in found[0]])
        items |= held[0]
        n = base + counts[0]
        tail = words_of(whole)[-(width - 1) :] if width > 1 else []
    return n, spans, items


class Shard:
    """Documents that wait to be indexed together."""

    def __init__(self, bench: Benchmark):
        self.bench = bench
        self._start()

    def _start(self) -> None:
        self.counts: list[int] = []
        self.symbols: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.base = self.size = 0

    def add(self, texts: list[bytes | None]) -> None:
        get, coded, counts = self.bench.vocabulary.get, [], []
        for data in texts:
            words = words_of(data)
            counts.append(len(words))
            coded.extend(map(get, words, _ones()))
            coded.append(1)
        made = np.array(coded, dtype=np.int32)
        kept = _long_runs(made, self.bench.shortest)
        self.counts += counts
        self.symbols.append(made[kept])
        self.places.append(kept + self.base)
        self.base += len(made)
        self.size += len(kept)

    def flush(self) -> tuple[list[int], list[list[tuple[int, int]]], list[set[int]]]:
        """What Benchmark.scan() says, for all that was added; then the shard is empty."""
        bench, counts = self.bench, self.counts
        spans: list[list[tuple[int, int]]] = [[] for _ in counts]
        items: list[set[int]] = [set() for _ in counts]
        if len(bench.lengths) and self.size:
            places = np.concatenate(self.places)
            index = FMIndex(np.concatenate(self.symbols), len(bench.vocabulary) + 2)
            lo, hi = index.search(bench.patterns, bench.lengths)
            many = np.maximum(hi - lo, 0)
            which = np.repeat(np.arange(len(many)), many)
            rows = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            begins = places[index.locate(rows)]
            offsets = np.concatenate(([0], np.cumsum(np.array(counts) + 1)))
            docs = np.searchsorted(offsets, begins, side="right") - 1
            order = np.lexsort((begins, docs))
            for d, w, at in zip(docs[order].tolist(), which[order].tolist(), (begins - offsets[docs])[order].tolist(), strict=True):
                items[d].update(bench.owners[bench.firsts[w] : bench.firsts[w + 1]].tolist())
                end = at + int(bench.lengths[w])
                if spans[d] and at <= spans[d][-1][1]:
                    spans[d][-1] = (spans[d][-1][0], max(end, spans[d][-1][1]))
                else:
                    spans[d].append((at, end))
        self._start()
        return counts, spans, items


def _sharded(bench: Benchmark, batches: Iterator[pa.RecordBatch], column: str, keep: list[str] | None) -> Iterator[tuple]:
    """Batches (of the named columns) with the counts, spans and items of their rows, a shard at a time."""
    shard, waiting, rows, size = Shard(bench), [], 0, 0

    def found() -> Iterator[tuple]:
        counts, spans, items = shard.flush()
        at = 0
        for b in waiting:
            yield b, counts[at : at + b.num_rows], spans[at : at + b.num_rows], items[at : at + b.num_rows]
            at += b.num_rows

    for b in pieces(batches, column):
        if (pc.max(pc.binary_length(b.column(column))).as_py() or 0) > LONG_BYTES:
            yield from found()
            waiting, rows, size = [], 0, 0
            done = [(0, [], set()) if x is None else scan_long(bench, x, LONG_BYTES) for x in b.column(column).cast(pa.binary()).to_pylist()]
            yield (b.select(keep) if keep else b), [x[0] for x in done], [x[1] for x in done], [x[2] for x in done]
            continue
        shard.add([None if x is None else x.encode() if isinstance(x, str) else x for x in b.column(column).to_pylist()])
        waiting.append(b.select(keep) if keep else b)
        rows, size = rows + b.num_rows, size + (b.nbytes if keep is None else 0)
        if shard.size >= SHARD_WORDS or rows >= SHARD_ROWS or size >= SHARD_BYTES:
            yield from found()
            waiting, rows, size = [], 0, 0
    if waiting:
        yield from found()


def _ones() -> Iterator[int]:
    while True:
        yield 1


def _long_runs(symbols: np.ndarray, least: int) -> np.ndarray:
    """Positions of the runs without a break of at least `least` words, each with the break behind it."""
    breaks = np.flatnonzero(symbols == 1)
    starts = np.concatenate(([0], breaks[:-1] + 1)) if len(breaks) else breaks
    long = breaks - starts >= least
    mark = np.zeros(len(symbols) + 1, dtype=np.int64)
    np.add.at(mark, starts[long], 1)
    np.add.at(mark, breaks[long] + 1, -1)
    return np.flatnonzero(np.cumsum(mark)[:-1] > 0)


def _blocks(benchmark: DataFrame, window: int) -> Iterator[list[tuple]]:
    """The items in blocks of at most BLOCK_WINDOWS windows; one block is on the driver at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("data"))
    for r in rows.toLocalIterator():
        words = words_of(bytes(r["data"]) if r["data"] is not None else None)
        left, at = max(1, len(words) - window + 1) if words else 0, 0
        while left:
            if size >= BLOCK_WINDOWS:
                yield block
                block, size = [], 0
            some = min(left, BLOCK_WINDOWS - size)
            block.append((r["item_id"], b" ".join(words[at : at + some + window - 1])))
            left, at, size = left - some, at + some, size + some
    yield block


def _mapper(held) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables("decontaminate")
        bench = held.value
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        names = ["doc_id", "row_no", "text_hash"]
        for b, counts, spans, items in _sharded(bench, batches, "data", names):
            found = [pa.array(counts, pa.int64()), pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], span), pa.array([[bench.ids[i] for i in sorted(x)] for x in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *found], names=[*names, "n_words", "spans", "items"])

    return run


SCHEMA = "doc_id long, row_no long, text_hash long, n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the spans, and joins the items, that several blocks found in one row."""
    for b in batches:
        spans, items = [], []
        for found in b.column("spans").to_pylist():
            out: list[dict] = []
            for x in sorted(found, key=lambda x: x["start"]):
                if out and x["start"] <= out[-1]["end"]:
                    out[-1]["end"] = max(x["end"], out[-1]["end"])
                else:
                    out.append(dict(x))
            spans.append(out)
        items = [sorted(set(x), key=lambda i: (i is None, i or "")) for x in b.column("items").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(n) for n in ("doc_id", "row_no", "text_hash", "n_words")] + [pa.array(spans, b.schema.field("spans").type), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "row_no", "text_hash", "n_words", "spans", "items"])


def _hits(rows: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """find_hits() of rows (doc_id, row_no, text_hash, data)."""
    held = lambda block: rows.sparkSession.sparkContext.broadcast(Benchmark(block, window))
    one_pass = lambda block: with_batches(rows).mapInArrow(_mapper(held(block)), SCHEMA)
    blocks = _blocks(benchmark, window)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return one_pass(first).withColumn("items", F.array_sort(F.array_distinct("items")))
    rows = materialise(rows, "hit-rows")  # all passes see the same row numbers
    both = materialise(one_pass(first), "hits")
    for block in chain([second], blocks):
        both = both.union(materialise(one_pass(block), "hits"))
    # A block is one more pass; the number of blocks, not of rows, bounds what meets here.
    met = both.groupBy("doc_id", "row_no", "text_hash", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return met.mapInArrow(merge_spans, SCHEMA)


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, row_no, text_hash, n_words, spans (merged, in words), items (ids as text, sorted, and a null for items without one)."""
    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("data"))
    return _hits(rows, benchmark, window)


def digest_columns(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated from the spans and items."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def clean_text(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans (and what stands between them)."""
    flat = data.translate(_KEEP)
    ends, at, words = [], 0, flat.split()
    for w in words:
        at = flat.index(w, at)
        ends.append((at, at + len(w)))
        at += len(w)
    out, last = [], 0
    for start, end in spans:
        out.append(data[last : ends[start][0]])
        last = ends[end - 1][1]
    return b"".join([*out, data[last:]])


def _cut(b: pa.RecordBatch, spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    """The batch with its texts cut (n_chars, if there, follows), without rows that have no word left."""
    texts = b.column("text").to_pylist()
    made = [x if not s else clean_text(x.encode(), s).decode() for x, s in zip(texts, spans, strict=True)]
    at = b.schema.get_field_index("text")
    b = b.set_column(at, b.schema.field(at), pa.array(made, b.schema.field(at).type))
    at = b.schema.get_field_index("n_chars")
    if at >= 0:
        chars = [n if not s else len(x) for n, s, x in zip(b.column(at).to_pylist(), spans, made, strict=True)]
        b = b.set_column(at, b.schema.field(at), pa.array(chars, b.schema.field(at).type))
    return b.filter(pa.array([not s or bool(words_of(x.encode())) for s, x in zip(spans, made, strict=True)], pa.bool_()))


def _cleaner(held, cut: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables("decontaminate")
        for b, _, spans, _ in _sharded(held.value, batches, "text", None):
            yield _cut(b, spans) if cut else b.filter(pa.array([not x for x in spans], pa.bool_()))

    return run


_ROW, _SPANS = "pricelark_row", "pricelark_spans"


def _cut_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = [[(x["start"], x["end"]) for x in s or ()] for s in b.column(_SPANS).to_pylist()]
        yield _cut(b.select([n for n in b.schema.names if n != _SPANS]), spans)


def decontaminate(docs: DataFrame, benchmark: DataFrame, cut: bool = False, window: int = WINDOW) -> DataFrame:
    """docs, with all columns, without contaminated rows; with `cut`, without the hit spans instead.

    A cut row whose text has no word left goes too; n_chars, if there, follows.
    A benchmark of several blocks is cut by the merged spans of all of them,
    which are joined to the rows by number.
    """
    blocks = _blocks(benchmark, window)
    first, second = next(blocks), next(blocks, None)
    if cut and second is not None:
        rows = materialise(docs.withColumn(_ROW, F.monotonically_increasing_id()), "cut-rows")
        named = rows.select(F.lit(None).cast("long").alias("doc_id"), F.col(_ROW).alias("row_no"), F.lit(None).cast("long").alias("text_hash"), F.col("text").cast("binary").alias("data"))
        hits = _hits(named, benchmark, window).where(F.size("spans") > 0).select(F.col("row_no").alias(_ROW), F.col("spans").alias(_SPANS))
        return with_batches(rows.join(hits, _ROW, "left").drop(_ROW)).mapInArrow(_cut_known, docs.schema)
    for block in chain([first], [] if second is None else [second], blocks):
        held = docs.sparkSession.sparkContext.broadcast(Benchmark(block, window))
        docs = with_batches(docs).mapInArrow(_cleaner(held, cut), docs.schema)
    return docs
