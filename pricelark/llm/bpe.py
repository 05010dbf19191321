"""BPE encoding and decoding with a tokenization automaton.

The automaton (after Berglund, Martens, van der Merwe, "Constructing a BPE
Tokenization DFA", 2024) reads tokens: a sequence of tokens is the encoding of
a word exactly if it is a path. It starts as one state with a loop for each
byte. The merges are applied in order; the gadget of a merge (u, v) -> w

* gives u a state of its own, a copy of the one that u led to without the
  v-arc (from now on v may not follow u);
* adds a w-arc wherever there was a u-arc, to where v leads.

So all arcs of one label lead to one state, each state has at most one arc of
a label, and the automaton is a table of bits: states by labels. States with
the same arcs share a row and labels with the same arcs share a column, from
the gadget that makes them until a later one tells them apart; for 50,000
merges that leaves some 15,000 rows of 11,000 bits (20 MB instead of 300). It
is compiled once, on the driver, and broadcast; its size depends on the
vocabulary alone.

A word is encoded in one pass from left to right, by tables. A trie of the
labels with suffix links gives the labels that end at each byte. Exactly one
of them has an arc from the state at its beginning; its state is the one after
this byte. At the end the tokens are read from the states backwards. Nothing
is searched or taken back.
Texts are decoded by emitting the labels of the arcs.

Before that, added tokens are cut out of the text, and the rest is split as
the tokenizer's ByteLevel pattern says. Chunks between single blanks are
looked up in a bounded table first; what is not in it takes the automaton.

Defined cases: null text = ''; '' has no tokens; special strings in a text
become their added token, as in the library; words of any length are encoded
whole; ids outside the vocabulary are left out when decoding, as the library
does.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelark.llm.common import pieces, with_batches, worker_table

#: Entries of the tables of chunks (about 35 MB when full) and of words; a full
#: table starts anew. They take what comes again: most chunks of a corpus are
#: names, numbers and codes that come once.
TABLE = 150_000
SMALL_TABLE = 60_000
#: Marks (a byte each) for what came once, and how many are set before they start anew.
MARKS, MARKED = 1 << 22, 1 << 19
#: Words longer than this aren't kept in the tables.
LONG = 64

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Blocks on which the two Unicode versions at hand agree; a text with other
#: characters is split by the library itself.
_SETTLED = regex.compile(r"[\x00-ɏ̀-ͰЀ-ԯḀ-ỿ -⁯⁰₠-₿←-⏿　-ヿ一-龥가-힣！-ￜ\U0001F300-\U0001F5FF\U0001F600-\U0001F64F]*")
#: A blank beside other white space, where splitting at blanks would be wrong.
_IRREGULAR = regex.compile(r"\s\s|^\s|\s$")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {}, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


_MARKS = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")


class _Table:
    """Bits by row and column, packed by column, that grows."""

    def __init__(self) -> None:
        self.bits = np.zeros((256, 32), dtype=np.uint8)
        self.bits[0, 0] = 1
        self.rows = self.columns = 1

    def get(self, row: int, column: int) -> int:
        return int(self.bits[row, column >> 3]) >> (column & 7) & 1

    def clear(self, row: int, column: int) -> None:
        self.bits[row, column >> 3] &= 0xFF ^ 1 << (column & 7)

    def copy_row(self, row: int) -> int:
        if self.rows == len(self.bits):
            self.bits = np.concatenate((self.bits, np.zeros_like(self.bits)))
        self.bits[self.rows] = self.bits[row]
        self.rows += 1
        return self.rows - 1

    def copy_column(self, column: int) -> int:
        at = self.columns
        if at == 8 * self.bits.shape[1]:
            self.bits = np.concatenate((self.bits, np.zeros_like(self.bits)), axis=1)
        self.bits[: self.rows, at >> 3] |= (self.bits[: self.rows, column >> 3] >> (column & 7) & 1) << (at & 7)
        self.columns += 1
        return at


class Automaton:
    """Tokenization automaton of a vocabulary of byte strings and its merges in order."""

    def __init__(self, vocabulary: dict[bytes, int], merges: Iterable[tuple[bytes, bytes]]):
        table, size = _Table(), max(vocabulary.values(), default=0) + 1
        row, column = [-1] * size, [-1] * size
        alone = [id_ for b, id_ in vocabulary.items() if len(b) == 1]
        for t in alone:
            row[t] = column[t] = 0
        of_row, of_column = [len(alone)], [len(alone)]  # how many states share a row, and labels a column
        for a, b in merges:
            u, v, w = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if row[u] < 0 or row[v] < 0 or not table.get(row[u], column[v]):
                continue  # v never follows u, so the merge never happens
            new = row[w] < 0
            if new:  # w leads to where v leads
                row[w] = row[v]
                of_row[row[v]] += 1
            if of_row[row[u]] > 1:
                of_row[row[u]] -= 1
                row[u] = table.copy_row(row[u])
                of_row.append(1)
            if of_column[column[v]] > 1:
                of_column[column[v]] -= 1
                column[v] = table.copy_column(column[v])
                of_column.append(1)
            table.clear(row[u], column[v])
            if new:  # and may stand wherever u may
                column[w] = column[u]
                of_column[column[u]] += 1
        width = (table.columns + 7) // 8
        rows = [table.bits[k, :width].tobytes() for k in range(table.rows)]
        #: label -> its length, token, arcs of its state, byte and bit of its own arc in a row
        self.label = {b: (len(b), t, rows[row[t]], column[t] >> 3, 1 << (column[t] & 7)) for b, t in vocabulary.items() if row[t] >= 0}
        self._reader()

    def _reader(self) -> None:
        """What finds the labels that end at a byte: a trie of all labels with links to the longest other suffix."""
        self.edges: dict[int, int] = {}  # node << 8 | byte -> node
        above, byte, depth, own = [0], [0], [0], [None]
        for x, hit in self.label.items():
            node = 0
            for c in x:
                key = node << 8 | c
                node = self.edges.get(key, 0)
                if not node:
                    node = self.edges[key] = len(above)
                    above.append(key >> 8)
                    byte.append(c)
                    depth.append(depth[key >> 8] + 1)
                    own.append(None)
            own[node] = hit
        self.suffix, self.ending = [0] * len(above), [()] * len(above)
        for node in sorted(range(1, len(above)), key=depth.__getitem__):
            at = above[node]
            while at:
                at = self.suffix[at]
                if (found := self.edges.get(at << 8 | byte[node])) is not None:
                    self.suffix[node] = found
                    break
            shorter = self.ending[self.suffix[node]]
            self.ending[node] = shorter if own[node] is None else (own[node], *shorter)

    def follows(self, state: bytes, label: bytes) -> bool:
        """Whether the state of one label has an arc of another."""
        *_, byte, bit = self.label[label]
        return self.label[state][2][byte] & bit != 0

    def encode(self, word: bytes) -> tuple[int, ...]:
        hit = self.label.get(word)
        if hit is not None:  # one arc from the beginning
            return (hit[1],)
        edge, suffix, ending = self.edges.get, self.suffix, self.ending
        arcs, tokens, starts = [b""], [0], [0]
        node = i = 0
        for c in word:
            i += 1
            at = edge(node << 8 | c)
            while at is None:
                if not node:
                    raise ValueError("a byte without a token")
                node = suffix[node]
                at = edge(node << 8 | c)
            node = at
            for size, token, row, byte, bit in ending[node]:  # longest first; exactly one fits
                if size == i or arcs[i - size][byte] & bit:
                    arcs.append(row)
                    tokens.append(token)
                    starts.append(i - size)
                    break
        out = []
        while i:
            out.append(tokens[i])
            i = starts[i]
        out.reverse()
        return tuple(out)


class ByteBPE:
    """Encoder and decoder of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        to_byte = {c: b for b, c in enumerate(byte_alphabet())}
        raw = {t: bytes(to_byte[c] for c in t) for t in model["vocab"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.automaton = Automaton({raw[t]: i for t, i in model["vocab"].items()}, ((raw[u], raw[v]) for u, v in merges))
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        self.added = added
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.labels: dict[int, bytes] = {i: raw[t] for t, i in model["vocab"].items()} | {i: t.encode() for t, i in added.items()}
        self.decimal: dict[int, bytes] = {i: str(i).encode() for i in self.labels}
        from tokenizers import Tokenizer

        self.pre = Tokenizer.from_file(path).pre_tokenizer
        self._start()

    def _start(self) -> None:
        self.find = regex.compile(PATTERN).findall
        self.words: dict[str, tuple[int, ...]] = {}
        self.first: dict[str, tuple[int, ...]] = {}
        self.later: dict[str, tuple[int, ...]] = {}
        self.marks, self.marked = bytearray(MARKS), 0

    def __getstate__(self) -> dict:
        """What is broadcast: everything but the tables of what was seen."""
        return {k: v for k, v in vars(self).items() if k not in ("find", "words", "first", "later", "marks", "marked")}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state)
        self._start()

    def _split(self, text: str) -> list[str]:
        if _SETTLED.fullmatch(text):
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.pre.pre_tokenize_str(text)]

    def _again(self, chunk: str) -> bool:
        """Whether a chunk, or one with its mark, came before; it is marked."""
        at = hash(chunk) % MARKS
        if self.marks[at]:
            return True
        if self.marked == MARKED:
            self.marks, self.marked = bytearray(MARKS), 0
        self.marks[at] = 1
        self.marked += 1
        return False

    def _word(self, word: str) -> tuple[int, ...]:
        ids = self.words.get(word)
        if ids is None:
            ids = self.automaton.encode(word.encode())
            if len(word) <= LONG and self._again(word):
                if len(self.words) >= SMALL_TABLE:
                    self.words.clear()
                self.words[word] = ids
        return ids

    def _chunk(self, chunk: str, blank: bool) -> tuple[int, ...]:
        """Ids of what stands between two blanks, with the blank before it. Letters, or letters and a mark, need no pattern."""
        table = self.later if blank else self.first
        if chunk and (chunk.isascii() or max(chunk) < "\u0250") and (chunk.isalpha() or chunk[-1] in _MARKS and chunk[:-1].isalpha()):
            if chunk[-1] in _MARKS:
                body = chunk[:-1]
                ids = (table.get(body) or self._chunk(body, blank)) + self._word(chunk[-1])
            else:
                ids = self.automaton.encode((" " + chunk if blank else chunk).encode())
        else:
            ids = tuple(chain.from_iterable(map(self._word, self._split(" " + chunk if blank else chunk))))
        if len(chunk) <= LONG and self._again(chunk):
            if len(table) >= TABLE:
                table.clear()
            table[chunk] = ids
        return ids

    def _plain(self, text: str) -> list[int]:
        if _IRREGULAR.search(text):
            return list(chain.from_iterable(map(self._word, self._split(text))))
        out: list[int] = []
        first, later, chunk_ids = self.first.get, self.later.get, self._chunk
        for n, line in enumerate(text.split("\n")):
            if n:
                out.extend(self._word("\n"))
            head, *rest = line.split(" ")
            out.extend(first(head) or chunk_ids(head, False))
            for chunk in rest:
                out.extend(later(chunk) or chunk_ids(chunk, True))
        return out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        out: list[int] = []
        for part in self.cut.split(text):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out.extend(self._plain(part))
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.labels.get, ids, _nothing())).decode("utf-8", "replace").encode()


def _nothing() -> Iterator[bytes]:
    while True:
        yield b""


@lru_cache(maxsize=2)
def compiled(path: str) -> ByteBPE:
    """The compiled tokenizer of a file; the driver compiles it once."""
    return ByteBPE(path)


_TYPES = {"ids": ("array<int>", pa.list_(pa.int32())), "n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}


def _encoder(held, path: str, outputs: tuple[str, ...], keep: tuple[str, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_table(("bpe", path), lambda: held.value)  # drops what other operators left in the worker
        decode = "decoded" in outputs or "decoded_sha256" in outputs
        for b in pieces(batches, "text"):
            made: dict[str, list] = {k: [] for k in _TYPES}
            for x in b.column("text"):
                ids = bpe.encode(x.as_py() or "")
                made["n_tokens"].append(len(ids))
                if "ids" in outputs:
                    made["ids"].append(np.array(ids, dtype=np.int32))
                if "ids_sha256" in outputs:
                    made["ids_sha256"].append(hashlib.sha256(b",".join(map(bpe.decimal.__getitem__, ids))).hexdigest())
                if decode:
                    text = bpe.decode(ids)
                    if "decoded" in outputs:
                        made["decoded"].append(text.decode())
                    if "decoded_sha256" in outputs:
                        made["decoded_sha256"].append(hashlib.sha256(text).hexdigest())
            own = ["doc_id", *keep]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), *(pa.array(made[k], _TYPES[k][1]) for k in outputs)], names=[*own, *outputs])

    return run


def bpe_encode(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("ids", "n_tokens"), keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, columns to keep and the named outputs for every row: ids, n_tokens, ids_sha256, decoded, decoded_sha256.

    decoded is made from the ids. Only the driver reads path.
    """
    held = docs.sparkSession.sparkContext.broadcast(compiled(path))
    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), *keep, "text")
    schema = ["doc_id long", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{k} {_TYPES[k][0]}" for k in outputs)]
    return with_batches(rows).mapInArrow(_encoder(held, path, outputs, keep), ", ".join(schema))


def _decoder(held, path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_table(("bpe", path), lambda: held.value)
        for b in batches:
            texts = [None if x is None else bpe.decode(x).decode() for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids (null ids give null)."""
    held = encoded.sparkSession.sparkContext.broadcast(compiled(path))
    rows = encoded.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return with_batches(rows).mapInArrow(_decoder(held, path), "doc_id long, text string")
