"""Fill-in-the-middle by succinct rank and select.

Tokens are runs of letters, or single other code points. A text's UTF-8 bytes
have two bitvectors of one bit a byte: where a token begins, and where a code
point begins. Each is packed into 64-bit words with a directory of popcounts
(a total per block of 512 bits, and the words' counts inside it), an eighth of
the text and 4 bits a byte of directory.

- n is the popcount of the text's part of the token bits (two ranks);
- the byte where token k begins is select(k);
- lengths in code points are ranks over the second bitvector.

The texts of a slice of an Arrow batch (8 MB, or one longer text) are worked on
together; bits are made in steps of a megabyte, so a long text needs little
more than itself. Nothing is shuffled.

Defined cases: a null text is empty; an empty text is plain, with n = 0; a null
doc_id takes the hash of the seed with '' as id; repeated rows are cut alike;
ids of any type are kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelark.llm.common import pieces, with_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Documents that are cut, of 100, and those of them whose suffix comes first.
CUT, SUFFIX_FIRST = 90, 20
SEED = 1

WORD, BLOCK = 64, 8  # bits of a word, words of a block
_STEP = 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123))] = True
_STARTS = (np.arange(256) & 0xC0) != 0x80  # not a continuation byte


class Bits:
    """A packed bitvector with rank and select over arrays of positions."""

    def __init__(self, words: np.ndarray):
        """words: uint64, a multiple of BLOCK of them."""
        self.words = words
        counts = np.bitwise_count(words).reshape(-1, BLOCK).astype(np.int64)
        inside = np.cumsum(counts, axis=1)
        self.inside = np.concatenate([np.zeros((len(counts), 1), np.int64), inside[:, :-1]], axis=1).astype(np.uint16)
        self.blocks = np.concatenate([[0], np.cumsum(inside[:, -1])]).astype(np.int64)

    @classmethod
    def of(cls, n: int, made) -> Bits:
        """n bits; made(lo, hi) gives those of a step as booleans."""
        packed = np.zeros(-(-(n + 1) // (WORD * BLOCK)) * BLOCK * 8, np.uint8)  # a zero bit follows, so that rank(n) is there
        for lo in range(0, n, _STEP):
            bits = np.packbits(made(lo, min(n, lo + _STEP)), bitorder="little")
            packed[lo // 8 : lo // 8 + len(bits)] = bits
        return cls(packed.view("<u8"))

    def at(self, at: np.ndarray) -> np.ndarray:
        """The bits at positions, as booleans."""
        return (self.words[at // WORD] >> (at % WORD).astype(np.uint64) & np.uint64(1)).astype(bool)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at // WORD, (at % WORD).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.blocks[word // BLOCK] + self.inside[word // BLOCK, word % BLOCK] + np.bitwise_count(below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Positions of the ones of rank k, each below the total."""
        block = np.searchsorted(self.blocks, k, side="right") - 1
        left = k - self.blocks[block]
        inside = self.inside[block]
        word = (inside <= left[:, None]).sum(axis=1) - 1
        left -= inside[np.arange(len(k)), word]
        at = block * BLOCK + word
        bits = np.unpackbits(np.ascontiguousarray(self.words[at]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return at * WORD + np.argmax(np.cumsum(bits, axis=1) > left[:, None], axis=1)


def bitvectors(data: np.ndarray, firsts: np.ndarray) -> tuple[Bits, Bits]:
    """(token starts, code point starts) of the bytes of several texts; firsts: where non-empty texts begin."""

    def tokens(lo: int, hi: int) -> np.ndarray:
        letter = _LETTER[data[max(lo - 1, 0) : hi]]
        before = letter[:-1] if lo else np.concatenate([[False], letter[:-1]])
        now = letter[1:] if lo else letter
        found = _STARTS[data[lo:hi]] & ~(now & before)
        own = firsts[np.searchsorted(firsts, lo) : np.searchsorted(firsts, hi)]
        found[own - lo] = True
        return found

    return Bits.of(len(data), tokens), Bits.of(len(data), lambda lo, hi: _STARTS[data[lo:hi]])


def draws(doc_id: object, seed: int) -> list[int]:
    """Four 32-bit numbers from an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


_OUT = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def _cut(batch: pa.RecordBatch, seed: int, cut: int, suffix_first: int) -> pa.RecordBatch:
    texts = batch.column("data")
    ids = batch.column("doc_id").to_pylist()
    sizes = np.array([len(x) for x in texts.to_pylist()], np.int64) if texts.offset else np.diff(np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1]).astype(np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    whole = b"".join(x.as_py() for x in texts)
    data = np.frombuffer(whole, np.uint8)
    tokens, points = bitvectors(data, begins[sizes > 0])
    low = tokens.rank(begins)
    n = tokens.rank(ends) - low
    h = np.array([draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
    a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    cuts = []
    for k in (np.minimum(a, b), np.maximum(a, b)):
        at = ends.copy()
        inner = np.flatnonzero(k < n)
        at[inner] = tokens.select(low[inner] + k[inner])
        cuts.append(at)
    p_chars = points.rank(cuts[0]) - points.rank(begins)
    m_chars = points.rank(cuts[1]) - points.rank(cuts[0])
    forms, outputs = [], []
    marks = [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]
    for s, c, d, e, h3, h4 in zip(begins.tolist(), cuts[0].tolist(), cuts[1].tolist(), ends.tolist(), h[:, 2].tolist(), h[:, 3].tolist(), strict=True):
        text = whole[s:e]
        if not text or h3 % 100 >= cut or any(x in text for x in marks):
            forms.append("plain")
            outputs.append(text)
        elif h4 % 100 < suffix_first:
            forms.append("spm")
            outputs.append(b"".join((marks[1], whole[d:e], marks[0], whole[s:c], marks[2], whole[c:d])))
        else:
            forms.append("psm")
            outputs.append(b"".join((marks[0], whole[s:c], marks[1], whole[d:e], marks[2], whole[c:d])))
    plain = np.array([f == "plain" for f in forms], bool)
    columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(p_chars.astype(np.int64), pa.int64(), mask=plain), pa.array(m_chars.astype(np.int64), pa.int64(), mask=plain), pa.array(outputs, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=_OUT)


def fill_in_middle(docs: DataFrame, seed: int = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "data"):
            yield _cut(piece, seed, cut, suffix_first)

    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    schema = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string("n long, form string, prefix_chars long, middle_chars long, output binary").fields])
    return with_batches(rows).mapInArrow(run, schema).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from: its parts lie between markers that the text itself doesn't hold."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))  # either form begins with a marker
    after = lambda text, part, mark: F.substr(text, F.length(part) + F.lit(len(mark) + 1))

    def parts(first: str) -> tuple[Column, Column, Column]:
        one = F.substring_index(body, first, 1)
        rest = after(body, one, first)
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, after(rest, two, MIDDLE)

    prefix, suffix, middle = parts(SUFFIX)
    suffix_2, prefix_2, middle_2 = parts(PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_2, middle_2, suffix_2)).otherwise(output)
