"""Hashed word features of many texts at once, as arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np

from pricelark.llm.common import worker_table

#: Entries of a worker's table of word hashes; a full table starts anew.
TABLE = 500_000

#: Bytes of a text whose words are cut out at once.
PIECE = 1 << 20
_BETWEEN = re.compile(rb"[^0-9A-Za-z\x80-\xff]")

#: Bytes of a word's stem.
STEM = 4

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= TABLE:
            self.clear()
        h = self[word] = crc32(word) | crc32(word[:STEM]) << 32
        return h


def _hashes() -> _Hashes:
    return worker_table("hashes", _Hashes)


def cut(data: bytes, at: re.Pattern, size: int = PIECE) -> Iterator[bytes]:
    """Pieces of about `size` bytes; each but the last ends where the pattern, a byte between words, is found."""
    start = 0
    while start < len(data):
        found = at.search(data, start + size)
        end = found.end() if found else len(data)
        yield data[start:end] if start or end < len(data) else data
        start = end


def word_hashes(data: bytes | None) -> np.ndarray:
    """For each word (letters and digits, A-Z lower-cased), in order: its hash, and above it that of its stem.

    Words are cut out piece by piece, so a text takes 8 bytes a word.
    """
    found = []
    for piece in cut(data or b"", _BETWEEN):
        words = piece.translate(_LOWER).split()
        found.append(np.fromiter(map(_hashes().__getitem__, words), dtype=np.uint64, count=len(words)))
    return found[0] if len(found) == 1 else np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    return (x ^ (x >> np.uint64(29))) * _MIX


def gram_features(hashes: np.ndarray, bits: int, grams: int = 3, skips: int = 2) -> np.ndarray:
    """Hashed n-grams of 1 to `grams` words, pairs with 1 to `skips` words between them, and stems.

    The result isn't made distinct. Kinds are told apart by their salt.
    """
    made, shift = [], np.uint64(64 - bits)
    words, stems = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32)
    made.append(_mix(stems + np.uint64(1009)) >> shift)
    h = np.zeros(0, dtype=np.uint64)
    for n in range(1, grams + 1):
        if len(words) < n:
            break
        h = _mix(words + np.uint64(n)) if n == 1 else _mix(h[: len(words) - n + 1] + words[n - 1 :] * np.uint64(2 * n + 1))
        made.append(h >> shift)
    for gap in range(2, skips + 2):
        if len(words) > gap:
            made.append(_mix(_mix(words[:-gap] + np.uint64(101 * gap)) + words[gap:] * np.uint64(7)) >> shift)
    return np.concatenate(made).astype(np.int64)
