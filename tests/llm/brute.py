"""Plain versions of the models: loops over words and texts, no batches, no Spark."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

import numpy as np

from pricelark.llm import hashing, language, licences, quality, toxicity

MASK = (1 << 64) - 1


def mix(x: int) -> int:
    x = x * 0x9E3779B97F4A7C15 & MASK
    return (x ^ x >> 29) * 0x9E3779B97F4A7C15 & MASK


def words(text: str | None) -> list[bytes]:
    out, now = [], bytearray()
    for c in (text or "").encode() + b" ":
        if 65 <= c <= 90:
            c += 32
        if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128:
            now.append(c)
        elif now:
            out.append(bytes(now))
            now = bytearray()
    return out


# --- toxicity: one dict of coordinates --------------------------------------------


def toxic_features(text: str | None, bits: int = toxicity.BITS) -> set[int]:
    ws = words(text)
    h = [zlib.crc32(w) for w in ws]
    found = {mix(zlib.crc32(w[: hashing.STEM]) + 1009) for w in ws}
    for i in range(len(h)):
        one = mix(h[i] + 1)
        found.add(one)
        for n in (2, 3):
            if i + n <= len(h):
                one = mix(one + h[i + n - 1] * (2 * n + 1) & MASK)
                found.add(one)
        for gap in (2, 3):
            if i + gap < len(h):
                found.add(mix(mix(h[i] + 101 * gap & MASK) + h[i + gap] * 7 & MASK))
    return {x >> 64 - bits for x in found}


def toxic_scores(labelled: list[tuple[str | None, int]], texts: list[str | None]) -> list[float]:
    z: dict = defaultdict(float)
    n: dict = defaultdict(float)

    def weight(at) -> float:
        l1 = 0.0 if at == "bias" else toxicity.L1
        if abs(z[at]) <= l1:
            return 0.0
        return -(z[at] - math.copysign(l1, z[at])) / ((toxicity.BETA + math.sqrt(n[at])) / toxicity.ALPHA + toxicity.L2)

    made = [([*sorted(toxic_features(t)), "bias"], y) for t, y in labelled]
    for _ in range(toxicity.EPOCHS):
        for at, y in made:
            w = {a: weight(a) for a in at}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - y
            for a in at:
                step = (math.sqrt(n[a] + g * g) - math.sqrt(n[a])) / toxicity.ALPHA
                z[a] += g - step * w[a]
                n[a] += g * g
    out = []
    for t in texts:
        margin = weight("bias") + sum(weight(a) for a in toxic_features(t))
        out.append(1 / (1 + math.exp(-max(-35, min(35, margin)))))
    return out


# --- language: one n-gram after another -------------------------------------------


def letter(c: str) -> int:
    if not c.isalpha():
        return 0
    low = c.lower()[0]
    return ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % (language.CODES - 27)


def bundle(text: str | None) -> tuple[np.ndarray, int]:
    codes = [0]
    for c in text or "":
        k = letter(c)
        if k or codes[-1]:
            codes.append(k)
    if not any(codes):
        return np.zeros(language.D), 0
    if codes[-1]:
        codes.append(0)
    table, total, count = language._letters().astype(np.int64), np.zeros(language.D), 0
    for i in range(len(codes) - language.N + 1):
        bound = np.ones(language.D, dtype=np.int64)
        for j in range(language.N):
            bound = bound * np.roll(table[codes[i + j]], language.N - 1 - j)
        total += bound
        count += 1
    return total, count


def unit(x: np.ndarray) -> np.ndarray:
    return x / max(float(np.sqrt((x * x).sum())), 1e-12)


def languages(labelled: list[tuple[str | None, str | None]], texts) -> list[tuple[str, float, bool]]:
    """Language, score and rejection of each text, with profiles of all labelled texts."""
    sums: dict[str, np.ndarray] = {}
    for t, name in labelled:
        v, n = bundle(t)
        if n and name is not None:
            sums[name] = sums.get(name, 0) + unit(v)
    names = sorted(sums)
    whole = {k: unit(sums[k]) for k in names}
    mean = sum(whole.values()) / len(names)
    own = {k: unit(whole[k] - mean) for k in names}
    out = []
    for t in texts:
        v, n = bundle(t)
        if not n:
            out.append((language.UND, 0.0, True))
            continue
        u = unit(v)
        centred = unit(u - mean)
        cosine = {k: float(centred @ own[k]) for k in names}
        best = max(names, key=lambda k: cosine[k])
        score = 1 / sum(math.exp(language.SHARP * (cosine[k] - cosine[best])) for k in names)
        like = max(float(u @ whole[k]) for k in names)
        out.append((best, score, n >= language.LONG and like < language.LEAST))
    return out


# --- quality: counts by loops, all cosines, a sort --------------------------------


def quality_counts(text: str | None) -> np.ndarray:
    half, out = quality.BINS // 2, np.zeros(quality.BINS)
    shape = []
    for c in (text or "").encode():
        shape.append(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else 32 if c in (9, 13, 32) else c)
    for n in (2, 3, 4):
        for i in range(len(shape) - n + 1):
            code = shape[i]
            for c in shape[i + 1 : i + n]:
                code = code * 257 + c & 0xFFFFFFFF
            out[(code * 2654435761 & 0xFFFFFFFF) >> 21] += 1
    h = [zlib.crc32(w) for w in words(text)]
    for a, b in zip(h, h[1:], strict=False):
        out[half - quality.REPEATS : half] += a == b
    for x in h:
        out[half + (x * 2654435761 >> 13) % half] += 1
    return out


def quality_scores(model: quality.Neighbours, texts: list[str | None]) -> list[float]:
    """By the model's own projection and neighbours, one document and one neighbour at a time."""
    half, out = quality.BINS // 2, []
    for t in texts:
        counts = quality_counts(t)
        for side in (slice(0, half), slice(half, quality.BINS)):
            counts[side] *= 1000 / max(counts[side].sum(), 1)
        v = unit(unit(np.log1p(counts) * model.idf) @ model.projection)
        cosine = [float(v @ x) for x in model.vectors]
        near = sorted(range(len(cosine)), key=lambda k: (-cosine[k], k))[: quality.NEIGHBOURS]
        weight = [max(cosine[k], 0) ** quality.POWER for k in near]
        total = sum(weight)
        out.append(sum(w * model.labels[k] for w, k in zip(weight, near, strict=True)) / total if total > 1e-9 else model.base)
    return out


# --- licences: one line, one feature and one class at a time ------------------------


def licence_odds(model: licences.Model, line: bytes) -> list[float]:
    ws = words(line.decode())
    h = [zlib.crc32(w) for w in ws]
    found = [mix(x + 1) >> 64 - licences.BITS for x in h] + [mix(mix(a) + b * 5 & MASK) >> 64 - licences.BITS for a, b in zip(h, h[1:], strict=False)]
    rows = {int(a): w for a, w in zip(model.at, model.weights, strict=True)}
    hit = [rows[f] for f in found if f in rows]
    if not hit:
        return [float(k == licences.NONE) for k in range(len(licences.CLASSES))]
    margins = []
    for k in range(len(licences.CLASSES)):
        margins.append((sum(float(w[k]) for w in hit) / math.sqrt(2 * len(ws) - 1) + float(model.bias[k])) / model.temperature)
    top = max(margins)
    e = [math.exp(m - top) for m in margins]
    return [x / sum(e) for x in e]


# --- BPE: the rule itself ---------------------------------------------------------


def bpe(word: bytes, merges: list[tuple[bytes, bytes]]) -> list[bytes]:
    rank = {m: k for k, m in reversed(list(enumerate(merges)))}
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        best = min((rank.get(p, len(rank)), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
        if best[0] == len(rank):
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts
