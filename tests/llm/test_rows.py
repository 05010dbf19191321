"""Repeated rows, long texts and ids of other types in the training-data operators."""

import random
import resource
import subprocess
import sys
import time

import numpy as np
from pyspark.sql import functions as F

from pricelark.llm import decontaminate, language, licences, quality, simhash

DOC = "doc_id long, text string, lang string"


def test_copies_do_not_hide_a_language(spark):
    rows = [(1, "la misma frase de siempre", "es")] * 3000 + [(k, f"otra frase número {k} del idioma", "es") for k in range(2, 22)] + [(k, f"some other words {k} here", "en") for k in range(30, 40)]
    docs = spark.createDataFrame(rows, DOC)
    model = language.learn(docs, F.lit(True), sample=10)
    assert model.languages == ["en", "es"]
    once = language.learn(docs.distinct(), F.lit(True), sample=10)
    assert abs(once.units - model.units).max() < 1e-6  # copies change nothing


def test_copies_are_learnt_once_by_licences(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(licences, "fit", lambda lines: seen.append(lines))
    rows = [(1, "one line\nanother line", None)] * 200 + [(k, f"line of {k}\nanother line", None) for k in range(2, 30)]
    licences.learn(spark.createDataFrame(rows, DOC))
    assert sorted(b" ".join(x) for x in seen[0]) == sorted({b"one line", b"another line", *(b"line of %d" % k for k in range(2, 30))})


def test_copies_do_not_come_to_the_driver(spark):
    docs = spark.createDataFrame([(1, "good text of words", None)] * 3000 + [(k, f"text {k} of other words", None) for k in range(2, 12)], DOC)
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 12)], "doc_id long, quality int")
    model = quality.learn(docs, labels, F.lit(True), sample=10)
    assert len(model.labels if hasattr(model, "labels") else model.y) == 10


def test_spdx_lines_take_linear_time():
    model = licences.fit([b"some ordinary words".split()])
    slots = model.slots()
    took = []
    for n in (2000, 8000):
        text = b"\n".join(b"// SPDX-License-Identifier: " + (b"MIT", b"Apache-2.0 OR GPL-3.0-only")[k % 2] for k in range(n))
        start = time.perf_counter()
        found = licences.scan_text(text, model, slots)
        took.append(time.perf_counter() - start)
        assert {(x["line"], x["family"]) for x in found} >= {(0, "MIT"), (1, "Apache-2.0"), (1, "GPL-3.0"), (n - 2, "MIT")} and len(found) == n // 2 * 3
    assert took[1] < 8 * took[0] + 0.2
    odds = {x["family"]: x["probability"] for x in licences.scan_text(b"SPDX-License-Identifier: MIT\nSPDX-License-Identifier: ISC", model, slots)}
    assert set(odds) == {"MIT", "ISC"} and all(0.5 < p < 1 for p in odds.values())


def plain_scan(items, text, window):
    words = decontaminate.words_of(text)
    hit, held = set(), set()
    for number, item in enumerate(items):
        own = decontaminate.words_of(item)
        n = min(window, len(own))
        wanted = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
        for k in range(len(words) - n + 1):
            if own and tuple(words[k : k + n]) in wanted:
                hit.update(range(k, k + n))
                held.add(number)
    return len(words), hit, held


def test_long_texts_in_chunks():
    """Windows across cuts, short items, words longer than a chunk; equal to the plain rule whatever the cuts."""
    rng = random.Random(4)
    for _ in range(60):
        vocabulary = [b"a", b"bb", b"c\xc3\xa9", b"dddd", b"x" * rng.choice([1, 300])]
        items = [b" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 14))) for _ in range(4)]
        text = b" ".join(rng.choice([*vocabulary, b"zz", *items]) + rng.choice([b"", b",", b"\n"]) for _ in range(rng.randrange(80)))
        window = rng.choice([1, 2, 4])
        bench = decontaminate.Benchmark(list(enumerate(items)), window)
        n, spans, held = decontaminate.scan_long(bench, text, rng.randrange(1, 60))
        hit = {k for a, b in spans for k in range(a, b)}
        want = plain_scan(items, text, window)
        assert (n, hit, {int(bench.ids[i]) for i in held}) == want
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_memory_of_a_long_text():
    """50 MB of words in under 1 GB."""
    code = (
        "import random, resource; from pricelark.llm import decontaminate as d; rng = random.Random(1);"
        "w = [b'w%d' % k for k in range(2000)]; item = b' '.join(w[:12]); text = b' '.join(rng.choices(w, k=9_000_000)) + b' ' + item;"
        "n, spans, held = d.scan_long(d.Benchmark([(7, item)]), text, d.LONG_BYTES);"
        "assert n == 9_000_012 and spans[-1] == (n - 12, n) and len(text) > 45e6;"
        "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=False)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 1 << 20
    assert resource.RUSAGE_SELF == 0


def test_long_documents_through_the_operator(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "LONG_BYTES", 200)
    item = " ".join(f"w{k}" for k in range(15))
    docs = [(1, "x " * 90 + item + " y" * 90, None), (2, "short", None), (3, None, None), (4, "z " * 300, None)]
    got = {r["doc_id"]: r for r in decontaminate.digest_columns(decontaminate.find_hits(spark.createDataFrame(docs, DOC), spark.createDataFrame([(9, item)], "item_id long, text string"))).collect()}
    assert {k: (r["n_words"], r["n_hit"], r["n_items"]) for k, r in got.items()} == {1: (195, 15, 1), 2: (1, 0, 0), 3: (0, 0, 0), 4: (300, 0, 0)}


def test_ids_that_are_no_numbers(spark):
    rows = [("x7", "a b c d"), ("y8", "a b c d"), ("y8", "a b c d"), ("12", "q r s t"), ("5", "q r s t"), ("n", "q r s t"), (None, "other words here now"), (None, "other words here now"), ("z", "something else again")]
    kept = sorted(map(tuple, simhash.keep_one(spark.createDataFrame(rows, "doc_id string, text string")).collect()), key=str)
    assert kept == sorted([("x7", "a b c d"), ("5", "q r s t"), (None, "other words here now"), ("z", "something else again")], key=str)


def test_wavelet_ranks():
    rng = np.random.default_rng(3)
    for n in (1, 63, 64, 65, 511, 512, 513, 1700):
        symbols = rng.integers(0, 11, n)
        tree = decontaminate.Wavelet(symbols, 4)
        got, ranks = tree.access(np.arange(n))
        assert (got == symbols).all() and ranks.tolist() == [int((symbols[:i] == symbols[i]).sum()) for i in range(n)]
        for s in range(11):
            assert tree.rank(np.full(n + 1, s), np.arange(n + 1)).tolist() == [int((symbols[:i] == s).sum()) for i in range(n + 1)]
