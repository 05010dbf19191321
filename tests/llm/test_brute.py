"""The operators against the plain versions in brute.py."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricelark.llm import bpe, common, decontaminate, exact_dedup, language, licences, quality, queries, simhash, toxicity
from tests.llm import brute
from tests.llm.test_text_ops import BIG, brute_components, brute_hits, table

TEXTS = [None, "", " \n", "Hola", "hola HOLA hola", "idiot idiot scum", "Das ist ein Satz. " * 30, "ÀÉ ñandú 12 ab12", "😀 😀", "a", "x" * 5000]


def labelled_rows(spark, sf, name, usable):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(usable & F.col(name).isNotNull())
    rows = docs.join(labels, "doc_id").select("text", F.col(name).alias("y"), F.xxhash64("doc_id").alias("h")).orderBy("h", "y").collect()
    return docs, [(r["text"], r["y"]) for r in rows]


def test_toxicity(spark, sf):
    usable = common.remainder(F.col("doc_id"), 3) != 1
    docs, rows = labelled_rows(spark, sf, "toxic", usable)
    got = {r["doc_id"]: r["score"] for r in queries.op1_toxicity(spark, sf).collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = dict(zip(text, brute.toxic_scores(rows, list(text.values())), strict=True))
    assert len(rows) > 50 and all(abs(got[i] - want[i]) < 1e-5 for i in want)
    for t in TEXTS:
        assert set(toxicity.features(None if t is None else t.encode()).tolist()) == brute.toxic_features(t)


def test_toxicity_sample_bound(spark, monkeypatch):
    """Rows are learnt in hash order until the bound on numbers, repeated rows until the bound on rows."""
    docs = table(spark, [(k, f"palabra{k} comun idiota") for k in range(40)] + [(0, "otra vez comun")] * 5)
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity.FTRL, "learn", lambda self, at, y: seen.append((len(at), y)))
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    toxicity.learn(docs, labels, F.lit(True), sample=10)
    assert len(seen) == 10
    seen.clear()
    monkeypatch.setattr(toxicity, "NUMBERS", 50)
    toxicity.learn(docs, labels, F.lit(True))
    assert 1 <= len(seen) and sum(n for n, _ in seen) <= 50


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("held", common.remainder(F.col("doc_id"), 4) == 2).collect()
    named = brute.languages([(r["text"], r["lang"]) for r in docs if not r["held"]], [r["text"] for r in docs])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries.op6_language_id(spark, sf).collect()}
    for r, (name, score, _) in zip(docs, named, strict=True):
        assert got[r["doc_id"]][0] == name and abs(got[r["doc_id"]][1] - score) < 1e-3
    bundler = language.Bundler()
    for t in TEXTS:
        v, n = brute.bundle(t)
        vectors, sizes = bundler.bundle([t])
        assert sizes[0] == n and np.allclose(vectors[0], v)


def test_language_rejects(spark, sf):
    """Letters in no language's order go, short texts and words of a language stay; lang becomes the prediction."""
    rng = random.Random(3)
    junk = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz      ", k=4000))
    model = language.learn(spark.read.parquet(f"{BIG}/documents.parquet"), F.lit(True))
    docs = table(spark, [(1, junk), (2, "ACGT" * 500), (3, "Привет мир, как дела сегодня? " * 20), (4, "Xzqk vvb."), (5, "The " * 300), (6, "12 34")])
    assert sorted(r["doc_id"] for r in language.keep_identified(docs, model).collect()) == [4, 5]
    real = spark.read.parquet(f"{BIG}/documents.parquet")
    kept = language.keep_identified(real, model)
    assert kept.count() == real.where(F.col("text").rlike(r"\p{L}")).count()
    both = kept.select("doc_id", F.col("lang").alias("now")).join(real, "doc_id").where("lang IS NOT NULL")
    assert both.where("now <> lang").count() <= 0.02 * both.count() and kept.where("lang IS NULL").count() == 0


def test_quality(spark, sf):
    usable = common.remainder(F.col("doc_id"), 4) != 2
    docs, rows = labelled_rows(spark, sf, "quality", usable)
    model = quality.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"), usable)
    assert sorted(model.labels.tolist()) == sorted(y for _, y in rows)
    counts = np.array([brute.quality_counts(t) for t, _ in rows])
    exact = np.linalg.svd(model._weigh(counts.astype(np.float32)).astype(np.float64), full_matrices=False)
    kept = np.linalg.norm(model._weigh(counts.astype(np.float32)) @ model.projection) ** 2
    assert kept >= 0.99 * (exact[1][: quality.RANK] ** 2).sum()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = dict(zip(text, brute.quality_scores(model, list(text.values())), strict=True))
    got = {r["doc_id"]: r["score"] for r in queries.op10_quality(spark, sf).collect()}
    assert all(abs(got[i] - want[i]) < 1e-3 for i in want)
    for t in TEXTS:
        assert np.array_equal(quality.counts_of(None if t is None else t.encode()), brute.quality_counts(t))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=7, max_size=7), min_size=1, max_size=4), st.integers(1, 9))
def test_quality_ties(rows, k):
    cosine = np.array(rows, dtype=np.float32)
    for r, near in zip(rows, quality.nearest(cosine, k), strict=True):
        assert sorted(near.tolist()) == sorted(sorted(range(7), key=lambda j: (-r[j], j))[:k])


@pytest.fixture(scope="module")
def licence_model(spark):
    return licences.learn(spark.read.parquet(f"{BIG}/documents.parquet"))


def test_licence_odds(licence_model):
    slots = licence_model.slots()
    lines = [t.encode() for ts in licences.TEMPLATES.values() for t in ts] + [b"Just a line.", b"", b"Licensed under the Foo License", b"license", b"work under terms of use"]
    for line in lines:
        made = licences.features(licences.words_of(line))
        got = licence_model.odds(*made, slots)[0] if len(made[2]) else [float(k == licences.NONE) for k in range(len(licences.CLASSES))]
        assert np.allclose(got, brute.licence_odds(licence_model, line), atol=1e-4), line


def test_licence_recall(spark, licence_model):
    """Every notice with every opening, put as a line into ordinary documents; and the lines that the test table holds."""
    texts = [r["text"] for r in spark.read.parquet(f"{BIG}/documents.parquet").where("length(text) BETWEEN 200 AND 3000 AND NOT lower(text) LIKE '%licen%'").orderBy("doc_id").limit(60).collect()]
    slots, planted, hit, false = licence_model.slots(), 0, 0, 0
    for k, (family, template) in enumerate((f, t) for f, ts in licences.TEMPLATES.items() for t in ts):
        for j, opening in enumerate(licences.OPENINGS):
            lines = texts[(k * 11 + j) % len(texts)].split("\n")
            lines.insert((k + j) % (len(lines) + 1), f"{opening} {template}.".strip())
            found = licences.scan_text("\n".join(lines).encode(), licence_model, slots)
            planted, hit, false = planted + 1, hit + any(x["family"] == family for x in found), false + sum(x["family"] != family for x in found)
    print(f"planted {planted}, found {hit}, others {false}")
    assert hit >= 0.95 * planted and false <= 0.05 * planted
    known = {"Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0."}
    got = {r["doc_id"]: r["licences"] or "" for r in queries.op9_licence_scan(spark, BIG).collect()}
    there = 0
    for r in spark.read.parquet(f"{BIG}/documents.parquet").collect():
        has = {f for f, line in known.items() if line in (r["text"] or "").split("\n")}
        there += len(has)
        assert has <= set(got[r["doc_id"]].split(","))
    assert there >= 30


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=25), st.lists(st.text(alphabet="abc", max_size=24), min_size=1, max_size=6))
def test_automaton(pairs, texts):
    """Any list of merges that makes each token once: words are encoded as the rule says, and an arc is a pair that stays apart."""
    tokens, merges = [b"a", b"b", b"c"], []
    for i, j in pairs:
        u, v = tokens[i % len(tokens)], tokens[j % len(tokens)]
        if u + v not in tokens and len(u + v) <= 12 and brute.bpe(u + v, merges) == [u, v]:
            tokens.append(u + v)
            merges.append((u, v))
    machine = bpe.Automaton({t: k for k, t in enumerate(tokens)}, merges)
    for t in texts:
        assert [tokens[k] for k in machine.encode(t.encode())] == brute.bpe(t.encode(), merges)
    for u in tokens:
        for v in tokens:
            assert machine.follows(u, v) == (brute.bpe(u + v, merges) == [u, v])


@pytest.mark.parametrize("bucket", [256, 2048])
def test_near_links_of_dense_groups(spark, monkeypatch, bucket):
    """Groups that overflow the buckets of the first level lose no link at the finer ones."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(2)]
    fps = {b ^ sum(1 << i for i in rng.sample(range(20), rng.randint(0, 5))) for b in base for _ in range(900)}
    rows = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for r in simhash.near_links(rows).collect():
        u, v = r["u"] % 2**64, r["v"] % 2**64
        assert (u ^ v).bit_count() <= simhash.RADIUS
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    want = brute_components({x: x for x in fps})
    assert {x: find(x) for x in fps} == want and len(fps) > 2 * 256


def test_free_bits():
    """At most 32, 16 and 8 bits stay free, so no bucket of the last level can overflow."""
    at = [0]
    for most in (32, 16, 8):
        at = sorted({m for k in at for m in simhash.covering_masks(k)})
        assert max(64 - m.bit_count() for m in at) <= most


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\tÄ", max_size=60), st.integers(1, 9))
def test_pieces_of_texts(text, size):
    """Words cut out piece by piece are the words of the whole."""
    from pricelark.llm import hashing

    data = text.encode()
    whole = simhash.fingerprint(data), hashing.word_hashes(data).tolist()
    old, old_cut = hashing.PIECE, simhash.cut
    try:
        hashing.cut.__defaults__ = (size,)
        assert (simhash.fingerprint(data), hashing.word_hashes(data).tolist()) == whole
    finally:
        hashing.cut.__defaults__ = (old,)
        assert simhash.cut is old_cut


def test_slices_of_batches(monkeypatch):
    monkeypatch.setattr(common, "PIECE_ROWS", 3)
    monkeypatch.setattr(common, "PIECE_BYTES", 10)
    rows = ["a" * n for n in (4, 4, 4, 30, 1, 1, 1, 1)] + [None, "", "b"]
    got = [b.column(0).to_pylist() for b in common.pieces(iter([pa.RecordBatch.from_arrays([pa.array(rows)], names=["t"]), pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["t"])]), "t")]
    assert [x for b in got for x in b] == rows and max(map(len, got)) == 3 and ["a" * 30] in got and got[0] == ["aaaa"] * 2


def test_exact_shuffled_gate(spark, sf, monkeypatch):
    """Above the bound the refinement is a shuffled join, with hot keys apart; the same rows stay open."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.limit(1).crossJoin(spark.range(1200)).drop("id"))  # one hot text
    whole = lambda: sorted(map(tuple, exact_dedup.exact_dedup(docs).collect()), key=str)
    want = whole()
    closed = sum(r[-1] is None for r in want)
    assert 0 < closed < len(want)
    for hot in (1000, 10**9):
        monkeypatch.setattr(exact_dedup, "small", lambda keys: False)
        monkeypatch.setattr(exact_dedup, "HOT_ROWS", hot)
        assert whole() == want


def test_shards_of_documents(spark, monkeypatch):
    """Small shards and blocks, and items divided over blocks, find what one index finds."""
    rng = random.Random(4)
    word = lambda: rng.choice("uno dos tres cuatro cinco seis".split())
    items = [(k, " ".join(word() for _ in range(rng.choice((2, 12, 40))))) for k in range(12)]
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) + " " + rng.choice(items)[1] for _ in range(40)]
    docs, bench = table(spark, list(enumerate(texts))), spark.createDataFrame(items, "item_id long, text string")
    data = [(i, t.encode()) for i, t in items]
    for words, blocks in ((1 << 20, 500_000), (30, 500_000), (200, 25)):
        monkeypatch.setattr(decontaminate, "SHARD_WORDS", words)
        monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", blocks)
        got = {r["doc_id"]: (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), sorted(r["items"])) for r in decontaminate.find_hits(docs, bench).collect()}
        assert got == {k: brute_hits(t.encode(), data) for k, t in enumerate(texts)}


def test_ids_that_are_no_numbers(spark):
    """Such a doc_id counts as null; item ids stay as they are."""
    docs = spark.createDataFrame([("x7", "uno dos tres"), ("8", "hola")], "doc_id string, text string")
    bench = spark.createDataFrame([("b-1", "dos tres"), ("a-2", "uno dos")], "item_id string, text string")
    got = {r["doc_id"]: r["items"] for r in decontaminate.find_hits(docs, bench).collect()}
    assert got == {None: ["a-2", "b-1"], 8: []}
    assert sorted(str(r["doc_id"]) for r in simhash.near_dedup(docs).collect()) == ["8", "None"]
