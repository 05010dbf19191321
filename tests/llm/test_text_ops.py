"""Round trips, brute force and held-out accuracy of the training-data operators."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pricelark.llm import bpe, decontaminate, exact_dedup, language, licences, quality, queries, sharding, simhash, token_files, toxicity
from pricelark.llm.common import remainder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, fp string, row_no int, `start` int, h int, label int, l int, n int, c int, `data` int, marked int, gone_id int, node int, part int, shard int, mask int, `key` int"
BYTE, WORD = public_tokenizers.path(queries.BYTE_BPE), public_tokenizers.path(queries.WORD_BPE)


def table(spark, rows):
    """rows (doc_id, text); further columns have names that operators use themselves."""
    return spark.createDataFrame([(i, t, None, None, None, 7, "x", 1, 2, *range(13)) for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, "Hola"), (3, "Hola"), (4, "hola"), (None, "HOLA"), (5, "ÁB"), (6, "áb"), (7, "x " * 40000), (8, " \n\t ")]


@pytest.fixture
def odd(spark):
    return table(spark, ODD)


@pytest.fixture
def empty(spark):
    return table(spark, [])


# --- BPE -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def byte_bpe():
    return bpe.ByteBPE(BYTE), Tokenizer.from_file(BYTE)


WORDY = st.one_of(st.text(max_size=40), st.text(alphabet="abthe \n\t's1.,!ÄßéTHE", max_size=80), st.sampled_from(["<|endoftext|>", "a<|endoftext|> b", "a" * 500, " " * 50 + "x", "\r\n\r\n x", "don't I'll", "᷸౜x"]))


@settings(max_examples=300, deadline=None)
@given(WORDY)
def test_byte_bpe(byte_bpe, text):
    own, library = byte_bpe
    ids = own.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert own.decode(ids).decode() == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=12))
def test_byte_decode(byte_bpe, ids):
    own, library = byte_bpe
    assert own.decode(ids).decode() == library.decode(ids, skip_special_tokens=False)


def test_bpe_frames(spark, odd, empty, byte_bpe):
    enc = bpe.bpe_encode(odd, BYTE)
    back = sorted(((r[0], r[1]) for r in bpe.bpe_decode(enc, BYTE).collect()), key=str)
    assert back == sorted(((i, t or "") for i, t in ODD), key=str)
    assert bpe.bpe_encode(empty, BYTE).count() == 0


# --- token files -----------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(WORDY)
def test_word_bpe(text):
    own = token_files.encoder(WORD)
    assert own.encode(text).tolist() == own.library.encode(text, add_special_tokens=False).ids


MARKED = st.text(alphabet="abZéÉÑΣσİıẞក̸़́ ,.'!-_<9中\x1c", max_size=14)


@settings(max_examples=300, deadline=None)
@given(MARKED)
@example("\u0130'")
@example("\u0958!")
def test_word_bpe_marks_at_the_end(text):
    """A mark after a word is taken apart only if the word ends in a letter when lower-cased and composed."""
    own = token_files.encoder(WORD)
    assert own.encode(text).tolist() == own.library.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50000), st.integers(0, 2**64 - 1)), max_size=70), min_size=1, max_size=6))
def test_simple8b(docs):
    ids = np.array([x for d in docs for x in d], dtype=np.uint64)
    words, offsets = token_files.pack(ids, np.array([len(d) for d in docs]))
    assert token_files.unpack(words).tolist() == ids.tolist()
    ends = [*offsets.tolist(), len(words)]
    assert [token_files.unpack(words[a:b]).tolist() for a, b in zip(ends, ends[1:], strict=False)] == docs


def test_token_files(spark, sf, odd, empty):
    library = Tokenizer.from_file(WORD)
    got = {r["doc_id"]: r for r in queries.op5_token_files(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    at = 0
    for r in rows:
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        assert tuple(got[r["doc_id"]])[1:] == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(rows)
    read = token_files.read_digests(token_files.write_tokens(odd, WORD)).orderBy("start").collect()
    assert [r["doc_id"] for r in read] == [None, 1, 2, 3, 3, 4, 5, 6, 7, 8] and read[1]["n_tokens"] == 1
    assert token_files.read_digests(token_files.write_tokens(empty, WORD)).count() == 0
    ids = {r["doc_id"]: r["ids"] for r in token_files.read_ids(token_files.write_tokens(odd, WORD)).collect()}
    assert ids[4] == [*library.encode("hola", add_special_tokens=False).ids, 2]


# --- exact and near copies ---------------------------------------------------------


def test_exact(spark, odd, empty):
    got = exact_dedup.exact_dedup(odd, digest_all=True).collect()
    assert len(got) == len(ODD)
    hola = [r for r in got if r["keep_id"] == 4]
    assert len(hola) == 4 and {r["group_size"] for r in hola} == {4} and sum(r["kept"] for r in hola) == 1
    assert {r["doc_id"]: r["kept"] for r in got if r["doc_id"] in (1, 2, 5, 6)} == {1: False, 2: True, 5: True, 6: True}
    assert sorted(r["doc_id"] for r in exact_dedup.keep_one(odd).collect()) == [2, 4, 5, 6, 7, 8]
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.keep_one(empty).count() == 0
    twice = table(spark, [(1, "a"), (1, "A"), (1, "a")])
    assert exact_dedup.keep_one(twice).count() == 1


def test_exact_open_gate(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(map(tuple, exact_dedup.exact_dedup(docs, digest_all=True).collect()), key=str)
    monkeypatch.setattr(exact_dedup, "small", lambda keys: False)
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs, digest_all=True).collect()), key=str) == want


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= simhash.RADIUS:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_covering():
    rng = random.Random(1)
    for kept in (0, simhash.covering_masks()[3]):
        free = [i for i in range(64) if not kept >> i & 1]
        for _ in range(3000):
            diff = sum(1 << i for i in rng.sample(free, 3))
            assert any(not m & diff for m in simhash.covering_masks(kept))


def test_near(spark, sf, odd, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    fps = {i: simhash.fingerprint(t) for i, t in text.items()}
    got = queries.op2_simhash_near_dedup(spark, sf).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{x:016x}" for i, x in fps.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(fps)
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == set(brute_components(fps).values())
    assert simhash.near_dedup(odd).count() == len(ODD) and simhash.near_dedup(empty).count() == 0
    assert len({r["component_id"] for r in simhash.near_dedup(odd).where("doc_id IN (1, 2, 8)").collect()}) == 1
    assert simhash.keep_one(table(spark, [(1, "a b c"), (1, "a b c"), (2, "A b c")])).count() == 1


def test_near_unrelated_heads(spark):
    """Components without an id, or with the id of another one, each keep a document."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(None, a), (None, a), (None, a.upper()), (None, b), (7, c), (7, d), (7, d), (9, d), (5, None)]
    got = sorted(((r["doc_id"], (r["text"] or "").lower()) for r in simhash.keep_one(table(spark, rows)).collect()), key=str)
    assert got == sorted([(None, a), (None, b), (7, c), (7, d), (5, "")], key=str)


@pytest.mark.parametrize("bucket", [2, 8, 2048])
def test_large_buckets(spark, monkeypatch, bucket):
    """Finer keys find the same components as one comparison of all."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(bucket)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = {x ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4))) for x in base for _ in range(60)}
    rows = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    links = [(r["u"] % 2**64, r["v"] % 2**64) for r in simhash.near_links(rows).collect()]
    want = brute_components({x: x for x in fps})
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        assert (u ^ v).bit_count() <= 3
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    if bucket == 2048:
        assert {x: find(x) for x in fps} == want
    else:  # three levels of fifteen keys serve buckets of 2,048; smaller ones may need more
        assert all(want[u] == want[v] for u, v in links)


# --- sharding ----------------------------------------------------------------------


def test_sharding(spark, sf, odd, empty):
    got = sorted(queries.op3_sharding(spark, sf).collect(), key=lambda r: r["doc_id"])
    text = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sizes = [len(text[r["doc_id"]]) + 16 for r in got]
    total, at, slots = sum(sizes), 0, Counter()
    assert len(got) == len(text)
    for r, size in zip(got, sizes, strict=True):
        shard = min(39, (2 * at + size) * 40 // (2 * total))
        assert (r["size"], r["text_crc32"], r["shard"], r["slot"]) == (size, zlib.crc32(text[r["doc_id"]]), shard, slots[shard])
        slots[shard] += 1
        at += size
    rows = sharding.shard_by_bytes(odd, 3).collect()
    assert len(rows) == len(ODD) and sorted((r["shard"], r["slot"]) for r in rows) == sorted((s, k) for s, n in Counter(r["shard"] for r in rows).items() for k in range(n))
    assert sharding.shard_by_bytes(empty).count() == 0


# --- decontamination -----------------------------------------------------------------


def brute_hits(text, items, window=decontaminate.WINDOW):
    words, hit, which = decontaminate.words_of(text), set(), set()
    for i, t in items:
        w = decontaminate.words_of(t)
        n = min(len(w), window)
        wins = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in wins:
                hit.update(range(k, k + n))
                which.add(str(i))
    return len(words), len(hit), sorted(which)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab c", max_size=60), max_size=5), st.lists(st.text(alphabet="ab c", max_size=25), min_size=1, max_size=4))
def test_fm_index(texts, items):
    items = list(enumerate(t.encode() for t in items))
    data = [t.encode() for t in texts]
    bench = decontaminate.Benchmark(items, 4)
    counts, spans, found = bench.scan(data)
    for t, n, s, f in zip(data, counts, spans, found, strict=True):
        assert (n, sum(e - b for b, e in s), sorted(bench.ids[i] for i in f)) == brute_hits(t, items, 4)


def test_decontaminate(spark, odd, empty, monkeypatch):
    bench = spark.createDataFrame([(1, "Uno dos tres"), (2, None), (3, ""), (None, "hola"), (4, " ".join(map(str, range(30))))], "item_id long, text string")
    docs = table(spark, [(1, "Cero UNO, dos: tres! Cuatro"), (2, "x " + " ".join(map(str, range(5, 20))) + " y"), (3, "limpio"), (4, None)])
    want = {1: (5, 3, ["1"]), 2: (17, 15, ["4"]), 3: (1, 0, []), 4: (0, 0, [])}
    for block in (1 << 20, 1):
        monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
        got = {r["doc_id"]: (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) for r in decontaminate.find_hits(docs, bench).collect()}
        assert got == want
        assert sorted(r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()) == [3, 4]
        assert {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench, cut=True).collect()} == {1: "Cero ! Cuatro", 2: "x  y", 3: "limpio", 4: None}
    assert decontaminate.find_hits(odd, bench).count() == len(ODD) and decontaminate.find_hits(empty, bench).count() == 0
    assert decontaminate.find_hits(odd, bench.limit(0)).count() == len(ODD)


def test_decontaminate_items_without_id(spark, monkeypatch):
    """The same rows as the query's SQL, and such passages go from the pipeline."""
    bench = spark.createDataFrame([(None, "hola mundo"), (None, "adios mundo"), (7, "hola mundo cruel")], "item_id long, text string")
    texts = ["x hola mundo y adios mundo", "hola mundo cruel", "limpio"]
    docs = table(spark, list(enumerate(texts)))
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    c.executemany("INSERT INTO benchmark VALUES (?, ?)", [tuple(r) for r in bench.collect()])
    want = sorted(c.execute(queries.SQL_OP8).fetchall())
    assert [r[2] for r in want] == [4, 3, 0]
    for block in (1 << 20, 1):
        monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
        assert sorted(tuple(r) for r in decontaminate.digest_columns(decontaminate.find_hits(docs, bench)).collect()) == want
        assert [r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()] == [2]


# --- models ----------------------------------------------------------------------------


def labelled(spark, sf, name, n, bad):
    got = spark.createDataFrame(queries.queries()[name](spark, sf).collect()).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    return got.where("held_out").select("score", "predicted", queries_label[name]).collect()


queries_label = {"op1_toxicity": "toxic", "op10_quality": "quality"}
BIG = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("name", "least"), [("op1_toxicity", 0.85), ("op10_quality", 0.95)])
def test_held_out(spark, name, least):
    rows = labelled(spark, BIG, name, None, None)
    good, bad = [r[0] for r in rows if r[2] == 1], [r[0] for r in rows if r[2] == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc >= least and all(0 <= r[0] <= 1 and r[1] == (r[0] >= 0.7) for r in rows)


def test_language_held_out(spark):
    got = queries.op6_language_id(spark, BIG).join(spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) >= 0.97 and all(0 <= r["score"] <= 1 for r in got)


def test_models_on_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1, 1), (3, 1, 1), (4, 0, 0), (None, 1, 1), (5, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    every = F.lit(True)
    for module in (toxicity, quality):
        for rows in (labels, labels.limit(0)):
            scores = [r["score"] for r in module.score(odd, module.learn(odd, rows, every)).collect()]
            assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores)
        assert module.score(empty, module.learn(empty, labels, every)).count() == 0
    model = language.learn(odd.withColumn("lang", F.when(F.col("doc_id") > 4, "aa").otherwise("bb")), every)
    got = language.identify(odd, model).collect()
    assert sorted(r["doc_id"] for r in got if r["lang_pred"] == "und") == [1, 2, 8] and all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert {r["lang_pred"] for r in language.identify(odd, language.learn(odd, every)).collect()} == {"und"}
    assert language.learn(empty, every) is None and language.keep_identified(empty, None).count() == 0
    for m in (model, None):
        assert language.keep_identified(odd, m).count() == len(ODD) - 3


def test_language_beyond_the_first_plane(spark):
    """Emoji are no letters, letters of other planes are."""
    docs = table(spark, [(1, "\U0001f600\U0001f680 12, !"), (2, "\U00010400\U00010401"), (3, "hola"), (4, "hola \U0001f600")])
    model = language.learn(docs.withColumn("lang", F.when(F.col("doc_id") == 2, "aa").otherwise("bb")), F.lit(True))
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert (got[1]["lang_pred"], got[1]["score"]) == ("und", 0) and got[2]["lang_pred"] == "aa" and got[3]["lang_pred"] == "bb"
    for m in (model, None):
        assert sorted(r["doc_id"] for r in language.keep_identified(docs, m).collect()) == [2, 3, 4]
    assert language.ngrams("hola").tolist() == language.ngrams("hola \U0001f600").tolist()


def test_language_of_any_number(spark):
    """Of 300 languages, as many documents each, none is left out."""
    docs = table(spark, [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26)} " * 9) for k in range(300)]).withColumn("lang", F.format_string("l%03d", F.col("doc_id")))
    model = language.learn(docs, F.lit(True))
    assert model.languages == [f"l{k:03d}" for k in range(300)]


def test_long_texts_in_pieces(monkeypatch):
    text = "Das ist ein Satz, der sich wiederholt. " * 400
    whole = language.ngrams(text), quality.counts_of(text.encode())
    monkeypatch.setattr(language, "PIECE", 1000)
    monkeypatch.setattr(quality, "PIECE", 1000)
    assert np.array_equal(quality.counts_of(text.encode()), whole[1])
    assert np.array_equal(language.ngrams(text), whole[0])
    model = toxicity.Model(toxicity.FTRL())
    dense = np.zeros(1 << toxicity.BITS, dtype=np.float32)
    dense[toxicity.features(b"idiot idiot moron")] = 1.0
    one = model.score(text.encode() + b"idiot moron", dense)
    monkeypatch.setattr(toxicity, "PIECE", 50)
    assert model.score(text.encode() + b"idiot moron", dense) == one


def test_licences(spark, sf, odd, empty):
    text = {1: "Erste Zeile.\nReleased under the MIT License.", 2: "Licensed under the Apache License, Version 2.0.\nxx", 3: "This work is licensed under the GNU General Public License, version 3.", 4: "Licensed under CC BY-NC 4.0.", 5: "Just a sentence about work and terms.", 6: "Licensed under the Foo Bar Baz License.", 7: None}
    docs = table(spark, list(text.items()))
    got = {r["doc_id"]: [x["family"] for x in r["found"]] for r in licences.scan(docs, licences.learn(spark.read.parquet(f"{sf}/documents.parquet"))).collect()}
    assert got == {1: ["MIT"], 2: ["Apache-2.0"], 3: ["GPL-3.0"], 4: ["CC-BY-NC-4.0"], 5: [], 6: ["unknown"], 7: []}
    assert licences.scan(odd, licences.learn(empty)).count() == len(ODD) and licences.scan(empty, licences.learn(empty)).count() == 0


WRAPPED = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal": ["MIT"],
    "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007": ["GPL-3.0"],
    "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are\n# met:": ["BSD-3-Clause"],
    "Permission to use, copy, modify, and/or distribute this software for any\r\npurpose with or without fee is hereby granted, provided": ["ISC"],
    "you can use it under the terms\nof the GNU\nLesser General\nPublic License\nas published\nby the Free\nSoftware Foundation,\neither version 3\nof the License": ["LGPL-3.0"],
    "Released under the MIT License.\nReleased under the MIT License.": ["MIT", "MIT"],
    "GNU GENERAL PUBLIC LICENSE\n\nVersion 3 of the plan": ["unknown", "unknown"],
    "// SPDX-License-Identifier: MIT": ["MIT"],
    "x\n/* SPDX-License-Identifier: Apache-2.0 */": ["Apache-2.0"],
    "SPDX-License-Identifier: (GPL-2.0-or-later WITH Bison-exception-2.2 OR BSD-3-Clause)": ["BSD-3-Clause", "GPL-2.0"],
    "SPDX-License-Identifier: MIT-0": ["unknown"],
}


def test_licences_wrapped_and_tags(spark, sf):
    docs = table(spark, list(enumerate(WRAPPED)))
    got = {r["doc_id"]: [x["family"] for x in r["found"]] for r in licences.scan(docs, licences.learn(spark.read.parquet(f"{sf}/documents.parquet"))).collect()}
    assert got == dict(enumerate(WRAPPED.values()))


def test_licence_background(spark, monkeypatch):
    """Lines far down and far along a document are background too."""
    seen = []
    monkeypatch.setattr(licences, "fit", seen.extend)
    licences.learn(table(spark, [(1, "\n".join(f"zeile {k} " + "wort " * 100 + f"ende {k}" for k in range(40)))]))
    assert sorted(int(x[-1]) for x in seen) == list(range(40)) and {len(x) for x in seen} == {104}


def test_remainders(spark):
    got = spark.createDataFrame([(5,), (None,)], "i long").select(remainder(F.col("i"), 3)).collect()
    assert [r[0] for r in got] == [zlib.crc32(b"5") % 3, zlib.crc32(b"") % 3]
