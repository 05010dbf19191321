"""The pipeline's rows against the same steps in plain Python."""

import hashlib
import string

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from pricelark.llm import simhash
from tests.llm.brute import languages
from tests.llm.test_text_ops import brute_components, brute_hits

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "decontamination", "bpe_encode_decode"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    docs = {r["doc_id"]: r["text"] for r in rows}
    items = [(r["item_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    named = languages([(r["text"], r["lang"]) for r in rows], docs.values())
    lang = {i: name for i, (name, _, rejected) in zip(docs, named, strict=True) if not rejected}
    left = {i: docs[i] for i in lang}
    keep = {}
    for i, t in left.items():
        k = t.translate(LOWER)
        keep[k] = max(i, keep.get(k, i))
    left = {i: left[i] for i in keep.values()}
    roots = brute_components({i: simhash.fingerprint(t.encode()) for i, t in left.items()})
    left = {i: t for i, t in left.items() if roots[i] == i and not brute_hits(t.encode(), items)[1]}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in left.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (lang[i], ids, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r["doc_id"]: (r["lang"], r["ids"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


def test_pipeline_keeps_columns_and_takes_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for rows in (docs.limit(20), docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, sf).columns == docs.columns, name
