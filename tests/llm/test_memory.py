"""What a Python worker holds: bounded tables, and nothing of the operator before."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from pricelark.llm import bpe, common, decontaminate, language, simhash
from tests.llm import brute

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def test_vectors_of_many_ngrams():
    """More n-grams than are kept: the sums are right, and memory doesn't follow their number."""
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=30_000)) for _ in range(2)]
    assert len(np.unique(np.concatenate([language.ngrams(t) for t in texts]))) > language.Bundler.HELD
    tracemalloc.start()
    bundler = language.Bundler()
    plain, _ = bundler.bundle(["the cat sat on the mat"])
    vectors, sizes = bundler.bundle(texts)
    again, _ = bundler.bundle(["the cat sat on the mat"])
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    want, n = brute.bundle(texts[0])
    assert sizes[0] == n and (vectors[0] == want).all()
    assert (plain == again).all() and (plain[0] == brute.bundle("the cat sat on the mat")[0]).all()
    assert peak < 48 << 20


def test_groups_of_texts(monkeypatch):
    """Every text is in one group, in order; long ones stand alone."""
    monkeypatch.setattr(language, "GROUP", 3)
    monkeypatch.setattr(language, "GROUP_CHARS", 10)
    texts = ["aaaa", None, "b" * 6, "c", "d" * 30, "", "", "", "e"]
    found = list(language.groups(texts))
    assert [texts[x] for x in found] == [["aaaa", None, "b" * 6], ["c"], ["d" * 30], ["", "", ""], ["e"]]
    assert list(language.groups([])) == []


def test_encoder_keeps_what_recurs(monkeypatch):
    """Chunks that come once aren't kept, and a full table or full marks change no id."""
    found, library = bpe.ByteBPE(BYTE), Tokenizer.from_file(BYTE)
    once = " ".join(f"x{k}" for k in range(1000))
    want = library.encode(once, add_special_tokens=False).ids
    assert found.encode(once) == want and len(found.later) <= 20
    assert found.encode(once) == want and len(found.later) >= 990
    monkeypatch.setattr(bpe, "MARKED", 50)
    monkeypatch.setattr(bpe, "TABLE", 20)
    small = bpe.ByteBPE(BYTE)
    assert [small.encode(once) for _ in range(3)] == [want] * 3 and len(small.later) <= 20


def test_operators_leave_nothing(monkeypatch):
    """An operator drops the tables of the one before and returns its memory, even if that kept no table."""
    returned = []
    monkeypatch.setattr(common, "_HELD", {})
    monkeypatch.setattr(common, "_give_back", lambda: returned.append(1))
    common.worker_table("bundler", language.Bundler)
    assert list(simhash._map_fingerprints(iter(()))) == [] and "bundler" not in common._HELD and len(returned) == 2
    empty = type("Held", (), {"value": decontaminate.Benchmark([])})
    for _ in range(2):  # a second task of the same operator returns nothing
        assert list(decontaminate._cleaner(empty, False)(iter(()))) == [] and len(returned) == 3
    common.worker_table("bpe", dict)
    assert len(returned) == 4 and list(common._HELD) == ["bpe"]
