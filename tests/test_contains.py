"""Texts that hold others, against a comparison of all pairs."""

import pytest

from pricelark.operators import merge as mg
from pricelark.operators.contains import WIDEST, holders


def joins(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().lower().splitlines() if "join" in x or "cartesian" in x]


TEXTS = ["a", "ab", "abcabcabcd", "sku-0001 and sku-00012", "x" * 100, "x" * 31 + "y", "ñandú 𝒳 日本語テキスト", "日本", "ABC", "%_", " "]
PARTS = ["a", "b", "ab", "abc", "abcd", "bcab", "sku-0001", "ku-00012", "u-000", "x" * WIDEST, "x" * (WIDEST + 9), "x" * 31, "xy", "𝒳", "日本語", "𝒳 日", "Abc", "%_", "%", " ", "zz"]


@pytest.mark.parametrize("shuffled", [False, True])
def test_holders(spark, monkeypatch, shuffled):
    """Every width of anchor, repeated rows, nulls, letters of all planes, both ways to join."""
    if shuffled:
        monkeypatch.setattr("pricelark.operators.contains.BROADCAST_BYTES", 0)
    rows = [(k % 2, t) for t in TEXTS for k in (0, 1)] + [(0, TEXTS[0]), (None, "ab"), (1, None), (1, "")]
    parts = [(0, p) for p in PARTS] + [(1, p) for p in PARTS[::2]] + [(0, PARTS[0]), (None, "ab"), (0, None), (0, "")]
    found = holders(spark.createDataFrame(rows, "at int, text string"), spark.createDataFrame(parts, "at int, part string"))
    want = sorted({(a, t, p) for a, t in rows for b, p in parts if a is not None and a == b and t and p and p in t})
    assert sorted(tuple(r) for r in found.collect()) == want and want
    assert joins(found) and not any("nestedloop" in x or "cartesian" in x for x in joins(found))


def test_holders_of_nothing(spark):
    some, none = spark.createDataFrame([(1, "ab")], "at int, x string"), spark.createDataFrame([], "at int, x string")
    for texts, parts in ((some, none), (none, some), (none, none)):
        assert holders(texts.toDF("at", "text"), parts.toDF("at", "part")).count() == 0


def test_sites_of_domains(spark):
    """The lowest site, whatever the domain's case and spaces; repeated and null URLs; rows of the batch stay whole."""
    urls = ["https://b.example.com/x", "https://example.com", "https://b.example.com/x", None, "", "https://EXAMPLE.com", "https://a.b"]
    domains = [" Example.com ", "b.example", "example.com", "nowhere.org", "", "  ", None, "a.b", "s", "a.b"]
    sites = spark.createDataFrame(list(enumerate(urls, 5)), "site_id int, url_base string")
    items = spark.createDataFrame(list(enumerate(domains)), "item_id int, domain string")
    found = mg.resolve_sites(items, sites)
    holds = lambda d: [k for k, u in enumerate(urls, 5) if u and d and d.strip() and d.strip().lower() in u]
    assert found.columns == ["item_id", "domain", "site_id"]
    assert sorted((r["item_id"], r["site_id"]) for r in found.collect()) == [(k, min(holds(d), default=None)) for k, d in enumerate(domains)]
    assert not any("nestedloop" in x or "cartesian" in x for x in joins(found))
