"""Searches by a saved index of 3-grams, against a look into every text."""

import pytest

from pricelark.operators import analytics as an
from pricelark.operators import postings as po

TEXTS = ["Bolt 12", "bolt", "BOLTED joint", "b", "lt 1", "ΟΔΟΣ ΑΣΑ", "οδός", "İstanbul", "straße", "x%_y", "日本語テキスト", "𝒳y𝒳", " ", "ab" * 400, "the bolt, the bolt"]
SOUGHT = ["bolt", "Bolt", "b", "lt", "LT 1", "ΑΣ", "Σ", "ς", "οδοσ", "i̇s", "İ", "STRASSE", "ße", "%_", "日本", "本語テ", "𝒳", "𝒳y", " ", "abab" * 9, "nothing", "the bolt, the bolt", "e b"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "a")
    rows = [(k % 9, t) for k, t in enumerate(TEXTS)] + [(3, TEXTS[0]), (None, "bolt"), (20, None), (21, "")]
    po.write_postings(spark.createDataFrame(rows, "id int, text string"), path)
    return path, rows


@pytest.mark.parametrize("share", [1.0, po.SHARE])
def test_candidates(spark, index, monkeypatch, share):
    """No row that holds the text, with or without regard to case, is left out; ids come once."""
    monkeypatch.setattr(po, "SHARE", share)
    path, rows = index
    lists = 0
    for q in SOUGHT:
        ids = po.candidates(spark, path, q)
        if ids is None:
            continue
        lists += 1
        found = [r["id"] for r in ids.collect()]
        texts = [(k, t) for k, t in rows if k is not None and t]
        assert len(found) == len(set(found)) and {k for k, t in texts if q in t or q.lower() in t.lower()} <= set(found)
        assert all(any(g in po.folded(t) for i, t in texts if i == k) for k in found for g in [po.folded(q)[: po.WIDTH]])
    assert lists == len(SOUGHT) if share == 1 else lists >= len(SOUGHT) - 6
    assert po.candidates(spark, path, "") is None
    assert po.candidates(spark, path, "zzz").count() == 0 and po.candidates(spark, path, "zz").count() == 0


def test_only_rare_postings_are_read(spark, tmp_path):
    """Each pair is there once and in order; the gram's filter reaches the scan; a frequent gram isn't looked up."""
    texts = spark.range(3000).selectExpr("id", "concat('https://shop.example/p/', id) AS text")
    path = str(tmp_path / "a")
    po.write_postings(texts, path)
    pairs = spark.read.parquet(path + "/postings")
    assert pairs.count() == pairs.distinct().count() and len({r[0] for r in pairs.selectExpr("input_file_name()").distinct().collect()}) > 1
    assert spark.read.parquet(path + "/counts").where("gram = ''").first()["n"] == 3000
    ids = po.candidates(spark, path, "shop.example/p/2999")
    assert [r["id"] for r in ids.collect()] == [2999]
    assert "PushedFilters: [In(gram" in ids._jdf.queryExecution().toString().replace("\n", "")
    assert po.candidates(spark, path, "shop.example") is None


def test_index_of_nothing(spark, tmp_path):
    po.write_postings(spark.createDataFrame([], "id long, text string"), str(tmp_path / "a"))
    assert po.candidates(spark, str(tmp_path / "a"), "abc").count() == 0 and po.candidates(spark, str(tmp_path / "a"), "a").count() == 0


def test_searches(spark, tmp_path):
    """The catalogue's searches over candidates give what they give over all rows, also for products without variants and nulls."""
    products = spark.createDataFrame([(1, "Bolt", "Acme", None), (2, "Nut", None, "bolts"), (3, "Gear", "B", "c"), (4, "nut BOLT", "x", "y"), (5, None, None, None)], "product_id int, product_name string, brand string, category string")
    variants = spark.createDataFrame([(10, 3, "https://a/BOLT-3", None), (11, 3, None, "s"), (12, 5, "u", "SKU-77"), (13, None, "bolt", "bolt")], "variant_id int, product_id int, url string, sku string")
    path = str(tmp_path / "a")
    po.write_postings(po.catalog_texts(products, variants), path)
    for q in ("bolt", "BOLT", "ku-7", "sku-77", "b", "nut", "nowhere", ""):
        ids = po.candidates(spark, path, q)
        p, v = po.narrowed(products, ids), po.narrowed(variants, ids)
        for search in (lambda p, v, q=q: an.catalog_search(p, v, q), lambda p, v, q=q: an.autocomplete(p, q)):
            assert sorted(map(str, search(p, v).collect())) == sorted(map(str, search(products, variants).collect()))


def test_grams_are_not_shuffled(spark, tmp_path):
    """All postings of an id are in one file, that of the task that got its texts, in the order of gram and id."""
    path = str(tmp_path / "a")
    po.write_postings(spark.range(200).selectExpr("id % 90 AS id", "concat('https://shop.example/p/', id) AS text"), path)
    rows = spark.read.parquet(path + "/postings").selectExpr("gram", "id", "input_file_name() AS f").collect()
    assert len({(r["id"], r["f"]) for r in rows}) == len({r["id"] for r in rows}) == 90 and len({r["f"] for r in rows}) > 1
    for f in {r["f"] for r in rows}:
        pairs = [(r["gram"], r["id"]) for r in rows if r["f"] == f]
        assert pairs == sorted(pairs)
