"""Matching by lists of texts: nothing grows with the pairs of a SKU and a URL that come together."""

from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from pricelark.operators import merge as mg
from pricelark.plans import catalog

ITEM = "item_id int, site_id int, item_sku string, item_url string, price decimal(18,2), image_url string"
VARIANT = "variant_id int, site_id int, sku string, url string, updated_at timestamp_ntz, price decimal(18,2), prev_price decimal(18,2), in_stock boolean, image_url string, active boolean"


def crossed(spark):
    """Each of 12 SKUs with each of 12 URLs; a variant is met by SKU, by URL, or by both."""
    items = [(12 * a + b, 1, f"q-10{a:02d}", f"https://s.com/x/q-10{b:02d}", Decimal(a + 1), None) for a in range(12) for b in range(12)]
    skus = [f"Q-10{k:02d}{end}" for k in range(12) for end in ("", "0", "00")] + ["q-10", "Q-1"]
    variants = [(k, 1, s, f"https://s.com/p/{k}", datetime(2024, 1, 1 + k % 5) if k % 4 else None, Decimal(3), None, True, None, False) for k, s in enumerate(skus)]
    same = lambda i, v: any(len(p) >= 4 and p in t for p, t in ((i[2], v[2].lower()), (v[2].lower(), i[2]), (v[2].lower(), i[3])))
    return spark.createDataFrame(items, ITEM), spark.createDataFrame(variants, VARIANT), [(i, v) for i in items for v in variants if same(i, v)]


def test_pairs_of_texts_are_not_made(spark, monkeypatch):
    items, variants, pairs = crossed(spark)
    for rows in (mg.PART_ROWS, 0):  # parts broadcast, and neither parts nor their beginnings
        monkeypatch.setattr(mg, "PART_ROWS", rows)
        k = mg._keyed(items, variants)
        assert k.by_sku.count() + k.by_url.count() == len({(i[2], v[0]) for i, v in pairs if i[2] in v[2].lower() or v[2].lower() in i[2]}) + len({(i[3], v[0]) for i, v in pairs if v[2].lower() in i[3]}) < len(pairs) / 8
        best = {}
        for i, v in pairs:
            best.setdefault(i[0], []).append((v[4] is not None, v[4] or datetime(1, 1, 1), -v[0]))
        assert sorted(tuple(r) for r in mg.best_matches(items, variants).collect()) == sorted((i, -max(m)[2], len(m)) for i, m in best.items())
        assert sorted((r["item_id"], r["variant_id"]) for r in mg.fuzzy_match(items, variants).collect()) == sorted((i[0], v[0]) for i, v in pairs)


def test_beginnings_of_parts(spark, monkeypatch):
    """Parts are shuffled and their few beginnings broadcast: the same links."""
    texts = spark.createDataFrame([(1, f"https://s.com/i/ab{k:03d}z") for k in range(40)] + [(2, "ab001"), (1, "ab00")], "at int, text string")
    parts = spark.createDataFrame([(1, f"ab{k:03d}") for k in range(30)] + [(2, "xyz9")], "at int, text string")
    want = sorted(tuple(r) for r in mg._held(texts, mg._parts(parts)).collect())
    monkeypatch.setattr(mg, "PART_ROWS", 10)
    some = mg._parts(parts)
    assert some.heads is not None and len(want) == 30 and sorted(tuple(r) for r in mg._held(texts, some).collect()) == want


def test_upsert_takes_the_last_item(spark):
    items, variants, pairs = crossed(spark)
    last = {v[0]: i for i, v in sorted(pairs)}
    out = mg.extension_upsert(items, variants, "2024-05-01 00:00:00")
    assert {r["variant_id"]: r["price"] for r in out["variants"].collect()} == {r["variant_id"]: last[r["variant_id"]][4] if r["variant_id"] in last else Decimal(3) for r in variants.select("variant_id").collect()}
    tables = out["variants"]._jdf.queryExecution().optimizedPlan().toString()
    assert "hash(" not in tables and "strategy=merge" in tables and out["history"].where(F.col("price") == 3).count() == 0


def test_what_texts_reach_is_read_not_repeated(spark):
    """It was in the plan three times, each with the tables of matches and of variants that it is made of."""
    items, variants, _ = crossed(spark)
    plan = mg.best_matches(items, variants)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 7


def test_classes_make_all_pairs(spark):
    """The pairs were listed: rows grew with the copies of items times those of variants."""
    items, variants, _ = crossed(spark)
    shift = lambda df, c: df.unionByName(df.withColumn(c, F.col(c) + 1000)).unionByName(df.withColumn(c, F.col(c) + 2000))
    items, variants = shift(items, "item_id"), shift(variants, "variant_id")
    rows = [tuple(r) for r in mg.match_classes(items, variants).collect()]
    by, members = {}, {}
    for part, how, site, text, _, of in rows:
        if part == "link":
            by.setdefault((how, site, text), []).append(of)
    for part, _, _, _, one, of in rows:
        if part == "variant":
            members.setdefault(of, []).append(one)
    made = {(one, v) for part, how, site, text, one, _ in rows if part == "item" for of in by.get((how, site, text), []) for v in members[of]}
    assert made == {tuple(r) for r in mg.fuzzy_match(items, variants).select("item_id", "variant_id").collect()}
    assert len(rows) == len(set(rows)) < len(made) / 3 and sorted(sum(members.values(), [])) == sorted(r[0] for r in variants.select("variant_id").collect())
    assert all(of in members[of] for of in members)


def test_all_matches_are_listed(spark, sf):
    """The query gave texts, classes and members, from which the pairs were still to be made."""
    pairs = catalog.queries()["fuzzy_match_all"](spark, sf)
    assert pairs.columns == ["item_id", "variant_id"]
    best = {r["item_id"]: r for r in catalog.queries()["fuzzy_match"](spark, sf).collect()}
    found = {}
    for item, variant in pairs.collect():
        found.setdefault(item, []).append(variant)
    assert {k: len(v) for k, v in found.items()} == {k: r["matches"] for k, r in best.items()}
    assert all(len(set(v)) == len(v) and best[k]["variant_id"] in v for k, v in found.items())
