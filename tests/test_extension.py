"""Extension items one by one in a loop, against the fold; a store under two writers; rows that must not get lost or multiply."""

import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pricelark.functions.text import normalize_brand, normalize_sku
from pricelark.functions.urls import clean_product_url, make_absolute_url, normalize_image_url
from pricelark.operators import extension as ex
from pricelark.operators import merge as mg
from pricelark.operators import stateful as st
from pricelark.operators.linked import components
from pricelark.operators.store import CommitConflict, Store

ITEM = "item_id long, sku string, name string, url string, price decimal(18,2), image_url string, domain string, brand string, sel_price string, method string, source string, confidence int, latency_ms int"
SITE = "site_id int, url_base string, sel_price string, last_crawl timestamp_ntz"
VARIANT = "variant_id long, product_id long, site_id int, sku string, variant_name string, url string, price decimal(18,2), prev_price decimal(18,2), in_stock boolean, updated_at timestamp_ntz, image_url string, active boolean, extra string"
PRODUCT = "product_id long, product_name string, brand string, category string"
CANDIDATE = "site_id int, variant_id long, xpath string"
AS_OF = "2024-05-01 10:00:00"
NOW = datetime(2024, 5, 1, 10)


def plain(items, sites, variants, products, candidates):
    """The batch, one item after another, over lists of dicts (items normalised already)."""
    vs, ps, cs = [dict(v) for v in variants], [dict(p) for p in products], {(c["site_id"], c["xpath"], c["variant_id"]) for c in candidates}
    crawled, selector = set(), {s["site_id"]: s["sel_price"] for s in sites}
    history, metrics, fresh, outcome = [], [], [], []
    for k, i in enumerate(items):
        site, sku, url = i["site_id"], i["sku"].lower(), i["url"].lower()

        def same(v):
            s, u = (v["sku"] or "").lower(), (v["url"] or "").lower()
            return v["site_id"] == site and (
                (u != "" and v["clean"].lower() == url)
                or (s != "" and (s == sku or (len(sku) >= 4 and sku in s) or (len(s) >= 4 and s in sku)))
                or (u != "" and ((len(sku) >= 4 and sku in u) or (len(s) >= 4 and s in url)))
            )

        met = [v for v in vs if same(v)]
        price, stock = i["price"], i["price"] > 0
        if met:
            best = max(met, key=lambda v: (v.get("last", -1), v["updated_at"] is not None, v["updated_at"] or datetime.min, -v["variant_id"]))
            changed, created = best["price"] != price or best["in_stock"] != stock, False
            for v in met:
                v |= {"prev_price": v["price"], "price": price, "in_stock": stock, "updated_at": NOW, "url": i["url"], "clean": i["clean"], "active": True, "last": k}
                if i["image_url"] and not v["image_url"]:
                    v["image_url"] = i["image_url"]
        else:
            own = [p["product_id"] for p in ps if p["product_name"] == i["name"] and p["brand"] == i["brand"]]
            if not own:
                own = [max((p["product_id"] for p in ps), default=0) + 1]
                ps.append({"product_id": own[0], "product_name": i["name"][:200], "brand": i["brand"], "category": ex.CATEGORY})
            best = {"variant_id": max((v["variant_id"] for v in vs), default=0) + 1, "product_id": min(own), "site_id": site, "sku": i["sku"], "variant_name": i["name"], "url": i["url"], "clean": i["clean"], "price": price, "prev_price": None, "in_stock": stock, "updated_at": NOW, "image_url": i["image_url"], "active": True, "extra": None, "last": k}
            vs.append(best)
            changed = created = True
        outcome.append((i["item_id"], best["variant_id"], created, changed))
        if changed:
            history.append((best["variant_id"], price, stock))
        if (i["sel_price"] or "").strip() and price > 0:
            c = (site, i["sel_price"], best["variant_id"])
            if c not in cs:
                cs.add(c)
                fresh.append(c)
            if len([x for x in cs if x[:2] == c[:2]]) >= 3:
                selector[site] = i["sel_price"]
        metrics.append((site, best["variant_id"]))
        crawled.add(site)
    return vs, ps, selector, crawled, history, metrics, fresh, outcome


def made(spark, seed, n=70):
    rng = random.Random(seed)
    skus = ["ABC1", "abc12", "zz", "REF abc1", "Q-9999", "q-99991", "", "sku", "long-sku-7", "x", None]
    urls = ["https://s.com/a/1", "https://s.com/a/1?gclid=4", "https://s.com/p/abc12", "https://s.com/q/Q-9999/", "https://t.com/x-long-sku-7", "https://t.com/" + "y" * 6, " ", "https://s.com/zz?ref=1", "/rel#top"]
    names = ["Uno", "Dos", "n" * 250, "n" * 200, "n" * 320]
    paths = ["//a", "//b", " ", None]
    items = [(k, rng.choice(skus) or "K", rng.choice(names), rng.choice(urls), Decimal(rng.choice([0, 5, 5, 7])), rng.choice([None, "", "/i.png", "https://cdn.shopify.com/q.png"]), rng.choice(["s.com", " T.com", "none.org", "s.com"]), rng.choice([None, "B", "C / D"]), rng.choice(paths), "m", None, rng.choice([None, 3]), 4) for k in rng.sample(range(1, 999), n)]
    items.append((items[0][0], "zzz", "Uno", "https://s.com/zzz", Decimal(1), None, "s.com", None, None, None, None, None, None))  # an id that repeats
    sites = [(1, "https://s.com", None, None), (2, "https://t.com", "//old", None), (3, "https://u.com", "//u", datetime(2020, 1, 1))]
    variants = [(k, k % 4 + 1, 1 + k % 2, rng.choice(["abc1", "ABC12x", "", None, "Q-9999", "zz", "other"]), f"v{k}", rng.choice(["https://s.com/a/1/", "", None, "https://s.com/old", "https://s.com/q/Q-9999#x"]), rng.choice([None, Decimal(5), Decimal(7)]), None, rng.random() < 0.5, rng.choice([None, datetime(2024, 1, 1), datetime(2024, 2, 1)]), rng.choice([None, "", "i"]), rng.random() < 0.5, f"e{k}") for k in range(1, 16)]
    products = [(1, "Uno", "B", "c"), (2, "Uno", "B", "c"), (3, "Tres", "Genérica", "c"), (4, "Dos", "Genérica", "c")]
    candidates = [(1, 1, "//a"), (1, 3, "//a"), (2, 2, "//b")]
    return [spark.createDataFrame(r, s) for r, s in ((items, ITEM), (sites, SITE), (variants, VARIANT), (products, PRODUCT), (candidates, CANDIDATE))]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ingest_equals_a_loop(spark, seed):
    items, sites, variants, products, candidates = made(spark, seed)
    out = ex.ingest(items, sites, variants, products, candidates, AS_OF)
    rows = lambda df: [r.asDict() for r in df.collect()]
    # normalised by the functions alone
    rest = [c for c in items.columns if c != "item_id"]
    one = items.groupBy("item_id").agg(F.max(F.struct(*rest)).alias("x")).select("item_id", "x.*")
    url = clean_product_url(F.col("url"))
    clean = one.withColumns({"sku": normalize_sku(F.col("sku")), "brand": normalize_brand(F.col("brand")), "raw": F.col("url"), "url": url, "clean": clean_product_url(url), "image_url": normalize_image_url(make_absolute_url(F.col("image_url"), url)), "name": F.substring("name", 1, 300)})
    host = {"s.com": 1, "t.com": 2}
    good = [r | {"site_id": host[r["domain"].strip().lower()]} for r in rows(clean.orderBy("item_id")) if r["raw"].strip() and r["domain"].strip().lower() in host]
    old = rows(variants.withColumn("clean", clean_product_url(F.coalesce("url", F.lit("")))))
    vs, ps, selector, crawled, history, metrics, fresh, outcome = plain(good, rows(sites), old, rows(products), rows(candidates))
    assert sorted((r["item_id"], r["variant_id"], r["created"], r["changed"]) for r in out.outcome.collect()) == outcome
    strip = lambda v: tuple(str(v[c]) for c in variants.columns)
    assert sorted(map(strip, rows(out.variants))) == sorted(map(strip, vs))
    assert sorted((r["product_id"], r["product_name"], r["brand"], r["category"]) for r in out.products.collect()) == sorted((p["product_id"], p["product_name"], p["brand"], p["category"]) for p in ps)
    assert sorted((r["variant_id"], r["price"], r["in_stock"]) for r in out.history.collect()) == sorted(history)
    assert sorted((r["site_id"], r["xpath"], r["variant_id"]) for r in out.candidates.collect()) == sorted(fresh)
    assert sorted((r["site_id"], r["variant_id"]) for r in out.metrics.collect()) == sorted(metrics)
    assert {r["site_id"]: r["sel_price"] for r in out.sites.collect()} == selector
    assert {r["site_id"] for r in out.sites.collect() if r["last_crawl"] == NOW} == crawled
    assert len({r["item_id"] for r in out.rejected.collect()}) + len(good) == one.count()
    assert [r["created"] for r in out.outcome.collect()].count(False) > 5


def test_ingest_of_nothing(spark):
    items, sites, variants, products, candidates = made(spark, 1)
    out = ex.ingest(items.limit(0), sites, variants, products, candidates, AS_OF)
    assert out.variants.count() == 15 and out.history.count() == 0 and out.products.count() == 4 and out.candidates.count() == 0
    bare = ex.ingest(items, sites, variants.limit(0), products.limit(0), candidates.limit(0), AS_OF)
    assert min(r[0] for r in bare.variants.select("variant_id").collect()) == 1 and bare.outcome.where("created").count() > 0


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7), (None, 3), (1, 2)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            up[find(a)] = find(b)
    got = {r["node"]: r["head"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = [x for x in up if find(x) != x or any(find(y) == x for y in up if y != x)]
    assert set(got) == set(nodes)
    assert all((got[x] == got[y]) == (find(x) == find(y)) for x in nodes for y in nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_store_of_two_writers(spark, tmp_path):
    """Both read version 1; the second to commit is told so and merges anew."""
    path = f"file://{tmp_path}/store"
    first, second = Store(spark, path), Store(spark, path)
    row = lambda k: spark.createDataFrame([(k,)], "k int")
    assert first.commit({"t": row(1)})
    a, b = first.snapshot(), second.snapshot()
    assert first.commit({"t": a.table("t").union(row(2))}, base=a)
    with pytest.raises(CommitConflict):
        second.commit({"t": b.table("t").union(row(3))}, base=b)
    again = second.snapshot()
    assert second.commit({"t": again.table("t").union(row(3))}, base=again)
    assert sorted(r[0] for r in first.table("t").collect()) == [1, 2, 3] and b.table("t").count() == 1  # what was read stays as it was


def test_one_item_per_id(spark):
    variants = spark.createDataFrame([(1, 1, "AAAA1", "https://s/1", Decimal(10), None, True, None, "", True)], "variant_id int, site_id int, sku string, url string, price decimal(18,2), prev_price decimal(18,2), in_stock boolean, updated_at timestamp_ntz, image_url string, active boolean")
    items = spark.createDataFrame([(5, 1, "aaaa1", "https://s/9", Decimal(7), None), (5, 1, "aaaa1", "https://s/9", Decimal(6), None)], "item_id int, site_id int, item_sku string, item_url string, price decimal(18,2), image_url string")
    out = mg.extension_upsert(items, variants, AS_OF)
    assert [(r["variant_id"], int(r["price"])) for r in out["variants"].collect()] == [(1, 7)] and [int(r["price"]) for r in out["history"].collect()] == [7]


def test_numbered(spark):
    """Null and repeated keys keep their rows, and one far key doesn't bring the others to one task."""
    rows = [(None,), (None,), (5,), (5,), (9_000_000_000_000_000_000,), *((k,) for k in range(5000))]
    got = st.numbered(spark.createDataFrame(rows, "k long"), "k").orderBy("i").collect()
    assert [r["i"] for r in got] == list(range(len(rows)))
    assert [r["k"] for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    assert st.numbered(spark.createDataFrame([], "k long"), "k").count() == 0
    placed = spark.createDataFrame(rows, "k long").repartitionByRange(4, "k").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert max(r["count"] for r in placed) < 2500
    tasks = spark.createDataFrame([(None,), (3,), (4,)], "task_id long")
    proxies = spark.createDataFrame([(1, True, False), (2, True, False)], "proxy_id int, active boolean, banned boolean")
    assert sorted((r["task_id"] or 0, r["proxy_id"]) for r in st.round_robin(tasks, proxies).collect()) == [(0, 1), (3, 2), (4, 1)]


def test_cards_without_a_sku(spark):
    cards = spark.createDataFrame([(1, 1, None, Decimal(1), None), (2, 1, None, Decimal(0), None), (3, 1, "", Decimal(1), None), (4, 2, "", Decimal(1), None), (5, 2, "", Decimal(1), None), (6, 1, "a", Decimal(1), None), (7, 1, "A", Decimal(1), None)], "card_id int, site_id int, sku string, price decimal(18,2), brand string")
    variants = spark.createDataFrame([(1, "b")], "site_id int, sku string")
    assert sorted(r["card_id"] for r in mg.new_products(cards, variants).collect()) == [1, 2, 4, 6]
