from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pricelark.functions.text import normalize_sku
from pricelark.functions.urls import clean_product_url
from pricelark.operators import analytics as an
from pricelark.operators import merge as mg
from pricelark.operators import stateful as st
from pricelark.operators.store import Store
from pricelark.plans import catalog
from pricelark.plans.domain import Domain

V = "variant_id int, site_id int, sku string, url string, price decimal(18,2), prev_price decimal(18,2), in_stock boolean, updated_at timestamp_ntz, image_url string, active boolean"
D = datetime(2024, 1, 1)
d = lambda k: D + timedelta(days=k)
m = Decimal


@pytest.fixture
def state(spark):
    rows = [(1, 1, "AAAA1", "https://s/p/1", m(10), None, True, d(0), "i", True), (2, 1, "AAAA2", "https://s/p/2?ref=1", None, None, False, None, None, True), (3, 2, "AAAA3", "https://s/p/2/", m(30), m(31), True, d(5), "", False)]
    return spark.createDataFrame(rows, V), spark.createDataFrame([(1, None), (2, None)], "site_id int, last_crawl timestamp_ntz")


BATCH = "variant_id int, price decimal(18,2), in_stock boolean, captured_at timestamp_ntz, image_url string"


def test_bulk_merge(spark, state):
    variants, sites = state
    batch = spark.createDataFrame([(1, m(10), True, d(9), "n"), (2, m(5), True, d(9), "n"), (2, m(6), True, d(8), "o"), (3, m(30), False, d(7), "n"), (99, m(1), True, d(9), None)], BATCH)
    done = mg.bulk_merge(variants, sites, batch)
    assert sorted((r[0], int(r[1])) for r in done.history.collect()) == [(2, 5), (2, 6), (3, 30)]
    got = {r["variant_id"]: r for r in done.variants.collect()}
    assert (got[1]["prev_price"], got[1]["price"], got[1]["image_url"], got[1]["updated_at"]) == (m(10), m(10), "i", d(9))
    assert (got[2]["prev_price"], got[2]["price"], got[2]["image_url"]) == (None, m(5), "n")
    assert (got[3]["in_stock"], got[3]["image_url"]) == (False, "n")
    assert {r[0]: r[1] for r in done.sites.collect()} == {1: d(9), 2: d(7)}
    again = mg.bulk_merge(done.variants, done.sites, mg.latest_items(batch))
    assert again.history.count() == 0  # replaying what is there adds nothing
    assert mg.bulk_merge(done.variants, done.sites, batch, force_history=True).history.count() == 4
    none = mg.bulk_merge(variants, sites, None)
    assert (none.ok, none.message, none.history.count()) == (False, mg.EMPTY_BATCH, 0)


def test_duplicates(spark, state):
    variants, _ = state
    losers = mg.duplicate_map(variants)
    assert [tuple(r) for r in losers.collect()] == [(2, 3)]
    left = mg.without(variants, losers, "loser")
    assert mg.duplicate_map(left).count() == 0
    history = spark.createDataFrame([(2, 1), (3, 2)], "variant_id int, k int")
    assert sorted(tuple(r) for r in mg.remap_history(history, losers).collect()) == [(3, 1), (3, 2)]
    assert {r["variant_id"]: r["active"] for r in mg.deactivate(variants, 3).collect()} == {1: True, 2: False, 3: False}


def test_fuzzy_and_upsert(spark, state):
    variants, _ = state
    items = spark.createDataFrame([(1, 1, "sku aaaa1", "https://z/x", m(12), None), (2, 1, "q", "https://s/p/2", m(0), "https://cdn.shopify.com/a"), (3, 1, "none", "https://z/none", m(1), None)], "item_id int, site_id int, item_sku string, item_url string, price decimal(18,2), image_url string")
    out = mg.extension_upsert(items, variants, "2024-02-01 00:00:00")
    got = {r["variant_id"]: r for r in out["variants"].collect()}
    assert (got[1]["price"], got[1]["prev_price"], got[1]["url"]) == (m(12), m(10), "https://z/x")
    assert (got[2]["price"], got[2]["in_stock"], got[2]["image_url"]) == (m(0), False, "https://cdn.shopify.com/a?width=2000")
    assert got[3]["price"] == m(30)
    assert sorted((r[0], int(r[1])) for r in out["history"].collect()) == [(1, 12), (2, 0)]
    assert [r["item_id"] for r in out["fresh"].collect()] == [3]


def test_fuzzy_branches(spark):
    """Each branch of the match against a comparison of all pairs, with repeated rows, nulls and short texts."""
    skus, urls = ["sku abc12", "abc1", "abc12x", "abc", "", None, "zz", "Z-99999"], ["https://s/p/1?gclid=1", "https://s/q/abc12/", "https://S/P/1", "abc1", "", None]
    items = [(k, k % 2, a, b) for k, (a, b) in enumerate((a, b) for a in skus for b in urls)]
    variants = [(k, k % 2 if k % 9 else None, a, b, None) for k, (a, b) in enumerate((a, b) for a in ["ABC12", "abc", "xabc12x", "", None, "9999"] for b in ["https://s/p/1", "https://s/q/ABC12#x", "https://s/z-99999", "", None])]
    left = spark.createDataFrame([*items, items[0]], "item_id int, site_id int, item_sku string, item_url string")
    right = spark.createDataFrame([*variants, variants[1]], "variant_id int, site_id int, sku string, url string, updated_at timestamp_ntz")
    made = left.select("item_id", F.col("site_id").alias("s"), F.lower(normalize_sku(F.col("item_sku"))).alias("b"), F.lower(clean_product_url(F.col("item_url"))).alias("y")).collect()
    known = right.select("variant_id", F.col("site_id").alias("s"), F.lower(F.coalesce("sku", F.lit(""))).alias("a"), F.lower(F.coalesce("url", F.lit(""))).alias("x"), F.lower(clean_product_url(F.col("url"))).alias("c")).collect()
    holds = lambda t, n: t is not None and n is not None and len(n) >= 4 and n in t
    same = lambda i, v: i.s == v.s and ((v.x != "" and (v.c == i.y or holds(v.x, i.b) or holds(i.y, v.a))) or (v.a != "" and (v.a == i.b or holds(v.a, i.b) or holds(i.b, v.a))))
    want = sorted((i.item_id, v.variant_id) for i in made for v in known if same(i, v))
    found = mg.fuzzy_match(left, right)
    assert want and sorted((r["item_id"], r["variant_id"]) for r in found.collect()) == want
    joins = [x for x in found._jdf.queryExecution().executedPlan().toString().lower().splitlines() if "hashjoin" in x or "mergejoin" in x or "nestedloop" in x or "cartesian" in x]
    assert joins and not any("contains(" in x or "nestedloop" in x or "cartesian" in x for x in joins)


def test_fuzzy_takes_all_events(spark, sf):
    d = Domain(spark, sf)
    got = catalog.queries()["fuzzy_match"](spark, sf)
    assert catalog._incoming(d).count() == d.table("events").count()
    assert got.where("item_id >= 60").count() > 60


def test_products_and_updates(spark):
    products = spark.createDataFrame([(5, "A", "X"), (7, "A", "X")], "product_id int, product_name string, brand string")
    items = spark.createDataFrame([(1, "A", "X"), (2, "B", None), (3, "B", None)], "item_id int, item_name string, item_brand string")
    assert sorted((r["item_id"], r["product_id"], r["created"]) for r in mg.find_products(items, products).collect()) == [(1, 5, False), (2, 8, True), (3, 8, True)]
    upd = spark.createDataFrame([(5, "Z")], "product_id int, brand string")
    assert sorted(tuple(r) for r in mg.apply_updates(products, upd, "product_id").collect()) == [(5, "A", "Z"), (7, "A", "X")]
    variants = spark.createDataFrame([("s1", 3, 9), ("s1", 2, 8)], "sku string, variant_id int, product_id int")
    new = spark.createDataFrame([("s1",), ("s2",)], "item_sku string")
    assert sorted((r[0], r[1]) for r in mg.adopt_products(new, variants).collect()) == [("s1", 8), ("s2", None)]
    hosts = mg.match_hosts(spark.createDataFrame([("https://www.a.com/x",), ("https://b.org",)], "url string"), spark.createDataFrame([(1, "https://shop.a.com"), (2, "https://a.com")], "site_id int, url_base string"))
    assert sorted((r["url"], r["site_id"]) for r in hosts.collect()) == [("https://www.a.com/x", 1), ("https://www.a.com/x", 2)]


def test_promotion(spark):
    rows = [(1, 1, 1, "//a", m(5), d(0)), (2, 1, 1, "//a", m(5), d(1)), (3, 1, 2, "//a", m(5), d(2)), (4, 1, 3, "//b", m(0), d(2)), (5, 1, 4, " ", m(1), d(2))]
    c = spark.createDataFrame(rows, "candidate_id int, site_id int, variant_id int, xpath string, price decimal(18,2), validated_at timestamp_ntz")
    assert [(r["variants"], r["current"]) for r in st.selector_promotion(c).collect()] == [(2, False)]
    more = c.union(spark.createDataFrame([(6, 1, 3, "//a", m(5), d(3))], c.schema))
    assert [(r["xpath"], r["variants"], r["promoted_at"], r["current"]) for r in st.selector_promotion(more).collect()] == [("//a", 3, d(3), True)]


def test_proxies_and_limits(spark):
    res = spark.createDataFrame([(k, 1, d(k), ok) for k, ok in enumerate([False] * 5 + [True, False])], "result_id int, proxy_id int, tried_at timestamp_ntz, ok boolean")
    rows = st.proxy_health(res).orderBy("result_id").collect()
    assert [r["failures"] for r in rows] == [1, 2, 3, 4, 5, 0, 1] and [r["banned"] for r in rows] == [False] * 4 + [True] * 3
    assert [r["banned"] for r in st.proxy_health(res, unban=True).orderBy("result_id").collect()][-2:] == [False, False]
    att = spark.createDataFrame([(k, 1, D + timedelta(minutes=k)) for k in range(12)] + [(12, 1, d(1))], "attempt_id int, variant_id int, attempted_at timestamp_ntz")
    assert [r["allowed"] for r in st.attempt_limiter(att).orderBy("attempt_id").collect()] == [True] * 10 + [False, False, True]
    tasks = spark.createDataFrame([(k,) for k in range(3)], "task_id int")
    proxies = spark.createDataFrame([(1, True, False), (2, True, False), (3, True, True)], "proxy_id int, active boolean, banned boolean")
    assert [r["proxy_id"] for r in st.round_robin(tasks, proxies).orderBy("task_id").collect()] == [1, 2, 1]


def test_chart(spark):
    h = spark.createDataFrame([(1, 9, m(k), d(k), k, 0, 0) for k in range(9)] + [(2, 9, m(50), d(8), 99, 0, 0)], "variant_id int, product_id int, price decimal(18,2), captured_at timestamp_ntz, k1 int, k2 int, k3 int")
    v = spark.createDataFrame([(1, 9, m(8)), (2, 9, m(50)), (3, 9, None), (4, 7, m(3)), (5, 7, None)], "variant_id int, product_id int, price decimal(18,2)")
    got = an.price_chart(h, v, "2024-03-01 00:00:00").collect()
    by = lambda k: sorted((r["label"], int(r["price"])) for r in got if r["variant_id"] == k)
    assert [p for _, p in by(1)] == [2, 3, 4, 5, 6, 7, 8] and {p for _, p in by(2)} == {50} and {p for _, p in by(3)} == {0}
    assert by(4) == [("01/03/2024", 3)] and by(5) == []


def test_queues_at_the_limit(spark):
    sites = spark.createDataFrame([(1, "S", 360, True)], "site_id int, site_name string, interval_minutes int, active boolean")
    at = datetime(2024, 1, 2, 6)
    v = spark.createDataFrame([(1, 1, at - timedelta(minutes=360), True), (2, 1, at - timedelta(minutes=361), True), (3, 1, None, True), (4, 9, at - timedelta(days=3), True)], "variant_id int, site_id int, updated_at timestamp_ntz, active boolean")
    assert an.pending_total(v, sites, str(at)).first()[0] == 2  # strictly before, and a site must be there
    assert sorted(r[0] for r in an.due_variants(v, sites, str(at)).collect()) == [1, 2, 3]


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    a = spark.range(3).withColumn("v", F.lit(1))
    assert s.commit({"t": a}, {"h": a}) and s.commit({"t": a.where("id > 0")}, {"h": a}, batch=("q", 7))
    assert s.table("t").count() == 2 and s.table("h").count() == 6
    assert not s.commit({"t": a}, batch=("q", 7)) and not s.commit({"t": a}, batch=("q", 6)) and s.table("t").count() == 2
    assert s.commit({"t": a}, batch=("other", 0)) and s.table("t").count() == 3  # another stream counts for itself


def test_store_second_writer(spark, tmp_path, monkeypatch):
    """Of two writers that read the same pointer the second one fails, and its table isn't seen."""
    path = f"file://{tmp_path}/store"
    first, second = Store(spark, path), Store(spark, path)
    rows = spark.range(1).withColumn("v", F.lit("start"))
    assert first.commit({"t": rows})
    seen = second._pointers()
    assert first.commit({"t": rows.withColumn("v", F.lit("first"))})
    monkeypatch.setattr(second, "_pointers", lambda: seen)
    with pytest.raises(RuntimeError, match="another commit came first"):
        second.commit({"t": rows.withColumn("v", F.lit("second"))})
    assert Store(spark, path).table("t").first()["v"] == "first" and first._pointers() == [1, 2]


def test_store_folders_and_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Store, "FANOUT", 3)
    s = Store(spark, f"file://{tmp_path}/store")
    for k in range(10):
        s.commit(appended={"h": spark.range(k, k + 1)})
    assert sorted(r[0] for r in s.table("h").collect()) == list(range(10)) and len(s.state()["h"].split(",")) <= 4
    rows = spark.range(40).withColumn("v", F.lit(0))
    s.commit(patched={"b": (rows, "id", 4, None)})
    one = s.buckets("b", [2])
    assert s.has_buckets("b", 4) and not s.has_buckets("b", 8) and 0 < one.count() < 40
    s.commit(patched={"b": (one.withColumn("v", F.lit(1)), "id", 4, [2])})
    got = s.table("b").collect()
    assert sorted(r["id"] for r in got) == list(range(40)) and {r["id"] for r in got if r["v"] == 1} == {r["id"] for r in one.collect()}
    assert s.buckets("b", [9]).count() == 0


def test_empty_batch_and_ties(spark, state):
    variants, sites = state
    none = mg.bulk_merge(variants, sites, spark.createDataFrame([], BATCH))
    assert (none.ok, none.message, none.history.count()) == (False, mg.EMPTY_BATCH, 0)
    tied = [(1, m(5), True, d(9), "b"), (1, m(5), True, d(9), "c"), (1, m(5), False, d(9), "z"), (1, m(4), True, d(9), "zz")]
    for rows in (tied, tied[::-1]):
        assert tuple(mg.latest_items(spark.createDataFrame(rows, BATCH)).first()) == (1, m(5), True, d(9), "c")


def test_register_and_widths(spark):
    variants = spark.createDataFrame([(1, 7, 1, "A"), (2, 8, 2, "A"), (3, 9, 2, None)], "variant_id int, product_id int, site_id int, sku string")
    rows = [(1, 50, 1, "A", m(3), True), (2, 51, 3, "A", m(3), True), (3, 52, 3, "A", None, True), (4, 53, 3, "B", None, False), (5, 54, 2, None, m(1), True)]
    items = spark.createDataFrame(rows, "item_id int, product_id int, site_id int, item_sku string, price decimal(18,2), in_stock boolean")
    out = mg.register_variants(items, variants, "2024-02-01 00:00:00")
    assert sorted((r["item_id"], r["product_id"], r["linked"]) for r in out["variants"].collect()) == [(2, 7, True), (4, 53, False)]
    assert [(r["item_id"], r["price"]) for r in out["history"].collect()] == [(2, m(3))]
    assert sorted(r["item_id"] for r in out["rejected"].collect()) == [1, 3, 5]
    wide = spark.createDataFrame([("n" * 301, None, None, "u" * 1001, None)], "name string, sku string, brand string, url string, image_url string")
    r = mg.fit_columns(wide).first()
    assert (len(r["name"]), r["sku"], r["brand"], len(r["url"]), r["image_url"]) == (300, "", "Genérica", 1000, None)


def test_running_state_in_blocks(spark):
    """Counts that go on from one block of time to the next, against a loop."""
    rows = [(k, k % 2, D + timedelta(minutes=7 * (k * 37 % 101)), (k * k) % 11 == 0) for k in range(200)]
    res = spark.createDataFrame(rows, "result_id int, proxy_id int, tried_at timestamp_ntz, ok boolean")
    for unban in (False, True):
        want, n, banned = {}, {}, {}
        for i, p, _, ok in sorted(rows, key=lambda r: (r[2], r[0])):
            n[p] = 0 if ok else n.get(p, 0) + 1
            banned[p] = n[p] >= 5 if unban else banned.get(p, False) or n[p] >= 5
            want[i] = (n[p], banned[p])
        assert {r["result_id"]: (r["failures"], r["banned"]) for r in st.proxy_health(res, unban=unban).collect()} == want
