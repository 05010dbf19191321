from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricelark.functions import price, text, urls
from pricelark.html import values as V

PRICES = [("$9999", "9999"), ("MXN 1,250.50", "1250.50"), ("1.250,50 EUR", "1250.50"), ("999 MXN", "999"), ("£ 89.95", "89.95"), ("123", "123"), ("123.45", "123.45"), ("  $1,234.56 ", "1234.56"), ("Precio: $1,299.00 MXN", "1299"), ("1.250,75", "1250.75"), ("1299,50", "1299.50"), ("$ 9.99", "9.99"), ("  $ 45,200  ", "45200"), ("$1,249.99 MXN", "1249.99"), ("Precio: $1.249,99 USD", "1249.99"), ("749.50", "749.50"), ("$1.250", "1250"), (None, None), ("", None), ("   ", None), ("Agotado", None), ("Sin stock", None), ("Precio a consultar", None), ("abc", None), ("1.2345", None), ("1,234,56", None), ("A 12 meses € 1.250,50", "12"), ("Antes de hoy, 12 meses MXN 1.250,50", "1250.50"), ("0", None)]


def one(spark, make, *values):
    rows = spark.createDataFrame([(k, *v) for k, v in enumerate(values)], "k int, " + ", ".join(f"c{i} string" for i in range(len(values[0]))))
    return [r[1] for r in rows.select("k", make(*(F.col(f"c{i}") for i in range(len(values[0]))))).orderBy("k").collect()]


def test_parse_price(spark):
    got = one(spark, price.parse_price, *[(t,) for t, _ in PRICES])
    assert [None if g is None else g["price"] for g in got] == [None if e is None else Decimal(e) for _, e in PRICES]
    assert [None if (v := V.parse_price(t)) is None else v.price for t, _ in PRICES] == [None if e is None else Decimal(e) for _, e in PRICES]
    usd = one(spark, price.parse_price, ("USD 1,299.00",))[0]
    assert (usd["price"], usd["currency"], usd["raw"]) == (Decimal("1299.00"), "USD", "1,299.00")


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="0123456789.,$€£ MXNUSDmx-", max_size=30), min_size=50, max_size=50))
def test_parse_price_native_equals_python(spark, texts):
    got = one(spark, price.parse_price, *[(t,) for t in texts])
    assert [g and (g["price"], g["currency"], g["raw"]) for g in got] == [(v := V.parse_price(t)) and tuple(v) for t in texts]


def test_names(spark):
    cases = [("Gold Standard Protein 2kg - 10% OFF", "Gold Standard Protein 2kg"), ("Orgain Protein 1.2kg (Envío Gratis)", "Orgain Protein 1.2kg"), ("  MuscleTech Nitrotech   5lbs  ", "MuscleTech Nitrotech 5lbs"), ("BCAA Powder - Oferta Especial /", "BCAA Powder"), (None, ""), ("  ", ""), ("A &amp; B PROMOCIÓN", "A & B")]
    assert one(spark, text.normalize_name, *[(c,) for c, _ in cases]) == [e for _, e in cases]
    assert [V.normalize_name(c) for c, _ in cases] == [e for _, e in cases]


def test_stock_brand_sku(spark):
    assert one(spark, text.normalize_stock, ("Out of stock", "instock"), ("In Stock", "Some other page text"), (None, "producto agotado"), (None, None)) == [False, True, False, True]
    assert one(spark, text.normalize_brand, ("VIDANAT/VITAMINAS",), (" ",), (None,), ("x",), ("A  B",)) == ["VIDANAT", "Genérica", "Genérica", "Genérica", "A B"]
    assert one(spark, text.normalize_sku, ("modelo X",), ("SKU: 1",), ("código 77",), (None,), ("REF 9",)) == ["o X", ": 1", "77", "", "9"]
    assert one(spark, text.brand_from_name, ("Isopure Zero",), ("ON whey",), ("Gold whey",), ("Optimum Nutrition Gold",)) == ["Isopure", "Genérica", "Gold", "Optimum Nutrition"]
    assert one(spark, text.stable_hash, ("abc",), ("",)) == ["GEN-22CI", "GEN-0"]


def test_urls(spark):
    assert one(spark, urls.clean_product_url, ("https://s.com/p/1?x=1",), ("https://s.com/a?utm_source=f&b=2&REF=3#t",), ("https://s.com/a/?gclid=1",), ("https://s.com/mlm-123?x=1//",), ("https://s.com/a///",), (None,)) == ["https://s.com/p/1", "https://s.com/a?b=2", "https://s.com/a", "https://s.com/mlm-123", "https://s.com/a", ""]
    assert one(spark, urls.make_absolute_url, ("//x/a", "https://b.c"), ("/a", "https://b.c:8080/z"), ("/a", "bad"), ("q", None), (None, "https://b.c")) == ["https://x/a", "https://b.c/a", "/a", "q", ""]
    assert one(spark, urls.is_valid_link, ("javascript:void(0)",), ("#",), ("/",), ("tel:+1",), ("mailto:a@b",), ("https://s.com/p/1",), ("/p/pantalla",), (None,)) == [False] * 5 + [True, True, False]
    assert one(spark, urls.best_srcset_url, ("a.jpg 800w, b.jpg 1200w",), ("a 1x, b 2x",), ("a, b",), (" ",)) == ["b.jpg", "b", "a", None]
    assert one(spark, urls.normalize_image_url, ("https://x/cdn/shop/a.jpg",), ("https://cdn.shopify.com/a?v=1",), ("https://cdn.shopify.com/a?width=9&b=1",), ("z",), (None,)) == ["https://x/cdn/shop/a.jpg?width=2000", "https://cdn.shopify.com/a?v=1&width=2000", "https://cdn.shopify.com/a?width=2000&b=1", "z", ""]
    skus = ["https://s.com/x?sku=ab12c", "https://s.com/p/1264415", "https://s.com/a-1264415.html", "https://s.com/MLM123456789x", "https://s.com/x"]
    assert one(spark, urls.deduce_sku, *[(u,) for u in skus]) == [V.deduce_sku(u) for u in skus]
    assert one(spark, urls.same_site, ("https://www.a.com/x", "https://a.com"), ("https://m.a.com", "https://a.com"), ("https://ba.com", "https://a.com")) == [True, True, False]


@pytest.mark.parametrize(
    ("page", "error", "title", "want"),
    [("<div class='cf-challenge'>", None, None, "Cloudflare"), ("x Ray ID: 1", None, None, "Cloudflare"), ("px-captcha", None, None, "Cloudflare"), ("ok", None, "Attention Required! | x", "Cloudflare"), ("", "403 Forbidden", None, "Cloudflare"), ("", "timeout", None, "Standard"), ("<NOSCRIPT>", None, None, "Heavy-JS"), ('<div id="root"></div>', None, None, "Heavy-JS"), ("<p>ok</p>", None, None, "Standard")],
)
def test_detect_strategy(spark, page, error, title, want):
    assert one(spark, text.detect_strategy, (page, error, title)) == [want]
