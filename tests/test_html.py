from decimal import Decimal

import pytest

from pricelark.html import category, dom, nodes, product, readability, selectors, xpath


def tree(page):
    return dom.parse(page)


def test_dom_recovers():
    t = tree("<ul><li>a<li>b</ul><p>x<p>y<br>z</i><script>var t='</p>';</script>")
    assert [n.inner_text() for n in xpath.select(t, "//li")] == ["a", "b"]
    assert [n.inner_text() for n in xpath.select(t, "//p")][0] == "x"
    assert xpath.select(t, "//script")[0].inner_text() == "var t='</p>';"


@pytest.mark.parametrize(
    ("path", "want"),
    [("//b", ["1", "2", "3"]), ("//b[2]", ["2"]), ("(//b)[3]", ["3"]), ("//a/b[last()]", ["2", "3"]), ("//b[@k='v']", ["2"]), ("//*[contains(text(), '3')]", ["3"]), ("//b[not(@k)] | //c", ["1", "3", "4"]), ("//c/preceding::b[1]", ["3"]), ("//b[position() > 1 and true()]", ["2"]), ("//c[count(//b) = 3]", ["4"]), ("//b[normalize-space() = '1']", ["1"]), ("//b/parent::a/@id", ["x", "y"]), ("//c[self::c or .//z]", ["4"]), ("//a[translate(@id, 'xy', 'XY') = 'Y']/b", ["3"])],
)
def test_xpath(path, want):
    t = tree("<r><a id='x'><b> 1 </b><b k='v'>2</b></a><a id='y'><b>3</b></a><c>4</c></r>")
    assert [(n.text if isinstance(n, xpath.Attribute) else n.inner_text()).strip() for n in xpath.select(t, path)] == want


def test_selectors():
    for s in ["//div[@id='price']", "/html/body/div[1]", "id('price')", "(//span)[2]", ".//div/span", "div[@class='price']", "text()", "contains(text(), 'price')", "body/main[1]/div[5]", "div[1]"]:
        assert selectors.is_xpath(s)
    for s in ['a[href="http://example.com"]', "a[href='http://example.com']", "div.price", "#price", "div > span", "", None]:
        assert not selectors.is_xpath(s)
    for s in ["//div[@id=", "///", "//div[foo(1)]", ""]:
        assert not xpath.is_valid(s)
    for s in ["div.price", "#price", "div > span", "div[class='price']", "div:not(.active)"]:
        assert selectors.is_valid_css(s)
    for s in ["div[class", "div(", "div['x", "div > ", "div @ class", "a)", "", None]:
        assert not selectors.is_valid_css(s)
    assert selectors.first_invalid("//a", ".n", "", "div") is None
    assert selectors.first_invalid("//div[@id=", ".n", "", "div") == ("Precio", "//div[@id=")
    assert selectors.first_invalid("", " ", None, "") is None


def test_learned_selector():
    t = tree('<span class="price">$1,249.00</span><span>x</span>')
    holds = lambda s, p: selectors.learned_selector_holds(t, s, Decimal(p))
    assert holds("//span[@class='price']", "1249") and not holds("//span[@class='price']", "1250") and not holds("//span", "1249") and not holds("//b", "1249") and not holds("//b[", "1")


LD = '<script type="application/ld+json">%s</script>'


def test_structured_data():
    p = product.extract("<html><head>" + LD % '{"@type":"Product","name":"Whey","sku":"SKU 12","brand":{"name":"A/B"},"offers":{"price":"1249.99","priceCurrency":"mxn","availability":"https://schema.org/InStock"}}' + "</head><h1>Other</h1></html>")
    assert (p.name, p.price, p.in_stock, p.method, p.source, p.raw_price, p.currency, p.confidence, p.sku) == ("Whey", Decimal("1249.99"), True, product.BY_JSON, "JSON-LD", "1249.99", "MXN", 100, "12")
    p = product.extract(LD % '{"@graph":[{"@type":["Thing","Product"],"name":"G","offers":[{"price":999,"priceCurrency":"MXN","availability":"OutOfStock"},{"price":799,"priceCurrency":"MXN","availability":"InStock"}]}]}')
    assert (p.price, p.in_stock, p.currency) == (Decimal("799.00"), True, "MXN")
    p = product.extract(LD % "{bad" + LD % '{"@type":"ProductGroup","hasVariant":[{"@type":"product","name":"V","offers":{"lowPrice":699}}]}')
    assert (p.price, p.source, p.confidence) == (Decimal("699.00"), "JSON-LD (Precio mínimo)", 90)


def test_meta_and_dom():
    p = product.extract('<meta property="og:title" content="T"><meta property="product:price:amount" content="749.50"><meta property="product:availability" content="out of stock">')
    assert (p.name, p.price, p.in_stock, p.method) == ("T", Decimal("749.50"), False, product.BY_META)
    p = product.extract('<div><h1>N</h1><p class="product-price">Precio $649.00 hoy</p><p class="stock-warning">agotado</p></div>')
    assert (p.price, p.in_stock, p.method, p.confidence) == (Decimal("649.00"), False, product.BY_DOM, 50) and p.xpath
    p = product.extract('<main class="product-detail"><h1>X</h1><span class="old-price">$1,599.00</span><span class="monthly-price">$99</span><span class="sale-price">$1,249.00</span></main><section class="related"><span class="sale-price">$1</span></section>')
    assert (p.price, p.source) == (Decimal("1249.00"), "DOM semántico")
    p = product.extract('<main><h1>X</h1><b class="price">$9999</b><i class="stock">disponible</i></main><aside>agotado</aside>')
    assert (p.price, p.in_stock) == (Decimal("9999.00"), True)
    a, b = product.extract("<h1>Z</h1>"), product.extract("<h1>Z</h1>")
    a.name = "changed"
    assert b.name == "Z" and product.extract("<h1>Z</h1>").name == "Z" and product.extract(None) == product.Product()


def test_nodes():
    first = lambda p: tree(p).children[0]
    assert nodes.price_of(first('<div class="price"><span style="text-decoration: line-through">1,500</span><span class="fraction">1299</span><span class="cents">50</span></div>')) == Decimal("1299.50")
    assert nodes.price_of(first("<div><span>$</span><span>2,499</span><sup>90</sup></div>")) == Decimal("2499.90")
    assert nodes.price_of(first('<div><span class="badge">15% OFF</span><span class="amount">1299</span><span class="cents">50</span></div>')) == Decimal("1299.50")
    assert nodes.price_of(first('<div><del>$1,599</del><span>$1,249.99</span></div>')) == Decimal("1249.99")
    assert nodes.name_of(first('<h3>Whey 2kg <span class="promo-badge">10% OFF</span> - Envío gratis</h3>')) == "Whey 2kg"
    assert nodes.image_of(first("<div style=\"background-image: url('https://x/a.jpg')\"></div>")) == "https://x/a.jpg"
    pic = tree('<picture><source srcset="b.jpg 800w, a.jpg 1200w"><img src="c.jpg"></picture>')
    assert nodes.image_of(xpath.select(pic, "//img")[0]) == "a.jpg"


def card(i):
    return f'<div class="product-card"><a href="/p/{i}"><img src="/i{i}.jpg"></a><h3>Proteína {i}</h3><span class="price">${i}99.50</span></div>'


def test_grids():
    grid = tree('<div id="grid-container">' + "".join(map(card, (1, 2, 3))) + "</div>")
    for way in category.STRATEGIES[:3]:
        assert "grid-container" in category.detect(grid, way).container
    assert "product-card" in category.detect(grid, "semantic").container
    row = tree('<div id="catalog-row">' + "".join(f'<div class="col-md-4"><div class="card"><a href="/p/{i}"><img src="x.jpg"><h3>N {i}</h3><span class="price">$10</span></a></div></div>' for i in range(3)) + "</div>")
    assert "catalog-row" in category.detect(row).container and "/div[" in category.detect(row).container
    found = category.detect(tree('<main id="catalog-grid">' + "".join(map(card, range(1, 4))) + "</main>"), "repetitive")
    assert "catalog-grid" in found.container and "product-card" in found.container and found.name and found.price and found.link and found.image
    assert category.detect(tree("<p>a</p><div>b</div>")) is None


def test_read_category():
    page = '<div id="g">' + "".join(map(card, (1, 2, 3))) + '<div class="product-card"><a href="/c/all"><img src="x"></a><h3>Cat</h3></div></div><a rel="next" href="/l?page=2">2</a>'
    got = category.read_category(page, "https://s.com/l")
    assert [(p["name"], p["price"], p["url"]) for p in got.products] == [(f"Proteína {i}", Decimal(f"{i}99.50"), f"https://s.com/p/{i}") for i in (1, 2, 3)]
    assert got.next_url == "https://s.com/l?page=2" and len(got.diagnostics) == 1
    assert category.next_page(tree('<a href="/x">volver</a><a href="/2" aria-label="Página siguiente">›</a>')) == "/2"
    assert category.read_category(None, None).products == []


def test_readability():
    t = readability.pre_clean(tree('<html><head><title>t</title></head><body><script>x</script><style>y</style><header>h</header><nav>n</nav><!-- c --><div style="display:none">hid</div><div class="ad-container">ad</div><article>Only this body text.</article><footer>f</footer></body></html>'))
    assert t.inner_text().strip() == "Only this body text."
    text = readability.main_text('<body><div class="sidebar"><a href="#">one link</a> <a href="#">two links here</a></div><div class="x"><p>A long paragraph, with commas, and sentences. It goes on, and on; it ends.</p></div></body>')
    assert "A long paragraph" in text and "links" not in text
    assert readability.main_text("") == "" and readability.main_html(None) == ""


def test_client():
    from pricelark.html import client

    got = client.extract_client('<h1>Whey Pro</h1><span class="price">$1,299.50</span><main><img src="a.jpg"></main>', "https://s.com/p/12345")
    assert (got.name, got.price, got.sku, got.brand, got.image_url, got.confidence) == ("Whey Pro", Decimal("1299.50"), "12345", "Whey", "a.jpg", 0)
    assert client.extract_client("<h1>N</h1>", "https://s.com/x") is None
    gone = client.extract_client("<h1>N</h1><p>Agotado</p>", "https://s.com/x")
    assert gone.sku == client.stable_hash("https://s.com/x") and not gone.in_stock
    meli = client.extract_client('<h1 class="ui-pdp-title">T</h1><span class="andes-money-amount__fraction">1,249</span><span class="andes-money-amount__cents">50</span>', "https://www.mercadolibre.com.mx/x/p/MLM123456")
    assert (meli.price, meli.sku) == (Decimal("1249.50"), "MLM123456")
    costco = client.extract_client('<h1>Isopure</h1><b class="price">$10</b>', "https://www.costco.com.mx/x/p/777")
    assert (costco.sku, costco.brand) == ("777", "Isopure")
    deep = client.extract_client(LD % '{"a":{"b":[{"@type":"Product","name":"J","mpn":"m1","offers":[{"price":"5"}],"brand":{"name":"B"}}]}}', "https://s.com")
    assert (deep.name, deep.price, deep.sku, deep.brand) == ("J", Decimal("5.00"), "m1", "B")
    assert client.is_out_of_stock(tree('<p class="x no-stock">Publicación Pausada</p>'), "") and not client.is_out_of_stock(tree("<p>ok</p>"), "<p>ok</p>")


def test_follow_and_answers(spark):
    from pyspark.sql import functions as F

    from pricelark.functions import pages
    from pricelark.html import udfs

    rows = [("https://s.com/l", '<a rel="next" href="/l2">x</a>'), ("https://s.com/l2", '<a rel="next" href="/L">x</a>'), ("https://s.com/l3", "")]
    stored = spark.createDataFrame(rows, "url string, html string")
    got = udfs.follow_pages(stored.where("url <> 'https://s.com/l2'").select("url"), stored, 5).collect()
    assert sorted((r["start"], r["url"], r["page_no"]) for r in got) == [("https://s.com/l", "https://s.com/l", 1), ("https://s.com/l", "https://s.com/l2", 2), ("https://s.com/l3", "https://s.com/l3", 1)]
    text = "** 🏆 La Mejor Oferta: ** Whey a $10\n** 📊 Los Números: ** uno\ndos\n* x\n** 🥈 Mención Honorífica: ** otra"
    r = spark.createDataFrame([(text,)], "t string").select(pages.answer_sections(F.col("t")).alias("s"), pages.markdown_html(F.lit("a **b** <c>\n* d\ne")).alias("m")).first()
    assert tuple(r["s"]) == ("Whey a $10", "uno\ndos", "", "otra") and r["m"] == "a <strong>b</strong> &lt;c&gt;<br/>• d<br/>e"


def test_noise_and_layout_rules():
    cards = "".join(map(card, (1, 2, 3)))
    by = lambda page, way: category.detect(tree(page), way)
    for area in ('class="main-menu"', 'id="TopNav"', 'class="x-Header"'):
        page = f"<div {area}><div><div>{cards}</div></div></div>"
        assert all(by(page, w) is None for w in ("structural", "density", "semantic")) and by(page, "repetitive")
    for tag in ("header", "footer", "nav", "aside"):
        assert by(f"<{tag}><div>{cards}</div></{tag}>", "density") is None
    page = f'<form><section id="list">{cards}</section></form>'
    assert by(page, "structural").container.startswith("//*[@id='list']/div[") and by(page, "density").container.startswith("//*[@id='list']/div[") and "product-card" in by(page, "semantic").container
    for c in ("mdc-x", "mat-x", "ng-x", "divide-x", "ring-1", "outline-none", "select-none", "resize-y", "pointer-events-none", "my-bootstrap-x", "md:flex", "p-4", "row"):
        assert category.utility_class(c)
    for c in ("card", "rowdy", "p-x", "md"):
        assert not category.utility_class(c)
    only = lambda c: category.telling_classes(tree(f'<i class="{c} z b"></i>').children[0])
    assert only("divide-x") == only("Ring-1") == only("col-12") == only("item20241") == only("BOOTSTRAP") == only("hover:x") == ["b", "z"] and only("my-bootstrap-x") == ["b", "my-bootstrap-x", "z"]


def test_structural_rules():
    tile = '<li><div class="in"><a href="/p/{0}"><img src="{0}.jpg"></a><a href="/p/{0}">Café {0}</a><span class="money">{0}</span></div></li>'
    page = "<main><ul>" + "".join(tile.format(k) for k in range(4)) + "</ul></main>"
    assert category.detect(tree(page), "structural").container == "//main/ul/li/div" + category.CARD  # the inner card, as none has a title; up to the top
    titled = page.replace("<li>", "<li><h3>T</h3>")
    assert category.detect(tree(titled), "structural").container == "//main/ul/li" + category.CARD  # the outer one has the title
    deep = "<body><i><b><u><s><q>" + tile.format(1) + tile.format(2) + tile.format(3) + "</q></s></u></b></i></body>"
    assert category.detect(tree(deep), "structural").container == "//body/i/b/u/s/q/li/div" + category.CARD
    assert category.detect(tree("<body>" + tile.format(1) + tile.format(2) + "</body>"), "structural") is None


def test_single_product_selectors():
    found = category.detect(tree('<div class="ui-pdp"><h1>Uno</h1><b property="price">$ 12</b></div>'))
    assert (found.strategy, found.pager) == ("single", "")
    for part in ("ui-pdp", "@id, 'product'", "//main"):
        assert part in found.container
    for part in ("andes-money-amount__fraction", "a-price-whole", "@property, 'price'"):
        assert part in found.price
    got = category.read_category('<div class="product ui-pdp"><h1>Uno</h1><a href="/p/1">x</a><b property="price">$ 12</b></div>', "https://s.com")
    assert [(p["name"], p["price"], p["url"]) for p in got.products] == [("Uno", Decimal("12.00"), "https://s.com/p/1")]


def test_wrapped_and_custom_tags():
    columns = "".join(f'<div class="col-md-4"><div class="card"><a class="link" href="/p/{k}"><img src="{k}.jpg"><h2>Artículo {k}</h2><div class="amount">$ {k}00.00</div></a></div></div>' for k in (1, 2, 3))
    found = category.detect(tree(f'<div class="row" id="catalog-row">{columns}</div>'))
    assert "catalog-row" in found.container and "/div[" in found.container
    items = "".join(f'<x-item class="col-md-4"><a class="thumb" href="/p/123{k}"><img class="product-image" src="{k}.jpg"></a><div class="lister-name"><a href="/p/123{k}"><span>Avena {k} kg</span></a></div><div class="product-price-amount"><span>$1,{k}49.00</span></div></x-item>' for k in (1, 2, 3))
    page = f'<x-layout class="ListPage"><x-list><div class="container"><div class="row">{items}</div></div></x-list></x-layout>'
    assert "x-item" in category.detect(tree(page)).container
    got = category.read_category(page, "https://www.costco.com.mx")
    assert [(p["name"], p["price"], p["sku"]) for p in got.products] == [(f"Avena {k} kg", Decimal(f"1{k}49.00"), f"123{k}") for k in (1, 2, 3)]
    blocked = category.read_category(page + "<i>Verifica tu identidad</i>", "https://www.costco.com.mx")
    assert (blocked.products, blocked.strategy) == ([], "Cloudflare")


def test_evaluate_capture(spark):
    from pricelark.html import udfs

    ld = LD % '{"@type":"Product","name":"W","offers":{"price":"20"}}'
    sites = [(1, "https://s.com", "Standard", "//b[@id='p']", None, "//img"), (2, "https://t.com", "Standard", "//b[", None, None), (3, "https://u.com", "Cloudflare", " ", None, None)]
    captures = [
        (1, 11, '<b id="p">$ 12.50</b><img src="/a.jpg">', None),  # the site's selectors
        (2, 11, ld + "<noscript>enable javascript</noscript>", "sin selector"),  # they fail, the extraction doesn't
        (3, 11, "<title>Just a moment</title><i>cf-challenge</i>", "Selector no encontrado"),  # nothing
        (4, 12, ld, "x"),  # malformed selectors
        (5, 13, '<main class="product"><h1>Z</h1><span class="price">$ 7.00</span></main>', None),  # no selector
        (6, 99, ld, "y"),  # no site
    ]
    got = udfs.evaluate_capture(
        spark.createDataFrame(captures, "capture_id int, variant_id int, html string, error string"),
        spark.createDataFrame([(11, 1), (12, 2), (13, 3)], "variant_id int, site_id int"),
        spark.createDataFrame(sites, "site_id int, url_base string, strategy string, price_selector string, stock_selector string, image_selector string"),
    ).collect()
    by = {r["capture_id"]: r for r in got}
    assert (by[1]["ok"], by[1]["price"], by[1]["method"], by[1]["image_url"], by[1]["message"]) == (True, Decimal("12.50"), "Selector configurado", "https://s.com/a.jpg", None)
    assert (by[2]["ok"], by[2]["price"], by[2]["method"], by[2]["recommended"], by[2]["message"]) == (True, Decimal("20.00"), product.BY_JSON, "Heavy-JS", f"Extraido via heuristica ({product.BY_JSON})")
    assert (by[3]["ok"], by[3]["price"], by[3]["recommended"], by[3]["message"]) == (False, None, "Cloudflare", "Selector no encontrado")
    assert (by[4]["ok"], by[4]["recommended"]) == (False, None)
    assert (by[5]["ok"], by[5]["price"], by[5]["recommended"]) == (True, Decimal("7.00"), None) and by[5]["learned_selector"]
    assert by[6]["ok"] and by[6]["recommended"] is None
