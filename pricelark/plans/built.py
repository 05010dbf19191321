"""Queries over pages that are built from table columns, so that SQL can say what is to be found in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelark.html import category, product, udfs
from pricelark.plans.catalog import query
from pricelark.plans.domain import Domain
from pricelark.scratch import shuffle_partitions


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))


def _key() -> Column:
    return F.col("p_partkey")


def _parts(d: Domain) -> DataFrame:
    """A row per page. Pages are small but dear to read, so they are dealt out instead of following the files."""
    rows = d.table("part").select("p_partkey", "p_name", "p_size", F.format_string("%.2f", "p_retailprice").alias("cost"))
    return rows.repartition(shuffle_partitions(d.spark), "p_partkey")


def _pick(n: int, *choices: Column) -> Column:
    return F.element_at(F.array(*choices), (_key() % n + 1).cast("int"))


@query(f"""SELECT p_partkey AS page_id, p_name AS name, round(p_retailprice, 2)::DECIMAL(18,2) AS price, p_partkey % 4 <> 3 AS in_stock, CASE WHEN p_partkey % 4 IN (0, 3) THEN '{product.BY_JSON}' WHEN p_partkey % 4 = 1 THEN '{product.BY_META}' ELSE '{product.BY_DOM}' END AS method FROM part""")
def extract_product_built(d: Domain) -> DataFrame:
    """HTM-1 to HTM-6: structured data, meta tags, plain elements."""
    k, name, cost = _key(), F.col("p_name"), F.col("cost")
    said = F.when(k % 4 == 0, "InStock").otherwise("OutOfStock")
    ld = _text('<h1>x</h1><script type="application/ld+json">{"@type":"Product","name":"', name, '","offers":{"price":"', cost, '","availability":"https://schema.org/', said, '"}}</script>')
    meta = _text('<meta property="og:title" content="', name, '"><meta property="product:price:amount" content="', cost, '">')
    plain = _text('<main class="product-detail"><h1>', name, '</h1><span class="old-price">$99999.00</span><span class="sale-price">$', cost, "</span></main>")
    page = F.when(k % 4 == 1, meta).when(k % 4 == 2, plain).otherwise(ld)
    return udfs.extract_once(_parts(d).select(k.alias("page_id"), page.alias("html"))).select("page_id", "product.name", "product.price", "product.in_stock", "product.method")


@query(f"""SELECT page_id, CASE WHEN n >= 3 THEN '//*[@id=''list-' || chr(CAST(97 + page_id % 26 AS INTEGER)) || ''']/li[contains(@class, ''' || CASE WHEN page_id % 2 = 0 THEN 'tile' ELSE 'item-box' END || ''')]{category.CARD}' END AS container,
  CASE WHEN n >= 3 THEN 'repetitive' END AS strategy FROM (SELECT p_partkey // 7 AS page_id, count(*) AS n FROM part GROUP BY 1)""")
def detect_grid_built(d: Domain) -> DataFrame:
    """HTM-19, HTM-24: classes for looks are left out of the selector."""
    page_id = F.col("page_id")
    cards = d.table("part").withColumn("page_id", F.floor(_key() / 7)).repartition(shuffle_partitions(d.spark), "page_id")
    kind = F.when(page_id % 2 == 0, "row tile md:flex").otherwise("divide-x item-box col-4")
    card = _text('<li class="', kind, '"><a href="/p/', _key(), '"><img src="/i.jpg"></a><h3>', F.col("p_name"), "</h3><b>$", F.format_string("%.2f", "p_retailprice"), "</b></li>")
    pages = cards.groupBy("page_id").agg(F.array_join(F.collect_list(card), "").alias("cards"))
    page = _text('<ul id="list-', F.char(97 + page_id % 26), '">', F.col("cards"), "</ul>")
    return pages.select("page_id", udfs.detect_grid(page).alias("g")).select("page_id", "g.container", "g.strategy")


@query("SELECT p_partkey AS page_id, CASE WHEN p_partkey % 6 < 4 THEN '/l?page=' || p_partkey END AS next_url FROM part")
def next_page_built(d: Domain) -> DataFrame:
    """HTM-26."""
    link = lambda attrs, said: _text("<a ", attrs, ' href="/l?page=', _key(), '">', said, "</a>")
    kinds = [link('rel="next"', "x"), link('aria-label="Página siguiente"', "x"), link("", " » "), link('class="pager-next"', "x"), link("", "ver producto siguiente"), link("", "atrás")]
    page = _text('<a href="/home">Inicio</a>', _pick(6, *kinds))
    return _parts(d).select(_key().alias("page_id"), udfs.next_page(page).alias("next_url"))


@query("""SELECT p_partkey AS page_id, CASE WHEN p_partkey % 2 = 0 THEN '//*[@id=''cost-' || p_partkey % 9 || ''']' ELSE '/main[1]/span[' || (1 + p_partkey % 3) || ']' END AS price, CASE WHEN p_partkey % 2 = 0 THEN '//*[@id=''name-' || p_partkey % 9 || ''']' ELSE '/main[1]/h1[1]' END AS name,
  '/main[1]/img[1]' AS image, CASE WHEN p_partkey % 3 = 0 THEN '/main[1]/i[1]' END AS stock FROM part""")
def failure_diagnosis_built(d: Domain) -> DataFrame:
    """HTM-11, HTM-15."""
    k = _key()
    own = lambda kind: F.when(k % 2 == 0, _text(' id="', kind, "-", k % 9, '"')).otherwise("")
    page = _text("<main><h1", own("name"), ">", F.col("p_name"), "</h1>", F.repeat(F.lit("<span>x</span>"), (k % 3).cast("int")), "<span", own("cost"), ' class="price">$', F.col("cost"), '</span><img src="a.jpg">', F.when(k % 3 == 0, '<i class="stock">en stock</i>').otherwise(""), "</main>")
    return _parts(d).select(k.alias("page_id"), udfs.diagnose(page).alias("s")).select("page_id", "s.*")


@query("SELECT p_partkey AS page_id, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE round(p_retailprice, 2) END::DECIMAL(18,2) AS price, p_partkey % 3 <> 0 AS in_stock, CAST(100000 + p_partkey AS VARCHAR) AS sku FROM part")
def extract_product_client_built(d: Domain) -> DataFrame:
    """HTM-28: a third of the products is sold out and shows no price."""
    k = _key()
    page = _text("<h1>", F.col("p_name"), "</h1>", F.when(k % 3 == 0, "<p>Agotado</p>").otherwise(_text('<span class="price">$', F.col("cost"), "</span>")), '<main><img src="a.jpg"></main>')
    got = _parts(d).select(k.alias("page_id"), udfs.extract_product_client(page, _text("https://s.example.com/p/", 100000 + k)).alias("p"))
    return got.select("page_id", "p.name", F.when(F.col("p.price") > 0, F.col("p.price")).alias("price"), "p.in_stock", "p.sku")


@query("""SELECT 'https://s.example.com/l?page=' || s AS start, 'https://s.example.com/l?page=' || (s + n - 1) AS url, CAST(n AS INTEGER) AS page_no FROM (SELECT p_partkey AS s FROM part WHERE p_partkey % 5 = 0), (SELECT unnest(range(1, 11)) AS n) WHERE s + n - 1 <= (SELECT max(p_partkey) FROM part)""")
def follow_pages_built(d: Domain) -> DataFrame:
    """HTM-26, SET-4: every fifth page is a start, every page but the last names the one after it."""
    k, last = _key(), d.table("part").agg(F.max("p_partkey").alias("last"))
    url = lambda k: _text("https://s.example.com/l?page=", k)
    page = F.when(k < F.col("last"), _text('<a rel="next" href="/l?page=', k + 1, '">x</a>')).otherwise("<p>fin</p>")
    pages = _parts(d).crossJoin(F.broadcast(last)).select(url(k).alias("url"), page.alias("html"))  # one row
    return udfs.follow_pages(_parts(d).where(k % 5 == 0).select(url(k).alias("url")), pages)


@query("SELECT p_partkey AS page_id, p_name || ', con ' || p_size || ' piezas, y otras cosas, que se venden en la tienda.' AS text FROM part")
def readability_text_built(d: Domain) -> DataFrame:
    """HTM-16 to HTM-18."""
    page = _text("<html><head><title>t</title><script>x</script></head><body><nav><a href='#'>Inicio</a></nav><div class='sidebar'><a href='#'>uno</a> <a href='#'>dos</a></div><article class='content'><p>", F.col("p_name"), ", con ", F.col("p_size"), " piezas, y otras cosas, que se venden en la tienda.</p></article><footer>pie</footer></body></html>")
    return _parts(d).select(_key().alias("page_id"), F.trim(udfs.main_text(page)).alias("text"))


_WAYS = ("Selector configurado", product.BY_JSON, product.BY_DOM)


@query(f"""SELECT p_partkey AS capture_id, k < 3 AS ok, CASE WHEN k < 3 THEN round(p_retailprice, 2) END::DECIMAL(18,2) AS price, CASE k WHEN 0 THEN '{_WAYS[0]}' WHEN 1 THEN '{_WAYS[1]}' WHEN 2 THEN '{_WAYS[2]}' END AS method, CASE WHEN k = 3 THEN 'Cloudflare' END AS recommended,
  CASE k WHEN 1 THEN '{udfs.BY_HEURISTIC}{_WAYS[1]})' WHEN 2 THEN '{udfs.BY_HEURISTIC}{_WAYS[2]})' WHEN 3 THEN 'no ' || p_partkey WHEN 4 THEN 'no ' || p_partkey END AS message FROM (SELECT *, p_partkey % 5 AS k FROM part)""")
def evaluate_capture_built(d: Domain) -> DataFrame:
    """HTM-14: of five sites one each has a selector that holds, one that fails, none, one on pages that block, and a malformed one."""
    k, cost = _key(), F.col("cost")
    pages = [_text("<b id='c'>$ ", cost, "</b>"), _text('<script type="application/ld+json">{"@type":"Product","name":"n","offers":{"price":"', cost, '"}}</script>'), _text('<main class="product"><h1>x</h1><span class="price">$', cost, "</span></main>"), _text("<p>cf-challenge ", k, "</p>"), _text("<b id='c'>$ ", cost, "</b>")]
    captures = _parts(d).select(k.alias("capture_id"), k.alias("variant_id"), _pick(5, *pages).alias("html"), F.when(k % 5 > 2, _text("no ", k)).alias("error"))
    selector = F.element_at(F.array(*map(F.lit, ("//b[@id='c']", "//b[@id='z']", "", "//b", "//b["))), (F.col("site_id") + 1).cast("int"))
    sites = d.sites.select("site_id", "url_base", F.lit("Standard").alias("strategy"), selector.alias("price_selector"), F.lit(None).cast("string").alias("stock_selector"), F.lit(None).cast("string").alias("image_selector"))
    got = udfs.evaluate_capture(captures, d.table("part").select(k.alias("variant_id"), (k % 5).alias("site_id")), sites)
    return got.select("capture_id", "ok", "price", "method", "recommended", "message")
