"""Registered queries over HTML pages. What needs a tree has no SQL; tests compare it with fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelark.functions import pages as rules
from pricelark.html import udfs
from pricelark.plans.catalog import query
from pricelark.plans.domain import Domain
from pricelark.scratch import shuffle_partitions


def _pages(d: Domain) -> DataFrame:
    return d.table("pages")


@query()
def readability_text(d: Domain) -> DataFrame:
    return _pages(d).select("page_id", udfs.main_text("html").alias("text"))


@query()
def extract_product(d: Domain) -> DataFrame:
    return udfs.extract_once(_pages(d).select("page_id", "html")).select("page_id", "product.*")


@query()
def detect_grid(d: Domain) -> DataFrame:
    return _pages(d).select("page_id", udfs.detect_grid("html").alias("g")).select("page_id", "g.*")


@query("""SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS INTEGER) AS card, name, price, 'https://shop.example.com/p/' || (100000 + k) AS url, 'https://shop.example.com/i/' || k || '.jpg' AS image_url, CAST(100000 + k AS VARCHAR) AS sku, NULL::VARCHAR AS next_url
FROM (SELECT p_partkey AS k, p_partkey // 6 AS page_id, p_name AS name, round(p_retailprice, 2)::DECIMAL(18,2) AS price, count(*) OVER (PARTITION BY p_partkey // 6) AS n FROM part) WHERE n >= 3""")
def category_products(d: Domain) -> DataFrame:
    """Each page shows a card for each of some parts, so that cards can be read."""
    k = F.col("p_partkey")
    cards = d.table("part").select(F.floor(k / 6).alias("page_id"), F.concat(F.lit('<div class="product-card"><a href="/p/'), (100000 + k).cast("string"), F.lit('"><img src="/i/'), k.cast("string"), F.lit('.jpg"></a><h3>'), F.col("p_name"), F.lit('</h3><span class="price">$'), F.format_string("%.2f", "p_retailprice"), F.lit("</span></div>")).alias("card"), k.alias("k"))
    page = F.concat(F.lit('<main id="catalog-grid">'), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "card"))), lambda x: x["card"]), ""), F.lit("</main>"))
    dealt = cards.repartition(shuffle_partitions(d.spark), "page_id")  # grouped by the same key, and not drawn together: pages are small but dear
    return udfs.category_products(dealt.groupBy("page_id").agg(page.alias("html")).withColumn("url", F.lit("https://shop.example.com/list")))


@query()
def next_page(d: Domain) -> DataFrame:
    return _pages(d).select("page_id", udfs.next_page("html").alias("next_url"))


@query("SELECT page_id, page_id % 4 IN (0, 1) AS is_xpath, page_id % 4 IN (0, 2) AS valid FROM pages")
def selector_validation(d: Domain) -> DataFrame:
    k = F.col("page_id")
    selector = F.when(k % 4 == 0, F.concat(F.lit("//div[@id='"), k.cast("string"), F.lit("']"))).when(k % 4 == 1, F.lit("//div[@id=")).when(k % 4 == 2, F.lit("div > span")).otherwise("div @ x")
    return _pages(d).select("page_id", udfs.check_selector(selector).alias("s")).select("page_id", "s.*")


@query()
def failure_diagnosis(d: Domain) -> DataFrame:
    return _pages(d).select("page_id", udfs.diagnose("html").alias("s")).select("page_id", "s.*")


@query()
def extract_product_client(d: Domain) -> DataFrame:
    return _pages(d).select("page_id", udfs.extract_product_client("html", "url").alias("p")).select("page_id", "p.*")


@query()
def follow_pages(d: Domain) -> DataFrame:
    return udfs.follow_pages(_pages(d).select("url"), _pages(d).select("url", "html"))


@query("""SELECT page_id, regexp_matches(lower(html), 'px-captcha|challenge-platform|cf-challenge|mantén presionado|manten presionado|verifica tu identidad|human challenge|securitas|perimeterx') AS blocked,
  regexp_matches(lower(html), '"pdp_type":"no_stock"|"has_stock":false|este producto no está disponible|publicación pausada|producto no disponible|sin stock|agotado|out of stock|sold out') AS no_stock FROM pages""")
def page_signatures(d: Domain) -> DataFrame:
    return _pages(d).select("page_id", rules.is_captcha_or_block(F.col("html")).alias("blocked"), rules.says_no_stock(F.col("html")).alias("no_stock"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN '<script async src="#blocked-tracker"></script>' WHEN 1 THEN '<script src="https://cdn.example.com/' || page_id || '.js"></script>' WHEN 2 THEN '<script>blocked_gtm(' || page_id || '); console.log(''fbq blocked''); //, ' || page_id || ')</script>'
  ELSE '<script>if (' || page_id || ') window.self.location = "' || page_id || '"; stop.location</script>' END || html AS html FROM pages""")
def neutralize_trackers(d: Domain) -> DataFrame:
    k, no = F.col("page_id"), F.col("page_id").cast("string")
    host = F.element_at(F.array(*map(F.lit, ("www.GoogleTagManager.com/gtag?id=", "connect.facebook.net/", "a.b.hotjar.com/x/"))), (F.floor(k / 4) % 3 + 1).cast("int"))
    tracker = F.when(k % 4 == 0, F.concat(F.lit('<script async src="https://'), host, no, F.lit('"></script>'))).when(k % 4 == 1, F.concat(F.lit('<script src="https://cdn.example.com/'), no, F.lit('.js"></script>')))
    tracker = tracker.when(k % 4 == 2, F.concat(F.lit("<script>google_tag_manager("), no, F.lit("); fbq( 'init', "), no, F.lit(")</script>"))).otherwise(F.concat(F.lit("<script>if ("), no, F.lit(') window.top.location = "'), no, F.lit('"; stop.location</script>')))
    return _pages(d).select("page_id", rules.neutralize_trackers(F.concat(tracker, F.col("html"))).alias("html"))
