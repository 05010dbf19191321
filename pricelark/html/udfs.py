"""The HTML functions on columns and frames. Batches are bounded by Spark's arrow.maxBytesPerBatch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from pricelark.functions.text import detect_strategy, strategy_weight
from pricelark.functions.urls import make_absolute_url
from pricelark.html import batches, category, product
from pricelark.scratch import materialise
from pricelark.session import workers_find_package

# Fixed value: how the message of a rescued capture begins.
BY_HEURISTIC = "Extraido via heuristica ("
#: What each card gives.
PRODUCTS = "card int, name string, price decimal(18,2), url string, image_url string, sku string, next_url string"


def _udf(f: Callable, schema: str) -> Callable[..., Column]:
    def call(*columns: Column | str) -> Column:
        return pandas_udf(f, schema)(*columns)

    return call


extract_product = _udf(batches.extract, product.SCHEMA)
main_text = _udf(batches.main_text, "string")
main_html = _udf(batches.main_html, "string")
detect_grid = _udf(batches.grid, category.SELECTORS_SCHEMA)
next_page = _udf(batches.next_page, "string")
check_selector = _udf(batches.selector, "is_xpath boolean, valid boolean")
learned_selector_holds = _udf(batches.learned, "boolean")
diagnose = _udf(batches.diagnosis, "price string, name string, image string, stock string")
phases = _udf(batches.phases, "valid boolean, configured boolean, price decimal(18,2), in_stock boolean, method string, source string, confidence int, image_url string, learned string")
by_selectors = _udf(batches.configured, product.SCHEMA)
extract_product_client = _udf(batches.client, product.SCHEMA)


def extract_once(pages: DataFrame) -> DataFrame:
    """pages(page_id, html, ...) with a struct `product`. Equal pages of a worker's last 256 are extracted once; nothing is shuffled."""
    return pages.withColumn("product", extract_product("html"))


def category_products(pages: DataFrame) -> DataFrame:
    """HTM-25: page_id and the products of pages(page_id, url, html), a row each."""
    workers_find_package(pages.sparkSession)
    key = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(batches.category_rows, f"page_id {key}, {PRODUCTS}")


def follow_pages(starts: DataFrame, pages: DataFrame, most: int = 10) -> DataFrame:
    """HTM-26, SET-4: the pages that follow each other from starts(url), over stored pages(url, html).

    Returns start, url, page_no. A URL is visited once per start, whatever its
    case; `most` pages are read, which is the feature's limit. The links are
    found once per page and written; each step is a join on the URL. Of several
    pages of one URL the one with the least hash of its content counts.
    """
    found = pages.select(F.lower("url").alias("at"), "url", F.xxhash64("html").alias("h"), next_page("html").alias("n"))
    found = found.select("at", "h", "url", make_absolute_url(F.col("n"), F.col("url")).alias("next_url"))
    links = materialise(found.groupBy("at").agg(F.min_by("next_url", F.struct("h", "url")).alias("next_url")), "page-links")
    step = starts.select(F.col("url").alias("start"), "url", F.lit(1).alias("page_no"), F.array(F.lower("url")).alias("seen"))
    out = step
    for _ in range(most - 1):
        step = step.join(links, F.lower("url") == F.col("at")).where((F.coalesce("next_url", F.lit("")) != "") & ~F.array_contains("seen", F.lower("next_url")))
        step = step.select("start", F.col("next_url").alias("url"), F.col("page_no") + 1, F.concat("seen", F.array(F.lower("next_url")))).toDF("start", "url", "page_no", "seen")
        out = out.unionByName(step)
    return out.drop("seen")


def evaluate_capture(captures: DataFrame, variants: DataFrame, sites: DataFrame) -> DataFrame:
    """HTM-14: what a stored capture gives, without the network.

    captures(capture_id, variant_id, html, error), variants(variant_id,
    site_id), sites(site_id, url_base, strategy, price_selector,
    stock_selector, image_selector; null or blank: none). A site whose
    selectors are malformed gives nothing at all. Otherwise its selectors
    count, then the extraction with a positive price; its selector is handed
    on if it finds that price and nothing else. `recommended` is the strategy
    that a failed selector phase calls for, if it is stronger than the site's.
    Each page is parsed in one pass over its row.
    """
    c = captures.select("capture_id", "variant_id", "html", "error").join(variants.select("variant_id", "site_id"), "variant_id", "left")
    c = c.join(sites.select("site_id", "url_base", "strategy", "price_selector", "stock_selector", "image_selector"), "site_id", "left")
    c = c.withColumn("r", phases("html", "price_selector", "stock_selector", "image_selector"))
    title = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    asked = detect_strategy(F.col("html"), F.col("error"), F.trim(title))
    by_site, rescued = F.col("r.valid") & F.col("r.configured"), F.col("r.valid") & ~F.col("r.configured") & (F.col("r.price") > 0)
    ok = by_site | rescued
    return c.select(
        "capture_id",
        "variant_id",
        F.coalesce(ok, F.lit(False)).alias("ok"),
        F.when(ok, F.col("r.price")).alias("price"),
        F.when(ok, F.col("r.in_stock")).alias("in_stock"),
        F.when(ok, F.col("r.method")).alias("method"),
        F.when(ok, F.col("r.source")).alias("source"),
        F.when(ok, F.col("r.confidence")).alias("confidence"),
        F.when(ok & F.col("r.image_url").isNotNull(), make_absolute_url(F.col("r.image_url"), F.col("url_base"))).alias("image_url"),
        F.when(rescued, F.col("r.learned")).alias("learned_selector"),
        F.when(F.col("r.valid") & ~by_site & (strategy_weight(asked) > strategy_weight(F.col("strategy"))), asked).alias("recommended"),
        F.when(rescued, F.concat(F.lit(BY_HEURISTIC), F.col("r.method"), F.lit(")"))).when(~F.coalesce(ok, F.lit(False)), F.col("error")).alias("message"),
    )


def accept(configured: Column, extracted: Column) -> Column:
    """HTM-14, HTM-29: the site's selectors, else the extraction; a SKU, a name, and a price or no stock are asked for."""
    best = F.when(configured["price"].isNotNull(), configured).otherwise(extracted)
    return F.when(((F.coalesce(best["price"], F.lit(0)) > 0) | ~best["in_stock"]) & (F.coalesce(extracted["sku"], F.lit("")) != "") & (F.coalesce(extracted["name"], F.lit("")) != ""), best)
