"""Dashboards, discounts, catalogue, quality and failure triage.

Every function takes DataFrames with the columns of plans.domain and an
explicit as_of; nothing is collected. Averages of decimals are exact sums
divided as doubles. `Desconocido` and the like stand for missing partners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelark.functions.text import age_label, any_in, date_label
from pricelark.functions.urls import clean_product_url

DEFAULT_SOURCE = "Selector configurado"


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def mean(c: Column | str) -> Column:
    """Mean of a decimal column as a double; null if there is none."""
    return F.sum(c).cast("double") / F.count(c)


def discount_pct(prev: Column, cur: Column) -> Column:
    """PRJ-4."""
    p, c = prev.cast("double"), cur.cast("double")
    return F.when(p > 0, (p - c) / p * 100).otherwise(0.0)


def offers(variants: DataFrame) -> DataFrame:
    """FLT-3: active, both prices known, cheaper than before."""
    return variants.where("active AND price IS NOT NULL AND prev_price IS NOT NULL AND price < prev_price")


def discount_opportunities(variants: DataFrame, products: DataFrame, sites: DataFrame, history: DataFrame) -> DataFrame:
    """FLT-3, JN-4, JN-11, AGG-7, PRJ-4: offers with the mean of their history.

    Means are combined before the shuffle, so a variant costs one row per task.
    Cutting history to the offers first would shuffle its rows instead.
    """
    found = offers(variants)
    means = history.groupBy("variant_id").agg(mean("price").alias("m"))
    joined = found.join(products, "product_id", "left").join(sites.select("site_id", "site_name"), "site_id", "left").join(means, "variant_id", "left")
    middle = (F.col("prev_price").cast("double") + F.col("price").cast("double")) / 2
    return joined.select(
        "variant_id", "product_id", "site_id", F.coalesce("product_name", "variant_name").alias("name"), F.coalesce("site_name", F.lit("Tienda")).alias("site_name"), "category",
        "prev_price", "price", F.round(F.when(F.col("m") > 0, F.col("m")).otherwise(middle), 6).alias("mean_price"), F.round(discount_pct(F.col("prev_price"), F.col("price")), 6).alias("discount_pct"), "image_url", "in_stock",
    )


def discount_page(items: DataFrame, site_id: int | None, category: str | None, in_stock: bool, order: str, page: int, size: int = 8) -> DataFrame:
    """FLT-12, TOP-6, TOP-7: filters, one of four orders, and a page that is held inside [1, pages]."""
    rows = items
    if site_id is not None:
        rows = rows.where(F.col("site_id") == site_id)
    if category:
        rows = rows.where(F.lower("category") == category.lower())
    if in_stock:
        rows = rows.where("in_stock")
    by = {"pct": F.desc("discount_pct"), "saving": (F.col("prev_price") - F.col("price")).desc(), "price_asc": F.asc("price"), "price_desc": F.desc("price")}[order]
    n = rows.count()
    pages = max(1, -(-n // size))
    at = min(max(1, page), pages)
    return rows.orderBy(by, "variant_id").offset((at - 1) * size).limit(size)


def top_dataset(items: DataFrame, k: int = 8) -> DataFrame:
    """TOP-10, FN-37: the k best as one line of text each. Numbers come rounded half up, without grouping."""
    num = lambda c, d: F.format_string(f"%.{d}f", F.round(F.col(c).cast("double"), d))
    rank = F.row_number().over(Window.orderBy(F.desc("discount_pct"), "variant_id"))
    top = items.orderBy(F.desc("discount_pct"), "variant_id").limit(k)
    line = F.concat_ws(" | ", "name", "site_name", F.concat(F.lit("$"), num("mean_price", 2)), F.concat(F.lit("$"), num("price", 2)), F.concat(num("discount_pct", 1), F.lit("%")))
    return top.select(rank.cast("int").alias("rank"), line.alias("line"))


# --- dashboard ---------------------------------------------------------------


def stale(as_of: str) -> Column:
    """FLT-4."""
    return F.col("active") & (F.col("updated_at").isNull() | (F.col("updated_at") < F.date_trunc("DAY", ts(as_of).cast("timestamp")).cast("timestamp_ntz")))


def dashboard_kpis(sites: DataFrame, products: DataFrame, variants: DataFrame, history: DataFrame | int, as_of: str) -> DataFrame:
    """AGG-1, SRC-9: one row of counts. history: the rows, or their number (sources.ingest.row_count of a saved table)."""
    a = sites.agg(F.count_if("active").alias("active_sites"))
    b = products.agg(F.count("*").alias("products"))
    c = variants.agg(F.count("*").alias("variants"), F.count_if(stale(as_of)).alias("stale_variants"))
    counts = a.crossJoin(b).crossJoin(c)  # single rows
    if isinstance(history, int):
        return counts.withColumn("history_rows", F.lit(history).cast("long"))
    return counts.crossJoin(history.agg(F.count("*").alias("history_rows")))


def recent_price_changes(variants: DataFrame, sites: DataFrame, k: int = 5) -> DataFrame:
    """FLT-2, TOP-1, PRJ-3."""
    delta = F.coalesce("price", F.lit(0)) - F.coalesce("prev_price", F.lit(0))
    top = variants.where("price IS NOT NULL AND prev_price IS NOT NULL AND price <> prev_price").orderBy(F.desc("updated_at"), "variant_id").limit(k)
    return top.join(sites.select("site_id", "site_name"), "site_id", "left").select("variant_id", "variant_name", F.coalesce("site_name", F.lit("Desconocido")).alias("site_name"), "price", "prev_price", delta.cast("decimal(18,2)").alias("delta"), F.when(delta > 0, "up").when(delta < 0, "down").otherwise("same").alias("direction"), "updated_at")


def site_distribution(variants: DataFrame, sites: DataFrame) -> DataFrame:
    """AGG-3: variants by site name and their share."""
    counted = variants.groupBy("site_id").agg(F.count("*").alias("n")).join(sites, "site_id", "left")
    by_name = counted.groupBy(F.coalesce("site_name", F.lit("Desconocido")).alias("site_name")).agg(F.sum("n").alias("variants"))
    whole = by_name.agg(F.sum("variants").alias("total"))
    return by_name.crossJoin(whole).select("site_name", "variants", F.round(F.when(F.col("total") > 0, F.col("variants") * 100.0 / F.col("total")).otherwise(0.0), 6).alias("share_pct"))


def recent_failures(failures: DataFrame, variants: DataFrame, sites: DataFrame, as_of: str, k: int = 5) -> DataFrame:
    """TOP-3, JN-5, PRJ-2, PRJ-5."""
    top = failures.orderBy(F.desc("failed_at"), F.desc("failure_id")).limit(k)
    joined = top.join(variants.select("variant_id", "variant_name", "site_id"), "variant_id", "left").join(sites.select("site_id", "site_name"), "site_id", "left")
    return joined.select("failure_id", "variant_id", F.coalesce("variant_name", F.lit("Variante Eliminada")).alias("variant_name"), F.coalesce("site_name", F.lit("N/A")).alias("site_name"), "error", age_label(F.col("failed_at"), ts(as_of)).alias("age"))


def recent_attempts(metrics: DataFrame, failures: DataFrame, k: int = 5) -> DataFrame:
    """TOP-2, JN-12: the last attempts of variants, and whether one failed since its last good one."""
    last = metrics.groupBy("variant_id").agg(F.max("recorded_at").alias("last_attempt_at"), F.max(F.when(F.col("ok"), F.col("recorded_at"))).alias("updated_at"))
    top = last.orderBy(F.desc("last_attempt_at"), "variant_id").limit(k)
    f = failures.select(F.col("variant_id").alias("v"), "failed_at")
    hit = top.join(f, (top["variant_id"] == f["v"]) & (top["updated_at"].isNull() | (f["failed_at"] >= top["updated_at"])), "left_semi").select(F.col("variant_id").alias("v"))
    return top.join(hit, top["variant_id"] == hit["v"], "left").select("variant_id", "last_attempt_at", F.col("v").isNotNull().alias("has_failure"))


def attempt_stamps(attempts: DataFrame) -> DataFrame:
    """STF-2's stamp: a variant's first attempt of the last day that it was tried on. Partial minima, then a row per day."""
    days = attempts.groupBy("variant_id", F.to_date("attempted_at").alias("day")).agg(F.min("attempted_at").alias("first"))
    return days.groupBy("variant_id").agg(F.max("first").alias("last_attempt_at"))


def recent_attempts_by_stamp(attempts: DataFrame, variants: DataFrame, sites: DataFrame, failures: DataFrame, k: int = 5) -> DataFrame:
    """TOP-2, JN-12: variants by the stamp of their last attempts, which only a day's first one sets; has_failure: since the last good capture."""
    top = variants.join(attempt_stamps(attempts), "variant_id").orderBy(F.desc("last_attempt_at"), "variant_id").limit(k)
    f = failures.select(F.col("variant_id").alias("v"), "failed_at")
    hit = f.join(F.broadcast(top.select("variant_id", "updated_at")), (F.col("v") == F.col("variant_id")) & (F.col("updated_at").isNull() | (F.col("failed_at") >= F.col("updated_at"))), "left_semi").select("v").distinct()  # top has k rows
    named = top.join(sites.select("site_id", "site_name"), "site_id", "left").join(hit, F.col("variant_id") == F.col("v"), "left")
    return named.select("variant_id", "variant_name", F.coalesce("site_name", F.lit("N/A")).alias("site_name"), "last_attempt_at", F.col("v").isNotNull().alias("has_failure"))


def limit_exceeded(variants: DataFrame, limit: int = 10) -> DataFrame:
    """FLT-7."""
    return variants.where(F.col("active") & (F.col("attempts_today") >= limit)).select("variant_id", "variant_name", "attempts_today")


def site_stats(sites: DataFrame) -> DataFrame:
    """AGG-15."""
    return sites.agg(F.count("*").alias("sites"), F.count_if("active").alias("active"), F.count_if(F.col("strategy") != "Standard").alias("evasive"), F.coalesce(F.avg(F.expr("interval_minutes div 60")).cast("int"), F.lit(0)).alias("mean_hours"))


def site_tab(sites: DataFrame, tab: str) -> DataFrame:
    """FLT-1, FLT-11: all, active, evasive or inactive sites."""
    return sites.where({"all": F.lit(True), "active": F.col("active"), "evasive": F.col("strategy") != "Standard", "inactive": ~F.col("active")}[tab])


def proxy_summary(proxies: DataFrame) -> DataFrame:
    """FLT-13, AGG-2."""
    return proxies.where("active AND NOT banned").agg(F.count("*").alias("usable"), F.coalesce(F.avg("latency_ms").cast("int"), F.lit(0)).alias("mean_latency"))


def choose_proxy(proxies: DataFrame, policy: str) -> DataFrame:
    """TOP-11: the fastest, or the one not used for longest (never used first)."""
    usable = proxies.where("active AND NOT banned")
    by = [F.asc("latency_ms"), F.asc("proxy_id")] if policy == "latency" else [F.asc_nulls_first("last_used"), F.asc("proxy_id")]
    return usable.orderBy(*by).limit(1)


# --- extraction quality ------------------------------------------------------


def _recent(metrics: DataFrame, sites: DataFrame, as_of: str, days: int) -> DataFrame:
    rows = metrics.where(F.col("recorded_at") >= ts(as_of) - F.expr(f"INTERVAL {days} DAYS"))
    return rows.join(sites.select("site_id", "site_name"), "site_id")


def _success() -> Column:
    return F.round(F.count_if(F.col("ok")) * 100.0 / F.count("*"), 6)


def _zero(c: Column) -> Column:
    return F.round(F.coalesce(c, F.lit(0.0)), 6)


def quality_global(metrics: DataFrame, sites: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """AGG-4, JN-1."""
    return _recent(metrics, sites, as_of, days).agg(F.count("*").alias("total"), F.coalesce(_success(), F.lit(0.0)).alias("success_pct"), _zero(F.avg("latency_ms")).alias("mean_latency"))


def quality_by_site(metrics: DataFrame, sites: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """AGG-5. Sites of one name count as one."""
    latest = F.max_by(F.coalesce("source", F.lit(DEFAULT_SOURCE)), F.struct("recorded_at", "metric_id"))
    return _recent(metrics, sites, as_of, days).groupBy("site_name").agg(F.count("*").alias("total"), _success().alias("success_pct"), _zero(F.avg(F.when(F.col("ok"), F.col("confidence")))).alias("mean_confidence"), _zero(F.avg("latency_ms")).alias("mean_latency"), latest.alias("last_source"))


def quality_by_method(metrics: DataFrame, sites: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """AGG-6."""
    rows = _recent(metrics, sites, as_of, days)
    return rows.groupBy(F.coalesce("method", F.lit(DEFAULT_SOURCE)).alias("method"), F.coalesce("source", F.lit(DEFAULT_SOURCE)).alias("source")).agg(F.count("*").alias("total"), _success().alias("success_pct"), _zero(F.avg(F.when(F.col("ok"), F.col("confidence")))).alias("mean_confidence"), _zero(F.avg("latency_ms")).alias("mean_latency"))


def attempt_sessions(metrics: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of a site's attempts without a pause longer than `gap`. Spark merges sessions in each task before it shuffles them."""
    timed = metrics.withColumn("at_", F.col("recorded_at").cast("timestamp"))
    found = timed.groupBy("site_id", F.session_window("at_", gap).alias("w")).agg(F.count("*").alias("attempts"), F.count_if(~F.col("ok")).alias("failed"), F.min("recorded_at").alias("first_at"), F.max("recorded_at").alias("last_at"))
    return found.select("site_id", "first_at", "last_at", "attempts", "failed")


# --- failures ----------------------------------------------------------------

# Substrings of the overlapping failure classes.
SELECTOR_ERRORS = ["Selector", "XPath", "no encontrado"]
TIMEOUT_ERRORS = ["Timeout", "net::", "connection"]
ANTIBOT_ERRORS = ["Cloudflare", "Captcha", "403", "Blocked"]


def failure_categories(failures: DataFrame) -> DataFrame:
    """AGG-12, AGG-18: classes overlap; the rest is never below zero."""
    n = {name: F.count_if(any_in(F.col("error"), words)) for name, words in (("selector", SELECTOR_ERRORS), ("timeout", TIMEOUT_ERRORS), ("antibot", ANTIBOT_ERRORS))}
    return failures.agg(F.count("*").alias("total"), *(c.alias(k) for k, c in n.items())).withColumn("other", F.greatest(F.lit(0), F.col("total") - F.col("selector") - F.col("timeout") - F.col("antibot")))


def latest_failures(failures: DataFrame, variants: DataFrame, sites: DataFrame) -> DataFrame:
    """WIN-1, JN-5, PRJ-1, PRJ-2: the last failure of each variant."""
    first = Window.partitionBy("variant_id").orderBy(F.desc("failed_at"), F.desc("failure_id"))
    last = failures.withColumn("rn", F.row_number().over(first)).where("rn = 1")
    joined = last.join(variants.select("variant_id", "variant_name", "site_id", "price"), "variant_id", "left").join(sites.select("site_id", "site_name"), "site_id", "left")
    return joined.select("failure_id", "variant_id", F.coalesce("variant_name", F.lit("Variante Eliminada")).alias("variant_name"), F.coalesce("site_name", F.lit("N/A")).alias("site_name"), F.coalesce("strategy", F.lit("N/A")).alias("strategy"), F.coalesce("price", F.lit(0)).cast("decimal(18,2)").alias("price"), "error", "failed_at")


def latest_failure_ids(failures: DataFrame) -> DataFrame:
    """AGG-11."""
    return failures.groupBy("variant_id").agg(F.max("failure_id").alias("failure_id"))


# --- catalogue ---------------------------------------------------------------


def product_price_stats(variants: DataFrame) -> DataFrame:
    """AGG-8: over variants with a price; the cheapest (the first of equals) is the best."""
    priced = variants.where("price IS NOT NULL").groupBy("product_id").agg(F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.round(mean("price"), 6).alias("mean_price"), F.min_by("variant_id", F.struct("price", "variant_id")).alias("best_variant"))
    lo, hi = F.col("min_price").cast("double"), F.col("max_price").cast("double")
    return priced.withColumns({"max_saving": (F.col("max_price") - F.col("min_price")).cast("decimal(18,2)"), "saving_pct": F.round(F.when(hi > 0, (hi - lo) / hi * 100).otherwise(0.0), 6)})


def product_cards(products: DataFrame, variants: DataFrame) -> DataFrame:
    """AGG-9, JN-6."""
    has = F.col("image_url").isNotNull() & (F.col("image_url") != "")
    pct = F.when(F.col("price") < F.col("prev_price"), discount_pct(F.col("prev_price"), F.col("price")))
    by = variants.groupBy("product_id").agg(F.min_by(F.when(has, F.col("image_url")), F.when(has, F.col("variant_id"))).alias("image_url"), F.min("price").alias("lowest"), F.max(pct).alias("best_pct"))
    return products.join(by, "product_id", "left").select("product_id", "product_name", "image_url", F.coalesce("lowest", F.lit(0)).cast("decimal(18,2)").alias("min_price"), F.round(F.coalesce("best_pct", F.lit(0.0)), 6).alias("max_discount_pct"))


def catalog_search(products: DataFrame, variants: DataFrame, text: str | None = None, site_id: int | None = None, only_offers: bool = False, only_stock: bool = False, only_stale: str | None = None) -> DataFrame:
    """FLT-8, FLT-9, JN-7: text in a product or in any variant's URL or SKU, and existence filters; case doesn't matter.

    One aggregate over variants answers all existence questions at once.
    """
    q = (text or "").lower()
    asked = {"hit": F.bool_or(F.contains(F.lower("url"), F.lit(q)) | F.contains(F.lower("sku"), F.lit(q)))}
    if site_id is not None:
        asked["at_site"] = F.bool_or(F.col("site_id") == site_id)
    if only_offers:
        asked["offer"] = F.bool_or(F.col("price") < F.col("prev_price"))
    if only_stock:
        asked["stock"] = F.bool_or("in_stock")
    if only_stale:
        asked["stale"] = F.bool_or(stale(only_stale))
    flags = variants.groupBy(F.col("product_id").alias("p")).agg(*(c.alias(k) for k, c in asked.items()))
    rows = products.join(flags, F.col("product_id") == F.col("p"), "left")
    own = F.contains(F.lower("product_name"), F.lit(q)) | F.contains(F.lower("brand"), F.lit(q)) | F.contains(F.lower("category"), F.lit(q))
    rows = rows.where(own | F.coalesce("hit", F.lit(False)))
    for k in asked:
        if k != "hit":
            rows = rows.where(k)
    return rows.select("product_id", "product_name", "brand", "category")


def catalog_facets(found: DataFrame, variants: DataFrame, sites: DataFrame) -> DataFrame:
    """AGG-10, SET-3: all variants of the found products by site, and the products by category."""
    ids = found.select("product_id")
    by_site = variants.join(ids, "product_id", "left_semi").groupBy("site_id").agg(F.count("*").alias("n")).join(sites.select("site_id", "site_name"), "site_id").select(F.lit("site").alias("facet"), F.col("site_name").alias("value"), "n")
    by_category = found.groupBy(F.col("category").alias("value")).agg(F.count("*").alias("n")).select(F.lit("category").alias("facet"), "value", "n")
    return by_site.unionByName(by_category)


def catalog_sort(products: DataFrame, variants: DataFrame, order: str, k: int) -> DataFrame:
    """TOP-5: by name, lowest price up or down (none: last up, 0 down) or best discount."""
    by = variants.groupBy("product_id").agg(F.min("price").alias("lowest"), F.max(discount_pct(F.col("prev_price"), F.col("price"))).alias("pct"))
    rows = products.join(by, "product_id", "left")
    key = {"name": F.asc("product_name"), "price_asc": F.asc_nulls_last("lowest"), "price_desc": F.coalesce("lowest", F.lit(0)).desc(), "discount": F.coalesce("pct", F.lit(0.0)).desc()}[order]
    return rows.orderBy(key, "product_id").limit(k).select("product_id", "product_name", "lowest", F.round("pct", 6).alias("pct"))


def categories(products: DataFrame) -> DataFrame:
    """SET-1."""
    return products.where("category <> ''").select("category").distinct()


def autocomplete(products: DataFrame, text: str, k: int = 20) -> DataFrame:
    """TOP-9."""
    q = F.lit(text)
    return products.where(F.contains("product_name", q) | F.contains("brand", q) | F.contains("category", q)).orderBy("product_name", "product_id").limit(k)


# --- history and charts ------------------------------------------------------

_ORDER = ("captured_at", "k1", "k2", "k3", "price")


def last_captures(history: DataFrame, k: int = 7) -> DataFrame:
    """WIN-4. The rank filter becomes a WindowGroupLimit before the shuffle."""
    last = Window.partitionBy("variant_id").orderBy(*(F.desc(c) for c in _ORDER))
    return history.withColumn("back", F.row_number().over(last)).where(F.col("back") <= k)


def price_chart(history: DataFrame, variants: DataFrame, as_of: str, k: int = 7) -> DataFrame:
    """WIN-5, WIN-6, WIN-7, SET-2: points of each product's chart.

    Days: the last k days with a capture of any of the product's variants. A
    variant's point on a day is the first of its last k captures on that day,
    else its point before, else its current price, else 0. A product without
    captures has one point today for each variant with a price.
    """
    day = F.to_date("captured_at")
    days = history.select("product_id", day.alias("day")).distinct()
    days = days.withColumn("r", F.row_number().over(Window.partitionBy("product_id").orderBy(F.desc("day")))).where(F.col("r") <= k).select("product_id", "day")
    early = last_captures(history, k).withColumn("day", day).groupBy("variant_id", "day").agg(F.min_by("price", F.struct(*_ORDER)).alias("point"))
    grid = variants.select("variant_id", "product_id", F.col("price").alias("current")).join(days, "product_id")
    filled = grid.join(early, ["variant_id", "day"], "left")
    onward = Window.partitionBy("variant_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    points = filled.select("product_id", "variant_id", "day", F.coalesce(F.last("point", ignorenulls=True).over(onward), F.col("current"), F.lit(0)).cast("decimal(18,2)").alias("price"))
    bare = variants.where("price IS NOT NULL").join(days.select("product_id").distinct(), "product_id", "left_anti").select("product_id", "variant_id", F.to_date(ts(as_of)).alias("day"), "price")
    return points.unionByName(bare).select("product_id", "variant_id", date_label(F.col("day")).alias("label"), "price")


def change_points(history: DataFrame, block: str = "year") -> DataFrame:
    """WIN-8, WIN-9: captures that are first or differ from the one before, with its price.

    A variant's captures are cut into blocks of time. The last capture of a
    block is handed to the variant's next one as a row of its own, so a task
    gets a block of a variant and never the variant, however busy it is; what
    is gathered per variant is one entry per block of the calendar.
    """
    rows = history.withColumn("block_", F.date_trunc(block, "captured_at"))
    state = F.struct(*_ORDER, "in_stock")
    ends = rows.groupBy("variant_id", "block_").agg(F.max(state).alias("end"))
    held = ends.groupBy("variant_id").agg(F.sort_array(F.collect_list(F.struct("block_", "end"))).alias("ends"))
    handed = F.transform(F.col("ends"), lambda e, i: F.struct(e["block_"].alias("block_"), F.when(i > 0, F.element_at(F.col("ends"), F.greatest(i, F.lit(1)))["end"]).alias("end")))
    carried = held.select("variant_id", F.explode(handed).alias("h")).where("h.end IS NOT NULL").select("variant_id", F.col("h.block_").alias("block_"), "h.end.*")
    both = rows.withColumn("own_", F.lit(True)).unionByName(carried.withColumn("own_", F.lit(False)), allowMissingColumns=True)
    onward = Window.partitionBy("variant_id", "block_").orderBy("own_", *_ORDER)
    rows = both.withColumns({"prev_price": F.lag("price").over(onward), "prev_stock": F.lag("in_stock").over(onward), "first_": F.lag("own_").over(onward).isNull()}).where("own_")
    differs = F.col("first_") | F.col("prev_price").isNull() | (F.col("price") != F.col("prev_price")) | (F.col("in_stock") != F.col("prev_stock"))
    return rows.where(differs).drop("prev_stock", "own_", "first_", "block_")


# --- queues ------------------------------------------------------------------


def _pending(variants: DataFrame, sites: DataFrame, as_of: str) -> DataFrame:
    now = ts(as_of)
    rows = variants.join(sites.select("site_id", "site_name", "interval_minutes"), "site_id", "left")
    last = F.col("updated_at")
    due = (last < F.date_trunc("DAY", now.cast("timestamp")).cast("timestamp_ntz")) & F.col("site_name").isNotNull() & (last < now - F.make_dt_interval(mins=F.col("interval_minutes")))
    return rows.where(F.col("active") & (last.isNull() | due))


def pending_total(variants: DataFrame, sites: DataFrame, as_of: str) -> DataFrame:
    """FLT-5: the count before any limit."""
    return _pending(variants, sites, as_of).agg(F.count("*").alias("total"))


def pending_queue(variants: DataFrame, sites: DataFrame, as_of: str, first: int = 150, then: int = 50) -> DataFrame:
    """FLT-5, TOP-4, WIN-3: oldest `first`, of those one per clean URL, of those `then`."""
    old = _pending(variants, sites, as_of).orderBy(F.asc_nulls_first("updated_at"), "variant_id").limit(first)
    keyed = old.where("trim(url) <> ''").withColumn("key", F.lower(clean_product_url(F.col("url"))))
    one = Window.partitionBy("key").orderBy(F.asc_nulls_first("updated_at"), "variant_id")
    rows = keyed.withColumn("rn", F.row_number().over(one)).where("rn = 1")
    return rows.orderBy(F.asc_nulls_first("updated_at"), "variant_id").limit(then).select("variant_id", "variant_name", "sku", "url", "price", "updated_at", F.coalesce("site_name", F.lit("Tienda")).alias("site_name"))


def due_variants(variants: DataFrame, sites: DataFrame, as_of: str, test_mode: bool = False) -> DataFrame:
    """FLT-6: inclusive, active sites only; differs from the pending queue on purpose."""
    now = ts(as_of)
    rows = variants.where("active").join(sites.where("active").select("site_id", "interval_minutes"), "site_id")
    if not test_mode:
        rows = rows.where(F.col("updated_at").isNull() | (F.col("updated_at") + F.make_dt_interval(mins=F.col("interval_minutes")) <= now))
    return rows.select("variant_id", "site_id", "updated_at")
