"""Merges of captures into state, and the clean-ups of the catalogue (MRG-*, JN-8 to JN-14, FLT-14).

Plain Parquet has no MERGE, so each operator is a function of frames to new
frames; operators.store commits them together.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelark.functions.text import NO_BRAND, normalize_brand, normalize_sku
from pricelark.functions.urls import clean_product_url, host_of, normalize_image_url
from pricelark.operators.contains import holders
from pricelark.operators.stateful import numbered
from pricelark.scratch import materialise, shuffle_partitions

# Widths of columns, and what an empty batch says.
WIDTHS = {"name": 300, "sku": 100, "brand": 100, "url": 1000, "image_url": 1000}
EMPTY_BATCH = "El lote de datos está vacío."

#: Texts, or beginnings of texts, that are broadcast to be looked up in others.
PART_ROWS = 100_000


@dataclass
class Merged:
    variants: DataFrame
    sites: DataFrame
    history: DataFrame
    ok: bool = True
    message: str = ""


def changed(price: Column, stock: Column, new_price: Column, new_stock: Column) -> Column:
    """Whether a capture goes to the history: no price yet, another price, or another stock."""
    return price.isNull() | (price != new_price) | (stock != new_stock)


def fit_columns(items: DataFrame) -> DataFrame:
    """PRJ-6: texts cut to the widths of their columns; a missing brand gets the default, other texts '' but for the image."""
    cut = {c: F.substring(F.col(c) if c == "image_url" else F.coalesce(F.col(c), F.lit(NO_BRAND if c == "brand" else "")), 1, n) for c, n in WIDTHS.items() if c in items.columns}
    return items.withColumns(cut)


def latest_items(batch: DataFrame) -> DataFrame:
    """One item per variant: the latest, then the dearest, then the greatest of all other columns in their order (nulls last).

    Only partial aggregates are shuffled.
    """
    rest = ["captured_at", "price", *(c for c in batch.columns if c not in ("variant_id", "captured_at", "price"))]
    best = batch.groupBy("variant_id").agg(F.max(F.struct(*rest)).alias("x"))
    return best.select(*("variant_id" if c == "variant_id" else F.col(f"x.{c}").alias(c) for c in batch.columns))


def bulk_merge(variants: DataFrame, sites: DataFrame, batch: DataFrame | None, force_history: bool = False, checked: bool = False) -> Merged:
    """MRG-1 (and MRG-3 with force_history), JN-2, JN-3, AGG-13, SNK-2, SNK-3.

    New history rows are judged against the state before the batch; every
    differing row of a variant is kept. Of several items of a variant one
    becomes its state (latest_items). Items of unknown variants are left out. A
    site's last crawl becomes the batch's latest time, even if it is older. A
    batch that is None or empty changes nothing and says so; `checked` leaves
    out the look for a first row.
    """
    if batch is None or not checked and batch.isEmpty():
        return Merged(variants, sites, variants.select("variant_id", "price", "in_stock", F.col("updated_at").alias("captured_at")).limit(0), False, EMPTY_BATCH)
    old = variants.select(F.col("variant_id").alias("v"), F.col("price").alias("old_price"), F.col("in_stock").alias("old_stock"), "site_id")
    met = batch.join(old, F.col("variant_id") == F.col("v"))
    keep = F.lit(True) if force_history else changed(F.col("old_price"), F.col("old_stock"), F.col("price"), F.col("in_stock"))
    history = met.where(keep).select("variant_id", "price", "in_stock", "captured_at")

    new = latest_items(batch).select(F.col("variant_id").alias("v"), *(F.col(c).alias(f"new_{c}") for c in ("price", "in_stock", "captured_at", "image_url")))
    hit = F.col("v").isNotNull()
    pick = lambda new, old: F.when(hit, F.col(new)).otherwise(F.col(old))
    keeps = F.col("image_url").isNotNull() & (F.col("image_url") != "")
    state = {
        "prev_price": pick("price", "prev_price"),
        "price": pick("new_price", "price"),
        "in_stock": pick("new_in_stock", "in_stock"),
        "updated_at": pick("new_captured_at", "updated_at"),
        "image_url": F.when(hit & ~F.coalesce(keeps, F.lit(False)), F.col("new_image_url")).otherwise(F.col("image_url")),
    }
    joined = variants.join(new, F.col("variant_id") == F.col("v"), "left")
    after = joined.select(*(state[c].alias(c) if c in state else F.col(c) for c in variants.columns))

    crawled = met.groupBy("site_id").agg(F.max("captured_at").alias("crawl"))
    columns = [F.coalesce("crawl", "last_crawl").alias("last_crawl") if c == "last_crawl" else F.col(c) for c in sites.columns]
    return Merged(after, sites.join(crawled, "site_id", "left").select(*columns), history)


def duplicate_map(variants: DataFrame) -> DataFrame:
    """MRG-4, AGG-16, WIN-2: loser -> winner for variants of one clean URL, across all sites.

    The winner has an update, the latest, and then the lowest id. It comes from
    one aggregate that combines before its shuffle. The join back shuffles
    variants by URL; where one URL holds a large share, AQE splits its
    partition (spark.sql.adaptive.skewJoin), as it does for remap_history.
    """
    keyed = variants.where("trim(url) <> ''").withColumn("key", F.lower(clean_product_url(F.col("url"))))
    rank = F.struct(F.col("updated_at").isNotNull(), F.col("updated_at"), (-F.col("variant_id")).alias("i"))
    best = keyed.groupBy("key").agg(F.max_by("variant_id", rank).alias("winner"), F.count("*").alias("n")).where("n > 1")
    return keyed.select("key", F.col("variant_id").alias("loser")).join(best, "key").where("loser <> winner").select("loser", "winner")


def remap_history(history: DataFrame, losers: DataFrame) -> DataFrame:
    """MRG-4: the losers' history goes to the winners."""
    joined = history.join(losers, F.col("variant_id") == F.col("loser"), "left")
    return joined.select(*(F.coalesce("winner", "variant_id").alias(c) if c == "variant_id" else F.col(c) for c in history.columns))


def without(rows: DataFrame, keys: DataFrame, key: str, column: str = "variant_id") -> DataFrame:
    """MRG-4, MRG-8, MRG-9: rows whose column isn't among the keys."""
    k = keys.select(F.col(key).alias("gone"))
    return rows.join(k, F.col(column) == F.col("gone"), "left_anti")


def deactivate(variants: DataFrame, variant_id: int) -> DataFrame:
    """MRG-5: the variant and every one with its clean URL."""
    keyed = variants.withColumn("key", F.lower(clean_product_url(F.col("url"))))
    own = keyed.where(F.col("variant_id") == variant_id).select(F.col("key").alias("own")).limit(1)
    joined = keyed.join(F.broadcast(own), (F.col("key") == F.col("own")) & (F.col("own") != ""), "left")  # one row
    off = (F.col("variant_id") == variant_id) | F.col("own").isNotNull()
    return joined.select(*(F.when(off, False).otherwise(F.col("active")).alias(c) if c == "active" else F.col(c) for c in variants.columns))


def cascade_delete(products: DataFrame, variants: DataFrame, history: DataFrame, failures: DataFrame, product_ids: DataFrame) -> dict[str, DataFrame]:
    """MRG-8: products with their variants, and these with their history and failures."""
    gone = variants.join(product_ids, "product_id", "left_semi").select("variant_id")
    return {"products": without(products, product_ids, "product_id", "product_id"), "variants": without(variants, gone, "variant_id"), "history": without(history, gone, "variant_id"), "failures": without(failures, gone, "variant_id")}


def cascade_delete_sites(sites: DataFrame, variants: DataFrame, history: DataFrame, failures: DataFrame, site_ids: DataFrame) -> dict[str, DataFrame]:
    """MRG-8: sites with their variants, and these with their history and failures. What is left of each table."""
    gone = variants.join(site_ids, "site_id", "left_semi").select("variant_id")
    return {"sites": without(sites, site_ids, "site_id", "site_id"), "variants": without(variants, site_ids, "site_id", "site_id"), "history": without(history, gone, "variant_id"), "failures": without(failures, gone, "variant_id")}


def apply_updates(rows: DataFrame, updates: DataFrame, key: str, clears: bool = False) -> DataFrame:
    """MRG-10, MRG-11: sets the columns of `updates` where it has the key; a null in it sets nothing, or null if it `clears`."""
    fields = [c for c in updates.columns if c != key]
    u = updates.select(F.col(key).alias("u_key"), *(F.col(c).alias(f"u_{c}") for c in fields))
    joined = rows.join(u, F.col(key) == F.col("u_key"), "left")
    new = lambda c: F.when(F.col("u_key").isNotNull(), F.col(f"u_{c}")).otherwise(F.col(c)) if clears else F.coalesce(f"u_{c}", c)
    return joined.select(*(new(c).alias(c) if c in fields else F.col(c) for c in rows.columns))


def reset_attempts(variants: DataFrame) -> DataFrame:
    """MRG-10."""
    return variants.withColumn("attempts_today", F.lit(0))


def resolve_sites(items: DataFrame, sites: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """FLT-14: the site of lowest id whose base URL has the item's domain; null if none has.

    `told` has the domains of all items at least, if it costs less to read.

    Distinct domains meet distinct base URLs by their rarest anchors, so no
    site is compared with every domain. Both are written first, as they are
    read several times.
    """
    d = F.lower(F.trim("domain"))
    asked = materialise((items if told is None else told).select(d.alias("part")).where("part <> ''").distinct().select(F.lit(0).alias("at"), "part"), "domains")
    bases = materialise(sites.groupBy(F.col("url_base").alias("text")).agg(F.min("site_id").alias("site_id")).select(F.lit(0).alias("at"), "text", "site_id"), "site-bases")
    found = holders(bases, asked).join(bases.drop("at"), "text").groupBy("part").agg(F.min("site_id").alias("site_id"))
    return items.join(found, d == F.col("part"), "left").drop("part")


def match_hosts(items: DataFrame, sites: DataFrame) -> DataFrame:
    """FLT-15: sites whose host is the item's, or a dotted suffix of it, or the other way round.

    Equal suffixes are met by an equi-join on every suffix of either host.
    """
    cut = lambda h: F.transform(F.sequence(F.lit(1), F.size(F.split(h, r"\."))), lambda k: F.array_join(F.slice(F.split(h, r"\."), k, 100), "."))
    a = items.withColumn("host", host_of(F.col("url"))).where("host <> ''")
    b = sites.withColumn("site_host", host_of(F.col("url_base"))).where("site_host <> ''")
    down = a.withColumn("k", F.explode(cut(F.col("host")))).join(b, F.col("k") == F.col("site_host")).drop("k")
    up = b.withColumn("k", F.explode(cut(F.col("site_host")))).join(a, (F.col("k") == F.col("host")) & (F.col("host") != F.col("site_host"))).drop("k")
    return down.unionByName(up)


def existing_products(cards: DataFrame, variants: DataFrame) -> DataFrame:
    """JN-8: whether a card's SKU (if it has one) is at its site already, whatever its case."""
    have = variants.select(F.col("site_id").alias("s"), F.lower("sku").alias("k")).where("k <> ''").distinct()
    joined = cards.join(have, (F.col("site_id") == F.col("s")) & (F.lower("sku") == F.col("k")), "left")
    return joined.withColumn("exists", F.col("k").isNotNull()).drop("s", "k")


def new_products(cards: DataFrame, variants: DataFrame) -> DataFrame:
    """JN-9, MRG-6: cards whose (site, SKU) isn't there, one per SKU; price null if 0; default for the brand.

    Nothing equals a null SKU, so each card without one is new; it is saved
    with an empty SKU, and a later card with an empty one is then there already.
    """
    have = variants.select(F.col("site_id").alias("s"), F.lower("sku").alias("k"))
    fresh = cards.join(have, (F.col("site_id") == F.col("s")) & (F.lower("sku") == F.col("k")), "left_anti")
    first = Window.partitionBy("site_id", F.lower(F.coalesce("sku", F.lit("")))).orderBy("card_id")
    # all cards without a SKU stay, so these go by themselves: a window would bring them to one task
    named = fresh.where("sku IS NOT NULL").withColumn("own", F.lit(True))
    least = fresh.where("sku IS NULL").groupBy("site_id").agg(F.min("card_id").alias("card_id"))  # a row per site
    stand = least.select(*(F.col(c) if c in ("site_id", "card_id") else F.lit("" if c == "sku" else None).cast(cards.schema[c].dataType).alias(c) for c in cards.columns), F.lit(False).alias("own"))
    one = named.unionByName(stand).withColumn("rn", F.row_number().over(first)).where("rn = 1 AND own").drop("rn", "own").unionByName(fresh.where("sku IS NULL"))
    return one.withColumns({"price": F.when(F.col("price") > 0, F.col("price")), "brand": normalize_brand(F.col("brand"))})


# What products of saved categories say.
GENERAL, FROM_CATEGORY = "General", "Creado automáticamente desde extractor de categorías (%s) el %s."


def save_category(cards: DataFrame, sites: DataFrame, products: DataFrame, variants: DataFrame, as_of: str, brand: str = "", category: str = "", product_id: int | None = None) -> dict[str, DataFrame]:
    """MRG-6 over cards (card_id, site_id, name, sku, url, price, image_url) that are saved in the order of their ids.

    A card that new_products() lets through makes a product of its own (brand:
    the given one or else the site's name; category: the given one or else
    General), or joins the given product, and a variant in stock; one with a
    price above 0 makes a history row. Ids follow the highest ones. Returns the
    whole tables products and variants, the new history rows, and one row with
    the numbers of created and linked products.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    fresh = new_products(cards.withColumn("brand", F.lit(None).cast("string")), variants).drop("brand")
    placed = materialise(numbered(fresh.join(sites.select("site_id", "site_name"), "site_id", "left"), "card_id"), "category-cards")
    follow = lambda df, c: df.agg(F.coalesce(F.max(c).cast("long"), F.lit(0)) + 1).first()[0]
    own = F.lit(product_id).cast("long") if product_id is not None else F.col("i") + follow(products, "product_id")
    placed = placed.withColumns({"p_": own, "v_": F.col("i") + follow(variants, "variant_id")})
    label = F.coalesce("site_name", F.lit(""))
    said = {"product_id": F.col("p_"), "product_name": F.col("name"), "brand": F.lit(brand) if brand.strip() else label, "category": F.lit(category if category.strip() else GENERAL), "description": F.format_string(FROM_CATEGORY, label, F.date_format(now, "dd/MM/yyyy")), "created_at": now}
    state = {"variant_id": F.col("v_"), "product_id": F.col("p_"), "site_id": F.col("site_id"), "sku": F.coalesce("sku", F.lit("")), "variant_name": F.col("name"), "url": F.col("url"), "price": F.col("price"), "in_stock": F.lit(True), "updated_at": now, "attempts_today": F.lit(0), "last_attempt_at": now, "image_url": F.col("image_url"), "active": F.lit(True)}
    like = lambda table, values: placed.select(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema.fields))
    made = products.limit(0) if product_id is not None else like(products, said)
    history = placed.where("price IS NOT NULL").select(F.col("v_").alias("variant_id"), "price", F.lit(True).alias("in_stock"), now.alias("captured_at"))
    n = F.count("*")
    counts = placed.agg((n if product_id is None else F.lit(0).cast("long")).alias("created"), (n if product_id is not None else F.lit(0).cast("long")).alias("linked"))
    return {"products": products.unionByName(made), "variants": variants.unionByName(like(variants, state)), "history": history, "counts": counts}


def _texts(rows: DataFrame, site: str, text: str) -> DataFrame:
    return rows.select(F.col(site).alias("at"), F.col(text).alias("text")).where("text <> ''").distinct()


#: The shortest text that counts as a part of another one.
PART = 4


@dataclass
class _Parts:
    rows: DataFrame  # p_at, part
    heads: DataFrame | None  # first characters of the parts, if these are too many to be broadcast


def _parts(texts: DataFrame) -> _Parts:
    """A site's texts that others may hold, broadcast if they are few; else their beginnings are, if those are few."""
    rows = texts.where(F.length("text") >= PART).toDF("p_at", "part")
    few = lambda df: df.limit(PART_ROWS + 1).count() <= PART_ROWS
    if few(rows):
        return _Parts(F.broadcast(rows), None)
    heads = rows.select(F.col("p_at").alias("h_at"), F.substring("part", 1, PART).alias("head")).distinct()
    return _Parts(rows.hint("merge"), F.broadcast(heads) if few(heads) else None)


def _held(texts: DataFrame, parts: _Parts, whole: bool = True) -> DataFrame:
    """(at, text, part): a site's texts and those of its parts, from 4 characters up, that they hold; each pair once, without whole ones if these aren't asked for.

    Only substrings of lengths that parts have are made, as rows of their places
    (the first of equal ones counts), so that generated code does all of it.
    They meet the parts in a broadcast table if these are few, so that they
    aren't shuffled; if not, substrings that begin as no part does go before the
    shuffle. A short text makes many substrings, so texts are spread over all
    tasks first.
    """
    texts = texts.repartition(shuffle_partitions(texts.sparkSession))
    lengths = parts.rows.select(F.col("p_at").alias("l_at"), F.length("part").alias("n")).distinct()  # a few rows per site
    cut = texts.join(F.broadcast(lengths), (F.col("at") == F.col("l_at")) & (F.col("n") <= F.length("text") - (0 if whole else 1)))
    cut = cut.select("at", "text", "n", F.explode(F.sequence(F.lit(1), F.length("text") - F.col("n") + 1)).alias("place"))
    cut = cut.select("at", "text", "place", F.substr("text", "place", "n").alias("piece"))
    if parts.heads is not None:
        cut = cut.join(parts.heads, (F.col("at") == F.col("h_at")) & (F.substring("piece", 1, PART) == F.col("head")), "left_semi")
    cut = cut.where(F.instr("text", F.col("piece")) == F.col("place")).drop("place")
    return cut.join(parts.rows, (F.col("at") == F.col("p_at")) & (F.col("piece") == F.col("part"))).select("at", "text", "part")


def _sku_links(keys: DataFrame, targets: DataFrame, key_parts: _Parts, target_parts: _Parts, equal: bool = True) -> DataFrame:
    """(at, text, other): SKUs of keys and of targets that are equal (if asked for) or hold each other, each pair once."""
    within = _held(targets, key_parts, whole=False).select("at", F.col("part").alias("text"), F.col("text").alias("other"))
    if not equal:
        return _held(keys, target_parts, whole=False).union(within)
    short = keys.where(F.length("text") < PART).join(targets.toDF("p_at", "other"), (F.col("at") == F.col("p_at")) & (F.col("text") == F.col("other"))).select("at", "text", "other")
    return short.union(_held(keys, target_parts)).union(within)


def text_links(keys: DataFrame, targets: DataFrame) -> DataFrame:
    """(at, how, text, other): the other texts of a site's targets that the texts of its keys match, each pair once.

    That a text matches itself (as a SKU, and as a URL if it is clean) isn't listed.

    keys: site_id, k_sku, k_url (clean); targets: site_id, t_sku, t_url, t_clean;
    all in lower case. `how` names the text of the key and the other: `sku-sku`
    (equal, or one holds the other), `url-sku` (the URL holds the SKU),
    `sku-url` (the other way round), `url-url` (equal when clean). Both frames
    are read several times: hand over written tables.
    """
    i_skus, i_urls = _texts(keys, "site_id", "k_sku"), _texts(keys, "site_id", "k_url")
    v_skus, v_urls = _texts(targets, "site_id", "t_sku"), _texts(targets, "site_id", "t_url")
    i_parts, v_parts = _parts(i_skus), _parts(v_skus)
    clean = targets.where("t_url <> '' AND t_url <> t_clean").select(F.col("site_id").alias("c_at"), "t_url", "t_clean").distinct()
    urls = i_urls.join(clean, (F.col("at") == F.col("c_at")) & (F.col("text") == F.col("t_clean"))).select("at", "text", "t_url")
    named = {"sku-sku": _sku_links(i_skus, v_skus, i_parts, v_parts, equal=False), "url-sku": _held(i_urls, v_parts), "sku-url": _held(v_urls, i_parts).select("at", "part", "text"), "url-url": urls}
    return reduce(DataFrame.union, (df.toDF("at", "text", "other").select("at", F.lit(how).alias("how"), "text", "other") for how, df in named.items()))


_ITEM_KEY, _VARIANT_KEY = ["site_id", "i_sku", "i_url"], ["v_site", "v_sku", "v_url", "v_clean"]


@dataclass
class _Keyed:
    left: DataFrame  # items with the texts of _ITEM_KEY
    right: DataFrame  # variants with those of _VARIANT_KEY
    its: DataFrame  # distinct item keys: `last` item
    vs: DataFrame  # distinct variant keys: v_key (a number), `top` rank, n variants
    by_sku: DataFrame  # at, text, v_key: what a site's item SKU matches
    by_url: DataFrame  # the same for a URL


def _keyed(items: DataFrame, variants: DataFrame) -> _Keyed:
    """Items and variants with the texts that they are matched by, and what each distinct text matches.

    What an item matches is what its SKU matches and what its URL matches. The
    two lists are held by SKU and by URL, so that work grows with the distinct
    texts and their matches: neither with items times variants, nor with pairs
    of a SKU and a URL that come together. The lists are found by equi-joins of
    a site's texts; all tables are written once, as each is read several times,
    and joined by a shuffle, as the files of repeating texts say nothing about
    how large they are in memory.
    """
    left = items.withColumns({"i_sku": F.lower(normalize_sku(F.col("item_sku"))), "i_url": F.lower(clean_product_url(F.col("item_url")))})
    v_sku, v_url = F.lower(F.coalesce("sku", F.lit(""))), F.lower(F.coalesce("url", F.lit("")))
    right = variants.withColumns({"v_sku": v_sku, "v_url": v_url, "v_clean": F.lower(clean_product_url(F.col("url")))}).withColumnRenamed("site_id", "v_site")
    rank = F.struct(F.col("updated_at").isNotNull(), F.col("updated_at"), (-F.col("variant_id")).alias("i"))
    its = materialise(left.groupBy(*_ITEM_KEY).agg(F.max("item_id").alias("last")), "item-keys").hint("merge")
    distinct = right.groupBy(*_VARIANT_KEY).agg(F.max(rank).alias("top"), F.count("*").alias("n"))
    vs = materialise(distinct.withColumn("v_key", F.monotonically_increasing_id()), "variant-keys").hint("merge")
    linked = vs.where("v_url <> ''")
    i_skus, i_urls = _texts(its, "site_id", "i_sku"), _texts(its, "site_id", "i_url")
    v_skus, v_urls = _texts(vs, "v_site", "v_sku"), _texts(vs, "v_site", "v_url")
    i_parts, v_parts = _parts(i_skus), _parts(v_skus)

    def through(links: DataFrame, found: DataFrame, variant: str) -> DataFrame:
        """What a text matches by links (at, a text of the item, a text of the variant)."""
        k = links.toDF("at", "text", "k_variant")
        return k.join(found, (F.col("at") == F.col("v_site")) & (F.col("k_variant") == F.col(variant))).select("at", "text", "v_key")

    by_sku = through(_sku_links(i_skus, v_skus, i_parts, v_parts), vs, "v_sku").union(through(_held(v_urls, i_parts).select("at", "part", "text"), vs, "v_url"))
    by_url = through(_held(i_urls, v_parts), linked, "v_sku").union(i_urls.join(linked, (F.col("at") == F.col("v_site")) & (F.col("text") == F.col("v_clean"))).select("at", "text", "v_key"))
    return _Keyed(left, right, its, vs, *(materialise(df.distinct(), tag).hint("merge") for df, tag in ((by_sku, "sku-matches"), (by_url, "url-matches"))))


def _by_key(rows: DataFrame, keyed: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """rows joined with `keyed` by the columns of a key, nulls equal; the second key is dropped."""
    other = keyed.withColumnsRenamed({c: f"k_{c}" for c in key})
    met = rows.join(other, reduce(and_, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in key]), how)
    return met.drop(*(f"k_{c}" for c in key))


def _asked(rows: DataFrame, text: str, pairs: DataFrame, how: str = "inner") -> DataFrame:
    """rows of items joined with what their text (i_sku or i_url) matches, by the columns at and text; these are dropped."""
    return rows.join(pairs, (F.col("site_id") == F.col("at")) & (F.col(text) == F.col("text")), how).drop("at", "text")


def _without_other(rows: DataFrame, text: str, pairs: DataFrame, how: str) -> DataFrame:
    """rows (with v_key) whose variants their other text matches too (left_semi), or doesn't (left_anti)."""
    other = pairs.withColumnRenamed("v_key", "o_key")
    return rows.join(other, (F.col("site_id") == F.col("at")) & (F.col(text) == F.col("text")) & (F.col("v_key") == F.col("o_key")), how)


def fuzzy_match(items: DataFrame, variants: DataFrame) -> DataFrame:
    """JN-10: pairs of items and variants of one site that share a clean URL, or whose SKUs and URLs hold each other.

    Variants are put to the distinct texts first, and items meet these lists
    last: the pairs themselves are never shuffled. A pair by URL that the SKU
    makes too is left out.
    """
    k = _keyed(items, materialise(variants.select("variant_id", "site_id", "sku", "url", "updated_at"), "match-variants"))
    met = k.vs.join(k.by_sku.select("v_key").union(k.by_url.select("v_key")), "v_key", "left_semi").select("v_key", *_VARIANT_KEY)
    members = materialise(_by_key(k.right, met, _VARIANT_KEY).select("v_key", "variant_id", "updated_at"), "match-members").hint("merge")
    item = k.left.select("item_id", *_ITEM_KEY)
    by_sku = _asked(item, "i_sku", materialise(k.by_sku.join(members, "v_key").drop("v_key"), "sku-members").hint("merge"))
    by_url = _without_other(_asked(item, "i_url", k.by_url), "i_sku", k.by_sku, "left_anti").join(members, "v_key")
    return by_sku.select("item_id", "variant_id", "updated_at").union(by_url.select("item_id", "variant_id", "updated_at"))


def match_classes(items: DataFrame, variants: DataFrame) -> DataFrame:
    """JN-10 without its pairs, as classes that match and their members: (part, how, site_id, text, id, class_id).

    `item` rows hold an item's texts (`how`: sku or url, in lower case, the SKU
    normalised, the URL clean), `link` rows the classes of variants that such a
    text matches, `variant` rows each variant's class: those of one site, SKU
    and URL whatever their case, named after the one that would win. An item
    matches the members of the classes that either of its texts matches, so the
    parts joined by how, site, text and class make fuzzy_match's pairs. Rows
    grow with items, variants and the matches of different texts.
    """
    k = _keyed(items, materialise(variants.select("variant_id", "site_id", "sku", "url", "updated_at"), "match-variants"))
    none = F.lit(None)

    def part(rows: DataFrame, name: str, how: str | None, site: str, text: Column, id: Column, of: Column) -> DataFrame:
        return rows.select(F.lit(name).alias("part"), F.lit(how).cast("string").alias("how"), F.col(site).cast("int").alias("site_id"), text.cast("string").alias("text"), id.cast("long").alias("id"), of.cast("long").alias("class_id"))

    winner = k.vs.select(*_VARIANT_KEY, "v_key", (-F.col("top.i")).alias("class_id"))
    own = [part(k.left.where(F.col(c) != ""), "item", how, "site_id", F.col(c), F.col("item_id"), none) for how, c in (("sku", "i_sku"), ("url", "i_url"))]
    met = [part(pairs.join(winner, "v_key"), "link", how, "at", F.col("text"), none, F.col("class_id")) for how, pairs in (("sku", k.by_sku), ("url", k.by_url))]
    members = _by_key(k.right, winner, _VARIANT_KEY)
    return reduce(DataFrame.union, [*own, *met, part(members, "variant", None, "v_site", none, F.col("variant_id"), F.col("class_id"))])


def best_matches(items: DataFrame, variants: DataFrame) -> DataFrame:
    """WIN-2: an item's winner among its matches, and their number.

    Variants are ranked per key before they meet the pairs, and pairs per
    item's text before they meet the items: no single match is listed.
    """
    return _best(_keyed(items, variants))


def _best(k: _Keyed) -> DataFrame:
    """Of an item's two lists the greater winner counts; what both hold is counted once.

    What both hold is looked for along the shorter list of a pair of texts.
    What each pair of texts reaches is read three times, so it is written: a
    plan that holds it three times takes more of the driver, and of shuffles.
    """
    ranked = k.vs.select("v_key", "top", "n")

    def reach(pairs: DataFrame, name: str) -> DataFrame:
        found = pairs.join(ranked, "v_key").groupBy("at", "text").agg(F.max("top"), F.sum("n"), F.count("*"))
        return found.toDF("at", "text", f"{name}_top", f"{name}_n", f"{name}_held").hint("merge")

    key = k.its.select(*_ITEM_KEY)
    met = _asked(_asked(key, "i_sku", reach(k.by_sku, "sku"), "left"), "i_url", reach(k.by_url, "url"), "left").where("sku_n IS NOT NULL OR url_n IS NOT NULL")
    met = materialise(met, "reached-keys").hint("merge")
    both = lambda cond: met.where(f"sku_held {cond} url_held").select(*_ITEM_KEY)
    common = _without_other(_asked(both(">="), "i_url", k.by_url), "i_sku", k.by_sku, "left_semi")
    common = common.union(_without_other(_asked(both("<"), "i_sku", k.by_sku), "i_url", k.by_url, "left_semi"))
    common = common.join(ranked.select("v_key", "n"), "v_key").groupBy(*_ITEM_KEY).agg(F.sum("n").alias("common"))
    count = lambda c: F.coalesce(c, F.lit(0))
    per_item = _by_key(met, common, _ITEM_KEY, "left").select(*_ITEM_KEY, F.greatest("sku_top", "url_top").alias("top"), (count("sku_n") + count("url_n") - count("common")).alias("matches"))
    found = _by_key(k.left.select("item_id", *_ITEM_KEY), per_item, _ITEM_KEY).groupBy("item_id").agg(F.max("top").alias("top"), F.sum("matches").alias("matches"))
    return found.select("item_id", (-F.col("top.i")).alias("variant_id"), "matches")


def _last(k: _Keyed) -> DataFrame:
    """The last (by item_id) of the items that match a variant; the last of each text first, as the best match is."""

    def told(text: str, pairs: DataFrame) -> DataFrame:
        return _asked(k.its.groupBy("site_id", text).agg(F.max("last").alias("item_id")), text, pairs).select("v_key", "item_id")

    last = F.max("item_id").alias("item_id")
    per_key = told("i_sku", k.by_sku).union(told("i_url", k.by_url)).groupBy("v_key").agg(last)
    per_variant = k.vs.join(per_key, "v_key").select(*_VARIANT_KEY, "item_id")
    return _by_key(k.right.select("variant_id", *_VARIANT_KEY), per_variant, _VARIANT_KEY).groupBy("variant_id").agg(last)


def register_variants(items: DataFrame, variants: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """MRG-7 over items (item_id, product_id, site_id, item_sku, price, in_stock).

    An item whose SKU its site has already is rejected, as is all but the
    first (by item_id) of several items of one site and SKU; the others adopt
    the product of their SKU if there is one (JN-13), and a first history row
    is made for those with a price.
    """
    have = variants.select(F.col("site_id").alias("s"), F.col("sku").alias("k")).distinct().withColumn("taken", F.lit(True))
    first = items.groupBy(F.col("site_id").alias("f_site"), F.col("item_sku").alias("f_sku")).agg(F.min("item_id").alias("first"))
    met = items.join(have, F.col("site_id").eqNullSafe(F.col("s")) & F.col("item_sku").eqNullSafe(F.col("k")), "left")
    met = met.join(first, F.col("site_id").eqNullSafe(F.col("f_site")) & F.col("item_sku").eqNullSafe(F.col("f_sku")))
    ok = F.col("taken").isNull() & (F.col("item_id") == F.col("first"))
    known = variants.groupBy(F.col("sku").alias("k2")).agg(F.min_by("product_id", "variant_id").alias("known"))
    linked = met.where(ok).join(known, F.col("item_sku") == F.col("k2"), "left")
    added = linked.select(*(F.coalesce("known", "product_id").alias(c) if c == "product_id" else F.col(c) for c in items.columns), F.col("known").isNotNull().alias("linked"))
    history = added.where("price IS NOT NULL").select("item_id", "price", "in_stock", F.lit(as_of).cast("timestamp_ntz").alias("captured_at"))
    return {"variants": added, "history": history, "rejected": met.where(~ok).select(*items.columns)}


def adopt_products(items: DataFrame, variants: DataFrame) -> DataFrame:
    """JN-13: a new variant whose SKU is anywhere already adopts that product (of the lowest variant id)."""
    known = variants.groupBy(F.col("sku").alias("k")).agg(F.min_by("product_id", "variant_id").alias("product_id"))
    return items.join(known, F.col("item_sku") == F.col("k"), "left").drop("k")


def find_products(items: DataFrame, products: DataFrame) -> DataFrame:
    """JN-14: the lowest id of a product of the item's name and brand; new ones follow the highest id.

    New ones are numbered in the order of a hash of name and brand, so that no
    task orders them all.
    """
    dim = products.groupBy(F.col("product_name").alias("n"), F.col("brand").alias("b")).agg(F.min("product_id").alias("product_id"))
    joined = items.join(dim, (F.col("item_name") == F.col("n")) & (F.coalesce("item_brand", F.lit(NO_BRAND)) == F.col("b")), "left").drop("n", "b")
    fresh = joined.where("product_id IS NULL").select("item_name", F.coalesce("item_brand", F.lit(NO_BRAND)).alias("item_brand")).distinct()
    top = products.agg(F.coalesce(F.max("product_id"), F.lit(0)).alias("top"))
    placed = numbered(fresh.withColumn("h", F.xxhash64("item_name", "item_brand")), "h", "item_name", "item_brand")
    made = placed.crossJoin(F.broadcast(top)).select(F.col("item_name").alias("n"), F.col("item_brand").alias("b"), (F.col("top") + 1 + F.col("i")).alias("made"))
    return joined.join(made, (F.col("item_name") == F.col("n")) & (F.coalesce("item_brand", F.lit(NO_BRAND)) == F.col("b")), "left").select(*items.columns, F.coalesce("product_id", "made").alias("product_id"), F.col("made").isNotNull().alias("created"))


def extension_upsert(items: DataFrame, variants: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """MRG-2 over a batch of items (item_id, site_id, item_sku, item_url, price, image_url).

    All matches of an item are updated, the winner alone gets a history row if
    price or stock changed; items without a match come back as `fresh`. Of
    several items that match one variant the last (by item_id) counts, as it
    would if they came one by one. Items are matched against the state before
    the batch (extension.ingest folds them in order); several of one id are
    one, the greatest by all columns in their order.
    """
    rest = [c for c in items.columns if c != "item_id"]
    items = items.groupBy("item_id").agg(F.max(F.struct(*rest)).alias("x")).select("item_id", *(F.col(f"x.{c}").alias(c) for c in rest))
    items, variants = materialise(items, "upsert-items").hint("merge"), materialise(variants, "upsert-variants").hint("merge")
    keyed = _keyed(items, variants)
    last, winners = _last(keyed), _best(keyed)
    item = items.select("item_id", F.col("price").alias("i_price"), clean_product_url(F.col("item_url")).alias("i_url"), normalize_image_url(F.col("image_url")).alias("i_image"))
    met = variants.join(last, "variant_id", "left").join(item, "item_id", "left")
    hit = F.col("item_id").isNotNull()
    state = {
        "prev_price": F.when(hit, F.col("price")).otherwise(F.col("prev_price")),
        "price": F.when(hit, F.col("i_price")).otherwise(F.col("price")),
        "in_stock": F.when(hit, F.col("i_price") > 0).otherwise(F.col("in_stock")),
        "updated_at": F.when(hit, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("updated_at")),
        "url": F.when(hit, F.col("i_url")).otherwise(F.col("url")),
        "image_url": F.when(hit & (F.col("i_image") != "") & (F.coalesce("image_url", F.lit("")) == ""), F.col("i_image")).otherwise(F.col("image_url")),
        "active": F.col("active") | hit,
    }
    after = met.select(*(state[c].alias(c) if c in state else F.col(c) for c in variants.columns))
    best = winners.join(item, "item_id").join(variants.select("variant_id", F.col("price").alias("o_price"), F.col("in_stock").alias("o_stock")), "variant_id")
    history = best.where(changed(F.col("o_price"), F.col("o_stock"), F.col("i_price"), F.col("i_price") > 0)).select("variant_id", F.col("i_price").alias("price"), (F.col("i_price") > 0).alias("in_stock"), F.lit(as_of).cast("timestamp_ntz").alias("captured_at"))
    return {"variants": after, "history": history, "fresh": items.join(winners, "item_id", "left_anti")}
