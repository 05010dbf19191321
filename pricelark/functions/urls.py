"""URLs, images and SKUs in them: FN-10, 13, 14, 15, 21, 22, as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelark.functions.text import blank, once, trim_space

# Parameters that only track, and paths whose whole query goes.
TRACKING = ["tracking_id=", "polycard_client=", "be_origin=", "overlay_label=", "search_layout=", "position=", "wid=", "sid=", "utm_", "ref=", "gclid=", "fbclid="]
BARE_PATHS = ["/up/", "/p/", "/dp/"]
SKU_PARAMETERS = r"(?i)[?&](?:sku|id|prod|product|code|productId|productCode|spu|item|itemId)=(\w{4,20})"


def make_absolute_url(url: Column, base: Column) -> Column:
    """FN-10."""
    u = trim_space(url)
    host, scheme = F.try_parse_url(base, F.lit("HOST")), F.try_parse_url(base, F.lit("PROTOCOL"))
    return F.when(blank(url), F.lit("")).when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.startswith("/") & host.isNotNull(), F.concat(scheme, F.lit("://"), host, u)).otherwise(u)


def clean_product_url(url: Column) -> Column:
    """FN-14: no fragment, no tracking parameters, no slash at the end."""
    tracks = lambda p: reduce(lambda a, b: a | b, (F.lower(p).startswith(F.lit(x)) for x in TRACKING))

    def with_query(u: Column, path: Column) -> Column:
        bare = reduce(lambda a, b: a | b, (F.contains(path, F.lit(x)) for x in BARE_PATHS)) | path.rlike(r"(?i)/MLM-?\d+")
        kept = F.filter(F.split(F.substr(u, F.length(path) + 2), "&"), lambda p: ~tracks(p))
        return F.when(bare, path).otherwise(once(kept, lambda k: F.when(F.size(k) == 0, path).otherwise(F.concat(path, F.lit("?"), F.array_join(k, "&")))))

    full = lambda u: F.when(F.instr(u, "?") == 0, u).otherwise(once(F.split_part(u, F.lit("?"), F.lit(1)), lambda path: with_query(u, path)))
    return F.when(blank(url), F.lit("")).otherwise(F.rtrim(once(F.split_part(trim_space(url), F.lit("#"), F.lit(1)), full), F.lit("/")))


def deduce_sku(url: Column) -> Column:
    """FN-15: from a parameter, a number that ends a path segment, a marketplace id, else from the hash."""
    found = lambda pattern: F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))
    return F.when(blank(url), F.lit("")).otherwise(F.coalesce(F.upper(found(SKU_PARAMETERS)), found(r"[/-](\d{4,15})(?:\.html|\?|/|$)"), F.upper(found(r"(?i)(ML[A-Z]-?\d{7,15})")), F.concat(F.lit("SKU-"), F.upper(F.substring(F.sha2(url, 256), 1, 8)))))


def normalize_image_url(url: Column) -> Column:
    """FN-13: images of one CDN come 2,000 wide."""
    u = trim_space(url)
    wide = F.when(F.contains(u, F.lit("width=")), F.regexp_replace(u, r"(?<=[?&]width=)\d+", "2000")).when(F.contains(u, F.lit("?")), F.concat(u, F.lit("&width=2000"))).otherwise(F.concat(u, F.lit("?width=2000")))
    return F.when(blank(url), F.lit("")).when(F.contains(u, F.lit("/cdn/shop/")) | F.contains(u, F.lit("cdn.shopify.com")), wide).otherwise(u)


def is_valid_link(url: Column) -> Column:
    """FN-21."""
    u = F.lower(trim_space(url))
    return ~blank(url) & ~u.startswith("javascript:") & ~u.isin("#", "/") & ~u.startswith("tel:") & ~u.startswith("mailto:")


def best_srcset_url(srcset: Column) -> Column:
    """FN-22: the candidate of the largest width or density; the first of equals."""
    words = F.transform(F.filter(F.split(srcset, ","), lambda p: F.trim(p) != ""), lambda p: F.split(F.trim(p), " +"))
    mark = lambda w: F.when(F.size(w) > 1, F.lower(F.get(w, F.lit(1)))).otherwise(F.lit(""))
    size = lambda w: F.coalesce(F.when(mark(w).endswith("w"), F.rtrim(mark(w), F.lit("w")).try_cast("double")).when(mark(w).endswith("x"), F.rtrim(mark(w), F.lit("x")).try_cast("double") * 1000), F.lit(1.0))
    ranked = F.transform(words, lambda w, k: F.struct(size(w).alias("size"), (-k).alias("order"), F.get(w, F.lit(0)).alias("url")))
    return F.array_max(ranked)["url"]


def host_of(url: Column) -> Column:
    """The host without `www.`, in lower case."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def same_site(a: Column, b: Column) -> Column:
    """FLT-15: hosts equal, or one a dotted suffix of the other."""
    x, y = host_of(a), host_of(b)
    return (x == y) | x.endswith(F.concat(F.lit("."), y)) | y.endswith(F.concat(F.lit("."), x))
