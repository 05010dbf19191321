"""Names, brands, SKUs, stock and page signatures: FN-5, 9, 11, 12, 16, 19, 20, 28 to 32, 36."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is cut from names, in order.
NOISE = [
    r"\b\d+\s*%\s*OFF\b",
    r"\b(?:envío|envio)\s+gratis\b",
    r"\bfree\s+shipping\b",
    r"\b\d+\s*(?:msi|meses\s+sin\s+intereses)\b",
    r"\bllega\s+mañana\b",
    r"\b(?:oferta|descuento|ahorro|promoción|promocion|especial|precio)\b",
]
TRAILING = r"\s*[-|•/]+(?:\s+[-|•/]+)*\s*$"
OUT_RAW = ["out of stock", "oos", "agotado", "sin stock", "no disponible", "soldout", "discontinued"]
OUT_PAGE = ["agotado", "sin stock", "no disponible", "out of stock", "sold out"]
NO_BRAND = "Genérica"
KNOWN_BRANDS = {"isopure": "Isopure", "orgain": "Orgain", "optimum nutrition": "Optimum Nutrition", "premier protein": "Premier Protein"}
BLOCKED_ERRORS = ["403", "Forbidden", "Unauthorized", "Access Denied"]
CHALLENGES = ["px-captcha", "perimeterx", "verify your identity", "verifica tu identidad", "sec-cpt", "securitas", "cloudflare-challenge", "challenge-platform", "cf-challenge", "__cf_bm", "cf-ray", "ray id:", "cloudflare"]
CHALLENGE_TITLES = ["verify your identity", "verifica tu identidad", "attention required!", "cloudflare"]
NEEDS_JS = ["you need to enable javascript to run this app", "javascript está deshabilitado", "enable javascript", "activar javascript", "<noscript>", '<div id="app"></div>', '<div id="root"></div>', "<app-root></app-root>"]
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'"}

#: Java's case folding and classes are ASCII without these flags.
_U = "(?iuU)"


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value computed once however often `of` names it: Spark computes again what branches of a CASE share."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def any_in(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def blank(text: Column) -> Column:
    return text.isNull() | (F.regexp_replace(text, r"(?U)\s", "") == "")


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def unescape(text: Column) -> Column:
    """The usual named entities and the Latin-1 letters; `&amp;` last."""
    names = ENTITIES | {f"&{n}": v for n, v in html5.items() if n.endswith(";") and len(v) == 1 and "¡" <= v <= "ÿ"}
    out = reduce(lambda a, kv: F.replace(a, F.lit(kv[0]), F.lit(kv[1])), names.items(), text)
    return F.when(F.contains(text, F.lit("&")), F.replace(out, F.lit("&amp;"), F.lit("&"))).otherwise(text)


def normalize_name(name: Column) -> Column:
    """FN-5."""
    text = F.regexp_replace(trim_space(unescape(name)), r"(?U)\s+", " ")
    for pattern in NOISE:
        text = trim_space(F.regexp_replace(text, _U + pattern, ""))
    text = F.regexp_replace(text, r"\(\s*\)|\[\s*\]|\{\s*\}", "")
    text = F.regexp_replace(text, "(?U)" + TRAILING, "")
    text = trim_space(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(blank(name), F.lit("")).otherwise(text)


def normalize_stock(raw: Column, page: Column) -> Column:
    """FN-9: false if the field or the page says that there is none."""
    return ~(F.coalesce(any_in(F.lower(raw), OUT_RAW), F.lit(False)) | F.coalesce(any_in(F.lower(page), OUT_PAGE), F.lit(False)))


def normalize_brand(brand: Column) -> Column:
    """FN-11."""
    text = trim_space(F.regexp_replace(F.split_part(trim_space(unescape(brand)), F.lit("/"), F.lit(1)), r"(?U)\s+", " "))
    return once(text, lambda t: F.when(blank(brand) | (F.length(t) < 2), F.lit(NO_BRAND)).otherwise(t))


def normalize_sku(sku: Column) -> Column:
    """FN-12. The first alternative that fits counts, so `modelo X` leaves `o X`, as it always has."""
    text = F.regexp_replace(trim_space(unescape(sku)), _U + r"^(?:sku|código|codigo|ref|model|modelo|sku\s*:)\s*", "")
    return F.when(blank(sku), F.lit("")).otherwise(trim_space(text))


def stable_hash(text: Column) -> Column:
    """FN-16: h = 31 h + c in 32 bits, its absolute value in base 36. UTF-16 units, as Java's hash."""
    h = F.java_method(F.lit("java.util.Objects"), F.lit("hashCode"), text).cast("long")
    return F.concat(F.lit("GEN-"), F.conv(F.abs(h).cast("string"), 10, 36))


def brand_from_name(name: Column) -> Column:
    """FN-19: a known brand in the name, else its first word."""
    low = F.lower(name)
    known = reduce(lambda a, kv: a.when(F.contains(low, F.lit(kv[0])), F.lit(kv[1])), KNOWN_BRANDS.items(), F.when(F.lit(False), F.lit("")))
    first = F.split_part(trim_space(name), F.lit(" "), F.lit(1))
    return F.coalesce(known, F.when(F.length(first) > 2, first).otherwise(F.lit(NO_BRAND)))


def detect_strategy(page: Column, error: Column, title: Column) -> Column:
    """FN-28: which way of capture recorded pages call for."""
    low = F.lower(page)
    return (
        F.when(blank(page), F.when(F.coalesce(any_in(error, BLOCKED_ERRORS), F.lit(False)), F.lit("Cloudflare")).otherwise(F.lit("Standard")))
        .when(any_in(low, CHALLENGES) | F.coalesce(any_in(F.lower(title), CHALLENGE_TITLES), F.lit(False)), F.lit("Cloudflare"))
        .when(any_in(low, NEEDS_JS), F.lit("Heavy-JS"))
        .otherwise(F.lit("Standard"))
    )


def strategy_weight(strategy: Column) -> Column:
    """FN-29."""
    return F.when(strategy == "Cloudflare", 3).when(strategy == "Heavy-JS", 2).otherwise(1)


def log_level_push(level: Column) -> Column:
    """FN-30, pushed events: any case, long and short names."""
    low = F.lower(level)
    return F.when(low.isin("verbose", "v"), "Verbose").when(low.isin("debug", "d"), "Debug").when(low.isin("warning", "warn", "w"), "Warning").when(low.isin("error", "err", "e"), "Error").when(low.isin("fatal", "f"), "Fatal").otherwise("Information")


def log_level_record(level: Column) -> Column:
    """FN-30, stored records: the listed forms only."""
    return F.when(level.isin("v", "verbose", "Verbose"), "Verbose").when(level.isin("d", "debug", "Debug"), "Debug").when(level.isin("w", "warning", "Warning", "warn"), "Warning").when(level.isin("e", "error", "Error", "err"), "Error").when(level.isin("f", "fatal", "Fatal"), "Fatal").otherwise("Information")


def age_label(at: Column, now: Column) -> Column:
    """PRJ-5: days, hours, minutes, or seconds since, cut off."""
    s = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(at.cast("timestamp"))
    unit = lambda n, mark: F.concat(F.floor(s / n).cast("string"), F.lit(mark))
    return F.when(s >= 86400, unit(86400, " d")).when(s >= 3600, unit(3600, " h")).when(s >= 60, unit(60, " m")).otherwise(F.lit("segundos"))


def date_label(at: Column) -> Column:
    """FN-36."""
    return F.date_format(at, "dd/MM/yyyy")
