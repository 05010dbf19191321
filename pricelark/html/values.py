"""The scalar rules of functions/ for use inside Python workers; fixed values are shared."""

from __future__ import annotations

import re
from decimal import Decimal, InvalidOperation
from typing import NamedTuple
from urllib.parse import urlsplit

from pricelark.functions import price as P
from pricelark.functions import text as T
from pricelark.functions import urls as U
from pricelark.html.dom import unescape

_AMOUNT = re.compile(P.AMOUNT)
_CURRENCY = re.compile(P.CURRENCY)
_NOISE = [re.compile(p, re.IGNORECASE) for p in T.NOISE]
_TRAILING = re.compile(T.TRAILING)


class Price(NamedTuple):
    price: Decimal
    currency: str | None
    raw: str


def parse_price(text: str | None) -> Price | None:
    """FN-1 to FN-4."""
    found = list(_AMOUNT.finditer(text or ""))
    if not found:
        return None

    def near(m: re.Match) -> bool:
        start = max(0, m.start() - P.BEFORE)
        return bool(_CURRENCY.search(text[start : start + len(m.group()) + P.AROUND]))

    raw = next(filter(near, found), found[0]).group(1)
    dot, comma = raw.rfind("."), raw.rfind(",")
    if dot >= 0 and comma >= 0:
        plain = raw.replace(",", "") if dot > comma else raw.replace(".", "").replace(",", ".")
    elif max(dot, comma) >= 0 and len(raw) - max(dot, comma) == 4:
        plain = raw.replace(".", "").replace(",", "")
    else:
        plain = raw.replace(",", ".")
    try:
        price = Decimal(plain)
    except InvalidOperation:
        return None
    if price <= 0 or price >= Decimal(10) ** 16:
        return None
    m = _CURRENCY.search(text)
    currency = {"$": None, "€": "EUR", "£": "GBP"}.get(m.group(), m.group().upper()) if m else None
    return Price(price.quantize(Decimal("0.01")), currency, raw)


def normalize_name(text: str | None) -> str:
    """FN-5."""
    out = " ".join(unescape(text or "").split())
    for noise in _NOISE:
        out = noise.sub("", out).strip()
    out = _TRAILING.sub("", re.sub(r"\(\s*\)|\[\s*\]|\{\s*\}", "", out))
    return " ".join(out.split())


def normalize_brand(text: str | None) -> str:
    """FN-11."""
    out = " ".join(unescape(text or "").strip().split("/")[0].split())
    return out if len(out) > 1 else T.NO_BRAND


def normalize_sku(text: str | None) -> str:
    """FN-12."""
    return re.sub(r"^(?:sku|código|codigo|ref|model|modelo|sku\s*:)\s*", "", unescape(text or "").strip(), flags=re.IGNORECASE).strip()


def absolute_url(url: str | None, base: str | None) -> str:
    """FN-10."""
    u = (url or "").strip()
    if u.startswith("//"):
        return "https:" + u
    if u.startswith("/") and base:
        try:
            b = urlsplit(base)
            return f"{b.scheme}://{b.hostname}{u}" if b.scheme and b.hostname else u
        except ValueError:
            return u
    return u


def image_url(url: str | None) -> str:
    """FN-13."""
    u = (url or "").strip()
    if "/cdn/shop/" not in u and "cdn.shopify.com" not in u:
        return u
    if "width=" in u:
        return re.sub(r"(?<=[?&]width=)\d+", "2000", u)
    return u + ("&" if "?" in u else "?") + "width=2000"


def valid_link(url: str | None) -> bool:
    """FN-21."""
    u = (url or "").strip().lower()
    return bool(u) and u not in ("#", "/") and not u.startswith(("javascript:", "tel:", "mailto:"))


def deduce_sku(url: str) -> str:
    """FN-15."""
    from hashlib import sha256

    if not url.strip():
        return ""
    m = re.search(U.SKU_PARAMETERS, url)
    if m:
        return m.group(1).upper()
    m = re.search(r"[/-](\d{4,15})(?:\.html|\?|/|$)", url)
    if m:
        return m.group(1)
    m = re.search(r"ML[A-Z]-?\d{7,15}", url, re.IGNORECASE)
    return m.group().upper() if m else "SKU-" + sha256(url.encode()).hexdigest()[:8].upper()


def best_srcset(srcset: str) -> str | None:
    """FN-22."""
    best, most = None, 0.0
    for part in srcset.split(","):
        words = part.split()
        if not words:
            continue
        size = 1.0
        if len(words) > 1 and words[1][-1:].lower() in ("w", "x"):
            try:
                size = float(words[1].lower().rstrip("wx")) * (1000 if words[1][-1].lower() == "x" else 1)
            except ValueError:
                size = 1.0
        if best is None or size > most:
            best, most = words[0], size
    return best
