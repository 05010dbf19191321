"""The HTML functions on pandas batches, one call per distinct page of a batch. Workers import these."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict
from decimal import Decimal

import pandas as pd
import pyarrow as pa

from pricelark.html import category, product, readability, selectors
from pricelark.html.client import extract_client
from pricelark.html.dom import parse


def _each(pages: pd.Series, f: Callable) -> list:
    """f of each value, called once for equal ones."""
    known: dict = {}
    out = []
    for p in pages:
        if p not in known:
            known[p] = f(p)
        out.append(known[p])
    return out


def extract(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([asdict(x) for x in _each(pages, product.extract)], columns=[c.split()[0] for c in product.SCHEMA.split(", ")])


def main_text(pages: pd.Series) -> pd.Series:
    return pd.Series(_each(pages, readability.main_text), dtype=object)


def main_html(pages: pd.Series) -> pd.Series:
    return pd.Series(_each(pages, readability.main_html), dtype=object)


def grid(pages: pd.Series) -> pd.DataFrame:
    names = [c.split()[0] for c in category.SELECTORS_SCHEMA.split(", ")]
    found = _each(pages, lambda p: category.detect(parse(p)))
    return pd.DataFrame([asdict(x) if x else dict.fromkeys(names) for x in found], columns=names)


def next_page(pages: pd.Series) -> pd.Series:
    return pd.Series(_each(pages, lambda p: category.next_page(parse(p))), dtype=object)


def selector(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"is_xpath": _each(values, selectors.is_xpath), "valid": _each(values, selectors.is_valid_selector)})


def learned(pages: pd.Series, paths: pd.Series, prices: pd.Series) -> pd.Series:
    return pd.Series([selectors.learned_selector_holds(parse(p), x, Decimal(v)) if x and v is not None else False for p, x, v in zip(pages, paths, prices, strict=True)])


def diagnosis(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(_each(pages, product.diagnose), columns=["price", "name", "image", "stock"])


def configured(pages: pd.Series, price: pd.Series, stock: pd.Series, image: pd.Series) -> pd.DataFrame:
    found = [product.by_selectors(parse(p), a, b, c) or product.Product(method="") for p, a, b, c in zip(pages, price, stock, image, strict=True)]
    return pd.DataFrame([asdict(x) for x in found], columns=[c.split()[0] for c in product.SCHEMA.split(", ")])


def _phases(page: str | None, price: str | None, stock: str | None, image: str | None) -> dict:
    """Whether the selectors are well formed, whether they found a price, and what counts: they or the extraction."""
    if selectors.first_invalid(price, None, stock, None) is not None:
        return {"valid": False, "configured": False, "in_stock": False, "confidence": 0}
    found = product.by_selectors(parse(page), price, stock, image) if (price or "").strip() else None
    out, learned = found or product.extract(page), None
    if found is None and out.price and out.xpath and selectors.learned_selector_holds(parse(page), out.xpath, out.price):
        learned = out.xpath
    return {"valid": True, "configured": found is not None, "price": out.price, "in_stock": out.in_stock, "method": out.method, "source": out.source, "confidence": out.confidence, "image_url": out.image_url, "learned": learned}


def phases(pages: pd.Series, price: pd.Series, stock: pd.Series, image: pd.Series) -> pd.DataFrame:
    names = ["valid", "configured", "price", "in_stock", "method", "source", "confidence", "image_url", "learned"]
    return pd.DataFrame([_phases(*x) for x in zip(pages, price, stock, image, strict=True)], columns=names, dtype=object)


def category_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products of each page of batches of (page_id, url, html), a batch out for each in."""
    for b in parts:
        made: list[tuple] = []
        for key, url, page in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
            found = category.read_category(page, url)
            made += [(key, k, p["name"], p["price"], p["url"], p["image_url"], p["sku"], found.next_url) for k, p in enumerate(found.products, 1)]
        schema = pa.schema([b.schema.field("page_id"), ("card", pa.int32()), ("name", pa.string()), ("price", pa.decimal128(18, 2)), ("url", pa.string()), ("image_url", pa.string()), ("sku", pa.string()), ("next_url", pa.string())])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)] if made else [pa.array([], f.type) for f in schema], schema=schema)


def client(pages: pd.Series, urls: pd.Series) -> pd.DataFrame:
    names = [c.split()[0] for c in product.SCHEMA.split(", ")]
    found = [extract_client(p, u) for p, u in zip(pages, urls, strict=True)]
    return pd.DataFrame([asdict(x) if x else dict.fromkeys(names) for x in found], columns=names)
