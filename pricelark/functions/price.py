"""Prices in text: FN-1 to FN-4, FN-7, FN-18, as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of an amount and of a currency.
AMOUNT = r"(?<![\d.,])(\d{1,3}(?:[.,]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?)(?![\d.,])"
CURRENCY = r"(?i)(?<![A-Za-z])(?:MXN|USD|EUR|GBP)(?![A-Za-z])|[$€£]"
#: Characters before an amount, and in all around it, where a currency counts.
BEFORE, AROUND = 6, 12


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often use() refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalize_separators(amount: Column) -> Column:
    """FN-2: of two kinds of separators the last is the decimal one; a single kind before three digits groups thousands."""
    dot, comma = F.instr(F.reverse(amount), "."), F.instr(F.reverse(amount), ",")
    both = F.when(dot < comma, F.replace(amount, F.lit(","))).otherwise(F.replace(F.replace(amount, F.lit(".")), F.lit(","), F.lit(".")))
    return (
        F.when((dot > 0) & (comma > 0), both)
        .when((dot == 0) & (comma == 0), amount)
        .when(F.greatest(dot, comma) == 4, F.translate(amount, ".,", ""))
        .otherwise(F.replace(amount, F.lit(","), F.lit(".")))
    )


def currency_of(text: Column) -> Column:
    """FN-4: the first currency of the whole text; a dollar sign alone names none."""
    name = lambda found: F.when(found == "€", F.lit("EUR")).when(found == "£", F.lit("GBP")).when(found.isin("", "$"), F.lit(None)).otherwise(found)
    return _bound(F.upper(F.regexp_extract(text, f"({CURRENCY})", 1)), name)


def _chosen(text: Column, found: Column, gaps: Column) -> Column:
    """The first amount with a currency near it, else the first; null without one.

    The pieces between amounts are the split of the text by the amount pattern,
    so an amount's place is the length of all pieces and amounts before it.
    """

    def step(acc: Column, k: Column) -> Column:
        amount, start = F.element_at(found, k), acc["at"] + F.length(F.element_at(gaps, k))
        window = F.substring(text, F.greatest(F.lit(0), start - BEFORE) + 1, F.length(amount) + AROUND)
        return F.struct((start + F.length(amount)).alias("at"), F.when(acc["near"].isNotNull(), acc["near"]).when(window.rlike(CURRENCY), amount).alias("near"))

    near = F.aggregate(F.sequence(F.lit(1), F.size(found)), F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("near")), step, lambda acc: acc["near"])
    return F.when(F.size(found) > 0, F.coalesce(near, F.element_at(found, 1)))


def _parsed(text: Column) -> Column:
    def priced(raw: Column) -> Column:
        price = normalize_separators(raw).try_cast("decimal(28,2)")
        return F.when(price > 0, F.struct(price.cast("decimal(18,2)").alias("price"), currency_of(text).alias("currency"), raw.alias("raw")))

    pieces = F.struct(F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(1)).alias("found"), F.split(text, AMOUNT, -1).alias("gaps"))
    return _bound(pieces, lambda x: _bound(_chosen(text, x["found"], x["gaps"]), priced))


def parse_price(text: Column) -> Column:
    """FN-1: struct(price, currency, raw), null if the text has no positive amount.

    The first amount with a currency near it counts, else the first. The window
    begins BEFORE characters before the amount (or at the text's beginning) and
    is AROUND characters longer than the amount (FN-3).
    """

    return _bound(text, _parsed)


def parse_price_client(text: Column) -> Column:
    """FN-18: digits and dots only, their leading number, else 0."""
    number = F.regexp_extract(F.regexp_replace(text, r"[^0-9.]", ""), r"^(\d*\.?\d*)", 1)
    return F.coalesce(number.try_cast("double"), F.lit(0.0))
