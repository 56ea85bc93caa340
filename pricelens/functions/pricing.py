"""Price rules (X1, X4-X8, X21, X23, P12, A16) as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import nonzero, round_half_up
from .text import WS, WS_SET

# First amount in a text, after any currency word ("Rs.", "MRP", the rupee sign).
AMOUNT_PATTERN = r"([0-9]+(?:\.[0-9]+)?)"


def clean_price(text: Column, rule: str = "first_amount") -> Column:
    """Text -> positive double, or null.

    ``first_amount`` (default, the documented rule): drop thousands commas and
    take the first ``digits[.digits]`` run, so ``Rs. 149`` is 149.0 and
    ``MRP 199`` is 199.0. ``strip`` is the literal code rule: drop commas, keep
    only digits and dots, parse the rest (``Rs.65`` then reads as 0.65).
    """
    no_commas = F.replace(text, F.lit(","), F.lit(""))
    if rule == "first_amount":
        amount = F.regexp_extract(no_commas, AMOUNT_PATTERN, 1)
    elif rule == "strip":
        amount = F.regexp_replace(no_commas, r"[^0-9.]", "")
    else:
        raise ValueError(f"unknown price rule {rule!r}")
    value = amount.try_cast("double")
    return F.when(value > 0, value)


def join_price_parts(whole: Column, fraction: Column) -> Column:
    """Whole + fraction spans of a displayed price -> price text."""
    w = F.regexp_replace(whole, f"[.{WS_SET}]+$", "")
    return F.concat_ws(".", w, F.coalesce(F.nullif(fraction, F.lit("")), F.lit("00")))


def effective_mrp(price: Column, mrp: Column) -> Column:
    """MRP when it is above the price, else the price."""
    return F.when(mrp > price, mrp).otherwise(price)


def discount_pct(price: Column, eff_mrp: Column) -> Column:
    """(mrp - price) / mrp * 100, 1 dp; 0 when there is no gain."""
    return F.when(eff_mrp > price,
                  round_half_up((eff_mrp - price) / eff_mrp * F.lit(100.0), 1)).otherwise(F.lit(0.0))


def unit_price(price: Column, quantity: Column, unit: Column) -> Column:
    """Price per 100 g / 100 ml / piece, 2 dp.

    A quantity that does not parse or is zero gives the price itself (the
    reference catches the error the same way); an unknown unit gives the price.
    """
    q = quantity.cast("string").try_cast("double")
    u = F.lower(F.coalesce(unit, F.lit("pcs")))
    per_100_small = F.try_divide(price, q) * F.lit(100.0)
    per_100_large = F.try_divide(price, q * F.lit(1000.0)) * F.lit(100.0)
    per_piece = F.try_divide(price, q)
    raw = (F.when(u.isin("g", "ml"), per_100_small)
            .when(u.isin("kg", "l"), per_100_large)
            .when(u == "pcs", per_piece)
            .otherwise(price))
    return F.coalesce(round_half_up(raw, 2), round_half_up(price, 2))


def unit_label(unit: Column) -> Column:
    """per 100g / per 100mL / per pc / per unit."""
    u = F.lower(unit)
    return (F.when(u.isin("g", "kg"), F.lit("per 100g"))
             .when(u.isin("ml", "l"), F.lit("per 100mL"))
             .when(u == "pcs", F.lit("per pc"))
             .otherwise(F.lit("per unit")))


def value_score(ppu: Column, price: Column, delivery_mins: Column) -> Column:
    """Unit price with a 15 %-per-hour delivery penalty, 4 dp.

    Missing or zero unit price falls back to the price; missing, zero or NaN
    minutes count as 60.
    """
    p = F.coalesce(nonzero(ppu), price)
    dm = F.coalesce(nonzero(delivery_mins.cast("double")), F.lit(60.0))
    return round_half_up(p * (F.lit(1.0) + dm / F.lit(60.0) * F.lit(0.15)), 4)


def amounts(text: Column) -> Column:
    """All rupee amounts in a text, in order, as array<double>."""
    found = F.regexp_extract_all(F.regexp_replace(text, ",", ""),
                                 F.lit(f"₹{WS}*([0-9]+(?:[.][0-9]+)?)"), 1)
    return F.transform(found, lambda s: s.cast("double"))


def sanity_price(price: Column, mrp: Column, found: Column) -> Column:
    """If price < 5 % of MRP, take the first found amount >= 5 % of MRP, else MRP."""
    floor_ = mrp * F.lit(0.05)
    repaired = F.coalesce(F.try_element_at(F.filter(found, lambda p: p >= floor_), F.lit(1)), mrp)
    return F.when(mrp.isNotNull() & (price < floor_), repaired).otherwise(price)


def card_mrp(price: Column, found: Column) -> Column:
    """Highest amount of a card is the MRP when there are two or more and it is above the price."""
    top = F.array_max(found)
    return F.when((F.size(found) >= 2) & (top > price), top)
