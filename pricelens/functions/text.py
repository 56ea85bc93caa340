"""Text rules (X9-X12, X14-X18, X20, X25, P16) as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as web pages use it: ASCII and Unicode spaces (no-break, thin, ideographic ...),
# written out so that Java and RE2 agree.
WS_SET = r" \t\n\x0B\f\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = f"[{WS_SET}]"


WS_CHARS = (" \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
            + "\u2028\u2029\u202f\u205f\u3000")


def strip_text(c: Column) -> Column:
    """Strip leading/trailing whitespace incl. tabs and newlines (plain trim strips spaces only).

    ``btrim`` with an explicit character set: no regex on the hot path.
    """
    return F.btrim(c, F.lit(WS_CHARS))


def clean_text(c: Column, limit: int | None = None) -> Column:
    """Strip; null is empty (X9). ``limit`` keeps the first characters, for display only."""
    whole = strip_text(F.coalesce(c, F.lit("")))
    return whole if limit is None else F.substring(whole, 1, limit)


def squeeze_spaces(c: Column) -> Column:
    return strip_text(F.regexp_replace(c, WS + "+", " "))


def clean_product_name(raw: Column, brand: Column) -> Column:
    """Cut the rating tail, a trailing number, long numbers, a brand prefix; squeeze."""
    n = F.regexp_replace(raw, r"(?is)" + WS + r"*[0-9]+(?:\.[0-9]+)?" + WS + r"*ratings?.*$", "")
    n = F.regexp_replace(n, WS + r"+[0-9]+(?:\.[0-9]+)?" + WS + r"*$", "")
    n = F.regexp_replace(n, WS + r"+[0-9]{5,}", "")
    b = F.coalesce(brand, F.lit(""))
    cut = (b != "") & F.startswith(F.lower(n), F.lower(b))
    n = F.when(cut, strip_text(F.substr(n, F.length(b) + 1))).otherwise(n)
    return squeeze_spaces(n)


def card_name(card_text: Column) -> Column:
    """Name = text before the first rupee sign, minus a leading 'N mins' and a trailing ADD (X11)."""
    before = strip_text(F.substring_index(card_text, "₹", 1))
    no_eta = F.regexp_replace(before, f"(?i)^[0-9]+{WS}*mins?{WS}+", "")
    return strip_text(F.regexp_replace(no_eta, f"{WS}*(ADD|add){WS}*$", ""))


def observed_minutes(text: Column) -> Column:
    """'9 mins' -> 9 (X12); null when absent."""
    return F.nullif(F.regexp_extract(text, f"(?i)([0-9]+){WS}*mins?", 1), F.lit("")).try_cast("int")


def longest(arr: Column) -> Column:
    """Longest non-empty string of an array, first on ties."""
    return F.aggregate(
        arr, F.lit(None).cast("string"),
        lambda acc, x: F.when((F.coalesce(F.length(x), F.lit(0)) > F.coalesce(F.length(acc), F.lit(0))), x)
                        .otherwise(acc))


def brand_guess(name: Column) -> Column:
    """First word when longer than one character and not starting with a digit."""
    first = F.split(strip_text(name), WS + "+").getItem(0)
    return F.when((F.length(first) > 1) & ~first.rlike("^[0-9]"), first).otherwise(F.lit(""))


def bullets_description(bullets: Column) -> Column:
    """The first two bullets, those longer than 5 characters, joined by ' | ' (X16)."""
    two = F.slice(F.transform(bullets, strip_text), 1, 2)
    return F.array_join(F.filter(two, lambda b: F.length(b) > 5), " | ")


def absolute_url(href: Column, host: Column) -> Column:
    """Prefix the host when the link is site-relative."""
    h = F.coalesce(href, F.lit(""))
    return F.when(F.startswith(h, F.lit("/")), F.concat(host, h)).otherwise(h)


def plus_query(q: Column) -> Column:
    """Strip, then whitespace runs -> '+' (X25, used by the link fallback)."""
    return F.regexp_replace(strip_text(q), WS + "+", "+")


def space_replace(q: Column, rep: Column) -> Column:
    """Each single space -> the platform's replacement ('+' or '%20'), as search URLs do."""
    return F.replace(q, F.lit(" "), rep)


def first_json_key(doc: Column, keys: list[str]) -> Column:
    """First non-empty, non-zero value among alternative JSON keys."""
    vals = [F.get_json_object(doc, f"$.{k}") for k in keys]
    return F.coalesce(*[F.when(~v.isin("", "0", "0.0"), v) for v in vals])


def json_brand(doc: Column) -> Column:
    """Brand as an object with a name, or a plain value."""
    obj = F.get_json_object(doc, "$.brand.name")
    plain = F.get_json_object(doc, "$.brand")
    return F.coalesce(obj, F.when(~F.startswith(plain, F.lit("{")), plain))


def is_price_fragment(text: Column, anchored: bool) -> Column:
    """A text that starts with (or contains) rupee sign + digits."""
    pat = f"^{WS}*₹{WS}*[0-9]" if anchored else f"₹{WS}*[0-9]"
    return F.coalesce(text.rlike(pat), F.lit(False))
