"""Captured pages -> raw offers, one pass per page.

Each shop has its strategies in order (``shop_pages.SHOPS``): result cards, flex
cards, the embedded JSON, or the walk from price texts up to the nearest name.
The first strategy that finds offers wins (U2). Pages are read by an Arrow-batched
map, in small chunks of pages, because neither an HTML tree nor the JSON's shape
is known to the engine; everything after it is native. All offers of a page are
returned: a limit is the caller's (``rules.first_n_per_page``). A page that
cannot be parsed, or gives no offers, yields one quarantine row with the reason.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shop_pages as S
from ..reference_data import PLATFORMS
from ..sources.lookups import platform_attr
from .pagetree import Element, Page

RAW_COLUMNS = ["page_id", "search_id", "platform", "pincode", "position", "name", "price", "mrp",
               "brand", "description", "product_url", "observed_mins", "pack", "strategy"]
HOSTS = {p[0]: p[3] for p in PLATFORMS}
#: Offers from which an output chunk is sent on: what one task holds beside the current page.
CHUNK = 2048
Offer = dict
_AMOUNT = re.compile(r"₹\s*([0-9]+(?:\.[0-9]+)?)")
_NUMBER = re.compile(r"[0-9]+(?:\.[0-9]+)?")
_STARTS = re.compile(r"^\s*₹\s*[0-9]")
_HOLDS = re.compile(r"₹\s*[0-9]")
_MINUTES = re.compile(r"([0-9]+)\s*mins?", re.I)


@lru_cache(None)
def _pattern(text: str) -> re.Pattern:
    return re.compile(text, re.I)


def amount(text) -> float | None:
    """First amount of a displayed price, if positive."""
    found = _NUMBER.search(str(text).replace(",", "")) if text is not None else None
    value = float(found.group()) if found else 0.0
    return value if value > 0 else None


def amounts(text: str) -> list[float]:
    return [v for v in map(float, _AMOUNT.findall(text.replace(",", ""))) if v > 0]


def _offer(name: str, price: float, mrp: float | None = None, brand: str = "", description: str = "", link: str = "",
           mins: int | None = None, pack: str = "", at: int = 0) -> Offer:
    """``at``: place of the card, item or price text on its page."""
    return {"at": at, "name": name, "price": price, "mrp": mrp if mrp and mrp > price else 0.0, "brand": brand,
            "description": description, "link": link, "mins": mins, "pack": pack}


def _first_of_each(offers: list[Offer], key: Callable[[Offer], object]) -> list[Offer]:
    kept: dict = {}
    for o in offers:
        kept.setdefault(key(o), o)
    return list(kept.values())


def _has_classes(wanted: list[str]) -> Callable[[Element], bool]:
    return lambda e: set(wanted) <= set(e.classes.split())


# --------------------------------------------------------------------------- links

def _link(page: Page, card: Element, shop: dict) -> str:
    """A product link in the card, else any link in it, else the nearest link around or beside it."""
    if "link" not in shop:
        return ""
    least = shop.get("link_min", 2)

    def local(e: Element | None) -> str:
        href = e.attrs.get("href", "") if e is not None else ""
        return href if href.startswith("/") and len(href) >= least else ""

    wanted = _pattern(shop["link"])
    inside = page.first_inside(card, "product link", lambda e: e.tag == "a" and bool(wanted.search(e.attrs.get("href", ""))))
    found = local(inside or page.first_inside(card, "link", lambda e: e.tag == "a" and bool(e.attrs.get("href"))))
    if found:
        return found
    for node in card.ancestors(shop["link_levels"]):
        if node.tag == "a" and local(node):
            return local(node)
        if shop["link_above"]:
            above = _pattern(shop["link_above"])
            near = page.first_inside(node, "link above", lambda e: e.tag == "a" and bool(above.search(e.attrs.get("href", ""))))
            if near is not None:
                return near.attrs["href"]
    return ""


# --------------------------------------------------------------------------- cards

def result_cards(page: Page, shop: dict) -> list[Offer]:
    """Result cards: longest title span, first shown price, repaired when it is a unit price."""
    shown, whole_of, part_of = (_has_classes([c]) for c in (S.CARD_SHOWN, S.CARD_WHOLE, S.CARD_FRACTION))
    out = []
    for at, card in enumerate(e for e in page.elements if e.attrs.get(S.CARD_ATTRIBUTE) == S.CARD_VALUE):
        title = page.first_inside(card, "h2", lambda e: e.tag == "h2")
        if title is None:
            continue
        spans = [page.text(e, "") for e in page.all_inside(title, "span", lambda e: e.tag == "span")]
        name = max((s for s in spans if s), key=len, default="")
        if len(name) < 4:
            continue
        prices = [page.first_inside(c, "shown", shown) for c in page.all_inside(card, "price box", _has_classes([S.CARD_PRICE]))]
        found = [v for v in (amount(page.text(e, "")) for e in prices if e is not None) if v and v > 1]
        top = max(found, default=0.0)
        if found:
            price = found[0]
            if top > price and price < 0.05 * top:
                price = next(v for v in found if v >= 0.05 * top)
        else:
            whole, part = page.first_inside(card, "whole", whole_of), page.first_inside(card, "fraction", part_of)
            if whole is None:
                continue
            units = page.text(whole, "").replace(",", "").rstrip(". ")
            price = amount(f"{units}.{page.text(part, '') if part is not None else '00'}")
        if not price:
            continue
        link = page.first_inside(title, "title link", lambda e: e.tag == "a" and "href" in e.attrs)
        bullets = page.all_inside(card, "bullet", lambda e: any(_has_classes(c)(e) for c in S.CARD_BULLETS))
        texts = [page.text(b, "") for b in bullets[:2]]
        first = name.split()[0]
        brand = first if len(first) > 1 and not first[0].isdigit() else ""
        out.append(_offer(name, price, top, brand, " | ".join(t for t in texts if len(t) > 5), link.attrs["href"] if link is not None else "", at=at))
    return _first_of_each(out, lambda o: o["name"])


def _name_before_price(text: str) -> str:
    before = re.sub(r"^[0-9]+\s*mins?\s+", "", text.split("₹")[0].strip(), flags=re.I)
    return re.sub(r"\s*(ADD|add)\s*$", "", before).strip()


def flex_cards(page: Page, shop: dict) -> list[Offer]:
    """Flex cards: the name stands before the first price; minutes are read from the card's surroundings."""
    out = []
    for at, card in enumerate(filter(_has_classes(S.FLEX_CLASSES), page.elements)):
        text = page.text(card)
        name, found = _name_before_price(text), amounts(text)
        if "₹" not in text or len(name) < 3 or not found:
            continue
        around = page.text(card.parent) if card.parent is not page.root else text
        minutes = _MINUTES.search(around)
        out.append(_offer(name, found[0], found[1] if len(found) > 1 else None, link=_link(page, card, shop), mins=int(minutes.group(1)) if minutes else None, at=at))
    return _first_of_each(out, lambda o: o["name"])


# --------------------------------------------------------------------------- embedded JSON

def next_data(page: Page) -> object | None:
    holder = next((e for e in page.elements if e.tag == "script" and e.attrs.get("id") == S.NEXT_DATA_ID), None)
    return json.loads(page.text(holder, "")) if holder is not None else None


def product_arrays(document: object, keys: list[str], depth: int) -> list[list]:
    """Arrays whose first item is an object with one of ``keys``, in document order; not those inside such an array."""
    found, todo = [], [(document, 0)]
    while todo:
        node, level = todo.pop()
        if level > depth:
            continue
        if isinstance(node, list) and node and isinstance(node[0], dict) and not node[0].keys().isdisjoint(keys):
            found.append(node)
            continue
        inner = list(node.values()) if isinstance(node, dict) else node if isinstance(node, list) else []
        todo.extend((x, level + 1) for x in reversed(inner))
    return found


def _first_value(item: dict, keys: list[str]) -> object:
    return next((item[k] for k in keys if item.get(k)), "")


def json_items(page: Page, shop: dict) -> list[Offer]:
    """Offers of the longest product array, the first on ties (A10)."""
    rules, document = shop["json"], next_data(page)
    arrays = product_arrays(document, rules["keys"], rules["depth"]) if document is not None else []
    out = []
    for at, item in enumerate(max(arrays, key=len, default=[])):
        if not isinstance(item, dict):
            continue
        name, price = str(_first_value(item, rules["name"])), amount(_first_value(item, rules["price"]))
        if not name or not price:
            continue
        brand = _first_value(item, rules["brand"])
        brand = brand.get("name") or "" if isinstance(brand, dict) else brand
        out.append(_offer(name, price, amount(_first_value(item, rules["mrp"])), str(brand), str(_first_value(item, rules["description"])),
                          str(_first_value(item, rules["url"])), pack=str(_first_value(item, rules["pack"])), at=at))
    return _first_of_each(out, lambda o: o["name"]) if rules["one_per_name"] else out


# --------------------------------------------------------------------------- walk from prices

def _price_elements(page: Page, rules: dict) -> list[tuple[Element, str]]:
    tags, kind = set(rules["tags"]), rules["price"]
    inner = {"span", "div", "p"}
    out = []
    for e in page.elements:
        if e.tag not in tags or e.last_text == e.first_text:
            continue
        if kind == "leaf":
            text = page.text(e, "") if not any(page.elements[k].tag in inner for k in range(e.number + 1, e.end)) else None
        else:
            text = page.only_text(e)
        if text is not None and (_STARTS if kind == "starts" else _HOLDS).search(text):
            out.append((e, text))
    return out


@lru_cache(None)
def _test(tag: str | None, attribute: str | None, pattern: str | None) -> Callable[[Element], bool]:
    match = _pattern(pattern) if pattern else None

    def passes(e: Element) -> bool:
        if tag is not None and e.tag != tag:
            return False
        return attribute is None or (attribute in e.attrs and (match is None or bool(match.search(e.attrs[attribute]))))
    return passes


def clean_listed_name(name: str, brand: str) -> str:
    """Without the rating tail, trailing and long numbers, and a brand run into the name."""
    name = re.sub(r"\s*[0-9]+(\.[0-9]+)?\s*ratings?.*$", "", name, flags=re.I | re.S)
    name = re.sub(r"\s+[0-9]+(\.[0-9]+)?\s*$", "", name)
    name = re.sub(r"\s+[0-9]{5,}", "", name)
    if brand and name.lower().startswith(brand.lower()):
        name = name[len(brand):]
    return " ".join(name.split())


def _name_in(page: Page, card: Element, rules: dict, brand: str) -> str:
    if rules["names"] == "text_before_price":
        return _name_before_price(page.text(card))
    for k, wanted in enumerate(rules["names"]):
        e = page.first_inside(card, f"name {k}", _test(*wanted))
        if e is not None:
            if rules.get("title_first") and e.attrs.get("title"):
                return e.attrs["title"]
            return clean_listed_name(page.text(e), brand) if rules.get("clean_name") else page.text(e, "")
    return ""


def price_walk(page: Page, shop: dict) -> list[Offer]:
    """From each price text up to the nearest element with a name; the last short candidate of a cleaned name is kept (P5)."""
    rules, out = shop["walk"], []
    for at, (element, text) in enumerate(_price_elements(page, rules)):
        price = amount(text)
        if price is None or price < rules["min_price"]:
            continue
        name, brand, mrp, last = "", "", None, element
        for card in element.ancestors(rules["levels"]):
            last = card
            if rules.get("brand") and not brand:
                marked = page.first_inside(card, "brand", _test(None, "class", rules["brand"]))
                brand = page.text(marked, "") if marked is not None else ""
            candidate = _name_in(page, card, rules, brand)
            good = len(candidate) >= rules["min_name"] and not (rules.get("no_rupee") and candidate.startswith("₹"))
            if good or (candidate and rules.get("clean_name")):
                name = candidate
            if good:
                break
            if mrp is None and rules.get("mrp") == "amounts":
                found = amounts(page.text(card))
                mrp = max(found) if len(found) > 1 and max(found) > price else None
            elif mrp is None and rules.get("mrp"):
                struck = page.first_inside(card, "struck", _test(None, "class", rules["mrp"]))
                value = amount(page.text(struck, "")) if struck is not None else None
                mrp = value if value and value > price else None
        if name:
            out.append(_offer(name, price, mrp, brand, link=_link(page, last, shop), at=at))
    return _first_of_each(out, lambda o: (o["name"], o["price"]) if rules.get("key") == "name_price" else o["name"])


STRATEGIES: dict[str, Callable[[Page, dict], list[Offer]]] = {"cards": result_cards, "flex": flex_cards, "json": json_items, "walk": price_walk}


def read_page(html: str, platform: str, only: str | None = None) -> tuple[str, list[Offer]]:
    """(strategy, offers) of the first of the shop's strategies that finds any. A strategy that fails is passed over; if none finds offers, its error is raised."""
    shop = S.SHOPS.get(platform)
    if shop is None:
        raise ValueError(f"unknown platform {platform!r}")
    page, failure = Page(html), None
    for strategy in shop["order"]:
        if only in (None, strategy):
            try:
                offers = STRATEGIES[strategy](page, shop)
            except (ValueError, KeyError, TypeError, AttributeError) as error:
                failure = failure or error
                continue
            if offers:
                return strategy, offers
    if failure is not None:
        raise failure
    return "", []


PAGE_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("search_id", T.LongType()),
    T.StructField("platform", T.StringType()), T.StructField("pincode", T.StringType()),
    T.StructField("position", T.IntegerType()), T.StructField("name", T.StringType()),
    T.StructField("price", T.DoubleType()), T.StructField("mrp", T.DoubleType()),
    T.StructField("brand", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("product_url", T.StringType()), T.StructField("observed_mins", T.IntegerType()),
    T.StructField("pack", T.StringType()), T.StructField("strategy", T.StringType()), T.StructField("error", T.StringType()),
])
_NAMES = [f.name for f in PAGE_SCHEMA.fields]


def _rows_of(head: tuple, html: str | None, only: str | None) -> list[tuple]:
    """A page's rows: its offers, or one with the error."""
    platform = head[2]
    try:
        strategy, offers = read_page(html, platform, only)
        host = HOSTS.get(platform, "")
        rows = [(*head, o["at"], o["name"], o["price"], o["mrp"], o["brand"], o["description"],
                 host + o["link"] if o["link"].startswith("/") else o["link"], o["mins"], o["pack"], strategy, None)
                for o in offers]
        error = "no offers found"
    except Exception as e:  # noqa: BLE001 - E10: one bad page never stops the job
        rows, error = [], f"{type(e).__name__}: {e}"
    return rows or [(*head, *[None] * 10, error)]


def _read_pages(only: str | None):
    def sent(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=_NAMES).astype({"search_id": "Int64", "position": "Int32", "observed_mins": "Int32"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for r in pdf.itertuples(index=False):
                out += _rows_of((r.page_id, r.search_id, r.platform, r.pincode), r.html, only)
                if len(out) >= CHUNK:
                    yield sent(out)
                    out = []
            if out:
                yield sent(out)
    return run


def extract(pages: DataFrame, only: str | None = None) -> DataFrame:
    """One row per offer, or one row with ``error`` for a page without any. ``only`` restricts to one strategy."""
    return pages.select("page_id", "search_id", "platform", "pincode", "html").mapInPandas(_read_pages(only), PAGE_SCHEMA)


def split_quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(offers, quarantine) of ``extract``."""
    return (rows.where(F.col("error").isNull()).select(*RAW_COLUMNS),
            rows.where(F.col("error").isNotNull()).select("page_id", "search_id", "platform", "error"))


NEXT_DATA = r'(?s)<script(?=[^>]*\sid="__NEXT_DATA__")[^>]*>(.*?)</script>'


def active_only(pages: DataFrame) -> DataFrame:
    """Only pages of active platforms."""
    return pages.where(F.coalesce(platform_attr(F.col("platform"), "active"), F.lit(False)))


def to_raw_offers(extracted: DataFrame, captured_at: Column) -> DataFrame:
    """Extracted fields -> the raw-offer shape that ``standardise`` takes (P1 input). A pack text, where the shop
    states one, gives the size (X19)."""
    return extracted.select(
        "search_id", F.col("position").alias("line_no"), F.col("page_id").alias("part_id"), "platform",
        F.col("name"), F.col("price").cast("string").alias("price_text"),
        F.when(F.col("mrp") > 0, F.col("mrp").cast("string")).otherwise(F.lit("")).alias("mrp_text"),
        "brand", "description", F.col("product_url").alias("url"), F.lit(True).alias("in_stock"),
        "pincode", captured_at.alias("captured_at"), F.coalesce("pack", F.lit("")).alias("pack"))
