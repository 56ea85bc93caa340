"""How each shop's pages mark products. Selectors, keys, limits of the walk and link
patterns must equal the shops' markup; the parsing is in ``operators/extract.py``."""

from __future__ import annotations

# (tag or None, attribute, pattern or None): an element of that tag whose attribute matches.
HEADINGS_432 = [("h4", None, None), ("h3", None, None), ("h2", None, None)]
HEADINGS_32 = [("h3", None, None), ("h2", None, None)]

SHOPS: dict[str, dict] = {
    "Amazon Fresh": {
        "order": ["cards"],
    },
    "Blinkit": {
        "order": ["flex", "walk"],
        "link": r"^/(prn|pn)/", "link_levels": 6, "link_above": r"^/(prn|pn)/",
        "walk": {"tags": ["span", "div"], "price": "starts", "levels": 5, "names": "text_before_price", "min_name": 5, "min_price": 0.0},
    },
    "BigBasket": {
        "order": ["json", "walk"],
        "json": {
            "depth": 12, "keys": ["sp", "selling_price", "mrp", "desc", "product_name", "name"],
            "name": ["product_name", "name"], "price": ["sp", "selling_price", "price"],
            "mrp": ["mrp", "market_price", "original_price"], "brand": ["brand"], "description": ["desc", "description"],
            "url": ["absolute_url", "url"], "pack": ["w", "pack_desc"], "one_per_name": False,
        },
        "link": r"^/pd/", "link_levels": 4, "link_above": None,
        "walk": {
            "tags": ["span", "div", "p", "strong"], "price": "starts", "levels": 8,
            "names": [*HEADINGS_32, (None, "class", r"name|title|prod")],
            "min_name": 5, "min_price": 1.0, "brand": r"brand", "clean_name": True, "key": "name_price",
        },
    },
    "Zepto": {
        "order": ["walk", "json"],
        "json": {
            "depth": 14, "keys": ["price", "mrp", "name", "productName", "product_name", "sellingPrice", "discountedSellingPrice", "display_name"],
            "name": ["name", "product_name", "productName", "display_name"],
            "price": ["discountedSellingPrice", "sellingPrice", "price", "mrp", "selling_price"],
            "mrp": ["mrp", "market_price"], "brand": ["brand", "brandName"], "description": [],
            "url": ["urlKey", "url_key", "slug", "productUrl", "product_url"], "pack": [], "one_per_name": True,
        },
        "link": r"/(pn|cn|pd)/", "link_levels": 6, "link_above": r"/(pn|cn)/", "link_min": 4,
        "walk": {
            "tags": ["span", "div", "p"], "price": "leaf", "levels": 12,
            "names": [*HEADINGS_432, (None, "data-testid", r"name|title|product"), (None, "class", r"name|title|product|item")],
            "min_name": 4, "min_price": 1.0, "no_rupee": True, "mrp": "amounts",
        },
    },
    "Flipkart": {
        "order": ["walk"],
        "walk": {
            "tags": ["div", "span"], "price": "holds", "levels": 10,
            "names": [("a", "title", None), ("div", "class", r"_4rR01T|IRpwTa|_2WkVRV|KzDlHZ|wjcEIp"),
                      ("span", "class", r"_4rR01T|IRpwTa|_2WkVRV"), ("a", "class", r"s1Q9rs|IRpwTa")],
            "title_first": True, "min_name": 5, "min_price": 1.0, "mrp": r"_3I9_wc|_3Ay6Sb|dattD_",
        },
    },
    "Swiggy Instamart": {
        "order": ["walk"],
        "walk": {
            "tags": ["span", "div", "p"], "price": "holds", "levels": 10, "names": [*HEADINGS_432, (None, "class", r"name|title|product")],
            "min_name": 4, "min_price": 1.0, "mrp": "amounts",
        },
    },
    "JioMart": {
        "order": ["json", "walk"],
        "json": {
            "depth": 12, "keys": ["price", "sp", "selling_price", "name", "product_name", "title"],
            "name": ["name", "product_name", "title"], "price": ["price", "sp", "selling_price", "discounted_price"],
            "mrp": [], "brand": ["brand"], "description": ["description", "short_description"], "url": [], "pack": [], "one_per_name": False,
        },
        "walk": {
            "tags": ["span", "div", "p", "strong"], "price": "holds", "levels": 8,
            "names": [("p", "class", r"name|title|desc"), *HEADINGS_32, ("a", "title", None)],
            "min_name": 5, "min_price": 0.0,
        },
    },
}

# Result cards and flex cards.
CARD_ATTRIBUTE, CARD_VALUE = "data-component-type", "s-search-result"
CARD_PRICE, CARD_SHOWN, CARD_WHOLE, CARD_FRACTION = "a-price", "a-offscreen", "a-price-whole", "a-price-fraction"
CARD_BULLETS = [["a-list-item"], ["a-size-base", "a-color-base"]]
FLEX_CLASSES = ["tw-flex", "tw-w-full", "tw-flex-col"]
NEXT_DATA_ID = "__NEXT_DATA__"
