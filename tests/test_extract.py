"""Page extraction on hand-written pages: attribute orders, entities, spaces, nesting, fallback, quarantine."""

import json

from pyspark.sql import functions as F

from pricelens.operators import extract as E
from pricelens.operators.pagetree import Page

PAGE_SCHEMA = "page_id long, search_id long, platform string, pincode string, html string"


def _pages(spark, rows):
    return spark.createDataFrame(rows, PAGE_SCHEMA)


def _read(html, platform, only=None):
    return E.read_page(html, platform, only)[1]


def _card(i=0, name="Sea Salt Fine 1 kg", attrs='data-component-type="s-search-result"'):
    return (f'<div {attrs}><h2><a href="/dp/{i}"><span>Sea</span><span>{name}</span></a></h2>'
            '<span class="a-price"><span class="a-offscreen">₹1.20</span></span>'
            '<span class="a-price"><span class="a-offscreen">₹250.00</span></span>'
            '<span class="a-price a-text-price"><span class="a-offscreen">₹280.00</span></span>'
            '<span class="a-list-item">Iodised salt</span></div>')


def test_result_cards_longest_title_sanity_and_dedup():
    offers = _read("<html><body>" + _card() * 2 + "</body></html>", "Amazon Fresh")
    assert len(offers) == 1  # same name twice on one page: first wins
    o = offers[0]
    assert (o["name"], o["price"], o["mrp"], o["brand"], o["description"], o["link"]) == (
        "Sea Salt Fine 1 kg", 250.0, 280.0, "Sea", "Iodised salt", "/dp/0")  # 1.20 is a unit price


def test_cards_by_attribute_in_any_order_with_entities_and_no_cap():
    html = "".join(_card(i, f"Salt &amp; Pepper {i}", f"class='x' data-asin={i} data-component-type=s-search-result") for i in range(40))
    offers = _read(html, "Amazon Fresh")
    assert len(offers) == 40 and offers[39]["name"] == "Salt & Pepper 39" and offers[39]["at"] == 39


def test_whole_fraction_fallback():
    html = ('<div data-component-type="s-search-result"><h2><a href="/x"><span>Oat Biscuits 200 g</span></a></h2>'
            '<span class="a-price-whole">1,299.</span><span class="a-price-fraction">50</span></div>')
    assert _read(html, "Amazon Fresh")[0]["price"] == 1299.5


def test_flex_cards_by_class_set_links_around_and_minutes_beside():
    html = ('<a href="/prn/milk/prid/7"><div class="outer">9 mins<div class="tw-flex-col z tw-w-full tw-flex">'
            '<div>Whole Milk&nbsp;500 ml</div><div>₹27 ₹29 ADD</div></div></div></a>')
    o = _read(html, "Blinkit")[0]
    assert (o["name"], o["price"], o["mrp"], o["mins"], o["link"]) == ("Whole Milk 500 ml", 27.0, 29.0, 9, "/prn/milk/prid/7")


def test_flex_falls_back_to_the_walk():
    strategy, offers = E.read_page('<div><div>Round Bread 400 g</div><span>₹ 45</span></div>', "Blinkit")
    assert strategy == "walk" and offers[0]["name"] == "Round Bread 400 g"


def _next(doc, attrs='type="application/json" id="__NEXT_DATA__"'):
    return f"<html><script {attrs}>{json.dumps(doc)}</script></html>"


def test_json_longest_outer_array_keys_brand_pack_and_description():
    doc = {"a": [{"name": "Only one", "price": 5}],
           "b": {"items": [{"product_name": "Milk 1 L", "sp": "60", "market_price": "66", "brand": {"name": "Farm"}, "desc": "Fresh", "w": "1 L",
                            "variants": [{"name": "x", "price": 1}] * 5},
                           {"name": "Curd 400 g", "price": "35", "brand": "Hill", "absolute_url": "/pd/2"}]}}
    offers = _read(_next(doc), "BigBasket")
    assert [(o["name"], o["price"], o["mrp"], o["brand"], o["description"], o["pack"], o["link"]) for o in offers] == [
        ("Milk 1 L", 60.0, 66.0, "Farm", "Fresh", "1 L", ""), ("Curd 400 g", 35.0, 0.0, "Hill", "", "", "/pd/2")]


def test_json_of_the_shop_that_keeps_one_offer_per_name():
    items = [{"productName": "Flour 5 kg", "discountedSellingPrice": 210, "mrp": 250, "brandName": "Mill", "urlKey": "/pn/flour"},
             {"productName": "Flour 5 kg", "sellingPrice": 220}]
    deep = {"k": items}
    for _ in range(12):
        deep = {"k": deep}
    strategy, offers = E.read_page(_next(deep), "Zepto")
    assert strategy == "json" and [(o["name"], o["price"], o["mrp"], o["brand"], o["link"]) for o in offers] == [("Flour 5 kg", 210.0, 250.0, "Mill", "/pn/flour")]
    assert _read(_next(deep), "BigBasket") == []  # two levels too deep for that shop


def test_json_returns_every_item():
    assert len(_read(_next([{"name": f"Item {i}", "price": 10 + i} for i in range(90)]), "JioMart")) == 90


def test_walk_cleans_names_keeps_prices_apart_and_finds_links_above():
    def card(price):
        return (f'<a href="/pd/9"><div><span class="Brand">Dale</span><h3>DaleGold Oil 1 L 4.1 Ratings 1234</h3>'
                f'<div><p>₹{price}</p></div></div></a>')
    offers = _read(card(150) + card(170) + card(150), "BigBasket")
    assert [(o["name"], o["price"], o["brand"], o["link"]) for o in offers] == [("Gold Oil 1 L", 150.0, "Dale", "/pd/9"), ("Gold Oil 1 L", 170.0, "Dale", "/pd/9")]


def test_walk_reads_nested_price_texts_and_test_ids():
    html = ('<div class="c"><a href="/other"></a><div data-testid="product-name">Basmati Rice 1 kg</div><a href="/pn/rice">see</a>'
            '<div><p>Price <b>₹</b>99</p><p>₹ 120</p></div></div>')
    o = _read(html, "Zepto")[0]
    assert (o["name"], o["price"], o["mrp"], o["link"]) == ("Basmati Rice 1 kg", 99.0, 120.0, "/pn/rice")


def test_walk_titles_and_struck_prices():
    html = '<div><a class="q" title="Green Tea 100 g">Green...</a><div><div class="pr">₹149</div><div class="yR dattD_">₹199</div></div></div>'
    o = _read(html, "Flipkart")[0]
    assert (o["name"], o["price"], o["mrp"]) == ("Green Tea 100 g", 149.0, 199.0)


def test_tree_survives_broken_markup():
    page = Page("<div><p>a<p>b</div></span><div>c<br>d")
    assert page.pieces == ["a", "b", "c", "d"] and page.text(page.elements[0]) == "a b"


def test_quarantine_holds_every_page_without_offers(spark):
    pages = _pages(spark, [(1, 1, "Zepto", "", '<div><h3>Corn Oil 1 L</h3><div><span>₹150</span></div></div>'),
                           (2, 1, "Flipkart", "", "<p>No prices</p>"), (3, 1, "JioMart", "", '<script id="__NEXT_DATA__">{bad</script>'),
                           (4, 1, "Nowhere", "", ""), (5, None, "Amazon Fresh", None, None)])
    offers, bad = E.split_quarantine(E.extract(pages))
    assert [(r.page_id, r.name, r.strategy) for r in offers.collect()] == [(1, "Corn Oil 1 L", "walk")]
    errors = {r.page_id: r.error for r in bad.collect()}
    assert errors[2] == errors[5] == "no offers found" and errors[3].startswith("JSONDecodeError") and "Nowhere" in errors[4]


def test_pages_are_read_once(spark):
    plan = E.extract(_pages(spark, [(1, 1, "Zepto", "", "")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1


def test_active_platforms_only(spark):
    pages = _pages(spark, [(1, 1, "Amazon Fresh", "", ""), (2, 1, "Flipkart", "", ""), (3, 1, "JioMart", "", "")])
    assert {r.platform for r in E.active_only(pages).collect()} == {"Amazon Fresh"}


def test_to_raw_offers_feeds_standardise_and_packs_give_the_size(spark):
    from pricelens.operators.standardise import standardise
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    flex = '<div class="tw-flex tw-w-full tw-flex-col"><div>Butter 100 g</div><div>₹56 ₹60 ADD</div></div>'
    packed = _next([{"name": "Butter slab", "sp": 100, "w": "2 x 200 g pack"}])
    offers, _ = E.split_quarantine(E.extract(_pages(spark, [(7, 1, "Blinkit", "110001", flex), (8, 1, "BigBasket", "110001", packed)])))
    rows = {r.product_name: r for r in standardise(E.to_raw_offers(offers, at)).collect()}
    r = rows["Butter 100 g"]
    assert (r.size_label, r.price_per_unit, r.unit_norm, r.discount_pct) == ("100g", 56.0, "per 100g", 6.7)
    r = rows["Butter slab"]
    assert (r.size_label, r.quantity, r.unit, r.price_per_unit) == ("2 x 200 g pack", "200", "g", 50.0)


def test_progress_observation(spark):
    from pricelens.operators.analytics import with_progress
    df = spark.createDataFrame([("Blinkit",), ("Zepto",), ("Zepto",)], "platform string")
    observed, obs = with_progress(df)
    observed.collect()
    assert obs.get["rows"] == 3 and obs.get["Zepto"] == 2


def test_plain_tags_give_the_tree_that_the_general_parser_gives(monkeypatch):
    import random
    import re
    from pricelens.operators import pagetree
    bits = ['<div class="a b">', "</div>", "<DIV CLASS=x>", '<a href="/pd/1?x=1&amp;y=2" title=\'q\'>', "</a>", "<br>", "<br/>", '<script id="s">{"a":"</div>"}', "</script>",
            '<textarea n="x">', "</textarea>", "<title>", "</title>", "₹ 12", " a &nbsp;b", '<p  class="n"\n id="z" >', "</p >", "<!-- c -->", '<span class="">', "</span>", '<div a="1"b="2">',
            '<div a="1" a="2">', "< b", "&", '<div a="1>2">', '<titles a="1">', "</titles>", '<img src="x">', '<div a="b" c>', "</>", "<plaintext>", "<x-y>"]
    rnd = random.Random(3)
    pages = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 20))) for _ in range(2000)]

    def tree(html):
        page = Page(html)
        return page.pieces, [(e.tag, e.attrs, e.parent.number, e.end, e.first_text, e.last_text, e.children, page.only_text(e)) for e in page.elements]
    plain = [tree(h) for h in pages]
    for name in ("_PLAIN_START", "_PLAIN_END"):
        monkeypatch.setattr(pagetree, name, re.compile("(?!)"))
    assert plain == [tree(h) for h in pages]


def test_output_chunks_are_cut_by_offers_not_by_pages():
    import pandas as pd
    page = '<div><a class="q" title="Green Tea {}">Green</a><div><div>₹149</div></div></div>'
    rows = [(k, k, "Flipkart", "400001", page.format(k) if k % 50 else None) for k in range(3000)]
    pages = pd.DataFrame(rows, columns=["page_id", "search_id", "platform", "pincode", "html"])
    out = list(E._read_pages(None)(iter([pages[:1000], pages[1000:]])))
    assert [len(f) for f in out] == [1000, 2000]
    found = pd.concat(out)
    assert list(found.page_id) == list(range(3000)) and list(found.error[:2])[0] == "no offers found" and list(found.name)[1] == "Green Tea 1"
