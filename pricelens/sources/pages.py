"""Captured search pages.

``render_pages`` builds one HTML page per (search, platform) from stored
offers, in the page shape of that platform, so extraction can be checked
against the offers it came from. Each page holds only its own offers (a page
is bounded by one search's results on one platform). ``driver_pages`` reads
the given ``pages`` table (generic web pages) for load and generic extraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

# Page shape per platform (ours): card = result cards, flex = flex cards with
# an ETA line, next = embedded __NEXT_DATA__ JSON, walk and titled = plain markup.
# Every second page of JioMart comes without its JSON, so that the fallback has work.
PAGE_SHAPE = {"Amazon Fresh": "card", "Blinkit": "flex", "BigBasket": "next", "JioMart": "next",
              "Zepto": "walk", "Flipkart": "titled", "Swiggy Instamart": "walk"}


def amount_text(x: Column) -> Column:
    c = F.floor(x * F.lit(100.0) + F.lit(0.5))
    return F.concat(F.floor(c / F.lit(100)).cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))


def _card_html(shape: Column) -> Column:
    name, url, desc = F.col("product_name"), F.col("product_url"), F.col("description")
    price, mrp = amount_text(F.col("price")), amount_text(F.col("mrp"))
    mins = F.col("delivery_mins").cast("string")
    card = F.concat(
        F.lit('<div data-component-type="s-search-result"><h2><a href="'), url, F.lit('"><span>'),
        F.col("brand"), F.lit("</span><span>"), name, F.lit('</span></a></h2><span class="a-price">'
                                                             '<span class="a-offscreen">₹'), price,
        F.lit('</span></span><span class="a-price a-text-price"><span class="a-offscreen">₹'), mrp,
        F.lit('</span></span><ul><li><span class="a-list-item">'), desc,
        F.lit('</span></li></ul></div>'))
    flex = F.concat(
        F.lit('<div class="tw-w-full tw-px-3"><div class="tw-flex tw-w-full tw-flex-col"><div class="eta">'),
        mins, F.lit(' mins</div><div class="name">'), name, F.lit('</div><div class="tw-flex tw-items-center tw-justify-between">₹'), price,
        F.lit(' ₹'), mrp, F.lit(' ADD</div></div></div>'))
    item = F.concat(F.lit('{"name":"'), name, F.lit('","price":'), price, F.lit(',"mrp":'), mrp,
                    F.lit(',"brand":{"name":"'), F.col("brand"), F.lit('"},"url":"'), url,
                    F.lit('","variants":[{"name":"v1","price":1},{"name":"v2","price":2},{"name":"v3","price":3}]}'))
    walk = F.concat(F.lit('<div class="item"><h3 class="product-title">'), name,
                    F.lit('</h3><div><span>₹'), price, F.lit('</span><span class="strike">₹'), mrp,
                    F.lit('</span></div></div>'))
    titled = F.concat(F.lit('<div class="item"><a class="x" title="'), name, F.lit('">link text</a><div><span>₹'), price,
                      F.lit('</span><span class="y dattD_">₹'), mrp, F.lit('</span></div></div>'))
    return (F.when(shape == "titled", titled).when(shape == "card", card).when(shape == "flex", flex).when(shape == "next", item)
             .otherwise(walk))


def render_pages(listings: DataFrame) -> DataFrame:
    """pages(page_id, search_id, platform, query, pincode, html) from listings."""
    shape = F.element_at(F.create_map(*[x for k, v in PAGE_SHAPE.items() for x in (F.lit(k), F.lit(v))]),
                         F.col("platform"))
    shape = F.when((F.col("platform") == "JioMart") & (F.col("search_id") % 2 == 1), F.lit("walk")).otherwise(shape)
    cards = listings.select("search_id", "platform", "pincode", "line_no", "part_id", "price", "mrp",
                            shape.alias("shape"), _card_html(shape).alias("frag"))
    pages = cards.groupBy("search_id", "platform", "pincode", "shape").agg(
        F.sort_array(F.collect_list(F.struct("line_no", "part_id", "price", "mrp", "frag"))).alias("cards"))
    body = F.array_join(F.transform("cards", lambda c: c["frag"]), "")
    html = (F.when(F.col("shape") == "next",
                   F.concat(F.lit('<html><body><div id="app"></div><script id="__NEXT_DATA__" '
                                  'type="application/json">{"props":{"pageProps":{"banner":[{"img":"b.png"}],'
                                  '"listing":{"featured":['), F.col("cards")[0]["frag"], F.lit('],"products":['),
                            F.array_join(F.transform("cards", lambda c: c["frag"]), ","),
                            F.lit(']}}}}</script></body></html>')))
            .otherwise(F.concat(F.lit("<html><body>"), body, F.lit("</body></html>"))))
    return pages.select(
        F.xxhash64("search_id", "platform").alias("page_id"), "search_id", "platform", "pincode",
        "shape", html.alias("html"))


def driver_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")
