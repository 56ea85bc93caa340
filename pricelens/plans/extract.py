"""Catalogue: page extraction (E1-E11, S6, S7) and the per-card text rules
(X10-X21, P12, P16, A16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as X
from ..operators import extract as E
from ..reference_data import PLATFORM_NAMES
from ..sources.pages import driver_pages, render_pages
from . import domain
from .registry import query
from .sql_common import with_base

OUT = ["search_id", "platform", "position", "name", "price", "mrp", "brand", "description",
       "product_url", "observed_mins"]
_OUT_SQL = ", ".join(OUT)
_PAGE_ORDER = "ORDER BY line_no, part_id, price, mrp"


def _pages(spark, sf):
    return render_pages(domain.listings(spark, sf))


def _brand_guess_sql(x: str) -> str:
    w = f"split_part(trim({x}), ' ', 1)"
    return f"(CASE WHEN length({w}) > 1 AND NOT regexp_matches({w}, '^[0-9]') THEN {w} ELSE '' END)"


def _offers(spark, sf, *platforms, only=None):
    pages = _pages(spark, sf).where(F.col("platform").isin(*platforms))
    offers, _ = E.split_quarantine(E.extract(pages, only))
    return offers.select(*OUT)


@query("extract_cards", with_base(f"""
, am AS (SELECT *, row_number() OVER (PARTITION BY search_id, platform {_PAGE_ORDER}) - 1 AS position
         FROM listings WHERE platform = 'Amazon Fresh'),
am2 AS (SELECT search_id, platform, position,
          CASE WHEN length(product_name) > length(brand) THEN product_name ELSE brand END AS name,
          price, CASE WHEN mrp > price THEN mrp ELSE 0.0 END AS mrp,
          CASE WHEN length(description) > 5 THEN description ELSE '' END AS description,
          product_url, CAST(NULL AS INTEGER) AS observed_mins FROM am),
am3 AS (SELECT *, {_brand_guess_sql('name')} AS brand FROM am2 WHERE length(name) >= 4),
bl AS (SELECT *, row_number() OVER (PARTITION BY search_id, platform {_PAGE_ORDER}) - 1 AS position
       FROM listings WHERE platform = 'Blinkit'),
bl2 AS (SELECT search_id, platform, position, product_name AS name, price,
          CASE WHEN mrp > price THEN mrp ELSE 0.0 END AS mrp, '' AS brand, '' AS description, '' AS product_url,
          delivery_mins AS observed_mins FROM bl WHERE length(product_name) >= 3),
u AS (SELECT {_OUT_SQL} FROM am3 UNION ALL SELECT {_OUT_SQL} FROM bl2)
SELECT {_OUT_SQL.replace("position", "CAST(position AS INTEGER) AS position")} FROM (
  SELECT *, row_number() OVER (PARTITION BY search_id, platform, name ORDER BY position) AS rn FROM u)
WHERE rn = 1""".replace("\n, am AS", ", am AS")))
def extract_cards(spark, sf):
    return _offers(spark, sf, "Amazon Fresh", "Blinkit")


@query("extract_next_data", with_base(f"""
, nd AS (SELECT *, row_number() OVER (PARTITION BY search_id, platform {_PAGE_ORDER}) - 1 AS position
         FROM listings WHERE platform = 'BigBasket' OR (platform = 'JioMart' AND search_id % 2 = 0))
SELECT search_id, platform, CAST(position AS INTEGER) AS position, product_name AS name, price,
       CASE WHEN mrp > price AND platform = 'BigBasket' THEN mrp ELSE 0.0 END AS mrp, brand, '' AS description,
       CASE platform WHEN 'BigBasket' THEN product_url ELSE '' END AS product_url,
       CAST(NULL AS INTEGER) AS observed_mins
FROM nd""".replace("\n, nd AS", ", nd AS")))
def extract_next_data(spark, sf):
    # Featured items and variants are arrays too; the longest outer array is the page's offers (A10).
    return _offers(spark, sf, "BigBasket", "JioMart", only="json")


_WALK_SQL = f"""
, pw AS (SELECT *, row_number() OVER (PARTITION BY search_id, platform {_PAGE_ORDER}) - 1 AS card_no
         FROM listings WHERE platform IN ('Zepto', 'Flipkart', 'Swiggy Instamart') OR (platform = 'JioMart' AND search_id % 2 = 1)),
pw2 AS (SELECT *, row_number() OVER (PARTITION BY search_id, platform, product_name ORDER BY card_no) AS rn
        FROM pw WHERE price >= 1 OR platform = 'JioMart')"""


@query("extract_price_walk", with_base(_WALK_SQL + """
SELECT search_id, platform, CAST(2 * card_no AS INTEGER) AS position, product_name AS name, price,
       CASE WHEN mrp > price AND platform <> 'JioMart' THEN mrp ELSE 0.0 END AS mrp, '' AS brand, '' AS description, '' AS product_url,
       CAST(NULL AS INTEGER) AS observed_mins
FROM pw2 WHERE rn = 1""".replace("\n, pw AS", ", pw AS")))
def extract_price_walk(spark, sf):
    return _offers(spark, sf, "Zepto", "Flipkart", "Swiggy Instamart", "JioMart", only="walk")


@query("parser_fallback", with_base("""
SELECT search_id, platform, CASE WHEN platform = 'BigBasket' OR search_id % 2 = 0 THEN 'json' ELSE 'walk' END AS strategy,
       CASE WHEN platform = 'BigBasket' OR search_id % 2 = 0 THEN count(*) ELSE count(DISTINCT product_name) END AS n_offers
FROM listings WHERE platform IN ('BigBasket', 'JioMart') GROUP BY search_id, platform"""))
def parser_fallback(spark, sf):
    # Shops with an embedded JSON: the walk takes over on pages that come without it.
    pages = _pages(spark, sf).where(F.col("platform").isin("BigBasket", "JioMart"))
    offers, _ = E.split_quarantine(E.extract(pages))
    return offers.groupBy("search_id", "platform", "strategy").agg(F.count(F.lit(1)).alias("n_offers"))


def _platform_of_page(page_id):
    names = F.array(*[F.lit(p) for p in PLATFORM_NAMES])
    return F.element_at(names, (F.pmod(page_id, F.lit(len(PLATFORM_NAMES))) + 1).cast("int"))


@query("extract_quarantine", f"""
WITH names(i, platform) AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{p}')" for i, p in enumerate(PLATFORM_NAMES))}))
SELECT p.page_id, n.platform, 'no offers found' AS error
FROM pages p JOIN names n ON n.i = p.page_id % {len(PLATFORM_NAMES)}
WHERE NOT regexp_matches(p.html, '₹')""")
def extract_quarantine(spark, sf):
    # The given web pages carry no offers: every page must land in quarantine with a reason.
    pages = driver_pages(spark, sf).select(
        "page_id", F.lit(None).cast("long").alias("search_id"), _platform_of_page(F.col("page_id")).alias("platform"),
        F.lit("").alias("pincode"), "html")
    _, quarantine = E.split_quarantine(E.extract(pages))
    return quarantine.select("page_id", "platform", "error")


@query("next_data_json", """
SELECT page_id, length(regexp_extract(html, '<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)) AS json_chars,
       length(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS text_chars
FROM pages""")
def next_data_json(spark, sf):
    # S7 on the given web pages: the embedded-JSON body (empty when absent) and the text size.
    p = driver_pages(spark, sf)
    return p.select("page_id",
                    F.length(F.regexp_extract("html", E.NEXT_DATA, 1)).alias("json_chars"),
                    F.length(F.regexp_replace("html", "<[^>]+>", " ")).alias("text_chars"))


# --------------------------------------------------------------------------- per-card text rules

_CARD_TEXT = "(CAST(delivery_mins AS VARCHAR) || ' mins ' || product_name || ' ₹' || {p} || ' ₹' || {m} || ' ADD')"


def _amt(x: str) -> str:
    c = f"CAST(floor({x} * 100.0 + 0.5) AS BIGINT)"
    return f"(CAST({c} // 100 AS VARCHAR) || '.' || lpad(CAST({c} % 100 AS VARCHAR), 2, '0'))"


def _card_text_col():
    from ..sources.pages import amount_text
    return F.concat(F.col("delivery_mins").cast("string"), F.lit(" mins "), F.col("product_name"), F.lit(" ₹"),
                    amount_text(F.col("price")), F.lit(" ₹"), amount_text(F.col("mrp")), F.lit(" ADD"))


@query("card_text_fields", with_base(f"""
SELECT search_id, line_no, part_id, {_CARD_TEXT.format(p=_amt('price'), m=_amt('mrp'))} AS card_text,
       product_name AS card_name, delivery_mins AS observed_mins, price AS first_amount, mrp AS second_amount
FROM listings"""))
def card_text_fields(spark, sf):
    lst = domain.listings(spark, sf).withColumn("card_text", _card_text_col())
    found = X.amounts(F.col("card_text"))
    return lst.select("search_id", "line_no", "part_id", "card_text", X.card_name(F.col("card_text")).alias("card_name"),
                      X.observed_minutes(F.col("card_text")).alias("observed_mins"),
                      found[0].alias("first_amount"), found[1].alias("second_amount"))


@query("price_fragments", with_base(f"""
, t AS (SELECT search_id, line_no, part_id, {_CARD_TEXT.format(p=_amt('price'), m=_amt('mrp'))} AS card_text FROM listings),
f AS (SELECT search_id, line_no, part_id, unnest(generate_series(0, len(string_split(card_text, ' ')) - 1)) AS pos,
             card_text FROM t)
SELECT search_id, line_no, part_id, CAST(pos AS INTEGER) AS pos, string_split(card_text, ' ')[pos + 1] AS fragment
FROM f WHERE regexp_matches(string_split(card_text, ' ')[pos + 1], '^\\s*₹\\s*[0-9]')""".replace("\n, t AS", ", t AS")))
def price_fragments(spark, sf):
    lst = domain.listings(spark, sf).withColumn("card_text", _card_text_col())
    frags = lst.select("search_id", "line_no", "part_id", F.posexplode(F.split("card_text", " ")).alias("pos", "fragment"))
    return frags.where(X.is_price_fragment(F.col("fragment"), anchored=True))


@query("clean_product_name", with_base(r"""
, r AS (SELECT search_id, line_no, part_id, brand,
               replace(brand, 'Brand#', 'B') || product_name || ' ' || CAST(line_no AS VARCHAR) || '.' ||
               CAST(part_id % 10 AS VARCHAR) || ' Ratings ' || CAST(part_id AS VARCHAR) || '00000' AS raw_name,
               replace(brand, 'Brand#', 'B') AS short_brand FROM listings),
c1 AS (SELECT *, regexp_replace(raw_name, '(?is)[ \t\n\x0B\f\r]*[0-9]+(?:\.[0-9]+)?[ \t\n\x0B\f\r]*ratings?.*$', '') AS n1 FROM r),
c2 AS (SELECT *, regexp_replace(regexp_replace(n1, '[ \t\n\x0B\f\r]+[0-9]+(?:\.[0-9]+)?[ \t\n\x0B\f\r]*$', ''),
                                '[ \t\n\x0B\f\r]+[0-9]{5,}', '', 'g') AS n2 FROM c1),
c3 AS (SELECT *, CASE WHEN short_brand <> '' AND starts_with(lower(n2), lower(short_brand))
                      THEN trim(substring(n2, length(short_brand) + 1), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))
                      ELSE n2 END AS n3 FROM c2)
SELECT search_id, line_no, part_id, raw_name,
       trim(regexp_replace(n3, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS clean_name
FROM c3""".replace("\n, r AS", ", r AS")))
def clean_product_name(spark, sf):
    lst = domain.listings(spark, sf)
    short = F.replace(F.col("brand"), F.lit("Brand#"), F.lit("B"))
    raw = F.concat(short, F.col("product_name"), F.lit(" "), F.col("line_no").cast("string"), F.lit("."),
                   (F.col("part_id") % 10).cast("string"), F.lit(" Ratings "), F.col("part_id").cast("string"),
                   F.lit("00000"))
    return lst.select("search_id", "line_no", "part_id", raw.alias("raw_name"),
                      X.clean_product_name(raw, short).alias("clean_name"))


@query("brand_and_bullets", with_base(f"""
SELECT search_id, line_no, part_id,
       CASE WHEN length(product_name) > length(brand) THEN product_name ELSE brand END AS title,
       {_brand_guess_sql('product_name')} AS brand_guess,
       array_to_string(list_filter([description, 'Pack ' || size_label], lambda x: length(x) > 5), ' | ') AS description_text
FROM listings"""))
def brand_and_bullets(spark, sf):
    lst = domain.listings(spark, sf)
    bullets = F.array(F.col("description"), F.concat(F.lit("Pack "), F.col("size_label")), F.lit("third bullet"))
    return lst.select("search_id", "line_no", "part_id",
                      X.longest(F.array(F.col("brand"), F.col("product_name"))).alias("title"),
                      X.brand_guess(F.col("product_name")).alias("brand_guess"),
                      X.bullets_description(bullets).alias("description_text"))


@query("sanity_price", with_base(f"""
, f AS (SELECT search_id, line_no, part_id, price, mrp,
               [price_per_unit, price, mrp] AS found FROM listings)
SELECT search_id, line_no, part_id, found[1] AS first_price,
       CASE WHEN len(found) >= 2 AND list_max(found) > found[1] THEN list_max(found) END AS card_mrp,
       CASE WHEN (CASE WHEN len(found) >= 2 AND list_max(found) > found[1] THEN list_max(found) END) IS NOT NULL
             AND found[1] < list_max(found) * 0.05
            THEN coalesce(list_filter(found, lambda x: x >= list_max(found) * 0.05)[1], list_max(found))
            ELSE found[1] END AS repaired_price
FROM f""".replace("\n, f AS", ", f AS")))
def sanity_price(spark, sf):
    # A per-unit price rendered first (the trap P12 repairs), then price and MRP.
    lst = domain.listings(spark, sf)
    found = F.array("price_per_unit", "price", "mrp")
    first = found[0]
    mrp = X.card_mrp(first, found)
    return lst.select("search_id", "line_no", "part_id", first.alias("first_price"), mrp.alias("card_mrp"),
                      F.when(mrp.isNotNull(), X.sanity_price(first, mrp, found)).otherwise(first)
                      .alias("repaired_price"))


@query("first_key_json", with_base(f"""
SELECT search_id, line_no, part_id,
       coalesce(CASE WHEN product_name NOT IN ('', '0', '0.0') THEN product_name END) AS name,
       {_amt('price')} AS price_text, brand AS brand_name
FROM listings"""))
def first_key_json(spark, sf):
    # Alternative keys per record: empty 'name', real 'display_name'; brand as object or text.
    from ..sources.pages import amount_text
    lst = domain.listings(spark, sf)
    doc = F.concat(F.lit('{"name":"","display_name":"'), F.col("product_name"), F.lit('","sp":"0","price":"'),
                   amount_text(F.col("price")), F.lit('","brand":'),
                   F.when(F.col("line_no") % 2 == 0, F.concat(F.lit('{"name":"'), F.col("brand"), F.lit('"}')))
                    .otherwise(F.concat(F.lit('"'), F.col("brand"), F.lit('"'))), F.lit("}"))
    return lst.select("search_id", "line_no", "part_id",
                      X.first_json_key(doc, ["name", "product_name", "display_name"]).alias("name"),
                      X.first_json_key(doc, ["sp", "price"]).alias("price_text"),
                      X.json_brand(doc).alias("brand_name"))
