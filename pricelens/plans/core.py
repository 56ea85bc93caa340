"""Catalogue: listing build, scalar rules, lookups, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as X
from ..operators.ranking import best_deals
from ..sources import raw_offers, searches
from ..reference_data import DEFAULT_LOCATION, INSTAMART_DEFAULT, INSTAMART_LOCATIONS, LOCATIONS, PLATFORMS
from ..sources.lookups import city_of, delivery_minutes, location_of, platform_attr
from . import domain
from .registry import query
from .sql_common import (COUNT_RE, SIZE_RE, canon_unit_sql, clean_price_sql, rhu, strip_sql,
                         unit_norm_sql, with_base)

LISTING_COLS = ("search_id, line_no, part_id, platform, product_name, price, brand, description, "
                "source, scraped_at, mrp, discount_pct, quantity, unit, size_label, price_per_unit, "
                "unit_norm, delivery_mins, in_stock, pincode, product_url")


@query("standardise_listings", with_base(f"SELECT {LISTING_COLS} FROM listings"))
def standardise_listings(spark, sf):
    return domain.listings(spark, sf)


@query("clean_price", with_base(f"""
SELECT search_id, line_no, part_id, price_text, mrp_text,
       {clean_price_sql('price_text')} AS price, {clean_price_sql('mrp_text')} AS mrp_found,
       CASE WHEN TRY_CAST(regexp_replace(replace(price_text, ',', ''), '[^0-9.]', '', 'g') AS DOUBLE) > 0
            THEN TRY_CAST(regexp_replace(replace(price_text, ',', ''), '[^0-9.]', '', 'g') AS DOUBLE)
       END AS price_strip_rule
FROM raw_offers"""))
def clean_price_q(spark, sf):
    r = raw_offers(spark, sf)
    return r.select("search_id", "line_no", "part_id", "price_text", "mrp_text",
                    X.clean_price(F.col("price_text")).alias("price"),
                    X.clean_price(F.col("mrp_text")).alias("mrp_found"),
                    X.clean_price(F.col("price_text"), "strip").alias("price_strip_rule"))


def _names(spark, sf):
    """Distinct stripped offer names (size rules are a function of the name only)."""
    return (raw_offers(spark, sf).select(X.clean_text(F.col("name")).alias("product_name"))
            .distinct())


_STRIPPED_NAME = strip_sql("coalesce(name, '')")
_NAMES_SQL = f"SELECT DISTINCT substring({_STRIPPED_NAME}, 1, 120) AS product_name FROM raw_offers"


@query("extract_size", with_base(f"""
, n AS ({_NAMES_SQL}),
m AS (SELECT product_name, regexp_extract(product_name, '{SIZE_RE}', 1) AS sq,
             {canon_unit_sql(f"regexp_extract(product_name, '{SIZE_RE}', 2)")} AS su,
             regexp_extract(product_name, '{COUNT_RE}', 1) AS cq FROM n)
SELECT product_name,
       CASE WHEN sq <> '' THEN sq WHEN cq <> '' THEN cq ELSE '1' END AS quantity,
       CASE WHEN sq <> '' THEN su ELSE 'pcs' END AS unit,
       CASE WHEN sq <> '' THEN sq || su WHEN cq <> '' THEN cq || ' pcs' ELSE '' END AS size_label
FROM m""".replace("\n, n AS", ", n AS")))
def extract_size_q(spark, sf):
    s = X.extract_size(F.col("product_name"))
    return _names(spark, sf).select("product_name", s.quantity.alias("quantity"),
                                    s.unit.alias("unit"), s.size_label.alias("size_label"))


_EXT_UNIT = r"(kg|grams?|gms?|g|litres?|liters?|lit|l|ml)"
_NB = r"(?:^|[^0-9A-Za-z_])"
_NA = r"(?:[^0-9A-Za-z_]|$)"
_MULTI = r"(?i)" + _NB + r"([0-9]+)\s*[x×]\s*([0-9]+(?:\.[0-9]+)?)\s*" + _EXT_UNIT + _NA
_HALF = r"(?i)" + _NB + r"(?:half|1/2)\s*" + _EXT_UNIT + _NA
_HALF_DOZEN = r"(?i)" + _NB + r"half\s+dozen" + _NA
_DOZEN = r"(?i)" + _NB + r"([0-9]+)\s*dozens?" + _NA
_PACK = r"(?i)pack\s+of\s+([0-9]+)"


def _base_q(q: str, u: str) -> tuple[str, str]:
    return (f"(CASE WHEN {u} IN ('kg','l') THEN {q} * 1000.0 ELSE {q} END)",
            f"(CASE WHEN {u} = 'kg' THEN 'g' WHEN {u} = 'l' THEN 'ml' ELSE {u} END)")


def _num_txt(x: str) -> str:
    return (f"(CASE WHEN {x} = floor({x}) THEN CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR) "
            f"ELSE regexp_replace(printf('%.3f', {x}), '\\.?0+$', '') END)")


def _ext_sql() -> str:
    mq, mu = _base_q("(TRY_CAST(mn AS DOUBLE) * TRY_CAST(mq AS DOUBLE))", "mu")
    hq, hu_ = _base_q("0.5", "hu")
    sq, su = _base_q("TRY_CAST(sq AS DOUBLE)", "su")
    return with_base(f"""
, n AS ({_NAMES_SQL}),
m AS (
  SELECT product_name,
    regexp_extract(product_name, '{_MULTI}', 1) AS mn, regexp_extract(product_name, '{_MULTI}', 2) AS mq,
    {canon_unit_sql(f"regexp_extract(product_name, '{_MULTI}', 3)")} AS mu,
    regexp_matches(product_name, '{_HALF}') AS hh,
    {canon_unit_sql(f"regexp_extract(product_name, '{_HALF}', 1)")} AS hu,
    regexp_matches(product_name, '{_HALF_DOZEN}') AS hd,
    regexp_extract(product_name, '{_DOZEN}', 1) AS dz,
    regexp_extract(product_name, '{SIZE_RE}', 1) AS sq,
    {canon_unit_sql(f"regexp_extract(product_name, '{SIZE_RE}', 2)")} AS su,
    regexp_extract(product_name, '{_PACK}', 1) AS pk,
    regexp_extract(product_name, '{COUNT_RE}', 1) AS cq
  FROM n),
k AS (
  SELECT product_name,
    CASE WHEN mn <> '' THEN 'm' WHEN hh THEN 'h' WHEN hd THEN 'hd' WHEN dz <> '' THEN 'dz'
         WHEN sq <> '' THEN 's' WHEN pk <> '' THEN 'pk' WHEN cq <> '' THEN 'c' ELSE 'none' END AS kind,
    {mq} AS m_q, {mu} AS m_u, {hq} AS h_q, {hu_} AS h_u, {sq} AS s_q, {su} AS s_u,
    TRY_CAST(dz AS DOUBLE) * 12.0 AS dz_n, TRY_CAST(pk AS DOUBLE) AS pk_n, TRY_CAST(cq AS DOUBLE) AS c_n
  FROM m),
v AS (
  SELECT product_name, kind,
    CASE kind WHEN 'm' THEN m_q WHEN 'h' THEN h_q WHEN 's' THEN s_q WHEN 'hd' THEN 6.0
              WHEN 'dz' THEN dz_n WHEN 'pk' THEN pk_n WHEN 'c' THEN c_n END AS qv,
    CASE kind WHEN 'm' THEN m_u WHEN 'h' THEN h_u WHEN 's' THEN s_u WHEN 'none' THEN 'pcs' ELSE 'pcs' END AS unit
  FROM k)
SELECT product_name,
  CASE WHEN kind = 'none' THEN '1' ELSE {_num_txt('qv')} END AS quantity, unit,
  CASE WHEN kind = 'none' THEN '' WHEN unit = 'pcs' THEN {_num_txt('qv')} || ' pcs'
       ELSE {_num_txt('qv')} || unit END AS size_label
FROM v""".replace("\n, n AS", ", n AS"))


@query("extract_size_extended", _ext_sql())
def extract_size_extended_q(spark, sf):
    s = X.extract_size_extended(F.col("product_name"))
    return _names(spark, sf).select("product_name", s.quantity.alias("quantity"),
                                    s.unit.alias("unit"), s.size_label.alias("size_label"))


@query("unit_price", with_base("""
SELECT search_id, line_no, part_id, price, quantity, unit, price_per_unit FROM listings"""))
def unit_price_q(spark, sf):
    return domain.listings(spark, sf).select("search_id", "line_no", "part_id", "price",
                                             "quantity", "unit", "price_per_unit")


@query("unit_label", with_base(f"""
SELECT unit, {unit_norm_sql('unit')} AS unit_norm, count(*) AS n_rows FROM listings GROUP BY unit"""))
def unit_label_q(spark, sf):
    return (domain.listings(spark, sf).groupBy("unit").agg(F.count(F.lit(1)).alias("n_rows"))
            .select("unit", X.unit_label(F.col("unit")).alias("unit_norm"), "n_rows"))


@query("discount_pct", with_base("""
SELECT search_id, line_no, part_id, price, mrp, discount_pct FROM listings"""))
def discount_pct_q(spark, sf):
    return domain.listings(spark, sf).select("search_id", "line_no", "part_id", "price", "mrp",
                                             "discount_pct")


@query("value_score", with_base("""
SELECT search_id, line_no, part_id, platform, price, price_per_unit, delivery_mins, value_score
FROM scored"""))
def value_score_q(spark, sf):
    return domain.scored(spark, sf).select("search_id", "line_no", "part_id", "platform", "price",
                                           "price_per_unit", "delivery_mins", "value_score")


@query("rank_by_search", with_base("""
SELECT search_id, line_no, part_id, platform, value_score, rank FROM ranked_search_full"""))
def rank_by_search(spark, sf):
    # Output in rank order inside each search.
    return (domain.ranked(spark, sf, "search").select("search_id", "line_no", "part_id", "platform", "value_score", "rank")
            .orderBy("search_id", "rank", "line_no", "part_id"))


@query("rank_by_group", with_base("""
SELECT search_id, line_no, part_id, product_name, size_label, price, rank FROM ranked_group_full"""))
def rank_by_group(spark, sf):
    return domain.ranked(spark, sf, "group").select("search_id", "line_no", "part_id", "product_name",
                                                    "size_label", "price", "rank")


@query("savings_group", with_base("""
SELECT search_id, line_no, part_id, price, max_price, savings FROM ranked_group_full"""))
def savings_group(spark, sf):
    return domain.ranked(spark, sf, "group").select("search_id", "line_no", "part_id", "price",
                                                    "max_price", "savings")


@query("savings_search", with_base("""
SELECT search_id, line_no, part_id, price, max_price, savings FROM ranked_search_full"""))
def savings_search(spark, sf):
    return domain.ranked(spark, sf, "search").select("search_id", "line_no", "part_id", "price",
                                                     "max_price", "savings")


BEST_DEAL_COLS = ("search_id", "line_no", "part_id", "platform", "product_name", "size_label",
                  "price", "price_per_unit", "unit_norm", "delivery_mins", "value_score", "rank",
                  "savings", "is_best_deal", "pincode")


@query("best_deal", with_base(f"""
SELECT {', '.join(BEST_DEAL_COLS)} FROM ranked_search_full WHERE is_best_deal"""))
def best_deal(spark, sf):
    return best_deals(domain.ranked(spark, sf, "search")).select(*BEST_DEAL_COLS)


@query("city_lookup", with_base("""
SELECT s.search_id, s.pincode, c.city FROM searches s
LEFT JOIN cities c ON c.prefix = substring(s.pincode, 1, 3)"""))
def city_lookup(spark, sf):
    s = searches(spark, sf)
    return s.select("search_id", "pincode", city_of(F.col("pincode")).alias("city"))


@query("delivery_minutes", with_base("""
, pairs AS (SELECT DISTINCT pincode, platform FROM raw_offers)
SELECT p.pincode, p.platform, c.city,
       CAST(coalesce(cd.mins, t.mins, 60) AS INTEGER) AS delivery_mins
FROM pairs p LEFT JOIN cities c ON c.prefix = substring(p.pincode, 1, 3)
LEFT JOIN city_delivery cd ON cd.prefix = substring(p.pincode, 1, 3) AND cd.platform = p.platform
LEFT JOIN tier2 t ON t.platform = p.platform""".replace("\n, pairs AS", ", pairs AS")))
def delivery_minutes_q(spark, sf):
    pairs = raw_offers(spark, sf).select("pincode", "platform").distinct()
    return pairs.select("pincode", "platform", city_of(F.col("pincode")).alias("city"),
                        delivery_minutes(F.col("pincode"), F.col("platform")).alias("delivery_mins"))


@query("product_link", with_base(r"""
SELECT search_id, line_no, part_id, l.platform, product_url,
  CASE WHEN product_url <> '' THEN product_url
       WHEN p.link_template IS NOT NULL
       THEN replace(p.link_template, '{}', regexp_replace(regexp_replace(product_name,
              '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g'), '[ \t\n\x0B\f\r]+', '+', 'g'))
       ELSE '' END AS link
FROM listings l LEFT JOIN platforms p ON p.platform = l.platform"""))
def product_link(spark, sf):
    lst = domain.listings(spark, sf)
    tmpl = platform_attr(F.col("platform"), "link_template")
    link = (F.when(F.col("product_url") != "", F.col("product_url"))
             .when(tmpl.isNotNull(), F.replace(tmpl, F.lit("{}"), X.plus_query(F.col("product_name"))))
             .otherwise(F.lit("")))
    return lst.select("search_id", "line_no", "part_id", "platform", "product_url", link.alias("link"))


@query("search_requests", with_base("""
SELECT s.search_id, p.platform, p.priority,
       replace(p.search_template, '{}', replace(s.query, ' ', p.space)) AS url
FROM searches s JOIN platforms p ON p.active"""))
def search_requests(spark, sf):
    # One request per search and active platform: the platforms are a fixed
    # literal array exploded in the projection (no join, no shuffle).
    active = [p for p in PLATFORMS if p[1]]
    plats = F.array(*[F.struct(F.lit(p[0]).alias("platform"), F.lit(p[2]).alias("priority"),
                               F.lit(p[4]).alias("tmpl"), F.lit(p[5]).alias("space"))
                      for p in active])
    s = searches(spark, sf).select("search_id", "query", F.explode(plats).alias("p"))
    return s.select("search_id", F.col("p.platform").alias("platform"),
                    F.col("p.priority").alias("priority"),
                    F.replace(F.col("p.tmpl"), F.lit("{}"),
                              X.space_replace(F.col("query"), F.col("p.space"))).alias("url"))


__all__ = ["rhu"]


@query("search_locations", with_base(f"""
, loc(prefix, lat, lng, place) AS (SELECT * FROM (VALUES {', '.join(f"('{p}', {a}, {b}, '{d}')" for p, a, b, d in LOCATIONS)}))
SELECT s.search_id, s.pincode, CAST(coalesce(l.lat, {DEFAULT_LOCATION[0]}) AS DOUBLE) AS lat,
       CAST(coalesce(l.lng, {DEFAULT_LOCATION[1]}) AS DOUBLE) AS lng,
       coalesce(l.place, '{DEFAULT_LOCATION[2]}') AS place
FROM searches s LEFT JOIN loc l ON l.prefix = substring(s.pincode, 1, 3)"""))
def search_locations(spark, sf):
    loc = location_of(F.col("pincode"))
    return searches(spark, sf).select("search_id", "pincode", loc["lat"].alias("lat"), loc["lng"].alias("lng"),
                                      loc["place"].alias("place"))


@query("shop_locations", with_base("""
SELECT search_id, pincode, CASE substring(pincode, 1, 3)
    WHEN '110' THEN 'New Delhi' WHEN '122' THEN 'Gurugram' WHEN '201' THEN 'Noida' WHEN '400' THEN 'Mumbai' WHEN '401' THEN 'Mumbai'
    WHEN '411' THEN 'Pune' WHEN '500' THEN 'Hyderabad' WHEN '600' THEN 'Chennai' WHEN '700' THEN 'Kolkata' WHEN '380' THEN 'Ahmedabad'
    ELSE 'Bangalore' END AS place
FROM searches"""))
def shop_locations(spark, sf):
    # The shop with its own, shorter list; its oracle states the cities apart from the code's table.
    loc = location_of(F.col("pincode"), INSTAMART_LOCATIONS, INSTAMART_DEFAULT)
    return searches(spark, sf).select("search_id", "pincode", loc["place"].alias("place"))
