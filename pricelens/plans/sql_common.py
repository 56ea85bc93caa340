"""Independent SQL (DuckDB dialect) for the checking oracles.

These CTEs restate the domain mapping and the listing rules in plain SQL; they
share only fixed reference values with the Spark code, never its expressions.
RE2 has no look-around, so word boundaries are written as consuming
``(?:^|[^0-9A-Za-z_])`` / ``(?:[^0-9A-Za-z_]|$)`` groups.
"""

from __future__ import annotations

from ..reference_data import (DEFAULT_MINS, PINCODE_PREFIXES, PLATFORM_NAMES, PLATFORMS, TIER2,
                              city_delivery_rows, city_rows)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(vals) -> str:
    return "[" + ", ".join(_q(v) for v in vals) + "]"


WS = r"[ \t\n\x0B\f\r]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def rhu(x: str, n: int) -> str:
    """round half up, the floor form."""
    f = f"{10 ** n}.0"
    return f"(floor(({x}) * {f} + 0.5) / {f})"


def amount_sql(c: str) -> str:
    return (f"(CAST(CAST({c} AS BIGINT) // 100 AS VARCHAR) || '.' || "
            f"lpad(CAST(CAST({c} AS BIGINT) % 100 AS VARCHAR), 2, '0'))")


def clean_price_sql(t: str) -> str:
    v = f"TRY_CAST(regexp_extract(replace({t}, ',', ''), '([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE)"
    return f"(CASE WHEN {v} > 0 THEN {v} END)"


SIZE_RE = (r"(?i)(?:^|[^0-9A-Za-z_])([0-9]+(?:\.[0-9]+)?)\s*"
           r"(kg|grams?|gms?|g|litres?|liters?|lit|l|ml)(?:[^0-9A-Za-z_]|$)")
COUNT_RE = r"(?i)(?:pack\s+of\s+|x\s*)?([0-9]+)\s*(?:pcs?|pieces?|eggs?|units?)"


def canon_unit_sql(u: str) -> str:
    return (f"(CASE WHEN lower({u}) = 'kg' THEN 'kg' "
            f"WHEN lower({u}) IN ('g','gm','gms','gram','grams') THEN 'g' "
            f"WHEN lower({u}) IN ('l','lit','litre','liter','litres','liters') THEN 'l' "
            f"WHEN lower({u}) = 'ml' THEN 'ml' ELSE lower({u}) END)")


def ppu_sql(p: str, q: str, u: str) -> str:
    """unit price with try-divide semantics, 2 dp, fallback price."""
    qd = f"TRY_CAST({q} AS DOUBLE)"
    div = lambda a, b: f"(CASE WHEN ({b}) = 0 THEN NULL ELSE ({a}) / ({b}) END)"
    raw = (f"(CASE WHEN lower({u}) IN ('g','ml') THEN {div(p, qd)} * 100.0 "
           f"WHEN lower({u}) IN ('kg','l') THEN {div(p, qd + ' * 1000.0')} * 100.0 "
           f"WHEN lower({u}) = 'pcs' THEN {div(p, qd)} ELSE {p} END)")
    return f"coalesce({rhu(raw, 2)}, {rhu(p, 2)})"


def unit_norm_sql(u: str) -> str:
    return (f"(CASE WHEN lower({u}) IN ('g','kg') THEN 'per 100g' WHEN lower({u}) IN ('ml','l') "
            f"THEN 'per 100mL' WHEN lower({u}) = 'pcs' THEN 'per pc' ELSE 'per unit' END)")


def value_score_sql(ppu: str, price: str, dm: str) -> str:
    p = f"coalesce(CASE WHEN {ppu} <> 0 AND NOT isnan({ppu}) THEN {ppu} END, {price})"
    d = (f"coalesce(CASE WHEN CAST({dm} AS DOUBLE) <> 0 AND NOT isnan(CAST({dm} AS DOUBLE)) "
         f"THEN CAST({dm} AS DOUBLE) END, 60.0)")
    return rhu(f"{p} * (1.0 + {d} / 60.0 * 0.15)", 4)


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if v is True or v is False:
        return "TRUE" if v else "FALSE"
    if isinstance(v, str):
        return _q(v)
    return str(v)


def values_cte(name: str, cols: list[str], rows) -> str:
    body = ", ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)
    return f"{name}({', '.join(cols)}) AS (SELECT * FROM (VALUES {body}))"


def lookups_ctes() -> str:
    return ",\n".join([
        values_cte("city_delivery", ["prefix", "city", "platform", "mins"], city_delivery_rows()),
        values_cte("cities", ["prefix", "city"], city_rows()),
        values_cte("tier2", ["platform", "mins"], TIER2),
        values_cte("platforms", ["platform", "active", "priority", "host", "search_template",
                                 "space", "link_template", "page_mins"], PLATFORMS),
    ])


def delivery_sql(pin: str, plat: str) -> str:
    return (f"CAST(coalesce((SELECT cd.mins FROM city_delivery cd WHERE cd.prefix = "
            f"substring(coalesce({pin}, ''), 1, 3) AND cd.platform = {plat}), "
            f"(SELECT t.mins FROM tier2 t WHERE t.platform = {plat}), {DEFAULT_MINS}) AS INTEGER)")


SIZE_TEXT = """CASE p_partkey % 12
      WHEN 0 THEN CAST(p_size * 50 AS VARCHAR) || ' g'
      WHEN 1 THEN CAST(p_size AS VARCHAR) || ' kg'
      WHEN 2 THEN CAST(p_size * 100 AS VARCHAR) || ' ml'
      WHEN 3 THEN CAST(p_size AS VARCHAR) || 'L'
      WHEN 4 THEN CAST(p_size AS VARCHAR) || ' pcs'
      WHEN 6 THEN CAST(p_size AS VARCHAR) || 'gms'
      WHEN 7 THEN 'pack of ' || CAST(p_size AS VARCHAR) || ' eggs'
      WHEN 8 THEN '2 x ' || CAST(p_size * 50 AS VARCHAR) || 'g'
      WHEN 9 THEN 'half kg'
      WHEN 10 THEN '1/2 liter'
      WHEN 11 THEN CAST(p_size AS VARCHAR) || ' dozen' END"""


def base_ctes() -> str:
    """searches, raw_offers, listings (standardised + delivery stamped), scored."""
    return f"""
{lookups_ctes()},
searches AS (
  SELECT o_orderkey AS search_id, o_orderpriority AS query,
         {_list(PINCODE_PREFIXES)}[o_custkey % {len(PINCODE_PREFIXES)} + 1] || '001' AS pincode,
         o_orderdate AS searched_at
  FROM orders
),
offer_base AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_discount, l.l_linestatus,
         l.l_shipdate, p.p_partkey, p.p_brand, p.p_type, s.pincode,
         concat_ws(' ', p.p_name, {SIZE_TEXT}) AS nm,
         floor(l.l_extendedprice / l.l_quantity * 100.0 + 0.5) AS mrp_c
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
                  JOIN searches s ON l.l_orderkey = s.search_id
),
raw_offers AS (
  SELECT l_orderkey AS search_id, l_linenumber AS line_no, l_partkey AS part_id,
         {_list(PLATFORM_NAMES)}[l_suppkey % {len(PLATFORM_NAMES)} + 1] AS platform,
         CASE WHEN l_linenumber % 5 = 0 THEN '  ' || nm || chr(9) ELSE nm END AS name,
         (CASE l_linenumber % 4 WHEN 0 THEN 'Rs. ' WHEN 1 THEN '₹' WHEN 2 THEN 'INR ' ELSE '' END)
           || {amount_sql('floor(mrp_c * (1.0 - l_discount) + 0.5)')} AS price_text,
         CASE WHEN l_discount > 0 THEN 'MRP ₹' || {amount_sql('mrp_c')} ELSE '' END AS mrp_text,
         p_brand AS brand, p_type AS description,
         CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '/pd/' || CAST(p_partkey AS VARCHAR)
              ELSE 'https://shop.example.com/pd/' || CAST(p_partkey AS VARCHAR) END AS url,
         l_linestatus = 'O' AS in_stock, pincode, l_shipdate AS captured_at
  FROM offer_base
),
std_a AS (
  SELECT r.*, {strip_sql("coalesce(name, '')")} AS product_name,
         {clean_price_sql('price_text')} AS p0, {clean_price_sql('mrp_text')} AS m0
  FROM raw_offers r
),
std_b AS (
  SELECT *, regexp_extract(product_name, '{SIZE_RE}', 1) AS sq,
         {canon_unit_sql(f"regexp_extract(product_name, '{SIZE_RE}', 2)")} AS su,
         regexp_extract(product_name, '{COUNT_RE}', 1) AS cq,
         CASE WHEN m0 > p0 THEN m0 ELSE p0 END AS em
  FROM std_a WHERE p0 IS NOT NULL AND product_name <> ''
),
std_c AS (
  SELECT *, CASE WHEN sq <> '' THEN sq WHEN cq <> '' THEN cq ELSE '1' END AS quantity,
         CASE WHEN sq <> '' THEN su ELSE 'pcs' END AS unit,
         CASE WHEN sq <> '' THEN sq || su WHEN cq <> '' THEN cq || ' pcs' ELSE '' END AS size_label
  FROM std_b
),
listings AS (
  SELECT search_id, line_no, part_id, c.platform, product_name, {rhu('p0', 2)} AS price,
         {strip_sql("coalesce(brand, '')")} AS brand,
         {strip_sql("coalesce(description, '')")} AS description,
         'LIVE' AS source, captured_at AS scraped_at, {rhu('em', 2)} AS mrp,
         CASE WHEN em > p0 THEN {rhu('(em - p0) / em * 100.0', 1)} ELSE 0.0 END AS discount_pct,
         quantity, unit, size_label, {ppu_sql('p0', 'quantity', 'unit')} AS price_per_unit,
         {unit_norm_sql('unit')} AS unit_norm,
         {delivery_sql('pincode', 'c.platform')} AS delivery_mins,
         coalesce(in_stock, TRUE) AS in_stock, coalesce(pincode, '') AS pincode,
         CASE WHEN starts_with(coalesce(url, ''), '/') THEN coalesce(pf.host, '') || url
              ELSE coalesce(url, '') END AS product_url
  FROM std_c c LEFT JOIN platforms pf ON pf.platform = c.platform
),
scored AS (
  SELECT *, {value_score_sql('price_per_unit', 'price', 'delivery_mins')} AS value_score FROM listings
),
ranked_search AS (
  SELECT *, CAST(RANK() OVER (PARTITION BY search_id ORDER BY value_score ASC NULLS LAST) AS INTEGER) AS rank,
         MAX(price) OVER (PARTITION BY search_id) AS max_price
  FROM scored
),
ranked_search_full AS (
  SELECT *, {rhu('max_price - price', 2)} AS savings, rank = 1 AS is_best_deal FROM ranked_search
),
ranked_group AS (
  SELECT *, CAST(RANK() OVER (PARTITION BY search_id, product_name, size_label
                              ORDER BY price ASC NULLS LAST) AS INTEGER) AS rank,
         MAX(price) OVER (PARTITION BY search_id, product_name, size_label) AS max_price
  FROM scored
),
ranked_group_full AS (
  SELECT *, {rhu('max_price - price', 2)} AS savings, rank = 1 AS is_best_deal FROM ranked_group
)"""


def with_base(select_sql: str) -> str:
    return "WITH " + base_ctes().lstrip() + "\n" + select_sql
