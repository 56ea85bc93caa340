"""Catalogue: JSON of unknown shape on VARIANT."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import json_search as J
from ..sources.tables import table
from .registry import query

PRICE_KEYS, NAME_KEYS = ["sp", "selling_price", "price"], ["desc", "product_name", "name"]
CAP = 5

_LINES = """l AS (
  SELECT l_orderkey, p_name, p_brand, l_linenumber % 3 AS k, CAST(floor(l_extendedprice * 100.0 + 0.5) AS BIGINT) AS cents,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS position
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def offer_documents(spark, sf):
    """Stand-in input: one JSON text per order, nested, with prices and names under changing keys; every fiftieth is cut short."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount")
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    k = F.col("l_linenumber") % 3
    cents = F.floor(F.col("l_extendedprice") * 100.0 + 0.5).cast("long")
    item = F.to_json(F.struct(
        F.when(k == 0, F.col("p_name")).alias("desc"), F.when(k == 1, F.col("p_name")).alias("product_name"), F.when(k == 2, F.col("p_name")).alias("name"),
        F.when(k == 0, cents).when(k == 2, F.lit(0)).alias("sp"), F.when(k == 1, cents.cast("string")).when(k == 2, F.lit("")).alias("selling_price"),
        F.when(k == 2, cents).alias("price"), F.when(k == 0, F.struct(F.col("p_brand").alias("name"))).alias("brand")))
    # A brand is an object, a text or missing; one schema cannot say so, so the text is put in by hand.
    item = F.when(k == 1, F.concat(F.lit('{"brand":"'), "p_brand", F.lit('",'), F.substring(item, 2, 1 << 20))).otherwise(item)
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", item.alias("item"), (F.col("l_discount") >= 0.05).alias("promo"))
    docs = li.join(part, F.col("p_partkey") == F.col("l_partkey")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(order)).alias("o"))
    texts = F.concat(F.lit('{"props":{"user":{"id":1},"zones":[[1,2],[{"title":"x"}]],"page":{"alt":{"promos":['),
                     F.array_join(F.transform(F.filter("o", lambda x: x["promo"]), lambda x: x["item"]), ","),
                     F.lit(']},"main":{"items":['), F.array_join(F.transform("o", lambda x: x["item"]), ","), F.lit("]}}}}"))
    return docs.select(F.col("l_orderkey").alias("search_id"), F.when(F.col("l_orderkey") % 50 == 0, F.substring(texts, 1, 30)).otherwise(texts).alias("body"))


@query("json_list_items", f"""WITH {_LINES}
SELECT l_orderkey AS search_id, CAST(position AS INTEGER) AS position, p_name AS name, CAST(cents AS VARCHAR) AS price, CASE WHEN k < 2 THEN p_brand ELSE '' END AS brand
FROM l WHERE l_orderkey % 50 <> 0 AND position < {CAP}""")
def json_list_items(spark, sf):
    docs, _ = J.parsed(offer_documents(spark, sf), "body")
    lists = J.longest_list(J.candidate_lists(docs, "doc", [*PRICE_KEYS, *NAME_KEYS, "mrp"]), ["search_id"])
    item = F.col("item")
    return J.list_items(lists, CAP).select("search_id", "position", J.first_of(item, NAME_KEYS).alias("name"), J.first_of(item, PRICE_KEYS).alias("price"), J.name_of(item, "brand").alias("brand"))


@query("json_candidate_lists", f"""WITH {_LINES},
n AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_discount >= 0.05) AS m FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey % 50 <> 0 GROUP BY 1)
SELECT l_orderkey AS search_id, '0.0.1.0' AS path, CAST(n AS INTEGER) AS n_items FROM n
UNION ALL SELECT l_orderkey, '0.0.0.0', CAST(m AS INTEGER) FROM n WHERE m > 0""")
def json_candidate_lists(spark, sf):
    docs, _ = J.parsed(offer_documents(spark, sf), "body")
    lists = J.candidate_lists(docs, "doc", [*PRICE_KEYS, *NAME_KEYS, "mrp"])
    return lists.select("search_id", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), F.size("items").alias("n_items"))


@query("json_quarantine", """
SELECT l_orderkey AS search_id, 30 AS n_chars FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey % 50 = 0 GROUP BY l_orderkey""")
def json_quarantine(spark, sf):
    _, broken = J.parsed(offer_documents(spark, sf), "body")
    return broken.select("search_id", F.length("body").alias("n_chars"))


@query("json_props", """
SELECT event_id AS tick_id, nullif(json_extract_string(props, '$.k'), '0') AS k FROM events WHERE json_valid(props)""")
def json_props(spark, sf):
    docs, _ = J.parsed(table(spark, sf, "events").select(F.col("event_id").alias("tick_id"), "props"), "props")
    return docs.select("tick_id", J.first_of(F.col("doc"), ["price", "k"]).alias("k"))


@query("json_page_scripts", r"""
WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '<script[^>]*>((?s:.*?))</script>', 1)) AS body FROM pages)
SELECT page_id, count(*) AS n_scripts, count(*) FILTER (WHERE json_valid(body)) AS n_json FROM s GROUP BY page_id""")
def json_page_scripts(spark, sf):
    # Scripts of captured pages: those that are JSON can be searched, the others are counted.
    bodies = F.regexp_extract_all("html", F.lit(r"<script[^>]*>((?s:.*?))</script>"), F.lit(1))
    scripts = table(spark, sf, "pages").select("page_id", F.explode(bodies).alias("body")).withColumn("doc", F.try_parse_json("body"))
    return scripts.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_scripts"), F.count("doc").alias("n_json"))
