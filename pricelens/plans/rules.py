"""Catalogue: validation, filters, projections, dedup, caps, set operations, exports,
ML feature scans (S4, S5, P2-P8, P11, P14, A8-A10, T1, T2, T7, T8, U1, U2, K7, K8, M1, J7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as R
from ..operators.metrics import stored as stored_rows
from ..operators.store import price_rows
from ..reference_data import PARSER_SETTINGS, PLATFORM_NAMES
from ..session import scratch_path
from ..sources import searches
from ..sources.lookups import platform_attr
from ..sources.tables import table
from . import domain
from .core import LISTING_COLS
from .registry import query
from .sql_common import values_cte, with_base
from .store import _PRICES_SQL, PROCESSED_AT, stored

_SETTINGS = values_cte("settings", ["platform", "cap", "levels", "min_name", "min_price", "inclusive",
                                    "no_rupee"], PARSER_SETTINGS)
_LISTING_LIST = [c.strip() for c in LISTING_COLS.split(",")]


@query("valid_searches", with_base("""
SELECT search_id, q AS query, p AS pincode, searched_at, coalesce(q <> '', FALSE) AND coalesce(regexp_full_match(p, '[0-9]{6}'), FALSE) AS is_valid,
       CASE WHEN NOT coalesce(q <> '', FALSE) THEN 'empty query' WHEN NOT coalesce(regexp_full_match(p, '[0-9]{6}'), FALSE) THEN 'bad pincode' END AS reason
FROM (SELECT search_id, searched_at, regexp_replace(regexp_replace(typed, '^\\s+', ''), '\\s+$', '') AS q, regexp_replace(regexp_replace(pin, '^\\s+', ''), '\\s+$', '') AS p
      FROM (SELECT *, CASE WHEN search_id % 7 = 0 THEN chr(9) || ' ' WHEN search_id % 7 = 1 THEN ' ' || query || chr(10) ELSE query END AS typed,
                      CASE WHEN search_id % 5 = 0 THEN pincode || chr(10) WHEN search_id % 5 = 1 THEN pincode || '7' WHEN search_id % 5 = 2 THEN chr(9) || pincode ELSE pincode END AS pin FROM searches))"""))
def valid_searches(spark, sf):
    # As typed: with white space around the texts, only white space, or a digit too many.
    s, k = searches(spark, sf), F.col("search_id")
    typed = F.when(k % 7 == 0, F.lit("\t ")).when(k % 7 == 1, F.concat(F.lit(" "), "query", F.lit("\n"))).otherwise(F.col("query"))
    pin = F.when(k % 5 == 0, F.concat("pincode", F.lit("\n"))).when(k % 5 == 1, F.concat("pincode", F.lit("7"))).when(k % 5 == 2, F.concat(F.lit("\t"), "pincode")).otherwise(F.col("pincode"))
    return R.validate_searches(s.withColumns({"query": typed, "pincode": pin}))


@query("price_name_filters", with_base(f"""
, {_SETTINGS}
SELECT l.search_id, l.line_no, l.part_id, l.platform, l.product_name, l.price FROM listings l
JOIN settings s ON s.platform = l.platform
WHERE (CASE WHEN s.inclusive THEN l.price >= s.min_price ELSE l.price > s.min_price END)
  AND length(l.product_name) >= s.min_name
  AND NOT (s.no_rupee AND starts_with(l.product_name, '₹'))""".replace("\n, settings", ", settings")))
def price_name_filters(spark, sf):
    return R.platform_filters(domain.listings(spark, sf)).select(
        "search_id", "line_no", "part_id", "platform", "product_name", "price")


@query("live_counts", with_base("""
SELECT search_id, platform, count(*) AS n_products, count(*) FILTER (WHERE source = 'LIVE') AS n_live
FROM listings GROUP BY search_id, platform"""))
def live_counts(spark, sf):
    return domain.listings(spark, sf).groupBy("search_id", "platform").agg(
        F.count(F.lit(1)).alias("n_products"), F.count_if(F.col("source") == "LIVE").alias("n_live"))


@query("projection_views", with_base("""
SELECT search_id, platform, product_name, price, size_label, source,
       brand, mrp, discount_pct, quantity, unit, price_per_unit
FROM listings"""))
def projection_views(spark, sf):
    # Message sample (5 columns) + raw-export extras; column subsets are plain selects.
    return domain.listings(spark, sf).select(
        "search_id", "platform", "product_name", "price", "size_label", "source",
        "brand", "mrp", "discount_pct", "quantity", "unit", "price_per_unit")


_SAMPLE_ORDER = "line_no, part_id, platform, price, product_name"


@query("message_sample", with_base(f"""
SELECT search_id, platform, product_name, price, size_label, source FROM (
  SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY {_SAMPLE_ORDER}) AS position FROM listings) WHERE position <= 6"""))
def message_sample(spark, sf):
    order = [F.col(c.strip()) for c in _SAMPLE_ORDER.split(",")]
    return R.view(R.first_n_per_page(domain.listings(spark, sf), ["search_id"], order, R.SAMPLE_SIZE), R.SAMPLE_VIEW, ["search_id"])


@query("raw_view", with_base("""
SELECT search_id, platform, product_name, price, mrp, discount_pct, size_label, brand, delivery_mins, scraped_at, source, pincode FROM listings"""))
def raw_view(spark, sf):
    return R.view(domain.listings(spark, sf), R.RAW_VIEW, ["search_id"])


@query("processed_view", with_base(_PRICES_SQL + """
SELECT search_id, platform, product_name, price, mrp, discount_pct, rank, savings, is_best_deal, price_per_unit, unit_norm, size_label, processed_at FROM prices"""))
def processed_view(spark, sf):
    return R.view(stored(spark, sf)[0], R.PROCESSED_VIEW, ["search_id"])


@query("out_of_stock", with_base("""
SELECT platform, pincode, count(*) FILTER (WHERE NOT coalesce(in_stock, TRUE)) AS n_out_of_stock,
       count(*) AS n_offers
FROM listings GROUP BY platform, pincode"""))
def out_of_stock(spark, sf):
    lst = domain.listings(spark, sf).withColumn("out_of_stock", ~F.coalesce(F.col("in_stock"), F.lit(True)))
    return lst.groupBy("platform", "pincode").agg(F.count_if("out_of_stock").alias("n_out_of_stock"),
                                                  F.count(F.lit(1)).alias("n_offers"))


_TRAIN_COLS = ["platform", "product_name", "price", "mrp", "discount_pct", "price_per_unit",
               "delivery_mins", "savings", "is_best_deal"]


@query("scan_training_rows", with_base(_PRICES_SQL + f"""
SELECT {', '.join(_TRAIN_COLS)} FROM prices WHERE price IS NOT NULL"""))
def scan_training_rows(spark, sf):
    p, _ = stored(spark, sf)
    return p.select(*_TRAIN_COLS).where(F.col("price").isNotNull())


@query("training_features", with_base(_PRICES_SQL + """
SELECT coalesce(platform, '0') AS platform, coalesce(product_name, '0') AS product_name,
       coalesce(price, 0.0) AS price, coalesce(mrp, 0.0) AS mrp, coalesce(discount_pct, 0.0) AS discount_pct,
       coalesce(price_per_unit, 0.0) AS price_per_unit, coalesce(delivery_mins, 0) AS delivery_mins,
       coalesce(savings, 0.0) AS savings, coalesce(is_best_deal, 0) AS label
FROM prices WHERE price IS NOT NULL"""))
def training_features(spark, sf):
    from ..operators.ml import feature_table
    p, _ = stored(spark, sf)
    return feature_table(p.select(*_TRAIN_COLS).where(F.col("price").isNotNull()))


@query("class_weights", with_base(_PRICES_SQL + """
, c AS (SELECT is_best_deal AS label, count(*) AS n FROM prices WHERE price IS NOT NULL GROUP BY 1)
SELECT label, n, CAST((SELECT sum(n) FROM c) AS DOUBLE) / ((SELECT count(*) FROM c) * CAST(n AS DOUBLE)) AS weight
FROM c"""))
def class_weights(spark, sf):
    from ..operators.ml import class_weights as cw
    p, _ = stored(spark, sf)
    return cw(p.where(F.col("price").isNotNull()).withColumnRenamed("is_best_deal", "label"), "label")


@query("ranked_output", with_base(f"""
SELECT search_id, line_no, part_id, coalesce(product_name, '') AS sort_name, coalesce(rank, 99) AS sort_rank,
       platform, price, rank, max_price, savings, is_best_deal, TIMESTAMP '{PROCESSED_AT}' AS processed_at
FROM ranked_group_full"""))
def ranked_output(spark, sf):
    # Sort keys of the Spark-path output order (T1); processed_at passed in as a literal.
    r = domain.ranked(spark, sf, "group").withColumn("processed_at", F.lit(PROCESSED_AT).cast("timestamp_ntz"))
    return (r.select("search_id", "line_no", "part_id",
                     F.coalesce("product_name", F.lit("")).alias("sort_name"),
                     F.coalesce("rank", F.lit(99)).alias("sort_rank"),
                     "platform", "price", "rank", "max_price", "savings", "is_best_deal", "processed_at")
            .orderBy("sort_name", "sort_rank", "search_id", "line_no", "part_id", "platform"))


@query("union_platforms", with_base("""
SELECT platform, count(*) AS n_offers, count(DISTINCT search_id) AS n_searches FROM listings GROUP BY platform"""))
def union_platforms(spark, sf):
    # The bag union of the platforms' offers (U1): no dedup across platforms, so one pass keeps every row.
    lst = domain.listings(spark, sf).where(F.col("platform").isin(PLATFORM_NAMES))
    return lst.groupBy("platform").agg(F.count(F.lit(1)).alias("n_offers"),
                                     F.count_distinct("search_id").alias("n_searches"))


@query("first_n_records", with_base("""
SELECT search_id, line_no, part_id, platform, product_name, price, position FROM (
  SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY rank, price, line_no, part_id, platform,
                                                              product_name) AS position
  FROM ranked_search_full) WHERE position <= 6"""))
def first_n_records(spark, sf):
    r = domain.ranked(spark, sf, "search")
    top = R.first_n_per_page(r, ["search_id"], [F.col(c) for c in ("rank", "price", "line_no", "part_id",
                                                                     "platform", "product_name")], 6)
    return top.select("search_id", "line_no", "part_id", "platform", "product_name", "price",
                      F.col("position").cast("long").alias("position"))


_POS = "line_no, part_id, price, product_name"


@query("dedup_first_by_name", with_base(f"""
SELECT search_id, platform, product_name, line_no, part_id, price FROM (
  SELECT *, row_number() OVER (PARTITION BY search_id, platform, product_name ORDER BY {_POS}) AS rn
  FROM listings) WHERE rn = 1"""))
def dedup_first_by_name(spark, sf):
    return R.first_by_key(domain.listings(spark, sf), ["search_id", "platform"], ["product_name"],
                          ["line_no", "part_id", "price"], ["line_no", "part_id", "price"]).select(
        "search_id", "platform", "product_name", "line_no", "part_id", "price")


@query("dedup_name_price", with_base(f"""
SELECT search_id, platform, product_name, price, line_no, part_id FROM (
  SELECT *, row_number() OVER (PARTITION BY search_id, platform, product_name, price ORDER BY {_POS}) AS rn
  FROM listings) WHERE rn = 1"""))
def dedup_name_price(spark, sf):
    return R.first_by_key(domain.listings(spark, sf), ["search_id", "platform"], ["product_name", "price"],
                          ["line_no", "part_id"], ["line_no", "part_id"]).select(
        "search_id", "platform", "product_name", "price", "line_no", "part_id")


@query("top_n_per_page", with_base(f"""
, {_SETTINGS}
SELECT search_id, platform, line_no, part_id, product_name, price, position FROM (
  SELECT l.*, s.cap, row_number() OVER (PARTITION BY l.search_id, l.platform ORDER BY {_POS}) AS position
  FROM listings l JOIN settings s ON s.platform = l.platform) WHERE position <= cap""".replace("\n, settings", ", settings")))
def top_n_per_page(spark, sf):
    lst = domain.listings(spark, sf)
    top = R.first_n_per_page(lst, ["search_id", "platform"], [F.col(c) for c in _POS.split(", ")],
                             R.setting(F.col("platform"), "cap"), R.largest_cap())
    return top.select("search_id", "platform", "line_no", "part_id", "product_name", "price",
                      F.col("position").cast("long").alias("position"))


@query("largest_array", with_base("""
, c AS (SELECT l.search_id, l.platform, count(*) AS n, min(p.priority) AS pr FROM listings l
        JOIN platforms p ON p.platform = l.platform GROUP BY l.search_id, l.platform)
SELECT search_id, platform, n FROM (
  SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY n DESC, pr ASC) AS rn FROM c) WHERE rn = 1"""))
def largest_array(spark, sf):
    lst = domain.listings(spark, sf).withColumn("priority", platform_attr(F.col("platform"), "priority"))
    return R.largest_group(lst, ["search_id"], "platform", F.col("priority"))


@query("export_roundtrip", with_base(f"SELECT {LISTING_COLS} FROM listings"))
def export_roundtrip(spark, sf):
    # CSV export of the table (K7), JSON export of the records (K8); both read back with the schema.
    # The listings are built once; both exports are compressed, since a JSON record repeats its 21 names.
    lst = stored_rows(domain.listings(spark, sf), "export-listings")
    csv_path, json_path = scratch_path(spark, "export-csv"), scratch_path(spark, "export-json")
    # Explicit null marker, so empty strings and nulls both survive the CSV round trip.
    lst.write.mode("overwrite").option("header", True).option("nullValue", "\\N").option("compression", "gzip").csv(csv_path)
    lst.write.mode("overwrite").option("compression", "gzip").json(json_path)
    back_csv = (spark.read.schema(lst.schema).option("header", True).option("nullValue", "\\N")
                .option("emptyValue", "").csv(csv_path))
    back_json = spark.read.schema(lst.schema).json(json_path)
    # Both exports must agree row for row, compared by digests of whole rows; the JSON copy is returned.
    diff = R.row_digests(back_csv).exceptAll(R.row_digests(back_json)).limit(1).count()
    if diff:
        raise RuntimeError("CSV and JSON exports differ")
    return back_json.select(*_LISTING_LIST)


@query("foreach_batch_store", with_base(f"""
SELECT search_id, platform, product_name, brand, price, mrp, discount_pct, quantity, unit, size_label,
       price_per_unit, unit_norm, delivery_mins, CASE WHEN in_stock THEN 1 ELSE 0 END AS in_stock, rank, savings,
       CASE WHEN is_best_deal THEN 1 ELSE 0 END AS is_best_deal, pincode, source, scraped_at,
       TIMESTAMP '{PROCESSED_AT}' AS processed_at
FROM ranked_search_full"""))
def foreach_batch_store(spark, sf):
    # Stream of captured offers -> per micro-batch rank -> store rows, one folder per batch id (K9).
    from ..sources import raw_offers
    from ..streaming import stream as S
    raw = raw_offers(spark, sf)
    src = S.stage_files(raw, scratch_path(spark, "store-src"), "search_id", 4)
    sink = scratch_path(spark, "store-batches")
    writer = S.raw_and_clean_writer(sink, lambda b: price_rows(S.rank_batch(b),
                                                               F.lit(PROCESSED_AT).cast("timestamp_ntz")))
    stream = S.file_stream(spark, src, raw.schema, S.files_per_batch(spark, src, 4))
    S.run_available_now(stream, spark, "store", foreach=writer)
    return spark.read.parquet(f"{sink}/clean").drop("batch_id")


@query("stream_raw_sink", with_base("""
SELECT search_id, line_no, part_id, platform, name, price_text, in_stock, captured_at FROM raw_offers"""))
def stream_raw_sink(spark, sf):
    # The raw side of the two sinks: every captured offer as it came, whatever the clean side makes of it (K9).
    from ..sources import raw_offers
    from ..streaming import stream as S
    raw = raw_offers(spark, sf)
    src = S.stage_files(raw, scratch_path(spark, "raw-src"), "search_id", 4)
    sink = scratch_path(spark, "raw-batches")
    writer = S.raw_and_clean_writer(sink, lambda b: S.normalise_stream(b).where("price IS NOT NULL"))
    stream = S.file_stream(spark, src, raw.schema, S.files_per_batch(spark, src, 4))
    S.run_available_now(stream, spark, "raw", foreach=writer)
    return spark.read.parquet(f"{sink}/raw").select("search_id", "line_no", "part_id", "platform", "name", "price_text", "in_stock", "captured_at")


__all__ = ["table"]
