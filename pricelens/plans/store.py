"""Catalogue: store and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import store as S
from ..operators.metrics import stored as stored_rows
from ..session import scratch_path
from ..sources import searches
from . import domain
from .registry import query
from .sql_common import with_base

PROCESSED_AT = "2024-01-01 00:00:00"
QUERY, PINCODE = "1-URGENT", "400001"

_PRICES_SQL = f"""
, prices AS (
  SELECT search_id, platform, product_name, brand, price, mrp, discount_pct, quantity, unit,
         size_label, price_per_unit, unit_norm, delivery_mins,
         CASE WHEN in_stock THEN 1 ELSE 0 END AS in_stock, rank, savings,
         CASE WHEN is_best_deal THEN 1 ELSE 0 END AS is_best_deal, pincode, source, scraped_at,
         TIMESTAMP '{PROCESSED_AT}' AS processed_at
  FROM ranked_group_full),
store_searches AS (
  SELECT s.search_id AS id, s.query, s.pincode, CAST(coalesce(c.n, 0) AS BIGINT) AS result_count,
         s.searched_at
  FROM searches s LEFT JOIN (SELECT search_id, count(*) AS n FROM prices GROUP BY search_id) c
       ON c.search_id = s.search_id)
"""

_PRICE_COLS = ", ".join(S.PRICE_COLUMNS)


def _held_prices(spark, sf):
    """Ranked once and stored: what ranking shuffled is gone before the rows are dealt by month."""
    prices = S.price_rows(domain.ranked(spark, sf, "group"), F.lit(PROCESSED_AT).cast("timestamp_ntz"))
    return stored_rows(S.dated_prices(prices, searches(spark, sf)), "store-ranked")


def stored(spark, sf):
    """Write the store, then read it back from Parquet."""
    prices = _held_prices(spark, sf)
    root = scratch_path(spark, "store")
    S.write_dated(prices, searches(spark, sf), root)
    return S.read_store(spark, root)


@query("store_appends", with_base(_PRICES_SQL + """
SELECT s.id, s.query, s.pincode, s.result_count, count(p.search_id) AS n_prices, coalesce(sum(p.rank), 0) AS sum_rank,
       strftime(s.searched_at, '%Y-%m') AS search_month
FROM store_searches s LEFT JOIN prices p ON p.search_id = s.id GROUP BY ALL"""))
def store_appends(spark, sf):
    # Two batches of searches that share days, then the second one again: nothing is lost, nothing doubled.
    # Each batch reads its own rows of the held table.
    prices = _held_prices(spark, sf)
    srch = searches(spark, sf)
    root = scratch_path(spark, "store-appends")
    for batch in ("0", "1", "1"):
        mine = F.col("search_id") % 2 == int(batch)
        S.write_dated(prices.where(mine), srch.where(mine), root, batch)
    p, s = S.read_store(spark, root)
    each = p.groupBy("search_id", "search_month").agg(F.count(F.lit(1)).alias("n_prices"), F.sum("rank").alias("sum_rank"))
    joined = s.withColumnRenamed("id", "search_id").join(each, ["search_id", "search_month"], "left")
    return joined.select(F.col("search_id").alias("id"), "query", "pincode", "result_count", F.coalesce("n_prices", F.lit(0)).alias("n_prices"),
                         F.coalesce("sum_rank", F.lit(0)).alias("sum_rank"), "search_month")


@query("prices_row_defaults", with_base(f"""
SELECT search_id, platform, product_name, brand, price, mrp, discount_pct, quantity, unit,
       size_label, price_per_unit, unit_norm, delivery_mins,
       CASE WHEN in_stock THEN 1 ELSE 0 END AS in_stock, 1 AS rank, 0.0 AS savings,
       0 AS is_best_deal, pincode, source, scraped_at, TIMESTAMP '{PROCESSED_AT}' AS processed_at
FROM listings"""))
def prices_row_defaults(spark, sf):
    # Unranked listings: rank, savings and is_best_deal are absent and take the defaults.
    return S.price_rows(domain.listings(spark, sf), F.lit(PROCESSED_AT).cast("timestamp_ntz"))


@query("latest_prices", with_base(_PRICES_SQL + f"""
SELECT {_PRICE_COLS} FROM prices p
WHERE p.search_id IN (SELECT id FROM store_searches WHERE query = '{QUERY}' AND pincode = '{PINCODE}')
ORDER BY rank ASC NULLS LAST, price ASC NULLS LAST,
  {', '.join(c + ' ASC NULLS LAST' for c in S.PRICE_COLUMNS if c not in ('rank', 'price'))}
LIMIT 200"""))
def latest_prices(spark, sf):
    p, s = stored(spark, sf)
    return S.latest_prices(p, s, QUERY, PINCODE, 200)


@query("latest_prices_recent", with_base(_PRICES_SQL + f"""
, m AS (SELECT * FROM store_searches WHERE query = '{QUERY}' AND pincode = '{PINCODE}')
SELECT {_PRICE_COLS} FROM prices p
WHERE p.search_id IN (SELECT id FROM m WHERE searched_at = (SELECT max(searched_at) FROM m))
ORDER BY rank ASC NULLS LAST, price ASC NULLS LAST,
  {', '.join(c + ' ASC NULLS LAST' for c in S.PRICE_COLUMNS if c not in ('rank', 'price'))}
LIMIT 200"""))
def latest_prices_recent(spark, sf):
    p, s = stored(spark, sf)
    return S.latest_prices(p, s, QUERY, PINCODE, 200, latest_only=True)


@query("search_history", with_base(_PRICES_SQL + """
SELECT id, query, pincode, result_count, searched_at FROM store_searches ORDER BY id DESC LIMIT 20"""))
def search_history(spark, sf):
    _, s = stored(spark, sf)
    return S.search_history(s, 20)


@query("history_table", with_base(_PRICES_SQL + """
SELECT id AS "ID", query AS "Query", pincode AS "Pincode", result_count AS "Results", searched_at AS "Searched At" FROM store_searches ORDER BY id DESC LIMIT 20"""))
def history_table(spark, sf):
    return S.history_table(stored(spark, sf)[1], 20)


@query("store_stats", with_base(_PRICES_SQL + """
SELECT (SELECT count(*) FROM prices) AS total_prices, (SELECT count(*) FROM store_searches) AS total_searches, TRUE AS size_is_that_of_the_files"""))
def store_stats(spark, sf):
    # No other engine writes files of the same size, so the size is compared with the files that the store lists.
    p, s = stored(spark, sf)
    return S.store_stats(p, s).select("total_prices", "total_searches", (F.col("db_size_kb") == F.lit(S.file_kb(spark, [*p.inputFiles(), *s.inputFiles()]))).alias("size_is_that_of_the_files"))


@query("orphan_prices", with_base(_PRICES_SQL + """
SELECT 'prices_without_search' AS "check",
       (SELECT count(*) FROM prices p WHERE NOT EXISTS (SELECT 1 FROM store_searches s WHERE s.id = p.search_id)) AS n
UNION ALL
SELECT 'searches_without_prices', (SELECT count(*) FROM store_searches s
       WHERE NOT EXISTS (SELECT 1 FROM prices p WHERE p.search_id = s.id))
UNION ALL
SELECT 'searches_with_prices', (SELECT count(*) FROM store_searches s
       WHERE EXISTS (SELECT 1 FROM prices p WHERE p.search_id = s.id))"""))
def orphan_prices(spark, sf):
    p, s = stored(spark, sf)
    return S.integrity_report(p, s)
