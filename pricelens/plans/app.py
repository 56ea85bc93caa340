"""Catalogue: result-table analytics and documented analytics (A4-A17, P2, P9, P10, P13,
T5, T6, T9, J9, J10, W5-W8, M8, M9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as X
from ..operators import analytics as A
from ..reference_data import PLATFORM_NAMES
from ..sources import price_ticks, searches, table
from ..sources.lookups import platforms_df
from . import domain
from .registry import query
from .sql_common import rhu, with_base


@query("cheapest_in_stock", with_base("""
SELECT search_id, platform, product_name, price, line_no, part_id FROM (
  SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY coalesce(price, 9999.0), product_name,
                               platform, line_no, part_id) AS rn
  FROM listings WHERE coalesce(in_stock, TRUE)) WHERE rn = 1"""))
def cheapest_in_stock(spark, sf):
    return A.cheapest_in_stock(domain.listings(spark, sf))


@query("fastest_in_stock", with_base("""
SELECT search_id, platform, product_name, price, delivery_mins, line_no, part_id FROM (
  SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY
           coalesce(CASE WHEN delivery_mins <> 0 THEN delivery_mins END, 9999),
           coalesce(price, 9999.0), product_name, platform, line_no, part_id) AS rn
  FROM listings WHERE coalesce(in_stock, TRUE)) WHERE rn = 1"""))
def fastest_in_stock(spark, sf):
    return A.fastest_in_stock(domain.listings(spark, sf))


@query("platform_summary", with_base("""
SELECT p.platform, p.priority, coalesce(a.n, 0) AS n_products, coalesce(a.nl, 0) AS n_live,
       coalesce(a.span, 0.0) AS span_days,
       CASE WHEN coalesce(a.n, 0) > 0 THEN CAST(coalesce(a.nl, 0) AS VARCHAR) || ' live'
            ELSE 'blocked / no data' END AS status
FROM platforms p LEFT JOIN (
  SELECT platform, count(*) AS n, count(*) FILTER (WHERE source = 'LIVE') AS nl,
         CAST(epoch_us(max(scraped_at)) - epoch_us(min(scraped_at)) AS DOUBLE) / CAST(86400000000 AS DOUBLE) AS span
  FROM listings GROUP BY platform) a ON a.platform = p.platform"""))
def platform_summary(spark, sf):
    return A.platform_summary(domain.listings(spark, sf), platforms_df(spark))


@query("column_flags", with_base("""
SELECT search_id, bool_or(coalesce(mrp, 0.0) > coalesce(price, 0.0)) AS has_mrp,
       bool_or(coalesce(size_label, '') <> '') AS has_size,
       bool_or(coalesce(unit_norm, 'per pc') <> 'per pc') AS has_ppu
FROM listings GROUP BY search_id"""))
def column_flags(spark, sf):
    return A.column_flags(domain.listings(spark, sf))


@query("phase_timings", """
SELECT user_id AS run_id, event_type AS phase,
       floor(CAST(sum(floor(value * 100.0 + 0.5)) AS DOUBLE) / 100.0 * 100.0 + 0.5) / 100.0 AS seconds,
       count(*) AS n_events
FROM events GROUP BY ROLLUP (user_id, event_type)""")
def phase_timings(spark, sf):
    # events read as a phase log: run = user_id, phase = event_type, seconds = value.
    e = table(spark, sf, "events")
    return (e.rollup(F.col("user_id").alias("run_id"), F.col("event_type").alias("phase"))
            .agg(X.round_half_up(F.sum(X.cents(F.col("value"))) / F.lit(100.0), 2).alias("seconds"),
                 F.count(F.lit(1)).alias("n_events")))


def _fixed_sql(x: str, d: int) -> str:
    if d == 0:
        return f"CAST(CAST(floor({x} + 0.5) AS BIGINT) AS VARCHAR)"
    f = 10 ** d
    n = f"CAST(floor({x} * {f}.0 + 0.5) AS BIGINT)"
    return f"(CAST({n} // {f} AS VARCHAR) || '.' || lpad(CAST({n} % {f} AS VARCHAR), {d}, '0'))"


@query("display_table", with_base(f"""
SELECT search_id, line_no, part_id, coalesce(CAST(rank AS VARCHAR), '—') AS rank_text,
  coalesce(CAST(rank AS DOUBLE), 99.0) AS sort_key, coalesce(product_name, '—') AS product,
  coalesce(platform, '—') AS platform_text,
  CASE WHEN coalesce(delivery_mins, 0) <> 0 THEN '~' || CAST(delivery_mins AS VARCHAR) || ' min' ELSE '—' END AS delivery,
  CASE WHEN coalesce(price_per_unit, 0.0) <> 0 THEN '₹' || {_fixed_sql('price_per_unit', 1)} || ' ' || coalesce(unit_norm, 'per pc') ELSE '—' END AS unit_price_text,
  CASE WHEN coalesce(value_score, 0.0) <> 0 THEN {_fixed_sql('value_score', 2)} ELSE '—' END AS score_text,
  CASE WHEN coalesce(size_label, '') <> '' THEN size_label ELSE '—' END AS size_text,
  CASE WHEN mrp > price THEN {_fixed_sql('mrp', 2)} ELSE '—' END AS mrp_text,
  CASE WHEN discount_pct > 0 THEN {_fixed_sql('discount_pct', 0)} || '%' ELSE '—' END AS discount_text
FROM ranked_search_full"""))
def display_table(spark, sf):
    return A.display_table(domain.ranked(spark, sf, "search"))


@query("chart_rows", with_base("""
SELECT search_id, substring(coalesce(product_name, ''), 1, 32) || '  [' || coalesce(platform, '') || ']' AS label,
       price, platform FROM listings WHERE price > 0"""))
def chart_rows(spark, sf):
    return A.chart_rows(domain.listings(spark, sf))


FILTER_PLATFORMS = ["Amazon Fresh", "Blinkit", "BigBasket", "Zepto"]


@query("user_filters", with_base(f"""
SELECT search_id, line_no, part_id, platform, price, delivery_mins, discount_pct FROM listings
WHERE price BETWEEN 0.0 AND 5000.0 AND coalesce(delivery_mins, 0) <= 120 AND discount_pct >= 5.0
  AND platform IN ({', '.join("'" + p + "'" for p in FILTER_PLATFORMS)}) AND coalesce(in_stock, TRUE)"""))
def user_filters(spark, sf):
    f = A.user_filters(domain.listings(spark, sf), FILTER_PLATFORMS, 0.0, 5000.0, 120, 5.0, True)
    return f.select("search_id", "line_no", "part_id", "platform", "price", "delivery_mins",
                    "discount_pct")


@query("metric_strip", with_base(f"""
SELECT search_id, arg_min(platform, (price, platform)) AS cheapest_platform, min(price) AS best_price,
       min(delivery_mins) AS fastest_mins,
       {rhu('CAST(sum(floor(savings * 100.0 + 0.5)) AS DOUBLE) / count(savings) / 100.0', 2)} AS avg_saving
FROM ranked_search_full GROUP BY search_id"""))
def metric_strip(spark, sf):
    return A.metric_strip(domain.ranked(spark, sf, "search"))


@query("avg_price_by_platform", with_base(f"""
SELECT platform, count(price) AS n,
       {rhu('CAST(sum(floor(price * 100.0 + 0.5)) AS DOUBLE) / count(price) / 100.0', 2)} AS avg_price
FROM listings GROUP BY platform"""))
def avg_price_by_platform(spark, sf):
    return A.avg_price_by_platform(domain.listings(spark, sf))


@query("compare_pivot", with_base(f"""
SELECT product_name, size_label,
  {', '.join(f"min(price) FILTER (WHERE platform = '{p}') AS \"{p}\"" for p in PLATFORM_NAMES)}
FROM listings GROUP BY product_name, size_label"""))
def compare_pivot(spark, sf):
    return A.compare_pivot(domain.listings(spark, sf), PLATFORM_NAMES)


_TICKS = """ticks AS (SELECT event_id AS tick_id, ts, event_type AS platform, user_id AS product_id,
                    value AS price FROM events)"""


def _latest_and_alerts(spark, sf):
    t = price_ticks(spark, sf)
    latest = t.groupBy("product_id", "platform").agg(
        F.max_by("price", F.struct("ts", "tick_id")).alias("price"))
    alerts = t.groupBy("product_id").agg(
        X.round_half_up(F.sum(X.cents(F.col("price"))) / F.count("price") / F.lit(100.0) * F.lit(0.9), 2)
        .alias("target_price"))
    return latest, alerts


@query("price_alerts", f"""
WITH {_TICKS},
latest AS (SELECT product_id, platform, price FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id, platform ORDER BY ts DESC, tick_id DESC) AS rn
  FROM ticks) WHERE rn = 1),
alerts AS (SELECT product_id,
  {rhu('CAST(sum(floor(price * 100.0 + 0.5)) AS DOUBLE) / count(price) / 100.0 * 0.9', 2)} AS target_price
  FROM ticks GROUP BY product_id)
SELECT a.product_id, a.target_price, l.platform, l.price FROM alerts a JOIN latest l
  ON l.product_id = a.product_id WHERE l.price <= a.target_price""")
def price_alerts(spark, sf):
    # Targets derived from history: 90 % of each product's average price.
    latest, alerts = _latest_and_alerts(spark, sf)
    return A.price_alerts(latest, alerts).select("product_id", "target_price", "platform", "price")


_SNAP = f"""snap AS (
  SELECT product_id, platform, CAST(ts AS DATE) AS day, min(price) AS min_price, max(price) AS max_price,
         {rhu('CAST(sum(floor(price * 100.0 + 0.5)) AS DOUBLE) / count(price) / 100.0', 2)} AS avg_price,
         arg_max(price, (ts, tick_id)) AS last_price, count(*) AS n_ticks
  FROM ticks GROUP BY product_id, platform, CAST(ts AS DATE))"""


@query("daily_snapshot", f"WITH {_TICKS},\n{_SNAP}\nSELECT * FROM snap")
def daily_snapshot(spark, sf):
    return A.daily_snapshot(price_ticks(spark, sf))


def _ma_sql(days: int) -> str:
    frame = (f"OVER (PARTITION BY product_id, platform ORDER BY date_diff('day', DATE '1970-01-01', day) "
             f"RANGE BETWEEN {days - 1} PRECEDING AND CURRENT ROW)")
    c = "floor(avg_price * 100.0 + 0.5)"
    return rhu(f"CAST(sum({c}) {frame} AS DOUBLE) / count({c}) {frame} / 100.0", 2)


@query("trend_7_30", f"""WITH {_TICKS},\n{_SNAP}
SELECT product_id, platform, day, avg_price, {_ma_sql(7)} AS ma_7, {_ma_sql(30)} AS ma_30 FROM snap""")
def trend_7_30(spark, sf):
    return A.trend_7_30(A.daily_snapshot(price_ticks(spark, sf)))


@query("days_since_drop", f"""WITH {_TICKS},\n{_SNAP},
d AS (SELECT product_id, platform, day, last_price,
        CASE WHEN last_price < lag(last_price) OVER w THEN day END AS drop_day,
        lead(last_price) OVER w AS nxt
      FROM snap WINDOW w AS (PARTITION BY product_id, platform ORDER BY day))
SELECT product_id, platform, day, last_price,
  CAST(date_diff('day', last_value(drop_day IGNORE NULLS) OVER (PARTITION BY product_id, platform ORDER BY day
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), day) AS INTEGER) AS days_since_drop,
  CASE WHEN nxt IS NULL THEN NULL WHEN nxt < last_price THEN 1 ELSE 0 END AS drops_next
FROM d""")
def days_since_drop(spark, sf):
    return A.days_since_drop(A.daily_snapshot(price_ticks(spark, sf))).drop("max_price")


@query("anomaly_2sigma", f"""WITH {_TICKS},
t AS (SELECT *, CAST(ts AS DATE) AS day, floor(price * 100.0 + 0.5) AS c FROM ticks),
daily AS (SELECT product_id, platform, day, count(*) AS n, sum(CAST(c AS HUGEINT)) AS s,
                 sum(CAST(c AS HUGEINT) * CAST(c AS HUGEINT)) AS q FROM t GROUP BY product_id, platform, day),
base AS (SELECT product_id, platform, day,
   sum(n) OVER w AS n7, CAST(sum(s) OVER w AS DOUBLE) AS s7, CAST(sum(q) OVER w AS DOUBLE) AS q7
   FROM daily WINDOW w AS (PARTITION BY product_id, platform ORDER BY date_diff('day', DATE '1970-01-01', day)
                           RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING)),
j AS (SELECT t.tick_id, t.product_id, t.platform, t.ts, t.price, b.n7, b.s7 / CAST(b.n7 AS DOUBLE) / 100.0 AS mean,
        sqrt(greatest((b.q7 - b.s7 * b.s7 / CAST(b.n7 AS DOUBLE)) / (CAST(b.n7 AS DOUBLE) - 1.0) / 10000.0, 0.0)) AS sd
      FROM t JOIN base b ON b.product_id = t.product_id AND b.platform = t.platform AND b.day = t.day)
SELECT tick_id, product_id, platform, ts, price, {rhu('mean', 4)} AS mean_7d,
       coalesce(n7 >= 2 AND abs(price - mean) > 2.0 * sd, FALSE) AS is_anomaly FROM j""")
def anomaly_2sigma(spark, sf):
    return A.anomaly_2sigma(price_ticks(spark, sf))


@query("anomaly_top5pct", f"""WITH {_TICKS},
t AS (SELECT *, floor(price * 100.0 + 0.5) AS c FROM ticks),
st AS (SELECT product_id, platform, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(c AS HUGEINT)) AS DOUBLE) AS s,
              CAST(sum(CAST(c AS HUGEINT) * CAST(c AS HUGEINT)) AS DOUBLE) AS q FROM t GROUP BY product_id, platform),
z AS (SELECT t.tick_id, t.product_id, t.platform, t.ts, t.price,
   {rhu("coalesce(abs(t.price - st.s / st.n / 100.0) / nullif(sqrt(greatest((st.q - st.s * st.s / st.n) / (st.n - 1.0), 0.0)) / 100.0, 0.0), 0.0)", 4)} AS abs_z
   FROM t JOIN st ON st.product_id = t.product_id AND st.platform = t.platform)
SELECT *, abs_z > (SELECT quantile_cont(abs_z, 0.95) FROM z) AS is_anomaly FROM z""")
def anomaly_top5pct(spark, sf):
    return A.zscore_top(price_ticks(spark, sf), 0.05)


@query("platform_rank", with_base("""
SELECT search_id, product_name, platform, price,
       dense_rank() OVER (PARTITION BY search_id, product_name ORDER BY price ASC NULLS LAST) AS platform_rank
FROM listings"""))
def platform_rank(spark, sf):
    return A.platform_rank(domain.listings(spark, sf))


def deal_score_col():
    """Transparent 0-100 deal score (M8): rank, discount, delivery speed, savings share, stock."""
    dm = F.coalesce(F.col("delivery_mins"), F.lit(60)).cast("double")
    share = F.coalesce(F.try_divide(F.col("savings"), F.nullif(F.col("max_price"), F.lit(0.0))), F.lit(0.0))
    raw = (F.lit(40.0) / F.col("rank").cast("double")
           + F.lit(25.0) * F.least(F.col("discount_pct"), F.lit(50.0)) / F.lit(50.0)
           + F.lit(20.0) * (F.lit(1.0) - F.least(dm, F.lit(120.0)) / F.lit(120.0))
           + F.lit(10.0) * share
           + F.lit(5.0) * F.when(F.col("in_stock"), F.lit(1.0)).otherwise(F.lit(0.0)))
    return X.round_half_up(raw, 2)


DEAL_SCORE_SQL = rhu("40.0 / CAST(rank AS DOUBLE) + 25.0 * least(discount_pct, 50.0) / 50.0 "
                     "+ 20.0 * (1.0 - least(CAST(coalesce(delivery_mins, 60) AS DOUBLE), 120.0) / 120.0) "
                     "+ 10.0 * coalesce(CASE WHEN max_price = 0 THEN NULL ELSE savings / max_price END, 0.0) "
                     "+ 5.0 * CASE WHEN in_stock THEN 1.0 ELSE 0.0 END", 2)


@query("top_deals", with_base(f"""
SELECT search_id, line_no, part_id, platform, {DEAL_SCORE_SQL} AS deal_score FROM ranked_search_full
ORDER BY deal_score DESC NULLS LAST, search_id, line_no, part_id, platform LIMIT 50"""))
def top_deals(spark, sf):
    r = domain.ranked(spark, sf, "search").withColumn("deal_score", deal_score_col())
    return A.top_deals(r, 50).select("search_id", "line_no", "part_id", "platform", "deal_score")


@query("deal_score", with_base(f"""
SELECT search_id, line_no, part_id, platform, rank, discount_pct, delivery_mins, savings,
       {DEAL_SCORE_SQL} AS deal_score FROM ranked_search_full"""))
def deal_score(spark, sf):
    r = domain.ranked(spark, sf, "search").withColumn("deal_score", deal_score_col())
    return r.select("search_id", "line_no", "part_id", "platform", "rank", "discount_pct",
                    "delivery_mins", "savings", "deal_score")


@query("search_analytics", with_base("""
SELECT query, pincode, count(*) AS n_searches, count(DISTINCT CAST(searched_at AS DATE)) AS n_days
FROM searches GROUP BY CUBE (query, pincode)"""))
def search_analytics(spark, sf):
    s = searches(spark, sf)
    return s.cube("query", "pincode").agg(F.count(F.lit(1)).alias("n_searches"),
                                          F.count_distinct(F.to_date("searched_at")).alias("n_days"))


@query("product_cards", with_base("""
, pp AS (SELECT search_id, product_name, platform, price, delivery_mins, discount_pct FROM (
    SELECT *, row_number() OVER (PARTITION BY search_id, product_name, platform
                                 ORDER BY price, delivery_mins, discount_pct) AS rn FROM ranked_search_full)
  WHERE rn = 1)
SELECT search_id, product_name,
  string_agg(platform, ',' ORDER BY price, platform, delivery_mins, discount_pct) AS platforms,
  arg_min(platform, (price, platform, delivery_mins, discount_pct)) AS best_platform,
  min(price) AS best_price, count(*) AS n_platforms
FROM pp GROUP BY search_id, product_name"""))
def product_cards(spark, sf):
    c = A.product_cards(domain.ranked(spark, sf, "search"))
    return c.select("search_id", "product_name",
                    F.array_join(F.transform("offers", lambda o: o["platform"]), ",").alias("platforms"),
                    "best_platform", "best_price", F.col("n_platforms").cast("long").alias("n_platforms"))
