"""Catalogue queries against their DuckDB statements at sf0.001 (the driver checks sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as E
from pricelens.sources.tables import TABLES

from conftest import SF_SMALL

FAST = ["standardise_listings", "extract_size", "extract_size_extended", "rank_by_search", "rank_by_group",
        "best_deal", "delivery_minutes", "product_link", "search_requests", "cheapest_in_stock",
        "metric_strip", "compare_pivot", "daily_snapshot", "trend_7_30", "anomaly_2sigma",
        "anomaly_top5pct", "days_since_drop", "dedup_5min_gap", "top_n_per_page", "largest_array",
        "product_cards", "search_analytics", "phase_timings", "price_alerts", "display_table",
        "extract_cards", "extract_next_data", "extract_price_walk", "extract_quarantine", "clean_product_name",
        "card_text_fields", "first_key_json", "sanity_price", "stream_window_tumbling", "stream_session"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    norm = lambda v: repr(round(v, 9)) if isinstance(v, float) else str(v)
    return sorted("|".join(norm(r[i]) for i in order) for r in rows)


def test_every_query_has_a_callable_and_most_have_sql():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(o) >= 70


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, cur.fetchall())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "is_best_deal" in df.columns
