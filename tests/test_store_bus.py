"""Store defaults and queries (K5, J1, T3, T4, A3), topic round trip and offsets."""

import os
import re
import time

from pyspark.sql import functions as F

from pricelens.operators import bus as B
from pricelens.operators import store as S
from pricelens.operators.metrics import stored
from pricelens.operators.sequence import number_within
from pricelens.plans import domain
from pricelens.session import scratch_path, workspace

from conftest import SF_SMALL


def test_price_row_defaults(spark):
    df = spark.createDataFrame([(1, "Blinkit", None)], "search_id long, platform string, in_stock boolean")
    r = S.price_rows(df, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).first()
    assert (r.in_stock, r.rank, r.savings, r.is_best_deal, r.source) == (0, 1, 0.0, 0, "LIVE")
    assert len(r) == 21


def test_store_write_read_and_queries(spark):
    ranked = domain.ranked(spark, SF_SMALL, "group")
    prices = S.price_rows(ranked, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    from pricelens.sources import searches
    srch = S.search_rows(searches(spark, SF_SMALL), prices)
    root = scratch_path(spark, "store-test")
    S.write_store(prices, srch, root)
    p, s = S.read_store(spark, root)
    assert p.count() == prices.count()
    stats = S.store_stats(p, s).first()
    assert stats.total_prices == prices.count() and stats.db_size_kb > 0
    hist = S.search_history(s, 20).collect()
    assert len(hist) == 20 and [h.id for h in hist] == sorted([h.id for h in hist], reverse=True)
    latest = S.latest_prices(p, s, "1-URGENT", "400001", 5)
    assert "dynamicpruning" in latest._jdf.queryExecution().executedPlan().toString()
    top = latest.collect()
    assert len(top) <= 5 and all(t.rank == 1 for t in top[:1])
    # rewriting is idempotent (dynamic partition overwrite)
    S.write_store(prices, srch, root)
    assert spark.read.parquet(f"{root}/prices").count() == prices.count()


def test_two_searches_of_one_day_are_both_kept(spark):
    at = "2024-05-01 10:00:00"
    searches = spark.createDataFrame([(1, "tea", "400001", 1, at), (2, "rice", "400001", 1, at)],
                                     "id long, query string, pincode string, result_count long, at string").select(
        "id", "query", "pincode", "result_count", F.col("at").cast("timestamp_ntz").alias("searched_at"))
    prices = S.price_rows(spark.createDataFrame([(1, "Blinkit", 2.0), (2, "Zepto", 3.0)], "search_id long, platform string, price double"),
                          F.lit(at).cast("timestamp_ntz"))
    root = scratch_path(spark, "store-two")
    S.create_store(spark, root, prices.schema)
    assert S.read_store(spark, root, prices.schema)[0].count() == 0
    for k in (1, 2, 2):  # the second batch is saved twice
        S.write_store(prices.where(F.col("search_id") == k), searches.where(F.col("id") == k), root, f"b{k}")
    p, s = S.read_store(spark, root, prices.schema)
    assert sorted(r.price for r in p.collect()) == [2.0, 3.0] and sorted(r.id for r in s.collect()) == [1, 2]
    assert [r.price for r in S.latest_prices(p, s, "rice", "400001").collect()] == [3.0]


def test_number_within_is_consecutive(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 5000).alias("k"))
    n = number_within(df, "g", ["k"], out="seq")
    agg = n.groupBy("g").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"),
                            F.count_distinct("seq").alias("d"), F.count(F.lit(1)).alias("c")).collect()
    for r in agg:
        assert r.lo == 0 and r.hi == r.c - 1 and r.d == r.c


def test_topic_roundtrip_identity_and_replay(spark):
    lst = domain.listings(spark, SF_SMALL)
    order = lst.columns
    path = scratch_path(spark, "topic-test")
    first = B.encode(lst.where("search_id % 2 = 0"), partitions=3, order=order)
    B.write_topic(first, path)
    snap = B.end_offsets(B.read_topic(spark, path))
    second = B.encode(lst.where("search_id % 2 = 1"), partitions=3, order=order,
                      start=snap.select("partition", F.col("end_offset").alias("start_offset")))
    B.write_topic(second, path)
    msgs = B.read_topic(spark, path)
    good, bad = B.decode(msgs, lst.schema)
    assert bad.count() == 0
    assert good.exceptAll(lst).count() == 0 and lst.exceptAll(good).count() == 0
    replay, _ = B.decode(B.bounded_read(msgs, snap), lst.schema)
    odd = lst.where("search_id % 2 = 1")
    assert replay.exceptAll(odd).count() == 0 and odd.exceptAll(replay).count() == 0
    meta = B.flow_metadata(msgs).collect()
    assert sum(m.messages for m in meta) == lst.count()
    assert all(m.offset_before == 0 and m.offset_after == m.messages for m in meta)


def test_malformed_messages_quarantined(spark):
    from pyspark.sql import types as T
    texts = ['{"a": 1}', '{"b": 2}', "not json", '{"a": 1, "b"', '{"a":"zz"}', "[1]", "", None]
    msgs = spark.createDataFrame([(None if t is None else bytearray(t.encode()),) for t in texts], "value binary")
    good, bad = B.decode(msgs, T.StructType([T.StructField("a", T.IntegerType())]))
    assert sorted((r.a is None, r.a) for r in good.collect()) == [(False, 1), (True, None)]
    assert bad.count() == 6


def test_number_within_keeps_what_is_asked_and_leaves_no_checkpoint(spark, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda *a, **k: 1 / 0)
    df = spark.createDataFrame([("a", 3), ("b", 1), ("a", 1), (None, 9)], "g string, k long")
    for few in (False, True):
        n = number_within(df.where("g IS NOT NULL"), "g", ["k"], keep=[(F.col("k") * 10).alias("t")], few_groups=few)
        assert n.columns[-1] == "seq" and sorted(map(tuple, n.select("g", "t", "seq").collect())) == [("a", 10, 0), ("a", 30, 1), ("b", 10, 0)]


def test_encoded_messages_are_written_as_they_lie(spark):
    rows = spark.createDataFrame([("p", "n", str(i % 3), i) for i in range(30)], "platform string, product_name string, size_label string, i long")
    want = {r.value: r.offset for r in B.encode(rows, order=["i"]).collect()}  # not all columns are in the order
    path = scratch_path(spark, "runs")
    B.write_topic(B.encode(rows, order=["i", "platform", "product_name", "size_label"]), path, encoded=True)
    read = B.read_topic(spark, path)
    assert {bytes(r.value): r.offset for r in read.collect()} == {bytes(v): o for v, o in want.items()}
    per = B.flow_metadata(read).collect()
    assert sum(r.messages for r in per) == 30 and all(r.offset_before == 0 and r.offset_after == r.messages for r in per)


def test_dated_prices_are_counted_by_the_rows_of_their_search(spark):
    prices = S.price_rows(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (9, "d")], "search_id long, platform string")
                              .withColumn("scraped_at", F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")))
    searches = spark.sql("""SELECT id AS search_id, q AS query, '400001' AS pincode, CAST(t AS TIMESTAMP_NTZ) AS searched_at FROM VALUES
        (1, 'x', '2024-01-05'), (1, 'y', '2024-02-05'), (2, 'z', NULL), (3, 'w', '2024-01-01') AS v(id, q, t)""")
    dated = stored(S.dated_prices(prices, searches), "dated")
    root = scratch_path(spark, "dated-store")
    S.write_dated(dated, searches, root)
    p, s = S.read_store(spark, root)
    assert {(r.query, r.result_count) for r in s.collect()} == {("x", 2), ("y", 2), ("z", 1), ("w", 0)}
    assert sorted((r.search_id, r.search_month) for r in p.collect()) == [
        (1, "2024-01"), (1, "2024-01"), (1, "2024-02"), (1, "2024-02"), (2, "2024-05"), (9, "2024-05")]


def test_a_stored_table_leaves_no_shuffle_files(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toString()
        return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", found))
    before = files()
    stored(spark.range(1000).repartition(3).groupBy((F.col("id") % 10).alias("k")).count(), "no-shuffles")
    end = time.time() + 20  # files go in the background
    while not files() <= before and time.time() < end:
        time.sleep(0.2)
    assert files() <= before


def test_few_asked_searches_do_not_make_prices_be_shuffled(spark):
    at = F.lit("2024-05-01 10:00:00").cast("timestamp_ntz")
    searches = spark.range(4000).select(F.col("id"), F.concat(F.lit("q"), F.col("id")).alias("query"), F.lit("400001").alias("pincode"), F.lit(1).cast("long").alias("result_count"), at.alias("searched_at"))
    prices = S.price_rows(spark.range(4000).select(F.col("id").alias("search_id"), F.lit("Zepto").alias("platform"), F.rand(1).alias("price")), at)
    root = scratch_path(spark, "store-few")
    S.write_store(prices, searches, root)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4000")  # the searches are larger, the one asked for is not
    try:
        for latest_only in (False, True):
            found = S.latest_prices(*S.read_store(spark, root), "q7", "400001", latest_only=latest_only)
            assert [r.search_id for r in found.collect()] == [7]
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_integrity_counts_nulls_and_repeats_in_one_join(spark):
    prices = spark.createDataFrame([(1,), (1,), (3,), (None,), (4,)], "search_id long")
    searches = spark.createDataFrame([(1,), (1,), (2,), (None,), (4,)], "id long")
    report = S.integrity_report(prices, searches)
    assert {r["check"]: r.n for r in report.collect()} == {"prices_without_search": 2, "searches_without_prices": 2, "searches_with_prices": 3}
    assert report._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    none = S.integrity_report(prices.limit(0), searches.limit(0)).collect()
    assert len(none) == 3 and all(r.n == 0 for r in none)


def _files(spark, name):
    folder = workspace(spark).removeprefix("file:").rstrip("/")
    return [f for f in os.listdir(folder) if f.startswith(name)]


def _shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toString()
    return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", found))


def _gone(spark, before):
    end = time.time() + 20  # files go in the background
    while not _shuffle_files(spark) <= before and time.time() < end:
        time.sleep(0.2)
    return _shuffle_files(spark) <= before


def test_a_published_topic_leaves_only_its_messages(spark):
    rows = spark.createDataFrame([("p", f"n{i % 7}", None if i % 5 else "x", i // 2) for i in range(200)], "platform string, product_name string, size_label string, i long")
    order = ["i", "platform", "product_name", "size_label"]
    want = {(r.partition, r.offset, bytes(r.value)) for r in B.encode(rows, partitions=5, order=order).collect()}
    path, numbered, shuffled = scratch_path(spark, "published"), _files(spark, "numbered"), _shuffle_files(spark)
    B.publish(rows, path, partitions=5, order=order)
    assert {(r.partition, r.offset, bytes(r.value)) for r in B.read_topic(spark, path).collect()} == want
    assert _files(spark, "numbered") == numbered and _gone(spark, shuffled)
    snap = B.end_offsets(B.read_topic(spark, path)).localCheckpoint()
    B.publish(rows.where("i < 9"), path, partitions=5, order=order, start=snap.select("partition", F.col("end_offset").alias("start_offset")))
    per = B.flow_metadata(B.read_topic(spark, path)).collect()
    assert sum(r.messages for r in per) == 218 and all(r.offset_before == 0 and r.offset_after == r.messages for r in per)


def test_rows_are_reconciled_by_digests(spark):
    sql = """SELECT CAST(a AS DOUBLE) AS a, s, CAST(t AS TIMESTAMP_NTZ) AS t, l FROM VALUES
        {} AS v(a, s, t, l)"""
    same = "('0.0', 'x', '2024-01-01 00:00:00.000001', array(1)), ('0.0', 'x', '2024-01-01 00:00:00.000001', array(1)), ('NaN', NULL, NULL, NULL)"
    produced = spark.sql(sql.format(same + ", ('1.0', '1:a', NULL, array(2)), ('2.0', '', NULL, NULL), ('3.0', 'x', '2024-01-01 00:00:00.000002', NULL)"))
    consumed = spark.sql(sql.format("('-0.0', 'x', '2024-01-01 00:00:00.000001', array(1)), ('NaN', NULL, NULL, NULL), ('1.0', '1:a', NULL, array(3)),"
                                    " ('2.0', NULL, NULL, NULL), ('3.0', 'x', '2024-01-01 00:00:00.000003', NULL)"))
    report = B.reconcile(produced, consumed)
    assert {r.item: r.n for r in report.collect()} == {"delivered": 2, "produced_not_consumed": 4, "consumed_not_produced": 3}
    plain = [c for c in produced.columns if c != "l"]
    plan = B.reconcile(produced.select(plain), consumed.select(plain))._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Exchange hashpartitioning(_digest" in plan


def test_messages_are_not_shuffled_to_meet_a_snapshot(spark):
    msgs = spark.range(1000).select((F.col("id") % 3).cast("int").alias("partition"), F.lit("t").alias("topic"), "id", F.col("id").alias("offset"))
    path = scratch_path(spark, "snapshot-messages")
    msgs.write.parquet(path)
    snap = spark.createDataFrame([("t", 0, 500), ("t", 1, 900)], "topic string, partition int, end_offset long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        read = B.bounded_read(spark.read.parquet(path), snap, B.end_offsets(msgs))
        assert "Exchange hashpartitioning(topic" not in read._jdf.queryExecution().executedPlan().toString().split("HashAggregate")[0]
        assert read.count() == sum(k >= {0: 500, 1: 900, 2: 0}[k % 3] for k in range(1000))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
