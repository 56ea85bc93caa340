"""Delivery lookups (J2-J4), ranking scopes and their properties."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pricelens.operators.delivery import stamp_delivery
from pricelens.functions import round_half_up
from pricelens.operators.ranking import SCOPES, coarse_step, heavy_values, rank_within, score_and_rank, with_value_score
from pricelens.plans import domain
from pricelens.sources.lookups import city_of, delivery_minutes

from conftest import SF_SMALL


def test_delivery_cases(spark):
    df = spark.createDataFrame(
        [("400001", "Blinkit"), ("999999", "Blinkit"), ("400001", "Flipkart"), (None, "Zepto"),
         ("700123", "Amazon Fresh"), ("834001", "JioMart")], "pin string, plat string")
    got = [r[0] for r in df.select(delivery_minutes(F.col("pin"), F.col("plat"))).collect()]
    assert got == [10, 20, 60, 20, 180, 90]
    cities = [r[0] for r in df.select(city_of(F.col("pin"))).collect()]
    assert cities == ["Mumbai", None, "Mumbai", None, "Kolkata", None]


def test_stamp_overwrites_unless_observed(spark):
    df = spark.createDataFrame([("400001", "Blinkit", 7), ("400001", "Blinkit", None)],
                               "pincode string, platform string, delivery_mins int")
    assert [r.delivery_mins for r in stamp_delivery(df).collect()] == [10, 10]
    assert [r.delivery_mins for r in stamp_delivery(df, prefer_observed=True).collect()] == [7, 10]


def _offers(spark):
    rows = [(1, "milk", "1l", 50.0, 1.0, 10), (1, "milk", "1l", 40.0, 1.0, 10),
            (1, "milk", "1l", 40.0, 1.0, 10), (1, "milk", "1l", None, 1.0, 10),
            (1, "eggs", "", 70.0, 5.0, 30), (2, "milk", "1l", 45.0, 4.5, 0)]
    return spark.createDataFrame(rows, "search_id long, product_name string, size_label string, "
                                       "price double, price_per_unit double, delivery_mins int")


def test_rank_ties_and_nulls_last(spark):
    r = score_and_rank(_offers(spark), "group").where("search_id = 1 AND product_name = 'milk'")
    got = sorted((row.price is None, row.price or 0, row.rank) for row in r.collect())
    assert got == [(False, 40.0, 1), (False, 40.0, 1), (False, 50.0, 3), (True, 0, 4)]


def test_rank_equals_the_plain_window_and_properties(spark):
    lst = domain.listings(spark, SF_SMALL)
    cols = ["search_id", "line_no", "part_id", "platform", "price", "rank", "max_price", "savings", "is_best_deal"]
    for scope in ("group", "search"):
        a = score_and_rank(lst, scope).select(*cols)
        keys, order = SCOPES[scope]
        w = Window.partitionBy(*keys)
        b = (with_value_score(lst).withColumn("rank", F.rank().over(w.orderBy(F.col(order).asc_nulls_last())))
             .withColumn("max_price", F.max("price").over(w))
             .withColumn("savings", round_half_up(F.col("max_price") - F.col("price"), 2))
             .withColumn("is_best_deal", F.col("rank") == 1).select(*cols))
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
        assert a.where("savings < 0").count() == 0
        assert a.where("is_best_deal <> (rank = 1)").count() == 0
    per_search = score_and_rank(lst, "search").groupBy("search_id").agg(F.min("rank").alias("m"))
    assert per_search.where("m <> 1").count() == 0


def test_rank_unchanged_under_repartitioning(spark):
    lst = domain.listings(spark, SF_SMALL)
    a = score_and_rank(lst, "search").select("search_id", "line_no", "part_id", "rank")
    b = score_and_rank(lst.repartition(7, "platform"), "search").select("search_id", "line_no", "part_id", "rank")
    assert a.exceptAll(b).count() == 0


def test_coarse_steps_never_fall(spark):
    values = [float("-inf"), -1e300, -5.0, -0.1, 0.0, 1e-9, 0.5, 1.0, 1.0001, 3.0, 1e6, 1e300, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    steps = [r.s for r in df.select("i", coarse_step(F.col("v")).alias("s")).orderBy("i").collect()]
    assert steps == sorted(steps) and len(set(steps[-3:])) == 3


def test_one_hot_search_is_spread(spark):
    hot = spark.range(40001).select(F.when(F.col("id") < 40000, 1).otherwise(2).alias("search_id"), (F.rand(3) * 500 + 1).alias("value_score"), F.col("id").cast("double").alias("price"))
    ranked = rank_within(hot, ["search_id"], "value_score")
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "windowspecdefinition" in line]
    assert windows and all("_s#" in line for line in windows)
    assert ranked.where("search_id = 1").select(F.max("rank"), F.count_distinct("rank"), F.max("max_price")).first() == (40000, 40000, 39999.0)


def test_heavy_groups_are_ranked_like_all_others(spark):
    rows = [(1, i % 7 * 1.5, float(i)) for i in range(40)] + [(2, 3.0, 1.0), (2, None, 2.0), (2, float("nan"), 9.0), (None, 1.0, 4.0), (None, 0.5, 5.0)]
    df = spark.createDataFrame(rows, "search_id long, value_score double, price double")
    heavy = heavy_values(df, F.col("search_id"), "search_id", 10)
    assert [r.search_id for r in heavy.collect()] == [1]
    for dense in (False, True):
        plain = rank_within(df, ["search_id"], "value_score", dense=dense)
        both = rank_within(df, ["search_id"], "value_score", dense=dense, heavy=heavy)
        assert plain.columns == both.columns and both.count() == len(rows)
        assert plain.exceptAll(both).count() == 0 and both.exceptAll(plain).count() == 0


def test_offers_joined_by_search_are_ranked_without_another_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        offers = spark.createDataFrame([(1, 2.0, 5.0)], "k long, value_score double, price double")
        dealt = offers.join(spark.createDataFrame([(1,)], "search_id long"), F.col("k") == F.col("search_id")).drop("k")
        light = rank_within(dealt, ["search_id"], "value_score", heavy=spark.createDataFrame([], "search_id long"))
        light.collect()
        plan = light._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("Exchange hashpartitioning") == 2 and "rank(" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_listing_rules_do_not_exceed_what_the_jvm_compiles(spark):
    domain.listings(spark, SF_SMALL)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_without_heavy_groups_the_rows_are_planned_once(spark):
    df = spark.range(1000).select((F.col("id") % 50).alias("search_id"), (F.col("id") % 7).cast("double").alias("value_score"), F.lit(1.0).alias("price"))
    heavy = heavy_values(df, F.col("search_id"), "search_id", 20)
    plan = rank_within(df, ["search_id"], "value_score", heavy=heavy)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Join" not in plan
    assert sorted(r[0] for r in heavy_values(df.where("search_id < 3 OR id < 500 OR search_id IS NULL"), F.col("search_id"), "search_id", 10).collect()) == [0, 1, 2]
