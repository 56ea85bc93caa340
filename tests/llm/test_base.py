import time

from pyspark.sql import functions as F

from pricelens.llm.base import cut
from pricelens.session import measured_broadcasts


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(k).getName() for k in range(files.size())) if name.startswith("shuffle_")}


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    df = spark.range(3000).select((F.col("id") % 70).alias("k"), "id")
    grouped = df.groupBy("k").agg(F.sum("id").alias("n"))  # planned before the checkpoint is asked for
    held = cut(grouped)
    end = time.monotonic() + 20
    while _shuffle_files(spark) - before and time.monotonic() < end:  # Spark deletes them on its own thread
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before
    assert {(r.k, r.n) for r in held.collect()} == {(k, sum(range(k, 3000, 70))) for k in range(70)}


def _first_plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()  # before adaptive execution has measured anything


def test_an_exploded_side_is_broadcast_by_its_measured_size_only(spark):
    def joined(n):
        few = spark.range(1, 5).select(F.explode(F.sequence(F.lit(0), F.lit(n))).alias("id"), F.col("id").alias("x"))
        return spark.range(100_000).withColumn("y", F.col("id") + 1).join(few, "id")

    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "64k")
    try:
        assert "BroadcastHashJoin" in _first_plan(joined(90_000))  # Spark sees four rows
        with measured_broadcasts(spark):
            assert "BroadcastHashJoin" not in _first_plan(joined(90_000))
            for n, chosen in ((90_000, False), (50, True)):
                df = joined(n)
                assert df.count() == 4 * (n + 1)
                df.collect()
                assert ("BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]) == chosen
        assert spark.conf.get(setting) == "64k" and spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None
    finally:
        spark.conf.set(setting, before)
