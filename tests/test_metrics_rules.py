"""Model metrics by aggregates, mergeable distinct counts, validation, bounded top-N, stored size."""

import random

import pytest
from pyspark.sql import functions as F

from pricelens.operators import metrics as X
from pricelens.operators import rules as R
from pricelens.operators import sketches as K
from pricelens.operators import store as S
from pricelens.operators.ml import load_model
from pricelens.session import scratch_path


def _auc(rows):
    pos, neg = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("places", [0, 1, 6])
def test_auc_counts_pairs_and_ties(spark, places):
    rng = random.Random(places)
    rows = [(y, round(rng.gauss(y, 1), places)) for y in (rng.randrange(2) for _ in range(400))]
    df = spark.createDataFrame([*rows, (None, 1.0), (1, None)], "label int, score double").repartition(5)
    assert X.auc(df) == pytest.approx(_auc(rows), abs=1e-12)
    assert X.auc(df.where("label = 1")) is None and X.auc(df.limit(0)) is None
    assert X.auc(df.withColumn("score", F.lit(0.3))) == 0.5


def test_regression_and_report(spark):
    rng = random.Random(9)
    rows = [(rng.gauss(3, 2), rng.gauss(3, 2)) for _ in range(200)]
    r = X.regression(spark.createDataFrame([*rows, (None, 1.0)], "y double, p double"), "y", "p").first()
    mean = sum(y for y, _ in rows) / 200
    assert r.n == 200 and r.mae == pytest.approx(sum(abs(y - p) for y, p in rows) / 200)
    assert r.r2 == pytest.approx(1 - sum((y - p) ** 2 for y, p in rows) / sum((y - mean) ** 2 for y, _ in rows))
    assert X.regression(spark.createDataFrame([(1.0, 2.0)] * 3, "y double, p double"), "y", "p").first().r2 is None
    always = spark.createDataFrame([(0, 0)] * 6 + [(1, 0)] * 2, "label int, prediction int")
    got = {r["class"]: (r.precision, r.recall, r.f1, r.support) for r in X.classification_report(always).collect()}
    assert got == {"0": (0.75, 1.0, 1.5 / 1.75, 6), "1": (0.0, 0.0, 0.0, 2), "accuracy": (0.75, 0.75, 0.75, 8)}
    assert X.classification_report(always.limit(0)).count() == 0


def test_sketches_of_a_new_day_leave_the_others(spark):
    path = scratch_path(spark, "sketches")
    rows = [(f"2024-01-0{d}", g, k) for d in (1, 2, 3) for g in "ab" for k in range(d * 100)] + [("2024-01-01", "a", None)]
    df = spark.createDataFrame(rows, "day string, g string, user long")
    for day in ("2024-01-01", "2024-01-02", "2024-01-03", "2024-01-02"):  # the second day is written again
        K.add_days(K.daily_sketches(df.where(F.col("day") == day), "day", ["g"], ["user"]), path, "day")
    got = {r.g: (r.n, r.user) for r in K.cube_counts(spark, path, ["g"], ["user"]).collect()}
    assert got.keys() == {"a", "b", None} and (got["a"][0], got["b"][0], got[None][0]) == (601, 600, 1201)
    assert all(abs(users - 300) <= 300 * 5 * 1.04 / 64 for _, users in got.values())
    some = {r.g: r.n for r in K.cube_counts(spark, path, ["g"], ["user"], F.col("day") < "2024-01-02").collect()}
    assert some == {"a": 101, "b": 100, None: 201}


def test_searches_are_stripped_before_they_are_judged(spark):
    rows = [(1, " eggs\n", "\t400001\n"), (2, "\t  ", "400001"), (3, "eggs", "4000017"), (4, "eggs", "40 001"), (5, None, "400001"), (6, "eggs", None), (7, "", "x"), (8, "a b", "40000١")]
    got = {r.search_id: (r.query, r.pincode, r.is_valid, r.reason) for r in R.validate_searches(spark.createDataFrame(rows, "search_id long, query string, pincode string")).collect()}
    assert got[1] == ("eggs", "400001", True, None) and got[2][2:] == (False, "empty query") and got[5][3] == "empty query" and got[7][3] == "empty query"
    assert all(got[k][2:] == (False, "bad pincode") for k in (3, 4, 6, 8))


def test_a_hot_page_is_cut_before_it_is_gathered(spark):
    df = spark.range(2000).select(F.floor(F.col("id") / 5000).alias("page"), F.col("id").alias("line"), F.when(F.col("id") % 2 == 0, 3).otherwise(5).alias("cap"))
    top = R.first_n_per_page(df, ["page"], [F.col("line")], F.col("cap"), 5)
    assert [r.line for r in top.orderBy("line").collect()] == [0, 1, 2, 3] and "WindowGroupLimit" in top._jdf.queryExecution().toString()


def test_history_table_and_stored_size(spark):
    root = scratch_path(spark, "size")
    df = spark.createDataFrame([(1, "eggs", "400001", 2, None)], "id long, query string, pincode string, result_count long, searched_at timestamp_ntz")
    df.write.parquet(root)
    table = spark.read.parquet(root)
    assert S.history_table(table).columns == ["ID", "Query", "Pincode", "Results", "Searched At"]
    assert S.store_stats(table.limit(0), table).first().total_searches == 1 and S.file_kb(spark, table.inputFiles()) > 0
    with pytest.raises(Exception):
        spark.createDataFrame([("x",)], "a string").write.text(f"{root}-model/metadata")
        load_model(f"{root}-model")
    assert load_model(f"{root}-none") is None


def test_row_digests_tell_nulls_from_empty_texts(spark):
    a = spark.createDataFrame([("x", None), ("", "x"), ("x", None)], "a string, b string")
    b = spark.createDataFrame([("x", None), (None, "x"), ("x", None)], "a string, b string")
    assert R.row_digests(a).exceptAll(R.row_digests(b)).count() == 1 and R.row_digests(a).exceptAll(R.row_digests(a)).isEmpty()
    assert R.row_digests(a).exceptAll(R.row_digests(a.distinct())).count() == 1
