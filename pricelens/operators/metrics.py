"""Metrics of a model from the table of its predictions, by aggregates at any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path, without_shuffles


def stored(df: DataFrame, name: str, compression: str = "snappy", by: str | None = None) -> DataFrame:
    """Written once to the shared workspace and read back: predictions are made once, whatever is computed from them."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with without_shuffles(spark):
        df.write.parquet(path, compression=compression, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def running_counts(df: DataFrame, value: str, counts: list[str]) -> DataFrame:
    """``df`` with ``below_<count>``: the sum of each count over all rows with a smaller ``value``. Values must be distinct.

    The rows are range-partitioned, so a task holds a run of values; only the sums by task go
    to the driver. No window gathers more than a task's run.
    """
    ranged = stored(df.repartitionByRange(value).withColumn("_part", F.spark_partition_id()), "running-counts")
    sums = ranged.groupBy("_part").agg(*[F.sum(c).alias(c) for c in counts]).orderBy("_part").collect()
    before, total = [], dict.fromkeys(counts, 0)
    for row in sums:
        before.append((row["_part"], *total.values()))
        total = {c: total[c] + row[c] for c in counts}
    starts = df.sparkSession.createDataFrame(before, "_part int, " + ", ".join(f"_start_{c} long" for c in counts))
    w = Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(starts), "_part")  # a row for each task
    for c in counts:
        out = out.withColumn(f"below_{c}", F.col(f"_start_{c}") + F.coalesce(F.sum(c).over(w), F.lit(0)))
    return out.drop("_part", *[f"_start_{c}" for c in counts])


def auc(scored: DataFrame, label: str = "label", score: str = "score") -> float | None:
    """Area under the ROC curve as the rank sum: the share of (positive, negative) pairs in the right order, a tie counting half.

    Rows are first counted by distinct score. None if a class is missing; rows without label or score do not count.
    """
    rows = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    by_score = rows.groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    exact = "decimal(38,1)"
    pairs = F.col("pos").cast("decimal(19,0)") * (F.col("below_neg") * 2 + F.col("neg")).cast("decimal(19,0)") / 2
    row = running_counts(by_score, "s", ["pos", "neg"]).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(pairs.cast(exact)).alias("right")).first()
    if not row["p"] or not row["n"]:
        return None
    return float(row["right"]) / (float(row["p"]) * float(row["n"]))


def regression(predicted: DataFrame, target: str, prediction: str) -> DataFrame:
    """One row: n, mae, rmse, r2 (null where the target does not vary). Two passes of partial sums: the mean, then the deviations."""
    rows = predicted.where(F.col(target).isNotNull() & F.col(prediction).isNotNull())
    y, e = F.col(target).cast("double"), F.col(target).cast("double") - F.col(prediction)
    mean = rows.agg(F.avg(y)).scalar()
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.avg((y - mean) * (y - mean)).alias("var"))
    return sums.select("n", "mae", F.sqrt("mse").alias("rmse"), F.when(F.col("var") > 0, 1.0 - F.col("mse") / F.col("var")).alias("r2"))


def confusion(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n): all that the report needs, one aggregate."""
    return stored(scored.groupBy(F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")).agg(F.count(F.lit(1)).alias("n")), "confusion")


def classification_report(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class precision, recall, F1 and support, and the overall accuracy (A11), all from the stored confusion counts."""
    cm = confusion(scored, label, prediction)
    per_class = cm.groupBy(F.col("label").alias("cls")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("tp"))
    predicted = cm.groupBy(F.col("prediction").alias("cls")).agg(F.sum("n").alias("predicted"))
    precision, recall = F.coalesce(F.col("tp") / F.col("predicted"), F.lit(0.0)), F.col("tp") / F.col("support")
    rows = (per_class.join(predicted, "cls", "left")
            .select(F.col("cls").cast("string").alias("class"), precision.alias("precision"), recall.alias("recall"),
                    F.coalesce(F.try_divide(2.0 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"), F.col("support").cast("long").alias("support")))
    share = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)) / F.sum("n")
    whole = cm.agg(share.alias("a"), F.sum("n").cast("long").alias("support")).where("support IS NOT NULL")
    return rows.unionByName(whole.select(F.lit("accuracy").alias("class"), F.col("a").alias("precision"), F.col("a").alias("recall"), F.col("a").alias("f1"), "support"))
