"""Distinct counts that can be merged: one HyperLogLog sketch per day and group, merged by any grouping.

A new day reads only its own rows and appends its sketches; a report over any days and any cube of the groups reads
sketches, never the rows again. The relative standard error is about 1.04 / sqrt(2 ** ``lg_k``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: log2 of a sketch's places.
LG_K = 12


def daily_sketches(rows: DataFrame, day: str, groups: list[str], counted: list[str], lg_k: int = LG_K) -> DataFrame:
    """(day, groups, n, <counted>_sketch ...): row counts and a sketch of each counted column. Nulls are not counted."""
    return rows.groupBy(day, *groups).agg(F.count(F.lit(1)).alias("n"), *[F.hll_sketch_agg(c, lg_k).alias(f"{c}_sketch") for c in counted])


def add_days(sketches: DataFrame, path: str, day: str) -> None:
    """Write the days that ``sketches`` holds; a day that is written again replaces its earlier version."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def cube_counts(spark: SparkSession, path: str, groups: list[str], counted: list[str], days=None) -> DataFrame:
    """(groups, n, <counted> ...) for every combination of the groups (null: all), estimated from the stored sketches; ``days`` is a filter on them."""
    s = spark.read.parquet(path)
    s = s if days is None else s.where(days)
    merged = s.cube(*groups).agg(F.sum("n").alias("n"), *[F.hll_union_agg(f"{c}_sketch").alias(f"{c}_sketch") for c in counted])
    return merged.select(*groups, "n", *[F.hll_sketch_estimate(f"{c}_sketch").alias(c) for c in counted])
