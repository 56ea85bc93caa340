"""Shared Spark plans over the driver tables (lazy; each query builds its own)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.delivery import stamp_delivery
from ..operators.ranking import heavy_values, score_and_rank, with_value_score
from ..operators.standardise import standardise
from ..sources import raw_offers, searches, table


def listings(spark: SparkSession, sf: str, size_mode: str = "basic") -> DataFrame:
    """Standard listings with pincode-based delivery minutes."""
    return stamp_delivery(standardise(raw_offers(spark, sf), size_mode=size_mode))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return with_value_score(listings(spark, sf))


def ranked(spark: SparkSession, sf: str, scope: str = "search") -> DataFrame:
    return score_and_rank(listings(spark, sf), scope=scope, heavy=heavy_searches(spark, sf))


def heavy_searches(spark: SparkSession, sf: str) -> DataFrame:
    """Searches with too many captured offers for one task, counted on the stored keys alone."""
    return heavy_values(table(spark, sf, "lineitem"), F.col("l_orderkey"), "search_id")


def search_table(spark: SparkSession, sf: str) -> DataFrame:
    return searches(spark, sf)
