"""City and delivery-minute lookups as table operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lookups import delivery_minutes


def stamp_delivery(listings: DataFrame, prefer_observed: bool = False) -> DataFrame:
    """Set delivery_mins from (pincode prefix, platform) on every row.

    The reference overwrites any minutes read from the page; ``prefer_observed``
    keeps a page value when there is one (Q7).
    """
    est = delivery_minutes(F.col("pincode"), F.col("platform"))
    new = F.coalesce(F.col("delivery_mins"), est) if prefer_observed else est
    return listings.withColumn("delivery_mins", new)

