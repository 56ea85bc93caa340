"""Reference lookups as constant maps (for per-row lookups) and tiny DataFrames.

Their size is fixed by the reference data (16 x 6 + 6 + 7 entries), so a
literal map inside the projection is the cheapest join there is: no Exchange,
no BroadcastExchange, and it stays inside whole-stage codegen.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..reference_data import (DEFAULT_LOCATION, DEFAULT_MINS, LOCATIONS, PLATFORMS, TIER2,
                              city_delivery_rows, city_rows)


def _map(pairs) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in pairs))


def city_of(pincode: Column) -> Column:
    """City by the first three pincode digits; unknown -> null."""
    return F.try_element_at(_map(city_rows()), F.substring(pincode, 1, 3))


def delivery_minutes(pincode: Column, platform: Column) -> Column:
    """(prefix, platform) -> else tier-2 by platform -> else 60."""
    key = F.concat_ws("|", F.substring(F.coalesce(pincode, F.lit("")), 1, 3), platform)
    city = F.try_element_at(_map((f"{p}|{pl}", m) for p, _, pl, m in city_delivery_rows()), key)
    tier2 = F.try_element_at(_map(TIER2), platform)
    return F.coalesce(city, tier2, F.lit(DEFAULT_MINS)).cast("int")


def location_of(pincode: Column, table=LOCATIONS, default_row=DEFAULT_LOCATION) -> Column:
    """struct(lat, lng, place) by pincode prefix, else the default location (J5); ``table`` is a shop's own list."""
    m = F.create_map(*chain.from_iterable(
        (F.lit(p), F.struct(F.lit(lat).alias("lat"), F.lit(lng).alias("lng"), F.lit(d).alias("place")))
        for p, lat, lng, d in table))
    default = F.struct(F.lit(default_row[0]).alias("lat"), F.lit(default_row[1]).alias("lng"),
                       F.lit(default_row[2]).alias("place"))
    return F.coalesce(F.try_element_at(m, F.substring(F.coalesce(pincode, F.lit("")), 1, 3)), default)


def platform_attr(platform: Column, attr: str) -> Column:
    idx = {"active": 1, "priority": 2, "host": 3, "search_template": 4, "space": 5,
           "link_template": 6, "page_mins": 7}[attr]
    return F.try_element_at(_map((p[0], p[idx]) for p in PLATFORMS), platform)


PLATFORM_SCHEMA = T.StructType([
    T.StructField("platform", T.StringType(), False),
    T.StructField("active", T.BooleanType(), False),
    T.StructField("priority", T.IntegerType(), False),
    T.StructField("host", T.StringType(), False),
    T.StructField("search_template", T.StringType(), False),
    T.StructField("space", T.StringType(), False),
    T.StructField("link_template", T.StringType(), True),
    T.StructField("page_mins", T.IntegerType(), False),
])


def platforms_df(spark: SparkSession) -> DataFrame:
    """The 7-row platform dimension."""
    return spark.createDataFrame([tuple(p) for p in PLATFORMS], PLATFORM_SCHEMA)

