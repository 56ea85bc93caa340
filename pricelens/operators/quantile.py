"""Exact quantiles of a column of any size.

A mergeable quantile sketch brackets the wanted rank, an exact count says what lies below and inside the
bracket, and the next round looks at the rows inside only. After a few rounds the bracket is one value or holds at
most ``SMALL`` rows, which are sorted. No aggregate holds all distinct values and no rows are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are sorted at the end, and the sketch's accuracy: a round keeps about four in ``ACCURACY`` rows.
SMALL, ACCURACY = 10_000, 1000


def kth_value(x: DataFrame, k: int, n: int, small: int = SMALL, accuracy: int = ACCURACY) -> float:
    """The value of rank ``k`` (from 0) of the ``n`` rows of the one double column of ``x``."""
    name = x.columns[0]
    value = F.col(name)
    low, high, below, inside = -math.inf, math.inf, 0, n
    while low != high and inside > small:
        rows = x.where(value.between(low, high))
        share = (k - below) / (inside - 1)
        a, b = rows.agg(F.percentile_approx(name, [max(0.0, share - 2 / accuracy), min(1.0, share + 2 / accuracy)], accuracy)).first()[0]
        under, up_to = rows.agg(F.count_if(value < a), F.count_if(value <= b)).first()
        if k - below < under:  # the sketch was too far up
            high, inside = math.nextafter(a, -math.inf), under
        elif k - below >= up_to:
            low, below, inside = math.nextafter(b, math.inf), below + up_to, inside - up_to
        else:
            low, high, below, inside = a, b, below + under, up_to - under
    if low == high:
        return low
    return x.where(value.between(low, high)).sort(name).collect()[k - below][0]


def exact_quantile(df: DataFrame, column: str, q: float, small: int = SMALL, accuracy: int = ACCURACY) -> float | None:
    """The continuous quantile: linear between the two rows around rank (n - 1) * q. Nulls and NaN do not count; None without rows.

    ``df`` is read a few times, so it should be a stored table.
    """
    x = df.select(F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    n = x.count()
    if not n:
        return None
    rank = (n - 1) * q
    k = math.floor(rank)
    low = kth_value(x, k, n, small, accuracy)
    if rank == k:
        return low
    up_to, following = x.agg(F.count_if(F.col("x") <= low), F.min(F.when(F.col("x") > low, F.col("x")))).first()
    high = low if k + 1 < up_to else following
    return low + (high - low) * (rank - k)
