"""Rank, group max, savings and best-deal flag.

Two scopes, as in the reference:
  * ``group``  - rank by price inside (search_id, product_name, size_label);
                 savings against the group's highest price.
  * ``search`` - rank by value_score over the whole search; savings against
                 the search's highest price.

Skew: one search (or one product group) may hold a large share of all offers.
Rank = 1 + rows of the group with a smaller value, and it is found in two steps
that never need a group in one task. Values are cut into coarse steps (a
logarithmic scale, so a group has at most a few hundred steps in practice). The
rows before a step come from one short list per group: its steps with their
counts, built by partial aggregation. The rows before a value inside its step come from a window over
the distinct values of (group, step). The offers themselves meet that table in
an equi-join on (group, value), which the skew join splits.

The offers are dealt evenly over tasks first, and both uses start from that one
exchange, so the (regex-heavy) listing build runs once and nothing is written.

Where the caller can name the few searches that are too large for a task (``heavy``, from a count of
the source, stored when the plan is made), only their offers go this way. All others are ranked by a plain window: offers that are
already dealt by search, as after a join on it, are then not shuffled again. Both ways give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as X
from .metrics import stored

SCOPES = {
    "group": (["search_id", "product_name", "size_label"], "price"),
    "search": (["search_id"], "value_score"),
}
#: Coarse steps per factor of e.
STEPS = 64
_LAST = (1 << 62) - 1
#: Rows from which a group is not left to one task.
HEAVY = 1 << 18
#: Hash buckets in which the rows of all groups are counted before those of each.
BUCKETS = 1 << 16


def with_value_score(df: DataFrame) -> DataFrame:
    return df.withColumn("value_score",
                         X.value_score(F.col("price_per_unit"), F.col("price"), F.col("delivery_mins")))


def coarse_step(value: Column) -> Column:
    """A step number that never falls as the value rises; NaN and null come last."""
    x = value.cast("double")
    step = F.floor(F.signum(x) * F.log1p(F.abs(x)) * STEPS)
    return (F.when(x.isNull(), F.lit(_LAST + 1)).when(F.isnan(x), F.lit(_LAST))
             .when(F.abs(x) == float("inf"), F.when(x > 0, F.lit(_LAST - 1)).otherwise(F.lit(-_LAST)))
             .otherwise(step))


def heavy_values(source: DataFrame, key: Column, name: str, rows: int | None = None) -> DataFrame:
    """The values of ``key`` that more than ``rows`` rows of ``source`` have, as column ``name``: at most one in ``rows`` rows.

    Rows are counted by a hash of the key first: where no bucket has so many, no value has, and no keys are shuffled.
    """
    least = HEAVY if rows is None else rows
    keyed = source.select(key.alias(name)).withColumn("_b", F.pmod(F.xxhash64(name), F.lit(BUCKETS)))
    full = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > least).select("_b")
    counted = keyed.join(F.broadcast(full), "_b", "left_semi").groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
    return counted.where(F.col("_n") > least).select(name)


def rank_within(df: DataFrame, keys: list[str], order_col: str, max_col: str = "price",
                dense: bool = False, heavy: DataFrame | None = None) -> DataFrame:
    """Add rank (int, SQL RANK or DENSE_RANK semantics, nulls last) and max_<max_col> per group.

    ``heavy`` (one column, distinct values of the first key) names the groups that no task may have to itself.
    """
    if heavy is None:
        return _rank_in_steps(df, keys, order_col, max_col, dense)
    # Counted before the plan is made: without heavy groups there is no second branch that reads and shuffles the rows again.
    few = stored(heavy.select(F.col(heavy.columns[0]).alias("_heavy")), "heavy-groups")
    if few.isEmpty():
        return _rank_in_place(df, keys, order_col, max_col, dense)
    few = F.broadcast(few)  # one in HEAVY rows at most
    on = F.col(keys[0]).eqNullSafe(F.col("_heavy"))
    light, large = df.join(few, on, "left_anti"), df.join(few, on, "left_semi")
    return _rank_in_place(light, keys, order_col, max_col, dense).unionByName(_rank_in_steps(large, keys, order_col, max_col, dense))


def _rank_in_place(df: DataFrame, keys: list[str], order_col: str, max_col: str, dense: bool) -> DataFrame:
    group = Window.partitionBy(*keys).orderBy(F.col(order_col).asc_nulls_last())
    return df.withColumns({
        "rank": (F.dense_rank() if dense else F.rank()).over(group),
        f"max_{max_col}": F.max(max_col).over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})


def _rank_in_steps(df: DataFrame, keys: list[str], order_col: str, max_col: str, dense: bool) -> DataFrame:
    max_name = f"max_{max_col}"
    names = [f"_k{i}" for i in range(len(keys))]
    # A hash of every column: even shares, and the same exchange under both uses below.
    rows = df.repartition(F.xxhash64(*df.columns))
    values = (rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(order_col).alias("_v"))
              .agg(F.count(F.lit(1)).alias("_n"), F.max(max_col).alias("_mx"))
              .withColumn("_s", coarse_step(F.col("_v"))))
    # RANK counts smaller rows; DENSE_RANK counts smaller distinct values.
    weight = F.lit(1).cast("long") if dense else F.col("_n")
    in_step = Window.partitionBy(*names, "_s").orderBy(F.col("_v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("_w", weight)
    values = values.withColumn("_in", F.coalesce(F.sum("_w").over(in_step), F.lit(0)))
    steps = values.groupBy(*names, "_s").agg(F.sum("_w").alias("_w"), F.max("_mx").alias("_mx"))
    groups = steps.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("_s", "_w"))).alias("_l"), F.max("_mx").alias("_top"))
    before = groups.select(*names, "_top", F.inline(F.transform("_l", lambda x, i: F.struct(
        x["_s"].alias("_s"), F.aggregate(F.slice("_l", F.lit(1), i), F.lit(0).cast("long"), lambda t, y: t + y["_w"]).alias("_b")))))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*names, "_s")]
    ranked = values.alias("l").join(before.alias("r"), _all(same)).select(
        *[f"l.{n}" for n in names], "l._v", (F.col("_b") + F.col("_in") + 1).cast("int").alias("rank"), F.col("_top").alias(max_name))
    cond = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip((*keys, order_col), (*names, "_v"))]
    return rows.join(ranked, _all(cond)).drop(*names, "_v")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def score_and_rank(listings: DataFrame, scope: str = "search", processed_at: Column | None = None,
                   heavy: DataFrame | None = None) -> DataFrame:
    """value_score, rank, max_price, savings, is_best_deal (+ processed_at when given); ``heavy`` as in ``rank_within``."""
    keys, order_col = SCOPES[scope]
    df = listings if "value_score" in listings.columns else with_value_score(listings)
    df = rank_within(df, keys, order_col, "price", heavy=heavy)
    df = (df.withColumn("savings", X.round_half_up(F.col("max_price") - F.col("price"), 2))
            .withColumn("is_best_deal", F.col("rank") == 1))
    if processed_at is not None:
        df = df.withColumn("processed_at", processed_at)
    return df


def best_deals(ranked: DataFrame) -> DataFrame:
    return ranked.where(F.col("is_best_deal"))
