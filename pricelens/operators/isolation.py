"""M9: an isolation forest as tables.

Growing: a hash of its id deals a row to one of the trees with the chance that gives each tree ``sample`` rows
on average, whatever the size of the table, so the forest is grown from ``trees`` * ``sample`` rows. All trees grow a level at a time:
an aggregate per node (rows, least and greatest value of each feature), a split of one varying feature at
a place between its bounds, both by a hash of tree and node, and a join that moves the rows on. A node with
one row, without a varying feature or at the last level is a leaf.

Scoring: each row goes down all trees by joins with the splits of a level, a broadcast whose size
depends on ``trees`` and ``sample`` alone; the path lengths are summed per row before they are shuffled.
A row's path length in a tree is its leaf's depth plus the mean path length of the rows that
the leaf holds. Short paths are outliers.

Nulls in a feature count as zero; rows without an id take no part; ids are meant to be unique.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .quantile import exact_quantile

#: Trees, and rows that each is grown from.
TREES, SAMPLE = 100, 256
#: Euler's constant.
GAMMA = 0.5772156649
#: Path lengths are rounded to so many places, so that their sum does not depend on the order.
PLACES = 6


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of md5 of the parts: the same in any engine."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def mean_path(n: Column) -> Column:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    m = n.cast("double")
    return F.when(n <= 1, F.lit(0.0)).when(n == 2, F.lit(1.0)).otherwise(2.0 * (F.log(m - 1.0) + GAMMA) - 2.0 * (m - 1.0) / m)


def levels_of(sample: int) -> int:
    return max(1, math.ceil(math.log2(sample)))


def _stored(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def grow(rows: DataFrame, id_column: str, features: list[str], trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """The forest: (tree, node, level, feature, place, path); a leaf has a path, any other node a feature (its number) and a place. Node 1 is the root, 2k and 2k + 1 follow k."""
    n = rows.count()
    share = min(1.0, trees * sample / n) if n else 0.0
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    whole = rows.where(F.col(id_column).isNotNull() & (uniform(F.col(id_column), F.lit("in")) < share))
    held = _stored(whole.select(F.floor(uniform(F.col(id_column), F.lit("tree")) * trees).cast("int").alias("tree"), F.lit(1).cast("long").alias("node"), x.alias("x")), "forest-sample")
    last, found = levels_of(sample), None
    for level in range(last + 1):
        bounds = [F.struct(F.min(F.col("x")[k]).alias("lo"), F.max(F.col("x")[k]).alias("hi")) for k in range(len(features))]
        stats = held.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"), F.array(*bounds).alias("b"))
        varying = F.filter(F.sequence(F.lit(0), F.lit(len(features) - 1)), lambda k: F.col("b")[k]["hi"] > F.col("b")[k]["lo"])
        leaf = (F.col("n") <= 1) | (F.size("varying") == 0) | F.lit(level == last)
        pick = F.col("varying")[F.floor(uniform(F.col("tree"), F.col("node"), F.lit("feature")) * F.size("varying")).cast("int")]
        chosen = F.col("b")[F.col("feature")]
        place = chosen["lo"] + uniform(F.col("tree"), F.col("node"), F.lit("place")) * (chosen["hi"] - chosen["lo"])
        nodes = (stats.withColumn("varying", varying).withColumn("leaf", leaf)
                 .withColumn("feature", F.when(~F.col("leaf"), pick)).withColumn("place", F.when(~F.col("leaf"), place))
                 .withColumn("path", F.when(F.col("leaf"), F.round(F.lit(float(level)) + mean_path(F.col("n")), PLACES)))
                 .select("tree", "node", F.lit(level).alias("level"), "feature", "place", "path"))
        nodes = _stored(nodes, f"forest-level-{level}")
        found = nodes if found is None else found.unionByName(nodes)
        if level < last:
            on = held.join(nodes.where("path IS NULL").drop("level", "path"), ["tree", "node"])
            held = _stored(on.select("tree", _next(F.col("node"), F.col("x")).alias("node"), "x"), f"forest-rows-{level}")
    return found


def _next(node: Column, x: Column) -> Column:
    return 2 * node + (F.get(x, F.col("feature")) >= F.col("place")).cast("long")


def path_lengths(rows: DataFrame, id_column: str, features: list[str], forest: DataFrame, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """(id, path): the sum of the row's path lengths over all trees that were grown, as a decimal."""
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    grown = F.sequence(F.lit(0), F.lit(trees - 1))
    walk = rows.where(F.col(id_column).isNotNull()).select(
        id_column, x.alias("x"), F.explode(grown).alias("tree"), F.lit(1).cast("long").alias("node"), F.lit(None).cast("double").alias("reached"))
    for level in range(levels_of(sample) + 1):
        here = F.broadcast(forest.where(F.col("level") == level).drop("level"))
        walk = (walk.join(here, ["tree", "node"], "left")
                .select(id_column, "x", "tree", F.when(F.col("feature").isNotNull(), _next(F.col("node"), F.col("x"))).otherwise(F.col("node")).alias("node"),
                        F.coalesce("reached", "path").alias("reached")))
    return walk.groupBy(id_column).agg(F.sum(F.col("reached").cast(f"decimal(18,{PLACES})")).alias("path"))


def outliers(rows: DataFrame, id_column: str, features: list[str], forest: DataFrame, share: float, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """(id, path, is_anomaly): the rows whose paths are shorter than the exact ``share`` quantile of all paths."""
    paths = _stored(path_lengths(rows, id_column, features, forest, trees, sample).withColumn("path", F.col("path").cast("double")), "forest-paths")
    cut = exact_quantile(paths, "path", share)
    return paths.withColumn("is_anomaly", F.col("path") < F.lit(cut).cast("double"))
