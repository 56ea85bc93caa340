"""Catalogue: isolation forest, exact quantiles, mergeable distinct counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import isolation as I
from ..operators import sketches as K
from ..operators.quantile import exact_quantile
from ..session import scratch_path
from ..sources import price_ticks
from .registry import ORACLES, query

SHARES = [0.05, 0.5, 0.95, 0.99]
#: The key's forest is smaller than the default one, so that its SQL stays readable for an engine.
TREES, SAMPLE, CONTAMINATION = 20, 32, 0.05
_LAST = I.levels_of(SAMPLE)


def _u(*parts: str) -> str:
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST(CAST('0x' || substring(md5({text}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0)"


def _forest_sql() -> str:
    z = ORACLES["anomaly_top5pct"].partition("\nSELECT *, abs_z >")[0]
    ctes = [f"{z},\nx AS (SELECT tick_id, price AS x0, abs_z AS x1 FROM z)",
            f"""r0 AS (SELECT CAST(floor({_u('tick_id', "'tree'")} * {TREES}) AS INTEGER) AS tree, CAST(1 AS BIGINT) AS node, x0, x1 FROM x
  WHERE {_u('tick_id', "'in'")} < least(1.0, {TREES * SAMPLE}.0 / (SELECT count(*) FROM x)))""",
            f"w0 AS (SELECT tick_id, x0, x1, CAST(t AS INTEGER) AS tree, CAST(1 AS BIGINT) AS node, CAST(NULL AS DOUBLE) AS reached FROM x, range(0, {TREES}) r(t))"]
    right = "CASE WHEN (CASE WHEN feature = 0 THEN x0 ELSE x1 END) >= place THEN 1 ELSE 0 END"
    for k in range(_LAST + 1):
        ctes += [
            f"""s{k} AS (SELECT tree, node, count(*) AS n, min(x0) AS l0, max(x0) AS h0, min(x1) AS l1, max(x1) AS h1,
  (CASE WHEN max(x0) > min(x0) THEN [0] ELSE CAST([] AS INTEGER[]) END) || (CASE WHEN max(x1) > min(x1) THEN [1] ELSE CAST([] AS INTEGER[]) END) AS v FROM r{k} GROUP BY tree, node)""",
            f"""f{k} AS (SELECT *, CASE WHEN n > 1 AND len(v) > 0 AND {k} < {_LAST} THEN v[1 + CAST(floor({_u('tree', 'node', "'feature'")} * len(v)) AS INTEGER)] END AS feature FROM s{k})""",
            f"""g{k} AS (SELECT tree, node, feature,
  CASE WHEN feature = 0 THEN l0 + {_u('tree', 'node', "'place'")} * (h0 - l0) WHEN feature = 1 THEN l1 + {_u('tree', 'node', "'place'")} * (h1 - l1) END AS place,
  CASE WHEN feature IS NULL THEN round({k} + CASE WHEN n <= 1 THEN 0.0 WHEN n = 2 THEN 1.0
       ELSE 2.0 * (ln(CAST(n AS DOUBLE) - 1.0) + {I.GAMMA}) - 2.0 * (CAST(n AS DOUBLE) - 1.0) / CAST(n AS DOUBLE) END, {I.PLACES}) END AS path FROM f{k})""",
            f"""w{k + 1} AS (SELECT tick_id, x0, x1, w.tree, CASE WHEN feature IS NOT NULL THEN 2 * w.node + {right} ELSE w.node END AS node, coalesce(reached, path) AS reached
  FROM w{k} w LEFT JOIN g{k} g ON g.tree = w.tree AND g.node = w.node)"""]
        if k < _LAST:
            ctes.append(f"r{k + 1} AS (SELECT r.tree, 2 * r.node + {right} AS node, x0, x1 FROM r{k} r JOIN g{k} g ON g.tree = r.tree AND g.node = r.node WHERE path IS NULL)")
    ctes.append(f"p AS (SELECT tick_id, CAST(sum(CAST(reached AS DECIMAL(18, {I.PLACES}))) AS DOUBLE) AS path FROM w{_LAST + 1} GROUP BY tick_id)")
    return ",\n".join(ctes) + f"\nSELECT tick_id, path, path < (SELECT quantile_cont(path, {CONTAMINATION}) FROM p) AS is_anomaly FROM p"


@query("anomaly_forest", _forest_sql())
def anomaly_forest(spark, sf):
    scored = A.zscore_top(price_ticks(spark, sf)).select("tick_id", "price", "abs_z")
    path = scratch_path(spark, "forest-input")
    scored.write.parquet(path)
    rows = spark.read.schema(scored.schema).parquet(path)
    forest = I.grow(rows, "tick_id", ["price", "abs_z"], TREES, SAMPLE)
    return I.outliers(rows, "tick_id", ["price", "abs_z"], forest, CONTAMINATION, TREES, SAMPLE)


@query("price_quantiles", " UNION ALL ".join(f"SELECT CAST({q} AS DOUBLE) AS q, quantile_cont(value, {q}) AS price FROM events" for q in SHARES))
def price_quantiles(spark, sf):
    ticks = price_ticks(spark, sf)
    return spark.createDataFrame([(q, exact_quantile(ticks, "price", q, small=500, accuracy=200)) for q in SHARES], "q double, price double")


@query("distinct_sketches", """
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, count(DISTINCT event_id) AS n_ticks, TRUE AS users_in_error, TRUE AS ticks_in_error
FROM events GROUP BY CUBE (event_type)""")
def distinct_sketches(spark, sf):
    # Sketches of each day, written in two rounds of days; the cube reads sketches only. Five standard errors, or two, are allowed.
    ticks = price_ticks(spark, sf).select(F.to_date("ts").alias("day"), F.col("platform").alias("event_type"), "product_id", "tick_id")
    path = scratch_path(spark, "daily-sketches")
    for half in (0, 1):
        K.add_days(K.daily_sketches(ticks.where(F.dayofmonth("day") % 2 == half), "day", ["event_type"], ["product_id", "tick_id"]), path, "day")
    told = K.cube_counts(spark, path, ["event_type"], ["product_id", "tick_id"])
    exact = ticks.cube("event_type").agg(F.count_distinct("product_id").alias("n_users"), F.count_distinct("tick_id").alias("n_ticks"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.greatest(F.lit(2.0), F.col(b) * (5 * 1.04 / 2 ** (K.LG_K / 2)))
    return (told.withColumnRenamed("event_type", "_t").join(exact, F.col("_t").eqNullSafe(F.col("event_type")))
            .select("event_type", "n", "n_users", "n_ticks", near("product_id", "n_users").alias("users_in_error"), near("tick_id", "n_ticks").alias("ticks_in_error")))
