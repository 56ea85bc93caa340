"""The searches/prices store as Parquet tables.

Both tables are partitioned by (search_month, batch_id): history queries prune by
the months of the searches they look for, and a batch is appended beside what the
store holds. Writes use dynamic partition overwrite, so writing the same batch again
replaces that batch and nothing else (a retry after a lost executor changes nothing).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import without_shuffles
from .metrics import stored

SEARCHES_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("query", T.StringType(), False),
    T.StructField("pincode", T.StringType(), False),
    T.StructField("result_count", T.LongType(), True),
    T.StructField("searched_at", T.TimestampNTZType(), False),
])

PRICE_COLUMNS = ["search_id", "platform", "product_name", "brand", "price", "mrp", "discount_pct",
                 "quantity", "unit", "size_label", "price_per_unit", "unit_norm", "delivery_mins",
                 "in_stock", "rank", "savings", "is_best_deal", "pincode", "source", "scraped_at",
                 "processed_at"]


def _flag(c: Column) -> Column:
    """Boolean -> 0/1, null -> 0 (booleans are stored as integers)."""
    return F.when(c, F.lit(1)).otherwise(F.lit(0))


def price_rows(ranked: DataFrame, processed_at: Column | None = None) -> DataFrame:
    """The 21 stored price columns with the store's defaults (K5).

    Columns absent from the input take the defaults (in_stock true, rank 1,
    savings 0.0, is_best_deal false, source LIVE); present nulls stay null,
    except the two flags, which store null as 0.
    """
    cols = set(ranked.columns)

    def get(name: str, default: Column) -> Column:
        return F.col(name) if name in cols else default.alias(name)

    out = [
        F.col("search_id"),
        *[get(c, F.lit(None).cast("string")) for c in ("platform", "product_name", "brand")],
        *[get(c, F.lit(None).cast("double")) for c in ("price", "mrp", "discount_pct")],
        *[get(c, F.lit(None).cast("string")) for c in ("quantity", "unit", "size_label")],
        get("price_per_unit", F.lit(None).cast("double")),
        get("unit_norm", F.lit(None).cast("string")),
        get("delivery_mins", F.lit(None).cast("int")),
        _flag(get("in_stock", F.lit(True))).alias("in_stock"),
        get("rank", F.lit(1)).cast("int").alias("rank"),
        get("savings", F.lit(0.0)).alias("savings"),
        _flag(get("is_best_deal", F.lit(False))).alias("is_best_deal"),
        get("pincode", F.lit(None).cast("string")),
        get("source", F.lit("LIVE")).alias("source"),
        get("scraped_at", F.lit(None).cast("timestamp_ntz")),
        (processed_at if processed_at is not None else get("processed_at", F.current_timestamp()))
        .alias("processed_at"),
    ]
    return ranked.select(*out)


def search_rows(searches: DataFrame, prices: DataFrame) -> DataFrame:
    """searches(id, query, pincode, result_count, searched_at) (K4).

    result_count is the number of stored prices of the search; the count is a
    partial aggregation before the join, so a hot search costs one row.
    """
    return _with_counts(searches, prices.groupBy("search_id").agg(F.count(F.lit(1)).alias("result_count")))


def _with_counts(searches: DataFrame, counts: DataFrame) -> DataFrame:
    return (searches.join(counts, "search_id", "left")
            .select(F.col("search_id").alias("id"), "query", "pincode",
                    F.coalesce("result_count", F.lit(0)).cast("long").alias("result_count"),
                    "searched_at"))


PARTITIONS = ["search_month", "batch_id"]
_PARTITION_FIELDS = [T.StructField("search_month", T.StringType()), T.StructField("batch_id", T.StringType())]


def _month(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM")


def _save(df: DataFrame, path: str) -> None:
    with without_shuffles(df.sparkSession):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)


def create_store(spark: SparkSession, root: str, prices_schema: T.StructType) -> None:
    """Empty tables where there are none (K6): a store can be read before its first batch."""
    for name, schema in (("prices", prices_schema), ("searches", SEARCHES_SCHEMA)):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")


def write_store(prices: DataFrame, searches: DataFrame, root: str, batch_id: str = "0") -> tuple[str, str]:
    """Append one batch of searches and their prices (K4); the same batch_id replaces its earlier version.

    A price belongs to the month of its search; without a search to that of its capture.
    """
    dated = dated_prices(prices, searches.select(F.col("id").alias("search_id"), "searched_at"))
    return _save_prices(dated, root, batch_id), _save_searches(searches, root, batch_id)


def dated_prices(prices: DataFrame, searches: DataFrame) -> DataFrame:
    """``prices`` with the ``search_month`` they are stored under; prices that lie by search, as after ranking, are not shuffled for it."""
    dates = searches.select("search_id", _month("searched_at").alias("search_month"))
    return (prices.join(dates, "search_id", "left")
            .withColumn("search_month", F.coalesce("search_month", _month("scraped_at")))
            .select(*prices.columns, "search_month"))


def write_dated(dated: DataFrame, searches: DataFrame, root: str, batch_id: str = "0") -> tuple[str, str]:
    """``write_store`` of a stored table of ``dated_prices`` with their searches (search_id, query, pincode, searched_at).

    The searches are counted from the table. It has a price once for each row of its search, so the rows of a
    search that comes k times are counted by k.
    """
    rows = searches.groupBy("search_id").agg(F.count(F.lit(1)).alias("_rows"))
    counts = (dated.groupBy("search_id").agg(F.count(F.lit(1)).alias("_n")).join(rows, "search_id")
              .select("search_id", F.expr("_n DIV _rows").alias("result_count")))
    return _save_prices(dated, root, batch_id), _save_searches(_with_counts(searches, counts), root, batch_id)


def _save_prices(dated: DataFrame, root: str, batch_id: str) -> str:
    # Rebalanced by month: a task writes few files, and adaptive execution splits a hot month over
    # tasks by its size. Unlike range bounds that needs no sample, so the rows are computed once.
    _save(dated.hint("rebalance", "search_month").withColumn("batch_id", F.lit(batch_id)), f"{root}/prices")
    return f"{root}/prices"


def _save_searches(searches: DataFrame, root: str, batch_id: str) -> str:
    _save(searches.withColumns({"search_month": _month("searched_at"), "batch_id": F.lit(batch_id)})
          .hint("rebalance", "search_month"), f"{root}/searches")
    return f"{root}/searches"


def read_store(spark: SparkSession, root: str, prices_schema: T.StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """(prices, searches) of all batches, with their partition columns."""
    def read(name: str, schema: T.StructType | None) -> DataFrame:
        reader = spark.read if schema is None else spark.read.schema(T.StructType([*schema.fields, *_PARTITION_FIELDS]))
        return reader.parquet(f"{root}/{name}")
    return read("prices", prices_schema), read("searches", SEARCHES_SCHEMA)


def latest_prices(prices: DataFrame, searches: DataFrame, query: str, pincode: str,
                  limit: int = 200, latest_only: bool = False) -> DataFrame:
    """Stored prices of searches with this query and pincode, best first.

    The filter on searches is pushed to its scan; the matching (month, search id)
    pairs are a semi-join key set for prices, whose month partitions are pruned by it. The pairs are stored first, so that
    the join is planned by their own size: few of them never make the prices be shuffled. ``latest_only`` keeps only the most recent
    matching search time (the reference mixes all past searches).
    """
    s = searches.where((F.col("query") == query) & (F.col("pincode") == pincode))
    if latest_only:
        last = s.agg(F.max("searched_at").alias("_last"))
        s = s.join(last, s.searched_at == last._last, "left_semi")
    keys = ["search_month", "search_id"] if "search_month" in prices.columns else ["search_id"]
    asked = stored(s.withColumnRenamed("id", "search_id").select(*keys, "query"), "asked-searches")
    asked = asked.where(F.col("query") == query)  # a stored table is only used to prune months where it is filtered
    p = prices.join(asked, keys, "left_semi").drop(*PARTITIONS)
    # rank, price as stored; the remaining columns only make the order total,
    # so that the first ``limit`` rows are the same on every run.
    order = [F.col("rank").asc_nulls_last(), F.col("price").asc_nulls_last()] + [
        F.col(c).asc_nulls_last() for c in PRICE_COLUMNS if c not in ("rank", "price")]
    return p.orderBy(*order).limit(limit)


def search_history(searches: DataFrame, limit: int = 20) -> DataFrame:
    """Last ``limit`` searches, id descending (T4)."""
    return (searches.select("id", "query", "pincode", "result_count", "searched_at")
            .orderBy(F.col("id").desc()).limit(limit))


#: Headings of the history table, in its order.
HISTORY_HEADINGS = {"id": "ID", "query": "Query", "pincode": "Pincode", "result_count": "Results", "searched_at": "Searched At"}


def history_table(searches: DataFrame, limit: int = 20) -> DataFrame:
    """The search history under its headings."""
    return search_history(searches, limit).select(*[F.col(c).alias(h) for c, h in HISTORY_HEADINGS.items()])


def file_kb(spark: SparkSession, files: list[str]) -> float:
    """Size of the files in KB, one decimal, as the file system reports it."""
    jvm = spark._jvm
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in files]
    total = sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths)
    return round(total / 1024.0, 1)


def store_stats(prices: DataFrame, searches: DataFrame) -> DataFrame:
    """Row counts of both tables and the stored size in KB (A3).

    Rows are counted per (table, file) first, so each file's size enters the
    final sum once; one partial aggregation, no join.
    """
    def tagged(df: DataFrame, tag: str) -> DataFrame:
        return df.select(F.lit(tag).alias("t"), F.col("_metadata.file_path").alias("f"),
                         F.col("_metadata.file_size").alias("b"))
    per_file = (tagged(prices, "p").unionByName(tagged(searches, "s"))
                .groupBy("t", "f", "b").agg(F.count(F.lit(1)).alias("n")))
    return per_file.agg(
        F.coalesce(F.sum(F.when(F.col("t") == "p", F.col("n"))), F.lit(0)).alias("total_prices"),
        F.coalesce(F.sum(F.when(F.col("t") == "s", F.col("n"))), F.lit(0)).alias("total_searches"),
        F.round(F.coalesce(F.sum("b"), F.lit(0)) / 1024.0, 1).alias("db_size_kb"))


def integrity_report(prices: DataFrame, searches: DataFrame) -> DataFrame:
    """Parent/child checks (J8): one row per check with its count.

    Both tables are counted by search first and meet once; a null matches nothing.
    """
    p = prices.groupBy("search_id").agg(F.count(F.lit(1)).alias("_p"))
    s = searches.groupBy(F.col("id").alias("search_id")).agg(F.count(F.lit(1)).alias("_s"))
    rows = {"prices_without_search": F.when(F.col("_s").isNull(), F.col("_p")),
            "searches_without_prices": F.when(F.col("_p").isNull(), F.col("_s")),
            "searches_with_prices": F.when(F.col("_p").isNotNull(), F.col("_s"))}
    sums = p.join(s, "search_id", "full").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(check) for check, n in rows.items()])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(check).alias("check"), F.col(check).alias("n")) for check in rows])))
