"""Driver tables and their mapping to the retail domain (searches, offers, ticks).

The driver writes a TPC-H-like star schema. We read it as the history of
searches (orders) and the offers each search returned (line items joined to
parts). Every derived column is a deterministic expression of the source
columns, so an independent SQL engine can rebuild the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..reference_data import PINCODE_PREFIXES, PLATFORM_NAMES

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Session setting: deal a scan of offers over so many tasks. Unset (the default) a scan is read as
#: it is stored; a local run over one large row group sets it, because the offer rules cost more than a shuffle.
SCAN_TASKS = "pricelens.scanTasks"


def dealt(df: DataFrame) -> DataFrame:
    tasks = df.sparkSession.conf.get(SCAN_TASKS, None)
    return df.repartition(int(tasks)) if tasks else df


def _pick(values: list[str], index: Column) -> Column:
    """values[index] for a 0-based integer column (a literal array, no join)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + F.lit(1)).cast("int"))


def platform_of(suppkey: Column) -> Column:
    return _pick(PLATFORM_NAMES, suppkey % len(PLATFORM_NAMES))


def pincode_of(custkey: Column) -> Column:
    return F.concat(_pick(PINCODE_PREFIXES, custkey % len(PINCODE_PREFIXES)), F.lit("001"))


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """searches(search_id, query, pincode, searched_at) from orders."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        o.o_orderkey.alias("search_id"),
        o.o_orderpriority.alias("query"),
        pincode_of(o.o_custkey).alias("pincode"),
        o.o_orderdate.alias("searched_at"),
    )


def _size_text(partkey: Column, size: Column) -> Column:
    s = size.cast("string")
    k = partkey % 12
    return (F.when(k == 0, F.concat((size * 50).cast("string"), F.lit(" g")))
             .when(k == 1, F.concat(s, F.lit(" kg")))
             .when(k == 2, F.concat((size * 100).cast("string"), F.lit(" ml")))
             .when(k == 3, F.concat(s, F.lit("L")))
             .when(k == 4, F.concat(s, F.lit(" pcs")))
             .when(k == 6, F.concat(s, F.lit("gms")))
             .when(k == 7, F.concat(F.lit("pack of "), s, F.lit(" eggs")))
             .when(k == 8, F.concat(F.lit("2 x "), (size * 50).cast("string"), F.lit("g")))
             .when(k == 9, F.lit("half kg"))
             .when(k == 10, F.lit("1/2 liter"))
             .when(k == 11, F.concat(s, F.lit(" dozen"))))


def _amount_text(c: Column) -> Column:
    """Integer cents -> 'units.cc' text, the same in every engine."""
    return F.concat(F.floor(c / F.lit(100)).cast("string"), F.lit("."),
                    F.lpad((c % 100).cast("string"), 2, "0"))


def raw_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_offers: one captured offer per line item, texts as a shop shows them.

    Columns: search_id, line_no, part_id, platform, name, price_text, mrp_text,
    brand, description, url, in_stock, pincode, captured_at.
    """
    li = dealt(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_linestatus", "l_shipdate"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    s = searches(spark, sf_dir).select("search_id", "pincode")

    mrp_c = F.floor(li.l_extendedprice / li.l_quantity * F.lit(100.0) + F.lit(0.5))
    price_c = F.floor(mrp_c * (F.lit(1.0) - li.l_discount) + F.lit(0.5))
    currency = (F.when(li.l_linenumber % 4 == 0, F.lit("Rs. "))
                 .when(li.l_linenumber % 4 == 1, F.lit("₹"))
                 .when(li.l_linenumber % 4 == 2, F.lit("INR "))
                 .otherwise(F.lit("")))
    name = F.concat_ws(" ", F.col("p_name"), _size_text(F.col("p_partkey"), F.col("p_size")))
    padded = F.when(li.l_linenumber % 5 == 0, F.concat(F.lit("  "), name, F.lit("\t"))).otherwise(name)
    pk = F.col("p_partkey").cast("string")
    url = (F.when(F.col("p_partkey") % 3 == 0, F.lit(""))
            .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("/pd/"), pk))
            .otherwise(F.concat(F.lit("https://shop.example.com/pd/"), pk)))

    joined = (li.join(part, li.l_partkey == part.p_partkey, "inner")
                .join(s, li.l_orderkey == s.search_id, "inner"))
    return joined.select(
        F.col("l_orderkey").alias("search_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_id"),
        platform_of(F.col("l_suppkey")).alias("platform"),
        padded.alias("name"),
        F.concat(currency, _amount_text(price_c)).alias("price_text"),
        F.when(F.col("l_discount") > 0, F.concat(F.lit("MRP ₹"), _amount_text(mrp_c)))
         .otherwise(F.lit("")).alias("mrp_text"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("description"),
        url.alias("url"),
        (F.col("l_linestatus") == "O").alias("in_stock"),
        F.col("pincode"),
        F.col("l_shipdate").alias("captured_at"),
    )


def price_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price observations over time from events: (ts, platform, product_id, price).

    platform = event_type, product_id = user_id, price = value.
    """
    e = table(spark, sf_dir, "events")
    return e.select(
        e.event_id.alias("tick_id"),
        e.ts.alias("ts"),
        e.event_type.alias("platform"),
        e.user_id.alias("product_id"),
        e.value.alias("price"),
    )
