"""Captured offers -> the 18-column standard listing (one projection)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as X
from ..functions.sizes import with_size
from ..session import compiled_rules
from ..sources.lookups import platform_attr

LISTING_COLUMNS = ["platform", "product_name", "price", "brand", "description", "source",
                   "scraped_at", "mrp", "discount_pct", "quantity", "unit", "size_label",
                   "price_per_unit", "unit_norm", "delivery_mins", "in_stock", "pincode",
                   "product_url"]


def standardise(raw: DataFrame, size_mode: str = "basic", price_rule: str = "first_amount",
                keep: tuple[str, ...] = ("search_id", "line_no", "part_id")) -> DataFrame:
    """raw offers (name, price_text, mrp_text, brand, description, url, ...) -> listings.

    Offers without a valid (> 0) price or with an empty name are dropped, as the
    page parsers never build them. ``size_mode`` picks the code's size rules
    (``basic``) or the documented ones (``extended``).

    Staged projections: each regex runs once per row; later stages only
    reference the earlier columns (Catalyst keeps non-trivial aliases that are
    used more than once instead of inlining them).
    """
    compiled_rules(raw.sparkSession)
    kept = [F.col(c) for c in keep if c in raw.columns]
    stage = raw.select(
        *kept,
        F.col("platform"),
        X.clean_text(F.col("name")).alias("product_name"),
        X.clean_price(F.col("price_text"), price_rule).alias("_price"),
        X.clean_price(F.col("mrp_text"), price_rule).alias("_mrp_in"),
        X.clean_text(F.col("brand")).alias("brand"),
        X.clean_text(F.col("description")).alias("description"),
        F.col("captured_at").alias("scraped_at"),
        (X.clean_text(F.col("pack")) if "pack" in raw.columns else F.lit("")).alias("_pack"),
        (F.coalesce(F.col("in_stock"), F.lit(True)) if "in_stock" in raw.columns
         else F.lit(True)).alias("in_stock"),
        F.coalesce(F.col("pincode"), F.lit("")).alias("pincode"),
        (X.absolute_url(F.col("url"), F.coalesce(platform_attr(F.col("platform"), "host"), F.lit("")))
         if "url" in raw.columns else F.lit("")).alias("product_url"),
    ).where(F.col("_price").isNotNull() & (F.col("product_name") != ""))

    # A pack text stated by the shop gives size and label; else the name does.
    packed = F.col("_pack") != ""
    stage = stage.withColumn("_sized", F.when(packed, F.col("_pack")).otherwise(F.col("product_name")))
    stage = with_size(stage, "_sized", size_mode, "_size").withColumns({
        "_eff_mrp": X.effective_mrp(F.col("_price"), F.col("_mrp_in")),
        "quantity": F.col("_size.quantity"),
        "unit": F.col("_size.unit"),
        "size_label": F.when(packed, F.col("_pack")).otherwise(F.col("_size.size_label")),
    })
    return stage.select(
        *[F.col(c) for c in keep if c in raw.columns],
        "platform", "product_name",
        X.round_half_up(F.col("_price"), 2).alias("price"),
        "brand", "description",
        F.lit("LIVE").alias("source"),
        "scraped_at",
        X.round_half_up(F.col("_eff_mrp"), 2).alias("mrp"),
        X.discount_pct(F.col("_price"), F.col("_eff_mrp")).alias("discount_pct"),
        "quantity", "unit", "size_label",
        X.unit_price(F.col("_price"), F.col("quantity"), F.col("unit")).alias("price_per_unit"),
        X.unit_label(F.col("unit")).alias("unit_norm"),
        platform_attr(F.col("platform"), "page_mins").cast("int").alias("delivery_mins"),
        "in_stock", "pincode", "product_url",
    )
